"""From the language's tree to DataFrame plans."""
