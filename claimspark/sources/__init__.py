"""Where claims come from and go to."""
