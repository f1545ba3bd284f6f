"""The rule language: its tree, its text form and the checks before anything is compiled."""
