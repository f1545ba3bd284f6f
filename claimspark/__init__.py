"""Governed claims, rules and their history as DataFrame plans."""
