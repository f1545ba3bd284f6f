"""Operators over claims, actions and their history."""
