"""Queries over the bench tables, each an application of an operator, and SQL that gives the same."""
