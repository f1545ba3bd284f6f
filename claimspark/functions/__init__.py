"""Scalar functions of the rule language as column expressions; no Python runs on executors."""
