"""Queries composed from the operators, and their SQL oracles."""
