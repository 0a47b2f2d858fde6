"""Operators of the pseudonymization engine."""
