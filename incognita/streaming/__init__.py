"""Streaming of the pseudonymization engine."""
