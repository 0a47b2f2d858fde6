"""Functions of the pseudonymization engine."""
