"""Sources of the pseudonymization engine."""
