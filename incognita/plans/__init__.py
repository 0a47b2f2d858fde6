"""Plans of the pseudonymization engine."""
