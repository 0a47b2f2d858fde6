"""Spark-native detection, pseudonymization and restoration of sensitive entities in document collections."""
