"""Observational-study analytics as lazy Spark DataFrame transformations."""
