"""Donor-level cohort analytics expressed as Spark DataFrame operations."""
