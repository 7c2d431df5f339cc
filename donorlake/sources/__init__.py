"""Readers, sinks and the cohort views."""
