"""Acoustic fingerprinting and corpus preparation on Spark."""
