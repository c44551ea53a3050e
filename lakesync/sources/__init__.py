"""Readers, writers, generators and versioned tables."""
