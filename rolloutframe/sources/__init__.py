"""Readers, logical views and writers."""
