"""Readers, writers and saved state."""
