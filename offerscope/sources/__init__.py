"""Readers, writers and input shapes."""
