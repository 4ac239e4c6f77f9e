"""Readers and writers for the record formats."""
