"""Readers, writers, and the report tables that the queries derive."""
