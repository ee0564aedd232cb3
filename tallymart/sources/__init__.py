"""Readers, writers and adapters that bring tables into the retail schema."""
