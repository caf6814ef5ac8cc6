"""Readers, writers and the adapters that turn star tables into a table corpus."""
