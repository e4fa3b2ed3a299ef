"""Readers of public formats and writers of tables and texts."""
