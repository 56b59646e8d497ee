"""Readers and writers: spreadsheets, decks, strategies, audit logs."""
