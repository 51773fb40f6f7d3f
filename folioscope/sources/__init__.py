"""Readers: files by content, text pages, office containers, evaluation data."""
