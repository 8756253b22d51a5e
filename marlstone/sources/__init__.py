"""Readers of files, pages and feeds, and writers of artifacts."""
