"""Marlstone: DataFrame-to-DataFrame analytics over knowledge corpora on Spark."""
