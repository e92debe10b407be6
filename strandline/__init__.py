"""Storing, searching and distilling event and conversation histories on Spark."""
