"""Readers and writers of lines and log tables."""
