"""Readers and writers of file formats."""
