"""Readers that turn files and tables into documents, and the writers."""
