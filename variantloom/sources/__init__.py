"""Readers and writers of the text formats of rare-variant studies."""
