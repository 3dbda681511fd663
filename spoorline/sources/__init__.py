"""Readers, writers and converters of question-answering records."""
