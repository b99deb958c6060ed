"""Readers over tables of documents, and sinks."""
