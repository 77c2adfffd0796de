"""Readers and writers: driver tables, links, captures, the document store."""
