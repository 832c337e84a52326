"""Operators for text corpora and entity data; nothing else in the library imports this subpackage."""
