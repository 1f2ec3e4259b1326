"""Operators for text corpora: packing into containers, mixing of sources, language labels. Nothing else in the library imports this package."""
