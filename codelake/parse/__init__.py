"""Parsers from text to items and blocks; plain Python, one call for each file."""

from codelake.parse.scan import LANGUAGE_OF, Item, scan_text
from codelake.parse.extract import extract_item

__all__ = ["LANGUAGE_OF", "Item", "extract_item", "scan_text"]
