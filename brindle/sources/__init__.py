"""Readers and writers of delimited text and of columnar files."""

from brindle.sources.columnar import read_columnar, write_columnar
from brindle.sources.delimited import read_delimited, write_delimited

__all__ = ["read_columnar", "read_delimited", "write_columnar", "write_delimited"]
