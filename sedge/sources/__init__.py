"""Readers and writers of line-delimited relations."""

from sedge.sources.text import parse_edges, parse_labels, read_edges, read_labels, write_lines

__all__ = ["parse_edges", "parse_labels", "read_edges", "read_labels", "write_lines"]
