"""Operators over records, files, lines, symbols, graphs, coverage, revisions and logs."""
