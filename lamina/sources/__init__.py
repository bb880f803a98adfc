"""Readers: framed streams, tables, loose objects."""
