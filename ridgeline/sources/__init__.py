"""Readers: driver tables, drifting JSON exports, binary file listings."""
