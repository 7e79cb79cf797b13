"""Operators over large text corpora: mixing, token files, media, dedup, scoring, packing, scans.

Nothing else in the library imports this package.
"""
