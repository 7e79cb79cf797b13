"""Readers of feeds, catalogs and landed shop payloads."""
