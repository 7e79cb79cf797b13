"""Building blocks that several jobs share: ordered look-backs, ingest and export plans."""
