"""Joins, filters, aggregates and jobs over the offer, catalog, history and click tables."""
