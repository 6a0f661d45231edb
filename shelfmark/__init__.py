"""Catalog analytics for content-addressed media collections, on Spark."""
