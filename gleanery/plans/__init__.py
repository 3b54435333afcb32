"""Whole query plans: the search engine, and the catalogue of registered queries with their SQL."""
