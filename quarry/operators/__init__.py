"""Operators on DataFrames: listings, merges, comparison of sources, routes, contacts, records and pages."""
