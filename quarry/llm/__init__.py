"""Operators for preparing training data: ten corpus jobs on Spark DataFrames.

Each module holds one operator with its general interface and the thin
``opN_`` query that applies it to whole tables.  ``registry`` collects the
queries and their SQL.
"""
