"""Operators for large text corpora (training-data preparation).

One module per operator; ``queries.py`` holds the thin registered queries and
their DuckDB SQL.  Nothing else in the library imports this subpackage.
"""
