"""Operators of a training-data pipeline over whole text tables.

Each module holds one operator with a general DataFrame -> DataFrame interface;
``queries`` holds the thin registered queries over the given tables and
``sqlref`` their DuckDB statements where SQL can express them.  Nothing outside
this subpackage imports it.
"""
