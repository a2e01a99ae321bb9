"""Readers and writers: Parquet tables of a directory, delimited text, JDBC, value lists and series."""

from manyworlds.sources.tables import delimited, generate_series, jdbc, table, values, write_delimited

__all__ = ["delimited", "generate_series", "jdbc", "table", "values", "write_delimited"]
