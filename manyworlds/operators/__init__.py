"""Relational and data-preparation operators over ordinary (certain) DataFrames."""
