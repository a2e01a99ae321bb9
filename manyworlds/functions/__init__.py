"""Scalar and aggregate functions that Spark SQL lacks under the same name or semantics."""
