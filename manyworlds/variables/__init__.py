"""Continuous random variables as column values: symbolic arithmetic, constraints, expectation and confidence."""

from manyworlds.variables.symbols import CTable, add, const, from_text, gt, lt, mul, neg, rv, structurally_equal, sub, subscript, to_text

__all__ = ["CTable", "add", "const", "from_text", "gt", "lt", "mul", "neg", "rv", "structurally_equal", "sub", "subscript", "to_text"]
