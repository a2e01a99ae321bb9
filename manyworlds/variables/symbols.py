"""Expressions over random variables as column values, and tables with constraints.

An expression is stored in postfix order as an array of nodes, because Spark has no recursive types: building a sum is a
concatenation, and stays in the JVM. A constraint (an atom) states that one expression is greater than another. A table
with constraints keeps them in an array column: a row exists where all of them hold.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyworlds.variables.distributions import DISTRIBUTIONS

NODE = "struct<op:string,c:double,dist:string,id:bigint,sub:bigint,params:array<double>>"
EQN = f"array<{NODE}>"
ATOM = f"struct<l:{EQN},r:{EQN}>"
ATOMS = "_atoms"
Value = Column | float | int

_calls, _run = itertools.count(1), uuid.uuid4().hex


def _node(op: str, c: Column | None = None, dist: str | None = None, ident: Column | None = None, sub: int | None = None, params: Column | None = None) -> Column:
    # No nulls: on the way to Python a null beside them would turn the 64-bit names into floats.
    return F.struct(
        F.lit(op).alias("op"),
        (F.lit(0.0) if c is None else c).cast("double").alias("c"),
        F.lit(dist or "").alias("dist"),
        (F.lit(0) if ident is None else ident).cast("bigint").alias("id"),
        F.lit(sub or 0).cast("bigint").alias("sub"),
        (F.array() if params is None else params).cast("array<double>").alias("params"),
    )


def const(value: Value) -> Column:
    """A number as an expression."""
    return F.array(_node("c", value if isinstance(value, Column) else F.lit(float(value)))).cast(EQN)


def rv(dist: str, *params: Value, key: Sequence[str | Column] = (), salt: str | None = None) -> Column:
    """A random variable of a distribution. `key` names it per row: rows with equal keys share the variable, and a call
    without `salt` makes variables of its own."""
    if dist not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution type {dist}")
    if len(params) != DISTRIBUTIONS[dist].parameters:
        raise ValueError(f"{dist} has {DISTRIBUTIONS[dist].parameters} parameters")
    ident = F.xxhash64(F.lit(salt if salt is not None else f"{_run}/{next(_calls)}"), *(F.col(k) if isinstance(k, str) else k for k in key))
    return F.array(_node("v", None, dist, ident, 0, F.array(*(p.cast("double") if isinstance(p, Column) else F.lit(float(p)) for p in params)).cast("array<double>"))).cast(EQN)


def _eqn(value: Value) -> Column:
    """Numbers become constants; columns are taken for expressions."""
    return value if isinstance(value, Column) else const(value)


def add(a: Value, b: Value) -> Column:
    return F.concat(_eqn(a), _eqn(b), F.array(_node("+")).cast(EQN))


def mul(a: Value, b: Value) -> Column:
    return F.concat(_eqn(a), _eqn(b), F.array(_node("*")).cast(EQN))


def neg(a: Value) -> Column:
    return F.concat(_eqn(a), F.array(_node("-")).cast(EQN))


def sub(a: Value, b: Value) -> Column:
    return add(a, neg(b))


def such_that(value: Column, atoms: Column) -> Column:
    """`value` where all atoms hold, else 0."""
    return F.concat(value, F.flatten(F.transform(atoms, lambda a: F.concat(a["l"], a["r"], F.array(_node("?")).cast(EQN)))))


def subscript(a: Column, k: int) -> Column:
    """Component `k` of a variable: independent draws of the same distribution."""
    return F.transform(a, lambda n: n.withField("sub", F.lit(k).cast("bigint")))


def structurally_equal(a: Column, b: Column) -> Column:
    """Whether two expressions are built alike from the same variables."""
    return a.eqNullSafe(b)


def gt(a: Value, b: Value) -> Column:
    """The constraint a > b."""
    return F.struct(_eqn(a).alias("l"), _eqn(b).alias("r")).cast(ATOM)


def lt(a: Value, b: Value) -> Column:
    """The constraint a < b, stored as b > a."""
    return gt(b, a)


def _number(x: float) -> str:
    """A number in as few digits as give it back."""
    return str(int(x)) if abs(x) < 1e15 and x == int(x) else repr(float(x))


def _text(nodes) -> str:
    stack: list[str] = []
    for n in nodes:
        op = n["op"]
        if op == "c":
            stack.append(f"({_number(n['c'])})")
        elif op == "v":
            stack.append(f"[{n['id']}:{n['sub']}=>{n['dist']}({','.join(map(_number, n['params']))})]")
        elif op == "-":
            stack.append(f"-{stack.pop()}")
        elif op == "?":
            r, left, v = stack.pop(), stack.pop(), stack.pop()
            stack.append(f"|{v}{left}>{r}")
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(f"{op}{a}{b}")
    return stack.pop()


def to_text(eqn: str | Column) -> Column:
    """Prefix text of expressions, for reading."""

    @F.pandas_udf("string")
    def text(e: pd.Series) -> pd.Series:
        return e.map(lambda n: None if n is None else _text(n))

    return text(eqn)


_TOKEN = re.compile(r"\((?P<c>[^()]*)\)|\[(?P<id>-?\d+):(?P<sub>-?\d+)=>(?P<dist>\w+)\((?P<params>[^()]*)\)\]|(?P<op>[-+*|>])")


def _nodes(text: str) -> list[dict]:
    """The nodes of a prefix text, in postfix order: read from its end, operands are found before their operator."""
    found, tokens = [], list(_TOKEN.finditer(text))
    if "".join(t[0] for t in tokens) != text.strip():
        raise ValueError(f"not an expression: {text}")
    node = lambda op, c=0.0, dist="", ident=0, sub=0, params=(): {"op": op, "c": c, "dist": dist, "id": ident, "sub": sub, "params": list(params)}
    for t in reversed(tokens):
        if t["c"] is not None:
            found.append([node("c", float(t["c"]))])
        elif t["id"] is not None:
            found.append([node("v", 0.0, t["dist"], int(t["id"]), int(t["sub"]), [float(p) for p in t["params"].split(",") if p])])
        elif t["op"] != ">":  # a comparison's mark; the bar before its value says what it is
            few = {"-": 1, "|": 3}.get(t["op"], 2)
            if len(found) < few:
                raise ValueError(f"not an expression: {text}")
            operands = [found.pop() for _ in range(few)]
            found.append([n for o in operands for n in o] + [node("?" if t["op"] == "|" else t["op"])])
    if len(found) != 1:
        raise ValueError(f"not an expression: {text}")
    return found[0]


def from_text(text: str | Column) -> Column:
    """Expressions from their prefix text, the inverse of :func:`to_text`; null for null. Another text is an error."""

    @F.pandas_udf(EQN)
    def parsed(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else _nodes(x))

    return parsed(text)


class CTable:
    """A table whose rows exist where their constraints hold."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df if ATOMS in df.columns else df.withColumn(ATOMS, F.array().cast(f"array<{ATOM}>"))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ATOMS]

    def where(self, *conditions: Column) -> CTable:
        """Ordinary conditions filter rows; constraints join the row's others. Null constraints are none."""
        out = self.df
        for c in conditions:
            kind = out.select(c).schema[0].dataType.simpleString()
            if kind == "boolean":
                out = out.filter(c)
            else:
                out = out.withColumn(ATOMS, F.when(c.isNotNull(), F.concat(ATOMS, F.array(c))).otherwise(F.col(ATOMS)))
        return CTable(out)

    def select(self, *columns: str | Column) -> CTable:
        """Projection; constraints always come along."""
        return CTable(self.df.select(*columns, ATOMS))

    def join(self, other: CTable, on: str | Sequence[str] | Column | None = None) -> CTable:
        """Rows of both, with both's constraints."""
        left, right = self.df.withColumnRenamed(ATOMS, "_atoms_left"), other.df.withColumnRenamed(ATOMS, "_atoms_right")
        joined = left.crossJoin(right) if on is None else left.join(right, on)
        return CTable(joined.withColumn(ATOMS, F.concat("_atoms_left", "_atoms_right")).drop("_atoms_left", "_atoms_right"))

    def union_all(self, other: CTable) -> CTable:
        return CTable(self.df.unionByName(other.df))
