"""Nested records to related flat tables, by shared inlining of the schema graph.

The schema is read as a graph of element types. Elements that occur once below their parent are inlined as
columns of the parent's table; repeated elements, elements shared by several parents and maps get tables of
their own. Elements with the same structure that occur below several paths of one name share one table, whose
``path`` column says which field a row comes from. Rows carry the root's key and their positions along the
path, which are the foreign key to the parent row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Branch:
    """One occurrence of a repeated element: its path, element type and the repeated paths above it."""

    path: tuple[str, ...]
    element: T.DataType
    above: tuple[tuple[str, ...], ...] = ()


@dataclass
class Plan:
    """``inlined``: path and column name of singletons by table; ``branches``: occurrences by table name."""

    root: list[tuple[tuple[str, ...], str]] = field(default_factory=list)
    branches: dict[str, list[Branch]] = field(default_factory=dict)


def _shape(t: T.DataType) -> str:
    return t.simpleString()


def _inline(t: T.DataType, at: tuple[str, ...]) -> tuple[list[tuple[tuple[str, ...], str]], list[tuple[tuple[str, ...], T.DataType]]]:
    """Singleton leaves below ``t`` and the repeated elements met on the way."""
    if isinstance(t, T.StructType):
        leaves, repeated = [], []
        for f in t.fields:
            a, b = _inline(f.dataType, (*at, f.name))
            leaves += a
            repeated += b
        return leaves, repeated
    if isinstance(t, T.ArrayType):
        return [], [(at, t.elementType)]
    if isinstance(t, T.MapType):
        return [], [(at, T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)]))]
    return [(at, "_".join(at))], []


def plan_tables(schema: T.StructType) -> Plan:
    """Analyse the schema graph: a table for each repeated element, shared where several fields repeat the same structure."""
    plan = Plan()
    leaves, repeated = _inline(schema, ())
    plan.root = leaves
    todo = [Branch(p, e) for p, e in repeated]
    found: list[Branch] = []
    while todo:
        b = todo.pop(0)
        found.append(b)
        if isinstance(b.element, (T.ArrayType, T.MapType, T.StructType)):
            _, below = _inline(b.element, b.path)
            todo += [Branch((*p, "item") if p == b.path else p, e, (*b.above, b.path)) for p, e in below]
    by_shape: dict[tuple, list[Branch]] = {}
    for b in found:
        nested = isinstance(b.element, (T.StructType, T.ArrayType))
        by_shape.setdefault((_shape(b.element), len(b.above)) if nested else b.path, []).append(b)
    for group in by_shape.values():
        plan.branches["_".join(group[0].path)] = group
    return plan


def _get(base: Column, path: tuple[str, ...]) -> Column:
    for p in path:
        base = base.getField(p)
    return base


def _array(c: Column, t: T.DataType) -> Column:
    return F.map_entries(c) if isinstance(t, T.MapType) else c


def _type_at(t: T.DataType, path: tuple[str, ...]) -> T.DataType:
    for p in path:
        t = t[p].dataType
    return t


def _rows(records: DataFrame, keys: list[str], branch: Branch) -> DataFrame:
    """keys, pos1..posN, path, and the element's inlined columns (or ``value``); null elements give no row."""
    steps = [*branch.above, branch.path]
    d = records.select(*[F.col(k) for k in keys], F.col(steps[0][0]).alias("_e"))
    t: T.DataType = records.schema[steps[0][0]].dataType
    at = steps[0][:1]
    for i, step in enumerate(steps, 1):
        below = tuple(x for x in step[len(at) :] if x != "item")
        t = _type_at(t, below)
        src = _array(_get(F.col("_e"), below), t)
        d = d.select(*keys, *[f"pos{k}" for k in range(1, i)], F.posexplode(src).alias("_p", "_x"))
        d = d.where("_x is not null").select(*keys, *[f"pos{k}" for k in range(1, i)], (F.col("_p") + 1).alias(f"pos{i}"), F.col("_x").alias("_e"))
        t = T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)]) if isinstance(t, T.MapType) else t.elementType
        at = step
    pos = [f"pos{k}" for k in range(1, len(steps) + 1)]
    leaves, _ = _inline(t, ())
    used, columns = {*keys, *pos, "path"}, []
    for p, n in leaves:
        if p:
            while n in used:
                n = f"f_{n}"
            used.add(n)
            columns.append(_get(F.col("_e"), p).alias(n))
    if not isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        columns = [F.col("_e").alias("value")]
    return d.select(*keys, *pos, F.lit(".".join(branch.path)).alias("path"), *columns)


def flatten_records(records: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Flat tables of ``records``: 'root' and one per repeated element (see the module text).

    Positions count array elements from 1, null ones included, but a null element gives no row; null and empty
    arrays give none. Map entries are numbered in stored order. Repeated records, or versions of one key whose
    nested parts are equal, give each row once; where versions differ, all their rows stand. Records with a null
    key keep it. A leaf whose name clashes with a key, a position column or another leaf is prefixed ``f_``.
    """
    plan = plan_tables(records.schema)
    used = set(keys)
    columns = []
    for path, name in plan.root:
        if len(path) == 1 and path[0] in keys:
            continue
        while name in used:
            name = f"f_{name}"
        used.add(name)
        columns.append(_get(F.col(path[0]), path[1:]).alias(name))
    out = {"root": records.select(*keys, *columns).distinct()}
    for name, branches in plan.branches.items():
        rows = _rows(records, keys, branches[0])
        for b in branches[1:]:
            rows = rows.unionByName(_rows(records, keys, b))
        out[name] = rows.distinct()
    return out
