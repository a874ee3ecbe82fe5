"""References to records that do not exist: orphans per table and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_reference(ref: Column, none_words: tuple[str, ...] = ()) -> Column:
    """A reference without blanks around it; '' and the words that stand for none become null."""
    r = F.regexp_replace(ref, "^[\\s\\u00a0]+|[\\s\\u00a0]+$", "")
    return F.when(~r.isin("", *none_words), r)


def find_orphans(
    children: DataFrame, parents: DataFrame, name: str, record: Column, child_key: list[Column], child_time: Column,
    parent_key: list[Column], parent_time: Column, parent_alive: Column,
) -> DataFrame:
    """(table_name, record_key, period): children whose reference has no live parent that is not later.

    Distinct non-null foreign keys, each with its earliest and latest use, are anti-joined against the parents'
    keys with their earliest live time; what is left is joined back to the children. So the first join sees one
    row per key, however hot the key, and the join back only the children of suspicious keys.

    A reference counts if all of ``child_key`` are non-null. A parent without time is never there in time; a
    child without time is an orphan unless a live parent exists at all (its period is null). Repeated child
    rows count once; of several versions of a child each reference is judged, and one orphan makes the record
    one. Empty tables are fine. Only the named expressions are read, so other columns may have any names.
    """
    names = [f"_k{i}" for i in range(len(child_key))]
    kids = children.select(record.alias("record_key"), child_time.alias("_t"), *[c.alias(n) for n, c in zip(names, child_key)])
    for n in names:
        kids = kids.where(F.col(n).isNotNull())
    live = parents.where(parent_alive).select(parent_time.alias("_born"), *[c.alias(n) for n, c in zip(names, parent_key)])
    born = live.groupBy(*names).agg(F.min("_born").alias("_born"))
    used = kids.groupBy(*names).agg(F.min("_t").alias("_first"), F.max(F.col("_t").isNull()).alias("_timeless"))
    # keys of which every use has its parent in time
    safe = (F.col("b._born") <= F.col("u._first")) & (~F.col("u._timeless") | F.col("b._born").isNotNull())
    same = [F.col(f"u.{n}") == F.col(f"b.{n}") for n in names]
    cond = safe
    for s in same:
        cond = cond & s
    suspicious = used.alias("u").join(born.alias("b"), cond, "left_anti").select(*[F.col(f"u.{n}").alias(n) for n in names])
    first = suspicious.join(born, names, "left")
    hit = kids.join(first, names).where(F.col("_born").isNull() | (F.col("_t") < F.col("_born")))
    return hit.select(F.lit(name).alias("table_name"), "record_key", F.date_trunc("month", "_t").alias("period")).distinct()


def count_orphans(orphans: DataFrame, children: DataFrame, name: str, record: Column, child_key: list[Column], child_time: Column) -> DataFrame:
    """(table_name, period, references, orphans): distinct referring records and orphans per month; months without orphans too."""
    kids = children.where(child_key[0].isNotNull())
    for c in child_key[1:]:
        kids = kids.where(c.isNotNull())
    per = kids.select(record.alias("record_key"), F.date_trunc("month", child_time).alias("period")).distinct().groupBy("period").agg(F.count("*").alias("references"))
    bad = orphans.groupBy("period").agg(F.count("*").alias("_n"))
    out = per.alias("p").join(bad.alias("o"), F.col("p.period").eqNullSafe(F.col("o.period")), "left")
    return out.select(F.lit(name).alias("table_name"), F.col("p.period").alias("period"), "references", F.coalesce("_n", F.lit(0)).alias("orphans"))


def archive_orphans(index: DataFrame, layouts: DataFrame, notes: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orphans, counts) of structural_index.table_layout_id and note.source_doc_id."""
    c = F.col
    s = ("structural_index", F.concat("doc_id", F.lit(":"), c("entry_index").cast("string")), [c("doc_id"), clean_reference(c("table_layout_id"))], c("indexed_at"))
    n = ("note", c("note_id"), [clean_reference(c("source_doc_id"), ("None",))], c("created_at"))
    a = find_orphans(index, layouts, *s, [c("doc_id"), clean_reference(c("layout_id"))], c("extracted_at"), c("deleted_at").isNull())
    b = find_orphans(notes, registry, *n, [clean_reference(c("doc_id"))], c("created_at"), c("deleted_at").isNull())
    counts = count_orphans(a, index, *s).unionByName(count_orphans(b, notes, *n))
    return a.unionByName(b), counts
