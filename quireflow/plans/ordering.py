"""Positions in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... by ``order``.

    Rows are sorted into ranges, numbered within their range, and shifted by the sizes of the ranges before; only
    those sizes, one row per range, are summed in one place.
    """
    ranged = materialize(df.orderBy(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__range").alias("__r"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    d = ranged.withColumn("__place", place).join(F.broadcast(offsets), F.col("__range") == F.col("__r"))
    return d.select(*df.columns, (F.col("__place") + F.col("__before")).cast("long").alias(name))


def along(
    df: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None, leads: dict[str, Column] | None = None,
) -> DataFrame:
    """``df`` with running sums, last non-null values up to the row, and values of the row before and after, by ``order`` inside ``group``.

    The same as windows over ``group``, but however many rows a group has no task sees more than a range of them: rows
    are sorted into ranges, the windows run inside each, and only groups that lie in several ranges get what the
    ranges before and after hand over. A border between ranges parts one group at most, so that table has no
    more than two rows per range and may be broadcast. ``order`` must be total inside a group.
    """
    sums, lasts, lags, leads = ({k: v for k, v in (x or {}).items()} for x in (sums, lasts, lags, leads))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    d = df.select("*", F.struct(*keys).alias("__at"), *[v.alias(f"__{k}") for x in (sums, lasts, lags, leads) for k, v in x.items()])
    ranged = materialize(d.orderBy(*group, *keys).withColumn("__range", F.spark_partition_id()))
    w = Window.partitionBy("__range", *group).orderBy("__at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    one = lambda k, pick, when: pick(F.struct(F.col(f"__{k}").alias("v")), when)
    parts = ranged.groupBy("__range", *group).agg(
        F.count("*").alias("__n"), *[F.sum(f"__{k}").alias(f"__s_{k}") for k in sums], *[F.max_by(f"__{k}", F.when(F.col(f"__{k}").isNotNull(), F.col("__at"))).alias(f"__l_{k}") for k in lasts],
        *[one(k, F.max_by, F.col("__at")).alias(f"__p_{k}") for k in lags], *[one(k, F.min_by, F.col("__at")).alias(f"__f_{k}") for k in leads],
    )
    parts = materialize(parts)
    split = parts.groupBy(*[F.col(g).alias(f"__g_{g}") for g in group]).agg(F.count("*").alias("__m")).where("__m > 1").drop("__m")
    same = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]
    several = parts.join(split, same, "left_semi")
    b = Window.partitionBy(*group).orderBy("__range")
    before = b.rowsBetween(Window.unboundedPreceding, -1)
    hand = several.select(
        F.col("__range").alias("__r"), *[F.col(g).alias(f"__g_{g}") for g in group], *[F.sum(f"__s_{k}").over(before).alias(f"__hs_{k}") for k in sums],
        *[F.last(f"__l_{k}", True).over(before).alias(f"__hl_{k}") for k in lasts], *[F.lag(f"__p_{k}").over(b).getField("v").alias(f"__hp_{k}") for k in lags],
        *[F.lead(f"__f_{k}").over(b).getField("v").alias(f"__hf_{k}") for k in leads],
    )
    local = ranged.select(
        "*", F.row_number().over(w).alias("__i"), F.lead(F.lit(True)).over(w).isNull().alias("__end"), *[F.sum(f"__{k}").over(run).alias(f"__ws_{k}") for k in sums],
        *[F.last(f"__{k}", True).over(run).alias(f"__wl_{k}") for k in lasts], *[F.lag(f"__{k}").over(w).alias(f"__wp_{k}") for k in lags], *[F.lead(f"__{k}").over(w).alias(f"__wf_{k}") for k in leads],
    )
    joined = local.join(F.broadcast(hand), [F.col("__range") == F.col("__r"), *same], "left")
    c = F.col
    new = {
        **{k: F.when(c(f"__ws_{k}").isNull() & c(f"__hs_{k}").isNull(), None).otherwise(F.coalesce(c(f"__ws_{k}"), F.lit(0)) + F.coalesce(c(f"__hs_{k}"), F.lit(0))) for k in sums},
        **{k: F.coalesce(f"__wl_{k}", f"__hl_{k}") for k in lasts}, **{k: F.when(c("__i") == 1, c(f"__hp_{k}")).otherwise(c(f"__wp_{k}")) for k in lags},
        **{k: F.when(c("__end"), c(f"__hf_{k}")).otherwise(c(f"__wf_{k}")) for k in leads},
    }
    return joined.select(*[x for x in df.columns if x not in new], *[v.alias(k) for k, v in new.items()])
