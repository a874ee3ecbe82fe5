"""Problem 8: mixing sources to target weights.

Sizes are tokens of a public tokenizer. Entropy balancing finds, for every document, the expected number of
copies closest to an even draw such that each source reaches its share of the tokens: the dual has one
multiplier per source and is solved by Newton steps, each a distributed sum over the token table. The tilted
rates are then rounded to whole copies by systematic rounding along blocks of documents.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Where the public tokenizers' files lie, and the one whose tokens are counted.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of the public byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
NEWTON_STEPS, TOLERANCE = 40, 1e-7


def source_key(source: Column) -> Column:
    """Source names regardless of case, blanks and separators; a name without letters or digits is null."""
    k = F.regexp_replace(F.lower(source), "[^\\p{L}\\p{N}]+", "")
    return F.when(k == "", None).otherwise(k)


def count_tokens(texts: DataFrame, text: str, keep: tuple[str, ...], tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns with ``tokens`` of the whole text (0 for null and empty ones)."""
    fields = {f.name: f for f in texts.schema.fields}
    schema = T.StructType([T.StructField(c, fields[c].dataType) for c in keep] + [T.StructField("tokens", T.LongType())])
    rows = texts.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            out = pdf[list(keep)].copy()
            out["tokens"] = np.array([len(enc.encode_ordinary(t)) for t in pdf["_text"]], dtype=np.int64)
            yield out

    return rows.mapInPandas(run, schema)


def feasible_total(have: dict[str, tuple[int, float, int]], total: float | None) -> float:
    """The total to reach: the wish, but no more than every source can give. have: key -> (tokens, share, cap)."""
    most = min((cap * tokens / share for tokens, share, cap in have.values() if share > 0), default=0.0)
    return most if total is None else min(total, most)


def balance(sized: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[dict[str, float], float]:
    """Multiplier by source key, and the total reached. ``sized``: key, tokens, per document.

    The rate of document d is cap * x / (1 + x) with x = exp(multiplier * tokens / mean tokens of its source): the
    tilted rate under the constraint rate <= cap.
    """
    sums = {r.key: (int(r.tokens or 0), int(r.n), float(r.mean or 0)) for r in sized.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.avg("tokens").alias("mean")).collect() if r.key in targets}
    have = {k: (sums[k][0], *targets[k]) for k in sums if sums[k][0] > 0}
    share = sum(s for _, s, _ in have.values())
    have = {k: (t, s / share, c) for k, (t, s, c) in have.items()}
    goal = feasible_total(have, total)
    lam = {k: 0.0 for k in have}
    for _ in range(NEWTON_STEPS):
        got = {r.key: (float(r.g), float(r.h)) for r in _moments(sized, lam, have, sums).collect()}
        worst = 0.0
        for k, (t, s, c) in have.items():
            want = s * goal
            if want >= c * t * (1 - 1e-9):
                lam[k] = 60.0  # every document as often as allowed
                continue
            g, h = got[k]
            worst = max(worst, abs(g - want) / max(want, 1.0))
            lam[k] += max(-4.0, min(4.0, (want - g) / h)) if h > 0 else 0.0
        if worst < TOLERANCE:
            return lam, goal
    raise ArithmeticError(f"no balance after {NEWTON_STEPS} steps: a source is {worst:.2%} off its target")


def _rate(lam: Column, tokens: Column, mean: Column, cap: Column) -> Column:
    x = F.least(F.greatest(lam * tokens / mean, F.lit(-60.0)), F.lit(60.0))
    return cap / (F.lit(1.0) + F.exp(-x))


def _values(lam: dict[str, float], have: dict, sums: dict) -> DataFrame | None:
    from pyspark.sql import SparkSession

    rows = [(k, float(lam[k]), float(sums[k][2]), float(have[k][2])) for k in sorted(have)]
    return SparkSession.active().createDataFrame(rows, "key string, lam double, mean double, cap double")


def _moments(sized: DataFrame, lam: dict[str, float], have: dict, sums: dict) -> DataFrame:
    d = sized.join(F.broadcast(_values(lam, have, sums)), "key")  # one row per source of the target table
    r = _rate(F.col("lam"), F.col("tokens"), F.col("mean"), F.col("cap"))
    p = r / F.col("cap")
    slope = F.col("cap") * p * (1 - p) * F.col("tokens") / F.col("mean")
    return d.groupBy("key").agg(F.sum(r * F.col("tokens")).alias("g"), F.sum(slope * F.col("tokens")).alias("h"))


def mix_sources(
    documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    total_tokens: float | None = None, tokenizer: str = TOKENIZER,
) -> DataFrame:
    """(doc_id, source_key, tokens, rate, copies) of the documents taken, copies >= 1.

    targets: source, target_share, max_repeats. Sources are compared by ``source_key``; of rows for one source
    the shares add up and the smallest cap holds. Sources without documents, or whose documents have no tokens,
    give their share to the others in proportion. ``total_tokens`` None means the largest total at which no
    source exceeds its cap; a larger wish is cut to that. A document is never taken more than max_repeats
    times. Documents of no target source, with a null source or key, and empty texts are left out; rows
    delivered twice count once. Null shares or caps leave a source out.
    """
    goals = {
        r.key: (float(r.share), int(r.cap))
        for r in targets.select(source_key(F.col("source")).alias("key"), "target_share", "max_repeats").where("key is not null and target_share > 0 and max_repeats > 0")
        .groupBy("key").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).limit(10_001).collect()
    }
    if len(goals) > 10_000:
        raise ValueError("mix_targets is not a short table of sources")
    docs = documents.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("_doc"), source_key(F.col(source)).alias("_s"), F.col(text).alias("_t"))
    docs = docs.where(F.col("_s").isin(sorted(goals))) if goals else docs.where(F.lit(False))
    one = count_tokens(docs, "_t", ("_doc", "_s"), tokenizer).groupBy("_doc").agg(F.max(F.struct("tokens", "_s")).alias("x"))
    sized = materialize(one.select("_doc", F.col("x._s").alias("key"), "x.tokens").where("tokens > 0"))
    lam, _ = balance(sized, goals, total_tokens)
    if not lam:
        return sized.select(F.col("_doc").alias(key), F.col("key").alias("source_key"), "tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies")).where("copies > 0")
    sums = {r.key: (0, 0, float(r.mean)) for r in sized.groupBy("key").agg(F.avg("tokens").alias("mean")).collect()}
    have = {k: (0, 0.0, goals[k][1]) for k in lam}
    d = sized.join(F.broadcast(_values(lam, have, sums)), "key").withColumn("rate", _rate(F.col("lam"), F.col("tokens"), F.col("mean"), F.col("cap")))
    return _round(d).select(F.col("_doc").alias(key), "source_key", "tokens", "rate", "copies")


#: Documents of one source are rounded in blocks of about this many, so that no task sees a whole source.
BLOCK = 4096


def _round(rated: DataFrame) -> DataFrame:
    """Whole copies with the expected tokens: systematic rounding by tokens inside blocks of each source."""
    from pyspark.sql import Window

    # one row per source
    blocks = rated.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).alias("_blocks"))
    d = rated.join(blocks, "key").withColumn("_h", F.xxhash64(F.col("_doc").cast("string")))
    d = d.withColumn("_b", F.pmod(F.col("_h"), F.col("_blocks"))).withColumn("_floor", F.floor("rate"))
    # running sum of the fractional tokens; a document gets its extra copy where the sum passes a multiple of the step
    w = Window.partitionBy("key", "_b").orderBy("tokens", "_h", "_doc").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.col("rate") - F.col("_floor")).over(w)
    start = F.pmod(F.xxhash64("key", "_b"), F.lit(1000)) / 1000.0
    d = d.withColumn("_run", run + start)
    extra = F.floor(F.col("_run")) - F.floor(F.col("_run") - (F.col("rate") - F.col("_floor")))
    copies = F.least(F.col("_floor") + F.greatest(extra, F.lit(0)), F.col("cap")).cast("int")
    return d.select("_doc", F.col("key").alias("source_key"), "tokens", "rate", copies.alias("copies")).where("copies > 0")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source_key, target_share, documents, copies, tokens, actual_share, max_copies): the shares reached, one row per target source."""
    t = targets.select(source_key(F.col("source")).alias("source_key"), "target_share").where("source_key is not null").groupBy("source_key").agg(F.sum("target_share").alias("target_share"))
    m = mixture.groupBy("source_key").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("max_copies"),
    )
    total = m.agg(F.sum("tokens").alias("all"))
    return t.join(m, "source_key", "left").join(F.broadcast(total)).select(
        "source_key", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "tokens", "max_copies")],
        F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"),
    )
