"""Mixing sources to target weights by pivotal dependent rounding.

A source's target and size give every one of its documents the same expected number of copies, ``target / source_size``.  The whole
part is taken outright.  The fractional parts are rounded in pairs: words of expectation move, in a random direction, from one
document to the other until one of the two is integral; the other goes on to the next pair.  The direction's odds keep every
document's expectation, and each step keeps the source's expected number of words exactly.

Documents are dealt by a hash of their id into groups of about ``GROUP`` rows of one source, so a hot source is many groups.  Every
group ends with at most one fractional document; these residuals are combined, ``FAN`` groups at a time, in a reduction tree.  The
last residual of a source is rounded by a draw, so the taken words miss the target by less than the size of one document.

All draws come from seeded hashes, and groups are sorted before pairing, so reruns agree whatever the physical partitioning.  A null
source is a source (ordered last); a null or empty text has size 0 and takes no words.  Repeated rows are documents of their own: equal
rows are counted first and then numbered, so neither they nor rows without an id share a group or a draw.  Ties don't matter, as every
numbered row has a name of its own.  There may be any number of sources: their order is by range partitions, and the level that caps
don't reach is found in a histogram of at most ``BINS`` rows, narrowed until it is exact.  An empty table gives no rows; ``mixed``
carries other columns whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrowmill.llm.common import Scratch, word_count

GROUP = 2_000
FAN = 64
WEIGHTS = (3, 1, 2)
TOTAL = 1.5  # of all sizes
MOST = 2.0  # times a source's size
#: Rows of the histogram that the driver sees; sources of a range partition; numbered rows that one row is expanded to at once.
BINS, RANGE, EXPAND = 10_000, 100_000, 100_000


def _ranked(per: DataFrame, scratch: Scratch) -> DataFrame:
    """Sources with their place by code point, null last; ranges are sorted on their own and numbered on from the ranges before."""
    parts = max(1, -(-per.count() // RANGE))
    ranged = scratch.cut(per.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "ranged")
    before, offsets = 0, []
    for r in ranged.groupBy("range").count().orderBy("range").collect():  # a row for each range
        offsets.append((r["range"], before))
        before += r["count"]
    first = per.sparkSession.createDataFrame(offsets, "range int, before long")
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("own", own).join(first, "range").withColumn("rank", F.col("before") + F.col("own") - 1).drop("range", "own", "before")


def _level(per: DataFrame, words: float) -> float:
    """The level with sum(min(cap, level * w)) = words: sources whose cap / w is below it are capped.

    The driver sees sums of bins of cap / w; the bin in which the sum reaches ``words`` is divided again until it has one value."""
    low, high = per.agg(F.min("ratio"), F.max("ratio")).first()
    if low is None:
        return float("inf")
    cap_below = w_above = 0.0  # of sources below and above the bins
    while True:
        width = (high - low) / BINS
        at = F.floor((F.col("ratio") - low) / width) if width > 0 else F.lit(0)
        bins = per.filter(F.col("ratio").between(low, high)).groupBy(at.alias("bin"))
        rows = sorted(bins.agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.min("ratio").alias("low"), F.max("ratio").alias("high")).collect(), key=lambda r: r["low"])
        left = sum(r["w"] for r in rows) + w_above
        for r in rows:
            if cap_below + r["cap"] + r["high"] * (left - r["w"]) >= words:  # the sum with the bin's highest value as level
                break
            cap_below, left = cap_below + r["cap"], left - r["w"]
        else:
            return float("inf")
        if r["high"] == r["low"]:
            return (words - cap_below) / left
        low, high, w_above = r["low"], r["high"], left - r["w"]


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """One row per source: rows, source_size, target.

    A source's target is its share by weight, at most ``most`` times its size; what is cut is reshared by weight until nothing is above."""
    per = scratch.cut(sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")), "sources")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = _ranked(per, scratch).withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    per = scratch.cut(per.withColumn("ratio", F.col("cap") / F.col("w")), "ranked")
    level = _level(per, (per.agg(F.sum("source_size")).first()[0] or 0) * total)
    return per.select("source", "rows", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("cap"), F.lit(level) * F.col("w")).cast("double").alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int:
    """Round ``p`` in place by pairs, keeping sum(p * size); returns the index of what is left fractional, or -1."""
    carry = -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        q = p[j]
        if q <= 0.0 or q >= 1.0:
            continue
        if carry < 0:
            carry = j
            continue
        a, b, x = size[carry], size[j], p[carry]
        down = min(x * a, (1.0 - q) * b)  # words from the carried document to this one
        up = min((1.0 - x) * a, q * b)
        if draws[j] * (down + up) < up:
            x, q = x - down / a, q + down / b
        else:
            x, q = x + up / a, q - up / b
        x, q = (0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x), (0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q)
        p[carry], p[j] = x, q
        if 0.0 < x < 1.0:
            pass
        elif 0.0 < q < 1.0:
            carry = j
        else:
            carry = -1
    return carry


def _round(pdf: pd.DataFrame, level: int, seed: int) -> pd.DataFrame:
    # largest first: partners are of like size, and what is left fractional at the end is a small document
    pdf = pdf.sort_values(["size", "order", "key"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    name = "" if pd.isna(pdf["source"].iat[0]) else "=" + pdf["source"].iat[0]
    rng = np.random.default_rng([seed, level, int(pdf["grp"].iat[0]), zlib.crc32(name.encode("utf-8", "surrogatepass"))])
    p = pdf["p"].to_numpy(float).copy()
    pivot(p, pdf["size"].to_numpy(float), rng)
    pdf["p"] = p
    return pdf


ROW = "key string, source string, size long, source_size long, target double, whole long, p double, order long, grp long"


def mix(rows: DataFrame, scratch: Scratch, seed: int = 17) -> DataFrame:
    """``rows``: key (string, no two alike), source, size.  Returns them with source_size, target and copies."""
    sizes = scratch.cut(rows, "sizes")
    per = targets(sizes, scratch).withColumn("groups", F.ceil(F.col("rows") / GROUP).cast("long"))
    per = scratch.cut(per, "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = sizes.join(per.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    dealt = dealt.withColumn("whole", F.floor(rate)).withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
    dealt = dealt.withColumn("order", F.xxhash64(F.lit(seed), "key")).withColumn("grp", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("groups")))
    dealt = dealt.select(*(c.split()[0] for c in ROW.split(", ")))
    groups = per.agg(F.max("groups")).first()[0] or 0

    def level(k: int):
        return lambda pdf: _round(pdf, k, seed)

    done = []
    now = scratch.cut(dealt.groupBy("source", "grp").applyInPandas(level(0), ROW), "level0")
    k = 0
    between = (F.col("p") > 0) & (F.col("p") < 1)
    while groups > 1:
        done.append(now.filter(~between))
        groups, k = -(-groups // FAN), k + 1
        now = scratch.cut(now.filter(between).withColumn("grp", F.floor(F.col("grp") / FAN)).groupBy("source", "grp").applyInPandas(level(k), ROW), f"level{k}")
    for d in done:
        now = now.unionByName(d)
    draw = (F.xxhash64(F.lit(seed + 2), "key") / F.lit(float(1 << 63)) + 1) / 2
    return now.withColumn("copies", (F.col("whole") + F.when(F.col("p") > draw, 1).otherwise(0)).cast("int")).select("key", "source", "size", "source_size", "target", "copies")


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, source, size) of rows (id, source, size, digest): equal rows are counted, then numbered; the key has number, digest and id.

    Counts are expanded in two steps, so that very many equal rows aren't expanded in one task."""
    n = scratch.cut(rows.groupBy("id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("n")), "counted")
    some = n.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / EXPAND))))
    many = some.filter("n > 1").repartition("id", "digest", "step")
    every = some.filter("n = 1").withColumn("k", F.lit(0).cast("long"))
    last = F.least(F.col("n"), (F.col("step") + 1) * EXPAND) - 1
    every = every.unionByName(many.withColumn("k", F.explode(F.sequence(F.col("step") * EXPAND, last))))
    return every.select(F.concat_ws("\x00", F.col("k").cast("string"), F.col("digest").cast("string"), "id").alias("key"), "source", "size")


def _name(k: int):
    """Part of a key; null for the id of rows without one."""
    return F.try_element_at(F.split("key", "\x00", 3), F.lit(k))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target of its source, taken words.  Rows are equal if all columns are, as for ``mixed``."""
    s = Scratch(docs.sparkSession, "mix")
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.struct(*docs.columns)).alias("digest"))
    got = mix(numbered(rows, s), s)
    return got.select(_name(3).cast(kind).alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as often as it was rounded to, its columns unchanged.

    Equal rows have their copies in common.  Whole rows are shuffled once, by id and digest; only where there are equal rows, one of
    them is chosen by an aggregate, which combines within tasks first."""
    s = Scratch(docs.sparkSession, "mixed")
    row = F.struct(*docs.columns)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")).alias("_id"), F.xxhash64(row).alias("_digest"), row.alias("_row"))
    of = lambda c: F.col(f"_row.{c}")
    rows = keyed.select(F.nullif("_id", F.lit("\x00")).alias("id"), of(source_col).cast("string").alias("source"), word_count(of(text_col)).alias("size"), F.col("_digest").alias("digest"))
    got = mix(numbered(rows, s), s).filter("copies > 0")
    got = got.groupBy(F.coalesce(_name(3), F.lit("\x00")).alias("_id"), _name(2).cast("long").alias("_digest")).agg(F.sum("copies").cast("int").alias("_copies"))
    if not s.spark.read.parquet(s.path("counted")).filter("n > 1").isEmpty():
        keyed = keyed.groupBy("_id", "_digest").agg(F.first("_row").alias("_row"))
    return keyed.join(got, ["_id", "_digest"]).select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
