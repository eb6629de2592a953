"""Exact substring dedup over words, by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``BLOCK`` words, half of a window.  A repeated window holds a whole
reference block of its one occurrence, so the other occurrence holds a rolling run of the same words.  Hence: every rolling run of
``BLOCK`` words of every document probes the index of reference blocks; runs that equal a block and occur twice or more are anchors;
only windows that hold an anchor are looked at further, by a 96-bit hash of all their words, and of those all but the first occurrence
are repeats.  Consecutive repeated windows are maximal exact repeats.

Documents are dealt by a hash of their id into sub-batches and written once, bucketed by sub-batch, so the three passes over the texts
need no further shuffle of them.  Probes and windows are shuffled as packed arrays, a row for each sub-batch and range of hashes, and
each hash once a sub-batch: a passage that very many documents share adds one entry for each sub-batch, not one for each document.

Order is by id, then start; rows with equal ids, and rows without one (which come last), by a digest of their text, and are dealt by it,
too, so neither is one group.  Equal rows are first looked for by digests; if there are any, they are counted, one of them is worked on,
and the others, which come after it, lose all words if they have a window.  A null or empty text has no words.  A document is worked on
whole, however long.  An empty table gives no rows; columns but id and text aren't read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.common import WORD_POWERS_2, Scratch, U, pack_u64, pieces, release, shuffle_partitions, unpack_u64, windows

WINDOW = 20
BLOCK = WINDOW // 2
LOW = U((1 << 40) - 1)
#: Copies of a row that are made at once.
EXPAND = 100_000
#: Runs of words that a range of hashes has, about.
RANGE = 2_500_000


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> U(40)) * U(ranges)) >> U(24)


def _key(h: np.ndarray, ranges: int) -> np.ndarray:
    """What is kept of an anchor's hash: its range and low 40 bits."""
    return _range_of(h, ranges) << U(40) | h & LOW


class _Batch:
    """Word hashes of some documents, with what is needed to stay within them."""

    def __init__(self, texts: pa.Array) -> None:
        hs, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for _, _, w in pieces(texts):
            hs.append(w.hashes())
            counts.append(w.counts)
        self.h, self.counts = np.concatenate(hs), np.concatenate(counts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def starts(self, n: int) -> np.ndarray:
        """Where a run of ``n`` words of one document starts."""
        m = len(self.h) - n + 1
        return np.flatnonzero(self.doc[:m] == self.doc[n - 1 :]) if m > 0 else np.zeros(0, np.int64)

    def place(self, at: np.ndarray) -> np.ndarray:
        return at - self.first[self.doc[at]]


PROBES = "part int, sb long, runs binary, many binary, block binary"


def _probes(sb: int, texts: pa.Array, ranges: int):
    """Rows of the probe table: for each range of hashes, the distinct runs, whether each occurs twice here, and whether it is a reference block."""
    b = _Batch(texts)
    at = b.starts(BLOCK)
    if not len(at):
        return
    h = windows(b.h, BLOCK)[at]
    order = np.argsort(h)
    s = h[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    many = np.diff(np.append(first, len(s))) > 1
    block = np.maximum.reduceat((b.place(at) % BLOCK == 0)[order], first)
    u = s[first]
    part = _range_of(u, ranges)
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for a, z in zip(cut, np.append(cut[1:], len(u))):
        yield int(part[a]), sb, pack_u64(u[a:z] & LOW, 5), np.packbits(many[a:z]).tobytes(), np.packbits(block[a:z]).tobytes()


def _arrow(rows, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    cols = list(zip(*rows)) if rows else [[] for _ in schema.split(", ")]
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def probes(table: DataFrame, ranges: int) -> DataFrame:
    def run(batches):
        for b in batches:
            sb = b.column(0).to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], sb[1:] != sb[:-1]))) if len(sb) else []
            rows, held = [], 0
            for a, z in zip(cut, np.append(cut[1:], len(sb))):
                for r in _probes(int(sb[a]), b.column(1).slice(a, z - a), ranges):
                    rows.append(r)
                    held += len(r[2])
                if held > 4 << 20:
                    yield _arrow(rows, PROBES)
                    rows, held = [], 0
            if rows:
                yield _arrow(rows, PROBES)

    return table.select("sb", "text").mapInArrow(run, PROBES)


def anchors(probe_rows: DataFrame) -> DataFrame:
    """(sb, part, runs): runs that equal a reference block and occur twice or more, for each sub-batch that has them."""
    schema = "sb long, part int, runs binary"

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        sb = t.column("sb").to_pylist()
        runs = [unpack_u64(x.as_py(), 5) for x in t.column("runs")]
        n = np.array([len(x) for x in runs])
        bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=k) for x, k in zip(t.column(c), n)])
        h = np.concatenate(runs)
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.append(first, len(s)))
        good = ((size > 1) | (np.maximum.reduceat(bits("many")[order], first) > 0)) & (np.maximum.reduceat(bits("block")[order], first) > 0)
        hit = np.zeros(len(h), bool)
        hit[order] = np.repeat(good, size)
        ends = np.cumsum(n)
        rows = [(sb[k], part, pack_u64(x, 5)) for k, (a, z) in enumerate(zip(ends - n, ends)) if len(x := h[a:z][hit[a:z]])]
        return pa.Table.from_batches([_arrow(rows, schema)])

    return probe_rows.groupBy("part").applyInArrow(run, schema)


WINDOWS = "part int, sb long, hashes binary, tails binary, docs binary, digests binary, who binary, place binary"


def _sort(t: pa.Table) -> pa.Table:
    return t.sort_by([("ord", "ascending"), ("digest", "ascending")])


def _full(b: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows and both parts of their hashes."""
    at = b.starts(WINDOW)
    return at, windows(b.h, WINDOW)[at], windows(b.h, WINDOW, WORD_POWERS_2)[at] >> U(32)


def candidate_windows(table: DataFrame, anchor_rows: DataFrame, ranges: int) -> DataFrame:
    """Windows that hold an anchor: of each sub-batch and window the first occurrence."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if right.num_rows and left.num_rows:
            left = _sort(left)
            b = _Batch(left.column("text").combine_chunks())
            known = np.concatenate([U(p) << U(40) | unpack_u64(r, 5) for p, r in zip(right.column("part").to_pylist(), right.column("runs").to_pylist())])
            known.sort()
            at = b.starts(BLOCK)
            key = _key(windows(b.h, BLOCK)[at], ranges)
            pos = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = np.zeros(len(b.h) + 1, np.int64)
            hit[at[known[pos] == key] + 1] = 1
            before = np.cumsum(hit)
            at, h, tail = _full(b)
            ok = before[at + WINDOW - BLOCK + 1] > before[at]
            at, h, tail = at[ok], h[ok], tail[ok]
            order = np.lexsort((at, tail, h))
            first = np.ones(len(order), bool)
            first[1:] = (h[order][1:] != h[order][:-1]) | (tail[order][1:] != tail[order][:-1])
            o = order[first]
            ids, digests = left.column("ord").to_numpy(), left.column("digest").to_numpy()
            part = _range_of(h[o], ranges)
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(o) else []
            sb = left.column("sb")[0].as_py()
            for a, z in zip(cut, np.append(cut[1:], len(o))):
                w = at[o[a:z]]
                docs, who = np.unique(b.doc[w], return_inverse=True)
                rows.append((int(part[a]), sb, h[o[a:z]].tobytes(), tail[o[a:z]].astype("<u4").tobytes(), ids[docs].tobytes(), digests[docs].tobytes(), who.astype("<u4" if len(docs) > 65535 else "<u2").tobytes(), b.place(w).astype("<u4").tobytes()))
        return pa.Table.from_batches([_arrow(rows, WINDOWS)])

    return table.groupBy("sb").cogroup(anchor_rows.groupBy("sb")).applyInArrow(run, WINDOWS)


def later_windows(window_rows: DataFrame) -> DataFrame:
    """(sb, hashes, tails): windows of a sub-batch that start earlier in another sub-batch."""
    schema = "sb long, hashes binary, tails binary"

    def run(t: pa.Table) -> pa.Table:
        sb = t.column("sb").to_pylist()
        get = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in t.column(c)]
        hs, tails, docs, digests = get("hashes", "<u8"), get("tails", "<u4"), get("docs", "<i8"), get("digests", "<i8")
        who = [np.frombuffer(x.as_py(), "<u4" if len(d) > 65535 else "<u2") for x, d in zip(t.column("who"), docs)]
        h, tail = np.concatenate(hs), np.concatenate(tails)
        ids, digest = (np.concatenate([d[w] for d, w in zip(x, who)]) for x in (docs, digests))
        place = np.concatenate(get("place", "<u4"))
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.concatenate(([False], s[1:] == s[:-1]))
        shared = same | np.append(same[1:], False)
        order = order[shared]  # windows that occur in one sub-batch only are first
        order = order[np.lexsort((place[order], digest[order], ids[order], tail[order], h[order]))]
        late = np.zeros(len(h), bool)
        late[order[1:]] = (h[order][1:] == h[order][:-1]) & (tail[order][1:] == tail[order][:-1])
        n = np.array([len(x) for x in hs])
        ends = np.cumsum(n)
        rows = [(sb[k], h[a:z][late[a:z]].tobytes(), tail[a:z][late[a:z]].astype("<u4").tobytes()) for k, (a, z) in enumerate(zip(ends - n, ends)) if late[a:z].any()]
        return pa.Table.from_batches([_arrow(rows, schema)])

    return window_rows.groupBy("part").applyInArrow(run, schema)


RESULT = "doc_id long, copies long, n_words long, n_removed long, kept_sha256 string, repeats string"


def _repeated(b: _Batch, late: np.ndarray) -> np.ndarray:
    """Whether each word is covered by a window that starts earlier: in this sub-batch, or by ``late`` in another."""
    at, h, tail = _full(b)
    order = np.lexsort((at, tail, h))
    again = np.zeros(len(at), bool)
    again[order[1:]] = (h[order][1:] == h[order][:-1]) & (tail[order][1:] == tail[order][:-1])
    if len(late):
        late = np.sort(late, order=["h", "t"])
        lh = late["h"]
        a, z = np.searchsorted(lh, h, "left"), np.searchsorted(lh, h, "right")
        again |= (z - a == 1) & (late["t"][np.minimum(a, len(lh) - 1)] == tail)
        for k in np.flatnonzero(z - a > 1):
            again[k] |= tail[k] in late["t"][a[k] : z[k]]
    cover = np.zeros(len(b.h) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def verdicts(table: DataFrame, late_rows: DataFrame) -> DataFrame:
    """Per document: words, removed words, digest of what is kept, and the removed runs of words as start:end."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _sort(left)
        texts = left.column("text").combine_chunks()
        b = _Batch(texts)
        late = np.zeros(sum(len(x.as_py()) // 8 for x in right.column("hashes")) if right.num_rows else 0, [("h", "<u8"), ("t", "<u8")])
        if len(late):
            late["h"] = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in right.column("hashes")])
            late["t"] = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in right.column("tails")])
        gone = _repeated(b, late)
        ids, copies, rows = left.column("doc_id").to_pylist(), left.column("copies").to_pylist(), []
        for k, t in enumerate(texts):
            own = gone[b.first[k] : b.first[k + 1]]
            words = (t.as_py() or "").encode().split()
            spans = ""
            if own.any():
                words = [w for w, g in zip(words, own) if not g]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
                spans = ",".join(f"{a}:{z}" for a, z in zip(edge[::2], edge[1::2]))
            rows.append((ids[k], copies[k], len(own), int(own.sum()), hashlib.sha256(b" ".join(words)).hexdigest(), spans))
        return pa.Table.from_batches([_arrow(rows, RESULT)])

    return table.groupBy("sb").cogroup(late_rows.groupBy("sb")).applyInArrow(run, RESULT)


def kept_text(text: str | None, repeats: str) -> str:
    """The words of a text that stay, joined by one space; ``repeats`` as ``dedup`` gives them."""
    words, out, at = (text or "").encode().split(), [], 0
    for a, b in (map(int, r.split(":")) for r in repeats.split(",") if r):
        out += words[at:a]
        at = b
    return b" ".join(out + words[at:]).decode()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and the maximal repeats that are removed."""
    spark = docs.sparkSession
    s = Scratch(spark, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # rows without an id are ordered by their text
    none = F.col("doc_id").isNull()
    rows = rows.select("doc_id", F.when(none, 1 << 62).otherwise(F.col("doc_id")).alias("ord"), F.xxhash64("text").alias("digest"), "text")
    seen = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    n, size, most = seen.agg(F.sum("n"), F.sum("size"), F.max("n")).first()
    if (most or 0) > 1:  # one of equal rows is worked on; they are combined within tasks before they are shuffled
        rows = rows.groupBy("doc_id", "ord", "digest", "text").agg(F.count(F.lit(1)).alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    words = (size or 0) / 6 + 1
    ranges = int(max(1, words // RANGE))
    per_batch = min(1 << 20, max(1 << 16, 200 * ranges))  # words, about
    batches = int(max(1, (n or 0) // max(8, per_batch * (n or 1) / words)))
    rows = rows.withColumn("sb", F.pmod(F.xxhash64("ord", "digest"), F.lit(batches)).cast("long"))
    parts = max(shuffle_partitions(spark), min(batches, spark.sparkContext.defaultParallelism))
    name = f"sparrowmill_{uuid.uuid4().hex}"
    try:
        rows.repartition(parts, "sb").sortWithinPartitions("sb").write.bucketBy(parts, "sb").sortBy("sb").option("compression", "zstd").option("path", s.path("texts")).saveAsTable(name)
        release(spark)
        table = spark.table(name)
        found = s.cut(anchors(probes(table, ranges)), "anchors")
        release(spark)
        late = s.cut(later_windows(candidate_windows(table, found, ranges)), "late")
        s.drop("anchors")
        release(spark)
        out = s.cut(verdicts(table, late), "result")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        s.drop("texts", "late")
    if (most or 0) > 1:
        out = _with_copies(out)
    return out.drop("copies").withColumnRenamed("doc_id", id_col)


def _with_copies(out: DataFrame) -> DataFrame:
    """Every row as often as it was there: the copies have all words removed if they have a window, else none."""
    steps = out.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / EXPAND))))
    some = steps.filter("copies > 1").repartition("doc_id", "kept_sha256", "step")
    last = F.least(F.col("copies"), (F.col("step") + 1) * EXPAND) - 1
    some = some.withColumn("k", F.explode(F.sequence(F.col("step") * EXPAND, last)))
    gone = (F.col("k") > 0) & (F.col("n_words") >= WINDOW)
    some = some.withColumn("n_removed", F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")))
    some = some.withColumn("kept_sha256", F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")))
    some = some.withColumn("repeats", F.when(gone, F.concat(F.lit("0:"), F.col("n_words").cast("string"))).otherwise(F.col("repeats")))
    return steps.filter("copies = 1").drop("step").unionByName(some.drop("step", "k"))
