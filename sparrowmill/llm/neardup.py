"""Near-duplicates: minhash signatures joined by a multi-index Hamming join, links confirmed on full shingle sets.

Signatures have ``SYMBOLS`` symbols of 16 bits.  They are split into chunks of ``CHUNK`` symbols.  If two signatures differ in at most
``CHUNKS * 2 - 1`` symbols, then by the pigeonhole principle some chunk has at most one error; every chunk is therefore indexed under
each of its ``CHUNK`` variants with one symbol left out, and all pairs under that distance share a key.  At a similarity of exactly
0.85 a pair is missed with a probability of about 2e-7 (every chunk has two errors or more; 6e-6 at 0.8), and the more similar, the less.

Documents with equal shingle sets are one class, found by a 128-bit digest of the set; only class representatives are joined.  Within a
key, members are paired with one centre (the smallest id), not with each other, so a group of n near copies gives n pairs a key; their
intersections are counted on full sets, and links are contracted to components.

Two members of a key may be linked though neither is with the centre c.  An exact bound leaves few such pairs: a shingle that no other
candidate has (``own``) is in no intersection, so members x and y share at most min(|x & c|, |y & c|) shingles of the centre and at most
min(rest of x, rest of y) others, the rest of x being what is neither in c nor its own.  Pairs of different components that this leaves
a chance are compared, too; no link is lost.

Sets are shipped as sorted hashes of 48 bits, not as texts.  Pairs are compared in groups of about ``SHARE`` shingles, dealt by
the centre and a salt, so the pairs of a large star are many groups, and a centre's set is built once for each of them.  (Two sets
of 5,000 shingles have a false common one with a probability of 1e-7.)

Words are runs of characters other than ASCII white space, with A-Z lower-cased.  A document's set has its distinct runs of
``n`` words; with fewer words, its whole sequence; a null or empty text has an empty set and is linked with nothing.  Rows with
equal ids are each judged by their own text (a link of any of them counts for the id); rows without an id are linked with nothing.
Ties don't arise, as ids are ordered; an empty table gives no rows; other columns aren't read (``representatives`` carries them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.common import Scratch, U, mix, pack_u64, pieces, release, shuffle_partitions, unpack_u64, windows
from sparrowmill.llm.components import connected_components

CHUNKS, CHUNK = 7, 4
SYMBOLS = CHUNKS * CHUNK
#: Shingles of the sets that a group of compared pairs has, at most (or one longer set).
SHARE = 1 << 20
#: Bytes of a row of the tables of ids, keys and pairs.
ROW_BYTES = 24

_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * U(2) + U(1)
_XOR = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(texts: pa.Array, n: int):
    """Yield the sorted distinct shingle hashes of each text."""
    for _, rows, w in pieces(texts):
        h = w.hashes(lower=True)
        for k in range(rows):
            own = h[w.first[k] : w.first[k + 1]]
            yield np.unique(windows(own, min(n, len(own)))) if len(own) else own


def signature(s: np.ndarray) -> bytes:
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, U)
    for a in range(0, len(s), 4096):
        x = (s[a : a + 4096, None] ^ _XOR) * _MUL
        low = np.minimum(low, x.min(0))
    return (mix(low) >> U(48)).astype("<u2").tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, text_hash, n_shingles, d1, d2, sig) of every row; the digest of a set is the sum of its hashes under two mixings."""

    def run(batches):
        for b in batches:
            out = []
            for s in shingle_sets(b.column(2), n):
                if len(s):
                    out.append((len(s), int(mix(s ^ U(0x5851F42D4C957F2D)).sum().view(np.int64)), int(mix(s ^ U(0x14057B7EF767814F)).sum().view(np.int64)), signature(s)))
                else:
                    out.append((0, 0, 0, None))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["id", "text_hash", "n_shingles", "d1", "d2", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), text_col)
    return rows.mapInArrow(run, "id long, text_hash long, n_shingles long, d1 long, d2 long, sig binary")


def keys(classes: DataFrame) -> DataFrame:
    """(key, id): a key for each chunk and each symbol of it that is left out."""
    variants = []
    for c in range(CHUNKS):
        for out in range(CHUNK):
            parts = [F.substring("sig", 2 * (c * CHUNK + j) + 1, 2) for j in range(CHUNK) if j != out]
            variants.append(F.xxhash64(F.lit(c * CHUNK + out), *parts))
    return classes.select(F.explode(F.array(*variants)).alias("key"), "id")


def packed_sets(texts: DataFrame, n: int) -> DataFrame:
    """(id, shingles) of texts (id, text): the distinct shingle hashes in order, 48 bits each."""

    def run(batches):
        for b in batches:
            sets = [pack_u64(np.unique(x >> U(16)), 6) for x in shingle_sets(b.column(1), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles binary")


def own_shingles(sets: DataFrame, ranges: int) -> DataFrame:
    """(id, own): shingles that no other row of ``sets`` has.  A batch sends each hash once, so a group of n copies isn't n entries."""
    packed = "part int, ids binary, who binary, hashes binary"
    several = 0xFFFF  # stands for the rows of a hash that several rows of a batch have

    def spread(batches):
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), "<i8")
            for at in range(0, b.num_rows, several):
                some = [unpack_u64(x.as_py(), 6) for x in b.column(1).slice(at, several)]
                h, who = np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some])
                order = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(h) else order
                many = np.diff(np.append(first, len(h))) > 1
                h, who = h[order[first]], np.where(many, several, who[order[first]])
                cut = np.searchsorted(((h >> U(24)) * U(ranges)) >> U(24), np.arange(ranges + 1).astype(U))
                rows = []
                for p in range(ranges):
                    if cut[p] < cut[p + 1]:
                        part = slice(cut[p], cut[p + 1])
                        docs, w = np.unique(who[part], return_inverse=True)
                        known = docs[docs < several]
                        rows.append((p, ids[at + known].tobytes(), np.where(docs[w] < several, w, several).astype("<u2").tobytes(), pack_u64(h[part], 6)))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "ids", "who", "hashes"])

    def alone(t: pa.Table) -> pa.Table:
        h = np.concatenate([unpack_u64(x.as_py(), 6) for x in t.column("hashes")])
        who, named = [], []
        for i, w in zip(t.column("ids"), t.column("who")):
            w = np.frombuffer(w.as_py(), "<u2")
            ids = np.append(np.frombuffer(i.as_py(), "<i8"), 0)
            named.append(w < several)
            who.append(ids[np.where(w < several, w, len(ids) - 1)])
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        single = ~(np.concatenate(([False], same)) | np.concatenate((same, [False]))) & np.concatenate(named)[order]
        ids, count = np.unique(np.concatenate(who)[order[single]], return_counts=True)
        return pa.table([pa.array(ids), pa.array(count)], names=["id", "own"])

    return sets.mapInArrow(spread, packed).groupBy("part").applyInArrow(alone, "id long, own long").groupBy("id").agg(F.sum("own").alias("own"))


def compare(pairs: DataFrame, sets: DataFrame, known: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, na, nb, common) of pairs (a, b): sizes of the full sets and of their intersection.  ``known``: (id, n)."""
    sized = pairs.select("a", "b").join(known.select(F.col("id").alias("b"), "n"), "b")
    stars = scratch.cut(sized.groupBy("a").agg(F.sum("n").alias("n")), f"{name}-sizes", ROW_BYTES * pairs.count())
    total = stars.agg(F.sum("n")).first()[0] or 0
    groups = max(4 * shuffle_partitions(pairs.sparkSession), -(-total // SHARE))
    share = max(1 << 11, min(SHARE, total // groups))
    dealt = pairs.select("a", "b").join(stars.select("a", F.ceil(F.col("n") / share).alias("salts")), "a")
    salt = F.pmod(F.xxhash64(F.lit(1), "b"), F.col("salts"))
    dealt = scratch.cut(dealt.select("a", "b", F.pmod(F.xxhash64("a", salt), F.lit(groups)).alias("grp")), f"{name}-dealt", ROW_BYTES * pairs.count())
    one = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    centres = dealt.select("a", "grp").distinct().join(one("a"), "a").select(F.col("grp").alias("grp_a"), F.col("a").alias("centre"), "set_a")
    members = dealt.join(one("b"), "b").select("grp", "a", "b", "set_b")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held: dict[int, list[np.ndarray]] = {}
        for a, x in zip(left.column("centre").to_pylist(), left.column("set_a")):
            held.setdefault(a, []).append(unpack_u64(x.as_py(), 6))
        rows = []
        for a, b, x in zip(right.column("a").to_pylist(), right.column("b").to_pylist(), right.column("set_b")):
            y = unpack_u64(x.as_py(), 6)
            for c in held.get(a, ()):
                small, large = (y, c) if len(y) < len(c) else (c, y)
                at = np.minimum(np.searchsorted(large, small), max(0, len(large) - 1))
                rows.append((a, b, len(c), len(y), int((large[at] == small).sum()) if len(small) else 0))
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "na", "nb", "common"])

    out = centres.groupBy("grp_a").cogroup(members.groupBy("grp")).applyInArrow(run, "a long, b long, na long, nb long, common long")
    out = scratch.cut(out, name)
    release(pairs.sparkSession)
    return out


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of the compared pairs that reach the similarity."""
    return compared.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _chances(stars: DataFrame, own: DataFrame, label: DataFrame, percent: int, scratch: Scratch, upto: int) -> DataFrame:
    """Pairs (a, b) of members of one star in different components that the bound doesn't rule out.

    ``stars``: compared pairs, ``a`` being the centre."""
    far = (100 + percent) * F.col("common") < percent * (F.col("na") + F.col("nb"))  # not linked with the centre; of a pair, one is
    m = stars.select(F.col("a").alias("c"), F.col("b").alias("x"), F.col("nb").alias("n"), "common", far.alias("far"))
    m = m.join(own.withColumnRenamed("id", "x"), "x", "left").join(label.withColumnRenamed("node", "x"), "x", "left")
    m = m.select("c", "x", "n", "common", "far", F.greatest(F.col("n") - F.col("common") - F.coalesce("own", F.lit(0)), F.lit(0)).alias("rest"), F.coalesce("component", "x").alias("grp"))
    m = scratch.cut(m, "star-members", upto)
    least, most = lambda c: F.min(F.when(F.col("far"), F.col(c))), lambda c: F.max(F.when(F.col("far"), F.col(c)))
    per = m.groupBy("c").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.min("n").alias("small"), F.max("rest").alias("most"), least("n").alias("small_far"), most("common").alias("common_far"), most("rest").alias("rest_far"))
    per = scratch.cut(per.filter("lo < hi and small_far is not null").drop("lo", "hi"), "stars-of-several", upto)
    # a member that can't be linked even with the best partner that there might be goes at once
    best = F.when(F.col("far"), F.col("common") + F.least("rest", "most")).otherwise(F.least("common", "common_far") + F.least("rest", "rest_far"))
    partner = F.when(F.col("far"), F.col("small")).otherwise(F.col("small_far"))
    m = scratch.cut(m.join(per, "c").filter((100 + percent) * best >= percent * (F.col("n") + partner)).select("c", "x", "n", "common", "far", "rest", "grp"), "star-chances", upto)
    left, right = (m.select("c", *(F.col(k).alias(f"{k}_{side}") for k in ("x", "n", "common", "far", "rest", "grp"))) for side in "lr")
    bound = F.least("common_l", "common_r") + F.least("rest_l", "rest_r")
    once = ~F.col("far_r") | (F.col("x_l") < F.col("x_r"))
    chance = once & (F.col("grp_l") != F.col("grp_r")) & ((100 + percent) * bound >= percent * (F.col("n_l") + F.col("n_r")))
    pairs = left.filter("far_l").join(right, (left.c == right.c) & chance)
    return pairs.select(F.least("x_l", "x_r").alias("a"), F.greatest("x_l", "x_r").alias("b")).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 85, links: list | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept.  ``links`` receives the tables of compared pairs, if given."""
    return labelled(docs, id_col, text_col, n, percent, links).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, unchanged: of each group of near-duplicates that with the smallest id; of rows
    with equal ids and texts one, that with the smallest digest of all columns.  Rows without an id stay."""
    s = Scratch(docs.sparkSession, "representatives")
    found = s.cut(labelled(docs, id_col, text_col, n, percent).select("id", "text_hash", "kept"), "labelled")
    gone = found.filter("not kept").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    out = docs.join(gone, (docs[id_col] == gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_hash"]), "left_anti")
    if not found.filter("kept and id is not null").groupBy("id", "text_hash").count().filter("count > 1").isEmpty():
        digest = F.struct(F.xxhash64(F.to_json(F.struct(*docs.columns))), F.hash(*(F.col(c).cast("string") for c in docs.columns)))
        first = out.filter(F.col(id_col).isNotNull()).groupBy(id_col, F.xxhash64(text_col)).agg(F.min_by(F.struct(*docs.columns), digest).alias("_row")).select("_row.*")
        out = first.unionByName(out.filter(F.col(id_col).isNull()))
    return out


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 85, links: list | None = None) -> DataFrame:
    """Per row: id, text_hash, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    s = Scratch(spark, "neardup")
    rows = s.cut(signatures(docs, id_col, text_col, n), "signatures")
    full = rows.filter("id is not null and n_shingles > 0")
    upto = ROW_BYTES * SYMBOLS * rows.count()  # a row for each key is the most that follows
    own = full.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("id"), F.min("sig").alias("sig"))
    classes = s.cut(own.select("d1", "d2", F.col("n_shingles").alias("n"), "id", "sig"), "classes", upto)
    first = s.cut(keys(classes), "keys", upto)
    centres = s.cut(first.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last").select("key", "a"), "centres", upto)
    pairs = s.cut(first.join(centres, "key").filter("id != a").select("a", F.col("id").alias("b")).distinct(), "pairs", upto)
    s.drop("keys", "centres")
    ids = s.cut(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "candidates", upto)
    known = s.cut(classes.join(ids, "id").groupBy("id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("sets"), F.sum("n").alias("all")), "known", upto)
    total = known.agg(F.sum("all")).first()[0] or 0
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sets = s.cut(packed_sets(texts.join(ids, "id"), n), "sets", 8 * total)  # the one shuffle of texts
    release(spark)
    stars = compare(pairs, sets, known, s, "stars")
    label = connected_components(_linked(stars, percent), s, "cc0")
    own = own_shingles(sets, int(max(1, total // 1_500_000)))
    own = s.cut(own.join(known.filter("sets = 1").select("id"), "id"), "own", upto)  # an id with several sets has no bound
    rest = s.cut(_chances(stars, own, label, percent, s, upto).join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        late = compare(rest, sets, known, s, "late")
        label = connected_components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(_linked(late, percent)), s, "cc1")
        if links is not None:
            links.append(late)
    if links is not None:
        links.append(stars)
    comp = classes.join(label.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("component"))
    out = rows.join(comp, (rows.d1 == comp.d1) & (rows.d2 == comp.d2) & (rows.n_shingles == comp.n), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce(component, "id"))
    return out.select("id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
