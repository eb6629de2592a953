"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised alike: lower-cased, everything in ASCII but letters and digits to spaces, runs of spaces to
one.  An item of ``m`` bytes occurs in a text with at most ``k`` edits only if they share at least ``m + 1 - q - k * q`` q-grams on
diagonals that are at most ``k`` apart.  So shared q-grams are counted in overlapping bands of diagonals (each band twice as wide as
its step); bands that reach the bound are verified by a banded alignment, which is exact within the budget ``k``.

q-grams are ``Q`` bytes and compared as the 64-bit integers that they are, so there are no false hits from hashing.  The benchmark is
a query set: its distinct items are dealt into blocks of about ``BLOCK_BYTES``, and each block's index is written once to the shared
folder.  A task compares each of its batches of texts with one block after the other and holds one index at a time, so neither the
driver's memory nor a task's grows with the benchmark, and the texts are read once.

Items of equal text are one item, under the smallest of their ids (an item without an id counts, but isn't listed).  Items shorter
than ``SHORT`` bytes have an edit budget of 0 and must match whole words.  Empty items match nothing; null or empty texts hold nothing;
repeated rows are each reported; of several occurrences of an item the one with the fewest edits counts.  Without items nothing is
contaminated; an empty table gives no rows.  Other columns are carried by ``clean`` unchanged, whatever their names.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.common import Scratch, as_strings, ended, ranges_of

Q = 8
#: Edits allowed: one for each so many bytes of an item.
BYTES_PER_EDIT = 16
SHORT = 32
BLOCK_BYTES = 2 << 20
_PIECE = 1 << 20

_NORM = np.arange(256, dtype=np.uint8)
_NORM[:128] = 32
_NORM[48:58] = np.arange(48, 58)
_NORM[97:123] = np.arange(97, 123)
_NORM[65:91] = np.arange(97, 123)


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, each led by one space and followed by one (shared) space and a zero byte, and their bounds."""
    low = pc.utf8_lower(as_strings(texts))
    joined = ended(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), low, pa.scalar(" ", pa.large_string())), " \0")
    offs = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    d = _NORM[np.frombuffer(joined.buffers()[2], np.uint8)[offs[0] : offs[-1]]]
    offs = offs - offs[0]
    d[offs[1:] - 1] = 0
    keep = np.empty(len(d), bool)
    keep[:1] = True
    np.logical_or(d[1:] != 32, d[:-1] != 32, out=keep[1:])
    bounds = np.concatenate(([0], np.cumsum(keep)))[offs]
    return d[keep], bounds


def grams(d: np.ndarray) -> np.ndarray:
    """All q-grams of 8 bytes as integers."""
    a = d.astype(np.uint16)
    a = a[:-1] | a[1:] << np.uint16(8)
    b = a.astype(np.uint32)
    b = b[:-2] | b[2:] << np.uint32(16)
    c = b.astype(np.uint64)
    return c[:-4] | c[4:] << np.uint64(32)


def align(pattern: np.ndarray, text: np.ndarray, first: int, last: int, k: int) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of the text that starts on diagonals ``first`` to ``last``, if at most k; and its end.

    Cells outside of the band (diagonals first - k to last + k) are not computed; a path with at most k edits never leaves it."""
    lo, width = first - k, last - first + 2 * k + 1
    far = k + 1
    j = lo + np.arange(width)  # text position of the cells of row 0
    row = np.where((j >= 0) & (j <= len(text)), 0, far)
    step = np.arange(width)
    shift = width + max(0, -lo) + 1
    pad = np.zeros(shift + len(text) + width + len(pattern) + abs(lo) + 2, np.uint8)
    pad[shift : shift + len(text)] = text
    for i, c in enumerate(pattern):
        # row i + 1, cell t is text position lo + t + i + 1; the diagonal neighbour is cell t of row i, the upper one cell t + 1
        at = lo + i + shift
        new = row + (pad[at : at + width] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        pos = j + i + 1
        new[(pos < 0) | (pos > len(text))] = far
        new = np.minimum.accumulate(new - step) + step
        row = np.minimum(new, far)
        if row.min() > k:
            return far, -1
    best = int(row.argmin())
    return int(row[best]), lo + best + len(pattern)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        d, bounds = normalise(pa.array([t for _, t in items], pa.string()))
        texts = [d[a : b - 1] for a, b in zip(bounds[:-1], bounds[1:])]  # with the spaces around
        long = [i for i, t in enumerate(texts) if len(t) >= Q]
        parts = [grams(texts[i]) for i in long]
        g = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        item = np.repeat(long, [len(p) for p in parts]).astype(np.int32)
        off = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
        order = np.argsort(g, kind="stable")
        gram, at = np.unique(g[order], return_index=True)
        ids = np.array([0 if i is None else i for i, _ in items], np.int64)
        self._set(ids, np.array([i is not None for i, _ in items], bool), d, bounds, item[order], off[order], gram, at.astype(np.int32))

    def _set(self, *arrays: np.ndarray) -> None:
        self.arrays = arrays
        ids, named, d, bounds, self.item, self.off, self.gram, self.at = arrays
        self.ids = [int(i) if n else None for i, n in zip(ids, named)]
        self.text = [d[a : b - 1] for a, b in zip(bounds[:-1], bounds[1:])]
        self.m = np.array([len(t) for t in self.text], np.int64)
        self.k = np.where(self.m < SHORT, 0, self.m // BYTES_PER_EDIT)
        self.need = self.m + 1 - Q - self.k * Q
        self.upto = np.append(self.at[1:], len(self.item)).astype(np.int32) if len(self.at) else self.at
        self.bits = max(16, min(24, int(len(self.gram) * 64).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.gram)] = True
        live = self.m >= Q
        self.least = int(self.need[live].min()) if live.any() else 1 << 60
        self.span = int((self.m + 2 * self.k)[live].max()) if live.any() else 0
        self.tiny: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: sorted words and their items
        for n in range(3, Q):
            own = np.flatnonzero(self.m == n)
            if len(own):
                word = np.array([int.from_bytes(self.text[i].tobytes(), "little") for i in own], np.uint64)
                self.tiny[n] = np.sort(word), own[np.argsort(word, kind="stable")]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.arrays)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        out = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            out._set(*(z[k] for k in z.files))
        return out

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def search(self, d: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text number, item number, edits, end) of every item that a text holds; the best occurrence of each."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if self.tiny:
            g = grams(np.append(d, np.zeros(Q, np.uint8)))
            for n, (words, items) in self.tiny.items():
                part = g & np.uint64((1 << 8 * n) - 1)
                lo, hi = np.searchsorted(words, part, "left"), np.searchsorted(words, part, "right")
                for at in np.flatnonzero(hi > lo):
                    t = int(np.searchsorted(bounds, at, "right")) - 1
                    for i in items[lo[at] : hi[at]]:
                        found.setdefault((t, int(i)), (0, int(at)))
        if len(d) >= Q and len(self.gram):
            g = grams(d)
            pos = np.flatnonzero(self.seen[self._slot(g)])
            which = np.searchsorted(self.gram, g[pos])
            which[which == len(self.gram)] = 0
            ok = self.gram[which] == g[pos]
            pos, which = pos[ok], which[ok]
            if len(pos):
                # a text part that holds an item has enough hits within the longest item's span: others are left out
                ahead = np.searchsorted(pos, pos + self.span, "right") - np.arange(len(pos))
                dense = np.flatnonzero(ahead >= self.least)
                cover = np.zeros(len(pos) + 1, np.int64)
                np.add.at(cover, dense, 1)
                np.add.at(cover, dense + ahead[dense], -1)
                ok = np.cumsum(cover[:-1]) > 0
                self._bands(d, bounds, pos[ok], which[ok], found)
        return [(t, i, *v) for (t, i), v in sorted(found.items())]

    def _bands(self, d, bounds, pos, which, found) -> None:
        """Work on the hits in parts of about 2^17, cut between texts."""
        s = 0
        while s < len(pos):
            e = min(s + (1 << 17), len(pos))
            if e < len(pos):
                e = int(np.searchsorted(pos, bounds[np.searchsorted(bounds, pos[e], "right")]))
            self._count(d, bounds, pos[s:e], which[s:e], found)
            s = e

    def _count(self, d, bounds, pos, which, found) -> None:
        n = (self.upto[which] - self.at[which]).astype(np.int64)
        if not n.sum():
            return
        ends = np.cumsum(n)
        entry = np.arange(ends[-1]) + np.repeat(self.at[which] - (ends - n), n)
        item, off = self.item[entry].astype(np.int64), self.off[entry].astype(np.int64)
        p = np.repeat(pos, n)
        text = np.searchsorted(bounds, p, "right") - 1
        diag = p - bounds[text] - off
        step = self.k[item] + 1
        for half in (0, 1):  # bands of two steps, half of them shifted by one step
            band = (diag + self.m[item] + half * step) // (2 * step)
            key = (text.astype(np.uint64) << np.uint64(44) | item.astype(np.uint64) << np.uint64(24)) + band.astype(np.uint64) % np.uint64(1 << 24)
            order = np.argsort(key, kind="stable")
            sk = key[order]
            first = np.flatnonzero(np.concatenate(([True], sk[1:] != sk[:-1])))
            size = np.diff(np.append(first, len(sk)))
            enough = size >= self.need[item[order[first]]]
            for f, c in zip(first[enough], size[enough]):
                e = order[f]
                i, t = int(item[e]), int(text[e])
                if found.get((t, i), (1, 0))[0] == 0:
                    continue
                own = order[f : f + c]
                if len(np.unique(p[own])) < self.need[i]:
                    continue
                low, high = int(diag[own].min()), int(diag[own].max())
                b0, b1 = int(bounds[t]), int(bounds[t + 1]) - 1
                k = int(self.k[i])
                a = max(0, low - k)
                z = min(b1 - b0, high + k + int(self.m[i]) + k)
                edits, end = align(self.text[i], d[b0 + a : b0 + z], low - a, high - a, k)
                if edits <= k and edits < found.get((t, i), (k + 1, 0))[0]:
                    found[(t, i)] = (edits, a + end)


def stored_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[str]:
    """Write the indexes of all blocks to the shared folder, a task for each block; returns their addresses, one for each block."""
    s = Scratch(benchmark.sparkSession, "benchmark")
    items = benchmark.filter(F.octet_length(text_col) > 0).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    items = s.cut(items.groupBy("t").agg(F.min("i").alias("i")), "items")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    folder, blocks = s.path("indexes"), max(1, -(-total // block_bytes))

    def build(t: pa.Table) -> pa.Table:
        from pyarrow import fs as pafs

        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = uuid.uuid4().hex  # of this attempt
        rows = sorted(zip(t.column("i").to_pylist(), t.column("t").to_pylist()), key=lambda r: r[1])
        with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
            f.write(Index(rows).dump())
        return pa.table({"block": t.column("block")[:1], "uri": [f"{folder}/{name}"]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(blocks)).cast("long"))
    return [r["uri"] for r in s.cut(dealt.groupBy("block").applyInArrow(build, "block long, uri string"), "manifest").orderBy("block").collect()]


class _Blocks:
    """The stored blocks as a task goes through them: one index is in memory at a time."""

    def __init__(self, uris: list[str]) -> None:
        self.uris, self.held, self.index = list(uris), None, None

    def each(self):
        for uri in list(self.uris):
            if uri != self.held:
                from pyarrow import fs as pafs

                self.index = None
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    self.index, self.held = Index.load(f.read()), uri
            yield self.index
        self.uris.reverse()  # the last one, which is held, is the first of the next round

    def scan(self, texts: pa.Array) -> list[dict]:
        """{item id: edits} for each text of a batch."""
        out: list[dict] = [{} for _ in range(len(texts))]
        parts = [(at, *normalise(texts.slice(at, rows))) for at, rows in ranges_of(texts, _PIECE)] if self.uris else []
        for index in self.each():
            for at, d, bounds in parts:
                for t, i, edits, _ in index.search(d, bounds):
                    out[at + t][index.ids[i]] = min(edits, out[at + t].get(index.ids[i], edits))
        return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, contaminated, n_items, item_ids (sorted), least edits.  One pass over the texts, whatever the number of blocks."""
    uris = stored_blocks(benchmark, item_col, item_text, block_bytes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        blocks = _Blocks(uris)
        for b in batches:
            got = blocks.scan(b.column(1))
            items = pa.array([sorted(i for i in g if i is not None) for g in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), items, pa.array([min(g.values(), default=None) for g in got], pa.int32())], names=["id", "items", "edits"])

    df = rows.mapInArrow(run, f"id {id_type}, items array<long>, edits int")
    return df.select(F.col("id").alias(id_col), F.col("edits").isNotNull().alias("contaminated"), F.size("items").alias("n_items"), F.col("items").alias("item_ids"), "edits")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that hold no item, unchanged."""
    uris = stored_blocks(benchmark, item_col, item_text, block_bytes)
    where = docs.columns.index(text_col)

    def run(batches):
        blocks = _Blocks(uris)
        for b in batches:
            yield b.filter(pa.array([not g for g in blocks.scan(b.column(where))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema) if uris else docs
