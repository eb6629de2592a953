"""Token ids in packed matrices: best-fit-decreasing packing with a segment tree over capacities.

Texts are tokenised with a given public vocabulary (a rank file, by path) and an end token is added to each.  A document longer than a
row is split into pieces, losslessly: piece ``k`` holds tokens ``k * width`` to ``(k + 1) * width``.  Pieces are dealt by a hash into
groups of about ``GROUP``, so a group has a bounded number of bytes however long documents are, and every group packs its pieces on its
own: longest first, each into the fullest row that still has room, found in a segment tree over the remaining capacities.  Pieces of
equal length are taken by id (rows without one last), start and tokens.

``write_binary`` writes packed rows as matrices of ids (little-endian, two bytes each if the vocabulary allows, else four), position
resets (a bit for each token: whether its position is 0), cumulative segment lengths, and for each segment the document and its first
token's offset in it; ``read_binary`` reads them again.  ``packed_files`` packs and writes in one Python worker a task, as groups come in; the
manifest, a row for each task that wrote, goes by the driver, so no task writes through Hadoop, whose local file system starts a process
for each file and folder.

A null or empty text has no tokens but its end token.  Rows with equal ids, or none, are documents of their own; equal rows are numbered
within a task, so they aren't all dealt to one group.  An empty table gives no rows; columns but id and text aren't read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.common import BATCH_BYTES, TASK_BYTES, Scratch, shuffle_partitions, trim

WIDTH = 2048
GROUP = 500
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before merges, as the vocabulary's description gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = VOCABULARY):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space in Unicode, as the tokenizer's pattern has it; its engine runs out of stack on very long runs of it, so those that are
#: longer than ``SPACE_RUN`` are given to the merges as the one piece that the pattern makes of them.  Ids are the tokenizer's own.
SPACE_RUN = 10_000
_SPACES = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{SPACE_RUN},}}")


def encode(enc, text: str | None) -> list[int]:
    """Token ids of a text; they decode to it exactly."""
    if not text:
        return []
    if len(text) < SPACE_RUN or not _SPACES.search(text):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in _SPACES.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1  # the last one belongs to the word that follows
        out += enc.encode_ordinary(text[at : m.start()]) + enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def end_id(enc) -> int:
    """The first id after the vocabulary's."""
    return enc.n_vocab


class Capacities:
    """How many open rows have each remaining capacity; finds the smallest capacity that is large enough in O(log width)."""

    def __init__(self, width: int) -> None:
        self.base = 1 << width.bit_length()
        self.tree = [0] * (2 * self.base)

    def change(self, capacity: int, by: int) -> None:
        i = self.base + capacity
        while i:
            self.tree[i] += by
            i >>= 1

    def least(self, need: int) -> int:
        """Smallest capacity >= need of an open row; -1 if none."""
        tree, i = self.tree, self.base + need
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; pieces are taken in the given order, which should be longest first."""
    open_rows: dict[int, list[int]] = {}
    tree, rows = Capacities(width), []
    for k, n in enumerate(lengths):
        c = tree.least(n)
        if c < 0:
            rows.append([])
            r, c = len(rows) - 1, width
        else:
            r = open_rows[c].pop()
            tree.change(c, -1)
        rows[r].append(k)
        if c > n:
            open_rows.setdefault(c - n, []).append(r)
            tree.change(c - n, 1)
    return rows


def positions(cu: list[int]) -> np.ndarray:
    """Position ids of a packed row: they restart at 0 in every segment."""
    cu = np.asarray(cu)
    return np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))


def pieces(docs: DataFrame, id_col: str, text_col: str, width: int, vocabulary: str) -> DataFrame:
    """(id, start, salt, ids) of the pieces of all documents; ``salt`` numbers equal rows of a task, in whatever order they come."""

    def run(batches):
        enc = encoder(vocabulary)
        end = end_id(enc)
        kind = "<u2" if end < 1 << 16 else "<u4"
        step, seen = width * np.dtype(kind).itemsize, {}
        for b in batches:
            held, size = [], 0
            for i, (doc, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                ids = encode(enc, t.as_py())
                ids.append(end)
                data = np.array(ids, kind).tobytes()
                name = hash((doc, data))
                salt = seen[name] = seen.get(name, -1) + 1
                held += [(doc, s // (step // width), salt, data[s : s + step]) for s in range(0, len(data), step)]
                size += len(data)
                if size > BATCH_BYTES or i == b.num_rows - 1:
                    cols = [pa.array(c, k) for c, k in zip(zip(*held), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "salt", "ids"])
                    held, size = [], 0
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, start int, salt int, ids binary")


PACKED = "group long, row int, n_tokens int, n_segments int, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<int>, ids binary"
_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
_NAMES = [c.split()[0] for c in PACKED.split(", ")]


def dealt(docs: DataFrame, id_col: str, text_col: str, width: int, vocabulary: str, group: int) -> DataFrame:
    """(group, id, start, ids) of all pieces; a group's rows come one after the other."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col).cast("string")))).first()
    groups = max(1, -(-(n + (size or 0) // (4 * width)) // group))  # a token has about four bytes
    every = pieces(docs, id_col, text_col, width, vocabulary)
    rows = every.select(F.pmod(F.xxhash64("id", "start", "salt", "ids"), F.lit(groups)).alias("group"), "id", "start", "ids")
    return rows.repartition("group").sortWithinPartitions("group")


def pack_group(g: int, ids: list, starts: list[int], data: list[bytes], width: int, wide: int) -> pa.RecordBatch:
    """Packed rows of one group's pieces."""
    order = sorted(range(len(data)), key=lambda i: (-len(data[i]), ids[i] is None, ids[i] or 0, starts[i], data[i]))
    rows = []
    for r, members in enumerate(best_fit([len(data[i]) // wide for i in order], width)):
        segs = [order[k] for k in members]
        cu = np.concatenate(([0], np.cumsum([len(data[i]) // wide for i in segs])))
        rows.append((g, r, int(cu[-1]), len(segs), cu.tolist(), [ids[i] for i in segs], [starts[i] for i in segs], b"".join(data[i] for i in segs)))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def packer(width: int, vocabulary: str):
    """Packs what ``dealt`` gives, in batches cut anywhere; one group is held at a time."""
    wide = 2 if vocabulary_size(vocabulary) < 1 << 16 else 4

    def run(batches):
        held, now = ([], [], []), None
        for b in batches:
            groups = np.asarray(b.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)] if len(groups) else [0]
            for at, to in zip(cuts, cuts[1:]):
                g = int(groups[at])
                if g != now and held[0]:
                    yield pack_group(now, *held, width, wide)
                    held = ([], [], [])
                now = g
                for h, c in zip(held, b.columns[1:]):
                    h += c.slice(at, to - at).to_pylist()
        if held[0]:
            yield pack_group(now, *held, width, wide)
        trim()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """Packed rows of all documents."""
    return dealt(docs, id_col, text_col, width, vocabulary, group).mapInArrow(packer(width, vocabulary), PACKED)


def vocabulary_size(path: str) -> int:
    with open(path, "rb") as f:
        return sum(1 for line in f if line.strip()) + 1


def matrix(rows: list, width: int = WIDTH, pad: int = 0, kind: str = "<u2") -> np.ndarray:
    """Packed rows as one id matrix, padded at the right."""
    out = np.full((len(rows), width), pad, kind)
    for i, r in enumerate(rows):
        v = np.frombuffer(r["ids"], kind)
        out[i, : len(v)] = v
    return out


def resets(cu: list[int], width: int) -> np.ndarray:
    """A bit for each place of a padded row: whether a segment starts there."""
    out = np.zeros(width, np.uint8)
    out[np.asarray(cu[:-1], np.int64)] = 1
    return np.packbits(out)


FILES = ("ids", "resets", "cu", "segments")
MANIFEST = "file string, rows long"
_SEGMENTS = pa.schema([("group", pa.int64()), ("row", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32()))])


def writer(folder: str, width: int, kind: str):
    """Writes packed rows and gives a task's row of the manifest, if it has any."""

    def run(batches):
        import uuid
        from contextlib import ExitStack

        from pyarrow import fs as pafs

        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name, n = uuid.uuid4().hex, 0
        with ExitStack() as stack:
            sinks = segments = None
            for b in batches:
                if not b.num_rows:
                    continue
                if sinks is None:
                    sinks = {x: stack.enter_context(fs.open_output_stream(f"{path}/{name}.{x}", compression=None)) for x in FILES}
                    segments = stack.enter_context(pa.ipc.new_stream(sinks["segments"], _SEGMENTS))
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    rows = part.to_pylist()
                    sinks["ids"].write(matrix(rows, width, 0, kind).tobytes())
                    sinks["resets"].write(b"".join(resets(r["cu_seqlens"], width).tobytes() for r in rows))
                    sinks["cu"].write(b"".join(np.array([len(r["cu_seqlens"]), *r["cu_seqlens"]], "<i4").tobytes() for r in rows))
                    segments.write_batch(pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in _SEGMENTS], schema=_SEGMENTS))
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "rows": pa.array([n], pa.int64())})

    return run


def write_binary(packed: DataFrame, folder: str, width: int = WIDTH, kind: str = "<u2") -> DataFrame:
    """Write every task's rows as files of one name; returns the manifest (file, rows).  Only files that the manifest names count.

    ``.ids``: the matrix of ids, padded with zeros; ``.resets``: bits, a row of bytes for each row; ``.cu``: cumulative lengths (int32),
    each row led by their number; ``.segments``: group, row, documents and starts, as an Arrow stream."""
    return packed.select("group", "row", "cu_seqlens", "doc_ids", "doc_starts", "ids").mapInArrow(writer(folder, width, kind), MANIFEST)


def read_binary(manifest: DataFrame, partitions: int, width: int = WIDTH, kind: str = "<u2") -> DataFrame:
    """The packed rows of all files of a manifest; files that disagree are an error."""
    wide, marks = np.dtype(kind).itemsize, -(-width // 8)

    def run(batches):
        from contextlib import ExitStack

        from pyarrow import fs as pafs

        for uri, rows in ((u, n) for b in batches for u, n in zip(*(c.to_pylist() for c in b.columns))):
            fs, path = pafs.FileSystem.from_uri(uri)
            seen = 0
            with ExitStack() as stack:
                src = {x: stack.enter_context(fs.open_input_stream(f"{path}.{x}", compression=None)) for x in FILES}
                for b in pa.ipc.open_stream(src["segments"]):
                    out = []
                    for s in b.to_pylist():
                        ids, bits = src["ids"].read(width * wide), np.frombuffer(src["resets"].read(marks), np.uint8)
                        cu = np.frombuffer(src["cu"].read(4 * int.from_bytes(src["cu"].read(4), "little")), "<i4").tolist()
                        if np.flatnonzero(np.unpackbits(bits, count=width)).tolist() != cu[:-1] or len(cu) != len(s["doc_ids"]) + 1 or len(ids) != width * wide:
                            raise ValueError(f"files of {uri} disagree")
                        out.append((s["group"], s["row"], cu[-1], len(cu) - 1, cu, s["doc_ids"], s["doc_starts"], ids[: cu[-1] * wide]))
                    seen += len(out)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
                if seen != rows or any(src[x].read(1) for x in ("ids", "resets", "cu")):
                    raise ValueError(f"{uri} has {seen} rows, its manifest {rows}")
        trim()

    return manifest.repartition(partitions).mapInArrow(run, PACKED)


def packed_files(docs: DataFrame, width: int = WIDTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack, write the files to the shared folder and give the rows that are read back from them, in tasks of ``TASK_BYTES`` (but at least
    eight a core) if those are fewer than the shuffle partitions."""
    spark = docs.sparkSession
    folder = Scratch(spark, "packing").path("matrices")
    kind = "<u2" if vocabulary_size(vocabulary) < 1 << 16 else "<u4"
    packs, writes = packer(width, vocabulary), writer(folder, width, kind)
    written = dealt(docs, "doc_id", "text", width, vocabulary, GROUP).mapInArrow(lambda batches: writes(packs(batches)), MANIFEST).collect()
    size = sum(r["rows"] for r in written) * width * np.dtype(kind).itemsize
    tasks = max(8 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return read_binary(spark.createDataFrame(written, MANIFEST), min(tasks, shuffle_partitions(spark)), width, kind)
