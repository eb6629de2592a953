"""Quality rules: statistics of documents, two fixed rules and gradient-boosted trees.

The trees are fitted here, on histograms, from a bounded sample of labelled rows (``SAMPLE`` rows, those with the smallest hash of
their id), and flattened into numpy node arrays that score a whole batch at a time.  Chosen features are monotonic: the score can
only fall as they rise (``FALLING``); splits that would break this are not taken and children's values are clipped to the midpoint
of the split, as usual.

Words are runs of characters other than ASCII white space.  A null or empty text has no words and fails the first rule.  Repeated
rows are scored alike; a score of exactly 0.5 is kept.  If there are no labels of both classes, the verdict of the trees is to keep.
Rows without an id are judged, but never fitted on; an empty table gives no rows.  Columns but id and text aren't read (with
``whole_rows`` they are carried, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.llm.common import pieces, windows

#: Labelled rows for fitting, at most.
SAMPLE = 12_000
MIN_WORDS = 50

FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share",
    "pipe_word_share", "bang_share", "line_words", "letter_share", "distinct_share", "short_share", "long_share", "cap_word_share",
)
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "pipe_word_share", "bang_share")

_CLASS = np.zeros(256, np.uint8)  # 1 symbol, 2 upper, 4 digit, 8 other punctuation, 16 lower or not ASCII, 32 bang
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-_/"]] = 8
_CLASS[97:123] = 16
_CLASS[128:] = 16
_CLASS[ord("!")] = 32


def _repeated(h: np.ndarray, n: int = 3) -> int:
    """Words covered by windows of ``n`` words that occur twice or more."""
    if len(h) < n:
        return 0
    w = windows(h, n)
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _dup_lines(data: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in data[low:high].tobytes().split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines)


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) as integers, and ``FEATURES`` as floats."""
    ints, feats = [], []
    for _, rows, w in pieces(texts):
        d, b = w.data, w.bounds
        h = w.hashes()
        lead = (d & 0xC0) != 0x80  # first byte of a code point
        points = np.concatenate(([0], np.cumsum(lead)))
        wlen = points[w.ends] - points[w.starts]
        cl = _CLASS[d]
        per_doc = lambda mask: np.add.reduceat(mask, b[:-1], dtype=np.int64)  # noqa: E731  each document has its \n
        word_sum = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[w.first])
        chars = word_sum(wlen)
        n = w.counts
        symbols = per_doc(cl == 1)
        counts = {k: per_doc((cl == k) & lead) for k in (2, 4, 8, 16, 32)}
        first = d[w.starts]
        last = d[w.ends - 1]
        pipes, short, long = word_sum((first == 124) & (w.ends - w.starts == 1)), word_sum(wlen <= 2), word_sum(wlen >= 14)
        caps = word_sum(_CLASS[first] == 2)
        bangs = word_sum(last == 33)
        dup, lines, rep, distinct = (np.zeros(rows, np.int64) for _ in range(4))
        for k in range(rows):
            hk = h[w.first[k] : w.first[k + 1]]
            if len(hk):
                rep[k] = _repeated(hk)
                dup[k], lines[k] = _dup_lines(d, b[k], b[k + 1])
                distinct[k] = len(np.unique(hk))
        ints.append(np.stack([n, chars, symbols, dup, rep], 1))
        n1, c1 = np.maximum(n, 1), np.maximum(chars, 1)
        feats.append(np.stack([
            np.log1p(n), chars / n1, symbols / c1, dup / np.maximum(lines, 1), rep / n1, counts[2] / c1, counts[4] / c1, counts[8] / c1,
            pipes / n1, bangs / n1, n / np.maximum(lines, 1), counts[16] / c1, distinct / n1, short / n1, long / n1, caps / n1,
        ], 1))
    if not ints:
        return np.zeros((0, 5), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate(ints), np.concatenate(feats)


class Trees:
    """Boosted trees as flat arrays: feature (-1 in a leaf), threshold, left child (right is next to it) and value of each node."""

    def __init__(self, base: float, feature, threshold, left, value, roots, depth: int) -> None:
        self.base, self.depth = base, depth
        self.feature, self.threshold, self.left, self.value, self.roots = (np.asarray(x) for x in (feature, threshold, left, value, roots))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for r in self.roots:
            at = np.full(len(x), r)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                at = np.where(inner, self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at]), at)
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = (), trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 20) -> Trees:
    """Newton boosting of the logistic loss on quantile bins, with features in ``falling`` monotonically decreasing."""
    n, nf = x.shape
    mean = (y.sum() + 1) / (n + 2)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(nf)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b holds cuts[b-1] < v <= cuts[b]
    feature, threshold, left, value, roots = [], [], [], [], []
    raw = np.full(n, base)
    flat = binned + np.arange(nf) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, hs = y - p, p * (1 - p)

        def node() -> int:
            for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (value, 0.0)):
                a.append(v)
            return len(feature) - 1

        roots.append(node())
        todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            gs, hh = g[rows].sum(), hs[rows].sum()
            value[at] = rate * float(np.clip(gs / (hh + l2), low, high))
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                idx = flat[rows].ravel()
                hg = np.cumsum(np.bincount(idx, np.repeat(g[rows], nf), nf * bins).reshape(nf, bins), 1)
                hh_ = np.cumsum(np.bincount(idx, np.repeat(hs[rows], nf), nf * bins).reshape(nf, bins), 1)
                hc = np.cumsum(np.bincount(idx, minlength=nf * bins).reshape(nf, bins), 1)
                gl, hl, cl = hg[:, :-1], hh_[:, :-1], hc[:, :-1]
                gr, hr, cr = gs - gl, hh - hl, len(rows) - cl
                vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                gain = gl * vl - 0.5 * (hl + l2) * vl**2 + gr * vr - 0.5 * (hr + l2) * vr**2
                v0 = value[at] / rate
                gain -= gs * v0 - 0.5 * (hh + l2) * v0**2
                gain[(cl < least) | (cr < least)] = -1
                for j in falling:
                    gain[j][vl[j] < vr[j]] = -1
                k = int(np.argmax(gain))
                if gain.flat[k] > best[0]:
                    best = (float(gain.flat[k]), divmod(k, bins - 1))
            if best[1] is None:
                raw[rows] += value[at]
                continue
            j, b = best[1]
            if b >= len(cuts[j]):
                raw[rows] += value[at]
                continue
            feature[at], threshold[at] = j, float(cuts[j][b])
            left[at] = node()
            node()
            a, z = vl[j, b], vr[j, b]
            mid = (a + z) / 2
            lim = ((mid, high), (low, mid)) if j in falling else ((low, high), (low, high))
            right = binned[rows, j] > b
            todo += [(left[at], rows[~right], level + 1, *lim[0]), (left[at] + 1, rows[right], level + 1, *lim[1])]
    return Trees(base, feature, threshold, left, value, roots, depth)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Trees | None:
    """Fit on a bounded sample of labelled documents; None if it lacks a class."""
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col, "y").limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(id_col, text_col, "y")  # at most `sample` rows are broadcast

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array([r.tobytes() for r in statistics(b.column(1))[1]], pa.binary())], names=["id", "y", "x"])

    # one row an id, so that an id of very many rows stays within the bound
    bounded = rows.mapInArrow(run, "id long, y double, x binary").groupBy("id").agg(F.min(F.struct("y", "x")).alias("r"))
    got = sorted((r["id"], r["r"]["y"], bytes(r["r"]["x"])) for r in bounded.collect())
    y = np.array([r[1] for r in got])
    if len(np.unique(y > 0.5)) < 2:
        return None
    x = np.stack([np.frombuffer(r[2]) for r in got])
    return fit(x, (y > 0.5).astype(float), tuple(FEATURES.index(f) for f in FALLING))


def judge(docs: DataFrame, model: Trees | None, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """The rules' statistics and verdict for every row: by id, or with ``whole_rows`` the kept rows themselves, unchanged."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def verdicts(texts):
        ints, feats = statistics(texts)
        n, rep = ints[:, 0], ints[:, 4]
        failed = (n < MIN_WORDS) | (100 * rep > 50 * n)
        score = model.score(feats) if model is not None else np.ones(len(n))
        return ints, failed, ~failed & (score >= 0), score

    if whole_rows:
        where = docs.columns.index(text_col)

        def keep(batches):
            for b in batches:
                yield b.filter(pa.array(verdicts(b.column(where))[2]))

        return docs.mapInArrow(keep, docs.schema)

    def run(batches):
        for b in batches:
            ints, failed, kept, score = verdicts(b.column(1))
            # columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(ints[:, k]) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(1 / (1 + np.exp(-score)))],
                names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
