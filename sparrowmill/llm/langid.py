"""Language identification by nearest centroid.

A text's vector has the TF-IDF of its hashed character n-grams (1 to 3 code points, lower-cased, of words padded by one space),
normalised.  Every language has several centroids, found by spherical k-means.  The language of the nearest centroid by cosine is
predicted; a text that is farther from all centroids than ``REJECT`` is flagged as rejected (its nearest language is still named).

The classifier is fitted on a bounded sample: about ``PER_LANG`` rows of each language, those with the smallest hash of their id, and
fewer where ``SAMPLE`` rows in all would be exceeded; of more than ``LANGS`` labels the most frequent ones are learned.  Letters are
what Unicode puts in category L.  A null text, or one without a letter, is ``und`` with score 0.  Texts are read whole; repeated rows
are predicted alike; of centroids with equal cosines the first counts (languages in order, then as found).  Without rows to learn
from, everything is ``und``; an empty table gives no rows.  Columns but id, text and language aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented bounds of the fitted classifier.
PER_LANG, SAMPLE, LANGS = 600, 12_000, 200
DIM = 2048
CENTROIDS = 3
REJECT = 0.75  # cosine distance
UND = "und"

_LETTER = regex.compile(r"\p{L}")
_SPACES = regex.compile(r"[^\p{L}\p{M}]+")


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of a text; None without a letter."""
    if not text or not _LETTER.search(text):
        return None
    c = np.frombuffer(f" {_SPACES.sub(' ', text.lower())} ".encode("utf-32-le"), np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA77) + c[2:]
    shift = np.uint32(32 - (DIM.bit_length() - 1))
    parts = ((c * np.uint32(0x9E3779B1)) >> shift, (two * np.uint32(0xC2B2AE3D)) >> shift, (three * np.uint32(0x27D4EB2F)) >> shift)
    return sum(np.bincount(p, minlength=DIM) for p in parts).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Centroids:
    def __init__(self, langs: list[str], owner: np.ndarray, centres: np.ndarray, idf: np.ndarray) -> None:
        self.langs, self.owner, self.centres, self.idf = langs, owner, centres, idf

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine of each row of counts."""
        v = _unit(np.log1p(x) * self.idf)
        s = v @ self.centres.T
        best = np.argmax(s, 1)
        return self.owner[best], np.clip(s[np.arange(len(s)), best], 0, 1)


def fit(x: np.ndarray, y: list[str], k: int = CENTROIDS, rounds: int = 12) -> Centroids:
    langs = sorted(set(y))
    y = np.array([langs.index(v) for v in y])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    v = _unit(np.log1p(x) * idf)
    owner, centres = [], []
    for lang in range(len(langs)):
        rows = v[y == lang]
        # seeds at even ranks of likeness to the mean, so that outliers (wrong labels, mixed texts) don't become centroids of their own
        order = np.argsort(rows @ _unit(rows.mean(0)), kind="stable")
        n = min(k, len(rows))
        c = rows[order[[(2 * j + 1) * len(rows) // (2 * n) for j in range(n)]]]
        for _ in range(rounds):
            at = np.argmax(rows @ c.T, 1)
            c = np.stack([_unit(rows[at == j].mean(0)) if (at == j).any() else c[j] for j in range(len(c))])
        keep = np.bincount(at, minlength=len(c)) >= max(1, len(rows) // 50)
        c = c[keep]
        owner += [lang] * len(c)
        centres.append(c)
    return Centroids(langs, np.array(owner), np.concatenate(centres).astype(np.float32), idf.astype(np.float32))


def train(docs: DataFrame, eligible, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Centroids | None:
    """Fit on a bounded sample of the rows where ``eligible`` holds; None if there are none."""
    rows = docs.filter(eligible & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col, F.col(lang_col).alias("lang"))
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
    n = {r["lang"]: r["n"] for r in most.collect()}
    if not n:
        return None
    per_lang = min(per_lang, max(1, SAMPLE // len(n)))
    unit = (F.xxhash64(F.lit("langid"), id_col) / F.lit(float(1 << 63)) + 1) / 2
    rate = F.create_map(*(F.lit(x) for kv in ((k, min(1.0, per_lang / v)) for k, v in sorted(n.items())) for x in kv))
    chosen = rows.filter(F.col("lang").isin(list(n)) & (unit < F.try_element_at(rate, F.col("lang"))))

    def run(batches):
        for b in batches:
            got = [(i, l, c.tobytes()) for i, t, l in zip(*(x.to_pylist() for x in b.columns)) if (c := counts(t)) is not None]
            cols = list(zip(*got)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], names=["id", "lang", "x"])

    # one row an id and language, so that an id of very many rows stays within the bound
    bounded = chosen.mapInArrow(run, "id long, lang string, x binary").groupBy("id", "lang").agg(F.min("x").alias("x"))
    got = sorted((r["id"] or 0, r["lang"], bytes(r["x"])) for r in bounded.collect())
    if not got:
        return None
    return fit(np.stack([np.frombuffer(r[2], np.float32) for r in got]), [r[1] for r in got])


def held_out(id_col: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id's text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def predict(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                x = [counts(t.as_py()) if model is not None else None for t in part.column(1)]
                ok = [i for i, v in enumerate(x) if v is not None]
                lang, score = [UND] * len(x), np.zeros(len(x))
                if ok:
                    who, cos = model.predict(np.stack([x[i] for i in ok]))
                    score[ok] = cos
                    for i, w in zip(ok, who):
                        lang[i] = model.langs[w]
                rejected = np.array([l == UND for l in lang]) | (score < 1 - REJECT)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[id_col, "held_out", "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col, held_out(id_col).alias("held_out")).mapInArrow(run, f"{id_col} {id_type}, held_out boolean, lang_pred string, score double, rejected boolean")
