"""Operators on a Spark session: whole small tables and edge cases against brute force, exact round trips and held-out accuracy."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import brute
from sparrowmill.llm import common, decontam, html_text, langid, mixing, neardup, packing, pii, quality, substring, warc
from sparrowmill.llm.common import Scratch
from sparrowmill.llm.components import connected_components
from sparrowmill.llm.queries import QUERIES

RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefghijklmno") for _ in range(RNG.randint(2, 7))) for _ in range(500)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, share, rng=RNG):
    w = text.split(" ")
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = "q" + str(rng.randrange(10**6))
    return " ".join(w)


BASE = prose(150)
LONG = prose(20_000) + " " + prose(60) + "\n" + BASE
#: (doc_id, text, lang, source): nulls, empty, blank and very long texts, copies, near copies and repeated rows.
EDGES = [
    (0, BASE, "en", "a"), (1, BASE, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "  \n\t", "en", None), (5, LONG, "en", "a"), (6, "one", "fr", "a"), (7, "One", "fr", "c"), (8, "two words", None, "c"),
    *((10 + i, edited(BASE, 0.01 + 0.004 * (i % 20)), "en", "hot") for i in range(60)), *((100 + i, prose(80) + "\n" + BASE[:300], "en", "hot") for i in range(20)), (200, "spam spam spam " * 40, "en", "b"), (201, "!!! 123 ???", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns whose names the operators use inside.
CLASH = "id long, sig string, key string, grp long, n long, part int, sb long, ord long, row string, copies int, size long, p double"


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame([(*r, 1, "s", "k", 2, 3, 4, 5, 6, "r", 7, 8, 0.5) for r in EDGES], SCHEMA + ", " + CLASH).repartition(3)
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def with_null_and_repeats(spark):
    """Rows without an id, and rows that are repeated whole."""
    return spark.createDataFrame([(None, BASE, "en", "a"), (None, BASE, "en", "a"), (1, BASE, "en", "a"), (1, BASE, "en", "a"), (2, prose(70), None, None), (None, None, None, None)], SCHEMA)


# ---------------------------------------------------------------- 1, 8, 4: by row


@pytest.mark.parametrize("table", ["docs", "edges"])
def test_pii(request, table):
    df = request.getfixturevalue(table)
    text = {r.doc_id: r.text for r in df.collect()}
    for i, r in rows(pii.scan(df)).items():
        assert r.base_sha256 == brute.base_sha(text[i])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in brute.base_spans(text[i])) for k in pii.BASE_KINDS]


def test_pii_added_kinds_are_found(spark):
    """Every value after a cue in a whole table, by a plain pattern; and each account and IBAN that is put into texts."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    plain = re.compile(r"\b(?:token|password|api_key|secret) ?[:=] ?\"?([0-9a-f]{8,})")
    found = planted = 0
    got = rows(pii.scan(docs))
    for r in docs.filter("text rlike 'token|password|api_key|secret'").collect():
        spans = set(got[r.doc_id].spans.split(","))
        for m in plain.finditer(r.text):
            planted, found = planted + 1, found + (f"secret:{m.start(1)}:{m.end(1)}" in spans)
        assert got[r.doc_id].n_spans == len(spans - {""})
    assert planted > 50 and found == planted
    rng, texts = random.Random(6), []
    for k in range(200):
        digits = "".join(rng.choice("0123456789") for _ in range(18))
        check = 98 - int(digits + "131400") % 97  # DE00 moved to the end, letters as numbers
        value = (f"IBAN DE{check:02d}{digits}", f"account number {digits[:10]}", f"https://user:pw{digits[:4]}@host.example/x")[k % 3]
        texts.append((k, f"{prose(5, rng)} {value} {prose(5, rng)}", value))
    got = rows(pii.scan(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")))
    assert all(any(x.split(":")[0] == ("iban", "account", "url")[k % 3] for x in got[k].spans.split(",")) for k, _, _ in texts)


@pytest.mark.parametrize("table", ["docs", "edges"])
def test_quality(request, spark, sf, docs, table):
    df = request.getfixturevalue(table)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    text = {r.doc_id: r.text for r in df.collect()}
    got = rows(quality.judge(df, model))
    assert {i: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for i, r in got.items()} == {i: brute.base_quality(t) for i, t in text.items()}
    assert all(r.kept == (not r.base_failed and r.score >= 0.5) for r in got.values())
    assert {r.doc_id for r in quality.judge(df, model, whole_rows=True).collect()} == {i for i, r in got.items() if r.kept}


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    test = {r.doc_id: r.quality for r in labels.filter("doc_id % 4 = 0").collect()}
    got = rows(quality.judge(docs, quality.train(docs, labels.filter("doc_id % 4 != 0"))))
    fair = [(got[i].kept, q) for i, q in test.items() if not got[i].base_failed]
    assert sum(k == bool(q) for k, q in fair) / len(fair) > 0.97


def test_quality_without_labels(spark, edges):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(edges, none) is None
    assert rows(quality.judge(edges, None))[0].kept


def test_language(spark, edges):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(docs, ~langid.held_out("doc_id"))
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = rows(langid.predict(docs, model))
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    few = rows(langid.predict(edges, model))
    assert [few[i].lang_pred for i in (2, 3, 4, 201)] == ["und"] * 4 and few[0].lang_pred != "und"
    assert langid.train(edges, langid.F.lit(False)) is None and rows(langid.predict(edges, None))[0].lang_pred == "und"


def test_letters_and_labels(spark, monkeypatch):
    """Numbers that aren't digits are no letters; of very many labels the most frequent ones are learned, from a bounded sample."""
    data = [(k, " ".join(random.Random(k).choice(("der", "die", "und", "nicht")) for _ in range(30)), "de") for k in range(40)] + [(100 + k, "the of and that " * 9, "en") for k in range(30)]
    data += [(1000 + k, "mixed up words", f"x{k}") for k in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "LANGS", 2)
    model = langid.train(df, langid.F.lit(True))
    assert sorted(model.langs) == ["de", "en"]
    texts = ["½ ² ① ٣ — 12", "½ der die und", "\u0300\u0301", "", None, "ª nicht", "漢字", "_"]
    got = rows(langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model))
    assert [got[i].lang_pred == "und" for i in range(len(texts))] == [True, False, True, True, True, False, False, True] and got[1].lang_pred == "de"


# ---------------------------------------------------------------- 2, 3: pages


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r for r in pages.collect()}
    text = rows(html_text.main_text(pages), "page_id")
    assert {i: (r.url, r.text, r.n_chars) for i, r in text.items()} == {i: (p.url, t := brute.main_text(p.html, html_text.weights(), html_text), len(t)) for i, p in html.items()}
    got = rows(warc.page_rows(spark, pages, 3), "page_id")
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == brute.warc([(i, p.html) for i, p in html.items()])


PAGE_ROWS = [(0, "u", "x" * 3_000_000), (1, None, None), (2, "v", ""), (3, "w\r\nz", "<p>é</p>"), (4, "w", "<p>é</p>"), (5, "w", "<p>é</p>"), (6, " q ", "WARC/1.1\r\n\r\n")]


def test_archives_of_edges(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in PAGE_ROWS], "page_id long, url string, html string, sha string, data int")
    got = rows(warc.page_rows(spark, pages, 2), "page_id")
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in got.items()} == brute.warc([(i, h) for i, _, h in PAGE_ROWS])
    assert {i: r.url for i, r in got.items()} == {i: u for i, u, _ in PAGE_ROWS}
    s = Scratch(spark, "t")
    chunks = warc.read(warc.write(pages, s, chunk_bytes=1 << 16), 2).collect()
    whole = defaultdict(bytes)
    for c in sorted(chunks, key=lambda c: (c.page_id, c.chunk_no)):
        assert len(c.data) <= 1 << 16
        whole[c.page_id] += bytes(c.data)
        if c.record_type == "response":
            assert c.running_digest == warc.b32(hashlib.sha1(whole[c.page_id]).digest())
    assert whole[0] == PAGE_ROWS[0][2].encode() and whole[5] == PAGE_ROWS[5][2].encode() and whole[3] == b""


def test_archives_of_repeated_rows(spark):
    """Of equal payloads one record is the response, whatever is repeated; record ids are unique, and chunks are put together by them."""
    big = "y" * 200_000
    data = [(1, "a", "x"), (1, "a", "x"), (1, "b", "x"), (1, "a", "y"), (None, "n", "x"), (2, "p", big), (2, "p", big), (2, "p", big + "z"), (None, "u", "only"), (None, "u", "only"), (None, None, None), (None, None, "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = warc.page_rows(spark, pages, 2).collect()
    want = Counter({(1, "x", "revisit", 1): 2, (1, "x", "response", None): 1, (None, "x", "revisit", 1): 1, (1, "y", "response", None): 1, (2, big, "response", None): 1, (2, big, "revisit", 2): 1, (2, big + "z", "response", None): 1})
    want.update({(None, "only", "response", None): 1, (None, "only", "revisit", None): 1, (None, "", "response", None): 1, (None, "", "revisit", None): 1})
    digest = {warc.b32(hashlib.sha1(t.encode()).digest()): t for _, t, *_ in want}
    assert Counter((r.page_id, digest[r.payload_digest], r.record_type, r.refers_to) for r in got) == want
    chunks = warc.read(warc.write(pages, Scratch(spark, "t"), chunk_bytes=1 << 14), 2).collect()
    assert len({(c.record_id, c.chunk_no) for c in chunks}) == len(chunks) and len({c.record_id for c in chunks}) == len(data)
    whole = defaultdict(bytes)
    for c in sorted(chunks, key=lambda c: (c.record_id, c.chunk_no)):
        whole[c.record_id] += bytes(c.data)
    kept = Counter(whole[c.record_id].decode() for c in chunks if c.chunk_no == 0 and c.record_type == "response")
    assert kept == Counter({t: 1 for _, t, kind, _ in want if kind == "response"})
    small = warc.page_rows(spark, pages, 2)
    assert small.count() == len(data)
    few = warc.read(warc.write(pages, Scratch(spark, "t"), least_bytes=1000), 2, digests_only=True).filter("last").collect()
    assert Counter(r.record_type for r in few) == {"response": 11, "revisit": 1} and len({r.record_id for r in few}) == len(data)


def test_archives_can_be_read_by_others(spark):
    """Standard headers: a warcinfo record first, and revisits name the record that they refer to."""
    import gzip

    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "x")], "page_id long, url string, html string")
    text = b"".join(gzip.open(r.uri.removeprefix("file://")).read() for r in warc.write(pages, Scratch(spark, "t")).collect()).decode()
    records = [dict(x.split(": ", 1) for x in r.split("\r\n\r\n")[0].split("\r\n")[1:]) for r in ("\r\n\r\n" + text).split("\r\n\r\nWARC/1.1")[1:] for r in ("WARC/1.1" + r,)]
    by = {r["WARC-Target-URI"]: r for r in records if "WARC-Target-URI" in r}
    assert text.startswith("WARC/1.1\r\nWARC-Type: warcinfo") and by["http://a"]["WARC-Refers-To"] == by["http://b"]["WARC-Record-ID"]
    assert by["http://a"]["WARC-Refers-To-Target-URI"] == "http://b" and all(r["Content-Type"] for r in records if r["WARC-Type"] in ("response", "warcinfo")) and all(r["WARC-Date"] > "2020" for r in records)


# ---------------------------------------------------------------- 5: mixing


def expected_targets(size):
    names = sorted((n for n in size if n is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in size)
    w = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    left, out, live = 1.5 * sum(size.values()), {}, set(names)
    while live:
        level = left / sum(w[n] for n in live)
        over = [n for n in live if level * w[n] > 2 * size[n] + 1e-9]
        if not over:
            return out | {n: level * w[n] for n in live}
        for n in over:
            out[n] = 2 * size[n]
            left -= out[n]
            live.discard(n)
    return out


@pytest.mark.parametrize("group", [2_000, 8])
@pytest.mark.parametrize("table", ["docs", "edges"])
def test_mixing(request, monkeypatch, table, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "FAN", 2)
    df = request.getfixturevalue(table)
    doc = {r.doc_id: r for r in df.collect()}
    got = rows(mixing.report(df))
    size = defaultdict(int)
    for i, r in doc.items():
        assert got[i].size == len(brute.WORD.findall(r.text or ""))
        size[r.source] += got[i].size
    want = expected_targets(size)
    taken, largest = Counter(), Counter()
    for i, r in got.items():
        s = doc[i].source
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)
    assert {i: r.taken for i, r in rows(mixing.report(df.repartition(5))).items()} == {i: r.taken for i, r in got.items()}


def test_mixed_rows(spark, edges):
    got = Counter(r.doc_id for r in mixing.mixed(edges).collect())
    want = rows(mixing.report(edges.filter("text is not null")))
    assert mixing.mixed(edges).columns == edges.columns
    assert {i: n for i, n in got.items() if i > 8} == {i: r.taken // r["size"] for i, r in rows(mixing.report(edges)).items() if r["size"] and i > 8 and r.taken} and want
    odd = with_null_and_repeats(spark)
    n = Counter((r.doc_id, r.text) for r in mixing.mixed(odd).collect())
    assert set(n) <= {(r.doc_id, r.text) for r in odd.collect()} and all(v <= 4 for v in n.values())


@pytest.mark.parametrize("bins,range_", [(10_000, 100_000), (2, 3)])
def test_targets_of_many_sources(spark, monkeypatch, bins, range_):
    """Sources by the hundred, in several ranges, the level narrowed over several rounds."""
    monkeypatch.setattr(mixing, "BINS", bins)
    monkeypatch.setattr(mixing, "RANGE", range_)
    rng = random.Random(4)
    size = {f"s{rng.randrange(10**6)}é{k}": rng.choice((0, 1, 7, 7, rng.randrange(10**3), rng.randrange(10**7))) for k in range(23 if bins == 2 else 400)} | {None: 50}
    df = spark.createDataFrame([(k, v) for k, v in size.items()], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(df, Scratch(spark, "t")).collect()}
    want = expected_targets(size)
    assert set(got) == set(size) and all(got[k][0] == size[k] and got[k][1] == pytest.approx(want[k], rel=1e-9, abs=1e-6) for k in size)


def test_mixing_of_rows_without_ids(spark, monkeypatch):
    """Thousands of equal rows without an id, and of one id: no group is larger than dealt, and each row is rounded on its own."""
    monkeypatch.setattr(mixing, "GROUP", 100)
    monkeypatch.setattr(mixing, "EXPAND", 700)
    seen = []
    real = mixing.numbered
    monkeypatch.setattr(mixing, "numbered", lambda rows, s: seen.append(real(rows, s)) or seen[-1])
    data = [(None, "five words are in here", "en", "a")] * 5000 + [(7, "three more words", "en", "a")] * 3000 + [(8, None, "en", "b")] * 2000 + [(9, "other words", "en", "b")] * 10
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.report(df).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == {(None, 5): 5000, (7, 3): 3000, (8, 0): 2000, (9, 2): 10}
    keys = [r.key for r in seen[0].collect()]
    assert len(set(keys)) == len(keys) == len(data)
    groups = Counter((r.source, r.g) for r in seen[0].select("source", (mixing.F.xxhash64(mixing.F.lit(18), "key") % 80).alias("g")).collect())
    assert max(groups.values()) < 250
    total = Counter()
    for r in got:
        total[r.doc_id] += r.taken
    target = {r.doc_id: r.target for r in got}
    assert abs(total[None] + total[7] - target[7]) <= 5 and 0.9 < total[None] / 5 / 5000 / (total[7] / 3 / 3000) < 1.1
    rows_ = Counter(r.doc_id for r in mixing.mixed(df).collect())
    assert abs(5 * rows_[None] + 3 * rows_[7] - target[7]) <= 5 and rows_[9] <= 20


# ---------------------------------------------------------------- 6: near-duplicates


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("table", ["docs", "edges"])
def test_near_duplicates(request, table, n, percent):
    df = request.getfixturevalue(table)
    want = brute.components([(r.doc_id, r.text) for r in df.collect()], n, percent)
    got = rows(neardup.components(df, n=n, percent=percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_no_link_is_missed_in_a_larger_table(spark):
    """Components of 10,000 documents equal those of an exact join."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want = brute.linked_components([(r.doc_id, r.text) for r in df.collect()])
    assert {i: (r.n_shingles, r.component_id) for i, r in rows(neardup.components(df)).items()} == want


def test_chained_groups(spark):
    """Copies of copies: links that no centre has, found by the later rounds."""
    rng, texts = random.Random(11), [prose(120)]
    for _ in range(70):
        texts.append(edited(texts[rng.randrange(max(0, len(texts) - 6), len(texts))], 0.03, rng))
    data = list(enumerate(texts))
    got = rows(neardup.components(spark.createDataFrame(data, "doc_id long, text string")))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute.components(data)


def test_representatives(spark, edges):
    want = brute.components([(r[0], r[1]) for r in EDGES], 5, 80)
    out = neardup.representatives(edges)
    assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if i == c} and out.columns == edges.columns
    got = [(r.doc_id, r.text) for r in neardup.representatives(with_null_and_repeats(spark)).collect()]
    assert sorted(str(i) for i, _ in got) == ["1", "2", "None", "None", "None"]


def test_components(spark):
    rng = random.Random(2)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(2000, 2100)] + [(i, i + 1) for i in range(5000, 5040)]
    up = {x: x for p in e for x in p}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in e:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {x: root(x) for a, b in e if a != b for x in (a, b)}


# ---------------------------------------------------------------- 7: packing


@pytest.mark.parametrize("table", ["docs", "edges"])
def test_packing(request, table):
    df = request.getfixturevalue(table)
    enc = packing.encoder()
    out = packing.pack(df, width=256, group=25).collect()
    found = defaultdict(dict)
    for r in out:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] <= 256 and len(r.doc_ids) == r.n_segments == len(r.cu_seqlens) - 1
        for k, (d, s) in enumerate(zip(r.doc_ids, r.doc_starts)):
            found[d][s] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    for r in df.collect():
        ids = [x for s in sorted(found[r.doc_id]) for x in found[r.doc_id][s]]
        assert sorted(found[r.doc_id]) == [256 * k for k in range(len(found[r.doc_id]))]
        assert ids[-1] == packing.end_id(enc) and enc.decode(ids[:-1]) == (r.text or "")
    full = sum(r.n_tokens for r in out)
    assert len(out) <= full / 256 * 1.1 + 5


def plain_packing(members, width):
    """Longest first, each into the open row with the least room that is enough; of equal ones the last opened or filled."""
    rows_, at = [], []
    for n in members:
        fit = [(room, -k, r) for k, (r, room) in enumerate(at) if room >= n]
        if fit:
            _, k, r = min(fit)
            room = at.pop(-k)[1]
        else:
            rows_.append([])
            r, room = len(rows_) - 1, width
        rows_[r].append(n)
        if room > n:
            at.append((r, room - n))
    return rows_


def test_packing_against_a_plain_version(spark, docs):
    """One group: the same rows as by looking through all open rows."""
    out = sorted(packing.pack(docs, width=300, group=10**9).collect(), key=lambda r: r.row)
    enc = packing.encoder()
    lengths = []
    for r in docs.collect():
        n = len(packing.encode(enc, r.text)) + 1
        lengths += [300] * (n // 300) + [n % 300] * (n % 300 > 0)
    assert [[b - a for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:])] for r in out] == plain_packing(sorted(lengths, reverse=True), 300)


def test_packed_files(spark, docs, tmp_path):
    packed = packing.pack(docs.limit(20), width=512)
    files = packing.write_binary(packed, "file://" + str(tmp_path / "f"), 512)
    want = {(r.group, r.row): r for r in packed.collect()}
    files = Scratch(spark, "t").cut(files, "manifest")
    assert {(r.group, r.row): r for r in packing.read_binary(files, 2, 512).collect()} == want
    for f in files.collect():
        path = f.file.removeprefix("file://")
        m, bits = np.fromfile(path + ".ids", "<u2").reshape(f.rows, 512), np.unpackbits(np.fromfile(path + ".resets", np.uint8)).reshape(f.rows, 512)
        cu, at = np.fromfile(path + ".cu", "<i4"), 0
        for row, starts in zip(m, bits):
            c = cu[at + 1 : at + 1 + cu[at]]
            at += 1 + cu[at]
            pos = packing.positions(c)
            assert (np.flatnonzero(pos == 0) == np.flatnonzero(starts)).all() and any(bytes(r.ids) == row[: c[-1]].tobytes() for r in want.values()) and not row[c[-1] :].any()
    with open(path + ".resets", "r+b") as f:
        f.write(b"\x00")
    with pytest.raises(Exception, match="disagree"):
        packing.read_binary(files, 2, 512).collect()


def test_packing_of_repeated_and_very_long_rows(spark):
    """Equal rows, rows without an id and one very long text are spread over groups."""
    long = prose(30_000)
    df = spark.createDataFrame([(None, "same text in all", "en", "a")] * 3000 + [(5, "same id and text", "en", "a")] * 2000 + [(9, long, "en", "a")], SCHEMA)
    out = packing.pack(df, width=64, group=200).collect()
    per = Counter()
    for r in out:
        per[r.group] += r.n_segments
    assert max(per.values()) < 400 and len(per) > 20
    first = Counter(d for r in out for d, s in zip(r.doc_ids, r.doc_starts) if s == 0)
    assert first == {None: 3000, 5: 2000, 9: 1}
    parts = {s: np.frombuffer(r.ids, "<u2")[a:b].tolist() for r in out for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]) if d == 9}
    assert packing.encoder().decode([t for s in sorted(parts) for t in parts[s]][:-1]) == long


def plans_run(spark):
    """Physical plans of the session's executions so far."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(found.size())]


def test_packed_files_take_one_worker_a_task(spark, docs):
    """No task packs in one Python worker and writes in a second, or writes through Hadoop, which starts a process for each file."""
    made, n = len(common._MADE), len(plans_run(spark))
    out = packing.packed_files(docs, width=256)
    files = [f for s in common._MADE[made:] for _, _, names in os.walk(s.root.removeprefix("file://")) for f in names]
    assert files and {f.rpartition(".")[2] for f in files} == set(packing.FILES)
    plans = plans_run(spark)[n:]
    assert plans and not any("FlatMapGroupsInArrow" in p for p in plans)
    key = lambda r: (r.group, r.row)
    assert sorted(out.collect(), key=key) == sorted(packing.pack(docs, width=256).collect(), key=key)
    assert packing.packed_files(docs.limit(0)).count() == 0


def test_packing_of_batches_cut_anywhere():
    """Groups that go on in the next batch, end with one, or are a batch's only row."""
    rng = random.Random(4)
    rows_ = [(g, rng.choice([None, *range(50)]), rng.randrange(3), bytes(2 * rng.randrange(1, 40))) for g in (0, 1, 2, 5, 9) for _ in range(rng.choice([1, 30]))]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows_), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["group", "id", "start", "ids"])
    want = {g: packing.pack_group(g, *(list(c) for c in list(zip(*(r for r in rows_ if r[0] == g)))[1:]), 64, 2).to_pylist() for g in {r[0] for r in rows_}}
    for size in (1, 2, 7, 31, 1000):
        got = list(packing.packer(64, packing.VOCABULARY)(b for i in range(0, len(table), size) for b in table.slice(i, size).to_batches()))
        assert [b.column(0)[0].as_py() for b in got] == sorted(want) and {b.column(0)[0].as_py(): b.to_pylist() for b in got} == want


# ---------------------------------------------------------------- 9: decontamination


def test_decontamination(spark, sf, docs, pairs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    import re

    plain = lambda t: " " + re.sub("[\x00-/:-@\\[-`{-\x7f]+", " ", t.lower()).strip(" ") + " "
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    got = rows(decontam.matches(docs, bench))
    budget = {k: (t, len(t) // decontam.BYTES_PER_EDIT if len(t) >= decontam.SHORT else 0) for k, t in items.items()}
    tried = {k for k in items if k % 6 == 0} | {k for r in got.values() for k in r.item_ids}  # the full table takes a second an item
    want = brute.holds_items([(i, plain(t)) for i, t in pairs], {k: budget[k] for k in tried})
    assert {i: set(r.item_ids) for i, r in got.items()} == {i: want[i] for i, _ in pairs} and any(want.values())
    blocks = decontam.matches(docs, bench, block_bytes=100)
    assert {i: (r.item_ids, r.edits) for i, r in rows(blocks).items()} == {i: (r.item_ids, r.edits) for i, r in got.items()}
    assert {r.doc_id for r in decontam.clean(docs, bench, block_bytes=2000).collect()} == {i for i, r in got.items() if not r.contaminated}


def test_decontamination_of_edited_items(spark, sf, pairs):
    """Items with letters changed, left out and put in, about as often as the budget allows and somewhat more often."""
    rng, texts = random.Random(5), []
    items = {k: prose(rng.randrange(8, 40), rng) for k in range(30)}
    for n in range(120):
        cut = list(items[n % 30])
        for _ in range(rng.randrange(2 * len(cut) // decontam.BYTES_PER_EDIT + 1)):
            at = rng.randrange(len(cut))
            cut[at : at + rng.randrange(2)] = rng.choice("abcdefghij") * rng.randrange(2)
        texts.append((n, f"{prose(rng.randrange(30), rng)} {''.join(cut)} {prose(rng.randrange(30), rng)}"))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    budget = {k: (f" {t} ", (len(t) + 2) // decontam.BYTES_PER_EDIT) for k, t in items.items()}
    want = brute.holds_items([(i, f" {' '.join(t.split())} ") for i, t in texts], budget)
    got = rows(decontam.matches(spark.createDataFrame(texts, "doc_id long, text string"), bench))
    assert {i: set(r.item_ids) for i, r in got.items()} == {i: want[i] for i, _ in texts}
    assert 20 < sum(map(bool, want.values())) < 120


def test_benchmark_of_many_blocks(spark, docs):
    """One Python stage and one index at a time, however many blocks there are; copies of an item are one."""
    items = [(k, prose(12)) for k in range(400)] + [(1000 + k, BASE) for k in range(3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontam.stored_blocks(bench, "item_id", "text", 500)) > 40
    held = spark.createDataFrame([(1, BASE + " " + items[7][1]), (2, items[300][1]), (3, prose(40))], "doc_id long, text string")
    found = decontam.matches(held, bench, block_bytes=500)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {i: r.item_ids for i, r in rows(found).items()} == {1: [7, 1000], 2: [300], 3: []}


def test_decontamination_of_edges(spark, edges):
    item = edited(BASE, 0.01)[100:500]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "ONE"), (5, item)], "item_id long, text string")
    got = rows(decontam.matches(edges, bench))
    assert got[0].item_ids == [1] and got[5].item_ids == [1] and got[6].item_ids == [4] and not got[2].contaminated and not got[3].contaminated and got[8].item_ids == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.matches(edges, none).collect()) and decontam.clean(edges, none).count() == len(EDGES)


# ---------------------------------------------------------------- 10: substrings


@pytest.mark.parametrize("table", ["docs", "edges"])
def test_substrings(request, table):
    df = request.getfixturevalue(table)
    want = brute.substring([(r.doc_id, r.text) for r in df.collect()])
    got = rows(substring.dedup(df))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    text = {r.doc_id: r.text for r in df.collect()}
    for r in got.values():
        assert hashlib.sha256(substring.kept_text(text[r.doc_id], r.repeats).encode()).hexdigest() == r.kept_sha256
        assert sum(int(b) - int(a) for a, b in (s.split(":") for s in r.repeats.split(",") if s)) == r.n_removed


def test_substrings_by_many_ranges(spark, monkeypatch, docs, pairs):
    monkeypatch.setattr(substring, "RANGE", 3000)
    got = rows(substring.dedup(docs))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == brute.substring(pairs)


def test_substrings_of_repeated_rows(spark):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring.dedup(with_null_and_repeats(spark)).collect()]
    assert Counter(got) == Counter([(1, 150, 0), (1, 150, 150), (None, 150, 150), (None, 150, 150), (2, 70, 0), (None, 0, 0)])


def test_substrings_of_hot_rows(spark, monkeypatch):
    """Thousands of rows without an id, of one id, and equal ones: no sub-batch has them all, and results equal brute force in digest order."""
    rng = random.Random(8)
    passage = prose(40, rng)
    same = [(None, passage, "en", "a")] * 3000 + [(4, prose(25, rng), "en", "a")] * 2000 + [(4, "few words", "en", "a")] * 500
    other = [(None, f"{prose(15, rng)} {passage if k % 9 == 0 else ''} {k}", "en", "a") for k in range(800)] + [(7, f"{k} {prose(30, rng)}", "en", "a") for k in range(800)]
    df = spark.createDataFrame(same + other, SCHEMA).repartition(4)
    monkeypatch.setattr(substring, "EXPAND", 300)
    dealt = []
    real = substring.probes
    monkeypatch.setattr(substring, "probes", lambda table, ranges: dealt.append((table.count(), [r["count"] for r in table.groupBy("sb").count().collect()])) or real(table, ranges))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(df).collect())
    assert dealt[0][0] == len(other) + 3  # equal rows are one
    digest = {r.text: r.d for r in df.select("text", substring.F.xxhash64("text").alias("d")).distinct().collect()}
    order = sorted(same + other, key=lambda r: (r[0] is None, r[0] or 0, digest[r[1]]))
    want = brute.substring([(k, r[1]) for k, r in enumerate(order)])
    assert got == Counter((r[0], *want[k]) for k, r in enumerate(order))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("sparrowmill_")]


# ---------------------------------------------------------------- empty tables, the queries and the pipeline


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (pii.scan(empty), html_text.main_text(pages), warc.page_rows(spark, pages, 2), langid.predict(empty, langid.train(empty, ~langid.held_out())), mixing.report(empty), mixing.mixed(empty), neardup.components(empty), neardup.representatives(empty), packing.pack(empty), quality.judge(empty, quality.train(empty, none)), decontam.matches(empty, spark.createDataFrame([], "item_id long, text string")), substring.dedup(empty)):
        assert df.count() == 0


def test_rows_without_ids_and_repeated_rows(spark):
    odd = with_null_and_repeats(spark)
    n = odd.count()
    for df in (pii.scan(odd), langid.predict(odd, None), mixing.report(odd), quality.judge(odd, None), decontam.matches(odd, spark.createDataFrame([(1, BASE)], "item_id long, text string"))):
        assert df.count() == n
    near = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.components(odd).collect())
    assert near == Counter({(None, None, True): 3, (1, 1, True): 2, (2, 2, True): 1})
    assert sum(r.n_segments for r in packing.pack(odd).collect()) == n


def test_queries_are_registered(spark, sf):
    import __spark_entry__ as s

    assert set(QUERIES) <= set(s.queries()) and "pipeline" in s.queries()
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op3_warc", "op6_near_duplicates", "op10_substring_dedup"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    from sparrowmill.llm.queries import ORACLE_SQL

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = c.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r[x] for x in cols) for r in df.collect()))) == sorted(map(repr, res.fetchall()))


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as p

    now, seen = docs, {}
    for name, stage in p.STAGES:
        before, now = now, Scratch(spark, "p").cut(stage(spark, now, sf), "stage")
        seen[name] = (before, now)
        if name != p.STAGES[-1][0]:
            assert now.columns == docs.columns
    before, after = seen["quality rules"]
    kept = rows(quality.judge(before, quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))))
    assert {r.doc_id for r in after.collect()} == {i for i, r in kept.items() if r.kept}
    before, after = seen["near duplicates"]
    comp = brute.components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in comp.items() if i == c)
    before, after = seen["decontamination"]
    dirty = {i for i, r in rows(decontam.matches(before, spark.read.parquet(f"{sf}/benchmark.parquet"))).items() if r.contaminated}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - dirty
    before, after = seen["source mix"]
    want = {i: r.taken // r["size"] for i, r in rows(mixing.report(before)).items() if r.taken}
    assert Counter(r.doc_id for r in after.collect()) == Counter(want)
    before, after = seen["packed tokens"]
    assert Counter(d for r in after.collect() for d, s in zip(r.doc_ids, r.doc_starts) if s == 0) == Counter(r.doc_id for r in before.collect())
    assert p.run(spark, sf).count() == after.count()


def python_workers_a_task(plan):
    """The most Python operators between two exchanges of a plan without branches that have some."""
    most = now = 0
    for line in plan.split("\n\n")[0].splitlines():
        now = 0 if "Exchange" in line or "Plan ==" in line else now + ("InArrow" in line or "InPandas" in line)
        most = max(most, now)
    return most


def test_pipeline_takes_one_python_worker_a_task(spark, sf, docs):
    """Workers stay and are used in turn, so one stage with two a task doubles what all stages' workers hold of an executor's memory."""
    import corpus_pipeline as p

    now = docs
    for name, stage in p.STAGES:
        n = len(plans_run(spark))
        now = Scratch(spark, "p").cut(stage(spark, now, sf), "stage")
        assert {python_workers_a_task(x) for x in plans_run(spark)[n:]} <= {0, 1}, name
