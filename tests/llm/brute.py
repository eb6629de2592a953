"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections import defaultdict
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((*m.span(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((*m.span(), "phone"))
    rank = {"email": 0, "ip": 1, "card": 2, "phone": 3}
    return sorted(out, key=lambda s: (s[0], rank[s[2]]))


def base_sha(text: str | None) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base_spans(text)).encode()).hexdigest()


def shingles(text: str | None, n: int = 3) -> set:
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(docs: list[tuple[int, str | None]], n: int = 3, percent: int = 85) -> dict[int, tuple[int, int]]:
    """{id: (set size, component)} from all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in docs}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    common: dict = defaultdict(int)
    for ids in at.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                common[ids[a], ids[b]] += 1
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def base_quality(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    hit = {j for at in where.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def substring(docs: list[tuple[int, str | None]], n: int = 20) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            if x in seen:
                gone[k : k + n] = [True] * n
            seen.add(x)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def warc(pages: list[tuple[int, str | None]], least: int = 0) -> dict[int, tuple]:
    top: dict = {}
    for i, h in pages:
        top[h or ""] = max(i, top.get(h or "", i))
    out = {}
    for i, h in pages:
        b = (h or "").encode()
        revisit = len(b) >= least and top[h or ""] != i
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top[h or ""] if revisit else None)
    return out


def edit_distance_within(item: str, text: str) -> int:
    """Least edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


class _Tree(HTMLParser):
    """A page's blocks by the standard library's parser: nested dicts instead of one scan."""

    def __init__(self, h) -> None:
        super().__init__(convert_charrefs=False)
        self.h, self.hidden, self.root = h, [], {"name": "", "up": None, "cues": (), "kids": [], "n": 0, "l": 0}
        self.now, self.blocks, self.elements = self.root, [([], [])], []

    def _cut(self, name: str, e: dict) -> None:
        bare = name.removeprefix("/")
        if bare in self.h.BLOCK and self.blocks[-1][1]:
            self.blocks.append(([], []))
        if name == "br":
            self.blocks[-1][1].append((" ", self.now))
        if bare in self.h.BLOCK or not self.blocks[-1][1]:
            self.blocks[-1][0].append((name, e))

    def _path(self) -> list[dict]:
        out, e = [], self.now
        while e is not self.root:
            out.append(e)
            e = e["up"]
        return out

    def handle_starttag(self, tag, attrs) -> None:
        if self.hidden:
            self.hidden += [tag] * (tag == self.hidden[0])
            return
        if tag in self.h.HIDDEN:
            if tag in self.h.BLOCK:
                self._cut(tag, self.now)
            self.hidden.append(tag)
            return
        if tag in self.h.VOID:
            self._cut(tag, self.now)
            return
        if tag in self.h.BLOCK:
            block = next((e for e in self._path() if e["name"] in self.h.BLOCK), None)
            if block and block["name"] == "p":
                self.now = block["up"]
        last = None
        for e in self._path():
            if e["name"] in self.h.ENDS.get(tag, ()):
                last = e
            elif e["name"] in self.h.WITHIN:
                break
        if last:
            self.now = last["up"]
        names = [e["name"] for e in self._path()]
        cues = []
        if tag in self.h.PARTS:
            cues.append("<" + tag + " in an article" * (tag in ("header", "footer") and ("article" in names or "main" in names)))
        for k, v in attrs:
            cues += [("role " if k == "role" else "") + x for x in (v or "").lower().split() if k in ("class", "id", "role")]
        a = dict(attrs)
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or ""):
            cues.append("hidden")
        e = {"name": tag, "up": self.now, "cues": tuple(dict.fromkeys(cues)), "n": 0, "l": 0, "link": tag == "a" or "a" in names}
        self._cut(tag, e)
        self.elements.append(e)
        self.now = e

    def handle_endtag(self, tag) -> None:
        if self.hidden:
            if tag == self.hidden[0]:
                self.hidden.pop()
            return
        e = next((e for e in self._path() if e["name"] == tag), None)
        if e:
            self.now = e["up"]
        self._cut("/" + tag, e or self.now)

    def _text(self, text: str) -> None:
        if self.hidden:
            return
        if self.blocks[-1][1] and self.blocks[-1][1][-1][1] is self.now:
            text = self.blocks[-1][1].pop()[0] + text
        self.blocks[-1][1].append((text, self.now))

    handle_data = _text

    def handle_entityref(self, name) -> None:
        self._text(f"&{name};")

    def handle_charref(self, name) -> None:
        self._text(f"&#{name};")


def main_text(page: str | None, w, h) -> str:
    """Main text by trying every region; ``h`` has the fixed values of HTML, ``w`` the weights."""
    t = _Tree(h)
    t.feed(page or "")
    t.close()
    for _, parts in t.blocks:
        for text, e in parts:
            link, n = e.get("link", False), len(text.split())
            while e is not None:
                e["n"], e["l"] = e["n"] + n, e["l"] + n * link
                e = e["up"]
    above = lambda e: [e] + above(e["up"]) if e is not None else []

    def negative(e):
        own = sum(w.cues.get(c, 0) for c in e["cues"])
        length = f"words {min(e['n'], 1000).bit_length() // 2}"
        shape = w.cues.get(f"links {min(3, 4 * e['l'] // max(1, e['n']))}", 0) + w.cues.get(length, 0)
        shape += sum(w.cues.get(f"{c} {length}", 0) for c in e["cues"] if c.startswith("<"))
        return e["name"] not in ("", "html", "body") and own < 0 and own + shape < 0

    left = lambda e: [x for x in above(e) if negative(x)]
    authors = {x: {id(e) for e in t.elements if e["name"] == x and e["n"] and not left(e)} for x in ("article", "main")}

    def place(e):
        ids = {id(x) for x in above(e)}
        if ids & authors["article"]:
            return "article"
        if ids & authors["main"]:
            return "beside" if authors["article"] else "main"
        return "outside" if authors["article"] or authors["main"] else "plain"

    scores, last = [], None
    for tags, parts in t.blocks:
        a = sum(w.tag.get((n, place(e)), w.other) for n, e in tags if not left(e))
        b = 0.0
        for text, e in parts:
            if gone := left(e):
                if gone[-1] is not last:
                    last = gone[-1]
                    a += w.skip[place(last["up"])]
            else:
                b += len(text.split()) * w.word[place(e), e.get("link", False)]
        scores.append((a * w.scale, b))
    best, span = 0.0, (0, 0)
    for i in range(len(scores)):
        run = 0.0
        for j in range(i, len(scores)):
            run += scores[j][1] + (scores[j][0] if j > i else 0.0)
            if run > best + 1e-9:
                best, span = run, (i, j + 1)
    out = ["".join(x for x, e in parts if not left(e)) for _, parts in t.blocks[span[0] : span[1]]]
    return "\n".join(x for o in out if (x := re.sub(r"\s+", " ", html.unescape(o)).strip()))


def holds_items(docs: list[tuple[int, str]], items: dict[int, tuple[str, int]]) -> dict[int, set[int]]:
    """Items that each text holds with at most so many edits, by the full table of distances of each item to all texts."""
    import numpy as np

    gap = np.zeros(max((k for _, k in items.values()), default=0) + 1, np.uint8)  # no path over it is within the budget
    parts, bounds = [gap], [len(gap)]
    for _, t in docs:
        parts += [np.frombuffer(t.encode("utf-8"), np.uint8), gap]
        bounds.append(bounds[-1] + len(parts[-2]) + len(gap))
    d = np.concatenate(parts)
    step = np.arange(len(d) + 1, dtype=np.int32)
    out = defaultdict(set)
    for i, (item, k) in items.items():
        row = np.zeros(len(d) + 1, np.int32)
        for c in item.encode("utf-8"):
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + (d != c))
            row = np.minimum.accumulate(new - step) + step
        for n in np.unique(np.searchsorted(bounds, np.flatnonzero(row <= k), "right") - 1):
            out[docs[n][0]].add(i)
    return out


def linked_components(docs: list[tuple[int, str | None]], n: int = 3, percent: int = 85) -> dict[int, tuple[int, int]]:
    """As ``components``, for more documents: sets with enough in common share one of their rarest shingles (the exact prefix filter)."""
    by_set: dict[frozenset, list[int]] = defaultdict(list)
    for i, t in docs:
        by_set[frozenset(shingles(t, n))].append(i)
    sets = [s for s in by_set if s]
    count: dict = defaultdict(int)
    for s in sets:
        for g in s:
            count[g] += 1
    up = {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for ids in by_set.values():
        if by_set.get(frozenset()) is not ids:
            for i in ids:
                a, b = sorted((root(ids[0]), root(i)))
                up[b] = a
    index: dict = defaultdict(list)
    for s in sorted(sets, key=len):
        seen = set()
        rare = sorted(s, key=lambda g: (count[g], g))[: len(s) - -(-percent * len(s) // 100) + 1]
        for g in rare:
            for other in index[g]:
                if id(other) not in seen and 100 * len(other) >= percent * len(s):
                    seen.add(id(other))
                    common = len(s & other)
                    if 100 * common >= percent * (len(s) + len(other) - common):
                        a, b = sorted((root(by_set[s][0]), root(by_set[other][0])))
                        up[b] = a
            index[g].append(s)
    return {i: (len(s), root(i)) for s, ids in by_set.items() for i in ids}
