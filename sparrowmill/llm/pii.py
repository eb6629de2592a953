"""Personal data in texts, by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits, ``://`` and identifier cues such as ``IBAN`` or
``password``.  Around each anchor a deterministic local parser expands to the boundaries of the candidate and validates it.  Matches
of the base kinds equal the leftmost non-overlapping matches of their patterns over the whole text, because every match lies in one
maximal run of the characters its pattern can hold, and each such run is parsed as a whole, in linear time.

Base kinds, in this order: ``email``, ``ip``, ``card``, ``phone``.  Added kinds: ``url`` (with user information before the host),
``iban`` (checksum), ``account`` (digits after a cue) and ``secret`` (a value after a cue, or an access key).

A null or empty text has no spans; very long texts are parsed whole; repeated rows each give their row.
Spans of two kinds may overlap, and of one kind don't: the leftmost counts.  An empty table gives no rows; columns but id and text
aren't read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")
_RANK = {k: i for i, k in enumerate(KINDS)}

#: Cues that precede an account number or a secret.
ACCOUNT_CUES = ("account", "acct", "routing", "passport", "SSN", "ssn")
SECRET_CUES = ("password", "passwd", "api_key", "apikey", "secret", "token")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_")
IBAN_CUES = ("IBAN", "iban")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMERIC_LEFT = " ().+-0123456789"
_NUMERIC_RUN = re.compile(r"[\x20().+0-9-]*+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:-]++@[A-Za-z0-9.-]++(?::[0-9]++)?(?:[/?#][^\s\"'<>]*+)?")
_SCHEME_LEFT = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+"
_IBAN = re.compile(r"[\s:#]*+([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[\s:#=.-]*+(?:(?:no|number|num|nr)\b[\s:#=.]*+)?+([0-9](?:-?[0-9]){4,19}+)(?![0-9])", re.I)
_SECRET = re.compile(r"\s?[:=]\s?[\"']?([A-Za-z0-9_\-+/=.]{8,}+)")
_KEY = re.compile(r"[A-Za-z0-9]{16,}+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789+":
        a.add_word(d, ("numeric", 1))
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for kind, words in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("iban", IBAN_CUES), ("key", KEY_PREFIXES)):
        for w in words:
            for form in dict.fromkeys((w, w.capitalize(), w.upper()) if kind not in ("key", "iban") else (w,)):
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def find(text: str, automaton) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind) in code points, by start, then kind in the order of ``KINDS``."""
    out: list[tuple[int, int, str]] = []
    numeric_end = email_end = last_at = added_end = 0
    for at, (kind, width) in automaton.iter(text):
        if kind == "numeric":
            if at < numeric_end:
                continue
            left = at
            while left > numeric_end and text[left - 1] in _NUMERIC_LEFT:
                left -= 1
            numeric_end = _NUMERIC_RUN.match(text, at).end()
            _numeric(text, left, numeric_end, out)
        elif kind == "at":
            low = max(email_end, last_at)
            last_at = at + 1
            start = low + len(text[low:at].rstrip(_LOCAL))
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append((start, email_end, "email"))
        else:
            end = at + 1
            if end - width < added_end:
                continue
            if kind == "scheme":
                left = end - 3
                while left > 0 and end - left < 20 and text[left - 1] in _SCHEME_LEFT:
                    left -= 1
                if left < end - 3 and (m := _USERINFO.match(text, end)):
                    out.append((left, m.end(), "url"))
                    added_end = m.end()
            elif kind == "iban":
                if (m := _IBAN.match(text, end)) and _iban_ok(m[1]):
                    out.append((*m.span(1), "iban"))
                    added_end = m.end()
            elif kind == "account":
                if m := _ACCOUNT.match(text, end):
                    out.append((*m.span(1), "account"))
                    added_end = m.end()
            elif kind == "secret":
                if m := _SECRET.match(text, end):
                    out.append((*m.span(1), "secret"))
                    added_end = m.end()
            elif (end == width or not text[end - width - 1].isalnum()) and (m := _KEY.match(text, end)):
                out.append((end - width, m.end(), "secret"))
                added_end = m.end()
    if len(out) > 1:
        out.sort(key=lambda s: (s[0], _RANK[s[2]], s[1]))
    return out


def _numeric(text: str, left: int, right: int, out: list) -> None:
    """Addresses, cards and phones in a maximal run of the characters that they can hold."""
    if right - left < 7:
        return
    for m in _IP.finditer(text, left, right):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text, left, right):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text[left:right]:
        for m in _PHONE.finditer(text, left, right):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))


def digest_columns(text: str | None, automaton) -> tuple:
    spans = find(text, automaton) if text else []
    n = dict.fromkeys(KINDS, 0)
    for s in spans:
        n[s[2]] += 1
    base = ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in BASE_KINDS)
    return (*(n[k] for k in BASE_KINDS), len(spans), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every row: its id, counts of the base kinds and of all kinds, the digest of base spans and all spans."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        automaton = anchors()
        for b in batches:
            rows = [digest_columns(t.as_py(), automaton) for t in b.column(1)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.string()) for c in cols[5:])],
                names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "n_spans", "base_sha256", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by ``[KIND]``; overlapping spans are replaced as one, under the first kind."""
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < b:
            k += 1
            b = max(b, spans[k][1])
        out += [text[at:a], f"[{kind.upper()}]"]
        at, k = b, k + 1
    return "".join(out) + text[at:]
