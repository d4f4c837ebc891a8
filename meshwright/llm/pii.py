"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits that
open a number, and cue words of identifiers. From each anchor a local parser
expands to the boundaries of its kind and validates what it finds. Parsers of
one kind go left to right and never enter what that kind has consumed, so their
spans are the leftmost non-overlapping matches of the kind's grammar.

Base kinds: email, ip, card, phone. Added kinds: url (an anchor scheme with a
host), iban (mod-97 confirmed), ssn and account (a cue word, then the number),
street (a house number, capitalised words and a street word).

Null and empty texts hold nothing; very long ones are read whole. Ties in start
are ordered by kind as listed. Repeated rows give repeated results. Offsets are
code points, end exclusive. An empty table gives no rows. ``scan`` leaves further
columns out, whatever their names; ``redact`` keeps all columns as they are but
for the text and its length.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import over_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account", "street")

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_digits = frozenset("0123456789")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").match
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_url = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?").match
_iban = re.compile(r"[:#\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})").match
_ssn = re.compile(r"[:#\x20]{0,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])").match
_account = re.compile(r"(?:\x20(?:no|nr|number))?[.:#\x20]{1,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])").match
_street = re.compile(r"([0-9]{1,5}(?:\x20[A-Z][a-z]+){1,3}\x20)$").search

SCHEMES = ("http://", "https://", "ftp://")
CUES = {"IBAN": "iban", "SSN": "ssn", "Social Security": "ssn", "account": "account", "Account": "account", "acct": "account", "Konto": "account", "cuenta": "account", "compte": "account"}
STREETS = ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive")


def anchors() -> ahocorasick.Automaton:
    """The automaton; each pattern's value is (kind of anchor, length)."""
    out: dict[str, list[str]] = {"@": ["email"]}
    for a in "0123456789":
        out.setdefault(f"+{a}", []).append("phone")
        for b in "0123456789":
            out.setdefault(f"{a}.{b}", []).append("ip")
            for gap in ("", " ", "-"):
                out.setdefault(f"{a}{gap}{b}", []).append("card")
    for s in SCHEMES:
        out.setdefault(s, []).append("url")
    for cue, kind in CUES.items():
        out.setdefault(cue, []).append(kind)
    for s in STREETS:
        out.setdefault(f" {s}", []).append("street")
    found = ahocorasick.Automaton()
    for pattern, kinds in out.items():
        found.add_word(pattern, (kinds[0], len(pattern)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """One automaton per worker process."""
    return anchors()


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data in ``text``, by start, then kind as listed."""
    spans: list[tuple[str, int, int]] = []
    past = dict.fromkeys(KINDS, 0)  # where each kind's last match ended, kept or not
    for last, (kind, length) in automaton().iter(text):
        start, end = last + 1 - length, last + 1
        if kind == "card":
            if start < past["card"]:
                continue
            m = _card(text, start)
            past["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", start, m.end()))
        elif kind == "email":
            at, first = start, start
            while first > past["email"] and text[first - 1] in _local:
                first -= 1
            if first < at and (m := _domain(text, at + 1)):
                past["email"] = m.end()
                spans.append(("email", first, m.end()))
        elif kind == "ip":
            dot = first = start + 1
            while first > past["ip"] and text[first - 1] in _digits:
                first -= 1
            if first < dot and (m := _ip(text, first)):
                past["ip"] = m.end()
                if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.groups()):
                    spans.append(("ip", first, m.end()))
        elif kind == "phone":
            if start >= past["phone"] and (m := _phone(text, start)):
                past["phone"] = m.end()
                if 9 <= sum(c in _digits for c in m[0]) <= 15:
                    spans.append(("phone", start, m.end()))
        elif kind == "url":
            if start >= past["url"] and (m := _url(text, end)) and "." in m[0]:
                stop = m.start() + len(m[0].rstrip(".,;:!?)"))
                past["url"] = m.end()
                spans.append(("url", start, stop))
        elif kind == "street":
            if (m := _street(text, max(past["street"], start - 60), start + 1)) and not text[end : end + 1].isalpha():
                past["street"] = end
                spans.append(("street", m.start(), end))
        else:
            m = {"iban": _iban, "ssn": _ssn, "account": _account}[kind](text, end)
            if m and m.start(1) >= past[kind]:
                stop = m.end(1)
                if kind == "iban" and (stop := iban_end(text, m.start(1), stop)) == 0:
                    continue
                past[kind] = stop
                spans.append((kind, m.start(1), stop))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def iban_end(text: str, start: int, end: int) -> int:
    """The end of the longest prefix that is an IBAN by its check digits; 0: none is."""
    while end - start >= 15:
        own = text[start:end]
        if own[-1] != " " and mod97(own.replace(" ", "")):
            return end
        end -= 1
    return 0


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: counts of the base kinds, digest of the base spans, all spans and their number."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digest, every, total = [[] for _ in BASE], [], [], []
        for value in batch.column(text):
            spans = find(value.as_py() or "")
            base = [s for s in spans if s[0] in BASE]
            for column, kind in zip(counts, BASE, strict=True):
                column.append(sum(s[0] == kind for s in base))
            digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(spans))
            total.append(len(spans))
        columns = [batch.column(key), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(every), pa.array(total, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [key, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    kind = dict(docs.dtypes)[key]
    return over_batches(docs.select(key, text), kernel, f"`{key}` {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``chars``, if it is a column, counts the new text. Null stays null."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [None if x is None else redacted(x, find(x)) for x in batch.column(text).to_pylist()]
        swap = {text: pa.array(new, pa.string())}
        if chars in batch.schema.names:
            swap[chars] = pa.array([None if x is None else len(x) for x in new], pa.int64()).cast(batch.schema.field(chars).type)
        names = batch.schema.names
        return pa.RecordBatch.from_arrays([swap.get(n, batch.column(n)) for n in names], names)

    return over_batches(docs, kernel, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    return scan(table(spark, sf_dir, "documents"))
