"""Secrets, confirmed by structure.

Base kinds are grammars with a length test: assign (a naming word, then a
value), access (an access key id) and hex (a run of hexadecimal digits). Their
spans are leftmost and non-overlapping within a kind; a match that fails its
test is dropped and not retried.

Candidates are then decoded. Runs of base64 (either alphabet) or hex (either
case), alone, wrapped over lines, in an assigned value or between armour lines,
are reported as a further kind only if what they decode to parses: der (an ASN.1
SEQUENCE whose nested lengths fill the value exactly and which opens with an
INTEGER or a SEQUENCE), ssh (length-prefixed fields with a key type, or an
OpenSSH private key's magic), jwt (a signed token: header and payload are JSON
objects and the header names an algorithm), pem (armour lines around a der or ssh
body, or headers that declare it encrypted and whole cipher blocks). Line ends
may be escaped, as in JSON. What decodes to printable text is looked into again,
up to ``DEPTH`` times, so keys that were encoded twice are found; their span is
that of the outermost run. Bodies and nesting may be of any length. Confirmed
spans that hold public keys or certificates are counted in ``n_public``:
well-formed, but no secret.

Null and empty texts hold nothing; very long ones are read whole. Every decoding
is of one run or block of runs, which do not overlap, and spans that are covered
are found by bisection, so time grows with length, but for sorting. A run that
starts inside a confirmed block is not reported again. Ties in start are ordered
by kind as listed. Repeated rows give repeated results. Offsets are code points,
end exclusive. An empty table gives no rows. Further columns, whatever their
names, are left out.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import over_batches, table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "jwt", "ssh", "der")

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_assign_at = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").match
#: Shorter runs fail the length test whole, and no part of a run is retried: the test can be part of the pattern.
_access = re.compile(r"AKIA[A-Z0-9]{14,}").finditer
_hex = re.compile(r"[0-9a-f]{16,}").finditer
#: A header opens with blanks, if any, and a brace: base64 of tab, line feed, return, space or brace starts so.
_jwt = re.compile(r"(?<![A-Za-z0-9_-])((?:[CDI]|e[w-z])[A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)").finditer
#: Armour ends at the next dashes, whatever they are: a text is read once, however many openings it has.
_pem = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}(?:KEY|CERTIFICATE))-----((?:(?!-----).){16,})-----END \1-----", re.S).finditer
_line_ends = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\t\x20]*").split
_header = re.compile(r"([A-Za-z][A-Za-z0-9-]*):\s*(.*)").fullmatch
_cipher = re.compile(r"([A-Z0-9-]+),([0-9A-Fa-f]{16,64})").fullmatch
#: The same openings in hex of either case.
_any_line_end = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\t\x20]*").finditer
_any_hex = re.compile(r"(?<![0-9A-Za-z])(?:30|000000|6[Ff]70656[Ee])[0-9A-Fa-f]{18,}(?![0-9A-Za-z])").finditer
#: DER opens with 30 8x or 30 and a short length, OpenSSH's formats with 00 00 00 or their magic.
#: Encoded once more they open with T and U or V, QUFB and YjNC, armour with LS0t.
_OPENS = "M[A-P]|AAAA|b3BlbnNzaC1rZXkt|T[UV]|QUFB|YjNC|LS0tLS1CRUdJTi"
_base64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:{_OPENS})[A-Za-z0-9+/_-]{{14,}}={{0,2}}").finditer
#: Lines of base64 after one another, line ends plain or escaped, indented or not; the first opens as a run does.
_wrapped = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:{_OPENS})[A-Za-z0-9+/_-]{{14,}}={{0,2}}(?:(?:\r?\n|\\r\\n|\\n)[\t\x20]*[A-Za-z0-9+/_-]+={{0,2}}(?![A-Za-z0-9+/_=-]))+").finditer

_all_hex = re.compile("[0-9a-fA-F]+").fullmatch

#: How often what was decoded is looked into again.
DEPTH = 3
#: Sizes in bytes of the blocks that ciphers of encrypted armour work on, by name.
_BLOCKS = {"DES-": 8, "AES-": 16, "CAMELLIA-": 16}

_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-")


def unbase64(text: str) -> bytes | None:
    """The bytes of either base64 alphabet, with or without padding."""
    raw = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end of the value) of the ASN.1 element at ``at``; None if it does not fit before ``end``."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + length) if at + length <= end else None


def nested(data: bytes, at: int, end: int) -> bool:
    """Whether the elements from ``at`` on fill the space up to ``end`` exactly, constructed ones likewise inside."""
    ends = [end]
    while ends:
        if at == ends[-1]:
            ends.pop()
            continue
        if (element := tlv(data, at, ends[-1])) is None:
            return False
        tag, start, stop = element
        if tag & 0x20:
            ends.append(stop)
            at = start
        else:
            at = stop
    return True


def is_der(data: bytes) -> bool:
    top = tlv(data, 0, len(data)) if len(data) >= 12 and data[0] == 0x30 else None
    return top is not None and top[2] == len(data) and data[top[1]] in (0x02, 0x30) and nested(data, top[1], top[2])


def is_ssh(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if n > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and fields[0].startswith(_SSH_TYPES)


def is_jwt(header: str, payload: str) -> bool:
    try:
        head, body = (json.loads(unbase64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def decoded(candidate: str) -> Iterator[bytes]:
    """What a candidate says in base64, and in hex."""
    if data := unbase64(candidate):
        yield data
    if len(candidate) % 2 == 0 and _all_hex(candidate):
        yield bytes.fromhex(candidate)


def parsed(data: bytes, depth: int = DEPTH) -> tuple[str, bool] | None:
    """(kind, whether it is public) of the key that bytes are or, decoded again, hold."""
    if is_der(data):
        return "der", public_der(data)
    if is_ssh(data):
        return "ssh", not data.startswith(b"openssh-key-v1\0")
    if depth and data.isascii():
        inner = data.decode().strip()
        for m in _pem(inner):
            if found := armoured(m[2]):
                return "pem", found[1]
        if " " not in inner:
            return encoding("".join(_line_ends(inner)), depth - 1)
    return None


def encoding(candidate: str, depth: int = DEPTH) -> tuple[str, bool] | None:
    """The key encoding that a base64 or hex candidate decodes to, and whether it is public."""
    return next((found for data in decoded(candidate) if (found := parsed(data, depth))), None)


def armoured(body: str) -> tuple[str, bool] | None:
    """What stands between armour lines: headers, if any, then a key encoding, or cipher blocks as the headers declare."""
    lines = [line.strip() for line in _line_ends(body)]
    headers = {}
    while lines and (not lines[0] or _header(lines[0])):
        if m := _header(lines.pop(0) or "-"):
            headers[m[1]] = m[2].strip()
    text = "".join("".join(lines).split())
    if headers.get("Proc-Type", "").replace(" ", "") == "4,ENCRYPTED":
        cipher, data = _cipher(headers.get("DEK-Info", "").replace(" ", "")), unbase64(text)
        size = next((n for name, n in _BLOCKS.items() if cipher and cipher[1].startswith(name)), 0)
        return ("pem", False) if size and data and len(data) % size == 0 and len(cipher[2]) == 2 * size else None
    return encoding(text, 0)


def public_der(data: bytes) -> bool:
    """Whether DER holds no secret: it opens with a number that is no version, or with a SEQUENCE and holds a BIT STRING beside it."""
    _, at, end = tlv(data, 0, len(data))
    elements = []
    while at < end and len(elements) < 3:
        elements.append(tlv(data, at, end))
        at = elements[-1][2]
    tag, start, stop = elements[0]
    if tag == 0x02:
        return not (stop - start == 1 and data[start] < 4)
    return any(e[0] == 0x03 for e in elements[1:])


def declared(block: str) -> int | None:
    """How many base64 characters the DER that a block opens with takes, by its own length; None if it opens with something else."""
    head = unbase64(block[:8]) or b""
    if len(head) < 6 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return None
    size = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    return -(-size * 4 // 3)


def unwrapped(m: re.Match) -> tuple[str, bool, int] | None:
    """(kind, public, end) of a key whose base64 goes on over lines; a DER key ends at the line end where its length says, any other with the last line."""
    text = m[0]
    cuts = [x.span() for x in _any_line_end(text)]
    joined_, places = [], []  # characters, and where each line of them starts
    at = n = 0
    for a, b in [*cuts, (len(text), len(text))]:
        places.append((n, at))
        joined_.append(text[at:a])
        n += a - at
        at = b
    whole = "".join(joined_)
    if (size := declared(whole)) is not None:
        size += len(whole[size : size + 2]) - len(whole[size : size + 2].lstrip("="))
        if size not in {len(whole), *(s for s, _ in places)} or not (found := encoding(whole[:size], 0)):
            return None
        start, place = next((s, p) for s, p in reversed(places) if s < size)
        return *found, m.start() + place + size - start
    found = encoding(whole)
    return (*found, m.end()) if found else None


def _assign(text: str) -> Iterator[re.Match]:
    """The assign grammar's leftmost non-overlapping matches, tried only where a naming word stands."""
    low, starts = text.encode("ascii", "replace").lower(), []
    for name in NAMES:
        at = low.find(name.encode())
        while at >= 0:
            starts.append(at)
            at = low.find(name.encode(), at + 1)
    past = 0
    for at in sorted(starts):
        if at >= past and (m := _assign_at(text, at)):
            past = m.end()
            yield m


def within(spans: list[tuple[int, int]]) -> Callable[[int], bool]:
    """A test for places inside any of the spans, by bisection."""
    starts, ends, last = [], [], 0
    for a, b in sorted(spans):
        last = max(last, b)
        starts.append(a)
        ends.append(last)

    def inside(at: int) -> bool:
        k = bisect_right(starts, at) - 1
        return k >= 0 and at < ends[k]

    return inside


def found(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, public) of all secrets, in no order; some may come twice."""
    candidates = set()
    for m in _access(text):
        yield "access", *m.span(), False
    for m in _assign(text):
        if len(m[1]) >= 12:
            yield "assign", *m.span(), False
            candidates.add(m.span(1))
    for m in _hex(text):
        yield "hex", *m.span(), False
        candidates.add(m.span())
    candidates |= {m.span() for scan_for in (_base64, _any_hex) for m in scan_for(text)}
    covered = []
    for m in _pem(text):
        if inner := armoured(m[2]):
            yield "pem", *m.span(), inner[1]
            covered.append(m.span())
    for m in _jwt(text):
        if is_jwt(m[1], m[2]):
            yield "jwt", *m.span(), False
            covered.append(m.span())
    inside, wrapped = within(covered), []
    for m in _wrapped(text):
        if not inside(m.start()) and (got := unwrapped(m)):
            kind, public, end = got
            yield kind, m.start(), end, public
            wrapped.append((m.start(), end))
    inside = within(covered + wrapped)
    for a, b in candidates:
        if not inside(a) and (got := encoding(text[a:b])):
            yield got[0], a, b, got[1]


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in ``text``, by start, then kind as listed."""
    return [s[:3] for s in ordered(text)]


def ordered(text: str) -> list[tuple[str, int, int, bool]]:
    """As ``find``, with whether each holds no secret."""
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found(text)), key=lambda s: (s[1], order[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: counts of the base kinds, digest of the base spans, all spans, numbers confirmed by structure and of them public."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digest, every, confirmed, public = [[] for _ in BASE], [], [], [], []
        for value in batch.column(text):
            own = value.as_py() or ""
            rated = ordered(own)
            spans = [s[:3] for s in rated]
            base = [s for s in spans if s[0] in BASE]
            for column, kind in zip(counts, BASE, strict=True):
                column.append(sum(s[0] == kind for s in base))
            digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(spans))
            confirmed.append(len(spans) - len(base))
            public.append(sum(s[3] for s in rated))
        columns = [batch.column(key), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(every), pa.array(confirmed, pa.int64()), pa.array(public, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [key, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_confirmed", "n_public"])

    kind = dict(docs.dtypes)[key]
    return over_batches(docs.select(key, text), kernel, f"`{key}` {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_confirmed long, n_public long")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    return scan(table(spark, sf_dir, "documents"))
