"""Byte-level BPE through the tokenizers library, over Arrow batches.

A Latin text is cut into the pre-tokenising pattern's matches, which are encoded
apart; ids of frequent ones are kept in a bounded cache. Any other text is cut
before every single space that a non-blank follows, which no match spans, and
its Latin pieces likewise. Ids travel as little-endian unsigned bytes, four each,
or two where that is asked for.

Null and empty texts give no ids. Very long texts and pieces are encoded whole.
Repeated rows give repeated results. An empty table gives no rows. ``encode``
and ``decode`` append to all columns; a column that has one of the new names is
replaced. The query leaves further columns out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .common import over_batches, table, texts

#: Cached pieces per worker and generation (there are two), and the longest that is kept.
CACHE_PIECES, CACHE_CHARS = 250_000, 48
MULTI = "byte_bpe_multi_50k.tiktoken"

#: Up to U+024F all Unicode versions agree on what letters and numbers are.
_latin = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]+").fullmatch
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
#: The pre-tokenising pattern with these spelled out.
_tokens = re.compile(public_tokenizers.PATTERN.replace(r"?\p{L}+", f"?[{LETTERS}]+").replace(r"?\p{N}+", f"?[{NUMBERS}]+").replace(r"\p{L}\p{N}", LETTERS + NUMBERS)).findall
_cut = re.compile(r" (?=\S)").split
_word = re.compile(f" ?[{LETTERS}]+").fullmatch


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def splits_by_rank(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens that join to a token, by the joined token's rank.

    A rank file merges the neighbours whose joined rank is lowest, whatever they
    are, so all pairs are listed and not just one for each token.
    """
    pairs = []
    for token in sorted(ranks, key=ranks.__getitem__):
        pairs += [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    return pairs


def tokenizer_from_ranks(path: str, pattern: str = public_tokenizers.PATTERN) -> str:
    """The tokenizers library's JSON for a rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    to_char = byte_table()
    show = lambda token: "".join(map(to_char.__getitem__, token))
    vocab = {show(token): rank for token, rank in ranks.items()}
    merges = [(show(a), show(b)) for a, b in splits_by_rank(ranks)]
    out = Tokenizer(models.BPE(vocab, merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out.to_str()


class Encoder(dict):
    """Ids of texts as bytes; the dictionary holds parts that are encoded apart."""

    def __init__(self, spec: str, width: int = 4) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.kind = f"<u{width}"
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.to_char = str.maketrans({chr(b): c for b, c in byte_table().items()})
        from_char = {c: b for b, c in byte_table().items()}
        size = self.tokenizer.get_vocab_size()
        self.id_bytes = [i.to_bytes(width, "little") for i in range(size)]
        names = map(self.tokenizer.id_to_token, range(size))
        self.token_bytes = [bytes(from_char.get(c, 63) for c in name or "") for name in names]
        self.token_length = np.array([len(b) for b in self.token_bytes], np.int64)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of letters, perhaps after a space, straight from the merges."""
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.to_char))])

    def __missing__(self, part: str) -> bytes:
        if len(part) > CACHE_CHARS:
            return self.whole(part)
        if (ids := self.older.get(part)) is None:
            ids = self.word(part) if _word(part) else self.whole(part)
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _latin(text):
            return b"".join(map(self.__getitem__, _tokens(text)))
        first, *rest = _cut(text)
        out = []
        for part in [first, *(" " + piece for piece in rest)]:
            if _latin(part):
                out += map(self.__getitem__, _tokens(part))
            elif part:
                out.append(self[part])
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids, joined before anything is read as characters: a character may be split over tokens."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, self.kind).tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each id; tokens that split a character all name that character."""
        ends = np.cumsum(self.token_length[np.frombuffer(ids, self.kind)])
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64)
        return char_of[starts] if len(ends) else starts, (char_of[ends - 1] + 1 if len(ends) else ends)


@lru_cache(maxsize=2)
def encoder(spec: str, width: int = 4) -> Encoder:
    """One encoder per worker process, vocabulary and width of ids."""
    return Encoder(spec, width)


def encoded(enc: Encoder, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's ids, and each one's first and end character."""
    ids = enc.encode(text)
    return ids, *enc.offsets(text, ids)


def appended(rows: DataFrame, kinds: dict[str, str], kernel: Callable[[pa.RecordBatch], list[pa.Array]], without: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` less ``without``, with the columns ``kinds`` that ``kernel`` makes of each batch, in place of any of their names."""
    kept = [c for c in rows.columns if c not in kinds and c not in without]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes if n in kept), *(f"{n} {t}" for n, t in kinds.items())])
    return over_batches(rows, lambda batch: pa.RecordBatch.from_arrays([*map(batch.column, kept), *kernel(batch)], [*kept, *kinds]), schema)


def encode(docs: DataFrame, spec: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``starts`` and ``ends`` (characters); null text: empty arrays."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        enc = encoder(spec)
        found = [encoded(enc, x) for x in texts(batch, text)]
        lists = [[np.frombuffer(i, "<u4").astype(np.int32) for i, _, _ in found], *([f[k].astype(np.int32) for f in found] for k in (1, 2))]
        return [pa.array(x, pa.list_(pa.int32())) for x in lists]

    return appended(docs, dict.fromkeys(("ids", "starts", "ends"), "array<int>"), kernel)


def decode(rows: DataFrame, spec: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` (string); bytes that are no character become U+FFFD. Null ids: empty."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        enc = encoder(spec)
        out = [enc.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
        return [pa.array(out, pa.string())]

    return appended(rows, {"decoded": "string"}, kernel)


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """Per row: number of ids, digests of the ids, of the bytes they decode to, and of their offsets (each one's start and end as four bytes)."""
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "offsets_sha256": "string"}
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        enc, rows = encoder(spec), []
        for x in batch.column("text"):
            ids, starts, ends = encoded(enc, x.as_py() or "")
            rows.append((len(ids) // 4, sha(ids), sha(enc.decode(ids)), sha(np.stack([starts, ends], 1).astype("<u4").tobytes())))
        return [pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]

    return appended(docs.select("doc_id", "text"), kinds, kernel, without=("text",))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document by the multilingual rank file, and decode the ids again."""
    return digests(table(spark, sf_dir, "documents"), tokenizer_from_ranks(public_tokenizers.path(MULTI)))
