"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash (hash and displace) resolves whole pre-tokens that are in the vocabulary.
Tier two: other pre-tokens merge on linked bytes, the next merge always taken from a heap of (rank, place).
Both need no trained state besides the rank file, whose path is a parameter; the file is read on the driver
and its tables (as large as the vocabulary, whatever the corpus) go to the workers as a broadcast.

Texts are cut into pieces before a space that is followed by a non-space; no pre-token crosses such a
place, so a piece encodes alike wherever it stands and a bounded per-worker cache can answer repeats.

Defined results: a null text counts as empty; an empty text has no ids; no special tokens are known, so
their strings are ordinary text; repeated rows each give a row; a text is read whole however long it is; an
empty table gives an empty table; other columns are kept, whatever their names, and an output column replaces
an input column of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from .common import arrow_map, beside, texts

M64 = (1 << 64) - 1


def mix(h: int, d: int) -> int:
    h = (h ^ (d * 0x9E3779B97F4A7C15)) & M64
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & M64
    return h ^ (h >> 29)


class MinimalPerfectHash:
    """n distinct byte strings to 0..n-1 without gaps, one displacement per bucket of about two keys."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.shift = array("l", [0]) * self.buckets
        self.keys: list[bytes] = [b""] * n
        taken, slot_of = bytearray(n), [0] * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        single = next((i for i, b in enumerate(order) if len(groups[b]) < 2), len(order))
        for b in order[:single]:
            d = 0
            while True:
                slots = {mix(hashes[i], d) % n for i in groups[b]}
                if len(slots) == len(groups[b]) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i in groups[b]:
                slot_of[i] = s = mix(hashes[i], d) % n
                taken[s] = 1
        free = (s for s in range(n) if not taken[s])
        for b in order[single:]:
            for i in groups[b]:  # one key: its slot is stored itself, as a negative number
                slot_of[i] = s = next(free)
                self.shift[b] = -s - 1
        for i, s in enumerate(slot_of):
            self.keys[s] = keys[i]
        self.slot_of = slot_of

    def find(self, key: bytes) -> int:
        """The slot of a key, -1 if it is not one."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = mix(h, d) % self.n if d >= 0 else -d - 1
        return s if self.keys[s] == key else -1


class ByteBPE:
    """Encoder and decoder over a rank table."""

    #: Pieces in each of the two generations that a worker remembers; about 200 bytes each.
    CACHE = 400_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.table = MinimalPerfectHash(list(ranks))
        self.slot_rank = array("l", [0]) * len(ranks)
        for s, r in zip(self.table.slot_of, ranks.values(), strict=True):
            self.slot_rank[s] = r
        self.table.slot_of = []
        self.words = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            self.words[r] = k
        self._ready()

    def _ready(self) -> None:
        self.find_all, self.gap = regex.compile(self.pattern).findall, re.compile(r" \s").search
        self.decimal = [str(i) for i in range(len(self.words))]
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("ranks", "pattern", "table", "slot_rank", "words")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, token: bytes) -> list[int]:
        """Tier two. ``after[i]`` is where the part that starts at i ends, 0 once it is part of another. The heap
        holds (rank, start, end of the pair) as one integer, so the lowest rank goes first, the leftmost of equals."""
        rank, n = self.ranks.get, len(token)
        bits = n.bit_length()
        wide, low = 2 * bits, (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << wide | i << bits | i + 2 for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, end = x >> bits & low, x & low
            mid = after[i]
            if not mid or mid >= n or after[mid] != end:
                continue  # one of the two parts has been merged meanwhile
            after[mid] = 0
            after[i] = end
            if end < n:
                before[end] = i
                far = after[end]
                if (r := rank(token[i:far])) is not None:
                    heappush(heap, r << wide | i << bits | far)
            p = before[i]
            if p >= 0 and (r := rank(token[p:end])) is not None:
                heappush(heap, r << wide | p << bits | end)
        ranks = self.ranks
        return [ranks[token[i:e]] for i, e in enumerate(after) if e]

    def token(self, text: str) -> bytes:
        """The ids of one pre-token, as the bytes of their array."""
        if (raw := self.tokens.get(text)) is None:
            utf8 = text.encode()
            s = self.table.find(utf8)
            raw = array("I", [self.slot_rank[s]] if s >= 0 else self.merge(utf8)).tobytes()
            if len(self.tokens) >= self.CACHE // 2:
                self.tokens.clear()
            if len(text) <= 64:
                self.tokens[text] = raw
        return raw

    def _encode_piece(self, piece: str) -> bytes:
        raw = self.older.get(piece)
        if raw is None:
            raw = b"".join(map(self.token, self.find_all(piece)))
        if len(piece) <= 64:
            if len(self.pieces) >= self.CACHE:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = raw
        return raw

    def encode(self, text: str) -> array:
        """Ids of a text."""
        out = array("I")
        if not text:
            return out
        if self.gap(text):  # runs of white space that hold a space before their end
            cut = regex.split(r"(?= \S)", text, flags=regex.V1)
        else:
            cut = text.replace(" ", "\0 ").split("\0") if "\0" not in text else regex.split(r"(?= )", text, flags=regex.V1)
        one = self._encode_piece
        out.frombytes(b"".join([r if (r := self.pieces.get(x)) is not None else one(x) for x in cut]))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


#: What the encoder can put beside a document: type and value from (coder, ids, decoded bytes).
OUTPUTS = {
    "ids": (ArrayType(IntegerType()), pa.list_(pa.int32()), lambda c, ids, raw: ids.tolist()),
    "n_tokens": (LongType(), pa.int64(), lambda c, ids, raw: len(ids)),
    "ids_sha256": (StringType(), pa.string(), lambda c, ids, raw: hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest()),
    "decoded": (BinaryType(), pa.binary(), lambda c, ids, raw: raw),
    "decoded_sha256": (StringType(), pa.string(), lambda c, ids, raw: hashlib.sha256(raw).hexdigest()),
}


def encode(docs: DataFrame, coder: ByteBPE, text: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the ``outputs`` of its texts, in one pass without a shuffle."""
    source, keep, schema = beside(docs, text, keep, [StructField(o, OUTPUTS[o][0]) for o in outputs])
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    wanted = [OUTPUTS[o] for o in outputs]
    decoded = any(o.startswith("decoded") for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            rows = []
            for t in texts(b.column(b.num_columns - 1)):
                ids = c.encode(t)
                raw = c.decode(ids) if decoded else b""
                rows.append([f(c, ids, raw) for _, _, f in wanted])
            made = [pa.array(x, kind) for x, (_, kind, _) in zip(zip(*rows, strict=True) if rows else [[]] * len(wanted), wanted, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=[*keep, *outputs])

    return arrow_map(source, run, schema)
