"""Token ids in binary shards: a wavelet matrix per shard.

A shard file holds, for documents in ascending id order, the ids of all their tokens as a wavelet matrix: one
bit-plane per id bit from the highest, each plane's sequence being the former one stably parted by the
former bit, with counts of ones before every 64 bytes of a plane. Token access, counting of an id before a
place, and finding an id's k-th occurrence take one rank or select per plane, without unpacking the rest.
The file is compressed as a whole and says which documents it holds and where each ends.

Texts are encoded where they are read and only their token ids are shuffled. Shards are made on range
partitions of the ids of documents: each task reads its documents in order and closes a shard when it holds
``shard_tokens``, so memory is bounded by a shard whatever the partition. The files travel as a binary column
and are written and reread as a table by Spark, so any file system will do.

Defined results: a null text counts as empty and has the end id alone; documents with null ids come last;
documents of equal id, repeated rows too, stand in the order in which they are read, and any number of them is
dealt over several ranges; a very long document is read whole and makes a shard that is longer than others; an
empty table has no shards; columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subsieve.runtime import cut

from .common import arrow_map, blobs, n_bytes

MAGIC = b"SBWM0001"
STEP = 64
#: Most shards whose offsets are broadcast (24 bytes each); beyond it they are joined by a shuffle.
BROADCAST_SHARDS = 100_000


class WaveletMatrix:
    """An id sequence as bit-planes. ``planes[k]`` holds bit ``bits - 1 - k`` of every id, packed from the lowest bit."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks
        self.bits = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"an id needs more than {bits} bits")
        kind = np.uint16 if bits <= 16 else np.uint32
        seq = np.ascontiguousarray(ids, kind)
        planes, zeros, ranks = [], [], []
        for k in range(bits - 1, -1, -1):
            one = (seq & kind(1 << k)).astype(bool)
            plane = np.packbits(one, bitorder="little")
            planes.append(plane)
            ranks.append(cls.directory(plane))
            zeros.append(len(seq) - int(one.sum()))
            seq = np.concatenate([np.compress(~one, seq), np.compress(one, seq)])
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of ``STEP`` bytes, and in all."""
        ones = np.bitwise_count(plane)
        return np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(plane), STEP), dtype=np.uint32))]).astype(np.uint32) if len(plane) else np.zeros(1, np.uint32)

    def bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def rank1(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        byte, block = i >> 3, (i >> 3) // STEP
        r = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][block * STEP : byte]).sum(dtype=np.int64))
        return r + ((int(self.planes[k][byte]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def select(self, k: int, one: int, nth: int) -> int:
        """Place of the nth (from 0) one, or zero, of plane k."""
        before = self.ranks[k].astype(np.int64)
        if not one:
            before = np.minimum(np.arange(len(before)) * STEP * 8, self.n) - before
        block = int(np.searchsorted(before, nth, "right")) - 1
        bits = np.unpackbits(self.planes[k][block * STEP : (block + 1) * STEP], bitorder="little")
        return block * STEP * 8 + int(np.flatnonzero(bits == one)[nth - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.bits):
            one = self.bit(k, i)
            r = self.rank1(k, i)
            out = out << 1 | one
            i = self.zeros[k] + r if one else i - r
        return out

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id at places start..end-1."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            ra, rb = self.rank1(k, a), self.rank1(k, b)
            a, b = (self.zeros[k] + ra, self.zeros[k] + rb) if token >> (self.bits - 1 - k) & 1 else (a - ra, b - rb)
        return a, b

    def find(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of an id; -1 if there are fewer."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= nth < b - a:
            return -1
        i = a + nth
        for k in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - k) & 1
            i = self.select(k, one, i - self.zeros[k] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: from the last plane to the first, undo each parting."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            back = np.empty(self.n, kind)
            z = self.zeros[k]
            back[np.flatnonzero(~one)] = seq[:z]
            back[np.flatnonzero(one)] = seq[z:] | kind(1 << (self.bits - 1 - k))
            seq = back
        return seq


def dump(ids: np.ndarray, ends: np.ndarray, keys: list[int | None], bits: int) -> bytes:
    """A shard file: header, then one compressed body of document keys, their ends, planes and rank directories."""
    m = WaveletMatrix.build(ids, bits)
    null = np.packbits([k is None for k in keys], bitorder="little")
    body = [null.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), np.asarray(ends, "<i8").tobytes(), np.array(m.zeros, "<i8").tobytes()]
    body += [x.astype("<u4").tobytes() for x in m.ranks] + [p.tobytes() for p in m.planes]
    raw = b"".join(body)
    return MAGIC + struct.pack("<QQII", m.n, len(keys), bits, zlib.crc32(raw)) + zstandard.ZstdCompressor(level=1).compress(raw)


def load(file: bytes) -> tuple[WaveletMatrix, np.ndarray, list[int | None]]:
    """The matrix, where each document ends, and the documents' keys."""
    if file[:8] != MAGIC:
        raise ValueError("not a token shard")
    n, docs, bits, crc = struct.unpack_from("<QQII", file, 8)
    raw = zstandard.ZstdDecompressor().decompress(file[32:])
    if zlib.crc32(raw) != crc:
        raise ValueError("the shard fails its checksum")
    at = 0

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    null = np.unpackbits(take(-(-docs // 8), "u1"), count=docs, bitorder="little")
    keys = [None if z else k for z, k in zip(null.tolist(), take(docs, "<i8").tolist(), strict=True)]
    ends, zeros = take(docs, "<i8"), take(bits, "<i8").tolist()
    size = -(-n // 8)
    ranks = [take(-(-size // STEP) + 1, "<u4") for _ in range(bits)]
    planes = [take(size, "u1") for _ in range(bits)]
    return WaveletMatrix(n, planes, zeros, ranks), ends, keys


def byte_chars() -> list[str]:
    """The character that byte-level tokenizers write for each byte: itself if printable, else the next free one from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


#: What a definition must say, as fixed values, for texts to be encoded piece by piece: a lower-casing byte-level
#: tokenizer whose pattern matches no white space.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def by_words(definition: str) -> bool:
    """Whether a tokenizer may be given the pieces between white space one by one: its steps are those of
    ``BY_WORDS`` and its added tokens are matched as they stand, start with ``<|`` and hold no white space."""
    said = json.loads(definition)
    plain = all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and t["content"].startswith("<|") and len(t["content"].split()) == 1 for t in said["added_tokens"])
    return plain and said.get("truncation") is None and said["model"].get("dropout") is None and all(said[k] == v for k, v in BY_WORDS.items())


#: Bytes of text that are encoded at once, about.
AT_ONCE = 8 << 20


class WordEncoder:
    """Ids of texts by a tokenizer of the tokenizers library.

    If the definition allows it (``by_words``), many texts are cut at once, by array operations on their bytes:
    at ASCII white space, and words of ASCII and Latin-1 letters, digits and marks also as the tokenizer's
    pattern cuts them. Distinct pieces are encoded once each, a bounded cache keeping them between calls, and
    their ids are laid out. Words with other characters, an apostrophe or what may be a special token stay
    whole and go through the library's whole pipeline. Other definitions encode whole texts."""

    CACHE = 250_000
    #: Classes of bytes: white space, letters (of two bytes too), digits, other marks, and what keeps a word whole.
    SPACE, LETTER, DIGIT, MARK, WHOLE = range(5)

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.by_words = by_words(definition)
        self.model = self.tokenizer.model.tokenize
        self.chars = byte_chars()
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        kinds = np.full(256, self.WHOLE, np.uint8)
        kinds[33:127] = self.MARK
        for kind, chars in ((self.SPACE, b" \t\n\v\f\r"), (self.LETTER, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (self.DIGIT, b"0123456789"), (self.WHOLE, b"'<")):
            kinds[[*chars]] = kind
        self.kinds = kinds

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a word that was kept whole (it starts with a byte of no character) or of a part of a word."""
        if (raw := self.older.get(piece)) is None:
            if piece[0] == 255:
                ids = self.tokenizer.encode(piece[1:].decode(), add_special_tokens=False).ids
            else:
                ids = [t.id for t in self.model(piece.decode() if piece.isascii() else "".join(map(self.chars.__getitem__, piece)))]
            raw = array("I", ids).tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= self.CACHE:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = raw
        return raw

    def _cut(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces start, where bytes are of none, and all bytes lower-cased, with 255 for the space before a word that stays whole.

        ``joined`` starts and ends with a space."""
        kinds = self.kinds[joined]
        second = np.flatnonzero(joined == 0xC3) + 1  # Latin-1 letters have this first byte; of their marks two are signs
        second = second[(joined[second] != 0x97) & (joined[second] != 0xB7)]
        kinds[second] = kinds[second - 1] = self.LETTER
        low = joined.copy()
        capital = (joined >= 65) & (joined <= 90)
        low[capital] |= 32
        low[second[joined[second] < 0x9F]] |= 32
        space = kinds == self.SPACE
        start = kinds[1:] != kinds[:-1]
        start |= kinds[1:] == self.DIGIT
        start[space[1:]] = False
        start = np.append(False, start)
        gaps = np.flatnonzero(space)
        odd = np.unique(np.searchsorted(gaps, np.flatnonzero(kinds == self.WHOLE)))
        for a, z in zip(gaps[odd - 1].tolist(), gaps[odd].tolist(), strict=True):
            start[a] = True
            start[a + 1 : z] = False
            low[a], low[a + 1 : z] = 255, joined[a + 1 : z]
            space[a] = False
        return start, space, low

    def encode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts one after another, and where each text's ids end."""
        if not self.by_words:
            each = [self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids for raw in raws]
            return np.array([i for ids in each for i in ids], np.uint32), np.cumsum([len(ids) for ids in each], dtype=np.int64)
        runs = [self._run([raw]) if len(raw) <= AT_ONCE else self._long(raw) for raw in raws] if sum(map(len, raws)) > 2 * AT_ONCE else [self._run(raws)]
        ahead = np.cumsum([0, *(ends[-1] for _, ends in runs)][:-1] if runs else [], dtype=np.int64)
        return np.concatenate([ids for ids, _ in runs]), np.concatenate([ends + a for (_, ends), a in zip(runs, ahead, strict=True)])

    def _long(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A very long text, cut at spaces into pieces of about ``AT_ONCE`` bytes."""
        at, ids = 0, []
        while at < len(raw):
            end = raw.find(b" ", at + AT_ONCE)
            end = len(raw) if end < 0 else end
            ids.append(self._run([raw[at:end]])[0])
            at = end
        all_ = np.concatenate(ids)
        return all_, np.array([len(all_)])

    def _run(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = np.frombuffer(b" ".join([b"", *raws, b""]), np.uint8)
        start, space, low = self._cut(joined)
        starts = np.flatnonzero(start)
        dense = low[~space]
        offsets = np.append(np.flatnonzero(start[~space]), len(dense)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(dense)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        found = [r if (r := self.pieces.get(w)) is not None else self._piece(w) for w in pieces.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        size = sizes[which]
        upto = np.zeros(len(size) + 1, np.int64 if len(joined) >> 30 else np.int32)
        np.cumsum(size, out=upto[1:])
        first = np.cumsum(sizes, dtype=upto.dtype) - sizes
        place = np.repeat(first[which] - upto[:-1], size)
        place += np.arange(len(place), dtype=place.dtype)
        # a text's words lie after the space before it; a word that stays whole starts at that space
        text_ends = np.cumsum([len(raw) + 1 for raw in raws])
        return np.frombuffer(b"".join(found), "<u4")[place], upto[np.searchsorted(starts, text_ends)].astype(np.int64)


@lru_cache(1)
def encoder(definition: str) -> WordEncoder:
    """One encoder per worker process, whatever the number of its tasks."""
    return WordEncoder(definition)


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of texts of about ``AT_ONCE`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // AT_ONCE)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)], strict=True)


def encoded(docs: DataFrame, definition: str, bits: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, ids): a document's ids and the end id, little-endian in 2 bytes each, or in 4 where ``bits`` needs
    them; ``place`` tells rows apart."""
    kind = "<u2" if bits <= 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, place = encoder(shared.value), TaskContext.get().partitionId() << 40
        for b in batches:
            for a, z in slices(b.column(1)):
                ids, ends = coder.encode(blobs(b.column(1).slice(a, z - a)))
                if len(ids) and int(ids.max()) >> bits:
                    raise ValueError(f"an id needs more than {bits} bits")
                data = np.insert(ids.astype(kind), ends, end_id).tobytes()
                ends = (ends + np.arange(1, z - a + 1)) * int(kind[2])
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(np.arange(place, place + z - a)), held], names=["key", "place", "ids"])
                place += z - a

    return arrow_map(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")), run, "key bigint, place bigint, ids binary")


def write_shards(docs: DataFrame, definition: str, bits: int, end_id: int, key: str = "doc_id", text: str = "text", shard_tokens: int = 3_000_000, partition_bytes: int = 32 << 20) -> DataFrame:
    """(part, seq, n_tokens, n_docs, file): shard files of ``docs`` in ascending ``key`` order, as a table in the shared folder.

    Texts are encoded where they are read; one shuffle by range moves their ids. ``definition`` is the tokenizer's JSON text."""
    rows = cut(encoded(docs, definition, bits, end_id, key, text))
    kind = "<u2" if bits <= 16 else "<u4"
    size = rows.agg(F.sum(n_bytes("ids"))).first()[0] or 0
    # place is part of the order, so that many rows without an id, or with the same, are dealt over several ranges
    order = [F.col("key").asc_nulls_last(), F.col("place").asc()]
    dealt = rows.repartitionByRange(max(1, -(-size // partition_bytes)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ends, keys, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, held, ends, keys, size
            file = dump(np.frombuffer(b"".join(held), kind), np.array(ends), keys, bits)
            made = [pa.array([x], kind) for x, kind in ((part, pa.int32()), (seq, pa.int32()), (size, pa.int64()), (len(keys), pa.int64()), (file, pa.binary()))]
            seq, held, ends, keys, size = seq + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(made, names=["part", "seq", "n_tokens", "n_docs", "file"])

        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(ids)
                size += len(ids) // int(kind[2])
                ends.append(size)
                keys.append(k)
                if size >= shard_tokens:
                    yield shard()
        if keys:
            yield shard()

    return cut(arrow_map(dealt.select("key", "ids"), run, "part int, seq int, n_tokens bigint, n_docs bigint, file binary"))


def read_shards(shards: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document from the files; start counts all tokens before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, file in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                matrix, ends, keys = load(file)
                raw = matrix.decode().astype("<u4").tobytes()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                made = [pa.array([part] * len(keys), pa.int32()), pa.array([seq] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["part", "seq", "key", "at", "n_tokens", "ids_crc32"])

    found = arrow_map(shards.select("part", "seq", "file"), run, "part int, seq int, key bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    # two levels of running totals, so that no task adds up all shards
    sizes = shards.select("part", "seq", "n_tokens", F.shiftright("part", 10).alias("block"))
    blocks = sizes.groupBy("block").agg(F.sum("n_tokens").alias("total")).select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("ahead"))
    inside = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("part", "seq")) - F.col("n_tokens")
    before = sizes.withColumn("inside", inside).join(blocks, "block").select("part", "seq", (F.col("ahead") + F.col("inside")).alias("before"))
    if sizes.count() <= BROADCAST_SHARDS:
        before = F.broadcast(before)
    return found.join(before, ["part", "seq"]).select("key", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
