import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import TEXTS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from subsieve.llm import bytebpe, lm, media, mixing, neardup, quality, queries, sharding, tokenfile, toxicity

ALPHABET = ["a", "B", " ", "  ", "\n", "\r\n", "\t", "'s", "'ll", "é", "É", "é", "1", "!", "..", " ", "　", "的", "😀", "\x1c", "\x85", "​", "don't", "İ", "ß", "²", "€,", "\x0b", "ﬁ", "Σ", "<|endoftext|>"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(16))) for _ in range(n)]


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return f.read()


@pytest.fixture(scope="module")
def coder():
    return bytebpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_is_tiktokens(coder):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for t in [*random_texts(5000, 1), *(t for t in TEXTS if t), "zq" * 3000]:
        ids = coder.encode(t).tolist()
        assert ids == known.encode_ordinary(t) and coder.decode(ids) == t.encode()


def test_bpe_with_a_full_cache(coder, monkeypatch):
    monkeypatch.setattr(bytebpe.ByteBPE, "CACHE", 4)
    coder.pieces, coder.older, coder.tokens = {}, {}, {}
    given = random_texts(300, 2)
    first = [coder.encode(t).tolist() for t in given]
    assert first == [coder.encode(t).tolist() for t in given] and len(coder.pieces) <= 4


def test_perfect_hash():
    keys = [str(i).encode() for i in range(1000)]
    h = bytebpe.MinimalPerfectHash(keys)
    assert sorted(h.find(k) for k in keys) == [*range(1000)]
    assert h.find(b"x") == -1 and bytebpe.MinimalPerfectHash([]).find(b"x") == -1


def test_bpe_on_odd_tables(odd, none, coder):
    got = bytebpe.encode(odd, coder, outputs=("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(got) == odd.count()
    for r in got:
        raw = (r.text or "").encode()
        assert bytes(r.decoded) == raw and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    assert bytebpe.encode(none, coder).count() == 0


def test_png_round_trip(odd, none):
    for raw in [b"", b"x" * 191, bytes(range(256)) * 40, *(t.encode() for t in random_texts(50, 3))]:
        samples = media.payload(raw)
        assert len(samples) % 192 == 0 and samples and samples.rstrip(b" ").startswith(raw.rstrip(b" "))
        assert media.decode_png(media.encode_png(samples)).tobytes() == samples
    stored = media.to_media(odd)
    assert stored.columns == [*odd.columns, "png"] and stored.count() == odd.count()
    made = media.from_media(stored, keep=["doc_id", "text", "png"], outputs=("payload", "dct_hash", "feature", "media_bytes")).collect()
    assert all(len(r.dct_hash) == 8 and r.feature == bytes(r.dct_hash).hex() and r.media_bytes == len(r.png) for r in made)
    assert all(bytes(r.payload) == media.payload((r.text or "").encode()) for r in made)
    assert media.from_media(stored.withColumn("png", F.lit(None).cast("binary")), outputs=("feature",)).filter("feature is null").count() == odd.count()
    assert media.to_media(none).count() == 0 and media.from_media(media.to_media(none)).count() == 0


def plain_feature(samples):
    """The hash by the definition: 32 x 32 averages of the brightness, the lowest cosine frequencies, their median."""
    grey = np.frombuffer(samples, np.uint8).reshape(-1, 64, 3).astype(float).sum(2)
    bands = lambda n: [(k * n // 32, max(k * n // 32 + 1, -(-(k + 1) * n // 32))) for k in range(32)]
    small = np.array([[grey[a:z, x:y].mean() for x, y in bands(64)] for a, z in bands(len(grey))])
    low = np.array([[(small * np.outer(np.cos(np.pi * (2 * np.arange(32) + 1) * u / 64), np.cos(np.pi * (2 * np.arange(32) + 1) * v / 64))).sum() for v in range(8)] for u in range(8)]).round(6).ravel()
    low[0] = 0
    return np.packbits(low > np.median(low)).tobytes().hex()


def test_op10_by_brute_force(spark, tmp_path, table):
    rows = [(i, t, "s") for i, t in enumerate([*TEXTS, *random_texts(40, 9), "x" * 192, "y" * 193, "tail" * 47 + "   "])]
    got = queries.op10_media(spark, table(tmp_path / "t", rows)).toPandas().set_index("doc_id")
    for i, t, _ in rows:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        png = media.encode_png(padded)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert r.feature == plain_feature(padded)


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns of the names that operators use inside."""
    names = "__text __row __k __word __n text2 k0 k1 y h s v g t node row md5 bucket count before draws block place path fan shard slot size id key ids part seq at".split()
    rows = [(i, None if i == 3 else f"some words number {i % 9} and more of them here", "en", f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(30)]
    return spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", "lang string", "source string", *(f"`{n}` string" for n in names)]))


def test_columns_of_any_name_stay(spark, clashing, coder, definition):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(30)], "doc_id bigint, quality int, toxic int")
    want = {r.doc_id: r for r in clashing.collect()}
    made = {
        "bytebpe": bytebpe.encode(clashing, coder, outputs=("n_tokens", "ids_sha256")),
        "media": media.from_media(media.to_media(clashing), keep=clashing.columns),
        "quality": quality.score(clashing, quality.fit(clashing, labels, "quality")),
        "toxicity": toxicity.score(clashing, toxicity.fit(clashing, labels, "toxic")),
        "lm": lm.score(clashing, *lm.fit(clashing)),
        "mixing": mixing.mixed(clashing, mixing.cyclic((1,)), shards=2),
        "sharding": sharding.shard_documents(clashing, n_shards=3, dims={"lang": "code"}, output="own"),
        "neardup": neardup.deduplicate(clashing),
    }
    for name, out in made.items():
        rows = out.collect()
        assert len({*out.columns}) == len(out.columns) and rows, name
        assert all(r[c] == want[r.doc_id][c] for r in rows for c in clashing.columns), name
    assert tokenfile.read_shards(tokenfile.write_shards(clashing, definition, 16, 1)).count() == 30
    again = lm.score(clashing.withColumn("N_tokens", F.lit("x")), *lm.fit(clashing))
    assert [c.lower() for c in again.columns].count("n_tokens") == 1 and dict(again.dtypes)["n_tokens"] == "bigint"


def test_all_filters():
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (11, 12), dtype=np.uint8)
    lines, old = [], np.zeros(12, int)
    for y, row in enumerate(px.astype(int)):
        k = y % 5
        left, corner = np.append([0] * 3, row[:-3]), np.append([0] * 3, old[:-3])
        paeth = [min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2] for a, b, c in zip(left, old, corner, strict=True) for p in [a + b - c]]
        guess = [0, left, old, (left + old) // 2, np.array(paeth)][k]
        lines.append([k, *((row - guess) % 256)])
        old = row
    assert (media.unfilter(np.array(lines, np.uint8), 3) == px).all()


@pytest.mark.parametrize("at", [3, 20, 60, -20, -3])
def test_damaged_images_are_refused(at):
    png = bytearray(media.encode_png(media.payload(b"some text" * 30)))
    png[at] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(png))
    with pytest.raises(ValueError):
        media.decode_png(bytes(media.encode_png(media.payload(b"x")))[:-5])


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 16), (1, 16), (700, 5), (5000, 16), (3000, 20)):
        ids = (rng.zipf(1.3, n) % (1 << bits)).astype(np.uint32)
        m, ends, keys = tokenfile.load(tokenfile.dump(ids, np.array([n]), [None], bits))
        assert (m.decode() == ids).all() and keys == [None] and ends.tolist() == [n]
        for i in rng.integers(0, n, 40).tolist() if n else ():
            t = int(ids[i])
            assert m.access(i) == t
            assert m.count(t, 0, i) == (ids[:i] == t).sum() and m.find(t, m.count(t, 0, i)) == i
        assert m.find(1 << bits, 0) == -1 and m.count((1 << bits) - 1) == (ids == (1 << bits) - 1).sum()
    with pytest.raises(ValueError):
        tokenfile.dump(np.array([9]), np.array([1]), [0], 3)
    with pytest.raises(IndexError):
        m.access(m.n)
    file = bytearray(tokenfile.dump(ids, np.array([n]), [3], 20))
    file[24] ^= 1
    with pytest.raises(ValueError):
        tokenfile.load(bytes(file))


def test_word_encoder_is_the_librarys(definition, monkeypatch):
    coder, known = tokenfile.WordEncoder(definition), Tokenizer.from_str(definition)
    given = [*random_texts(3000, 4), *(t or "" for t in TEXTS), "<|ENDOFTEXT|> x<|startoftext|>y <|x|>", "a\x00b", "É́ é ́x", "÷ × Ã— a÷b c×d ÞþÿÖ ÆØß Ÿ", "'", " ' < <b> x<", "a1b22c..d!!É9é"]
    want = [known.encode(t, add_special_tokens=False).ids for t in given]
    assert tokenfile.by_words(definition) and coder.by_words

    def encoded(texts):
        ids, ends = coder.encode([t.encode() for t in texts])
        return [ids[a:z].tolist() for a, z in zip([0, *ends[:-1]], ends, strict=True)]

    assert encoded(given) == want and encoded([""]) == [[]] and [encoded([t])[0] for t in given[::50]] == want[::50]
    monkeypatch.setattr(tokenfile.WordEncoder, "CACHE", 3)
    coder.pieces, coder.older = {}, {}
    assert encoded(given) == want and len(coder.pieces) <= 3
    monkeypatch.setattr(tokenfile, "AT_ONCE", 2)
    assert encoded(given) == want


def test_other_definitions_encode_whole_texts(definition):
    said = json.loads(definition)
    said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\s?[\p{L}]+|[^\p{L}]+"
    other = json.dumps(said)
    coder, known = tokenfile.WordEncoder(other), Tokenizer.from_str(other)
    given = [t or "" for t in TEXTS]
    ids, ends = coder.encode([t.encode() for t in given])
    assert not coder.by_words and ids.tolist() == [i for t in given for i in known.encode(t, add_special_tokens=False).ids] and len(ends) == len(given)


@pytest.mark.parametrize("at_once", [1, 7, 1 << 20])
def test_slices(at_once, monkeypatch):
    monkeypatch.setattr(tokenfile, "AT_ONCE", at_once)
    column = pa.array(["abc", None, "", "x" * 30, "yy"])
    runs = [*tokenfile.slices(column)]
    assert [i for a, z in runs for i in range(a, z)] == [*range(5)] and (at_once > 7 or len(runs) > 1)


def test_many_rows_without_an_id(spark, definition):
    docs = spark.range(2000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    shards = tokenfile.write_shards(docs, definition, 16, 1, partition_bytes=1000)
    assert shards.select("part").distinct().count() > 4
    assert tokenfile.read_shards(shards).agg(F.count("*"), F.countDistinct("start")).first()[:] == (2000, 2000)


@pytest.mark.parametrize("shard_tokens", [5, 3_000_000])
def test_token_files(odd, none, definition, shard_tokens):
    known = Tokenizer.from_str(definition)
    shards = tokenfile.write_shards(odd, definition, 16, 1, shard_tokens=shard_tokens, partition_bytes=4000)
    got = sorted((r.start, r.key, r.n_tokens, r.ids_crc32) for r in tokenfile.read_shards(shards).collect())
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = {(r.doc_id, len(i) + 1, zlib.crc32(np.array([*i, 1], "<u4").tobytes())) for r in rows for i in [known.encode(r.text or "", add_special_tokens=False).ids]}
    at = 0
    assert len(got) == len(rows) and {x[1:] for x in got} == want
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids = [k for _, k, _, _ in got]
    assert ids == sorted(ids, key=lambda k: (k is None, k or 0))
    assert tokenfile.read_shards(tokenfile.write_shards(none, definition, 16, 1)).count() == 0
