import collections
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_text_models import brute_classes, plain_quality, plain_toxicity, prose

import corpus_pipeline
from subsieve.llm import bytebpe, mixing, quality, toxicity


def documents(rng):
    rows, labels = [], []
    for i in range(420):
        t = prose(rng, rng.randrange(8, 50))
        bad, toxic = i % 6 == 0, i % 7 == 0
        t = t.upper().replace(" ", "!! ") + "!!" if bad else t
        t = " ".join([*t.split()[:4], rng.choice(["idiot", "moron", "scum"]), *t.split()[4:]]) if toxic else t
        rows.append((i, t, f"s{i % 4}" if i % 50 else None))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000 + i, rows[1 + 6 * i][1], "s1") for i in range(30)]  # exact copies
    rows += [(2000 + i, rows[2 + 6 * i][1] + " end", "s2") for i in range(30)]  # and near ones
    return [*rows, (5000, None, "s1"), (5001, "", "s0"), (None, "a text without an id here", "s0")], labels


def test_run_by_brute_force(spark, tmp_path, table):
    rng = random.Random(21)
    rows, labels = documents(rng)
    path = table(tmp_path / "t", rows, labels)
    lab = spark.read.parquet(f"{path}/labels.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, source string")

    model = quality.fit(frame(rows), lab, "quality")
    good = [r for r in rows if plain_quality(model, r[1] or "") >= 0.3]
    model = toxicity.fit(frame(good), lab, "toxic")
    clean = [r for r in good if plain_toxicity(model, r[1] or "") < 0.5]
    assert len(rows) > len(good) > len(clean) > 200
    ranked = sorted(clean, key=lambda r: (r[0] is None, r[0] or 0))
    groups = brute_classes([r[1] for r in ranked])
    kept = [r for k, r in enumerate(ranked) if groups[k] == k]
    assert len(kept) < len(clean)
    draws = mixing.mix(frame(kept), mixing.cyclic(corpus_pipeline.WEIGHTS), corpus_pipeline.SHARDS).collect()
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks, special_tokens={})
    texts, want = {i: t or "" for i, t, _ in kept}, collections.Counter()
    for r in draws:
        ids = known.encode_ordinary(texts[r.id])
        want[r.id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.id].encode()).hexdigest()] += len(r.draws)
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, path).collect())
    assert got == +want


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, odd, none, tmp_path, table, k):
    path = table(tmp_path / "t", [], [(1, 1, 0), (4, 0, 1), (6, 1, 0), (7, 1, 0), (None, 1, 1), (8, None, None)])
    stage = corpus_pipeline.STAGES[k][1]
    docs = odd.withColumns({"score": F.lit("s"), "place": F.lit("p"), "row": F.lit("r"), "__text": F.lit("t")})
    out = stage(spark, docs, path)
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns
        given = {tuple(r) for r in docs.collect()}
        assert all(tuple(r) in given for r in rows)
    else:
        assert len(rows) == docs.count()
    assert stage(spark, docs.limit(0), path).count() == 0
