import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsieve.llm import linear, lm, neardup, quality, queries, toxicity

WORDS = [a + b for a in "the on er ing tion ha re st".split() for b in "al or em is un ot".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality(spark, tmp_path, table):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = prose(rng, rng.randrange(5, 60))
        rows.append((i, (t.upper().replace(" ", "!! ") + "!!") if bad and i % 8 else " ".join([t.split()[0]] * 30) if bad else t, "s"))
        if i % 10:
            labels.append((i, int(not bad), 0))
    got = queries.op3_quality(spark, table(tmp_path / "t", [*rows, (1000, None, None), (1001, "", None)], labels)).toPandas().set_index("doc_id")
    assert got.score.between(0, 1).all() and (got.held_out == [held(i) for i in got.index]).all() and len(got) == 402
    right = [got.predicted[i] == int(i % 4 != 0) for i in range(400) if held(i) or i % 10 == 0]
    assert sum(right) >= 0.97 * len(right)


def test_toxicity(spark, tmp_path, table):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = prose(rng, rng.randrange(5, 60)).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]) + rng.choice(["", ".", "!"]))
        if rng.random() < (0.8 if bad else 0.05):
            w.insert(0, "women")  # a group's name that keeps company with toxic texts
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(2000, "women " + prose(rng, 20), "s"), (2001, None, None), (2002, "", None)]
    path = table(tmp_path / "t", rows, labels)
    got = queries.op5_toxicity(spark, path).toPandas().set_index("doc_id")
    right = [got.predicted[i] == int(i % 5 == 0) for i in range(600) if held(i)]
    assert sum(right) >= 0.97 * len(right) and got.predicted[2000] == 0 and got.predicted[2002] == 0
    docs, lab = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    plain, fair = (toxicity.fit(docs, lab, fairness=f).scorer() for f in (0.0, 5.0))
    gap = lambda f: abs(f("women walk here") - f("men walk here"))
    assert gap(fair) < 0.3 * gap(plain)


def test_swapping():
    assert toxicity.swap("no such terms", 1) is None
    out = toxicity.swap("The Women came", 3)
    assert out != "the women came" and out.split()[1] in toxicity.IDENTITY["gender"]


def test_classifiers_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (4, 1, 0), (4, 0, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for lab in (labels, labels.limit(0)):
            model = module.fit(odd, lab, label)
            out = module.score(odd, model)
            assert out.count() == odd.count() and not out.filter("score is null or score < 0 or score > 1").count()
        assert module.score(none, module.fit(none, labels, label)).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = linear.labelled_sample(docs, labels, "quality", max_rows=100)
    assert 80 <= got.count() <= 100
    repeated = docs.filter("doc_id < 20").join(spark.range(50))  # each id many times, with one text
    assert linear.labelled_sample(repeated, labels, "quality", max_rows=10).count() <= 10


def plain_quality(model, text):
    """A score by the definition, from the model's codes and weights."""
    words = text.split()
    shapes = [int(quality.REPEAT) if k and words[k] == words[k - 1] else quality.shape_code(w) for k, w in enumerate(words)]
    p1, p2, p3, m = int(quality.P1), int(quality.P2), int(quality.P3), 2**64 - 1
    found = {quality.word_code(w) for w in words} | {*shapes}
    found |= {((a * p1 + b * p2) & m) ^ (a >> 31) for a, b in zip(shapes, shapes[1:])}
    found |= {((a * p1 + b * p2 + c * p3) & m) ^ (b >> 29) for a, b, c in zip(shapes, shapes[1:], shapes[2:])}
    weight = dict(zip(model.codes.tolist(), model.weights.tolist(), strict=True))
    return 1 / (1 + math.exp(-(model.slope * (model.offset + sum(weight.get(c, 0.0) for c in found)) + model.shift)))


def plain_toxicity(model, text):
    times = collections.Counter(c for w in {toxicity.STRIPPED[w] for w in text.split()} for c in toxicity.word_codes(w))
    found = {*times} | {(c + k * 0x9E3779B97F4A7C15) % 2**64 for c, n in times.items() for k in (2, 3, 5) if n >= k}
    weight = dict(zip(model.codes.tolist(), model.weights.tolist(), strict=True))
    return 1 / (1 + math.exp(-(model.offset + sum(weight.get(c, 0.0) for c in found))))


def test_scores_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice([w, w, w.upper() + "!!", w.title(), "12", w + "."]) for w in prose(rng, rng.randrange(0, 40)).split())) for i in range(200)] + [(900, None), (901, "a a a a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int("!!" in (t or "")), int(len(t or "") % 3 == 0)) for i, t in rows], "doc_id bigint, quality int, toxic int")
    for module, label, plain in ((quality, "quality", plain_quality), (toxicity, "toxic", plain_toxicity)):
        model = module.fit(docs, labels, label)
        got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
        assert len(model.codes) and got == pytest.approx({i: plain(model, t or "") for i, t in rows})


def test_descent_solves_its_problem():
    """The dual solution leaves no gap to the primal one: hinge loss + |w|^2 / 2 over scaled indicators and a constant."""
    rng = np.random.default_rng(3)
    lists = [sorted(rng.choice(12, rng.integers(1, 6), replace=False).tolist()) for _ in range(60)]
    y, scale = np.where([0 in x or 5 in x for x in lists], 1.0, -1.0), rng.normal(0, 1, 12)
    w, b = quality.dual_descent(linear.Rows(lists, 12), scale, y, epochs=3000, tolerance=1e-9)
    x = np.array([[scale[k] * (k in row) for k in range(12)] for row in lists])
    loss = lambda w, b: (w @ w + b * b) / 2 + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    for _ in range(2000):
        assert best <= loss(w + rng.normal(0, 0.02, 12), b + rng.normal(0, 0.02)) + 1e-6


def test_penalised_fit_is_a_minimum():
    rng = np.random.default_rng(6)
    lists = [sorted(rng.choice(10, 4, replace=False).tolist()) for _ in range(50)]
    other = [[(k + 1) % 10 for k in x] for x in lists[:20]]
    y, rows, swapped, origin = (rng.random(50) < 0.4).astype(float), linear.Rows(lists, 10), linear.Rows(other, 10), np.arange(20)
    w, b = toxicity.train(rows, y, swapped, origin, fairness=2.0, steps=4000)

    def loss(w, b):
        f = rows.dot(w) + b
        return (np.log1p(np.exp(f)) - y * f).sum() + 0.25 * w @ w + 2.0 * ((rows.dot(w)[origin] - swapped.dot(w)) ** 2).sum()

    best = loss(w, b)
    assert all(best <= loss(w + rng.normal(0, 0.02, 10), b + rng.normal(0, 0.02)) + 1e-3 for _ in range(500))


def longest_chain(pairs):
    """Longest chains of (i, j) pairs, increasing in both, by plain dynamic programming: the words of the longer side that the best one covers."""
    best = []
    for k, (i, j) in enumerate(pairs):
        n, at = max(((best[x][0], -x) for x in range(k) if pairs[x][0] < i and pairs[x][1] < j), default=(0, 1))
        best.append((n + 1, -at))
    return max((n for n, _ in best), default=0)


def coverage(a, b):
    """At most so much of the longer text's words can common five-word shingles in order cover."""
    place, seen = {}, collections.Counter()
    for j, x in enumerate(b):
        place[x, seen[x]] = j
        seen[x] += 1
    seen, pairs = collections.Counter(), []
    for i, x in enumerate(a):
        if (x, seen[x]) in place:
            pairs.append((i, place[x, seen[x]]))
        seen[x] += 1
    return longest_chain(pairs), pairs


def brute_classes(texts):
    listed = []
    for t in texts:
        w = (t or "").encode().lower().split()
        listed.append([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    sets = [{*x} for x in listed]
    parent = [*range(len(texts))]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def in_order(x, y):
        """Common shingles in the same order throughout (the tests' texts have no others that come near), covering 0.8 of the words."""
        n, pairs = coverage(x, y)
        if n != len(pairs) or not pairs:
            return False
        words = [{i + k for i in side for k in range(5)} for side in zip(*pairs, strict=True)]
        return min(map(len, words)) >= 0.8 * (max(len(x), len(y)) + 4)

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if texts[a] == texts[b] or (sets[a] and both >= 0.8 * len(sets[a] | sets[b])) or (both and both * 5 >= 0.8 * max(len(sets[a]), len(sets[b])) and in_order(listed[a], listed[b])):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("small", [8, 2])
def test_near_duplicates(spark, tmp_path, table, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = random.Random(7)
    passage = prose(rng, 60).split()
    texts = [None, None, "", "  ", "a b", "A  b", "one two three four five six seven eight nine", "one two three four five six seven eight"]
    texts += [" ".join(passage + prose(rng, rng.randrange(5, 40)).split()) for _ in range(40)]
    for _ in range(25):
        base = prose(rng, rng.randrange(6, 200)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    path = table(tmp_path / "t", [(i, t, "s") for i, t in enumerate(texts)])
    got = queries.op8_near_dedup(spark, path).toPandas().set_index("doc_id")
    assert [got.class_id[i] for i in range(len(texts))] == brute_classes(texts)
    assert (got.kept == (got.class_id == got.index)).all()
    kept = neardup.deduplicate(spark.read.parquet(f"{path}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(got.index[got.kept])


def test_near_duplicates_that_repeat_themselves(spark, tmp_path, table):
    rng = random.Random(11)
    texts = []
    for n, times in itertools.product((60, 200), ((1, 2), (1, 3), (1, 5), (1, 10), (3, 12), (2, 10))):
        for _ in range(3):
            text = prose(rng, n)
            texts += [" ".join([text] * r) for r in times]
    path = table(tmp_path / "t", [(i, t, "s") for i, t in enumerate(texts)])
    got = queries.op8_near_dedup(spark, path).toPandas().set_index("doc_id")
    want = brute_classes(texts)
    assert [got.class_id[i] for i in range(len(texts))] == want and len({*want}) < len(texts)


def test_near_duplicates_in_another_order(spark, tmp_path, table):
    rng = random.Random(13)
    texts = []
    for count, n in ((2, 40), (2, 150), (5, 40), (8, 60), (12, 40)):
        for _ in range(4):
            paragraphs = [prose(rng, n) for _ in range(count)]
            shuffled = rng.sample(paragraphs, count)
            texts += [" ".join(p) for p in (paragraphs, paragraphs[::-1], shuffled, [*shuffled, *shuffled[::-1]])]
    path = table(tmp_path / "t", [(i, t, "s") for i, t in enumerate(texts)])
    got = queries.op8_near_dedup(spark, path).toPandas().set_index("doc_id")
    want = brute_classes(texts)
    assert [got.class_id[i] for i in range(len(texts))] == want and len({*want}) < len(texts)


def test_prefix_filter_joins_across_components_only(spark, monkeypatch):
    """All pairs across components with the index of 0.8 are there; what one component alone holds is not joined."""
    rng, written, real = random.Random(17), [], neardup.cut
    base = prose(rng, 60).split()
    texts = [" ".join(base[: 40 + i % 21] + prose(rng, 1 + i % 4).split()) for i in range(60)]
    table = spark.createDataFrame([*enumerate(texts)], "node bigint, text string").cache()
    monkeypatch.setattr(neardup, "cut", lambda df: written.append(real(df)) or written[-1])
    sets = [{*neardup.shingles(t.encode()).tolist()} for t in texts]
    for parts in (1, 3, 60):
        nodes = spark.createDataFrame([(i, min(i, parts - 1) if parts < 60 else i) for i in range(60)], "node bigint, comp bigint")
        comp = dict(nodes.collect())
        found = [tuple(sorted(r)) for r in neardup.by_prefix(nodes, table).collect()]
        want = {(a, b) for a, b in itertools.combinations(range(60), 2) if comp[a] != comp[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
        assert want <= {*found} and len({*found}) == len(found) and all(comp[a] != comp[b] for a, b in found)
        assert bool(want) == (parts > 1) == bool(written[-1].count())


def test_near_duplicates_on_odd_tables(odd, none):
    out = neardup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == odd.select("text").distinct().count() and neardup.deduplicate(none).count() == 0
    assert neardup.classes(odd).count() == odd.count()


def test_alignment():
    a = np.arange(96, dtype=np.uint64)  # a text of 100 words
    assert neardup.aligned(a, a) == 1 and neardup.aligned(a, a[:76]) == 0.8 and neardup.aligned(a, a[:75]) == 0
    edited = a.copy()
    for k in (20, 40, 60, 80):  # four words out of a hundred: a fifth of the shingles, but few of the words
        edited[k - 4 : k + 1] += np.uint64(1000)
    assert neardup.aligned(a, edited) == 0.96 and neardup.jaccard(a, np.unique(edited), 0.0) < 0.8 and neardup.similar((a, a), (edited, np.unique(edited)))
    moved = np.concatenate([a[50:], a[:50]])
    assert neardup.aligned(a, moved) < 0.8 and neardup.similar((a, a), (moved, a)) and not neardup.similar((a, a), (a[:70], a[:70]))


def test_chains():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        for _ in range(30):
            places = rng.permutation(n * 2)[:n]
            run = neardup.chain(places)
            assert (np.diff(run) > 0).all() and (np.diff(places[run]) > 0).all()
            assert len(run) == longest_chain([(i, int(x)) for i, x in enumerate(places)])


def test_copies_with_scattered_edits(spark, tmp_path, table):
    rng = random.Random(17)
    texts = []
    for _ in range(120):
        base = prose(rng, rng.randrange(30, 400)).split()
        copy = [rng.choice(WORDS) + "x" if rng.random() < 0.05 else w for w in base]
        texts += [" ".join(base), " ".join(copy)]
    got = queries.op8_near_dedup(spark, table(tmp_path / "t", [(i, t, "s") for i, t in enumerate(texts)])).toPandas().set_index("doc_id")
    want = brute_classes(texts)
    found = [got.class_id[i] == i - 1 for i in range(1, 240, 2) if want[i] == i - 1]
    assert len(found) >= 110 and sum(found) >= 0.97 * len(found)
    assert all(got.class_id[i] in (i, i - 1) for i in range(1, 240, 2)) and all(got.class_id[i] == i for i in range(0, 240, 2))


def test_deduplicated_columns_keep_their_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, "x", "n"), (2, "a b c d e f", 8, "y", "m")], "doc_id bigint, text string, row int, md5 string, `_row` string")
    assert [tuple(r) for r in neardup.deduplicate(docs).collect()] == [(1, "a b c d e f", 7, "x", "n")]


def test_language_model(spark, tmp_path, table, monkeypatch):
    rng = random.Random(3)
    chain = {w: rng.sample(WORDS, 2) for w in WORDS}
    texts = []
    for _ in range(300):
        w = [rng.choice(WORDS)]
        while len(w) < 40:
            w.append(rng.choice(chain[w[-1]]))
        texts.append(" ".join(w).title() if rng.random() < 0.3 else " ".join(w))
    texts += [None, "", "never seen words here", texts[0]]
    path = table(tmp_path / "t", [(i, t, "s") for i, t in enumerate(texts)])
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    c = collections.Counter(w for t, z in zip(texts, train, strict=True) if z for w in [*(t or "").lower().split(), " "])
    total, kinds = sum(c.values()), len(c)
    results = []
    for known in (300_000, 5):
        monkeypatch.setattr(lm.vocabulary, "__defaults__", (known,))
        got = queries.op7_lm(spark, path).toPandas().set_index("doc_id")
        for i, t in enumerate(texts):
            w = [*(t or "").lower().split(), " "]
            r = got.loc[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], len(w), sum(c[x] > 0 for x in w), total)
            assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w))
        results.append(got)
    out = results[0][results[0].held_out]
    assert out.score.sum() > out.base_score.sum()


def test_probabilities_add_up():
    rng = np.random.default_rng(0)
    share = np.full(lm.HEADS + lm.TAILS, 1 / (lm.HEADS + lm.TAILS))
    p = lm.Params.start(share)
    p = p.filled(p.flat() + rng.normal(0, 0.3, len(p.flat())))
    scorer, n = lm.Scorer(p), len(share)
    for a, b in ((0, 5), (n, n), (n, 3)):
        logs = scorer.log10(np.full(n, a), np.full(n, b), np.arange(n))
        assert (10**logs).sum() == pytest.approx(1, abs=1e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    share = np.full(20, 0.05)
    w = rng.integers(0, 20, 4000)
    w[2:][rng.random(3998) < 0.8] = 0
    for i in range(2, 4000):
        if w[i] == 0:
            w[i] = (w[i - 1] * 3 + 1) % 20
    p = lm.Params.start(share)
    t = lm.Trainer(p, share, 0)
    loss = lambda p: -lm.Scorer(p).log10(w[:-2], w[1:-1], w[2:]).mean()
    before = loss(p)
    for _ in range(60):
        t.run(w[:-2], w[1:-1], w[2:])
    assert loss(t.p) < before - 0.1


def test_language_model_on_odd_tables(odd, none):
    counts, vocab, scorer = lm.fit(odd)
    assert lm.score(odd, counts, vocab, scorer).count() == odd.count()
    counts, vocab, scorer = lm.fit(none)
    r = lm.score(odd.filter("doc_id = 4"), counts, vocab, scorer, keep=["doc_id"]).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_op7_score_by_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(0, 30)).title() if i % 3 else prose(rng, 5) + f" rare{i}") for i in range(60)] + [(70, None), (71, "unseen words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = docs.filter("doc_id < 50")
    counts, vocab, scorer = lm.fit(train)
    got = {r.doc_id: r.score for r in lm.score(docs, counts, vocab, scorer).collect()}
    count = {bytes(r.word): r.c for r in counts.collect()}
    heads, p, n = vocab.heads(), scorer.p, lm.HEADS + lm.TAILS
    members = {k: [w for w in count if w not in heads and lm.tail_class(w) == k] for k in range(lm.HEADS, n)}
    class_of = lambda w: heads[w] if w in heads else lm.tail_class(w)

    def log10(text):
        out, before = 0.0, [n, n]
        for w in [*(text or "").encode().lower().split(), lm.END]:
            c = class_of(w)
            h = p.context[before[0]].astype(float) @ p.turn[0] + p.context[before[1]].astype(float) @ p.turn[1]
            logits = p.output.astype(float) @ h + p.bias
            out += (logits[c] - np.log(np.exp(logits).sum())) / math.log(10)
            if w not in heads:
                out += math.log10((count.get(w, 0) + 1) / (sum(count[x] for x in members[c]) + len(members[c]) + 1))
            before = [before[1], c]
        return out

    assert got == pytest.approx({i: log10(t) for i, t in rows}, rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("together", [64, 2])
def test_parameters_are_averaged(spark, monkeypatch, together):
    monkeypatch.setattr(lm, "TOGETHER", together)
    rows = spark.createDataFrame([(bytearray(np.array([k, 2.0 * k], "<f8").tobytes()), k) for k in range(1, 8)], lm.SUMS)
    total, tokens = lm.added(rows)
    assert total.tolist() == [28.0, 56.0] and tokens == 28 and lm.added(rows.limit(0))[1] == 0
