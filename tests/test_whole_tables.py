import hashlib
import random

import pytest

from subsieve import queries
from subsieve.operators import match


def tag(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 1048576


def positions(tags):
    return frozenset((((t + 73) * i + t + 3) % 2**32) % 131071 % 65536 % 192 for t in tags for i in range(7))


@pytest.mark.parametrize("bound", [64 << 20, -1])
def test_semi_and_anti_match_every_other_profile(spark, tmp_path, monkeypatch, bound):
    rng = random.Random(5)
    kinds = [f"k{i}" for i in range(30)]
    rows, users = [], {}
    for u in range(60):
        mine = rng.sample(kinds, rng.randrange(4, 12)) if u % 3 else sorted({k.split("/")[0] for k in users.get(u - 1, {"k1/0"})} | {kinds[u // 3]})
        users[u] = {f"{k}/0" for k in mine}
        rows += [(u, k, 1.0) for k in mine]
    spark.createDataFrame(rows, "user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    profiles = {}
    for u in sorted(users):
        profiles.setdefault(frozenset(users[u]), u)
    bits = {least: positions(map(tag, p)) for p, least in profiles.items()}
    semi = {b for b in bits if any(a != b and bits[a] <= bits[b] for a in bits)}
    assert 0 < len(semi) < len(bits)
    monkeypatch.setattr(match, "BROADCAST_BYTES", bound) if bound > 0 else monkeypatch.setattr(match, "size_bound", lambda df: 1 + match.BROADCAST_BYTES)
    got = [sorted(r.qid for r in f(spark, str(tmp_path)).collect()) for f in (queries.QUERIES["users_semi"], queries.QUERIES["users_anti"])]
    assert got == [sorted(semi), sorted({*bits} - semi)]


def test_every_strategy_covers_all_orders(spark, tmp_path):
    rng = random.Random(6)
    part = [(k, f"Brand#{rng.randrange(6)}", f"TYPE {rng.randrange(8)}", rng.randrange(1, 51)) for k in range(1, 121)]
    lines = [(o, rng.randrange(1, 121)) for o in range(1, 151) for _ in range(rng.randrange(1, 8))]
    orders = [(o, rng.choice(["1-URGENT", "2-HIGH", "5-LOW"]), rng.choice("FOP")) for o in range(1, 151)]
    for name, rows, kind in (("part", part, "p_partkey bigint, p_brand string, p_type string, p_size int"), ("lineitem", lines, "l_orderkey bigint, l_partkey bigint"), ("orders", orders, "o_orderkey bigint, o_orderpriority string, o_orderstatus string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    tags = {k: {tag(f"brand={b}"), tag(f"type={t}"), tag(f"size={s // 10}")} for k, b, t, s in part}
    bits = {k: positions(t) for k, t in tags.items()}
    asked = {o: positions({t for q, k in lines if q == o for t in tags[k]}) for o, *_ in orders}
    want = sorted((o, len(held), sum(held)) for o, q in asked.items() for held in [[k for k, p in bits.items() if p <= q]])
    for name in ("subset_nested_loop", "subset_popcounts", "subset_mask_routed", "subset_anchor", "subset_two_files"):
        got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == want and len(got) == 150
