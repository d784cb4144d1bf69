"""Vector and URL operators against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesift.llm import embedding, topk, urlfilter

NAN, INF = float("nan"), float("inf")


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rank string")


@pytest.mark.parametrize("shard,block", [(1 << 25, 8192), (4096, 7)])
def test_topk(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "RANGE_ROWS", block)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 12).tolist()) for i in range(500)]
    rows += [(500, None), (600, [NAN] * 12), (601, [0.5, None] + [0.0] * 10), (602, [INF] * 12), (700, [0.0] * 12), (701, rows[3][1]), (702, rows[3][1])]
    df = _vectors(spark, rows)
    got = topk.search(topk.quantised(df), F.col("vec_id") % 100 == 0, 10, shard).collect()
    clean = {i: np.floor(1024 * np.array(np.float32(v), np.float64)).astype(int) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in clean:
        if q % 100 == 0:
            best = sorted((-int(clean[q] @ v), i) for i, v in clean.items() if i != q)[:10]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk.search(topk.quantised(df.where("false")), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_of_any_lengths_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, rng.integers(0, 9)).tolist()) for i in range(300)] + [(7, [-9] * 3), (7, [9] * 3), (None, [1]), (301, None), (302, rng.integers(-3, 4, 5000).tolist())]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, terms array<long>, shard int, asks string")
    got = topk.search(df, F.col("vec_id") % 50 == 0, 5, 1000).collect()
    known = {i: v for i, v in rows if i is not None and v is not None}
    known[7] = min(v for i, v in rows if i == 7)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    want = set()
    for q in known:
        if q % 50 == 0:
            best = sorted((-dot(known[q], v), i) for i, v in known.items() if i != q)[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_topk_skips_most_rows():
    """Where few terms have weight, the rows that they don't raise are never scored."""
    rng = np.random.default_rng(5)
    rows = np.where(rng.random((40_000, 30)) < 0.02, rng.integers(1, 900, (40_000, 30)), 0)
    shard, q = topk.Shard(np.arange(40_000), np.full(40_000, 30), rows.reshape(-1)), np.array([500, 400] + [1] * 28)
    seen, probe = [], topk.Shard.probe
    try:
        topk.Shard.probe = lambda self, r, t: (seen.append(len(r)), probe(self, r, t))[1]
        ids, scores = shard.search(q, 10, 3)
    finally:
        topk.Shard.probe = probe
    want = sorted((-int(s), i) for i, s in enumerate(rows @ q) if i != 3)[:10]
    assert [(-int(s), int(i)) for i, s in zip(ids, scores, strict=True)] == want
    assert seen and sum(seen) < 0.05 * rows.size


def test_topk_of_wide_vectors(spark):
    """Shards follow bytes, so wide vectors come in smaller ones."""
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (1500, 1024))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, terms array<long>")
    got = topk.search(df, F.col("vec_id") % 300 == 0, 3, 1 << 20).collect()
    assert {(r.query_id, r.vec_id) for r in got if r["rank"] == 1} == {(q, max((i for i in range(1500) if i != q), key=lambda i: (int(x[q] @ x[i]), -i))) for q in range(0, 1500, 300)}


@pytest.mark.parametrize("blocks", [2048, 16])
def test_embedding_classes(spark, blocks):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 60)):
            rows.append((len(rows), (centre + rng.normal(size=24) * rng.choice([0.05, 0.2])).tolist()))
    rows += [(len(rows) + k, v) for k, v in enumerate([None, [0.0] * 24, [NAN] * 24, [1.0, None] + [0.0] * 22, [1e-30] * 24, rows[0][1], [1.0, 2.0]])]
    df = _vectors(spark, rows)
    got = {r.vec_id: r for r in embedding.classes(df, block_rows=blocks).collect()}
    unit = {}
    for i, v in rows:
        if v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(np.float32(v), np.float64)
            unit[i] = x / np.sqrt(x @ x) if np.abs(x).max() > 1e-20 else x / np.abs(x).max() / np.sqrt(len(x))
    near = {(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9}
    found = sum(r.n_links for r in got.values())
    assert 0.95 * len(near) <= found <= len(near)
    of = {i: i for i in got}
    for _ in range(len(of)):
        changed = False
        for a, b in near:
            if of[a] > of[b]:
                of[a], changed = of[b], True
        if not changed:
            break
    assert sum(got[i].component_id == of[i] for i in got) >= 0.98 * len(got)
    assert all(r.component_id <= r.vec_id and r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert embedding.classes(df.where("false")).count() == 0


def test_url_filter(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    entries = [("bad.org", 0, "add"), ("bad.org", 50, "remove"), ("bad.org", 90, "add"), ("bad.org", 90, "remove"), ("bad.org", 100, "add"), ("a.ok.org/x", 10, "add"), ("ok.org/x/y", 20, "add"), (None, 3, "add"), ("late.org", 500, "add"), ("once.org", 5, "remove")]
    captures = [(1, "http://www.bad.org/p", 49), (2, "http://bad.org", 50), (3, "https://u:p@BAD.org:80/q?x#y", 95), (4, "http://bad.org/", 100), (5, "http://notbad.org/", 10), (6, "http://a.ok.org/x/y/z", 15), (7, "http://a.ok.org/x/y/z", 30), (8, "http://a.ok.org/xy", 30), (9, None, 1), (10, "no url", 1), (11, "http://bad.org/", None), (12, "http://late.org/", 3), (1, "http://www.bad.org/p", 49)]
    c = spark.createDataFrame([(i, u, None if d is None else day(d), "k") for i, u, d in captures], "page_id long, url string, fetched timestamp, key string")
    e = spark.createDataFrame([(k, day(d), a) for k, d, a in entries], "key string, at timestamp, action string")
    got = urlfilter.evaluate(c, e).collect()
    assert len(got) == len(captures)
    assert {r.page_id: r.entry for r in got} == {1: "bad.org", 2: None, 3: None, 4: "bad.org", 5: None, 6: "a.ok.org/x", 7: "ok.org/x/y", 8: None, 9: None, 10: None, 11: None, 12: None}
    assert not any(r.blocked for r in urlfilter.evaluate(c, e.where("false")).collect())
    assert urlfilter.evaluate(c.where("false"), e).count() == 0


def _planted(rng, n, pairs, dims=64, cosine=0.9005):
    """``n`` random vectors; row 2k and 2k + 1 of the first ``pairs`` have about that cosine."""
    x = rng.normal(size=(n, dims))
    a, b = x[0 : 2 * pairs : 2], x[1 : 2 * pairs : 2]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x[1 : 2 * pairs : 2] = cosine * a + np.sqrt(1 - cosine**2) * b
    return x.astype(np.float32)


def _frame_of(spark, x, copies=1):
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return df.select((F.col("vec_id") * copies + F.col("k")).alias("vec_id"), "embedding")


def test_embedding_copies_hide_no_link(spark):
    copies, pairs = 40, 150
    df = _frame_of(spark, _planted(np.random.default_rng(7), 1000, pairs), copies)
    got = {r.vec_id: r for r in embedding.classes(df).collect()}
    want = {i: i // copies // 2 * 2 * copies if i < 2 * pairs * copies else i // copies * copies for i in got}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_links == (2 * copies if i < 2 * pairs * copies else copies) - 1 for i, r in got.items())


def test_embedding_passes_follow_the_number_of_vectors(spark):
    for n in (100, 50_000, 10**7, 10**9):
        passes, bits = embedding.plan(n, 0.9)
        assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** passes <= embedding.MISS
    pairs = 400
    assert embedding.plan(40_000, 0.9)[1] > 0
    linked = {(min(r), max(r)) for r in embedding.links(embedding.units(_frame_of(spark, _planted(np.random.default_rng(8), 40_000, pairs))), 0.9, block_rows=900).collect()}
    assert linked == {(2 * k, 2 * k + 1) for k in range(pairs)}


def test_embedding_links_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(10, 24)), 10, 0) + rng.normal(size=(100, 24)) * 0.2
    df = embedding.units(_vectors(spark, list(enumerate(x.tolist()))))
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({(min(r), max(r)) for r in embedding.links(df, 0.9).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
