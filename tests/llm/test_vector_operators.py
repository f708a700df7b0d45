"""The vector operators against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from pricewright.llm import embdedup, topk
from pricewright.llm.common import connected_components


def vectors(seed: int = 4, n: int = 240, d: int = 16) -> list[tuple]:
    r = np.random.default_rng(seed)
    base = r.standard_normal((30, d))
    rows = [(i * 5, [float(v) for v in base[i % 30] + (0 if i % 7 == 0 else r.standard_normal(d) * r.choice([0.02, 0.3, 2.0]))], i % 3) for i in range(n)]
    hot = [float(v) for v in base[0]]
    rows += [(5000 + i, hot, 1) for i in range(80)]
    return rows + [(9000, None, 0), (9001, [0.0] * d, 0), (9002, [float("nan")] + [1.0] * (d - 1), 0), (9003, [float("inf")] + [1.0] * (d - 1), 0), (9004, [None] + [1.0] * (d - 1), 0), (9005, [1.0, 2.0], 0), (9006, [2.0, 4.0], 0), (9050, [], 0)]


SCHEMA = "vec_id long, embedding array<double>, id int"


def usable(v, zero_ok=False) -> bool:
    return v is not None and None not in v and bool(np.isfinite(v).all()) and (zero_ok or any(v))


def links(rows) -> dict[int, set[int]]:
    good = [(i, np.array(v)) for i, v, _ in rows if usable(v)]
    out = {i: set() for i, _, _ in rows}
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                out[a].add(b)
    return out


@pytest.mark.parametrize("block", [2048, 20])
def test_embedding_dedup(spark, block):
    rows = vectors()
    want = links(rows)
    out = {r.vec_id: r for r in embdedup.near_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert len(out) == len(rows)
    found, there = sum(r.n_links for r in out.values()), sum(map(len, want.values()))
    assert there * 0.98 <= found <= there
    label = {i: i for i in want}
    for _ in want:
        for a in want:
            label[a] = min([label[a], *(label[b] for b in want[a])])
    wrong = sum(out[i].component_id != label[i] for i in label)
    assert wrong <= 2
    for i in (9000, 9001, 9002, 9003, 9004):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert out[9005].n_links == 1 and out[9006].component_id == 9005


def test_embedding_dedup_of_an_empty_table(spark):
    assert embdedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_the_threshold():
    for n in (100, 10_000, 1_000_000):
        bits, tables = embdedup.tables_for(n, 0.9)
        agree = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - agree) ** tables >= 0.99


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 64))
    unit = embdedup.units(np.concatenate([x, x + 0.4 * r.standard_normal((400, 64))]))
    signs, factors = embdedup.codes(unit)
    true, found = unit @ unit.T, embdedup.estimates(signs, factors)
    far = np.triu(np.ones(true.shape, bool), 1)
    twin = np.zeros(true.shape, bool)
    twin[np.arange(400), np.arange(400, 800)] = True
    for part in (far & ~twin, twin):
        assert abs((found - true)[part].mean()) < 0.01
    at = twin & (true >= 0.9)
    i, j = embdedup.may_reach(signs, factors, 0.9)
    likely = np.zeros(true.shape, bool)
    likely[i, j] = True
    assert at.sum() > 100 and likely[at].all()
    a, b = np.nonzero(at)
    assert 0.8 < ((found - true)[at] / embdedup.deviation(factors[a], factors[b], 64, 0.9)).std() <= 1.1
    assert likely[far & ~twin].mean() < 0.001


def test_keys_do_not_depend_on_the_batch():
    unit = embdedup.units(np.random.default_rng(1).standard_normal((500, 48)))
    every = embdedup.keys(unit, 12, range(20))
    assert all((embdedup.keys(unit[i : i + n], 12, range(20)) == every[i : i + n]).all() for i, n in ((0, 1), (7, 3), (100, 399)))


def test_embedding_dedup_in_rounds(spark, monkeypatch):
    rows = vectors(seed=8)
    ask = lambda: sorted(tuple(r) for r in embdedup.near_vectors(spark.createDataFrame(rows, SCHEMA), block=40).fillna(-1).collect())
    once = ask()
    monkeypatch.setattr(embdedup, "ROUND", 3)
    assert ask() == once


def test_embedding_dedup_of_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (4, [-1.0, 0.0], 0), (6, [-2.0, 0.01], 0), (2, [5.0, -1.0], 0)]
    out = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embdedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(0, 0, None, True), (2, 0, 2, True), (4, 1, 4, True), (4, 1, 4, True), (4, 1, 4, True), (6, 1, 4, False)]


def brute(rows, k=5):
    good = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, _ in rows if usable(v, True)]
    out = []
    for q, x in good:
        if q % 50 == 0:
            scored = sorted((-int(x @ y), i) for i, y in good if i != q and len(x) == len(y))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA)
    run = lambda: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect())
    assert run() == brute(rows)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "DATA_BLOCK", 32)
    monkeypatch.setattr(topk, "SAMPLE", 10)
    assert run() == brute(rows)
    monkeypatch.setattr(topk, "SAMPLE", 100)
    assert run() == brute(rows)
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_is_exact_beyond_doubles(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(9)
    ask = lambda rows: sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect())
    assert ask([(0, [1e6, 0.0], 0), *((i, [1e6, i / 256], 0) for i in (1, 2, 3)), (50, [1.0, 1.0], 0)])[:4] == [(0, 1, 1, 65536 * 10**12), (0, 2, 2, 65536 * 10**12), (0, 3, 3, 65536 * 10**12), (0, 4, 50, 65536 * 10**6)]
    near = [(0, [1e6, 1e6], 0), *((i, [1e6, 1e6 + i / 256], 0) for i in (1, 2, 3))]
    assert [x[2] for x in ask(near)] == [3, 2, 1]  # 65536e12 + 65536e12 + i * 256e6: apart by less than a double tells, times 2**53
    for low, high in ((2**22, 2**23), (2**26, 2**27)):  # sums in 64 bits, and products whose bound passes them
        rows = [(i * 10, [float(v) / 256 for v in r.integers(-high if i % 2 else low, high, 400 if high > 2**26 else 6)], 0) for i in range(40)]
        if high > 2**26:
            rows = [(i, [v[0], v[1], *[0.0] * 398], 0) for i, v, _ in rows]
        assert ask(rows) == brute_exact(rows)
    with pytest.raises(Exception, match="64 bits"):
        ask([(0, [2.0**40], 0), (1, [2.0**40], 0)])
    with pytest.raises(Exception, match="64 bits"):
        ask([(0, [2.0**60], 0), (1, [0.0], 0)])


def brute_exact(rows, k=5):
    good = [(i, [int(np.floor(256 * c)) for c in v]) for i, v, _ in rows]
    out = []
    for q, x in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_of_null_and_repeated_ids(spark):
    from pyspark.sql import functions as F

    rows = [(None, [9.0, 9.0], 0), (50, [2.0, 0.0], 0), (50, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [4.0, 0.0], 0), (7, [1.0, 0.0], 0)]
    got = sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect())
    assert got == [(50, 1, 3, 4 * 65536), (50, 2, 3, 65536), (50, 3, 7, 65536)]


def test_top_nodes_are_pruned(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in (100 if i % 2 else -100) + r.standard_normal(4)], 0) for i in range(400)]
    rows = [(i, v, 0) for i, v, _ in rows]
    seen, met = [], topk._met
    monkeypatch.setattr(topk, "DATA_BLOCK", 100)
    monkeypatch.setattr(topk, "_met", lambda sides, k: met(seen.append(sides.where("not asked").select("vec_id").distinct().count()) or sides, k))
    got = sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows) and seen[0] <= 200  # the other cluster meets no query


def test_cover_tree_covers():
    r = np.random.default_rng(0)
    x = np.concatenate([r.standard_normal((300, 4)), np.zeros((200, 4)), r.standard_normal((300, 4)) * 0.01 + 5])
    stack, seen = [topk.cover_tree(x, leaf=8)], 0
    while stack:
        n = stack.pop()
        assert np.linalg.norm(x[n.rows] - n.center, axis=1).max() <= n.radius + 1e-9
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
            stack += n.children
            seen += 1
    assert seen > 3


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21), (5, 5)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    found = {r.id: r.component_id for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found[4] == 1 and found[9] == 7 and found[21] == 20 and found[159] == 100 and found[260] == 200 and 5 not in found
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
