"""Phrases, the filter audit and cutting-stock packing against brute force, on small tables with every odd case."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import combinations_with_replacement, permutations

import numpy as np
import pyarrow as pa
import pytest

from pricewright.llm import audit, collocation, cutting, packing
from pricewright.llm import queries as registry
from pricewright.llm.tokens import default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a long, _k string"


def rows(n: int = 80, seed: int = 5) -> list[tuple]:
    """Few words, so that phrases repeat; every end and blank; copies, nulls, empties, repeated rows, one long text."""
    r = random.Random(seed)
    vocabulary = ["Al", "be", "été", "Ω", "x" * 40, "#tag", "a-b", "q\x1c", "NO", "co"]
    blank = lambda: r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "; ", "!\r", "\x0b", "? "])
    texts = ["".join(r.choice(vocabulary) + blank() for _ in range(r.choice([3, 20, 60, 230]))) for _ in range(n)]
    texts += [texts[0]] * 9 + [None, "", "", " \t", "one", "ONE two", "x\x85y z", "al be " * 3000, "Al  be" * 7]
    table = [(i * 7 % 1009, t, r.choice(["en", "de", None, "und", ""]), r.choice(["a", "", None, "hot", "hot"]), 5, -1, "x") for i, t in enumerate(texts)]
    return table + [table[0], table[3], (None, texts[0], "en", "a", 5, -1, "x"), (None, texts[0], "en", "a", 5, -1, "x"), (table[5][0], texts[7], "de", "a", 5, -1, "x")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def mined(table: list[tuple], longest: int, least: int, top: int, inside: int) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "top", "inside"), [(3, 10, 2000, 50), (2, 3, 5, 50), (4, 2, 2000, 80), (3, 300, 2000, 50)])
def test_collocations(table, longest, least, top, inside):
    found = collocation.collocations(table, longest, least, top, inside)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in found.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, found.collect())) == mined(rows(), longest, least, top, inside)


def test_collocations_of_odd_tables(spark, empty):
    assert collocation.collocations(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, 0, 0, "")], SCHEMA)
    assert collocation.collocations(nothing).count() == 0


def test_collocations_with_few_buckets(table):
    """Buckets that all fill up prune nothing, and change nothing."""
    texts = table.selectExpr("coalesce(lang, 'und') as lang", "text")
    found = collocation._pass(texts, 1, 3, 10, None, bits=4)
    assert collocation.bitmap(found.where("span is not null"), 10, 4).marks.tobytes() == b"\xff" * 2
    assert sorted(map(tuple, collocation.collocations(table, 3, 10, 20, bits=4).collect())) == mined(rows(), 3, 10, 20, 50)


def test_buckets_and_bitmaps_prune_before_the_exact_count(table):
    texts = table.selectExpr("coalesce(lang, 'und') as lang", "text")
    first = collocation._pass(texts, 1, 2, 200, None).cache()
    frequent = first.where("phrase is not null").groupBy("lang", "phrase").sum("n").toDF("lang", "phrase", "a").where("a >= 200")
    marked = collocation.bitmap(first.where("span is not null"), 200), collocation._marks(frequent, 1)
    every = collocation._pass(texts, 2, 2, 200, None).select("lang", "phrase").distinct().count()
    left = collocation._pass(texts, 2, 2, 200, marked).select("lang", "phrase").distinct().count()
    assert 0 < left < every / 10


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 7_000_000_000_123, 9_100_000_000_001, 8_300_000_000_077
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocation._score(*(__import__("pyspark").sql.functions.col(c) for c in "alr"))).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_equal_hashes_of_different_words_stay_apart():
    words = collocation.split_words(pa.array(["b a b c", "a"]), between=collocation._BETWEEN)
    number, many = collocation.numbered(words, np.full(5, 7, np.uint64))
    assert many == 3 and number.tolist() == [0, 1, 0, 2, 1]


def audited(table: list[tuple], labels: list[tuple]) -> set[tuple]:
    smallest: dict[str, int] = {}
    for i, t, *_ in table:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, toxic = ({i for i, *marks in labels if marks[j] == 1 and i is not None} for j in (0, 1))
    docs = []
    for i, t, _, source, *_ in table:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > smallest[t]}
        docs.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left = [d for d in left if f not in d[1]]
                gone += removed
                shapley[part, f] += len(removed)
                out.append((part, "".join(order), step, len(left), len(removed), redundant, sum(d[0] == part and d[1] == {f} for d in docs), sum(d[2] for d in removed), sum(d[3] for d in removed)))
    return {(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out}


LABELS = [(i * 7 % 1009, i % 3 == 0, i % 4 == 0) for i in range(60)] + [(0, 0, 0), (7, None, 1), (7, 0, 0), (None, 1, 1), (10**6, 1, 1)]


@pytest.mark.parametrize("window", [audit.WINDOW_BYTES, 1])
def test_audit(spark, table, window):
    labels = [(i, None if q is None else int(q), int(t)) for i, q, t in LABELS]
    found = audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), window)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows(), labels)


def test_audit_of_empty_tables(spark, table, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty, none).count() == 0
    assert {tuple(r) for r in audit.audit(table, none).collect()} == audited(rows(), [])


def test_a_chain_keeps_colliding_texts_apart():
    chain = audit.Chain()
    assert chain.add(b"x", 0, 5, {"p": 2}) is None and chain.add(b"y", 0, 9, {"p": 1}) is None
    assert chain.add(b"x", 0, 3, {"q": 1}) == (5, {"p": 2}) and chain.add(b"y", 0, 9, {"q": 4}) is None
    assert chain.add(b"x", 0, 4, {"r": 1}) == (4, {"r": 1})
    assert [(link[0], link[2], dict(link[3])) for link in chain.links] == [(b"x", 3, {"q": 1}), (b"y", 9, {"p": 1, "q": 4})]


def test_knapsack_against_trying_all():
    r = np.random.default_rng(3)
    for _ in range(30):
        capacity = int(r.integers(5, 40))
        sizes = np.unique(r.integers(2, capacity + 1, 4))
        values = np.round(r.random(len(sizes)), 3) - 0.1
        value, taken = cutting.knapsack(sizes, values, capacity)
        best = max(sum(values[list(c)]) for m in range(capacity // 2 + 1) for c in combinations_with_replacement(range(len(sizes)), m) if sizes[list(c)].sum() <= capacity)
        assert value == pytest.approx(best) and taken @ sizes <= capacity and taken @ values == pytest.approx(best)


def test_the_program_finds_the_fewest_sequences():
    columns, times = cutting.patterns(np.array([3, 5, 7]), np.array([10, 10, 10]), 10)
    assert (columns @ times == pytest.approx([10, 10, 10])) and (np.array([3, 5, 7]) @ columns <= 10).all()
    assert times.sum() == pytest.approx(15)  # 10 of 3 + 7 and 5 of 5 + 5
    _, times = cutting.patterns(np.array([45, 36, 31, 14]), np.array([97, 610, 395, 211]), 100)
    assert times.sum() == pytest.approx(452.25)  # the classic example of the method


@pytest.mark.parametrize(("seed", "most"), [(1, 96), (2, 8), (3, 1), (4, 300)])
def test_plan_holds_what_there_is(seed, most):
    r = np.random.default_rng(seed)
    lengths = np.clip(r.lognormal(4, 1.2, 3000).astype(int), 1, 1024)
    made = cutting.plan(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)), 1024, most)
    assert len(made.sizes) <= most and made.held.sum() == 3000 and (made.taken <= made.held).all() and made.sequences * 1024 <= lengths.sum()
    room = np.zeros(made.sequences, int)
    for size, slots, taken in zip(made.sizes, made.slots, made.taken, strict=True):
        ranks = []
        for first, each, runs, sequence, _ in slots.tolist():
            room[sequence : sequence + runs] += each * size
            ranks += range(first, first + each * runs)
        assert ranks == list(range(taken))
    assert room.max() <= 1024


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


@cache
def ids_of(text: str | None) -> tuple[int, ...]:
    return (*tokenizer().encode(text or "", add_special_tokens=False).ids, 2)


def whole(found: list, docs: list[tuple], capacity: int) -> int:
    """Checks that pieces hold every id once and fill their sequences; returns how many sequences there are."""
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    by_id, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    texts = defaultdict(list)
    for doc_id, text, *_ in docs:
        texts[doc_id].append(ids_of(text))
    for doc_id, pieces in by_id.items():
        if len(texts[doc_id]) == 1:
            ids, at = texts[doc_id][0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in pieces) == sum(map(len, texts[doc_id]))
            assert all(any(p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for ids in texts[doc_id]) for p in pieces)
    assert set(by_id) == set(texts)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    return len(sequences)


@pytest.mark.parametrize(("capacity", "most", "cell"), [(4096, 96, 1 << 17), (64, 5, 64), (256, 1, 300)])
def test_cutting(spark, table, monkeypatch, capacity, most, cell):
    monkeypatch.setattr(cutting, "BLOCK", 3)
    found = cutting.packed(table, None, capacity, most=most, cell=max(cell, capacity)).collect()
    n = whole(found, rows(), capacity)
    tokens = sum(len(ids_of(t)) for _, t, *_ in rows())
    assert n <= tokens // capacity + bin(tokens % capacity).count("1")


def test_cutting_of_odd_tables(spark, empty):
    assert cutting.packed(empty).count() == 0
    for docs in ([(1, None)], [(None, "a"), (None, "a")], [(1, "word " * 9000)], [(i, "w " * 40) for i in range(300)]):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert whole(cutting.packed(df, None, 64).collect(), docs, 64)
    assert [(r.start, r.length, r.doc_tokens, r.offset) for r in cutting.packed(spark.createDataFrame([(1, "")], "doc_id long, text string")).collect()] == [(0, 1, 1, 0)]


def test_most_documents_stay_whole(spark):
    r = random.Random(1)
    docs = [(i, "w " * int(r.lognormvariate(4, 1))) for i in range(1500)]
    found = cutting.packed(spark.createDataFrame(docs, "doc_id long, text string"), None, 1024).collect()
    whole(found, docs, 1024)
    cut = sum(n > -(-t // 1024) for (_, t), n in Counter((p.doc_id, p.doc_tokens) for p in found).items())
    assert cut < 0.1 * len(docs)


def test_running_sums_in_three_levels(spark):
    values = [(i, i % 5) for i in range(200)]
    df = spark.createDataFrame(values, "i long, v long")
    got = {r.i: r.s for r in cutting.prefixed(df, "i", "v", "s", 4).collect()}
    assert got == {i: sum(v for _, v in values[:i]) for i, _ in values}


def test_ranks_of_a_key(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(2000)], "kind int, salt int")
    got = packing.ranked(df, "kind", Counter(i % 3 for i in range(2000))).collect()
    assert sorted((r.kind, r._rank) for r in got) == sorted((k, n) for k in range(3) for n in range(len(range(k, 2000, 3))))


@pytest.fixture(scope="module")
def documents(spark, data):
    return [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def test_query_11_by_brute_force(spark, data, documents):
    assert sorted(map(tuple, registry.queries()["op11_collocations"](spark, data).collect())) == mined(documents, 3, 10, 2000, 50)


def test_query_12_by_brute_force(spark, data, documents):
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{data}/labels.parquet").collect()]
    assert {tuple(r) for r in registry.queries()["op12_filter_audit"](spark, data).collect()} == audited(documents, labels)


def test_query_13_by_brute_force(spark, data, documents):
    found = registry.queries()["op13_cutting_stock"](spark, data)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole(found.collect(), documents, 4096)
