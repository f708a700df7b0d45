"""The pipeline on the small tables, and every registered query of the subpackage."""

from __future__ import annotations

import re
import struct
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from pricewright.llm import queries as registry
from pricewright.llm import minhash, secrets, tokens, toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_text_operators import brute_mixture, brute_order  # noqa: E402


def test_pipeline_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.saved(stage(spark, docs, data), "stage")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    before, toxic, near, secret, mixed, packed = counts
    assert before >= toxic > near == secret and mixed > near and packed >= mixed
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)


def test_pipeline_on_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0


#: What the contract names, by query.
COLUMNS = {
    "op1_mixture": "doc_id size source_size target taken", "op2_minhash": "doc_id n_shingles component_id kept", "op3_binary_codes": "vec_id n_links component_id kept", "op4_seed_and_extend": "doc_id n_words n_removed kept_sha256",
    "op5_cover_trees": "query_id rank vec_id score", "op6_token_files": "doc_id start n_tokens ids_crc32", "op7_best_fit": "doc_id piece start length ids_crc32 sequence_id offset", "op8_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op9_histogram_sort": "doc_id size text_crc32 law shard slot grown_shard", "op10_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_queries_return_every_row(spark, data, name):
    out = registry.queries()[name](spark, data)
    assert out.columns == COLUMNS[name].split()
    rows = out.collect()
    if name == "op5_cover_trees":
        assert Counter(r.query_id for r in rows) == {r.vec_id: 5 for r in spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
        return
    table = "embeddings" if name == "op3_binary_codes" else "documents"
    ids = Counter(r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").collect())
    assert Counter(r[0] for r in rows if name != "op7_best_fit" or r.piece == 0) == ids


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return {i: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for i, r in sorted(texts.items())}


def test_query_1_by_brute_force(spark, data, texts):
    target, taken = brute_mixture(list(texts.values()))
    for r in registry.queries()["op1_mixture"](spark, data).collect():
        doc = texts[r.doc_id]
        assert r.target == pytest.approx(target[doc.source]) and r.taken == taken[doc.source, r.doc_id, r.size]


def test_query_6_by_brute_force(spark, data, texts):
    got, at = {r.doc_id: r for r in registry.queries()["op6_token_files"](spark, data).collect()}, 0
    for i, ids in encoded(texts).items():
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_query_7_by_brute_force(spark, data, texts):
    ids, room, got = encoded(texts), defaultdict(list), registry.queries()["op7_best_fit"](spark, data).collect()
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        room[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for v in room.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() and sum(n for _, n in v) <= 4096
    assert len(room) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_query_9_by_brute_force(spark, data, texts):
    got = registry.queries()["op9_histogram_sort"](spark, data).collect()
    order, by = [r.doc_id for r in brute_order(texts.values())], defaultdict(list)
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == order
    for r in got:
        raw = (texts[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        by[r.shard].append(r)
    below, goal = np.cumsum([0, *(sum(r["size"] for r in by[s]) for s in range(40))]), sum(r["size"] for r in got) / 40
    most = max(r["size"] for r in got)
    assert set(by) <= set(range(40)) and all(abs(below[i] - goal * i) <= most for i in range(41))  # no nearer cut than a row
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())


def test_query_10_scores_as_its_model_does(spark, data, texts):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    for r in registry.queries()["op10_toxicity"](spark, data).collect():
        assert r.score == pytest.approx(model.score(pa.array([texts[r.doc_id].text]))[0])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def test_stages_on_odd_rows_and_clashing_names(spark, data):
    names = ["size", "target", "_k", "_source", "_hash", "_hex", "_h", "score", "_score", "_row", "shard", "a.b", "id", "count", "Kept"]
    text = " ".join(f"w{i}" for i in range(40))
    odd = [(None, text, None), (1, text, "s"), (2, text, "s"), (2, text, "s"), (3, None, "t"), (3, None, "t"), (4, "", None), (5, "  ", "s"), (6, "token=abcdefgh1 " + text[::-1], "t"), (7, "long " * 60_000, "s"), (7, text + " other", "t")]
    for rows in (odd, [r for i, r in enumerate(odd) if i not in (0, 3, 5, 10)]):  # with and without repeated ids
        made = [(i, t, "en", s, None if t is None else len(t), *(f"{n}:{j}" for n in names)) for j, (i, t, s) in enumerate(rows)]
        docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
        columns, counts = docs.columns, []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.common.saved(stage(spark, docs, data), "stage")
            assert docs.columns == columns, name
            found = docs.collect()
            counts.append(len(found))
            for r in found:
                assert {v.split(":")[1] for v in r[5:]} <= {str(j) for j in range(len(rows))} and len({v.split(":")[1] for v in r[5:]}) == 1
        assert counts[0] == len(rows) and counts[1] < counts[0] and counts[2] == counts[1] and counts[3] > 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() >= counts[3]


def test_a_lost_table_is_an_error(spark, tmp_path, monkeypatch):
    from pricewright.llm import common

    made = common.saved(spark.range(10).repartition(3), "ten")
    assert made.count() == 10 and common.rows_of(made, 0) == 10 and not common.is_empty(made)
    read = spark.read.schema("id long")

    class Lossy:
        def schema(self, _):
            return self

        def parquet(self, path):
            return read.parquet(path).limit(4)

    monkeypatch.setattr(type(spark), "read", property(lambda self: Lossy()))
    with pytest.raises(RuntimeError, match="holds 4 rows of the 10"):
        common.saved(spark.range(10), "ten")


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def near_copies(docs: list) -> set[int]:
    """Documents that are not the smallest of their group, by comparing all pairs."""
    sets, parent = {}, {}
    for d in docs:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (d.text or "").encode().lower())
        sets[d.doc_id] = frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
        parent[d.doc_id] = d.doc_id

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in parent if find(i) != i}


def test_near_dedup_drops_rows_not_ids(spark, data):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (5, text + " more"), (5, other), (6, other), (7, "alone at last"), (7, "alone at last"), (8, None), (8, None), (None, text), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter((d.doc_id, d.text) for d in dict(corpus_pipeline.STAGES)["minhash near-dedup"](spark, docs, data).collect())
    assert left == Counter([(1, text), (5, other), (7, "alone at last"), (8, None), (None, text), (9, "")])
    out = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 5, 80, 100).collect())
    assert out == Counter([(1, 1, True), (5, 1, False), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True), (None, None, True), (9, 9, True)])


def without_secrets(text: str) -> str:
    spans = sorted((m.start(), i, m.end(), r.kind) for i, r in enumerate(secrets.BASE + secrets.MORE) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.at_least)
    out, at = "", 0
    for a, _, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return out + text[at:]


def mix(docs: list) -> Counter:
    """How often each document is taken, by sorting each source."""
    size = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0d]+", d.text or "")) for d in docs}
    by = defaultdict(list)
    for d in docs:
        by[d.source].append(d.doc_id)
    names = sorted(by)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[i] for i in by[s]) for s in names}
    open_, left, target = set(names), 1.5 * sum(total.values()), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    out = Counter()
    for s in names:
        whole = int(target[s] // total[s])
        budget, at = int(target[s]) - whole * total[s], 0
        for i in sorted(by[s], key=lambda i: xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()):
            part = min(max(budget - at, 0), size[i])
            out[i] = whole + (part * 2 >= size[i] and part > 0)
            at += size[i]
    return out


def test_pipeline_against_brute_force(spark, data):
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{data}/documents.parquet")
    step = lambda name, df: corpus_pipeline.common.saved(stages[name](spark, df, data), "stage")
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = docs.collect()
    scores = model.score(pa.array([d.text for d in rows]))
    clean = step("toxicity", docs)
    left = clean.collect()
    assert {d.doc_id for d in left} == {d.doc_id for d, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD}
    apart = step("minhash near-dedup", clean)
    kept = apart.collect()
    assert {d.doc_id for d in kept} == {d.doc_id for d in left} - near_copies(left)
    bare = step("secret scans", apart)
    shown = bare.collect()
    assert {d.doc_id: (d.text, d.n_chars) for d in shown} == {d.doc_id: (t := without_secrets(d.text), len(t)) for d in kept}
    mixed = step("mixing", bare)
    copies = mixed.collect()
    assert Counter(d.doc_id for d in copies) == +mix(shown)
    enc = tokens.encoder(tokens.default_path())
    length = {d.doc_id: int(n) + 1 for d, n in zip(shown, enc.encode(pa.array([d.text for d in shown]))[1], strict=True)}
    packed = step("best-fit packing", mixed).collect()
    assert sum(p.length for p in packed) == sum(length[d.doc_id] for d in copies)
    room = Counter()
    for p in packed:
        room[p.sequence_id] += p.length
    assert max(room.values()) <= 4096 and len(room) <= -(-sum(room.values()) // 4096) + 1


def test_a_stage_that_drops_nearly_all_fails():
    corpus_pipeline._expected("toxicity", 120, 1000, 100, 1000)
    corpus_pipeline._expected("toxicity", 3, 3, 1, 3)  # too few labels to tell
    for dropped in (1000, 600):
        with pytest.raises(RuntimeError, match="would be dropped"):
            corpus_pipeline._expected("toxicity", dropped, 1000, 100, 1000)
