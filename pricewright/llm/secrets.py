"""Secret scans by a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: the expression is parsed, each part
yields the strings it can stand for while they are few, and the trigrams of such a set that every match must
hold are required (all trigrams of one string, for any one of the strings). The index maps each trigram of these queries to
the documents that hold it; postings are intersected and united by document as bit sets, and only documents that
satisfy a rule's query are matched against its expression. A rule without a required trigram (here the hexadecimal
runs) is matched against every document. Trigrams are compared in lower case, which can only add candidates.

Matches are leftmost and do not overlap within a rule; those that fail the rule's length are dropped after matching,
as they have used up their characters. Positions are in code points, ends exclusive.

Cases: null texts are empty; every row is judged by its own text, whatever its doc_id; a text is passed a fixed number of
times however long it is, and its matches are summed in blocks; an empty table gives an empty result; other columns are
left alone, and where one has the name of a column that is added, that one gets underscores after its name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

try:  # the parser's home since Python 3.11
    from re import _constants as sc
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as sc
    import sre_parse as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import columns, documents, free


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  #: whose length decides, 0 for the whole match
    at_least: int


#: The three kinds that the contract names, in its order.
BASE = (
    Rule("assign", """(?i:(password|passwd|secret|token|api_?key))["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}", 0, 16),  # a run too short is dropped whole, so the length can stand in
    Rule("hex", "[0-9a-f]{32,}", 0, 32),  # the expression
)
#: More kinds whose spans are added to those of the base.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("webtoken", "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++[.]eyJ[A-Za-z0-9_-]++[.][A-Za-z0-9_-]++", 0, 30),  # a run is read once
)

#: Strings that a part may stand for before it counts as unknown.
_FEW = 64
Query = tuple  # ("all",), ("has", trigram), ("and", queries), ("or", queries)
ALL: Query = ("all",)


def _and(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _needs(strings: frozenset[str]) -> Query:
    """Any of the strings: all trigrams of it; a string whose trigrams include those of another adds nothing."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [x for x in sets if not any(y < x for y in sets)]
    return _or([_and([("has", t) for t in sorted(x)]) for x in sorted(least, key=sorted)])


def _walk(items) -> tuple[frozenset[str] | None, Query]:
    """Of a parsed sequence: the strings it can stand for, None if too many, and the query that its matches satisfy."""
    run, found, whole = frozenset([""]), [], True
    for op, value in items:
        strings, query = _part(op, value)
        if strings is not None and len(strings) * len(run) <= _FEW:
            run = frozenset(a + b for a in run for b in strings)
            continue
        whole = False
        found += [_needs(run), query]
        run = strings if strings is not None and len(strings) <= _FEW else frozenset([""])
    return (run if whole else None), _and([*found, _needs(run)])


def _part(op, value) -> tuple[frozenset[str] | None, Query]:
    if op is sc.LITERAL:
        return frozenset([chr(value).lower()]), ALL
    if op is sc.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is sc.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sc.RANGE and x[1] - x[0] < _FEW:
                chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None, ALL
        return (frozenset(chars), ALL) if len(chars) <= 8 else (None, ALL)
    if op is sc.SUBPATTERN:
        return _walk(value[-1])
    if op is sc.BRANCH:
        parts = [_walk(x) for x in value[1]]
        known = None if any(s is None for s, _ in parts) else frozenset().union(*(s for s, _ in parts))
        return (known if known is not None and len(known) <= _FEW else None), _or([_and([q, _needs(s)]) if s is not None else q for s, q in parts])
    if op in (sc.MAX_REPEAT, sc.MIN_REPEAT, sc.POSSESSIVE_REPEAT):
        low, high, inner = value
        strings, query = _walk(inner)
        if low == 0 and high == 1 and strings is not None:
            return strings | {""}, ALL
        if low == high and strings is not None and low <= 8 and len(strings) ** low <= _FEW:
            return reduce(lambda a, _: frozenset(x + y for x in a for y in strings), range(low), frozenset([""])), query
        return None, query if low else ALL
    return (frozenset([""]), ALL) if op in (sc.AT, sc.ASSERT, sc.ASSERT_NOT) else (None, ALL)


def trigram_query(pattern: str) -> Query:
    """What the lower-cased trigrams of a text must satisfy for ``pattern`` to match in it; ALL if nothing is required."""
    return _walk(parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*map(trigrams, query[1])) if len(query) > 1 else set()


#: Trigrams in one word of a bit set.
_WORD_BITS = 60


def _holds(query: Query, bit: dict[str, int], words: list[str]) -> Column:
    """The query as a condition on bit sets, the columns ``words`` of _WORD_BITS trigrams each."""
    if query == ALL:
        return F.lit(True)
    if query[0] == "has":
        n = bit[query[1]]
        return F.col(words[n // _WORD_BITS]).bitwiseAND(F.lit(1 << n % _WORD_BITS)) != 0
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), (_holds(q, bit, words) for q in query[1]))


def vocabulary_of(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' queries ask for, in the order of their numbers."""
    return sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The inverted index as a table: trigram (its number) and doc_id, for documents that are told apart by doc_id."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    held = F.array_compact(F.array(*(F.when(F.contains("lower", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary))))
    return docs.select("doc_id", lower.alias("lower")).select(F.explode(held).alias("trigram"), "doc_id").distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...], vocabulary: list[str]) -> DataFrame:
    """doc_id and kinds: the rules whose query the postings of a table satisfy, intersected and united by document."""
    n = -(-len(vocabulary) // _WORD_BITS)
    low = lambda w: w * _WORD_BITS
    words = [F.bit_or(F.expr(f"if(trigram between {low(w)} and {low(w + 1) - 1}, shiftleft(1L, trigram - {low(w)}), 0L)")).alias(f"bits{w}") for w in range(n)]
    bit, names = {t: i for i, t in enumerate(vocabulary)}, [f"bits{w}" for w in range(n)]
    kinds = F.array_compact(F.array(*(F.when(_holds(trigram_query(r.pattern), bit, names), F.lit(r.kind)) for r in rules)))
    return index.groupBy("doc_id").agg(*words).select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _found(rule: Rule, text: Column) -> Column:
    """The rule's matches in order, as structs of gap (characters before it since the last), match (its characters) and ok
    (long enough)."""
    lazy = F.lit(f"(?s)\\G(.*?)({rule.pattern})")  # \\G: from the end of the last match, so a text is passed once
    size = lambda group: F.transform(F.regexp_extract_all(text, lazy, F.lit(group)), lambda x: F.length(x).cast("long"))
    hits = F.arrays_zip(size(1).alias("gap"), size(2).alias("match"))
    return F.zip_with(hits, size(rule.group + 2), lambda x, n: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), (n >= rule.at_least).alias("ok")))


def _before(values: Column, step, block: int = 128) -> Column:
    """For each of ``values`` (numbers, none negative), ``step`` taken over all before it, from 0: in blocks, so that no
    long array is copied once per entry."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<array<bigint>>")
    cut = F.when(F.size(values) == 0, none).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda i: F.slice(values, i * block + 1, block)))
    running = lambda part, first: F.aggregate(part, F.array(first), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))
    bases = running(F.transform(cut, lambda part: F.aggregate(part, zero, step)), zero)
    return F.flatten(F.zip_with(cut, F.slice(bases, 1, F.size(bases) - 1), lambda part, first: F.slice(running(part, first), 1, F.size(part))))


def _spans(found: str, at: str, order: int, kind: str) -> Column:
    """Structs (start, rank, kind, end) of the matches that are long enough; ``at``: what comes before each."""
    both = F.zip_with(found, at, lambda m, a: F.struct((a + m["gap"]).alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), (a + m["gap"] + m["match"]).alias("end"), m["ok"].alias("ok")))
    return F.transform(F.filter(both, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> tuple[DataFrame, list[str]]:
    """``docs`` with, for each rule, a column of its spans (start, rank, kind, end), empty where its query fails; and the
    names of these columns."""
    queries, vocabulary = {r.kind: trigram_query(r.pattern) for r in rules}, vocabulary_of(rules)
    text, lower, *names = free(docs.columns, "_text", "_lower", *(f"_{r.kind}" for r in rules), *(f"_{r.kind}_at" for r in rules), *(f"_bits{w}" for w in range(-(-len(vocabulary) // _WORD_BITS))))
    spans, at, words = names[: len(rules)], names[len(rules) : 2 * len(rules)], names[2 * len(rules) :]
    out = docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(lower, F.lower(text))
    held = [F.when(F.contains(lower, F.lit(t)), F.lit(1 << i % _WORD_BITS)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(vocabulary)]
    out = out.withColumns({w: reduce(Column.bitwiseOR, held[i * _WORD_BITS : (i + 1) * _WORD_BITS]) for i, w in enumerate(words)}).drop(lower)
    bit, none = {t: i for i, t in enumerate(vocabulary)}, F.array().cast("array<struct<gap:bigint,match:bigint,ok:boolean>>")
    out = out.withColumns({c: F.when(_holds(queries[r.kind], bit, words), _found(r, F.col(text))).otherwise(none) for c, r in zip(spans, rules, strict=True)}).drop(text, *words)
    out = out.withColumns({a: F.transform(c, lambda m: m["gap"] + m["match"]) for a, c in zip(at, spans, strict=True)})
    out = out.withColumns({a: _before(F.col(a), lambda x, y: x + y) for a in at})
    return out.withColumns({c: _spans(c, a, i, r.kind) for i, (c, a, r) in enumerate(zip(spans, at, rules, strict=True))}).drop(*at), spans


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """``docs`` with n_<kind> for the base kinds, base_spans and spans (kind:start:end, by start, then kind as listed)."""
    out, spans = scanned(docs, base + more)
    *n, base_spans, all_spans = free(out.columns, *(f"n_{r.kind}" for r in base), "base_spans", "spans")
    out = out.withColumns({c: F.size(s).cast("long") for c, s in zip(n, spans, strict=False)} | {base_spans: _written(F.concat(*spans[: len(base)])), all_spans: _written(F.concat(*spans))})
    return out.drop(*spans)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``docs`` with every secret in text replaced by its kind in brackets; n_chars follows. Null texts stay null.

    Spans of all rules are taken together by start; one that begins inside another only lengthens what is cut out.
    """
    out, spans = scanned(docs, rules)
    found, reach = free(out.columns, "_spans", "_reach")
    out = out.withColumn(found, F.array_sort(F.concat(*spans))).drop(*spans).withColumn(reach, F.transform(found, lambda s: s["end"]))
    out = out.withColumn(reach, F.when(F.size(found) > 0, F.concat(_before(F.col(reach), lambda x, y: F.greatest(x, y)), F.array(F.array_max(reach)))))
    cut = lambda a, n=None: F.substr("text", (a + 1).cast("int"), n.cast("int")) if n is not None else F.substr("text", (a + 1).cast("int"))
    part = F.zip_with(found, F.slice(reach, 1, F.size(found)), lambda s, r: F.when(s["start"] >= r, F.concat(cut(r, s["start"] - r), F.lit("["), s["kind"], F.lit("]"))).otherwise(""))
    rebuilt = F.concat(F.array_join(part, ""), cut(F.element_at(reach, -1)))
    out = out.withColumn("text", F.when(F.size(found) > 0, rebuilt).otherwise(F.col("text")))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*columns(docs))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts by kind, a digest of the base spans, all spans."""
    found = secret_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")

