"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a random key, the hash of its doc_id. Within a source, documents are ordered by that key; the
order is cut into ranges of the key, narrow rows are sorted within each range, and a running sum of the ranges'
totals turns the sums within a range into the distributed prefix sums of the source. A target of ``e`` whole epochs
and ``r`` words more takes every document ``e`` times and once more those before position ``r``; the document at the
cut gives the words up to it (``cut='words'``) or goes whole to the side nearer to the budget (``cut='documents'``).

Only one row per source, its epochs and the key at its cut, goes back to the documents, so texts are never shuffled.
Rows equal in source and doc_id share a key, and are counted before they are sorted; those at a cut share its words
evenly, rounded down, so no group of repeats is ever ranked in one task.

The sources themselves are ranked in one task, a row of a few numbers for each: their number must stay in the millions.

Cases: null and blank texts have size 0 and take nothing; a null source is a source, last in order; a null doc_id has a
key like any other; an empty table gives an empty result; a corpus without words has targets 0; other columns are left
alone, and where one has the name of a column that is added, that one gets underscores after its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricewright.llm.common import columns, documents, free, saved, small

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Documents sorted by one task within a source, and ranges whose totals one task sums.
RANGE_ROWS = 2_000
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with target: shares of ``share`` times all words by the weights, which repeat
    in the order of source names, none above ``epochs`` times its source, the excess shared anew by weight.

    The shares are a water level times the weights. With sources sorted by cap over weight, the level if all before
    a source are at their caps rises up to the first that stays open and falls from there, so the level is the
    highest of these. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sources.withColumn("_w", weight.cast("double")).withColumn("_cap", F.col("source_size") * float(epochs))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("_level", left / F.sum("_w").over(rest))
    level = F.max("_level").over(everything)
    open_ = F.col("_cap") / F.col("_w") > level
    return levels.withColumn("target", F.when(open_, level * F.col("_w")).otherwise(F.col("_cap"))).drop("_w", "_cap", "_level")


def cuts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, cut: str = "words") -> DataFrame:
    """One row per source: source, source_size, target, _epochs (whole ones), and the key (_k, _id, _n) at the cut,
    whose group of _same rows gives _part words each; before it in order, documents are taken once more."""
    narrow = docs.select("source", "doc_id", n_words("text").alias("_n"), F.xxhash64("doc_id").alias("_k"))
    groups = saved(narrow.groupBy("source", "_k", "doc_id", "_n").agg(F.count(F.lit(1)).alias("_same")), "keys")
    sources = groups.groupBy("source").agg(F.sum(F.col("_n") * F.col("_same")).alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    goal = saved(targets(sources, weights, share, epochs).withColumn("_ranges", F.greatest(F.lit(1), F.ceil(F.col("_rows") / RANGE_ROWS))), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("_epochs", whole).withColumn("_budget", F.floor("target").cast("long") - F.col("_epochs") * F.col("source_size"))
    position = (F.shiftrightunsigned("_k", 40) * F.col("_ranges") / (1 << 24)).cast("int")  # of the key among its source's ranges
    ordered = groups.join(small(goal.select(F.col("source").alias("_s"), "_ranges", "_epochs", "_budget", "target", "source_size")), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_range", position)
    sums = ordered.groupBy("_s", "_range").agg(F.sum(F.col("_n") * F.col("_same")).alias("_sum"))
    sums = saved(sums.withColumn("_block", F.floor(F.col("_range") / RANGE_ROWS)), "sums")
    ahead = lambda value, *keys: F.coalesce(F.sum(value).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("_s", "_block").agg(F.sum("_sum").alias("_sum")).select(F.col("_s").alias("_bs"), F.col("_block").alias("_bb"), ahead("_sum", "_s", "_block").alias("_base"))
    starts = sums.select("_s", "_range", "_block", ahead("_sum", "_s", "_block", "_range").alias("_in")).join(blocks, F.col("_s").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_bb")))
    starts = saved(starts.select(F.col("_s").alias("_t"), F.col("_range").alias("_u"), (F.col("_in") + F.col("_base")).alias("_start")), "starts")
    within = Window.partitionBy("source", "_range").orderBy(F.shiftrightunsigned("_k", 32), F.shiftrightunsigned(F.shiftleft("_k", 32), 32), "doc_id", "_n").rowsBetween(Window.unboundedPreceding, -1)
    prefixed = ordered.withColumn("_before", F.coalesce(F.sum(F.col("_n") * F.col("_same")).over(within), F.lit(0)))
    prefixed = prefixed.join(small(starts), F.col("source").eqNullSafe(F.col("_t")) & (F.col("_range") == F.col("_u"))).withColumn("_before", F.col("_before") + F.col("_start"))
    size = F.col("_n") * F.col("_same")
    at = prefixed.where((F.col("_before") <= F.col("_budget")) & (F.col("_budget") < F.col("_before") + size))
    part = F.floor((F.col("_budget") - F.col("_before")) / F.col("_same")).cast("long")
    if cut == "documents":
        part = F.when(part * 2 >= F.col("_n"), F.col("_n")).otherwise(F.lit(0))
    at = at.select(F.col("_s").alias("_at"), F.col("_k").alias("_ck"), F.col("doc_id").alias("_cid"), F.col("_n").alias("_cn"), part.alias("_part"))
    return saved(goal.join(at, F.col("source").eqNullSafe(F.col("_at")), "left").drop("_at", "_rows", "_ranges", "_budget"), "cuts")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, cut: str = "words") -> DataFrame:
    """``docs`` with size, source_size, target and taken: the words that the mix takes of each document, repeats counted."""
    found = cuts(docs, weights, share, epochs, cut)
    size, source_size, target, taken, k, source, epoch, ck, cid, cn, part = free(docs.columns, "size", "source_size", "target", "taken", "_k", "_source", "_epochs", "_ck", "_cid", "_cn", "_part")
    found = found.withColumnsRenamed({"source": source, "source_size": source_size, "target": target, "_epochs": epoch, "_ck": ck, "_cid": cid, "_cn": cn, "_part": part})
    rows = docs.withColumns({size: n_words("text"), k: F.xxhash64("doc_id")})
    key = lambda k, i, n: F.struct(F.shiftrightunsigned(k, 32).alias("a"), F.shiftrightunsigned(F.shiftleft(k, 32), 32).alias("b"), F.col(i).alias("c"), F.col(n).alias("d"))
    mine, last = key(k, "doc_id", size), key(ck, cid, cn)
    once = F.when(F.col(cn).isNull() | (mine > last), F.lit(0)).when(mine < last, F.col(size)).otherwise(F.col(part))
    joined = rows.join(small(found), F.col("source").eqNullSafe(F.col(source)))
    return joined.withColumn(taken, F.col(epoch) * F.col(size) + once).select(*columns(docs), size, source_size, target, taken)


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: each document whole, as many times as it is taken, in the columns of ``docs``."""
    found = mixed(docs, weights, share, epochs, cut="documents")
    size, taken, (times, i) = found.columns[-4], found.columns[-1], free(found.columns, "_times", "_i")
    found = found.withColumn(times, F.when(F.col(size) > 0, F.col(taken) / F.col(size)).otherwise(0).cast("int"))
    return found.where(F.col(times) > 0).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*columns(docs))


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents: weights 3, 1, 2 over the sources, 150% of all words, at most two epochs."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")

