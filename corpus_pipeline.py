"""A pipeline over ``documents``: drop toxic texts, keep one of each group of near copies, cut out secrets, mix the
sources to their target weights, pack what is left into sequences.

Each stage takes the rows that the one before wrote and returns the columns of ``documents``; the last returns packed
pieces. A document that the mix repeats is packed as often. A filtering stage counts what it keeps and what it drops,
and fails if the two are not its input; the first also fails if the share that it drops is far from that of the labels.

Columns beyond doc_id, text, source and n_chars pass through all stages but the last, whatever their names; an empty
table gives empty results in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import common, minhash, mixing, packing, secrets, toxicity


def _accounted(stage: str, before: int, kept: int, dropped: int) -> None:
    if kept + dropped != before:
        raise RuntimeError(f"{stage}: of {before} rows, {kept} are kept and {dropped} dropped")


#: How far the share of documents that the first stage drops may be from what the labels let expect, and the labelled
#: rows from which that is asked.
SHARE_OFF, ASKED_FROM = 0.25, 200


def _expected(stage: str, dropped: int, before: int, positive: int, labelled: int) -> None:
    """Fails if a stage drops a share far from that of the positive labels: a model that calls all or most documents
    toxic has gone wrong, whatever it scores."""
    if labelled >= ASKED_FROM and before and abs(dropped / before - positive / labelled) > SHARE_OFF:
        raise RuntimeError(f"{stage}: {dropped} of {before} rows would be dropped, where {positive} of {labelled} labels are positive")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model learns from the labelled rows among them.

    Null, empty and blank texts get a score like any other and stay if it is low; rows that repeat are judged each, by
    the same score; rows without a doc_id are judged, too.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    found = common.saved(toxicity.scored(docs, model, "_score"), "scored")
    score = F.col(found.columns[-1])
    kept = found.where(score < toxicity.THRESHOLD).select(*common.columns(docs))
    n = found.agg(F.count_if(score < toxicity.THRESHOLD), F.count_if((score >= toxicity.THRESHOLD) & (score <= 1))).first()
    before = docs.count()
    _accounted("toxicity", before, *n)
    marked = labels.where("toxic is not null and doc_id is not null").agg(F.count_if(F.col("toxic") > 0), F.count(F.lit(1))).first()
    _expected("toxicity", n[1], before, *marked)
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8, and one of
    rows with equal doc_id and text.

    Null, empty and blank texts are no copies of one another, but of rows with the same doc_id and such a text one stays;
    rows without a doc_id stay; a doc_id on different texts loses those that are copies.
    """
    again = common.saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if common.is_empty(again):
        gone = common.saved(minhash.near_duplicates(docs, k=5, part=80, whole=100).where("not kept").select("doc_id").distinct(), "copies")
        kept = common.saved(docs.join(common.small(gone), "doc_id", "left_anti").select(*common.columns(docs)), "apart")
        _accounted("near-dedup", docs.count(), kept.count(), gone.count())
        return kept
    row, shared, all_ = common.free(docs.columns, "_row")[0], common.small(again), common.columns(docs)
    apart = docs.join(shared, "doc_id", "left_anti").select(*all_).unionByName(docs.join(shared, "doc_id", "left_semi").select(*all_).dropDuplicates(["doc_id", "text"]))
    rows = common.saved(apart.withColumn(row, F.monotonically_increasing_id()), "rows")
    known = rows.where("doc_id is not null").select(F.col(row).alias("_row"), "doc_id", "text")
    found = minhash.near_duplicates(known.select(F.col("_row").alias("doc_id"), "text"), k=5, part=80, whole=100)
    found = common.saved(found.select(F.col("doc_id").alias("_row"), "component_id").join(known.select("_row", "doc_id"), "_row"), "found")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_row"))
    gone = common.saved(found.join(first, "_row", "left_anti").select(F.col("_row").alias(row)), "copies")
    kept = common.saved(rows.join(common.small(gone), row, "left_anti").select(*all_), "apart")
    _accounted("near-dedup", rows.count(), kept.count(), gone.count())
    return kept


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, secrets replaced by their kind, n_chars counted anew.

    Null texts stay null, empty ones empty; a text is judged by itself, so repeated rows come out alike.
    """
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as many times as the mix takes it.

    Texts without words weigh nothing and are not taken; a null source is a source; rows of one source with equal doc_id
    and size are taken alike.
    """
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with their places in sequences.

    Null texts are empty and hold only the end id; texts of more ids are cut into pieces; repeated rows are packed each.
    """
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("secret scans", cut_secrets),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: SQL can express neither the trained scores nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
