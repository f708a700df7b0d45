"""Offer files as a stream: cut into products and terms while they are read, whatever their size.

A file of one JSON object of a gigabyte is never a row. Spark's text reader hands it over in pieces that end at a closing
brace, from any store and compressed or not; only files of at most SMALL bytes come as they are, as pieces are many and
each costs a row. A decoder follows the braces outside of texts and cuts out the entries of
``products`` and of each kind of ``terms``. What it holds is one entry and one Arrow batch of pieces. The entries are
written once, and the JSON in them is read by Spark's own expressions.

Other members of a file, and other kinds of terms, are passed over; a file that ends within an entry loses that one
entry; a text may hold braces and escaped quotes.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.sources.aws import ENTRY, KINDS

#: So large that no file is cut and no two share a task.
_WHOLE = {"spark.sql.files.maxPartitionBytes": str(1 << 40), "spark.sql.files.openCostInBytes": str(1 << 40)}
#: Entries in a batch that goes back to Spark.
ROWS = 1_000
#: Bytes of a file, as it is stored, that is handed over in one row, and of its text that are decoded at once.
SMALL, TEXT_BYTES = 16 << 20, 1 << 20
#: What of these is read in pieces all the same: compressed in ways that only Spark's reader knows.
_PACKED = r"\.(bz2|deflate|lz4|snappy|zst)$"
#: Objects above each other, the innermost the offers of a product: what is below is an entry's own.
DEEPEST = 4


class Decoder:
    """Follows a file that is fed piece by piece and cuts out its entries: kind, key and JSON text.

    Quotes and braces are found in whole pieces at a time; only braces above an entry's own are looked at one by one.
    """

    def __init__(self) -> None:
        self.held, self.seen, self.begin, self.depth = b"", 0, None, 0
        self.path: list[bytes] = []
        self.text = b'""'

    def _entry(self) -> str | None:
        """The kind of the entry that the current object is, if it is one."""
        if len(self.path) == 3 and self.path[1] == b'"products"':
            return "products"
        if len(self.path) == 4 and self.path[1] == b'"terms"' and (kind := self.path[2][1:-1].decode()) in KINDS:
            return kind
        return None

    def feed(self, more: str | bytes) -> Iterator[tuple[str, str, str]]:
        self.held += more.encode() if isinstance(more, str) else more
        held, start = self.held, self.seen
        bytes_ = np.frombuffer(held, np.uint8)[start:]
        quotes = _quotes(bytes_)
        end = len(bytes_)
        if len(quotes) % 2:  # a text whose end is not there yet
            quotes, end = quotes[:-1], int(quotes[-1])
        braces = np.flatnonzero((bytes_[:end] | 6) == 0x7F)  # {, } and two signs that are neither
        braces = braces[(bytes_[braces] == 0x7B) | (bytes_[braces] == 0x7D)]
        before = np.searchsorted(quotes, braces)
        outside = before % 2 == 0
        braces, before = braces[outside], before[outside]
        opens = bytes_[braces] == 0x7B
        depths = self.depth + np.cumsum(np.where(opens, 1, -1))
        depths -= np.minimum(np.minimum.accumulate(depths), 0)  # a brace that closes nothing is passed over
        if len(depths):
            self.depth = int(depths[-1])
        near = depths < np.where(opens, DEEPEST + 1, DEEPEST)
        for at, quoted, is_open in zip(braces[near].tolist(), before[near].tolist(), opens[near].tolist(), strict=True):
            if is_open:
                self.path.append(held[start + int(quotes[quoted - 2]) : start + int(quotes[quoted - 1]) + 1] if quoted else self.text)
                if self._entry():
                    self.begin = start + at
            else:
                if kind := self._entry():
                    yield kind, json.loads(self.path[-1]), held[self.begin : start + at + 1].decode()
                    self.begin = None
                if self.path:
                    self.path.pop()
        if len(quotes):
            self.text = held[start + int(quotes[-2]) : start + int(quotes[-1]) + 1]
        self.seen = start + end
        keep = self.seen if self.begin is None else self.begin
        self.held, self.seen = held[keep:], self.seen - keep
        self.begin = None if self.begin is None else 0


def _quotes(text: np.ndarray) -> np.ndarray:
    """Where quotes stand, but for those behind an odd number of backslashes."""
    quotes = np.flatnonzero(text == 0x22)
    slashes = text == 0x5C
    if not slashes.any():
        return quotes
    other = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(text))))  # the last sign that is no backslash
    return quotes[(quotes - 1 - np.where(quotes > 0, other[quotes - 1], -1)) % 2 == 0]


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, kind, sku, value) of pieces (file, value) in the order of their files."""
    return _in_batches(_of_pieces(batches))


def _decoded_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows of small files (file, content), compressed by gzip if they are named so."""

    def found() -> Iterator[tuple[str, str, str, str]]:
        for files in batches:
            for name, content in zip(*files.columns, strict=True):
                raw, decoder = pa.BufferReader(content.as_buffer()), Decoder()
                with gzip.open(raw) if name.as_py().endswith(".gz") else raw as text:
                    while more := text.read(TEXT_BYTES):
                        yield from ((name.as_py(), *entry) for entry in decoder.feed(more))

    return _in_batches(found())


def _in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*some, strict=True)], names=["file", "kind", "sku", "value"])


def _of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str, str]]:
    name, decoder = None, Decoder()
    for pieces in batches:
        files = pieces.column(0).dictionary_encode()
        for i, file in enumerate(files.dictionary.to_pylist()):
            if file != name:
                name, decoder = file, Decoder()
            mine = pieces.column(1) if len(files.dictionary) == 1 else pieces.column(1).filter(pc.equal(files.indices, i))
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(mine)], mine.cast(pa.binary())), b"}")[0].as_py()
            yield from ((name, *entry) for entry in decoder.feed(joined + b"}"))


def cut(spark: SparkSession, path: str, into: str, service: str | None = None) -> DataFrame:
    """Reads offer files (JSON, gzip or not) once and writes their entries to ``into``; returns these. They are of
    ``service``, or of the services that the files, or folders ``service=``, are named after."""
    before = {k: spark.conf.get(k, None) for k in _WHOLE}
    for k, v in _WHOLE.items():
        spark.conf.set(k, v)
    try:
        file, columns, of = F.input_file_name().alias("file"), "file string, kind string, sku string, value string", F.col("_metadata")
        small = (of["file_size"] <= SMALL) & ~of["file_path"].rlike(_PACKED)  # decided before files are opened
        whole = spark.read.format("binaryFile").load(path).where(small).select(file, "content").mapInArrow(_decoded_whole, columns)
        pieces = spark.read.option("lineSep", "}").text(path).where(~small).select(file, "value").mapInArrow(_decoded, columns)
        folder = F.regexp_extract("file", r"/service=([^/]+)/[^/]*$", 1)
        name = F.lit(service) if service else F.when(folder != "", folder).otherwise(F.regexp_extract("file", r"([^/]+?)(?:-[a-z]{2}(?:-[a-z]+)+-\d)?\.json(?:\.gz)?$", 1))
        found = whole.unionByName(pieces).withColumn("service", name)
        found.select(*ENTRY.fieldNames()).write.option("compression", "zstd").parquet(into)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(ENTRY).parquet(into)
