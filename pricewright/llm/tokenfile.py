"""Token-ID output: Arrow files of fixed-size-list batches (equal-length sequences with masks), read back in place.

``write`` orders the documents by id with one range exchange, and each task encodes its range and writes one Arrow
file: rows of ``seq_len`` ids as a fixed-size list, a byte mask of the same shape, and a last row padded with mask 0.
A second small file holds the range's documents (doc_id, first id within the file, number of ids). Files are not
compressed and batches hold equally many sequences, so a reader maps a file and any sequence is a slice of the mapping
at a place that its number gives. A task writes under a name of its own
and then renames, so a repeated task cannot leave half a file.

Cases: null texts are empty (they still hold the end id); null doc_ids come first; rows that share a doc_id stand
next to each other in an order fixed by their texts, and so do repeated rows, which are written each; an empty table gives
no file and no row; other columns of the input play no part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm.common import bounded_batches, documents, new_path, saved, squeezed
from pricewright.llm.textkernel import unsqueeze
from pricewright.llm.tokens import default_path, encoder

SEQ_LEN, END_ID = 2048, 1
_INDEX = "shard string, part int, n_docs long, n_ids long, first_doc long, last_doc long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


#: What Hadoop calls stores that Arrow opens by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "wasbs": "abfss", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def arrow_uri(path: str) -> str:
    """The URI by which Arrow opens what Spark calls ``path``. What it can't open is an error before any task runs."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return f"file://{path}"
    if scheme not in _SCHEMES:
        raise ValueError(f"token files can't be written to {scheme}: spark.checkpoint.dir must be in one of {', '.join(sorted(_SCHEMES))}")
    return f"{_SCHEMES[scheme]}:{rest}"


def _open(path: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(path))


class SequenceWriter:
    """One Arrow file of equal-length sequences and masks, in batches of ``rows`` sequences but for the last."""

    def __init__(self, sink, seq_len: int, dtype: type, rows: int = 512):
        self.ids, self.mask = pa.list_(pa.from_numpy_dtype(dtype), seq_len), pa.list_(pa.uint8(), seq_len)
        self.seq_len, self.dtype, self.rows, self.left, self.n = seq_len, dtype, rows, [], 0
        self.writer = pa.ipc.new_file(sink, pa.schema([("ids", self.ids), ("mask", self.mask)], metadata={"rows": str(rows)}))

    def add(self, ids: np.ndarray) -> None:
        self.left.append(ids.astype(self.dtype))
        self.n += len(ids)
        step = self.seq_len * self.rows
        if self.n >= step:
            flat = np.concatenate(self.left)
            for i in range(0, self.n - self.n % step, step):
                self._batch(flat[i : i + step], step)
            self.left, self.n = [flat[self.n - self.n % step :]], self.n % step

    def _batch(self, ids: np.ndarray, n: int) -> None:
        """Writes ``ids``, of which the first ``n`` are no padding."""
        mask = (np.arange(len(ids)) < n).astype(np.uint8)
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), type=self.ids), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.mask)], names=["ids", "mask"]))

    def close(self) -> None:
        if self.n:
            self._batch(np.pad(np.concatenate(self.left), (0, -self.n % self.seq_len)), self.n)
        self.writer.close()


def write(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, seq_len: int = SEQ_LEN) -> DataFrame:
    """Encode and write all ``docs`` (doc_id, text); returns a row per file: shard, part (its place), n_docs, n_ids, first_doc, last_doc."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_path()
    bounded_batches(spark)
    _open(out)[0].create_dir(_open(out)[1], recursive=True)
    numbered = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))  # equal rows, too, may be split
    ordered = squeezed(numbered).repartitionByRange("doc_id", "_h", "_n").sortWithinPartitions("doc_id", "_h", "_z")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, files, name = encoder(tokenizer), None, uuid.uuid4().hex
        filesystem, base = _open(out)
        n_docs, n_ids, first, last = 0, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                sinks = [filesystem.open_output_stream(f"{base}/_{name}.{kind}") for kind in ("ids", "docs")]
                files = SequenceWriter(sinks[0], seq_len, enc.dtype)
                index = pa.ipc.new_file(sinks[1], _DOCS)
                first = batch.column(0)[0].as_py()
            ids, offsets = enc.encode_ended(unsqueeze(batch.column(3)), end_id)
            files.add(ids)
            index.write_batch(pa.record_batch([batch.column(0), pa.array(offsets[:-1] + n_ids), pa.array(np.diff(offsets))], schema=_DOCS))
            n_docs, n_ids, last = n_docs + batch.num_rows, n_ids + len(ids), batch.column(0)[batch.num_rows - 1].as_py()
        if files is not None:
            files.close()
            index.close()
            for sink in sinks:
                sink.close()
            for kind in ("docs", "ids"):
                filesystem.move(f"{base}/_{name}.{kind}", f"{base}/{name}.{kind}")
            yield pa.record_batch([pa.array([name]), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n_docs]), pa.array([n_ids]), pa.array([first], pa.int64()), pa.array([last], pa.int64())], names=["shard", "part", "n_docs", "n_ids", "first_doc", "last_doc"])

    return saved(ordered.mapInArrow(task, _INDEX), "shards")


class TokenFile:
    """Random access to a file that ``write`` made. A file on this machine is mapped, and what is returned are views of the
    mapping; of another store, the batch that is asked for is read."""

    def __init__(self, out: str, shard: str):
        from pyarrow import fs

        filesystem, base = _open(out)
        local = isinstance(filesystem, fs.LocalFileSystem)
        open_ = lambda kind: pa.ipc.open_file(pa.memory_map(f"{base}/{shard}.{kind}") if local else filesystem.open_input_file(f"{base}/{shard}.{kind}"))
        self.reader, self.docs = open_("ids"), open_("docs")
        self.seq_len, self.rows = self.reader.schema.field("ids").type.list_size, int(self.reader.schema.metadata[b"rows"])

    def __len__(self) -> int:
        """The number of sequences."""
        n = self.reader.num_record_batches
        return 0 if not n else (n - 1) * self.rows + self.reader.get_batch(n - 1).num_rows

    def _views(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return tuple(batch.column(c).flatten().to_numpy(zero_copy_only=True).reshape(-1, self.seq_len) for c in (0, 1))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (1, and 0 for padding) of the sequence number ``i``."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        ids, mask = self._views(self.reader.get_batch(i // self.rows))
        return ids[i % self.rows], mask[i % self.rows]

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and mask of each batch, a row for each sequence."""
        for i in range(self.reader.num_record_batches):
            yield self._views(self.reader.get_batch(i))


def digests(out: str, shard: str) -> Iterator[pa.RecordBatch]:
    """From a shard's files: doc_id, start within the shard, n_tokens, ids_crc32, a document's ids met in order."""
    file = TokenFile(out, shard)
    pieces = (ids[mask > 0].astype("<u4") for ids, mask in file.batches())
    have = np.zeros(0, "<u4")
    for k in range(file.docs.num_record_batches):
        index = file.docs.get_batch(k)
        crcs = []
        for n in index.column(2).to_pylist():
            while len(have) < n:
                have = np.concatenate([have, next(pieces)])
            crcs.append(zlib.crc32(have[:n].tobytes()))
            have = have[n:]
        yield pa.record_batch([index.column(0), index.column(1), index.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, out: str, shards: DataFrame) -> DataFrame:
    """Read the files back, a task for each: doc_id, start (in the whole corpus), n_tokens, ids_crc32.

    The start of each file is a running sum over one row per file; their number is that of the writing tasks.
    """
    rows = sorted(shards.select("part", "shard", "n_ids").collect())
    base = np.cumsum([0, *(r.n_ids for r in rows)]).tolist()
    listed = spark.createDataFrame([(r.shard, b) for r, b in zip(rows, base[:-1], strict=True)], "shard string, base long").repartition(max(1, len(rows)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for found in digests(out, shard):
                    yield found.set_column(1, "start", pa.array(found.column(1).to_numpy() + at))

    return listed.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as Arrow token files in the shared folder and returns what is read back from them."""
    out = new_path(spark, "tokens")
    return read_digests(spark, out, write(documents(spark, sf_dir), out))
