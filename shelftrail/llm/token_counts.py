"""Token counts by a separator scan over flat token files.

`write_token_files` lays every document's ids down as little-endian numbers of two bytes (four, if the vocabulary needs
them), each document ended by the end-of-document id: flat files without an index. `count_tokens` finds the documents
again. Files are only listed; their byte ranges are dealt out as blocks, each task opens the file, seeks and reads one
block at a time, and a block is searched for the separator in one vectorised pass. Documents are completed across block
borders by a prefix scan over block summaries (documents and tokens before the block, tokens since the last separator).
Blocks, not documents or files, are the unit of work and of memory. A store whose scheme the Arrow library cannot open
is read by Spark in whole files, which `write_token_files` keeps to `FILE_BYTES` or one document.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each; tokens behind the last separator of a
file are one more document; last bytes that make no whole id are ignored; empty files and tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import in_pieces, map_arrow
from . import bpe
from ._common import fresh_path, materialise

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The id behind its last rank.
END_OF_DOCUMENT = 50256
BLOCK_BYTES = 1 << 20
#: A task of the scan reads blocks of about so many bytes in all.
TASK_BYTES = 32 << 20
#: Documents are written together in records of about so many bytes, some to a file.
RECORD_BYTES, RECORDS_PER_FILE = 4 << 20, 16
FILE_BYTES = RECORD_BYTES * RECORDS_PER_FILE
#: What the size of a scan's splits follows, by default the cores of the moment.
SPLITS = "spark.sql.files.minPartitionNum"


def end_of_document(vocabulary: str = VOCABULARY) -> int:
    """The id behind the last rank."""
    return len(bpe.encoder(vocabulary).bytes_of)


def id_bytes(end: int) -> int:
    return 2 if end < 1 << 16 else 4


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """The ids of `docs.text`, one file or more per partition, in row order.

    Spark's text sink writes a row's bytes and then the line separator as they are: documents and the end-of-document id.
    """
    last = end_of_document(vocabulary)
    width = id_bytes(last)
    end = last.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, size = bpe.encoder(vocabulary), [], 0
        for b in in_pieces(batches):
            for t in b.column(0).to_pylist():
                ids = enc.encode(t or "").astype(f"<u{width}").tobytes()
                if held and size + len(ids) > RECORD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], names=["ids"])
                    held, size = [], 0
                held.append(ids)
                size += len(ids) + width
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], names=["ids"])

    flat = map_arrow(docs.select(F.col("text").cast("string")), run, "ids binary").select(F.col("ids").cast("string"))
    flat.write.option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_BLOCK = "path string, block long, tokens long, n_ends long, tail long, lengths array<long>"


def _search(found: Iterator[tuple[str, int, memoryview]], end: int) -> Iterator[pa.RecordBatch]:
    """A row per block: its tokens, separators, tokens behind the last one, and the lengths that end in it."""
    schema = pa.schema([(n, pa.string() if n == "path" else pa.list_(pa.int64()) if n == "lengths" else pa.int64()) for n in ("path", "block", "tokens", "n_ends", "tail", "lengths")])
    width = id_bytes(end)
    for path, block, raw in found:
        ids = np.frombuffer(raw, f"<u{width}", count=len(raw) // width)
        ends = np.flatnonzero(ids == end)
        lengths = np.diff(ends, prepend=-1) - 1  # the first is what of it lies in this block
        tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
        yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "tokens": [len(ids)], "n_ends": [len(ends)], "tail": [tail], "lengths": [lengths]}, schema=schema)


def _opens(path: str) -> bool:
    """Whether Arrow has a file system for the path's scheme, so that a task can seek in the file."""
    try:
        pyarrow.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _uri(path: str) -> str:
    """Hadoop's unescaped `file:/x y` as other libraries write it."""
    plain = quote(path, safe="/:@")
    return plain.replace("file:/", "file:///", 1) if plain.startswith("file:/") and not plain.startswith("file://") else plain


def scan_blocks(spark: SparkSession, path: str, end: int, block_bytes: int) -> DataFrame:
    """One row per block of each file below `path`."""
    step = max(1, block_bytes // id_bytes(end)) * id_bytes(end)
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    some = files.select("path").first()
    if some is None or not _opens(_uri(some.path)):

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = memoryview(content.as_buffer())  # a view: blocks are not copied
                    yield from _search(((name, k, raw[at : at + step]) for k, at in enumerate(range(0, len(raw), step))), end)

        return map_arrow(files.select("path", "content"), whole, _BLOCK)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(name: str, k: int) -> memoryview:
            store, inside = pyarrow.fs.FileSystem.from_uri(_uri(name))
            with store.open_input_file(inside) as f:
                f.seek(k * step)
                return memoryview(f.read(step))

        for b in batches:
            yield from _search(((name, k, read(name, k)) for name, k in zip(*(c.to_pylist() for c in b.columns), strict=True)), end)

    total = files.agg(F.sum("length")).first()[0]
    blocks = files.select("path", F.explode(F.expr(f"sequence(0L, (length - 1) div {step})")).alias("block"))
    return map_arrow(blocks.repartition(max(1, -(-total // TASK_BYTES)), "path", "block"), ranges, _BLOCK)


def count_tokens(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, end: int = END_OF_DOCUMENT) -> DataFrame:
    """(path, ordinal, n_tokens) for every document of the token files in a folder; ordinals count from 0 in a file."""
    found = materialise(scan_blocks(spark, path, end, block_bytes), "token_blocks")
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    some = F.col("n_ends") > 0
    upto = found.drop("lengths").withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    upto = upto.withColumn("after_last", F.when(some, F.col("start") + F.col("tokens") - F.col("tail")))
    upto = upto.withColumn("first_ordinal", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn(
        "carried", F.col("start") - F.coalesce(F.max("after_last").over(before), F.lit(0))
    )
    rest = F.when(F.lead("block").over(order).isNull(), F.col("tail") + F.when(some, 0).otherwise(F.col("carried"))).otherwise(0)
    upto = upto.select("path", "block", "first_ordinal", "carried", rest.alias("rest"))
    pieces = F.transform("lengths", lambda x, i: F.when(i == 0, x + F.col("carried")).otherwise(x))
    pieces = F.when(F.col("rest") > 0, F.concat(pieces, F.array("rest"))).otherwise(pieces)
    docs = found.select("path", "block", "lengths").join(upto, ["path", "block"]).select("path", "first_ordinal", F.posexplode(pieces).alias("i", "n_tokens"))
    return docs.select("path", (F.col("first_ordinal") + F.col("i")).alias("ordinal"), "n_tokens")


def document_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row of `docs`, through token files in the shared folder.

    A file's n-th document is the n-th row of the partition that wrote it, so `docs` must be a plain scan or a written
    table, whose partitions hold the same rows in the same order each time. The places of the doc_ids are written down
    under the same number of splits as the tokens, whatever executors come or go, and each place must have its count.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    row = F.monotonically_increasing_id()
    order = docs.select("doc_id", F.shiftright(row, 33).cast("int").alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    was = spark.conf.get(SPLITS, None)
    if was is None:  # else Spark takes the cores that are there when it plans
        spark.conf.set(SPLITS, str(spark.sparkContext.defaultParallelism))
    try:
        write_token_files(docs, path, vocabulary)
        order = materialise(order, "token_order")
    finally:
        if was is None:
            spark.conf.unset(SPLITS)
    found = materialise(count_tokens(spark, path, end=end_of_document(vocabulary)), "token_counts")
    number = lambda pattern: F.coalesce(F.regexp_extract("path", pattern, 1).try_cast("int"), F.lit(0))
    files = found.groupBy("path").agg(F.count("*").alias("docs"))
    files = files.withColumns({"part": number(r"part-(\d+)-[^/]*$"), "file": number(r"-c(\d+)[^/-]*$")})
    earlier = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("first", F.coalesce(F.sum("docs").over(earlier), F.lit(0)))
    placed = found.join(files.select("path", "part", "first"), "path").select("part", (F.col("first") + F.col("ordinal")).alias("at"), "n_tokens")
    rows = order.groupBy("part").count().join(files.groupBy("part").agg(F.sum("docs").alias("docs")), "part", "full")
    if not rows.where("not (count <=> docs)").isEmpty():
        raise RuntimeError("token files and documents differ in their numbers of rows; docs must be a plain scan")
    return order.join(placed, ["part", "at"]).select("doc_id", "n_tokens")
