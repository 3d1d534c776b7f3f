"""Token counts from flat token files that have no index: only end-of-document ids tell where a document ends.

Token files hold unsigned little-endian ids, of two bytes where the vocabulary leaves the greatest value free and of four
otherwise; each document is followed by that greatest value. Files are cut into blocks of equal size, wherever those fall, and
blocks are dealt out over tasks, so one large file is read by many. A block finds its ends in one vectorised search and knows nothing
of other blocks. A prefix scan over a file's blocks (number of ends so far, last end so far) gives each document its ordinal
and, where it reaches over block edges, its first token.

The writer keeps a table beside the files that tells which document was written as which file's n-th. It names the
counted documents; ends are found by the search alone.

Defined cases: a null or empty text has 0 tokens; a null id stays null; repeated rows are counted once a row; an empty table gives no files and
an empty result; tokens after a file's last end count as one unfinished document, finished = false; a file of a lost
attempt is in no table and isn't read.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import bpe
from .common import make_folder, materialise, new_path

BLOCK_TOKENS = 1 << 21
#: Bytes of blocks that one task reads.
TASK_BYTES = 64 << 20


def token_type(vocabulary: int) -> np.dtype:
    """The narrower type whose greatest value is no id."""
    if vocabulary >= 1 << 32:
        raise ValueError(f"{vocabulary} ids do not fit into four bytes")
    return np.dtype("<u2" if vocabulary < 1 << 16 else "<u4")


def end_of(kind: np.dtype) -> int:
    return int(np.iinfo(kind).max)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a path or URI of the shared folder."""
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://")) if ":" in path.split("/")[0] else (pa.fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Flat token files in the folder path, one a task. Returns file, shard, ordinal, doc_id of every row of docs, in the order written."""
    tokenizer = tokenizer or bpe.default_tokenizer()
    make_folder(docs.sparkSession, path)
    schema = f"file string, shard string, ordinal bigint, doc_id {docs.schema[id_col].dataType.simpleString()}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        c = bpe.codec(tokenizer)
        kind = token_type(c.size)
        shard, out, n = f"shard-{TaskContext.get().partitionId():05d}", None, 0
        file = f"{shard}-{uuid.uuid4().hex}.tokens"  # another attempt writes another file
        fs, folder = file_system(path)
        for batch in chain.from_iterable(bpe.portions(b, 1) for b in batches):
            out = out or fs.open_output_stream(f"{folder}/{file}")
            e = c.encode_column(batch.column(1))
            ends = e.start[1:] + np.arange(batch.num_rows)
            flat = np.empty(len(e.ids) + batch.num_rows, dtype=kind)
            own = np.ones(len(flat), dtype=bool)
            own[ends] = False
            flat[own], flat[ends] = e.ids, end_of(kind)
            out.write(flat)
            yield pa.RecordBatch.from_arrays([pa.array([file] * batch.num_rows), pa.array([shard] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows)), batch.column(0)], schema=arrow)
            n += batch.num_rows
        if out:
            out.close()

    return materialise(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema), "written")


def scan_block(data, kind: np.dtype, end_id: int) -> np.ndarray:
    """Places of the ends in one block's bytes."""
    return np.flatnonzero(np.frombuffer(data, dtype=kind) == end_id)


def count_tokens(spark: SparkSession, path: str, kind: np.dtype, end_id: int | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the folder's token files: file, ordinal in it, first token's place, n_tokens, finished."""
    end_id = end_of(kind) if end_id is None else end_id
    width = kind.itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(path)
    files = files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes")).filter("bytes > 0")
    tasks = max(spark.sparkContext.defaultParallelism, -(-(files.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    dealt = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(bytes - 1) div {block * width}"))).alias("block"))
    schema = "file string, block bigint, total bigint, ends array<bigint>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        fs, folder = file_system(path)
        for batch in batches:
            for name, size, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    data = f.read_at(min(block * width, size - k * block * width), k * block * width)
                ends = scan_block(data[: len(data) // width * width], kind, end_id) + k * block
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k]), pa.array([size // width]), pa.array([ends], pa.list_(pa.int64()))], schema=arrow)

    blocks = materialise(dealt.repartition(tasks, "file", "block").mapInArrow(run, schema), "blocks")
    # Only counts and last ends go through the scan over a file's blocks; the ends stay where they are.
    in_order = Window.partitionBy("file").orderBy("block")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, -1)
    narrow = blocks.select("file", "block", F.size("ends").alias("n"), F.get("ends", F.size("ends") - 1).alias("last"))
    offsets = narrow.select(
        "file", "block", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(so_far), F.lit(-1)).alias("before"), F.lead("block").over(in_order).isNull().alias("final"),
    )
    scanned = blocks.join(materialise(offsets, "offsets"), ["file", "block"]).withColumn("last", F.get("ends", F.size("ends") - 1))
    documents = scanned.select("file", "base", "before", "ends", F.posexplode("ends").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("before")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    documents = documents.select("file", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), F.lit(True).alias("finished"))
    open_at = F.coalesce("last", "before") + 1
    unfinished = scanned.filter(F.col("final") & (F.col("total") > open_at))
    return documents.unionByName(unfinished.select("file", (F.col("base") + F.size("ends")).alias("ordinal"), open_at.alias("start"), (F.col("total") - open_at).alias("n_tokens"), F.lit(False).alias("finished")))


def document_token_counts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, shard, ordinal, start, n_tokens, finished of every row, counted from the flat files written of it."""
    tokenizer = tokenizer or bpe.default_tokenizer()
    path = new_path(docs.sparkSession, "tokens")
    written = write_token_files(docs, path, tokenizer, id_col, text_col)
    counted = count_tokens(docs.sparkSession, path, token_type(bpe.codec(tokenizer).size), block=block)
    return written.join(counted, ["file", "ordinal"]).select("doc_id", "shard", "ordinal", "start", "n_tokens", "finished")
