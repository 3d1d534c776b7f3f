"""Exact dedup by a streaming query with disk-backed keyed state.

Texts are normalised and hashed once, into a table of digest, id and locator (file and row). A stream takes that table's new files. Its
state, kept by RocksDB and never expired, holds for each digest the smallest id, the content's locator and the number of rows.
Partial aggregation makes at most one state update of a task's rows with equal digests, so one content held by a third of all rows
doesn't load one task. On hits the full bytes are compared with those at the retained locator; rows that differ under one digest
are grouped anew by their bytes. With a state folder all this stays between calls: another call hashes only files that no earlier call took in, reads only what
its own batches changed, and finds copies of all earlier rows. Files are known by their paths: one that is given again counts once, and so
does one whose call broke off after or before its stream ran, when the call is repeated.

Defined cases: files given with a state must stay as they are; null texts count as empty; null ids come after all others; of repeated rows with one id the first by
locator stays; an empty table gives an empty result; other columns aren't read. A later call's smaller id takes over its group: that
call's result names the new row, results already given aren't recalled.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WS_CLASS, drop_path, located, materialise, new_path, small_enough, text_of

#: RocksDB with logged changes. Space isn't allocated ahead, since many partitions hold little state each.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
DIGEST_BYTES, FILES_PER_BATCH = 32, 4096


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_of(text_col), WS_CLASS + "+", " ")


@contextmanager
def settings(spark: SparkSession, **values: str):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _place() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """at (id and locator, in the order in which rows are kept) and the SHA-256 of every text."""
    at = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(at.alias("at"), F.unhex(F.sha2(normalised(text_col), 256)).alias("sha256"))


class Deduplicator:
    """The state in a folder: digests of all rows taken in, the stream's checkpoint, and what each of its batches changed."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES, files_per_batch: int = FILES_PER_BATCH):
        self.spark, self.folder, self.id_col, self.text_col, self.digest_bytes, self.files_per_batch = spark, folder, id_col, text_col, digest_bytes, files_per_batch

    def take(self, docs: DataFrame) -> tuple[DataFrame, bool]:
        """Take in rows of files that aren't known yet; at, sha256 of all rows, and whether some were known. docs must come from files that stay where they are.

        Digests are written before the files count as known, into a folder that is named by the files, so a call that broke off between the two writes the same folder anew.
        """
        files = docs.select(F.col("_metadata.file_path").alias("file")).distinct()
        known = self.sources()
        fresh = materialise(files.join(known, "file", "left_anti"), "fresh")
        n, name = fresh.agg(F.count("*"), F.hex(F.coalesce(F.bit_xor(F.xxhash64("file")), F.lit(0)))).first()
        rows = digests(docs, self.id_col, self.text_col)
        if n:
            folder = f"{self.folder}/digests/{n}-{name}"
            new = rows.join(F.broadcast(fresh) if small_enough(fresh, 400) else fresh.hint("merge"), F.col("at.file") == F.col("file"), "left_semi")
            new.write.mode("overwrite").option("compression", "zstd").parquet(folder)
            fresh.select("file", F.lit(f"{n}-{name}").alias("folder")).coalesce(1).write.mode("append").parquet(f"{self.folder}/sources")
        folders = [r["folder"] for r in self.sources().join(files, "file", "left_semi").select("folder").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], rows.schema), False
        taken = self.spark.read.schema(rows.schema).parquet(*(f"{self.folder}/digests/{x}" for x in folders))
        some_known = n < files.count()
        return (taken.join(files, F.col("at.file") == F.col("file"), "left_semi") if some_known else taken), some_known

    def sources(self) -> DataFrame:
        """file, folder: what was taken in, and the folder of its digests."""
        try:
            return self.spark.read.schema("file string, folder string").parquet(f"{self.folder}/sources")
        except AnalysisException:
            return self.spark.createDataFrame([], "file string, folder string")

    def advance(self, schema: StructType, everything: bool) -> DataFrame:
        """Run the stream over all that was taken in since; the newest state of each digest: digest, kept, n. Without `everything`, only of digests that this call's batches changed."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(f"{self.folder}/digests/*")
        state = stream.groupBy(self.key().alias("digest")).agg(F.min("at").alias("kept"), F.count("*").alias("n"))
        shape = StructType([*state.schema.fields, StructField("batch", LongType())])
        ran: list[int] = []

        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/updates/number={number}")
            ran.append(number)

        with settings(self.spark, **STATE_STORE):
            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
            query.awaitTermination()
        paths = ["*"] if everything else sorted(set(ran))
        if not paths:
            return self.spark.createDataFrame([], state.schema)
        try:
            newest = self.spark.read.schema(shape).parquet(*(f"{self.folder}/updates/number={k}" for k in paths))
        except AnalysisException:  # nothing was ever taken in
            return self.spark.createDataFrame([], state.schema)
        return newest.groupBy("digest").agg(F.max_by(F.struct("kept", "n"), "batch").alias("s")).select("digest", "s.kept", "s.n")

    def key(self) -> Column:
        return F.substring("sha256", 1, self.digest_bytes)

    def texts(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """The columns of wanted (with a locator in at) and the normalised text there."""
        columns = wanted.columns
        held = docs.select(_place().alias("place"), F.col(self.text_col).alias("held"))
        side = wanted.withColumn("place", F.struct("at.file", "at.row"))
        side = F.broadcast(side) if small_enough(side, 400) else side.hint("merge")
        return held.join(side, "place").select(*columns, normalised("held").alias("text"))

    def files_of(self, wanted: DataFrame, docs: DataFrame) -> DataFrame:
        """The texts in the files of wanted's locators alone; as many paths as one read lists."""
        places = [r["file"] for r in wanted.select("at.file").distinct().collect()]
        return self.spark.read.schema(docs.select(self.text_col).schema).parquet(*places) if places else docs

    def decide(self, docs: DataFrame) -> DataFrame:
        """Take in docs: at, sha256, kept (id and locator of the row that stays) and n of every row of them."""
        rows, some_known = self.take(docs)
        state = materialise(self.advance(rows.schema, some_known), "dedup-kept")
        keyed = rows.withColumn("digest", self.key())
        out = materialise(keyed.join(state.hint("merge"), "digest"), "dedup-rows")
        columns = ["at", "sha256", "kept", "n"]

        # Full bytes are compared on hits only: new rows that don't stay, with the text at the retained locator.
        hits = out.filter("n > 1 AND at <> kept").select("at", "digest")
        kept = out.filter("n > 1").select(F.col("kept").alias("at"), "digest").distinct()
        held = self.texts(self.files_of(kept, docs), kept).select("digest", F.col("text").alias("held"))
        wrong = materialise(self.texts(docs, hits).join(held.hint("merge"), "digest").filter("text <> held").select("digest"), "dedup-wrong").distinct()
        if wrong.isEmpty():
            return out.select(columns)
        mixed = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/digests/*").withColumn("digest", self.key()).join(wrong, "digest", "left_semi")
        mixed = materialise(self.texts(self.files_of(mixed, docs), mixed), "dedup-mixed")
        anew = mixed.groupBy("digest", "text").agg(F.min("at").alias("kept"), F.count("*").alias("n"))
        right = out.join(wrong, "digest", "left_anti").select(columns)
        again = mixed.join(anew, ["digest", "text"]).join(out.select(F.col("at").alias("own")).distinct(), F.col("at") == F.col("own"), "left_semi")
        return right.unionByName(again.select(columns))


def _rows_of(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    return spark.read.parquet(source) if isinstance(source, str) else located(source)


def exact_dedup(spark: SparkSession, source: str | DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES, files_per_batch: int = FILES_PER_BATCH, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of the source (a path, or rows).

    state: a shared folder that keeps the state between calls; without it one is made and dropped. digest_bytes shortens the state's keys;
    results don't depend on it.
    """
    out = _decide(spark, _rows_of(spark, source), id_col, text_col, digest_bytes, files_per_batch, state)
    return out.select(
        F.col("at.id").alias("doc_id"), F.col("kept.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("kept")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = FILES_PER_BATCH, state: str | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    docs = located(docs)
    gone = _decide(docs.sparkSession, docs, id_col, text_col, DIGEST_BYTES, files_per_batch, state).filter("at <> kept").select("at.file", "at.row")
    gone = materialise(gone.select(F.struct("file", "row").alias("place")), "gone")
    placed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), _place().alias("place"))
    return placed.join(F.broadcast(gone) if small_enough(gone, 400) else gone.hint("merge"), "place", "left_anti").select("whole.*")


def _decide(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, digest_bytes: int, files_per_batch: int, state: str | None) -> DataFrame:
    folder = state or new_path(spark, "dedup-state")
    out = Deduplicator(spark, folder, id_col, text_col, digest_bytes, files_per_batch).decide(docs)
    if state is None:
        out = materialise(out, "dedup")
        drop_path(spark, folder)
    return out
