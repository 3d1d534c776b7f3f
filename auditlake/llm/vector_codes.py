"""Codes for vectors by product quantisation, learned on distinct parts.

Entries become whole numbers and vectors are cut into equal parts. At every position equal parts are counted, and Lloyd's rounds run over
these distinct parts with their counts as weights: each task assigns its parts to the nearest entry and gives sums by entry, Spark adds
them up, and only the sums of the codebooks (positions, entries and dimensions) reach the driver. Finally each distinct part's code and error
are joined back to the vectors. All of it is in whole numbers, so results don't depend on how rows are dealt out.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; shorter vectors count as if zeros followed, up to a multiple of the number of parts;
repeated rows count each; of repeated ids the smaller vector comes first in the first codebook, null ids come last; with fewer rows than entries the codebook has as many entries as
rows; null labels are one label; no rows give an empty result; other columns aren't read. An error too large for a long raises an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import located, materialise, small_enough
from .vectors import floored, matrix, padded, usable

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Entries up to this size have exact distances in 64 bits; larger ones take Python's numbers.
SAFE = 1 << 27


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (of equally near ones the first) and the squared distance, exactly."""
    if max(np.abs(parts.astype(np.float64)).max(initial=0), np.abs(book.astype(np.float64)).max(initial=0)) > SAFE:
        parts, book = parts.astype(object), book.astype(object)
    distance = np.stack([((parts - entry) ** 2).sum(axis=1) for entry in book], axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(parts)), best]


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """position x entry x dimension: the parts of the vectors with the smallest ids."""
    least = rows.select("at", "x").orderBy("at.none", "at.id", "x", "at.file", "at.row").limit(entries).collect()
    return np.array([r.x for r in least], dtype=np.int64).reshape(len(least), parts, -1).transpose(1, 0, 2)


def train(distinct: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weighted Lloyd rounds over distinct parts (position, part, weight); unused entries stay."""
    schema = "position int, entry int, j int, weight decimal(38,0), total decimal(38,0)"
    width = books.shape[2]
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    for _ in range(rounds):
        now = books

        def sums(batches, now=now):
            for batch in batches:
                if not batch.num_rows:
                    continue
                position, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(object)
                part = matrix(batch.column(1), width)
                columns: list[list] = [[] for _ in arrow.names]
                for p in np.unique(position).tolist():
                    own = np.flatnonzero(position == p)
                    best, _ = nearest(part[own], now[p])
                    for e in np.unique(best).tolist():
                        mine = own[best == e]
                        w = weight[mine]
                        for j, total in enumerate((part[mine].astype(object) * w[:, None]).sum(axis=0)):
                            for c, v in zip(columns, (p, e, j, int(w.sum()), int(total)), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), *(_decimals(c) for c in columns[3:])], schema=arrow)

        found = distinct.mapInArrow(sums, schema).groupBy("position", "entry", "j").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total")).collect()
        books = books.copy()
        for r in found:
            books[r.position, r.entry, r.j] = int(r.total) // int(r.weight)
    return books


def _decimals(values: list[int]) -> pa.Array:
    from decimal import Context, Decimal

    wide = Context(prec=40)
    return pa.array([wide.create_decimal(Decimal(v)) for v in values], pa.decimal128(38, 0))


def spelled(books: np.ndarray) -> str:
    """SHA-256 of all entries' numbers in decimal, by position, entry and dimension."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that has a usable vector."""
    vectors = located(vectors)
    id_type = vectors.schema[id_col].dataType.simpleString()
    at = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = materialise(vectors.filter(usable(vector_col)).select(at.alias("at"), F.col(label_col).alias("label"), floored(vector_col, scale).alias("x")), "vectors")
    rows, width = padded(rows, "x", parts)
    if not width:
        return vectors.sparkSession.createDataFrame([], f"{id_col} {id_type}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    size = width // parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("x", p * size + 1, F.lit(size)))
    pieces = materialise(rows.select("at", "label", F.posexplode(cut).alias("position", "part")), "pieces")
    distinct = materialise(pieces.groupBy("position", "part").agg(F.count("*").alias("weight")), "distinct")
    books = train(distinct, first_books(rows, parts, entries), rounds)

    schema = "position int, part array<bigint>, entry int, error bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            position, part = batch.column(0).to_numpy(), matrix(batch.column(1), size)
            entry, error = np.zeros(len(part), dtype=np.int32), np.zeros(len(part), dtype=object)
            for p in np.unique(position).tolist():
                entry[position == p], error[position == p] = nearest(part[position == p], books[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entry), pa.array(error.tolist(), pa.int64())], schema=arrow)

    codes = materialise(distinct.select("position", "part").mapInArrow(assign, schema), "codes")
    joined = pieces.join(codes.hint("merge"), ["position", "part"]).select("at", "label", "position", "entry", "error")
    of = F.array_sort(F.collect_list(F.struct("position", "entry")))
    coded = joined.groupBy("at").agg(of.alias("entries"), F.sum("error").alias("error"), F.min("label").alias("label"))
    digits = len(f"{entries - 1:x}") if entries > 256 else 2
    code = F.array_join(F.transform("entries", lambda e: F.lower(F.lpad(F.hex(e["entry"].cast("bigint")), digits, "0"))), "")
    coded = materialise(coded.select(F.col("at.id").alias("id"), code.alias("code"), "error", "label"), "coded")
    labels = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    labels = F.broadcast(labels) if small_enough(labels, 100) else labels.hint("merge")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(spelled(books)).alias("codebooks_sha256"))
