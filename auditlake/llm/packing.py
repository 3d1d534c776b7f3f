"""Best-fit packing of token pieces into fixed sequences, with certified bin counts.

Each partition packs its pieces by best-fit decreasing and compares its bin count with lower bounds from
dual-feasible functions. A partition that meets its bound is certified and rests. The others release the pieces of
their bins that aren't full; released pieces meet in fewer partitions and are packed again, until a round saves no bin. The
result's own certificate compares its sequences with the bound of all lengths together.

Defined cases: a null or empty text is one piece with the end id alone; repeated rows are packed once a row; ties in
length are broken by id and piece; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import bpe
from .common import materialise

CAPACITY = 2048
#: Pieces that one task packs; a partition never holds many more.
PIECES_PER_TASK = 60_000


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones from the end on, the first takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of every document. row_key tells repeated rows with one id apart."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, row_key bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        c = bpe.codec(tokenizer)
        for batch in chain.from_iterable(bpe.portions(b, 2) for b in batches):
            out = {k: [] for k in arrow.names}
            e = c.encode_column(batch.column(2))
            for r, (i, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = np.append(e.ids[e.start[r] : e.start[r + 1]], end_id).astype("<u4")
                for k, (start, length) in enumerate(cut(len(raw), capacity)):
                    out["doc_id"].append(i)
                    out["row_key"].append(key)
                    out["piece"].append(k)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(raw[start : start + length].tobytes()))
                    if with_ids:
                        out["ids"].append(raw[start : start + length].tolist())
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return docs.select(F.col(id_col), F.monotonically_increasing_id(), F.col(text_col)).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Lengths must be in descending order."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: some bin has room r
    for k, length in enumerate(lengths.tolist()):
        if fit := rooms >> length:
            room = (fit & -fit).bit_length() - 1 + length
            at = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at, n = capacity, n, n + 1
        bins[k], offsets[k] = at, capacity - room
        if left := room - length:
            with_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets, n


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins by dual-feasible functions; counts[l] pieces have length l.

    Used are the identity, the thresholding functions (pieces over capacity - t count as whole, under t as nothing) and
    the rounding functions u_k (x -> floor((k + 1) x) / k, whole multiples as they are). Each maps lengths that fit into
    one bin to at most one bin.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    many, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * size)])
    t = np.arange(1, capacity // 2 + 1)
    whole = many[-1] - many[capacity - t + 1]
    middle = total[capacity - t + 1] - total[t]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 33):
        scaled = (k + 1) * size
        weight = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # over k * capacity
        best = max(best, -(-int((counts * weight).sum()) // (k * capacity)))
    return best


def _packer(base: int, capacity: int):
    """Packs one partition; its first row carries the bin count, the bound and how many bins it releases."""

    def run(key, pdf):
        pdf = pdf.drop(columns="dealt").sort_values(["length", "doc_id", "row_key", "piece"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used)
        loose = fill < capacity
        if used == bound:  # certified: all stays but the emptiest bin, which may still share one with another partition's
            loose &= np.arange(used) == np.argmin(fill)
        counts = np.zeros((3, len(pdf)), dtype=np.int64)
        counts[:, 0] = used, bound, loose.sum()
        return pdf.assign(sequence_id=base + (int(key[0]) << 24) + bins, offset=offsets, released=loose[bins], n_bins=counts[0], n_bound=counts[1], n_released=counts[2])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK) -> tuple[DataFrame, list[dict]]:
    """sequence_id and offset for each row of items (a written table with doc_id, row_key, piece, length), and what each round certified.

    Pieces as long as a sequence fill one each. The others are dealt out by hash, packed and certified in rounds.
    """
    columns = items.columns
    n, whole = items.agg(F.count("*"), F.count_if(F.col("length") == capacity)).first()
    full = items.filter(F.col("length") == capacity)
    done = [full.withColumns({"sequence_id": F.monotonically_increasing_id() + F.lit(1 << 62), "offset": F.lit(0).cast("bigint")})]
    extra = ["sequence_id bigint", "offset bigint", "released boolean", "n_bins bigint", "n_bound bigint", "n_released bigint"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in items.schema), *extra])
    todo, left, before, held, log = items.filter(F.col("length") < capacity), n - whole, None, None, []
    for turn in count():
        if not left:
            break
        parts = -(-left // per_task)
        dealt = todo.withColumn("dealt", F.pmod(F.xxhash64(F.lit(turn), "row_key", "piece"), F.lit(parts)))
        packed = materialise(dealt.groupBy("dealt").applyInPandas(_packer(turn << 52, capacity), schema), "packed")
        used, bound, free, left = packed.agg(F.sum("n_bins"), F.sum("n_bound"), F.sum("n_released"), F.count_if("released")).first()
        log.append({"round": turn, "partitions": parts, "bins": used, "bound": bound})
        if before is not None and used >= before:
            break  # packing the released pieces again saved nothing: their former bins stay
        placed = [*columns, "sequence_id", "offset"]
        done.append(packed.filter(~F.col("released")).select(placed))
        held, before = packed.filter("released").select(placed), free
        todo = held.select(columns)
        if free <= 1:
            break
    if held is not None:
        done.append(held)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, log


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences the packed rows fill, and the fewest that any packing of their lengths can do with. At most capacity counts are collected."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Pack every document's ids, each followed by end_id; documents over the capacity are cut into pieces."""
    table = materialise(pieces(docs, tokenizer or bpe.default_tokenizer(), end_id, capacity), "pieces")
    return pack(table, capacity, per_task)[0].drop("row_key")
