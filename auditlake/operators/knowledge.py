"""Choosing knowledge for texts: hints, relevance, packs, stacks."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .packing import greedy

#: Impact from the gravest on.
IMPACTS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
MOST_CLASSES, PACK_CHARS = 4, 6000


#: Hints that one automaton holds; more take several passes over the texts.
HINTS_PER_PASS = 100_000


def select_hints(texts: DataFrame, hints: DataFrame, id_col: str, text_col: str, per_pass: int = HINTS_PER_PASS) -> DataFrame:
    """text_id, id, longest, matches: per text and class, the longest matched hint's length and how many match. A hint matches where a text contains it, whatever the case.

    All hints go into one Aho-Corasick automaton that each task builds once and runs over its texts as they are read: no text is shuffled or split into words. Hints are dealt
    into passes by their hash, so what is sent to tasks at a time is bounded. Null texts and null or empty hints match nothing; hints that a class has twice count twice.
    """
    keyed = hints.filter(F.length("hint") > 0).select("id", F.lower("hint").alias("hint"))
    passes = max(1, -(-keyed.count() // per_pass))
    held = texts.select(F.col(id_col).alias("text_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    id_type = hints.schema["id"].dataType.simpleString()
    schema = StructType([held.schema["text_id"], *StructType.fromDDL(f"id {id_type}, longest bigint, matches bigint").fields])
    out = None
    for k in range(passes):
        rows = keyed.filter(F.pmod(F.xxhash64("hint"), F.lit(passes)) == k).collect()
        found = _matched(held, [(r["id"], r["hint"]) for r in rows], schema)
        out = found if out is None else out.unionByName(found)
    return out if passes == 1 else out.groupBy("text_id", "id").agg(F.max("longest").alias("longest"), F.sum("matches").alias("matches"))


def _matched(held: DataFrame, hints: list[tuple], schema: StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)
    sent = held.sparkSession.sparkContext.broadcast(hints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, list] = {}
        for id_, hint in sent.value:
            classes.setdefault(hint, []).append(id_)
        automaton = ahocorasick.Automaton()
        for hint in classes:
            automaton.add_word(hint, hint)
        automaton.make_automaton()
        for batch in batches:
            at, ids, longest, matches = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                met: dict = {}
                for hint in {h for _, h in automaton.iter(text.as_py())} if classes else ():
                    for id_ in classes[hint]:
                        n, most = met.get(id_, (0, 0))
                        met[id_] = n + 1, max(most, len(hint))
                for id_, (n, most) in met.items():
                    for column, v in zip((at, ids, longest, matches), (k, id_, most, n), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, f.type) for c, f in zip((ids, longest, matches), list(arrow)[1:], strict=True))], schema=arrow)

    return held.mapInArrow(run, schema)


def relevance() -> list[Column]:
    """Gravest impact, longest hint, most hints, id."""
    return [F.array_position(F.array(*map(F.lit, IMPACTS)), F.col("impact")), F.desc("longest"), F.desc("matches"), F.col("id")]


def packs(selected: DataFrame, by: str, size: str, cap: int = PACK_CHARS, most: int = MOST_CLASSES, joint: int = 2) -> DataFrame:
    """Packs of a text's classes in order of relevance, bounded by characters and number."""
    ranked = selected.withColumn("place", F.array_position(F.array(*map(F.lit, IMPACTS)), F.col("impact")))
    ranked = ranked.withColumns({"_l": -F.col("longest"), "_m": -F.col("matches")})
    return greedy(ranked, by, ["place", "_l", "_m", "id"], size, cap, most, joint).drop("_l", "_m", "place")
