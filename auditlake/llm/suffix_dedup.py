"""Removal of repeated substrings, by suffix arrays over what can repeat at all.

Every string of PASSAGE bytes contains an anchor: the gram of GRAM bytes in it with the least hash. Equal strings have equal
anchors, so only documents' places with an anchor gram that occurs twice are looked at. Around each such anchor an excerpt
holds all windows that begin where a string with this anchor does; equal excerpts are counted, not compared. Distinct excerpts of one gram meet
in one task, which builds a suffix array over many grams' excerpts (see suffixes), finds windows that occur
again beside each other in its order, and compares their bytes. WINDOW is what is removed; PASSAGE, a shorter window, is only reported.

Grams with more than LARGE distinct excerpts are dealt out anew by more of the text around them: equal windows hold their anchor at
equal places, so windows are cut into slices by that place, and all windows of a slice share a core of nearly their whole length, by
which they meet. Cores that are still in more than LARGE excerpts become whole strings, and the excerpts single windows, which
are only counted.

Defined cases: null texts count as empty; texts shorter than the window lose nothing; repeated rows count as
places of their own, so their windows repeat; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import located, materialise, text_of
from .suffixes import repeated_windows

WINDOW, GRAM = 400, 32
#: Bytes of a passage of some 50 words at least, whatever the words.
PASSAGE = 256
#: Places of an anchor in its windows that one slice of a hot gram holds.
SLICE = 16
#: Distinct excerpts of one gram that meet in one task.
LARGE = 20_000
#: Excerpt bytes for one suffix array, unless one gram alone has more.
BLOCK_BYTES = 2 << 20
#: Window starts of one text that are hashed at a time.
STRIDE = 1 << 20


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` (a power of two) bytes from each place on."""
    h = b.astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(0x2545F4914F6CDD1D)
    s = 1
    while s < gram:
        h = (h[:-s] * np.uint64(0xFF51AFD7ED558CCD)) ^ (h[s:] + (h[s:] >> np.uint64(29)))
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        s *= 2
    return h


def _least_of(h: np.ndarray) -> np.ndarray:
    """Hashes with their places in the low bits: of equal ones the leftmost is least."""
    return (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)


def anchors(b: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, gram hash) for each anchor: the windows' least gram hash, the leftmost if several."""
    h = gram_hashes(b, gram)
    k = window - gram + 1
    value = _least_of(h)
    # Least of every k neighbours: the rest of one piece of k and the beginning of the next.
    padded = np.concatenate([value, np.full(-len(h) % k, ~np.uint64(0))]).reshape(-1, k)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(h) - k + 1], before[k - 1 : len(h)])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    return first, last, h[(least[first] & np.uint64((1 << 24) - 1)).astype(np.int64)]


def signed(h) -> np.ndarray:
    return np.asarray(h, dtype=np.uint64).view(np.int64)


def all_anchors(raw: bytes, least: int, window: int) -> tuple[np.ndarray, ...]:
    """(first string, last string, end of the excerpt, gram hash, excerpt hash) of a whole text's anchors in strings of `least` bytes."""
    out = []
    for at in range(0, len(raw) - least + 1, STRIDE):
        first, last, gram = anchors(np.frombuffer(raw[at : at + STRIDE + least - 1], dtype=np.uint8), least)
        first, last = first + at, last + at
        end = np.minimum(last + window, len(raw))
        out.append((first, last, end, signed(gram), signed([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(first.tolist(), end.tolist(), strict=True)])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 5


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def anchor_table(keyed: DataFrame, least: int, window: int) -> DataFrame:
    schema = "file bigint, row bigint, first bigint, last bigint, end bigint, gram bigint, excerpt bigint"
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            found = [all_anchors(t.as_py().encode(), least, window) for t in batch.column(2)]
            if found:
                size = [len(x[0]) for x in found]
                owner = [pa.array(np.repeat(batch.column(k).to_numpy(), size)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*owner, *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], schema=arrow)

    return keyed.select("file", "row", "text").mapInArrow(run, schema)


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


RUNS = "array<struct<a:bigint,b:bigint>>"


def find_in_groups(excerpts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """gram, excerpt, and for each size runs (first and last repeated window, counted in the excerpt). One suffix array for many grams."""
    schema = f"gram bigint, excerpt bigint, {', '.join(f'runs{k} {RUNS}' for k in range(len(sizes)))}"
    arrow = _arrow(schema)

    def solve(gram, excerpt, n, texts):
        hits = repeated_windows(texts, n, sizes)
        found = [k for k, h in enumerate(hits[0]) if h.any()]
        columns = {f"runs{j}": [_runs(h[k]) for k in found] for j, h in enumerate(hits)}
        return pa.RecordBatch.from_pydict({"gram": [gram[k] for k in found], "excerpt": [excerpt[k] for k in found], **columns}, schema=arrow)

    def run(batches):
        gram, excerpt, n, texts, size = [], [], [], [], 0
        for batch in batches:
            for g, e, m, t in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size > BLOCK_BYTES and g != gram[-1]:
                    yield solve(gram, excerpt, n, texts)
                    gram, excerpt, n, texts, size = [], [], [], [], 0
                gram.append(g)
                excerpt.append(e)
                n.append(m)
                texts.append(t)
                size += len(t)
        if texts:
            yield solve(gram, excerpt, n, texts)

    return excerpts.select("gram", "excerpt", "n", "content").repartition("gram").sortWithinPartitions("gram", "excerpt").mapInArrow(run, schema)


def refined(excerpts: DataFrame, width: int, least: int, window: int) -> DataFrame:
    """Excerpts in slices of so many places of their anchor: gram and excerpt anew, n, content, and what they were cut from (gram0, excerpt0, shift)."""
    schema = "gram bigint, excerpt bigint, n bigint, content binary, gram0 bigint, excerpt0 bigint, shift bigint"
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            rows = [[] for _ in arrow.names]
            for g, e, n, t, g0, e0, shift in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                anchor = int(_least_of(gram_hashes(np.frombuffer(t[:least], dtype=np.uint8))).argmin())
                for s in range(max(0, anchor - n + 1) // width, anchor // width + 1):
                    i, j = max(0, anchor - (s + 1) * width + 1), min(n - 1, anchor - s * width)
                    core = t[anchor - s * width : anchor - (s + 1) * width + 1 + least]
                    own = t[i : min(j + window, len(t))]
                    name = xxhash.xxh3_64_intdigest(core, seed=(g ^ s * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
                    for column, v in zip(rows, (int(signed(name)), int(signed(xxhash.xxh3_64_intdigest(own))), j - i + 1, own, g0, e0, shift + i), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, rows, strict=True)), schema=arrow)

    return excerpts.select("gram", "excerpt", "n", "content", "gram0", "excerpt0", "shift").mapInArrow(run, schema)


def find_in_hot_grams(excerpts: DataFrame, sizes: tuple[int, ...], large: int) -> DataFrame:
    """The same for grams of more than `large` distinct excerpts. Slices are taken twice: of SLICE places, and where that isn't enough of one."""
    least, window = sizes[0], sizes[-1]
    names = [f"runs{k}" for k in range(len(sizes))]
    parts = materialise(refined(excerpts.selectExpr("*", "gram AS gram0", "excerpt AS excerpt0", "0L AS shift"), SLICE, least, window), "parts")
    kinds = materialise(parts.groupBy("gram", "excerpt").agg(F.count("*").alias("many"), F.min(F.struct("gram0", "excerpt0", "shift")).alias("of")), "kinds")
    several = materialise(kinds.groupBy("gram").agg(F.count("*").alias("kinds")), "several")
    one = parts.join(kinds.join(several.hint("merge"), "gram").hint("merge"), ["gram", "excerpt"]).filter(F.col("of") == F.struct("gram0", "excerpt0", "shift"))
    found = find_in_groups(one.filter((F.col("kinds") > 1) & (F.col("kinds") <= large)), sizes)
    repeated = F.when(F.col("many") > 1, F.array(F.struct(F.lit(0).cast("bigint").alias("a"), (F.col("n") - 1).alias("b"))))
    inside = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.least(F.col("n") - 1, F.length("content") - window).alias("b")))
    whole = [repeated if size == least else F.when((F.col("many") > 1) & (F.length("content") >= window), inside) for size in sizes]
    found = one.drop("of").join(found.hint("merge"), ["gram", "excerpt"], "left").select("gram", "excerpt", *(F.coalesce(w, F.col(c)).alias(c) for w, c in zip(whole, names, strict=True)))
    found = parts.join(found.hint("merge"), ["gram", "excerpt"]).select(F.col("gram0").alias("gram"), F.col("excerpt0").alias("excerpt"), "shift", *names)
    # What is left: single windows, equal if their contents are; strings of the first size, if their grams are.
    still = several.filter(F.col("kinds") > large).select("gram")
    if not still.isEmpty():
        single = materialise(refined(parts.join(still, "gram"), 1, least, window), "single")
        again = single.groupBy("gram", "excerpt").agg(F.count("*").alias("many"))
        strings = again.groupBy("gram").agg(F.sum("many").alias("strings"))
        again = materialise(again.join(strings, "gram"), "again")
        hit = F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))
        marks = [F.when(F.col("strings" if size < window else "many") > 1, hit) if size < window else F.when((F.col("many") > 1) & (F.length("content") == window), hit) for size in sizes]
        counted = single.join(again.hint("merge"), ["gram", "excerpt"]).select(F.col("gram0").alias("gram"), F.col("excerpt0").alias("excerpt"), "shift", *(m.alias(c) for m, c in zip(marks, names, strict=True)))
        found = found.unionByName(counted)
    moved = lambda c: F.transform(c, lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b")))
    return found.groupBy("gram", "excerpt").agg(*(F.flatten(F.collect_list(moved(c))).alias(c) for c in names)).filter(F.size(names[0]) > 0)


def covered(raw: bytes, starts: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal spans covered by the windows whose first byte lies in one of the ranges (last included)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + window))
        else:
            out.append((a, b + window))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, large: int = LARGE, with_spans: bool = False, passage: int | None = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and n_passage_bytes: bytes covered by a string of `passage` bytes that
    also starts anywhere else (they stay unless a window covers them). with_spans adds the spans and the kept bytes."""
    sizes = (passage, window) if passage and passage < window else (window,)
    least, names = sizes[0], [f"runs{k}" for k in range(len(sizes))]
    docs = located(docs)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text_of(text_col).alias("text"))
    table = materialise(anchor_table(keyed, least, window), "anchors")
    grams = table.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    grams = materialise(grams, "grams")
    again = materialise(table.join(grams.hint("merge"), "gram"), "again")
    # One representative for each distinct excerpt; n places have it.
    kinds = materialise(again.groupBy("gram", "excerpt").agg(F.count("*").alias("n"), F.min(F.struct("file", "row", "first", "last", "end")).alias("at")), "kinds")
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds"))
    several = materialise(several.filter("kinds > 1"), "several")
    needed = kinds.join(several.hint("merge"), "gram").select("gram", "excerpt", "kinds", "at.*")
    by_row = needed.groupBy("file", "row").agg(F.collect_list(F.struct("gram", "excerpt", "kinds", "first", "last", "end")).alias("cuts"))
    by_row = materialise(by_row, "cuts")

    schema = "gram bigint, excerpt bigint, n bigint, content binary, kinds bigint"
    arrow = _arrow(schema)

    def cut(batches):
        for batch in batches:
            rows = [[] for _ in arrow.names]
            for t, cuts in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = t.as_py().encode()
                for c in cuts:
                    for column, v in zip(rows, (c["gram"], c["excerpt"], c["last"] - c["first"] + 1, raw[c["first"] : c["end"]], c["kinds"]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, rows, strict=True)), schema=arrow)

    excerpts = keyed.join(by_row.hint("merge"), ["file", "row"]).select("text", "cuts").mapInArrow(cut, schema)
    if several.filter(F.col("kinds") > large).isEmpty():
        found = find_in_groups(excerpts, sizes)
    else:
        excerpts = materialise(excerpts, "excerpts")
        found = find_in_groups(excerpts.filter(F.col("kinds") <= large), sizes)
        found = found.unionByName(find_in_hot_grams(excerpts.filter(F.col("kinds") > large), sizes, large))
    # An excerpt of several places repeats as a whole.
    last = F.col("at.last") - F.col("at.first")
    ends = {size: last if size == least else F.least(last, F.col("at.end") - F.col("at.first") - size) for size in sizes}
    run = lambda b: F.when(b >= 0, F.array(F.struct(F.lit(0).cast("bigint").alias("a"), b.alias("b"))))
    twice = kinds.filter("n > 1").select("gram", "excerpt", *(run(ends[size]).alias(c) for size, c in zip(sizes, names, strict=True)))
    found = materialise(found.join(twice.select("gram", "excerpt"), ["gram", "excerpt"], "left_anti").unionByName(twice), "found")
    moved = lambda c: F.transform(c, lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"]).alias("b")))
    starts = again.join(found.hint("merge"), ["gram", "excerpt"]).select("file", "row", *(moved(c).alias(c) for c in names))
    starts = materialise(starts.groupBy("file", "row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in names)), "starts")

    id_type = docs.schema[id_col].dataType.simpleString()
    result = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_bytes bigint" + f", spans {RUNS}, kept binary" * with_spans
    result_arrow = _arrow(result)

    def finish(batches):
        for batch in batches:
            rows = [[] for _ in result_arrow.names[1:]]
            for t, *hot in zip(batch.column(1), *(batch.column(2 + k).to_pylist() for k in range(len(sizes))), strict=True):
                raw = t.as_py().encode()
                all_spans = [covered(raw, [(h["a"], h["b"]) for h in x or ()], size) for x, size in zip(hot, sizes, strict=True)]
                spans = all_spans[-1]
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                values = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in all_spans[0]), [{"a": a, "b": b} for a, b in spans], kept)
                for column, v in zip(rows, values, strict=False):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, f.type) for v, f in zip(rows, list(result_arrow)[1:], strict=True))], schema=result_arrow)

    return keyed.join(starts.hint("merge"), ["file", "row"], "left").select("doc_id", "text", *names).mapInArrow(finish, result)
