"""Removal of repeated word windows, by suffix trees partitioned by prefixes.

A window is `window` words in a row of one text. Of every window the suffix at its anchor is kept: the place, among its first REACH words, whose
prefix (the words that any window with this anchor has from there on) has the least hash. Equal windows have equal anchors at equal
offsets, so their anchored suffixes share that prefix.

1. Prefix hashes are counted: each task deals those of its texts out to parts by hash, packed in arrays; a part sends back those that occur twice.
   A prefix that occurs once is a leaf of its own and goes no further.
2. Anchors that are left join to runs of words. Equal runs (copies, shared passages) are counted by their SHA-256 digest, only the first is looked into; so are, within
   first runs, equal excerpts around anchors, by two 64-bit hashes.
3. The first excerpts' anchored suffixes are split by prefixes of variable length: a prefix of few words, where more than `large` suffixes share it one of more
   words. Suffixes with one prefix, in the order of their words, are the leaves of one subtree. Going through them, the words shared with the leaf before
   tell which inner nodes end; below a node deep enough for a window that begins some words before the anchor, leaves are told apart by these words. What stays
   together is a repeat, and all but its first place are hits. Prefixes that stay too large at full length become whole windows, which are only grouped.

Words are compared by their bytes in step 3. Texts are written once, dealt out by their place, so that later
steps join them without another shuffle. Texts and their hits are never held beyond one text; a subtree holds the leaves below nodes that are open.

Defined cases: null texts have no words; texts shorter than the window lose nothing; of repeated rows and repeated ids the order of
files and rows tells which comes first; null ids come last; an empty table gives an empty result; very long texts take memory in proportion to their own
words; columns other than id and text aren't read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import located, materialise, new_path, text_of

WINDOW = 20
#: Places in a window where its anchor may be, a power of two.
REACH = 8
#: Words of the shorter prefixes by which suffixes are split before the longest.
PREFIXES = (4, 8)
#: Suffixes of one prefix that make one subtree.
LARGE = 20_000
#: Rows that are packed together when prefixes are counted, one byte numbers them.
PACK = 256
#: Text bytes for each part in which prefixes are counted.
PART_BYTES = 32 << 20
#: Rows among which one task may meet all places of one prefix.
SALT_ROWS = 4 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 19


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def prefix_hashes(words: list[bytes], n: int, known: _WordHashes) -> np.ndarray:
    """A 64-bit hash of the n words from each place on, put together from those of 1, 2, 4 ... words."""
    one = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    count = max(0, len(one) - n + 1)
    out, done, size = np.zeros(count, dtype=np.uint64), 0, 1
    while count and size <= n:
        if n & size:  # the places after what is done
            out = out * np.uint64(pow(MULTIPLIER, size, 1 << 64)) + one[done : done + count]
            done += size
        one = one[:-size] * np.uint64(pow(MULTIPLIER, size, 1 << 64)) + one[size:]
        size *= 2
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9) ^ (out >> np.uint64(29))


def anchors(hashes: np.ndarray, windows: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) for each anchor; of equal hashes the leftmost."""
    best = np.arange(len(hashes))
    step = 1
    while step < reach:
        a, b = best[:-step], best[step:]
        best = np.where(hashes[b] < hashes[a], b, a)
        step *= 2
    best = best[:windows]
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]])) if windows else np.empty(0, np.int64)
    return best[first], first, np.append(first[1:], windows)[: len(first)] - 1


class Shape:
    """Sizes that belong together, and the anchors of a text."""

    def __init__(self, window: int = WINDOW, reach: int = REACH):
        if reach & (reach - 1) or not 0 < reach <= window:
            raise ValueError("reach is a power of two, at most the window")
        self.window, self.reach, self.prefix = window, reach, window - reach + 1

    def anchored(self, words: list[bytes], known: _WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(prefix hash, anchor, first window, last window) for each anchor of a text."""
        hashes = prefix_hashes(words, self.prefix, known)
        at, first, last = anchors(hashes, max(0, len(words) - self.window + 1), self.reach)
        return hashes[at], at, first, last


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _stretches(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each stretch of equal values."""
    edge = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1], [True]])).tolist()
    return list(zip(edge[:-1], edge[1:], strict=True)) if len(sorted_values) else []


def _signed(h: int) -> int:
    return h - (h >> 63 << 64)


def _hashed(words: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def _codes(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part (high half) and what is left of a hash."""
    return ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(parts)) << np.uint64(32) | hashes >> np.uint64(32)


def repeated_prefixes(keyed: DataFrame, shape: Shape, parts: int, salts: int = 1) -> DataFrame:
    """file, row, codes (sorted 64-bit numbers) of the anchors' prefixes that occur twice or more. Hashes may take a few too many.

    With several salts, each salt's rows are looked through first and hand on one place of each code, so a prefix of very many rows doesn't load one task."""
    packed = "part bigint, file bigint, pack bigint, rows binary, codes binary"
    arrow = _arrow(packed)

    def pack(batches):
        known = _WordHashes()
        for batch in batches:
            held: dict[tuple[int, int], list] = {}
            for file, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                codes = _codes(shape.anchored(text.as_py().encode().split(), known)[0], parts)
                if len(codes):
                    held.setdefault((file, row // PACK), []).append((np.full(len(codes), row % PACK, np.uint8), codes))
            columns: list[list] = [[] for _ in arrow.names]
            for (file, number), found in held.items():
                rows, codes = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(codes, kind="stable")
                rows, codes = rows[order], codes[order]
                for i, j in _stretches(codes >> np.uint64(32)):
                    for c, v in zip(columns, (int(codes[i]) >> 32, file, number, rows[i:j].tobytes(), codes[i:j].astype(np.uint32).tobytes()), strict=True):
                        c.append(v)
            yield _batch(columns, arrow)

    told = "repeated boolean, " + packed
    told_arrow = _arrow(told)

    def solve(held: list[tuple]) -> pa.RecordBatch:
        codes = np.concatenate([np.frombuffer(c, dtype=np.uint32).astype(np.uint64) | np.uint64(part << 32) for part, _, _, _, c in held])
        order = np.argsort(codes, kind="stable")
        fresh = np.concatenate([[True], codes[order[1:]] != codes[order[:-1]]])
        alone = fresh & np.append(fresh[1:], True)
        repeated, first = np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=bool)
        repeated[order[~alone]] = first[order[fresh]] = True
        columns: list[list] = [[] for _ in told_arrow.names]
        ends = np.cumsum([len(h[3]) for h in held])[:-1]
        for kind, marks in ((True, repeated), (False, first)) if salts > 1 else ((True, repeated),):
            for (part, file, number, rows, own), mask in zip(held, np.split(marks, ends), strict=True):
                if mask.any():
                    values = (kind, part, file, number, np.frombuffer(rows, dtype=np.uint8)[mask].tobytes(), np.frombuffer(own, dtype=np.uint32)[mask].tobytes())
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
        return _batch(columns, told_arrow)

    def count(batches):
        now, held = None, []
        for batch in batches:
            for group, salt, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, salt) != now and held:
                    yield solve(held)
                    held = []
                now = group, salt
                held.append(tuple(rest))
        if held:
            yield solve(held)

    def counted(rows: DataFrame, group, salt) -> DataFrame:
        rows = rows.select(group.alias("group"), salt.alias("salt"), *arrow.names)
        return rows.repartition(parts, "group", "salt").sortWithinPartitions("group", "salt").mapInArrow(count, told)

    by_row = "file bigint, row bigint, codes binary"
    rows_arrow = _arrow(by_row)

    def unpack(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in rows_arrow.names]
            for file, number, packs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.concatenate([np.frombuffer(p["codes"], dtype=np.uint32).astype(np.uint64) | np.uint64(p["part"] << 32) for p in packs])
                rows = np.frombuffer(b"".join(p["rows"] for p in packs), dtype=np.uint8)
                order = np.lexsort((codes, rows))
                rows, codes = rows[order], codes[order]
                for i, j in _stretches(rows):
                    for c, v in zip(columns, (file, number * PACK + int(rows[i]), codes[i:j].tobytes()), strict=True):
                        c.append(v)
            yield _batch(columns, rows_arrow)

    found = counted(keyed.select("file", "row", "text").mapInArrow(pack, packed), F.col("part") % max(1, parts // salts), F.pmod(F.xxhash64("file", "pack"), F.lit(salts)))
    if salts > 1:
        found = materialise(found, "counted")
        found = found.filter("repeated").unionByName(counted(found.filter("NOT repeated"), F.col("part"), F.lit(0)).filter("repeated"))
    return found.groupBy("file", "pack").agg(F.collect_list(F.struct("part", "rows", "codes")).alias("packs")).mapInArrow(unpack, by_row)


def runs_of(texts: DataFrame, shape: Shape, parts: int, id_type: str) -> DataFrame:
    """digest, n (words) and place (whose at is the first word's number) of each run of words that windows with repeated anchors cover. texts: file, row, none, id, text, codes."""
    schema = f"none boolean, id {id_type}, file bigint, row bigint, at bigint, n bigint, digest binary"
    arrow = _arrow(schema)

    def run(batches):
        known = _WordHashes()
        for batch in batches:
            columns: list[list] = [[] for _ in arrow.names]
            for *place, text, codes in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5), strict=True):
                words = text.as_py().encode().split()
                hashes, _, first, last = shape.anchored(words, known)
                hit = np.isin(_codes(hashes, parts), np.frombuffer(codes.as_py(), dtype=np.uint64))
                first, last = first[hit], last[hit]
                fresh = np.flatnonzero(np.concatenate([[True], first[1:] != last[:-1] + 1]))[: len(first)]
                for i, j in zip(first[fresh].tolist(), last[np.append(fresh[1:], len(last)) - 1].tolist(), strict=True) if len(first) else ():
                    n = j - i + shape.window
                    for c, v in zip(columns, (*place, i, n, hashlib.sha256(b" ".join(words[i : i + n])).digest()), strict=True):
                        c.append(v)
            yield _batch(columns, arrow)

    runs = texts.select("none", "id", "file", "row", "text", "codes").mapInArrow(run, schema)
    return runs.select("digest", "n", F.struct("none", "id", "file", "row", "at").alias("place"))


def excerpts_of(texts: DataFrame, shape: Shape, id_type: str) -> DataFrame:
    """prefix and excerpt (hashes), place (whose start is the first window's number), n (windows) and offset (of the anchor) of each anchor in runs. texts: none, id, file, row, text, cuts."""
    schema = f"prefix bigint, excerpt bigint, none boolean, id {id_type}, file bigint, row bigint, start bigint, n int, offset int"
    arrow = _arrow(schema)

    def run(batches):
        known = _WordHashes()
        for batch in batches:
            columns: list[list] = [[] for _ in arrow.names]
            for *place, text, cuts in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5).to_pylist(), strict=True):
                words = text.as_py().encode().split()
                for cut in cuts:
                    part = words[cut["at"] : cut["at"] + cut["n"]]
                    for h, a, i, j in zip(*(x.tolist() for x in shape.anchored(part, known)), strict=True):
                        for c, v in zip(columns, (_signed(h), _hashed(part[i : j + shape.window]), *place, cut["at"] + i, j - i + 1, a - i), strict=True):
                            c.append(v)
            yield _batch(columns, arrow)

    return texts.select("none", "id", "file", "row", "text", "cuts").mapInArrow(run, schema)


def suffixes_of(texts: DataFrame, shape: Shape, prefixes: tuple[int, ...], id_type: str) -> DataFrame:
    """Anchored suffixes: prefix hashes, the words from the anchor on, those before it, and where the first window begins. texts: none, id, file, row, text, cuts (start, n and offset of excerpts)."""
    names = [f"prefix{k}" for k in range(len(prefixes))]
    schema = f"{', '.join(f'{c} bigint' for c in names)}, right binary, left binary, n_left int, none boolean, id {id_type}, file bigint, row bigint, start bigint"
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in arrow.names]
            for *place, text, cuts in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5).to_pylist(), strict=True):
                words = text.as_py().encode().split()
                for cut in cuts:
                    start, a = cut["start"], cut["start"] + cut["offset"]
                    right = b" ".join([*words[a : start + cut["n"] - 1 + shape.window], b""])
                    for c, v in zip(columns, (*(_hashed(words[a : a + p]) for p in prefixes), right, b" ".join(words[start:a]), cut["offset"], *place, start), strict=True):
                        c.append(v)
            yield _batch(columns, arrow)

    return texts.select("none", "id", "file", "row", "text", "cuts").mapInArrow(run, schema)


class Subtree:
    """The leaves of suffixes that share a prefix, in order; gives the places of repeats that are not the first."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.words: list[bytes] = []
        #: For windows that begin so many words before the anchor: what lies below the open node that is deep enough, by the words before the anchor.
        self.open: list[dict[bytes, list[tuple]]] = [{} for _ in range(shape.reach)]
        #: file, row and the window's number
        self.hits: list[tuple[int, int, int]] = []

    def close(self, shared: int) -> None:
        """Nodes deeper than the words shared with the next leaf end."""
        for before in range(min(self.shape.reach, self.shape.window - shared)):
            for leaves in self.open[before].values():
                if len(leaves) > 1:
                    least = min(leaves)
                    self.hits += [x[2:] for x in leaves if x is not least]
            self.open[before].clear()

    def add(self, right: bytes, left: bytes, n_left: int, none: bool, own, file: int, row: int, start: int) -> None:
        words, shared = right.split(), 0
        for a, b in zip(words, self.words, strict=False):
            if a != b:
                break
            shared += 1
        self.close(shared)
        self.words = words
        before = left.split()
        for offset in range(max(0, self.shape.window - len(words)), n_left + 1):
            self.open[offset].setdefault(b" ".join(before[n_left - offset :]), []).append((none, own, file, row, start + n_left - offset))


def hits_in_subtrees(suffixes: DataFrame, shape: Shape) -> DataFrame:
    """file, row, starts: windows of a text that begin earlier elsewhere. suffixes have the column prefix."""
    schema = "file bigint, row bigint, starts array<bigint>"
    arrow = _arrow(schema)

    def told(hits):
        by: dict[tuple[int, int], list[int]] = {}
        for file, row, start in hits:
            by.setdefault((file, row), []).append(start)
        return _batch([[k[0] for k in by], [k[1] for k in by], list(by.values())], arrow)

    def run(batches):
        tree, now = Subtree(shape), None
        for batch in batches:
            for prefix, *leaf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if prefix != now:
                    tree.close(0)
                    tree.words, now = [], prefix
                tree.add(*leaf)
            if tree.hits:
                yield told(tree.hits)
                tree.hits = []
        tree.close(0)
        if tree.hits:
            yield told(tree.hits)

    return suffixes.select("prefix", *_LEAF).repartition("prefix").sortWithinPartitions("prefix", "right").mapInArrow(run, schema)


_LEAF = ("right", "left", "n_left", "none", "id", "file", "row", "start")


def hits_of_windows(suffixes: DataFrame, shape: Shape, id_type: str) -> DataFrame:
    """The same for prefixes that stay too large: every window stands for itself, equal ones are grouped."""
    schema = f"content binary, none boolean, id {id_type}, file bigint, row bigint, start bigint"
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in arrow.names]
            for right, left, _, *place, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [*left.split(), *right.split()]
                for i in range(len(words) - shape.window + 1):
                    for c, v in zip(columns, (b" ".join(words[i : i + shape.window]), *place, start + i), strict=True):
                        c.append(v)
            yield _batch(columns, arrow)

    rows = suffixes.select(*_LEAF).mapInArrow(run, schema)
    rows = materialise(rows.select("content", F.struct("none", "id", "file", "row", "start").alias("place")), "windows")
    first = materialise(rows.groupBy("content").agg(F.min("place").alias("least"), F.count("*").alias("many")).filter("many > 1").select("content", "least"), "first")
    return rows.join(first.hint("merge"), "content").filter("place <> least").select("place.file", "place.row", F.array("place.start").alias("starts"))


def hits_by_prefix(suffixes: DataFrame, shape: Shape, prefixes: int, large: int, id_type: str) -> DataFrame:
    """Hits of all suffixes, split by the shortest prefix that at most `large` of them share."""
    rest, found = suffixes, []
    for k in range(prefixes):
        own = f"prefix{k}"
        many = materialise(rest.groupBy(own).agg(F.count("*").alias("many")).filter(F.col("many") > large).select(own), "many")
        if many.isEmpty():
            found.append(hits_in_subtrees(rest.withColumn("prefix", F.col(own)), shape))
            rest = None
            break
        found.append(hits_in_subtrees(rest.join(many.hint("merge"), own, "left_anti").withColumn("prefix", F.col(own)), shape))
        rest = rest.join(many.hint("merge"), own, "left_semi")
    if rest is not None:
        found.append(hits_of_windows(rest, shape, id_type))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def dealt_by_place(keyed: DataFrame) -> DataFrame:
    """The rows written in buckets of file and row, so that joins by them don't shuffle the texts again."""
    spark = keyed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"texts_{uuid.uuid4().hex}"
    keyed.repartition(n, "file", "row").write.bucketBy(n, "file", "row").option("path", new_path(spark, "texts")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, reach: int = REACH, prefixes: tuple[int, ...] = PREFIXES, large: int = LARGE, salts: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: without the words of windows that start earlier too. with_text adds the kept words.

    salts: see repeated_prefixes; by default as many as the rows ask for."""
    shape = Shape(window, reach)
    lengths = (*(p for p in prefixes if p < shape.prefix), shape.prefix)
    docs = located(docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_of(text_col).alias("text"),
    )
    many, size = keyed.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-(size or 0) // PART_BYTES))
    texts = dealt_by_place(keyed)
    codes = materialise(repeated_prefixes(keyed, shape, parts, salts or -(-many // SALT_ROWS) or 1), "codes")
    placed = materialise(runs_of(texts.join(codes.hint("merge"), ["file", "row"]), shape, parts, id_type), "runs")
    # Of equal runs the first is looked into, the others go as a whole.
    firsts = materialise(placed.groupBy("digest", "n").agg(F.min("place").alias("first"), F.count("*").alias("many")), "firsts")
    span = lambda a, n: F.struct(a.alias("a"), (a + n).alias("z"))
    again = placed.join(firsts.filter("many > 1").select("digest", "first").hint("merge"), "digest").filter("place <> first").select("place.file", "place.row", F.array(span(F.col("place.at"), F.col("n"))).alias("gone"))
    cuts = firsts.select("first.file", "first.row", F.struct("first.at", "n").alias("cut")).groupBy("file", "row").agg(F.collect_list("cut").alias("cuts"))
    excerpts = materialise(excerpts_of(texts.join(cuts.hint("merge"), ["file", "row"]), shape, id_type).select("prefix", "excerpt", F.struct("none", "id", "file", "row", "start", "n", "offset").alias("place")), "excerpts")
    # So with equal surroundings of an anchor. Prefixes that only one of them has are leaves.
    kinds = materialise(excerpts.groupBy("prefix", "excerpt").agg(F.min("place").alias("first"), F.count("*").alias("many")), "kinds")
    copies = excerpts.join(kinds.filter("many > 1").select("prefix", "excerpt", "first").hint("merge"), ["prefix", "excerpt"]).filter("place <> first")
    copies = copies.select("place.file", "place.row", F.array(span(F.col("place.start"), F.col("place.n") - 1 + window)).alias("gone"))
    several = kinds.groupBy("prefix").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("prefix")
    cuts = kinds.join(several.hint("merge"), "prefix").select("first.file", "first.row", F.struct("first.start", "first.n", "first.offset").alias("cut")).groupBy("file", "row").agg(F.collect_list("cut").alias("cuts"))
    suffixes = materialise(suffixes_of(texts.join(cuts.hint("merge"), ["file", "row"]), shape, lengths, id_type), "suffixes")
    hits = hits_by_prefix(suffixes, shape, len(lengths), large, id_type).select("file", "row", F.transform("starts", lambda k: span(k, F.lit(window))).alias("gone"))
    gone = again.unionByName(copies).unionByName(hits).groupBy("file", "row").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    gone = materialise(gone, "gone")

    schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    arrow = _arrow(schema)

    def finish(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in arrow.names[1:]]
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().encode().split()
                kept, at = [], 0
                for span in sorted(spans or (), key=lambda s: s["a"]):
                    kept += words[at : span["a"]]
                    at = max(at, span["z"])
                kept += words[at:]
                left = b" ".join(kept)
                for c, v in zip(columns, (len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode()), strict=False):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return texts.join(gone.hint("merge"), ["file", "row"], "left").select(F.col("id").alias("doc_id"), "text", "gone").mapInArrow(finish, schema)
