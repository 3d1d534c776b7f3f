"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within a radius of 4 differ in at most 4 of n blocks of bits, so n - 4 whole blocks agree: each fingerprint is
dealt out by all choices of n - 4 blocks, and only fingerprints with equal choices meet. The more fingerprints there are, the more
blocks are made, so that keys get wider and buckets don't grow with the corpus. Those of a task are stored as 64 bit
planes; distances of 64 pairs at a time are summed by carry-save counters, and blocks in which all exceed the radius are abandoned.
For wider fingerprints and larger radii, as filtering by similarity needs, keys are samples of the fingerprint's bits; their
width grows with the logarithm of the number of fingerprints, and their number such that near ones still meet as likely. Linking is the same.
Within a bucket only a spanning tree of the links is kept, never all pairs; where a similarity decides on links afterwards, all
texts of a tree's component are compared anew. Buckets over LARGE are dealt out anew by pairs of parts.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; texts of under four words
are one shingle; equal fingerprints are one node, so copies never meet as pairs; a null id counts in no component's
smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialise, small_enough
from .graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Chance that two wide fingerprints as far apart as the radius share no bucket.
MISS = 0.09
#: Fingerprints of one bucket that one task compares.
LARGE = 1 << 16
#: Shingle hashes of one loose component, in bytes, that one task holds.
GROUP_BYTES = 1 << 26
#: Runs up to this length are compared by shifting all planes; longer ones by a search from node to node.
SHORT = 8
LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """So many 64-bit words: the first from the shingles' hashes, the others from further hashes of those."""
    tokens = (text or "").encode().translate(LOWER).split()  # at blanks and the bytes 09 to 0D
    if not tokens:
        return np.zeros(words, dtype="<u8")
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(tokens)) - 1 :].tolist()
    counts, digest = np.zeros(64 * words, dtype=np.int64), xxhash.xxh64_intdigest
    step = (1 << 16) // words
    for at in range(0, n, step):
        h = np.array([digest(line[i:j], SEED) for i, j in zip(first[at : at + step], last[at : at + step], strict=True)], dtype="<u8")
        if words > 1:
            h = h[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            more = h[:, 1:]
            more ^= more >> np.uint64(30)
            more *= np.uint64(0xBF58476D1CE4E5B9)
            more ^= more >> np.uint64(27)
            more *= np.uint64(0x94D049BB133111EB)
            more ^= more >> np.uint64(31)
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id, node and sig of every row. sig: the fingerprint's bytes (null for one word); node: its bits as a signed long, or a hash of sig."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, node bigint, sig binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, words) for t in batch.column(1)]
            sig = [f.tobytes() if words > 1 else None for f in found]
            node = np.array([xxhash.xxh64_intdigest(x) if x else f[0] for f, x in zip(found, sig, strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node.view(np.int64)), pa.array(sig, pa.binary())], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def planes(fp: np.ndarray) -> np.ndarray:
    """The bit planes of so many fingerprints (rows of words), 64 lanes a word."""
    lanes = -len(fp) % 64
    padded = np.concatenate([fp, np.zeros((lanes, fp.shape[1]), np.uint64)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(differs, n_planes: int, shape: tuple[int, ...], lanes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (bits of words) whose differing bits are at most radius. differs(b, at) gives plane b of the words at.

    Counters are bit-sliced: ones, twos, fours and so on, and a bit that stays set once they overflow. Two planes are added
    at a time by one carry-save adder. Every quarter of the planes the words in which no lane is left are abandoned.
    """
    wanted = np.broadcast_to(lanes, shape).ravel()
    out = np.zeros(len(wanted), dtype=np.uint64)
    at = np.flatnonzero(wanted)
    wanted = wanted[at]
    counters = [np.zeros(len(at), dtype=np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(at), dtype=np.uint64)
    for b in range(0, n_planes, 2):
        x, y = differs(b, at), differs(b + 1, at)
        either = x ^ y
        carry = (x & y) | (either & counters[0])
        counters[0] = counters[0] ^ either
        for k in range(1, len(counters)):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = over | carry
        if (b + 2) % (n_planes // 4) == 0:
            left = wanted & ~_exceeds(counters, over, radius)
            alive = left != 0
            if b + 2 == n_planes:
                out[at] = left
            elif not alive.all():
                at, wanted, over, counters = at[alive], left[alive], over[alive], [c[alive] for c in counters]
                if not len(at):
                    break
    return out.reshape(shape)


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes counting more than radius, compared from the highest counter down."""
    above, equal = over, ~over
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | (equal & counters[k])
            equal = equal & ~counters[k]
    return above


def lanes_set(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def short_links(fp: np.ndarray, run: np.ndarray, longest: int, radius: int) -> Iterator[tuple[int, int]]:
    """Links within short runs (equal run numbers are neighbours): every plane against itself, shifted by 1, 2, ... lanes."""
    p = planes(fp)
    p = np.concatenate([p, np.zeros((len(p), 1), np.uint64)], axis=1)
    n, width = len(fp), p.shape[1] - 1
    for s in range(1, longest):
        same = np.zeros(width * 64, dtype=bool)
        same[: n - s] = run[s:] == run[:-s]
        if not same.any():
            break
        valid = np.packbits(same, bitorder="little").view(np.uint64)
        down, up = np.uint64(s), np.uint64(64 - s)
        hits = near(lambda b, at, down=down, up=up: p[b, at] ^ ((p[b, at] >> down) | (p[b, at + 1] << up)), len(p), (width,), valid, radius)
        for i in lanes_set(hits).tolist():
            yield i, i + s


def long_links(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each member of a run one within the radius through which a search from node to node reached it, itself where one began."""
    n, via = len(fp), np.arange(len(fp))
    left = np.arange(n)  # not reached yet
    frontier: list[int] = []
    batch = 1
    p = planes(fp)
    open_ = np.packbits(np.ones(n, dtype=bool), bitorder="little")
    open_ = np.concatenate([open_, np.zeros(-len(open_) % 8, np.uint8)]).view(np.uint64)

    def compare(queries: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(fp[queries]).view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little").T
        q, width = np.where(bits, ~np.uint64(0), np.uint64(0)), p.shape[1]
        return near(lambda b, at: p[b, at % width] ^ q[b, at // width], len(p), (len(queries), width), open_, radius)

    def close(positions: np.ndarray) -> None:
        np.bitwise_and.at(open_, positions // 64, ~(np.uint64(1) << (positions % 64).astype(np.uint64)))

    while True:
        live = int(np.bitwise_count(open_).sum())
        if not live:
            return via
        if live < len(left) // 2 and len(left) > 64:  # pack what is left into fewer words
            left = left[lanes_set(open_)]
            p = planes(fp[left])
            open_ = np.packbits(np.ones(len(left), dtype=bool), bitorder="little")
            open_ = np.concatenate([open_, np.zeros(-len(open_) % 8, np.uint8)]).view(np.uint64)
        most = max(1, (1 << 15) // max(1, p.shape[1]))
        if frontier:
            queries, frontier = np.array(frontier[:most]), frontier[most:]
            found = compare(queries)
            hits = lanes_set(np.bitwise_or.reduce(found, axis=0))
            by = (found[:, hits // 64] >> (hits % 64).astype(np.uint64)) & np.uint64(1)
            via[left[hits]] = queries[by.argmax(axis=0)] if len(hits) else hits
            frontier += left[hits].tolist()
            close(hits)
            continue
        # New starts, several at a time: those that reach nothing are done, the first that does leads a search.
        seeds = lanes_set(open_)[: min(batch, most)]
        reach = np.bitwise_count(compare(left[seeds])).sum(axis=1)
        linked = np.flatnonzero(reach > 1)
        close(seeds[reach <= 1] if len(linked) else seeds)
        if len(linked):
            batch = 1
            frontier = [int(left[seeds[linked[0]]])]
            close(seeds[linked[:1]])
        else:
            batch *= 2


class Linker:
    """Turns rows sorted by bucket into a spanning forest of each bucket's links, batch by batch."""

    def __init__(self, radius: int, large: int, words: int, schema: pa.Schema):
        self.radius, self.large, self.words, self.schema = radius, large, words, schema

    def links(self, key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([edge, [len(key)]]))
        run, each = np.repeat(np.arange(len(edge)), size), np.repeat(size, size)
        a, b = [], []
        pick = np.flatnonzero((each > 1) & (each <= SHORT))
        if len(pick):
            own, parent = node[pick], {}

            def find(i):
                while parent.get(i, i) != i:
                    parent[i] = i = parent.get(parent[i], parent[i])
                return i

            tree = []
            for i, j in short_links(fp[pick], run[pick], SHORT, self.radius):
                x, y = find(i), find(j)
                if x != y:
                    parent[y] = x
                    tree.append((i, j))
            pairs = np.array(tree, dtype=np.int64).reshape(-1, 2)
            a.append(own[pairs[:, 0]])
            b.append(own[pairs[:, 1]])
        for k in np.flatnonzero(size > SHORT):
            own = node[edge[k] : edge[k] + size[k]]
            via = long_links(fp[edge[k] : edge[k] + size[k]], self.radius)
            reached = np.flatnonzero(via != np.arange(len(own)))
            a.append(own[reached])
            b.append(own[via[reached]])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def out(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=self.schema)

    def skip(self, bucket: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": [None], "b": [None], "large": [bucket]}, schema=self.schema)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, node, sig) to links; a bucket over the limit gives one row with its name and no link."""
        key, node, fp = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, self.words), np.uint64)
        skipped = None
        for batch in batches:
            more = batch.column(1).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(-1, self.words) if self.words > 1 else more.view(np.uint64)[:, None]
            key, node, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([node, more]), np.concatenate([fp, sig])
            if skipped is not None:
                rest = key != skipped
                key, node, fp = key[rest], node[rest], fp[rest]
            if len(key) < 1 << 15:
                continue
            ends = np.flatnonzero(key[1:] != key[:-1])
            last = int(ends[-1]) + 1 if len(ends) else 0  # the last bucket may go on
            if last:
                yield self.out(*self.links(key[:last], node[:last], fp[:last]))
                key, node, fp = key[last:], node[last:], fp[last:]
            if len(key) > self.large:
                skipped = int(key[-1])
                yield self.skip(skipped)
                key, node, fp = key[:0], node[:0], fp[:0]
        if len(key):
            each = np.unique(key, return_counts=True)
            for bucket in each[0][each[1] > self.large].tolist():
                yield self.skip(bucket)
            rest = ~np.isin(key, each[0][each[1] > self.large])
            if rest.any():
                yield self.out(*self.links(key[rest], node[rest], fp[rest]))


def key_bits(nodes: int) -> int:
    """Bits of a key for so many fingerprints: with random bits, about one fingerprint a bucket."""
    return max(16, math.ceil(math.log2(max(2, nodes))))


def blocks_for(nodes: int, radius: int = RADIUS) -> tuple[int, ...]:
    """Sizes of the fewest blocks of which every choice that radius differing bits can leave unchanged is as wide as key_bits asks."""
    n = next(n for n in range(radius + 2, 65) if (n - radius) * (64 // n) >= min(key_bits(nodes), 64 - 2 * radius))
    return tuple(64 // n + (k < 64 % n) for k in range(n))


def buckets(nodes: DataFrame, blocks: tuple[int, ...], radius: int = RADIUS) -> DataFrame:
    """bucket, node: each fingerprint of one word once for every choice of blocks of which radius differing bits must leave one unchanged."""
    edge = np.concatenate([[0], np.cumsum(blocks)])
    masks = []
    for chosen in combinations(range(len(blocks)), len(blocks) - radius):
        mask = sum(((1 << blocks[k]) - 1) << int(edge[k]) for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("node").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)))
    return nodes.select(F.explode(keys).alias("bucket"), "node")


def samples(nodes: int, words: int, radius: int, miss: float = MISS) -> np.ndarray:
    """The bits of each key (rows): as many keys as it takes for two fingerprints radius bits apart to meet with probability 1 - miss.

    Keys take turns through random orders of all bits, so no bit is sampled much more often than another.
    """
    bits, width = 64 * words, key_bits(nodes)
    n = math.ceil(math.log(miss) / math.log1p(-((1 - radius / bits) ** width)))
    rng = np.random.default_rng(SEED)
    each = bits // width
    return np.concatenate([rng.permutation(bits)[: each * width].reshape(each, width) for _ in range(-(-n // each))])[:n]


def wide_buckets(nodes: DataFrame, words: int, chosen: np.ndarray) -> DataFrame:
    """bucket, node, sig: each fingerprint of several words once for every key."""
    schema = "bucket bigint, node bigint, sig binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    weight = np.uint64(1) << np.arange(chosen.shape[1], dtype=np.uint64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            for k, own in enumerate(chosen):
                key = bits[:, own].astype(np.uint64) @ weight
                key = (key + np.uint64(k << 40 & (1 << 63) - 1)) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], schema=arrow)

    return nodes.select("node", "sig").mapInArrow(run, schema)


def links(nodes: DataFrame, radius: int = RADIUS, large: int = LARGE, words: int = 1, meeting: int | None = None) -> DataFrame:
    """a, b: links between nodes that connect all those within the radius of one another that share a bucket.

    With one word every two within the radius do. With several words, two that differ in `meeting` bits (the radius unless given) share
    a bucket with probability 1 - MISS, closer ones more likely.
    """
    schema = "a bigint, b bigint, large bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    n = nodes.count()
    dealt = buckets(nodes, blocks_for(n, radius), radius) if words == 1 else wide_buckets(nodes, words, samples(n, words, meeting or radius))
    columns = dealt.columns[1:]
    linked = lambda rows, most: rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: Linker(radius, most, words, arrow).run(batches), schema)
    # Buckets are named by a hash; should two share a name, more fingerprints are compared, which does no harm.
    first = materialise(linked(dealt, large), "links")
    found = first.filter("large IS NULL").select("a", "b")
    over = first.filter("large IS NOT NULL").select(F.col("large").alias("bucket")).distinct()
    if over.isEmpty():
        return found
    # Large buckets: their fingerprints fall into parts by hash, and every pair of parts is compared by itself.
    members = dealt.join(over, "bucket")
    parts = members.groupBy("bucket").agg(F.ceil(F.count("*") * 3 / large).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
    pairs = members.join(parts.hint("merge"), "bucket").withColumn("own", own).select("bucket", *columns, "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    named = pairs.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), *columns).distinct()
    return found.unionByName(linked(named, 1 << 62).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, large: int = LARGE, words: int = 1, similarity: float | None = None) -> DataFrame:
    """doc_id, node, component_id for every row: the smallest id among all documents reachable over links.

    With a similarity only links between texts whose sets of shingles have at least this Jaccard similarity count.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle, words), "fingerprints")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), *([F.any_value("sig").alias("sig")] if words > 1 else []))
    nodes = materialise(nodes, "nodes")
    found = links(nodes.drop("least"), radius, large, words, meeting=radius_of(similarity, 64 * words) if similarity is not None else None)
    if similarity is not None:
        found = verified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), nodes, found, shingle, words, radius, similarity)
    labels = components(found)
    labelled = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    labelled = materialise(labelled, "labels")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = materialise(labelled.join(least, "root").select("node", "component_id"), "labels")
    return rows.join(by_node.hint("merge"), "node").select("doc_id", "node", "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    tokens = (text or "").encode().translate(LOWER).split()
    n = max(1, len(tokens) - shingle + 1)
    h = {xxhash.xxh64_intdigest(b" ".join(tokens[i : i + shingle])) & 0xFFFFFFFF for i in range(n)} if tokens else ()
    return np.sort(np.fromiter(h, dtype="<u4", count=len(h)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def similar(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets (sorted, as one is) have this Jaccard similarity to one."""
    size = np.array([len(x) for x in others], dtype=np.int64)
    each = np.concatenate([np.empty(0, "<u4"), *others])
    at = np.searchsorted(one, each)
    shared = np.concatenate([[0], np.cumsum(one[np.minimum(at, len(one) - 1)] == each)]) if len(one) else np.zeros(len(each) + 1, np.int64)
    ends = np.cumsum(size)
    both = shared[ends] - shared[ends - size]
    return both / np.maximum(1, size + len(one) - both) >= similarity


def confirmed_links(fp: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links within the radius between sets as similar as asked: no other link closes a node, so none of them hides one."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    left, frontier, tree = np.arange(len(fp)), [], []
    while len(left):
        if frontier:
            i = frontier.pop()
        else:
            i, left = int(left[0]), left[1:]
        within = np.bitwise_count(fp[left] ^ fp[i]).sum(axis=1) <= radius
        within &= np.minimum(size[left], size[i]) / np.maximum(1, np.maximum(size[left], size[i])) >= similarity
        hits = np.flatnonzero(within)
        hits = hits[similar(sets[i], [sets[j] for j in left[hits]], similarity)]
        reached = left[hits].tolist()
        tree += [(i, j) for j in reached]
        frontier += reached
        left = np.delete(left, hits)
    return tree


def verified(docs: DataFrame, nodes: DataFrame, found: DataFrame, shingle: int, words: int, radius: int, similarity: float, most: int = GROUP_BYTES) -> DataFrame:
    """Links that connect all texts as similar as asked and within the radius that lie in one component of found.

    A spanning tree of looser links does not hold every link, so all texts of its component are compared anew. Only texts with a link are read
    again; each node stands for the texts that share its fingerprint. Components of over most bytes fall into parts by hash, and every pair of
    parts is compared by itself.
    """
    loose = materialise(components(found), "loose")
    wanted = materialise(nodes.join(loose, "node").select(F.col("least").alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), "wanted")
    again = docs.join(F.broadcast(wanted) if small_enough(wanted, 16) else wanted.hint("merge"), "doc_id")
    schema = "node bigint, sig binary, shingles binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def sets(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            sig = [fingerprint(t, shingle, words) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) if words > 1 else x[0] for x in sig], dtype=np.uint64).view(np.int64)
            columns = [pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([shingle_set(t, shingle).tobytes() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(node), *columns], schema=arrow)

    held = again.select("text").mapInArrow(sets, schema).groupBy("node").agg(F.any_value(F.struct("sig", "shingles")).alias("x")).select("node", "x.*")
    held = materialise(held.join(loose.hint("merge"), "node"), "shingles")
    over = held.groupBy("root").agg(F.sum(F.length("sig") + F.length("shingles")).alias("bytes")).filter(F.col("bytes") > most).select("root", F.ceil(F.col("bytes") * 3 / most).cast("int").alias("parts"))
    over = materialise(over, "over")
    parted = held.join(F.broadcast(over) if small_enough(over, 16) else over.hint("merge"), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parted = parted.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Groups are named by a hash; should two share a name, more texts are compared, which does no harm.
    named = parted.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node", "sig", "shingles")
    kept = to_arrow_schema(StructType.fromDDL("a bigint, b bigint"))

    def confirm(batches):
        group, node, sig, held_ = None, [], [], []

        def out():
            tree = confirmed_links(np.frombuffer(b"".join(sig), dtype="<u8").reshape(len(sig), -1), held_, radius, similarity)
            return pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in tree], pa.int64()), pa.array([node[j] for _, j in tree], pa.int64())], schema=kept)

        for batch in batches:
            for g, k, s, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group and node:
                    yield out()
                    node, sig, held_ = [], [], []
                group = g
                node.append(k)
                sig.append(s)
                held_.append(np.frombuffer(x, dtype="<u4"))
        if node:
            yield out()

    return named.repartition("group").sortWithinPartitions("group").mapInArrow(confirm, "a bigint, b bigint")


def radius_of(similarity: float, bits: int) -> int:
    """Differing bits to expect between texts whose shingle sets have this Jaccard similarity."""
    cosine = 2 * similarity / (1 + similarity)
    return round(bits * math.acos(cosine) / math.pi)


#: Filtering takes shingles of five words and a similarity of 0.8. Fingerprints of 512 bits tell the similarity to within
#: about 0.03, so links are sought from MARGIN below on and then checked on the shingles themselves.
FILTER_SHINGLE, FILTER_SIMILARITY, FILTER_WORDS, MARGIN = 5, 0.8, 8, 0.06


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = FILTER_SIMILARITY) -> DataFrame:
    """The rows whose document has the smallest id of its group, and rows without an id. Ids name documents: rows with one id stay or go together."""
    radius = radius_of(similarity - MARGIN, 64 * FILTER_WORDS)
    rows = near_duplicates(docs, id_col, text_col, FILTER_SHINGLE, radius, words=FILTER_WORDS, similarity=similarity)
    gone = materialise(rows.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    return docs.join(F.broadcast(gone) if small_enough(gone, 16) else gone, id_col, "left_anti").select(docs.columns)
