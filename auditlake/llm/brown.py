"""Language-model scores from Brown classes.

Training documents are those whose crc32(id as text) mod 7 is not 2. Tokens are words with A to Z lower-cased, and
one end per document. Every word of the training documents gets one of CLASSES classes; the end is a class of its own, words not
seen in training another. A token's probability is that of its class after the class before it, times the word's share of its class.

Classes come by exchange clustering, which assigns a word to the class by which the class bigrams' likelihood grows most:
1. The SEEDS most frequent words on the driver, one word at a time, until no word moves.
2. The head (at most HEAD words, by count) against the seeds' class bigrams: workers count each word's neighbours by class, and
   every word is exchanged by itself while all others stay (distributed exchange).
3. The whole vocabulary in the same way against the head's class bigrams, head words included, however large it is.

The chance of an unseen word after a class is that of words that were seen once; what is left is shared by add-ALPHA among the classes.
All probabilities after a class sum to one. Counts cover all training documents. Only what has a bound leaves the executors: the head,
and class bigrams. Classes and counts of all other words are joined to the documents that hold them.

Defined cases: null and empty texts are the end alone; a null id is written as the empty text; without training
documents all counts are 0; repeated rows are scored, and learnt from, once a row; words that never stand beside a word of the head go
to the class of most tokens; ties go to the first class; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialise

SEEDS, CLASSES, HEAD, ALPHA = 1024, 64, 200_000, 0.5
#: No word holds a line feed, so this names the end.
END = b"\n"
#: Bytes of texts that are split into words at a time.
CHUNK = 1 << 24
#: Counts up to here have their gains in a table.
TABLED = 64
#: Words whose gains are held at a time.
WORDS = 1024
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: In a document's classes: a word that isn't in the head yet, and the mark of words seen once.
REST, ONCE = 255, 128
#: Size class of a count, as an expression.
SIZE = "CAST(floor(log2(c) * 8) AS INT)"


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


class Tokens(NamedTuple):
    words: pa.Array  # the distinct words of some rows
    code: np.ndarray  # of each token, the place of its word, or len(words) for an end
    start: np.ndarray  # of each row's tokens, and the end

    def before(self) -> np.ndarray:
        """The code before each token; a text begins after an end."""
        return np.concatenate([[len(self.words)], self.code[:-1]])


def tokenized(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, Tokens]]:
    """(first row, tokens) of so many rows at a time as have `most` bytes, one at least."""
    texts = texts.cast(pa.large_string()).fill_null("")
    rows = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(rows, rows[at] + most, side="right")) - 1)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[rows[at] : rows[stop]]
        edge = np.zeros(len(data) + 1, dtype=bool)
        own = rows[at : stop + 1] - rows[at]
        edge[own] = True
        word = ~SPACE[data]
        apart = np.concatenate([[False], word, [False]])
        first = np.flatnonzero(word & (~apart[:-2] | edge[:-1]))
        last = np.flatnonzero(word & (~apart[2:] | edge[1:]))
        offsets = np.concatenate([[0], np.cumsum(last - first + 1)])
        named = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[word]])]).dictionary_encode()
        words = named.dictionary.cast(pa.binary())
        start = np.searchsorted(first, own) + np.arange(len(own))
        code = np.full(len(first) + stop - at, len(words), dtype=np.int64)
        is_word = np.ones(len(code), dtype=bool)
        is_word[start[1:] - 1] = False
        code[is_word] = named.indices.to_numpy()
        yield at, Tokens(words, code, start)
        at = stop


def word_counts(training: DataFrame) -> DataFrame:
    """word, c over the texts of the one column of training."""
    schema = "word binary, c bigint"
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            for _, t in tokenized(batch.column(0)):
                words = pa.concat_arrays([t.words, pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(t.code, minlength=len(words)))], schema=arrow)

    return training.mapInArrow(run, schema).groupBy("word").agg(F.sum("c").alias("c"))


def least_size(counts: DataFrame, most: int = HEAD) -> int:
    """The size class of counts from which on there are at most `most` words."""
    classes = sorted(((r["size"], r["n"]) for r in counts.groupBy(F.expr(SIZE).alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 1 << 30, 0
    for k, n in classes:
        total += n
        if total > most:
            break
        least = k
    return least


class Words(NamedTuple):
    """Known words and a label of each."""

    words: pa.Array
    label: np.ndarray

    def of(self, words: pa.Array, other: int, end: int) -> np.ndarray:
        """Labels by code: of those words, and of the end."""
        place = pc.index_in(words, self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.append(np.where(place >= 0, self.label[place] if len(self.label) else other, other), end)


def pair_table(training: DataFrame, known: Words, end: int, other: int, width: int) -> np.ndarray:
    """How often each label follows each, as a square; width is its bounded side."""
    schema = "pair bigint, n bigint"
    arrow, sent = _arrow(schema), training.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        table = np.zeros(width * width, dtype=np.int64)
        for batch in batches:
            for _, t in tokenized(batch.column(0)):
                label = sent.value.of(t.words, other, end)
                table += np.bincount(label[t.before()] * width + label[t.code], minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], schema=arrow)

    rows = training.mapInArrow(run, schema).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width * width)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(width, width)


def exchange(pairs: np.ndarray, fixed: dict[int, int], classes: int, rounds: int | None = None) -> np.ndarray:
    """Classes of words from their pair counts (a square matrix). fixed: words that stay in a class, numbered from `classes` on.

    Moving a word changes its class bigrams' rows and columns only, so each move's gain in sum n log n is exact up to rounding. Moves
    must gain more than rounding can, so the likelihood rises with each and the search ends; without `rounds` it goes on until no word moves.
    """
    n, total = len(pairs), classes + len(set(fixed.values()))
    of = np.array([fixed.get(w, w % classes) for w in range(n)])
    xlog = lambda x: x * np.log(np.maximum(x, 1))
    one = np.eye(total)[of]
    right, left = pairs @ one, pairs.T @ one  # counts of each word before and after each class
    table = one.T @ right
    rows = table.sum(axis=1)
    columns = table.sum(axis=0)
    out, into = pairs.sum(axis=1), pairs.sum(axis=0)
    choice = np.arange(classes)
    least = max(1e-9, 64 * np.finfo(float).eps * float(xlog(pairs.sum())))
    for _ in count() if rounds is None else range(rounds):
        moved = 0
        for w in range(n):
            if w in fixed:
                continue
            c, r, l, own = of[w], right[w].copy(), left[w].copy(), pairs[w, w]
            r[c] -= own
            l[c] -= own
            # Without the word:
            table[c] -= r
            table[:, c] -= l
            table[c, c] -= own
            rows[c] -= out[w]
            columns[c] -= into[w]
            t = table[:classes]
            gain = (xlog(t + r) - xlog(t)).sum(axis=1) + (xlog(table[:, :classes] + l[:, None]) - xlog(table[:, :classes])).sum(axis=0)
            d = table[choice, choice]  # a class's pairs with itself get both, and the word's own
            gain += xlog(d + r[:classes] + l[:classes] + own) - xlog(d + r[:classes]) - xlog(d + l[:classes]) + xlog(d)
            gain -= xlog(rows[:classes] + out[w]) - xlog(rows[:classes]) + xlog(columns[:classes] + into[w]) - xlog(columns[:classes])
            best = int(gain.argmax())
            if gain[best] <= gain[c] + least:
                best = c
            table[best] += r
            table[:, best] += l
            table[best, best] += own
            rows[best] += out[w]
            columns[best] += into[w]
            if best != c:
                moved += 1
                of[w] = best
                right[:, c] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                left[:, c] -= pairs[w]
                left[:, best] += pairs[w]
        if not moved:
            break
    return of


#: One neighbour's class (the class before, or the number of classes and the end more for the class behind) and how often.
EVENT = np.dtype([("key", "u1"), ("n", "<u4")])


def contexts(training: DataFrame, known: Words, classes: int, all_words: bool) -> DataFrame:
    """word, c, events: each word's occurrences and its neighbours by class, once for each chunk of texts. Neighbours without a class don't count."""
    schema = "word binary, c bigint, events binary"
    arrow, sent = _arrow(schema), training.sparkSession.sparkContext.broadcast(known)
    side = classes + 1

    def run(batches):
        for batch in batches:
            for _, t in tokenized(batch.column(0)):
                label = sent.value.of(t.words, -1, classes).astype(np.int16)
                wanted = np.append(np.ones(len(t.words), bool) if all_words else pc.is_in(t.words, sent.value.words).to_numpy(zero_copy_only=False), False)
                here, before = label[t.code], label[t.before()]
                own = wanted[t.code]
                left = own & (before >= 0)
                behind = np.append(here[1:], -1)  # only an end is last
                right = own & (behind >= 0)
                keys = np.concatenate([t.code[left] * (2 * side) + before[left], t.code[right] * (2 * side) + side + behind[right]])
                keys = keys.astype(np.int32) if (len(t.words) + 1) * 2 * side < 1 << 31 else keys
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
                events = np.empty(len(first), dtype=EVENT)
                events["key"] = keys[first] % (2 * side)
                events["n"] = np.diff(np.append(first, len(keys)))
                size = np.bincount(keys[first] // (2 * side), minlength=len(t.words))[: len(t.words)]
                offsets = np.concatenate([[0], np.cumsum(size * EVENT.itemsize)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(t.words), [None, pa.py_buffer(offsets), pa.py_buffer(events.tobytes())])
                out = pa.RecordBatch.from_arrays([t.words, pa.array(np.bincount(t.code, minlength=len(t.words) + 1)[: len(t.words)]), packed], schema=arrow)
                yield out if all_words else out.filter(pa.array(wanted[:-1]))

    return training.mapInArrow(run, schema)


def xlog(x):
    return x * np.log(np.maximum(x, 1))


class Exchange:
    """Moves words to the class by which sum n log n of class bigrams, less that of the classes, grows most, all other words staying."""

    def __init__(self, table: np.ndarray, classes: int):
        self.classes, side = classes, classes + 1
        t = table[:side, :side]
        #: By event: counts with each class, for a class before the word and behind it.
        self.with_class = np.concatenate([t[:, :classes], t[:classes].T])
        self.rows, self.columns = t.sum(axis=1)[:classes], t.sum(axis=0)[:classes]
        n = np.arange(TABLED + 1)
        self.gain = (xlog(self.with_class + n[:, None, None]) - xlog(self.with_class)).astype(np.float32)
        self.common = int(self.rows.argmax())

    def best(self, counts: np.ndarray, now: np.ndarray) -> np.ndarray:
        """The class of each word: counts of its events (rows of words), now its class before, or -1. A word's pairs with itself count as with its class."""
        return np.concatenate([np.empty(0, np.int64), *(self._best(counts[k : k + WORDS], now[k : k + WORDS]) for k in range(0, len(counts), WORDS))])

    def _best(self, counts: np.ndarray, now: np.ndarray) -> np.ndarray:
        side, total = self.classes + 1, np.zeros((len(counts), self.classes))
        word, key = np.nonzero(counts)
        n = counts[word, key]
        worth = np.empty((len(n), self.classes), dtype=np.float32)
        small = n <= TABLED
        worth[small] = self.gain[n[small], key[small]]
        held = self.with_class[key[~small]]
        worth[~small] = xlog(held + n[~small, None]) - xlog(held)
        # Where the word is counted already, what it adds is what it would take away.
        own = now[word]
        at = np.flatnonzero(own >= 0)
        held = self.with_class[key[at], own[at]]
        worth[at, own[at]] = xlog(held) - xlog(np.maximum(held - n[at], 0))
        if len(n):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            total[word[first]] = np.add.reduceat(worth, first)
        for own_sum, sums in ((counts[:, side:].sum(axis=1), self.rows), (counts[:, :side].sum(axis=1), self.columns)):
            cost = xlog(sums + own_sum[:, None]) - xlog(sums)
            at = np.flatnonzero(now >= 0)
            cost[at, now[at]] = xlog(sums[now[at]]) - xlog(np.maximum(sums[now[at]] - own_sum[at], 0))
            total -= cost
        return np.where(counts.any(axis=1), total.argmax(axis=1), self.common)


def exchanged(events: DataFrame, known: Words, table: np.ndarray, classes: int) -> DataFrame:
    """word, c, class of each word of events; known has the classes before."""
    schema = "word binary, c bigint, class int"
    arrow, sent = _arrow(schema), events.sparkSession.sparkContext.broadcast((known, table))
    width = 2 * (classes + 1)

    def assign(by: Exchange, words: pa.Array, c: np.ndarray, packed: pa.Array) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
        size = pc.binary_length(packed).to_numpy(zero_copy_only=False) // EVENT.itemsize
        e = _content(packed).view(EVENT)
        counts = np.bincount(np.repeat(group, size) * width + e["key"], weights=e["n"], minlength=len(first) * width).astype(np.int64).reshape(-1, width)
        own = words.take(pa.array(first))
        best = by.best(counts, sent.value[0].of(own, -1, -1)[:-1])
        return pa.RecordBatch.from_arrays([own, pa.array(np.add.reduceat(c, first)), pa.array(best.astype(np.int32))], schema=arrow)

    def run(batches):
        by, held = Exchange(sent.value[1], classes), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            words = batch.column(0)
            same = pc.equal(words, words[-1]).to_numpy(zero_copy_only=False)
            ready = int(np.argmax(same))  # the last word may go on
            held = batch.slice(ready)
            if ready:
                done = batch.slice(0, ready)
                yield assign(by, done.column(0), done.column(1).to_numpy(), done.column(2))
        if held is not None:
            yield assign(by, held.column(0), held.column(1).to_numpy(), held.column(2))

    return events.repartition("word").sortWithinPartitions("word").mapInArrow(run, schema)


class Model:
    """What scoring needs: the head's counts and classes, the sizes of all classes, and (once counted) the logarithms of transitions."""

    def __init__(self, n: int, v: int, ends: int, head: Words, head_counts: np.ndarray, in_class: np.ndarray):
        self.classes = len(in_class)
        self.end, self.unseen = self.classes, self.classes + 1
        self.head, self.counts, self.in_class = head, head_counts, in_class
        self.all = math.log10(n + v + 1)  # base: log10(c + 1) - all
        self.ends = ends

    def emission(self, c: np.ndarray, of: np.ndarray) -> np.ndarray:
        """log10 of the share of words counted c in their classes; an unseen word is all of its class."""
        return np.where(c > 0, np.log10(np.maximum(c, 1) / np.maximum(self.in_class[np.minimum(of, self.classes - 1)], 1)), 0.0)

    def transitions(self, pairs: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
        """log10 of the probability of each class after each, by the bytes of documents' classes. pairs: how often byte follows byte in training."""
        pairs = pairs.reshape(256, 256).astype(float)
        after = pairs[:ONCE] + pairs[ONCE:]
        after[self.unseen] += pairs[ONCE:].sum(axis=0)  # after an unseen word as after words seen once
        once = after[:, ONCE:].sum(axis=1)
        seen = (after[:, :ONCE] + after[:, ONCE:])[:, : self.end + 1]
        total = seen.sum(axis=1)
        new = (once + alpha) / (total + 2 * alpha)
        p = np.zeros((ONCE, ONCE))
        p[:, : self.end + 1] = (1 - new)[:, None] * (seen + alpha) / (total + alpha * (self.end + 1))[:, None]
        p[:, self.unseen] = new
        return np.log10(np.maximum(p, 1e-300))


def train(training: DataFrame, seeds: int = SEEDS, classes: int = CLASSES, head_most: int = HEAD) -> tuple[Model, DataFrame, int]:
    """The model without transitions, the table word, c, class of the whole vocabulary, and the number of training tokens."""
    if classes > ONCE - 3:
        raise ValueError(f"{classes} classes; at most {ONCE - 3} fit into a byte with the marks")
    counts = materialise(word_counts(training), "words")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    words = counts.filter(F.col("word") != F.lit(END))
    least = least_size(words, head_most)
    head = words.filter(f"{SIZE} >= {least}").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    names = head["word"].combine_chunks().cast(pa.binary())
    seed_words = names[:seeds]
    k = len(seed_words)
    matrix = pair_table(training, Words(seed_words, np.arange(k)), k, k + 1, k + 2)
    of = exchange(matrix, {k: classes, k + 1: classes + 1}, classes)[:k]
    seeded = Words(seed_words, of)
    one = np.eye(classes + 1)[np.append(of, classes)]
    table = one.T @ matrix[: k + 1, : k + 1] @ one
    known = seeded
    if len(names) > k:
        found = exchanged(contexts(training, Words(names, _labels(names, seeded)), classes, False), seeded, table, classes).toArrow()
        known = Words(names, _labels(names, Words(found["word"].combine_chunks().cast(pa.binary()), found["class"].to_numpy())))
    table = pair_table(training, known, classes, classes + 1, classes + 2)
    assigned = materialise(exchanged(contexts(training, known, classes, True), known, table, classes), "classes")
    in_class = np.zeros(classes)
    for r in assigned.groupBy("class").agg(F.sum("c").alias("c")).collect():
        in_class[r["class"]] = r["c"]
    head = assigned.filter(f"{SIZE} >= {least}").toArrow()
    final = Words(head["word"].combine_chunks().cast(pa.binary()), head["class"].to_numpy())
    return Model(n, v, ends, final, head["c"].to_numpy(), in_class), assigned, n


def _labels(names: pa.Array, known: Words) -> np.ndarray:
    return known.of(names, -1, -1)[:-1]


def _row_sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of each row's values; every row has one at least."""
    return np.add.reduceat(values, start[:-1]) if len(values) else np.zeros(len(start) - 1)


def _binary(data: np.ndarray, start: np.ndarray) -> pa.Array:
    """Rows of bytes from items and each row's first one."""
    return pa.Array.from_buffers(pa.large_binary(), len(start) - 1, [None, pa.py_buffer((start * data.itemsize).astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _content(column: pa.Array) -> np.ndarray:
    """All bytes of a column of binaries without nulls, one row's after the other's."""
    if not len(column):
        return np.empty(0, dtype=np.uint8)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Items of all rows' bytes, and each row's first one."""
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    return _content(column.fill_null(b"")).view(kind), np.concatenate([[0], np.cumsum(size)])


def first_look(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """Each document's classes with what the head tells, and the words that need theirs joined: the distinct ones, and which of them stands where."""
    schema = f"key bigint, doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emission double, classes binary, places binary, rest array<binary>"
    arrow, sent = _arrow(schema), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for row, t in tokenized(batch.column(3), CHUNK // 2):
                place = np.append(pc.index_in(t.words, m.head.words).fill_null(-1).to_numpy(zero_copy_only=False), -1)
                known = place >= 0
                c = np.where(known, m.counts[place] if len(m.counts) else 0, 0)
                of = np.where(known, m.head.label[place] if len(m.counts) else 0, 0)
                byte = np.where(known, of | np.where(c == 1, ONCE, 0), REST).astype(np.uint8)
                emission, base = np.where(known, m.emission(c, of), 0.0), np.where(known, np.log10(c + 1) - m.all, 0.0)
                byte[-1], base[-1], known[-1] = m.end, math.log10(m.ends + 1) - m.all, m.ends > 0
                n = len(t.start) - 1
                of_row = np.repeat(np.arange(n), np.diff(t.start))
                rest = np.flatnonzero(byte[t.code] == REST)
                pairs, which = _unique(of_row[rest] * (len(t.words) + 1) + t.code[rest])
                rest_row = pairs // (len(t.words) + 1)
                first = np.searchsorted(rest_row, np.arange(n + 1))
                words = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), t.words.take(pa.array(pairs % (len(t.words) + 1))))
                places = (which - first[of_row[rest]]).astype("<i4")
                columns = [np.diff(t.start), _row_sums(known[t.code].astype(np.int64), t.start), _row_sums(base[t.code], t.start), _row_sums(emission[t.code], t.start)]
                packed = [_binary(byte[t.code], t.start), _binary(places, np.searchsorted(of_row[rest], np.arange(n + 1))), words]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, n) for k in range(3)), *map(pa.array, columns), *packed], schema=arrow)

    return docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col), held_out(id_col), F.col(text_col)).mapInArrow(run, schema)


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and the place of each value among them."""
    order = np.argsort(values, kind="stable")
    new = np.concatenate([[True], values[order][1:] != values[order][:-1]]) if len(values) else np.zeros(0, bool)
    which = np.empty(len(values), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return values[order][new], which


def second_look(looked: DataFrame, model: Model) -> DataFrame:
    """The same with all classes known. looked has `found`: c and class of the rest's words, by their place among the document's."""
    schema = f"doc_id {looked.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emission double, classes binary"
    arrow, sent = _arrow(schema), looked.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            byte, start = _flat(column["classes"], "u1")
            places, _ = _flat(column["places"], "<i4")
            found = pc.list_flatten(column["found"])
            size = pc.list_value_length(column["found"]).fill_null(0).to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            at = np.repeat(first, size) + found.field("k").to_numpy(zero_copy_only=False)
            c, of = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            c[at], of[at] = found.field("c").fill_null(0).to_numpy(zero_copy_only=False), found.field("class").fill_null(m.unseen).to_numpy(zero_copy_only=False)
            byte = byte.copy()
            rest = np.flatnonzero(byte == REST)
            row = np.repeat(np.arange(n), np.diff(start))[rest]
            token = first[row] + places
            byte[rest] = of[token] | np.where(c[token] == 1, ONCE, 0)
            add = lambda values: np.bincount(row, weights=values, minlength=n)
            known = column["n_known"].to_numpy() + add(c[token] > 0).astype(np.int64)
            base = column["base_score"].to_numpy() + add(np.log10(c[token] + 1) - m.all)
            emission = column["emission"].to_numpy() + add(m.emission(c, of)[token])
            yield pa.RecordBatch.from_arrays([column["doc_id"], column["held_out"], column["n_tokens"], pa.array(known), pa.array(base), pa.array(emission), _binary(byte, start)], schema=arrow)

    return looked.mapInArrow(run, schema)


def _before(byte: np.ndarray, start: np.ndarray, end: int) -> np.ndarray:
    before = np.concatenate([[end], byte[:-1]]).astype(np.int64)
    before[start[:-1]] = end
    return before * 256 + byte


def count_pairs(rows: DataFrame, end: int) -> np.ndarray:
    """How often each byte follows each in the classes of the training documents: 65,536 counts, whatever the corpus."""
    schema = "pair bigint, n bigint"
    arrow = _arrow(schema)

    def run(batches):
        table = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            table += np.bincount(_before(*_flat(batch.column(0), "u1"), end), minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], schema=arrow)

    out = np.zeros(1 << 16, dtype=np.int64)
    for r in rows.select("classes").mapInArrow(run, schema).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, **params) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    training = docs.filter(~held_out(id_col)).select(text_col)
    model, vocabulary, n = train(training, **params)
    looked = materialise(first_look(docs, model, id_col, text_col), "scored")
    rest = looked.select("key", F.posexplode("rest").alias("k", "word")).join(vocabulary.hint("merge"), "word", "left")
    found = rest.groupBy("key").agg(F.collect_list(F.struct("k", "c", "class")).alias("found"))
    known = materialise(second_look(looked.drop("rest").join(found, "key", "left"), model), "classes")
    jump = model.transitions(count_pairs(known.filter("NOT held_out"), model.end), alpha)
    schema = f"doc_id {known.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    arrow, sent, end = _arrow(schema), docs.sparkSession.sparkContext.broadcast(jump), model.end

    def run(batches):
        wide = np.tile(sent.value, (2, 2)).ravel()  # bytes with and without the mark of words seen once
        for batch in batches:
            byte, start = _flat(batch.column(6), "u1")
            score = batch.column(5).to_numpy() + _row_sums(wide[_before(byte, start, end)], start)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(np.full(batch.num_rows, n)), batch.column(4), pa.array(score)], schema=arrow)

    return known.mapInArrow(run, schema)
