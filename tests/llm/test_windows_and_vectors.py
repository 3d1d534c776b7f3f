"""Repeated word windows, whitening and vector codes against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter

from auditlake.llm import exact_dedup, queries, substring_dedup, vector_codes, whitening
from tests.conftest import DATA

# Word windows


def kept_words(rows, window):
    """rows: (order, text). The words that stay, by order."""
    seen, out = set(), {}
    for order, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[order] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return out


def window_texts():
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    base = [f"w{rng.randrange(50)}" for _ in range(300)]
    near = [" ".join(w if rng.random() > 0.03 else f"edit{rng.randrange(9)}" for w in base) for _ in range(30)]
    return [
        None, "", " \t", "one two", passage, f"head {passage} tail", passage, passage.upper(), "x " * 100, "x  x\tx\nx " * 9, "a b c " * 30, *near, f"é　ü {passage[:60]} \x01y {passage}",
        " ".join(f"v{i % 31}" for i in range(20_000)), passage.replace("p39", "p40"), "\x0b".join(base), " ".join(base[150:] + base[:150]),
    ]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Few files in one order, so that the order of rows is that of ids; with a null id and clashing columns."""
    path = str(tmp_path_factory.mktemp("windows") / "t")
    rows = [(i, t, "x", 1) for i, t in enumerate(window_texts())] + [(None, " ".join(f"p{i}" for i in range(25)), "x", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, digest string, place int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("window", "reach", "large", "salts"), [(20, 8, 20_000, None), (20, 8, 3, 3), (6, 4, 2, 1), (5, 1, 20_000, 2), (3, 2, 1, None)])
def test_windows(texts, monkeypatch, window, reach, large, salts):
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 5_000)
    rows = [((r.doc_id is None, r.doc_id or 0), r.text) for r in texts.collect()]
    want = kept_words(rows, window)
    got = substring_dedup.remove_repeats(texts, window=window, reach=reach, prefixes=(1, 2, 4), large=large, salts=salts, with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[(r.doc_id is None, r.doc_id or 0)], r.doc_id
        assert r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest()


def test_windows_of_repeated_ids(spark):
    """Rows with one id are told apart by their place: one keeps its words, the others lose them."""
    text = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.remove_repeats(spark.createDataFrame([(1, text), (1, text), (1, text)], "doc_id bigint, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 30, 30]


def test_windows_of_nothing(texts, spark):
    assert substring_dedup.remove_repeats(texts.filter("doc_id < 0")).count() == 0
    assert substring_dedup.remove_repeats(spark.createDataFrame([(1, None), (2, None)], "doc_id bigint, text string")).collect()[0].n_words == 0


def test_every_window_has_an_anchor_that_depends_on_its_words_alone():
    rng, known, shape = random.Random(1), substring_dedup._WordHashes(), substring_dedup.Shape(10, 4)
    words = [b"w%d" % rng.randrange(4) for _ in range(400)]
    _, anchor, first, last = shape.anchored(words, known)
    of = {k: a for a, i, j in zip(anchor, first, last, strict=True) for k in range(i, j + 1)}
    assert sorted(of) == list(range(len(words) - 9))
    offset = collections.defaultdict(set)
    for k, a in of.items():
        offset[tuple(words[k : k + 10])].add(a - k)
    assert all(len(x) == 1 for x in offset.values()) and all(0 <= min(x) < 4 for x in offset.values())


def test_reach_is_checked():
    with pytest.raises(ValueError, match="power of two"):
        substring_dedup.Shape(20, 6)


# Vectors

BAD = [None, [1.0, None, 2.0, 0.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [0.0, float("-inf"), 1.0, 1.0]]


def vector_rows(n, width, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * np.linspace(1, 0.1, width)
    x[n // 2 :: 7] = x[0]
    return [(int(i), [float(np.float32(c)) for c in v], None if i % 5 == 0 else int(i % 3)) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, at string, part int")


def whole(v, scale, width):
    return [math.floor(scale * c) for c in v] + [0] * (width - len(v))


def check_whitened(got, rows, width, components=4):
    good = [(i, whole(v, 256, width)) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in good}))
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    of = {i: np.array(v) for i, v in good}
    assert len(got) == len(good) * min(components, width)
    signs = {}
    for r in got:
        k, v = r.component - 1, of[r.vec_id]
        white = (v - sums / n) @ vectors[:, k] / math.sqrt(values[k])
        sign = signs.setdefault(k, 1 if white * r.whitened > 0 else -1)
        assert r.n == n and r.deviation == int(((n * v - sums) ** 2).sum()) and math.isclose(r.explained, values[k] / values.sum(), rel_tol=1e-9)
        assert abs(white - sign * r.whitened) < 1e-8 and r.identity_error < 1e-10


@pytest.mark.parametrize(("n", "width"), [(400, 12), (60, 40), (50, 3)])
def test_whitening(spark, n, width):
    rows = vector_rows(n, width) + [(1000 + k, v, 1) for k, v in enumerate(BAD)] + [(2000, [0.5] * (width - 1), 1), (None, [0.25] * width, None)]
    check_whitened(whitening.whiten(frame(spark, rows)).collect(), rows, width)


def test_range_finder_and_its_expansion(spark):
    """Values that fall fast settle on a few columns; flat ones expand to all dimensions. Both give the same as all dimensions at once."""
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    for scales, expanded in ((2.0 ** -np.arange(32), False), (np.ones(32), True)):
        x = np.round(1e6 * (rng.normal(size=(500, 32)) * scales) @ turn).astype(int)
        fit = spark.createDataFrame([(v.tolist(),) for v in np.unique(x, axis=0)], "x array<bigint>")
        found = whitening.fit_components(fit, 32, components=3, oversampling=9)
        x = np.unique(x, axis=0)
        values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
        assert found.expanded == expanded and np.allclose(found.values, values[::-1][:3], rtol=1e-10)
        assert np.allclose(np.abs((found.vectors * vectors[:, ::-1][:, :3]).sum(axis=0)), 1, atol=1e-10)


def test_residuals_are_seen():
    assert whitening.settled(np.array([4.0, 2.0, 1.0]), np.array([1e-13, 1e-13, 1.0]), 2) and not whitening.settled(np.array([4.0, 4.0, 1.0]), np.array([1e-13, 1e-13, 1.0]), 2)


def test_whitening_without_variance(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, None, None)] * 4
    assert whitening.whiten(frame(spark, [(k, v, 1) for k, v in enumerate(BAD)])).count() == whitening.whiten(frame(spark, [(1, [], 1)])).count() == 0
    assert whitening.whiten(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def codes(rows, parts=8, entries=16, rounds=6):
    good = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max(len(v) for _, v, _ in good) // parts) * parts
    good = [(i, whole(v, 4096, width), label) for i, v, label in good]
    size = width // parts
    part = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[part(v, p) for _, v, _ in first] for p in range(parts)]

    def assign(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for _, v, _ in good:
                own[assign(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if own[e] else entry for e, entry in enumerate(books[p])]
    out, by_label = [], collections.Counter()
    for i, v, label in good:
        best = [assign(part(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted([(i, code, error, by_label[label], digest) for i, code, error, label in out], key=repr)


@pytest.mark.parametrize(("n", "width", "extra"), [(150, 24, []), (9, 12, []), (60, 16, [(998, [-1.5e5] * 16, 7)]), (40, 8, [(1, [0.1] * 8, 2), (1, [0.1] * 8, 2), (None, [0.3] * 8, None), (5000, [0.2] * 5, 1)])])
def test_codes(spark, n, width, extra):
    rows = vector_rows(n, width) + extra + [(1000 + k, v, 1) for k, v in enumerate(BAD)]
    got = vector_codes.encode(frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == codes(rows)


def test_large_entries_are_exact():
    far = 1 << 40
    best, distance = vector_codes.nearest(np.array([[far, 0], [3, 4]]), np.array([[0, 0], [far + 1, 1]]))
    assert best.tolist() == [1, 0] and distance.tolist() == [2, 25]


def test_codes_of_nothing(spark):
    assert vector_codes.encode(frame(spark, [(k, v, 1) for k, v in enumerate(BAD)])).count() == vector_codes.encode(frame(spark, [])).count() == 0


def test_vector_queries(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()]
    check_whitened(queries.QUERIES["op12_whitening"](spark, DATA).collect(), rows, 64)


# State of exact dedup between calls


def test_a_source_given_again_counts_once(spark, tmp_path):
    state = str(tmp_path / "state")
    write = lambda name, rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / name)) or str(tmp_path / name)
    sizes = lambda path: sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, path, state=state).collect())
    a, b = write("a", [(1, "x"), (2, "x"), (3, "y")]), write("b", [(4, "y"), (5, "z")])
    first = [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    assert sizes(a) == first and sizes(a) == first
    assert sizes(b) == [(4, 3, 2), (5, 5, 1)]
    assert sizes(a) == [(1, 1, 2), (2, 1, 2), (3, 3, 2)]
    write("a", [(6, "z")])  # a file more
    assert sizes(a) == [(1, 1, 2), (2, 1, 2), (3, 3, 2), (6, 5, 2)]


@pytest.mark.parametrize("breaks", ["sources", "stream"])
def test_a_call_that_broke_off_is_repeated(spark, tmp_path, monkeypatch, breaks):
    state, path = str(tmp_path / "state"), str(tmp_path / "a")
    spark.createDataFrame([(1, "x"), (2, "x")], "doc_id bigint, text string").coalesce(1).write.parquet(path)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
        if breaks == "stream":
            m.setattr(exact_dedup.Deduplicator, "advance", stop)
        else:  # between the digests and the list of sources
            mode = DataFrameWriter.mode
            m.setattr(DataFrameWriter, "mode", lambda self, how: stop() if how == "append" else mode(self, how))
        exact_dedup.exact_dedup(spark, path, state=state)
    assert sorted((r.doc_id, r.group_size) for r in exact_dedup.exact_dedup(spark, path, state=state).collect()) == [(1, 2), (2, 2)]
