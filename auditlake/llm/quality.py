"""Quality rules whose cutoffs are risk-controlled, in DataFrame functions throughout.

Each document gets a few scores (higher is worse). The cutoffs of all of them are tightened in turn along one path fixed beforehand,
so each step rejects what the one before it does and a little more. Labelled documents are a holdout: for each stratum and step the
documents of good quality that the step would reject are counted, and the exact binomial tail tests "this step rejects more than
alpha of the good documents". Steps are tested from the mildest on and only as long as each passes (fixed sequence, no further correction
within a stratum); strata share delta equally (Bonferroni). The strictest step that passed is used. With probability
1 - delta, no stratum loses more than alpha of its good documents to the scores.
A stratum with too few labels (under log(strata / delta) / alpha, about 90 of four strata's) certifies nothing, and its documents are kept
unless a base rule rejects them.

Defined cases: null texts have no words (and fail by the least word count); null strata are a stratum of their own;
labels may be missing, repeated (any bad one makes the document bad) or null (ignored); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CLASS, materialise, small_enough, text_of

WINDOW = 8
MIN_WORDS = 20
#: Percent of words in repeated windows from which a document fails.
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Risk:
    """alpha: falsely rejected share of a stratum's good documents, over all scores together. delta: chance to exceed it anywhere."""

    alpha: float = 0.05
    delta: float = 0.05
    label: str = "quality"
    stratum: str = "lang"


#: The method's scores, as expressions over the measured columns, and their grids from mild to strict.
SCORES = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", [0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "word_length_off": ("abs(word_chars / greatest(n_words, 1) - 6)", [30, 24, 20, 16, 12, 10, 8, 6, 5, 4]),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35]),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", [0.3, 0.27, 0.24, 0.21, 0.2]),
}


def steps() -> list[tuple[str, float]]:
    """Which score is tightened to which cutoff, step by step: all scores in turn."""
    longest = max(len(grid) for _, grid in SCORES.values())
    return [(rule, float(grid[k])) for k in range(longest) for rule, (_, grid) in SCORES.items() if k < len(grid)]


def bind(value: Column, use) -> Column:
    """use(value), with the value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """How many words lie in an n-word window that occurs twice or more in the text."""

    def covered(windows: Column) -> Column:
        # Equal windows are neighbours in sorted order; each covers n words from its place on, overlaps count once.
        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (x["w"] == F.get(s, i - 1)["w"]) | (x["w"] == F.get(s, i + 1)["w"]))
            return F.array_sort(F.transform(same, lambda x: x["p"]))

        placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
        gaps = lambda p: F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(n)), F.lit(n)))
        total = bind(bind(placed, places), lambda p: F.aggregate(gaps(p), F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(total)

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return bind(words, lambda w: F.when(F.size(w) < n + 1, F.lit(0).cast("bigint")).otherwise(bind(windows(w), covered)))


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The base measures of every whole text, beside a struct (row) of the columns to keep."""
    text = text_of(text_col)
    words = lambda t: F.filter(F.split(t, WS_CLASS + "+", -1), lambda w: w != "")
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    spaces = " \t\n\x0b\x0c\r"
    split = docs.select(
        F.struct(*keep).alias("row"),
        F.length(F.translate(text, spaces, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        bind(lines(text), lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
        bind(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return split.select("row", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words").withColumn("base_failed", failed)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p), summed in logarithms so that no term underflows before it matters."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    total = F.when(k <= 0, start["sum"]).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1))), start, step, lambda s: s["sum"]))
    # Beyond the mean the tail is over one half, which no level of a test reaches.
    return F.when(k > n * F.lit(p), F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def first_rejection() -> Column:
    """The first step that rejects a document, or the number of steps."""
    path = steps()
    places = []
    for rule in SCORES:
        own = [(k, cutoff) for k, (r, cutoff) in enumerate(path) if r == rule]
        place = F.lit(len(path))
        for k, cutoff in reversed(own):
            place = F.when(F.col(rule) > cutoff, k).otherwise(place)
        places.append(place)
    return F.least(*places)


def certify(scored: DataFrame, labels: DataFrame, risk: Risk, id_col: str = "doc_id") -> DataFrame:
    """stratum, step: the strictest certified step of each. scored: id, stratum, base_failed and first (see first_rejection)."""
    good = labels.filter(F.col(risk.label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(risk.label).alias("good")).filter("good = 1").select("id")
    held = scored.filter(~F.col("base_failed")).join(good, "id", "left_semi")
    counts = held.groupBy("stratum", "first").agg(F.count("*").alias("n"))
    by_stratum = materialise(counts.groupBy("stratum").agg(F.sum("n").alias("total"), F.collect_list(F.struct("first", "n")).alias("hits")), "strata")
    level = risk.delta / max(1, by_stratum.count())
    tested = by_stratum.select("stratum", "total", "hits", F.explode(F.sequence(F.lit(0), F.lit(len(steps()) - 1))).alias("step"))
    rejected = F.aggregate(F.filter("hits", lambda h: h["first"] <= F.col("step")), F.lit(0).cast("bigint"), lambda a, h: a + h["n"])
    tested = tested.withColumn("p", binomial_tail(rejected, F.col("total"), risk.alpha))
    so_far = Window.partitionBy("stratum").orderBy("step")
    passed = tested.withColumn("passed", F.min((F.col("p") <= level).cast("int")).over(so_far)).filter("passed = 1")
    return passed.groupBy("stratum").agg(F.max("step").alias("step"))


def decide(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), keep: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """row (a struct of the columns to keep), the base measures, base_failed, the scores and kept for every document."""
    keep = keep or docs.columns
    measured = measure(docs, keep, text_col).select("*", *(F.expr(e).cast("double").alias(rule) for rule, (e, _) in SCORES.items()))
    measured = materialise(measured.withColumn("first", first_rejection()), "quality")
    scored = measured.select(F.col(f"row.{id_col}").alias("id"), F.col(f"row.{risk.stratum}").alias("stratum"), "base_failed", "first")
    certified = materialise(certify(scored, labels, risk, id_col).withColumnRenamed("stratum", "of"), "cutoffs")
    side = F.broadcast(certified) if small_enough(certified, 256) else certified.hint("merge")
    out = measured.join(side, F.col(f"row.{risk.stratum}").eqNullSafe(F.col("of")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("step").isNull() | (F.col("first") > F.col("step"))))
