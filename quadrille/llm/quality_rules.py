"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base measures and the fixed base rule come first. The method then learns further rules from labelled rows, for every
stratum on its own, among distinct texts that pass the base rule (copies count once; a text is good only if all its labels
are). They are dealt into two folds by a hash of the text:

* In the first fold, each measure's unit is the SPREAD quantile of the good texts (FLOOR at least). A text's excess is its
  greatest measure in those units, so one cutoff of the excess is a cutoff for every measure at once, and stricter cutoffs
  reject all that milder ones do. Candidates are quantiles of the excess of the bad texts.
* The good texts of the second fold are the holdout. For a cutoff that would reject k of n of them, the exact
  (Clopper-Pearson) upper bound of the false rejection rate is at most alpha exactly if P(Binomial(n, alpha) <= k) <=
  delta. Cutoffs are tried from the mildest to the strictest and the first failure ends the sequence, so the sequence needs
  no correction of its own; delta is divided by the number of strata.

With confidence 1 - DELTA, the cutoffs reject at most ALPHA of the good texts of every stratum at once: of those that pass
the base rule, which is no part of the guarantee. A stratum needs about 440 good holdout texts (4 strata; none rejected)
for a cutoff. Labelled strata with fewer are pooled to one, which is a stratum of the guarantee like any other: at most ALPHA
of the good texts of all of them together, though not of each. Their texts are still measured in their own stratum's units.
Which strata are pooled depends on counts alone, not on what a cutoff rejects. A pool with too few texts, and strata without
labels, have the base rule alone. The bound takes labelled texts as independent draws; copies count once, near copies do not.

Eight-word windows are compared by 64-bit hashes within one text (for a text of 20,000 words, a false match has a chance
below 2e-11). Defined cases: null and empty texts have no words and fail the base rule; a null stratum is a stratum of
its own; a key labelled twice counts as good only if all its labels are; an empty table, or one without labels, gives the
base rule alone; repeated rows and null keys pass through row by row; extra columns are not read, and keep_good() returns
them whatever their names are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import WHITE_SPACE, materialize, text_or_empty, words

SYMBOLS, CAPITALS = "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
ALPHA, DELTA = 0.01, 0.05
#: Quantiles of the bad texts' excess that are tried as cutoffs.
STEPS = [i / 40 for i in range(1, 40)]
#: A measure's unit: this quantile of the good texts, and the least unit.
SPREAD, FLOOR = 0.99, 0.005
#: The stratum of the guarantee that holds all strata with too few labelled texts.
POOL = "\x00small strata"
#: Measure -> its value.
MEASURES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
    "echoes": "n_echoes / greatest(n_words, 1)",
    "length": "word_chars / greatest(n_words, 1)",
    "shouts": "n_capitals / greatest(word_chars, 1)",
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated(words: Column, hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sorted by hash, equal neighbours are marked; sorted by
    position, each marked window adds the words that the one before it did not cover."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def marked(rows: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(rows))
        same = lambda a, b: F.coalesce(F.try_element_at(rows, a)["h"] == F.try_element_at(rows, b)["h"], F.lit(False))
        twice = F.filter(at, lambda k: F.when(k > 1, same(k, k - 1)).otherwise(F.lit(False)) | same(k, k + 1))
        return F.array_sort(F.transform(twice, lambda k: F.element_at(rows, k)["i"]))

    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total"))
    # The one-element transform binds the sorted array once instead of at each use.
    positions = F.element_at(F.transform(F.array(ordered), marked), 1)
    covered = F.aggregate(positions, start, step, lambda acc: acc["total"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base measures, base_failed, text_hash, and the further measures n_lines, n_echoes (words equal to the word
    before) and n_capitals (A-Z). Columns of df with one of these names are replaced."""
    made = [*BASE, "n_lines", "n_echoes", "n_capitals", "text_hash", "base_failed", "_words", "_lines", "_hashes", "_text"]
    kept = [c for c in df.columns if c not in made]
    df = df.select(*kept, text_or_empty(text).alias("_text"))
    df = df.withColumn("_words", words(F.col("_text")))
    w = F.col("_words")
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    lines = F.filter(F.split("_text", "\n"), lambda line: _without(line, WHITE_SPACE) != "")
    df = df.withColumns(
        {
            "_hashes": F.when(F.size(w) > WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
            "_lines": lines,
        }
    )
    echoes = F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, F.greatest(i - 1, F.lit(0))))))
    made_here = [
        F.size(w).cast("long").alias("n_words"),
        F.length(_without(F.col("_text"), WHITE_SPACE)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(w, F.col("_hashes")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        echoes.cast("long").alias("n_echoes"),
        (F.length("_text") - F.length(_without(F.col("_text"), CAPITALS))).cast("long").alias("n_capitals"),
        F.xxhash64("_text").alias("text_hash"),
    ]
    # A generator of one row: filters on the measures stay above it and do not repeat the work inside them.
    df = df.select(*kept, F.inline(F.array(F.struct(*made_here))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _at_most(k: Column, n: Column, rate: float) -> Column:
    """log P(Binomial(n, rate) <= k), for k < n * rate: terms by their ratio, summed as logarithms."""
    odds = math.log(rate / (1 - rate))
    first = n * math.log1p(-rate)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add, lambda acc: acc["sum"])


def _excess(units: dict[str, Column]) -> Column:
    """The greatest measure in its unit."""
    return F.greatest(*[F.expr(e).cast("double") / units[r] for r, e in MEASURES.items()])


def labelled(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """(_stratum, good, fold, the measures' columns) of each distinct labelled text that passes the base rule."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 1).alias("_good"))
    parts = [c for c in measured.columns if c in [*BASE, "n_lines", "n_echoes", "n_capitals"]]
    rows = measured.where("not base_failed").select(F.col(key).alias("_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), "text_hash", *parts)
    texts = rows.join(marks, "_id").groupBy("_stratum", "text_hash").agg(F.min("_good").alias("good"), *[F.min(c).alias(c) for c in parts])
    return texts.withColumn("fold", F.pmod(F.xxhash64("text_hash", F.lit("fold")), F.lit(2)))


def thresholds(measured: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(_stratum, _unit_ column of each measure, _cut: the least excess that is rejected, null where none is safe), one row per
    stratum with labelled rows."""
    rows = materialize(labelled(measured, labels, key, stratum), "labelled")
    sizes = materialize(rows.groupBy("_stratum").agg(F.sum((F.col("good") & (F.col("fold") == 1)).cast("long")).alias("n")), "strata")
    needed = math.log(delta / max(1, sizes.count())) / math.log1p(-alpha)
    pools = sizes.select("_stratum", F.when(F.col("n") >= needed, F.col("_stratum")).otherwise(POOL).alias("_pool"))
    unit = [F.greatest(F.percentile_approx(F.expr(e).cast("double"), SPREAD, 10_000), F.lit(FLOOR)).alias(f"_unit_{r}") for r, e in MEASURES.items()]
    units = materialize(rows.where("fold = 0 and good").groupBy("_stratum").agg(*unit), "units")
    scored = rows.join(units, "_stratum").join(pools, "_stratum").withColumn("excess", _excess({r: F.col(f"_unit_{r}") for r in MEASURES}))
    grid = scored.where("fold = 0 and not good").groupBy("_pool").agg(F.percentile_approx("excess", STEPS, 10_000).alias("cuts"))
    holdout = scored.where("fold = 1 and good").join(materialize(grid, "cutoffs"), "_pool")
    rejected = F.array(*[F.sum((F.col("excess") >= F.col("cuts")[i]).cast("long")) for i in range(len(STEPS))])
    counts = materialize(holdout.groupBy("_pool", "cuts").agg(F.count("*").alias("n"), rejected.alias("k")), "counts")
    level = math.log(delta / max(1, counts.count()))
    n, k = F.col("n"), F.col("k")
    passes = lambda i: F.when(F.get(k, i) < n * alpha, _at_most(F.get(k, i), n, alpha) <= level).otherwise(F.lit(False))
    stricter = F.sequence(F.lit(len(STEPS) - 1), F.lit(0), F.lit(-1))
    start = F.struct(F.lit(True).alias("on"), F.lit(None).cast("double").alias("cut"))

    def step(acc: Column, i: Column) -> Column:
        on = acc["on"] & passes(i)
        return F.struct(on.alias("on"), F.when(on, F.get("cuts", i)).otherwise(acc["cut"]).alias("cut"))

    chosen = counts.select("_pool", F.aggregate(stricter, start, step, lambda acc: acc["cut"]).alias("_cut"))
    return materialize(units.join(pools, "_stratum").join(chosen, "_pool", "left").drop("_pool"), "thresholds")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with `kept`: neither the base rule nor the cutoff of the row's stratum rejects it."""
    kept = [c for c in measured.columns if c != "kept"]
    rejected = F.coalesce(_excess({r: F.col(f"_unit_{r}") for r in MEASURES}) >= F.col("_cut"), F.lit(False))
    placed = measured.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    return placed.join(cutoffs, "_stratum", "left").select(*kept, (~F.col("base_failed") & ~rejected).alias("kept"))


def assess(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(key, base measures, base_failed, kept) of every row."""
    measured = materialize(measure(df.select(F.col(key), F.col(text), F.col(stratum)), text).drop(text), "measures")
    judged = judge(measured, thresholds(measured, labels, key, stratum), stratum)
    return judged.select(key, *BASE, "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of df that are kept, with df's own columns. Rows are written once with their measures, so no text is
    measured twice."""
    own = {c: f"_own_{i}" for i, c in enumerate(df.columns)}
    measured = materialize(measure(df.select(*[F.col(c).alias(o) for c, o in own.items()]), own[text]), "measures")
    cutoffs = thresholds(measured, labels, own[key], own[stratum])
    return judge(measured, cutoffs, own[stratum]).where("kept").select(*[F.col(o).alias(c) for c, o in own.items()])
