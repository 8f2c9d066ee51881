"""Quality by weak supervision: rules vote or abstain, EM weighs the rules, the posterior decides.

Everything is DataFrame functions. Rules vote 1 (good), 0 (bad) or null (abstain). Given the unknown
class, votes count as independent: rule j says "good" of a good text with probability ``good[j]`` and
"bad" of a bad one with ``bad[j]``. The corpus enters the fit only as counts of vote patterns, at most
3 to the number of rules, summed before the shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, stage, text_or_empty

WINDOW = 8
NOT_SYMBOLS = "[^#*$%&|<>]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measures that only the rules use.
MORE_MEASURES = ("n_lines", "n_upper", "n_stops", "n_other", "n_distinct")


def _repeated(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice: sort hashes with places, keep equal neighbours,
    sort the places again and add up what each next window newly covers."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    n = F.size(windows)
    as_next = F.zip_with(placed, F.slice(placed, 2, n), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    either = F.zip_with(as_next, F.concat(F.array(F.lit(False)), as_next), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    places = F.array_sort(F.array_compact(F.zip_with(placed, either, lambda x, e: F.when(e, x["p"]))))
    new = F.zip_with(places, F.slice(places, 2, n), lambda a, b: F.least(F.lit(WINDOW), b - a))
    return F.aggregate(new, F.lit(0), lambda total, x: total + x)


def with_measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``row`` (the input's columns, whatever their names) and the measures of each whole text, all bigint.

    Words are runs of anything but ASCII white space. ``n_dup_lines``: lines with a word, equal to an
    earlier line. ``n_repeat_words``: words in 8-word windows found twice or more in the text, compared
    by a 64-bit hash of each window. A null text has no words. Hot texts matter to no shuffle: there is none.
    """
    columns = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    given = docs.select(columns, text_or_empty(text_column).alias("text"))
    split = given.select(
        "row", "text", F.array_remove(F.split("text", GAP), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_replace("text", r"[\p{L}\p{N}\x20\x09-\x0D]+", "").alias("other"),
    )
    chars = lambda column: F.char_length(column).cast("bigint")
    many = lambda column: F.size(column).cast("bigint")
    measured = split.select(
        "row", many("words").alias("n_words"),
        chars(F.array_join("words", "")).alias("word_chars"),
        chars(F.regexp_replace("other", NOT_SYMBOLS, "")).alias("n_symbols"),
        (many("lines") - many(F.array_distinct("lines"))).alias("n_dup_lines"),
        many("lines").alias("n_lines"),
        chars(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        chars(F.regexp_replace("other", "[^.!?]+", "")).alias("n_stops"),
        chars("other").alias("n_other"),
        many(F.array_distinct("words")).alias("n_distinct"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # hashes of 2, 4 and then 8 words; the last seven, which miss words, are cut off
    span = 1
    while span < WINDOW:
        shifted = F.slice("h", span + 1, F.size("h") + 1)
        measured = measured.withColumn("h", F.zip_with("h", shifted, lambda a, b: F.xxhash64(a, b)))
        span *= 2
    windows = measured.withColumn("h", F.slice("h", 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))))
    repeats = F.when(F.size(F.array_distinct("h")) < F.size("h"), _repeated(F.col("h"))).otherwise(0)
    return windows.select("row", *MEASURES[:-1], repeats.cast("bigint").alias("n_repeat_words"), *MORE_MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _between(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


def votes() -> dict[str, Column]:
    """The rules over the measures: 1 good, 0 bad, null abstains. All abstain for a text without words."""
    n, c = F.col("n_words"), F.col("word_chars")
    per_word = lambda name: F.col(name) / F.greatest(n, F.lit(1))
    length, symbols, stops, repeats = c / F.greatest(n, F.lit(1)), per_word("n_symbols"), per_word("n_stops"), per_word("n_repeat_words")
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    upper, distinct = F.col("n_upper") / F.greatest(c, F.lit(1)), per_word("n_distinct")
    other = F.col("n_other") / F.greatest(c, F.lit(1))
    rules = {
        "long_enough": _between(n, n >= 50, n < 20),
        "word_length": _between(length, length.between(3, 10), (length < 2.2) | (length > 14)),
        "few_symbols": _between(symbols, symbols <= 0.03, symbols > 0.12),
        "mostly_letters": _between(other, other <= 0.07, other > 0.11),
        "few_equal_lines": _between(lines, lines <= 0.05, lines > 0.4),
        "few_repeats": _between(repeats, repeats <= 0.05, repeats > 0.3),
        "lower_case": _between(upper, upper <= 0.1, upper > 0.25),
        "sentence_stops": _between(stops, stops.between(0.01, 0.25), stops > 0.4),
        "varied_words": F.when((n < 30) | (n > 3000), None).when(distinct < 0.2, 0).when(distinct > 0.3, 1),
    }
    return {name: F.when(n > 0, vote) for name, vote in rules.items()}


@dataclass(frozen=True)
class Model:
    """What EM has found: the share of good texts, and each rule's accuracy on good and on bad texts."""

    prior: float
    good: dict[str, float]
    bad: dict[str, float]

    def posterior(self, columns: dict[str, Column]) -> Column:
        """Probability that a text is good, from its votes; the prior where all rules abstain."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, vote in columns.items():
            g, b = self.good[name], self.bad[name]
            odds = odds + F.when(vote == 1, math.log(g / (1 - b))).when(vote == 0, math.log((1 - g) / b)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


#: Where EM starts and what it is held to: a mostly good corpus, and rules whose "bad" is seldom wrong but
#: often missing, since each looks for one kind of fault. The weight of this belief, as a share of the rows.
PRIOR, GOOD, BAD, BELIEF = 0.9, 0.98, 0.4, 0.05


def fit(votes_table: DataFrame, names: list[str], rounds: int = 20, tolerance: float = 1e-3) -> Model:
    """Expectation-maximisation over the vote patterns of all rows.

    Each round is one sum over the patterns. Parameters are rounded to nine places, so that the order of
    summing doesn't show. An empty table gives the start.
    """
    patterns = stage(votes_table.groupBy(*names).count(), "vote-patterns").coalesce(1)
    model = Model(PRIOR, dict.fromkeys(names, GOOD), dict.fromkeys(names, BAD))
    for _ in range(rounds):
        p = model.posterior({n: F.col(n) for n in names})
        weighed = patterns.select(*names, (p * F.col("count")).alias("g"), ((1 - p) * F.col("count")).alias("b"))
        sums = [F.sum("g").alias("g"), F.sum("b").alias("b")]
        for n in names:
            for side, right in (("g", 1), ("b", 0)):
                sums.append(F.sum(F.when(F.col(n).isNotNull(), F.col(side))).alias(f"{side}_{n}"))
                sums.append(F.sum(F.when(F.col(n) == right, F.col(side))).alias(f"{side}_{n}_right"))
        s = {k: v or 0.0 for k, v in weighed.agg(*sums).first().asDict().items()}
        weight = BELIEF * (s["g"] + s["b"]) + 1
        rate = lambda right, all_, start: round((right + start * weight) / (all_ + weight), 9)  # noqa: B023,E731
        new = Model(
            rate(s["g"], s["g"] + s["b"], PRIOR),
            {n: rate(s[f"g_{n}_right"], s[f"g_{n}"], GOOD) for n in names},
            {n: rate(s[f"b_{n}_right"], s[f"b_{n}"], BAD) for n in names},
        )
        moved = max(abs(new.prior - model.prior), *(abs(getattr(new, k)[n] - getattr(model, k)[n]) for k in ("good", "bad") for n in names))
        model = new
        if moved < tolerance:
            break
    return model


def judge(measured: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds ``quality`` (posterior probability), ``base_failed`` and ``kept`` to measured rows.

    The input is read twice, for the fit and for the verdicts, so it should be a staged table. Texts that
    fail the base rule are never kept; they take part in the fit, as examples of bad texts.
    """
    rules = votes()
    model = fit(measured.select(*(v.cast("int").alias(n) for n, v in rules.items())), list(rules))
    quality = model.posterior(rules)
    return measured.select("*", quality.alias("quality"), base_failed().alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= least)
    )


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows whose text is judged good, with the columns they came with. Null texts go."""
    return judge(stage(with_measures(docs, text_column), "quality")).where("kept").select("row.*")
