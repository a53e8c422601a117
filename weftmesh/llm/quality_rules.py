"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies.

Each rule reads document statistics and votes good (1), bad (0) or abstains
(null).  The votes of all documents are counted by vote pattern (at most
3 ** number-of-rules rows), expectation-maximisation over these counts
estimates, for each rule, how often it votes each way on good and on bad
documents, and a document is kept if its posterior probability of being good
reaches a threshold.  No document has to pass every rule.

Everything that touches documents is DataFrame functions; the estimation sees
only the counted patterns.

Edge cases: null and empty texts have no words and fail the base rules; repeated
rows are judged alike and each kept in the result; an empty table gives an empty
result; extra columns are carried by :func:`judge` unless they clash with the
statistics, in which case the document's own column is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import unused

#: Whitespace of all word definitions here: space and \t to \r.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

#: A document with fewer words, or with a larger share of words in repeated windows, fails the base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_pipes"]


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the STATS columns, each computed from the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [c for c in docs.columns if c not in STATS]
    words, lines, grams, any_, pairs_, at = unused(docs.columns, "_words", "_lines", "_grams", "_any", "_pairs", "_at")
    first = docs.select(
        *own,
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias(words),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias(lines),
    )
    n = F.size(words)
    window = lambda i: F.xxhash64(*[F.element_at(words, i + F.lit(k)) for k in range(1, 6)])
    second = first.select(
        *own,
        n.cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.regexp_count(text, F.lit(r"[\p{Lu}]")).cast("bigint").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[\p{L}]")).cast("bigint").alias("n_letters"),
        F.regexp_count(text, F.lit(r"[|]")).cast("bigint").alias("n_pipes"),
        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(F.array().cast("array<bigint>")).alias(grams),
    )
    third = second.withColumn(any_, F.size(F.array_distinct(grams)) < F.size(grams))
    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    fourth = third.withColumn(pairs_, F.when(F.col(any_), pairs))
    held = lambda k: F.get(pairs_, k)["h"]  # noqa: E731  null beyond either end
    twice = F.filter(pairs_, lambda e, k: (e["h"] == F.coalesce(held(k + 1), e["h"] + 1)) | (F.when(k > 0, held(k - 1)).otherwise(e["h"] + 1) == e["h"]))
    fifth = fourth.withColumn(at, F.when(F.col(any_), F.sort_array(F.transform(twice, lambda e: e["i"]))))
    gaps = F.aggregate(
        F.col(at),
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return fifth.withColumn("n_repeat_words", F.when(F.col(any_), gaps).otherwise(F.lit(0)).cast("bigint")).drop(grams, any_, pairs_, at)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def default_rules() -> dict[str, Column]:
    """Rule name -> vote column (1 good, 0 bad, null abstains)."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    mean = F.col("word_chars") / n
    symbols, upper = F.col("n_symbols") / n, F.col("n_upper") / F.greatest("n_letters", F.lit(1))
    dup, repeat = F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / n
    letters, distinct = F.col("n_letters") / chars, F.col("n_distinct") / n
    short = F.col("n_words") < 40
    return {
        "length": _vote(F.col("n_words").between(30, 100_000), F.col("n_words") < MIN_WORDS),
        "word_length": _vote(mean.between(2.5, 9), (mean < 2) | (mean > 14)),
        "symbols": _vote(symbols <= 0.02, symbols > 0.1),
        "capitals": _vote(upper <= 0.15, upper > 0.5),
        "dup_lines": _vote(dup <= 0.1, dup > 0.3),
        "repeats": _vote(repeat <= 0.05, repeat > 0.2),
        "letters": _vote(letters >= 0.85, letters < 0.7),
        "variety": F.when(short, F.lit(None)).otherwise(_vote((distinct >= 0.2) | (F.col("n_words") > 500), distinct < 0.08)),
    }


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], n_rules: int, rounds: int = 60, prior: float = 0.8, smoothing: float = 1.0, anchor: float = 8.0) -> tuple[float, list[dict]]:
    """EM over counted vote patterns: (class prior, per rule P(vote | class)).

    The start assumes each rule to be right nine times in ten when it votes;
    ``anchor`` pseudo-votes hold that start where a rule hardly ever votes.
    """
    likely = [{c: {1: 0.6 if c else 0.07, 0: 0.07 if c else 0.6, None: 0.33} for c in (0, 1)} for _ in range(n_rules)]
    start = [{c: dict(x[c]) for c in x} for x in likely]
    total = sum(k for _, k in patterns)
    for _ in range(rounds if total else 0):
        counts = [{c: {v: anchor * start[j][c][v] for v in (0, 1, None)} for c in (0, 1)} for j in range(n_rules)]
        good = smoothing * prior
        for votes, k in patterns:
            p = posterior(votes, prior, likely)
            good += k * p
            for j, v in enumerate(votes):
                counts[j][1][v] += k * p
                counts[j][0][v] += k * (1 - p)
        prior = min(0.99, max(0.01, good / (total + smoothing)))
        likely = [{c: {v: counts[j][c][v] / sum(counts[j][c].values()) for v in (0, 1, None)} for c in (0, 1)} for j in range(n_rules)]
    return prior, likely


def posterior(votes: tuple[int | None, ...], prior: float, likely: list[dict]) -> float:
    """P(good | votes); abstentions carry no evidence."""
    z = math.log(prior / (1 - prior)) + sum(math.log(likely[j][1][v] / likely[j][0][v]) for j, v in enumerate(votes) if v is not None)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def judge(stats: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, quality_probability and kept to a table with STATS.

    ``stats`` is read twice (counting, then judging): pass a materialized table.
    """
    rules = rules or default_rules()
    names = list(rules)
    pattern = F.concat_ws(",", *[F.coalesce(v.cast("string"), F.lit("-")) for v in rules.values()])
    counted = {r[0]: r[1] for r in stats.groupBy(pattern.alias("votes")).count().collect()}  # at most 3 ** len(rules) rows
    seen = [(tuple(None if x == "-" else int(x) for x in key.split(",")), k) for key, k in sorted(counted.items())]
    prior, likely = estimate(seen, len(names))
    z = F.lit(math.log(prior / (1 - prior)))
    for j, vote in enumerate(rules.values()):
        weight = {v: math.log(likely[j][1][v] / likely[j][0][v]) for v in (0, 1)}
        z = z + F.when(vote == 1, F.lit(weight[1])).when(vote == 0, F.lit(weight[0])).otherwise(F.lit(0.0))
    return (
        stats
        .withColumn("quality_probability", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z)))))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole ``documents`` table."""
    from ..plans.storage import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats = materialize(with_stats(docs).drop("text"), "quality-stats")
    return judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability")
