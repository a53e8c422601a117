"""URL filters: listed rules first, mined association rules for the rest.

A listed rule names a host and a path start; it fits its host and all
subdomains, and the longest that fits decides.  The verdicts of listed rules
label URLs, Spark's FP-growth mines which combinations of URL tokens imply
``block`` or ``allow``, and rules pruned by support, confidence and redundancy
judge the URLs that no listed rule fits.  An inverted index from token to rules
counts, for each URL, how many of a rule's tokens it has; a rule matches when
all are there.  The most confident match decides; without a match a URL is
allowed.

Mining reads at most SAMPLE_ROWS labelled URLs (those with the least hash);
judging covers every row and needs no shuffle.

Edge cases: a null URL, or one without ``://``, has empty host and path, fits no
listed rule and is allowed; repeated rows are each judged; without labelled URLs
no rule is mined; an empty table gives an empty result; extra columns are
ignored by the query and carried by :func:`judge`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import extended, materialize
from .words import unused

#: Fixed values: (host, path start, verdict).
LISTED = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

SAMPLE_ROWS = 50_000
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = _rest(F.coalesce(url, F.lit("")))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tried first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: end of the host, domain, first label, path parts, suffix, query keys, scheme."""
    url = F.coalesce(url, F.lit(""))
    labels = F.split(host, r"\.")
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("part="), F.regexp_replace(F.translate(s, UPPER, LOWER), r"[0-9]+", "0")))
    query = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda s: s != "")
    keys = F.transform(query, lambda s: F.concat(F.lit("key="), F.substring_index(s, "=", 1)))
    single = F.array(
        F.concat(F.lit("end="), F.element_at(labels, -1)),
        F.concat(F.lit("domain="), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")),
        F.concat(F.lit("first="), F.element_at(labels, 1)),
        F.concat(F.lit("scheme="), F.substring_index(url, "://", 1)),
        F.concat(F.lit("suffix="), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)),
        F.concat(F.lit("depth="), F.least(F.size(parts), F.lit(9)).cast("string")),
    )
    return F.when(host != "", F.array_distinct(F.concat(single, parts, keys))).otherwise(F.array().cast("array<string>"))


@dataclass
class Rules:
    """Mined rules, best first, and the index from token to rule numbers."""

    rules: list[tuple[frozenset, str, float, float]]
    index: dict[str, list[int]]

    @classmethod
    def of(cls, found: list[tuple[frozenset, str, float, float]]) -> Rules:
        """Sort, and prune rules that a more general one makes needless."""
        kept: list[tuple[frozenset, str, float, float]] = []
        index: dict[str, list[int]] = {}
        for rule in sorted(found, key=lambda r: (-r[2], -r[3], len(r[0]), sorted(r[0]), r[1])):
            inside: dict[int, int] = {}
            for n in (n for t in rule[0] for n in index.get(t, ())):
                inside[n] = inside.get(n, 0) + 1
            if any(k == len(kept[n][0]) and kept[n][1] == rule[1] for n, k in inside.items()):
                continue
            for t in rule[0]:
                index.setdefault(t, []).append(len(kept))
            kept.append(rule)
        return cls(kept, index)

    def match(self, have: list[str]) -> int | None:
        """The number of the best rule all of whose tokens are there."""
        seen: dict[int, int] = {}
        for t in have:
            for n in self.index.get(t, ()):
                seen[n] = seen.get(n, 0) + 1
        return min((n for n, k in seen.items() if k == len(self.rules[n][0])), default=None)


def mine(parsed: DataFrame, rows: int = SAMPLE_ROWS, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> Rules:
    """(url, tokens, listed verdict) -> rules that imply a verdict."""
    sample = parsed.where("_verdict is not null").orderBy(F.xxhash64("url"), "url").limit(rows)
    baskets = materialize(sample.select(F.array_append("_tokens", F.concat(F.lit("verdict="), F.col("_verdict"))).alias("items")), "url-baskets")
    if baskets.isEmpty():
        return Rules.of([])
    mined = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    implied = mined.where(F.col("consequent")[0].startswith("verdict=") & ~F.exists("antecedent", lambda t: t.startswith("verdict=")))
    return Rules.of([(frozenset(r.antecedent), r.consequent[0].removeprefix("verdict="), r.confidence, r.support) for r in implied.collect()])


def _judged(shared, token_column: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, known = shared.value, {}
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            best = []
            for have in batch.column(token_column).to_pylist():
                key = tuple(have)
                if key not in known:
                    known[key] = rules.match(have)
                best.append(known[key])
            verdict = pa.array(["allow" if n is None else rules.rules[n][1] for n in best], pa.string())
            confidence = pa.array([None if n is None else rules.rules[n][2] for n in best], pa.float64())
            why = pa.array([None if n is None else " ".join(sorted(rules.rules[n][0])) for n in best], pa.string())
            keep = [k for k, name in enumerate(batch.schema.names) if name != token_column]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], verdict, confidence, why], [*[batch.schema.names[k] for k in keep], *names])

    return run


def judge(pages: DataFrame, rules_listed=LISTED) -> DataFrame:
    """Adds host, path, rule, verdict, confidence and mined_rule to all columns of ``pages`` (replacing such columns)."""
    pages = pages.drop("host", "path", "rule", "verdict", "confidence", "mined_rule")
    said, have, mined = unused(pages.columns, "_listed", "_tokens", "_mined")
    host, path = host_and_path(F.col("url"))
    parsed = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = listed(F.col("host"), F.col("path"), rules_listed)
    parsed = parsed.withColumn("rule", rule).withColumn(said, verdict).withColumn(have, tokens(F.col("url"), F.col("host"), F.col("path")))
    shared = pages.sparkSession.sparkContext.broadcast(mine(parsed.select("url", F.col(said).alias("_verdict"), F.col(have).alias("_tokens"))))
    schema = extended(parsed.drop(have).schema, f"{mined} string, confidence double, mined_rule string")
    out = parsed.mapInArrow(_judged(shared, have, [mined, "confidence", "mined_rule"]), schema)
    by_list = F.col("rule").isNotNull()
    out = out.withColumn("verdict", F.coalesce(said, mined)).withColumn("confidence", F.when(~by_list, F.col("confidence"))).withColumn("mined_rule", F.when(~by_list, F.col("mined_rule")))
    return out.select(*pages.columns, "host", "path", "rule", "verdict", "confidence", "mined_rule")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole ``pages`` table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "confidence", "mined_rule")
