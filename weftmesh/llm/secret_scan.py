"""Secret scans: pattern spans, and credentials told from examples by corpus-wide ownership.

Base spans (kinds assign, access, hex) are reported wherever they match.
Candidates are maximal runs of 24 or more of ``[A-Za-z0-9_-]`` that hold upper-
and lower-case letters and digits and lie in no base span.  Their hashes are
aggregated over the whole corpus by distinct repository and owner: a value seen
with many owners or repositories is a widely copied example; a value that
belongs to few owners looks live and is added as kind ``owned``.  Base spans
carry the same verdict in ``live_hashes``.

All of it is DataFrame functions; texts are scanned once and never shuffled.

Edge cases: null text counts as empty and has no spans; repeated rows each get
their spans (an owner counts once for a value); a null repository or owner is
one repository or owner of its own; an empty table gives an empty result; extra
columns are ignored by the query and carried by :func:`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialize, sized_join

# The base patterns and their least lengths.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: Stands for characters of base spans while candidates are looked for; in a text of its own it counts as a line break.
BLANK = "\ue000"
CANDIDATE = rf"[A-Za-z0-9_{BLANK}-]{{24,}}"
MIN_VALUE, MIN_ACCESS = 8, 16
KINDS = ["assign", "access", "hex", "owned"]

#: A value with more distinct repositories or owners is a copied example.
MAX_REPOSITORIES, MAX_OWNERS = 2, 2

#: Numbers that a running total appends to one array; characters of a text that are cut at once.
BLOCK, CHUNK = 256, 1 << 14

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, join) -> Column:
    """For each of the numbers ``join`` of 0 and all numbers before it, e.g. running sums.

    Arrays grow by copies, so they grow within blocks of BLOCK and over the
    blocks; the cost of n numbers is n * BLOCK and the square of n / BLOCK.
    """
    grown = lambda of: lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), of(x))))
    zero = F.array(F.lit(0))

    def walk(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        inside = F.transform(blocks, lambda block: F.aggregate(block, zero, grown(lambda x: x)))
        tops = lambda i: F.slice(F.aggregate(i, zero, grown(lambda x: F.element_at(x, -1))), F.lit(1), F.size(i))
        onto = lambda block, at: F.transform(F.slice(block, F.lit(1), F.size(block) - 1), lambda x: join(at, x))
        return _let(inside, lambda i: F.flatten(F.zip_with(i, tops(i), onto)))

    return _let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(walk(v)))


def _spans(text: Column, pattern: str, kind: int, keep, value=None) -> Column:
    """Spans of all leftmost non-overlapping matches of ``pattern`` for which ``keep(match)`` holds.

    A match starts after the pieces between matches and the matches before it.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = _let(matches, lambda m: F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x, p: F.struct(x.alias("m"), p.alias("p"))))

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda x: F.length(x["p"]) + F.length(x["m"]))
        span = lambda at, x: F.struct((at + F.length(x["p"])).alias("start"), F.lit(kind).alias("kind"), (at + F.length(x["p"]) + F.length(x["m"])).alias("end"), x["m"].alias("value"))
        return F.zip_with(_before(lengths, lambda a, b: a + b), parts, span)

    out = F.when(text.rlike(pattern), F.filter(_let(parts, placed), lambda s: keep(s["value"])))
    if value:
        out = F.transform(out, lambda s: F.struct(s["start"], s["kind"], s["end"], value(s["value"]).alias("value")))
    return F.coalesce(out.cast(SPAN), F.array().cast(SPAN))


def _blanked(blanked: Column, pattern: str, keep) -> Column:
    """The text with each kept match replaced by as many BLANK characters."""
    return _let(blanked, lambda text: _without(text, pattern, keep))


def _without(text: Column, pattern: str, keep) -> Column:
    blank = lambda p, m: F.concat(p, F.when(m.isNull(), F.lit("")).when(keep(m), F.repeat(F.lit(BLANK), F.length(m))).otherwise(m))
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(pieces, matches, blank), "")).otherwise(text)


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add base (spans of the base kinds) and candidates (spans the corpus must judge).

    A candidate must not touch a base span.  It is a maximal run, so base matches
    are blanked out first and runs that hold a blank are left.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    group = lambda m: F.regexp_extract(m, ASSIGN, 2)
    kept = [(ASSIGN, lambda m: F.length(group(m)) >= MIN_VALUE), (ACCESS, lambda m: F.length(m) >= MIN_ACCESS), (HEX, lambda m: F.length(m) >= 32)]
    base = [_spans(text, pattern, kind, keep, group if kind == 0 else None) for kind, (pattern, keep) in enumerate(kept)]
    mixed = lambda m: ~m.contains(BLANK) & m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    found = docs.withColumn("base", F.array_sort(F.concat(*base)))

    def free(blanked: Column) -> Column:
        return _spans(blanked, CANDIDATE, 3, mixed)

    some = text.rlike(CANDIDATE.replace(BLANK, ""))
    blanked = F.translate(text, BLANK, "\n")
    for pattern, keep in kept:
        blanked = _blanked(blanked, pattern, keep)
    return found.withColumn("candidates", F.when(some, _let(blanked, free)).otherwise(F.array().cast(SPAN)))


def ownership(values: DataFrame) -> DataFrame:
    """(value, repository, owner) -> value, repositories, owners, live.

    Repeats are reduced before the shuffle, so a value copied into a third of
    all documents costs a row per task.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    hashed = values.select(F.xxhash64("value").alias("value_hash"), named("repository").alias("r"), named("owner").alias("o"))
    repositories = hashed.groupBy("value_hash", "r").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias("repositories"))
    owners = hashed.groupBy("value_hash", "o").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias("owners"))
    both = repositories.join(owners, "value_hash")
    return both.withColumn("live", (F.col("repositories") <= MAX_REPOSITORIES) & (F.col("owners") <= MAX_OWNERS))


def scan(found: DataFrame) -> DataFrame:
    """(key columns, repository, owner, base, candidates) -> adds spans, live_hashes.

    ``found`` (materialized, without texts) is read more than once.  Rows with
    no candidate and no base span pass through without a join.
    """
    rest = [c for c in found.columns if c not in ("base", "candidates")]
    some = F.size(F.concat("base", "candidates")) > 0
    owned = found.where(some).withColumn("_all", F.concat("base", "candidates"))
    values = owned.select("repository", "owner", F.explode(F.array_distinct(F.transform("_all", lambda s: s["value"]))).alias("value"))
    verdicts = materialize(ownership(values), "secret-values")
    # One row for each span, judged by its value, then gathered again by document row.
    keyed = owned.withColumn("_row", F.monotonically_increasing_id())
    keyed = materialize(keyed, "secret-rows")
    spans = keyed.select("_row", F.explode("_all").alias("s")).withColumn("value_hash", F.xxhash64("s.value"))
    judged = sized_join(spans, verdicts.select("value_hash", "live"), "value_hash", "inner", 24)
    live = judged.where("live").groupBy("_row").agg(F.sort_array(F.collect_set("value_hash")).alias("live_hashes"))
    done = keyed.join(live, "_row", "left").withColumn("live_hashes", F.coalesce("live_hashes", F.array().cast("array<bigint>")))
    added = F.filter("candidates", lambda c: F.array_contains("live_hashes", F.xxhash64(c["value"])))
    done = done.withColumn("spans", F.array_sort(F.concat("base", added))).select(*rest, "base", "spans", "live_hashes")
    none = found.where(~some).select(*rest, "base", F.array().cast(SPAN).alias("spans"), F.array().cast("array<bigint>").alias("live_hashes"))
    return done.unionByName(none)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(text: Column, spans: Column, mask: str) -> Column:
    """The text with spans replaced by the mask, overlapping ones by one.

    A long text is cut from chunks, so a cut doesn't walk it from the start.
    """

    def between(chunks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        within = F.substring(chunk(first), start % CHUNK + 1, end - start)
        across = F.concat(F.substring(chunk(first), start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(chunk(last), F.lit(1), end % CHUNK))
        return F.when(start >= end, F.lit("")).when(first == last, within).otherwise(across)

    def joined(chunks: Column, s: Column) -> Column:
        upto = _before(F.transform(s, lambda x: x["end"]), F.greatest)
        gap = lambda at, x: F.when(x["start"] >= at, F.concat(between(chunks, at, x["start"]), F.lit(mask))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.zip_with(upto, s, gap), ""), between(chunks, F.array_max(F.transform(s, lambda x: x["end"])), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return _let(chunks, lambda c: _let(F.array_sort(spans), lambda s: joined(c, s)))


def redact(docs: DataFrame, mask: str = "[SECRET]", repository: str = "source", owner: str = "source") -> DataFrame:
    """The documents with each secret span of ``text`` replaced by ``mask``; n_chars follows.

    Overlapping spans are masked once.  Rows are found again by (doc_id, text
    hash); equal texts have equal spans.  Columns are those of ``docs``.
    """
    own = docs.columns
    found = find_spans(docs.select("doc_id", F.col(repository).alias("repository"), F.col(owner).alias("owner"), F.xxhash64("text").alias("_hash"), "text")).drop("text")
    scanned = scan(materialize(found, "secret-spans")).where(F.size("spans") > 0)
    marks = scanned.groupBy("doc_id", "_hash").agg(F.first("spans").alias("spans")).select(F.struct("doc_id", "_hash", "spans").alias("_secrets_"))
    marks = materialize(marks, "secret-marks")
    same = F.col("_docs_.doc_id").eqNullSafe(F.col("_secrets_.doc_id")) & (F.xxhash64("_docs_.text") == F.col("_secrets_._hash"))
    joined = sized_join(docs.alias("_docs_"), marks, same, "left", 200)
    hit = F.col("_secrets_").isNotNull()
    text = F.when(hit, _cut(F.col("_docs_.text"), F.col("_secrets_.spans"), mask)).otherwise(F.col("_docs_.text"))
    columns = {c: F.col(f"_docs_.`{c}`") for c in own}
    if "n_chars" in own:
        columns["n_chars"] = F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    columns["text"] = text
    return joined.select(*[columns[c].alias(c) for c in own])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole ``documents`` table.

    ``documents`` names no repositories: a source and language stand for the
    repository, the source for its owner.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    cut = docs.select("doc_id", F.concat_ws("/", named("source"), named("lang")).alias("repository"), F.col("source").alias("owner"), "text")
    scanned = scan(materialize(find_spans(cut).drop("text"), "secret-spans"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), F.size("live_hashes").cast("bigint").alias("n_live"))
