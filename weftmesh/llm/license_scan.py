"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Every line, every paragraph and the whole of every text is compared with each
template: vectors of term counts times inverse document frequency, counted over
all documents for every word.  The counts are a table; the driver holds those of
template words and of the COMMON most frequent ones.  Any other word weighs at
least what the rarest of these does, which bounds a segment's cosine; only for
segments that pass this bound are their other words looked up in the table.  A
document's own licence is that of its best segment; a document most of whose
words lie in such segments is a licence file, and speaks for its directory.

A document without a licence of its own inherits that of the nearest ancestor
directory with a licence file: directories (few) are joined with their
ancestors, the documents then with their directory.

Edge cases: null and empty texts have no licence of their own and may inherit;
a null path part counts as an empty name; repeated rows are each reported; of
several licence files in one directory the most similar one counts, then the
least path; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import extended, materialize, sized_join

#: Notices by licence, in the words of the licences' own instructions.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
]

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Whole licence texts, for licence files; those of long licences can be added by the caller.
BODIES = [
    ("MIT", f"MIT License Copyright (c) {TEMPLATES[1][1]}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"),
    ("MIT", _WARRANTY),
    ("BSD-3-Clause", f"Copyright (c) All rights reserved. {TEMPLATES[6][1]}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]

SIMILARITY = 0.7
#: A document is a licence file if so much of its words lie in matching segments.
FILE_SHARE = 0.5

#: Words, the most frequent first, whose counts the driver and every task hold.
COMMON = 20_000
#: Distinct words that a counting task holds at most before it hands them on.
COUNT_WORDS = 100_000

_EDGES = b".,;:!?\"'()[]{}*#/<>"


def _terms(line: bytes) -> list[bytes]:
    return [t for t in (w.strip(_EDGES) for w in line.lower().split()) if t]


@dataclass
class Matcher:
    """Templates as weighted vectors; idf by template term and common word, of any other word at least ``least``.

    ``rare`` is the weight of a word in no document.
    """

    idf: dict[bytes, float]
    rare: float
    documents: int = 0
    at_most: int = 0
    least: float = 0.0
    words: set[bytes] = field(default_factory=set)
    needed: set[bytes] = field(default_factory=set)
    names: list[str] = field(default_factory=list)
    vectors: list[dict[bytes, float]] = field(default_factory=list)

    @classmethod
    def of(cls, templates: list[tuple[str, str]], found: dict[bytes, int], documents: int, at_most: int = 0) -> Matcher:
        """found: documents by word, of all template words that occur and any others; no other word is in more than ``at_most``."""
        vocabulary = sorted({t for _, text in templates for t in _terms(text.encode())})
        weight = lambda df: float(np.log((1 + documents) / (1 + df)) + 1)
        idf = {t: weight(found.get(t, 0)) for t in {*vocabulary, *found}}
        out = cls(idf, weight(0), documents, at_most, weight(at_most), set(vocabulary))
        for name, text in templates:
            vector = {t: n * out.idf[t] for t, n in Counter(_terms(text.encode())).items()}
            norm = sum(v * v for v in vector.values()) ** 0.5
            out.names.append(name)
            out.vectors.append({t: v / norm for t, v in vector.items()})
        return out

    def weight(self, t: bytes, others: dict[bytes, int]) -> float:
        known = self.idf.get(t)
        return known if known is not None else float(np.log((1 + self.documents) / (1 + others[t])) + 1) if t in others else self.rare

    def best(self, terms: list[bytes], others: dict[bytes, int] | None = None) -> tuple[float, int]:
        """(cosine, template) of the most similar template; (0, -1) without terms."""
        vector = {t: n * self.weight(t, others or {}) for t, n in Counter(terms).items()}
        norm = sum(v * v for v in vector.values()) ** 0.5
        scores = [sum(v * template.get(t, 0.0) for t, v in vector.items()) / norm if norm else 0.0 for template in self.vectors]
        return max(((round(s, 12), -k) for k, s in enumerate(scores)), default=(0.0, 1)) if norm else (0.0, 1)

    def segments(self, text: bytes, hint: re.Pattern) -> list[tuple[int, int, list[bytes]]]:
        """(first line, end, terms) of lines, paragraphs and the whole text that may reach SIMILARITY."""
        if not hint.search(text):
            return []
        lines, out = [_terms(x) for x in text.split(b"\n")], []
        needed = self.needed = self.needed or needed_words(self)
        holds = [not needed.isdisjoint(t) for t in lines]
        spans = [(k, k + 1) for k, t in enumerate(lines) if t]
        gaps = [-1, *(k for k, t in enumerate(lines) if not t), len(lines)]
        spans += [(a + 1, b) for a, b in zip(gaps[:-1], gaps[1:], strict=True) if b - a > 2]
        spans += [(0, len(lines))] if len(lines) > 1 else []
        for a, b in dict.fromkeys(spans):
            if True not in holds[a:b]:
                continue
            own = [t for x in lines[a:b] for t in x]
            # Only template words add to a cosine: their share of the squared norm, counts included as in best(), bounds its square.
            inside = outside = 0.0
            for t, n in Counter(own).items():
                v = (n * self.idf.get(t, self.least)) ** 2
                if t in self.words:
                    inside += v
                else:
                    outside += v
            if inside >= SIMILARITY**2 * (inside + outside) - 1e-6:
                out.append((a, b, own))
        return out

    def unknown(self, segments: list[tuple[int, int, list[bytes]]]) -> list[bytes]:
        """Words whose counts the segments' cosines need beside those held: of segments that may reach SIMILARITY with them at least."""
        need: set[bytes] = set()
        for _, _, own in segments:
            rare = {t for t in own if t not in self.idf}
            if rare and self.best(own, dict.fromkeys(rare, self.at_most))[0] >= SIMILARITY - 1e-9:
                need |= rare
        return sorted(need)

    def document(self, text: bytes, hint: re.Pattern, others: dict[bytes, int] | None = None, segments: list[tuple[int, int, list[bytes]]] | None = None) -> tuple[str | None, float, int, int]:
        """(licence, cosine, words in matching segments, all words) over the whole text.

        others: documents by word, of the words in :meth:`unknown`; segments: if they are known already.
        """
        segments = self.segments(text, hint) if segments is None else segments
        if not segments:
            return None, 0.0, 0, len(text.split())
        lines = text.split(b"\n")
        covered, top, name = np.zeros(len(lines), bool), 0.0, None
        for a, b, own in segments:
            score, k = self.best(own, others)
            if score >= SIMILARITY:
                covered[a:b] = True
                if score > top:
                    top, name = score, self.names[-k]
        inside = sum(len(x.split()) for x, c in zip(lines, covered, strict=True) if c)
        return name, top, inside, sum(len(x.split()) for x in lines)


def needed_words(matcher: Matcher) -> set[bytes]:
    """Every segment at SIMILARITY holds one of these words."""
    needed: set[bytes] = set()
    for vector in matcher.vectors:
        # Dropping these words leaves a cosine below the threshold, so a match holds one of them.
        left = 1.0
        for t, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if left < SIMILARITY**2:
                break
            needed.add(t)
            left -= v * v
    return needed


def hint_of(matcher: Matcher) -> re.Pattern:
    """Matches any text in which some segment may reach the threshold: all template words that can matter.

    A segment at SIMILARITY holds a template's heaviest words; it can't do with
    only words whose joint weight in every template is below the threshold.
    """
    return re.compile(b"|".join(re.escape(t) for t in sorted(needed_words(matcher))), re.IGNORECASE)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents by word, summed over as much as COUNT_WORDS allows."""
    count: Counter = Counter()
    handed_on = lambda: pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["term", "n"])
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()):
            count.update(_terms_fast(text.as_py() or b""))
            if len(count) > COUNT_WORDS:
                yield handed_on()
                count.clear()
    yield handed_on()


def _terms_fast(raw: bytes) -> set[bytes]:
    return {w.strip(_EDGES) for w in set(raw.lower().split())} - {b""}


@dataclass
class Fitted:
    """A matcher and the table (term, n) of documents by word."""

    matcher: Matcher
    counts: DataFrame


def fit(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, common: int = COMMON) -> Fitted:
    """Count the documents of every word."""
    spark = docs.sparkSession
    counts = materialize(docs.select("text").mapInArrow(_frequencies, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "license-terms")
    vocabulary = spark.createDataFrame([(bytearray(t),) for t in sorted({t for _, text in templates for t in _terms(text.encode())})], "term binary")
    often = counts.orderBy(F.desc("n"), "term").limit(common).collect()  # at most ``common`` rows
    own = counts.join(F.broadcast(vocabulary), "term").collect()  # at most the templates' terms
    at_most = often[-1].n if len(often) == common else 0
    return Fitted(Matcher.of(templates, {bytes(r.term): r.n for r in [*often, *own]}, docs.count(), at_most), counts)


_RESULT = "own_license string, own_score double, license_words bigint, n_words bigint"


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)]


def _own(shared):
    """Results of texts that the held counts settle; of others the text, its digest and the words to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        hint = hint_of(matcher)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
            need, rows = [], []
            for t in texts:
                segments = matcher.segments(t, hint)
                need.append(matcher.unknown(segments))
                rows.append((None, None, None, None) if need[-1] else matcher.document(t, hint, segments=segments))
            kept = [t if n else None for t, n in zip(texts, need, strict=True)]
            digest = [hashlib.sha256(t).digest() if t is not None else None for t in kept]
            others = [k for k, n in enumerate(batch.schema.names) if n != "text"]
            more = [*_arrays(rows), pa.array(kept, pa.binary()), pa.array(digest, pa.binary()), pa.array(need, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in others], *more], [*[batch.schema.names[k] for k in others], "own_license", "own_score", "license_words", "n_words", "raw", "digest", "need"])

    return run


def _settled(shared):
    """(digest, raw, found: array of (term, n)) -> digest and result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        hint = hint_of(matcher)
        for batch in batches:
            counts = [{r["term"]: r["n"] for r in found.as_py() or []} for found in batch.column("found")]
            rows = [matcher.document(t.as_py(), hint, c) for t, c in zip(batch.column("raw"), counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *_arrays(rows)], ["digest", "own_license", "own_score", "license_words", "n_words"])

    return run


def _own_licenses(files: DataFrame, fitted: Fitted) -> DataFrame:
    """``files`` without text, with own_license, own_score, license_words and n_words."""
    shared = files.sparkSession.sparkContext.broadcast(fitted.matcher)
    kept = files.drop("text")
    first = files.mapInArrow(_own(shared), extended(kept.schema, _RESULT + ", raw binary, digest binary, need array<binary>"))
    first = materialize(first, "license-first")
    settled = first.where("digest is null").drop("raw", "digest", "need")
    open_ = first.where("digest is not null")
    if open_.isEmpty():
        return settled
    texts = materialize(open_.groupBy("digest").agg(F.first("raw").alias("raw"), F.first("need").alias("need")), "license-open")
    need = texts.select("digest", F.explode("need").alias("term"))
    wanted = materialize(need.select("term").distinct(), "license-wanted")
    counts = materialize(sized_join(fitted.counts, wanted, "term", "inner", 40), "license-counts")
    found = sized_join(need, counts, "term", "inner", 48).groupBy("digest").agg(F.collect_list(F.struct("term", "n")).alias("found"))
    results = texts.select("digest", "raw").join(found, "digest", "left").mapInArrow(_settled(shared), "digest binary, " + _RESULT)
    results = materialize(results, "license-results")
    late = sized_join(open_.select(*kept.columns, "digest"), results, "digest", "inner", 120).drop("digest")
    return settled.unionByName(late)


def scan(files: DataFrame, fitted: Fitted) -> DataFrame:
    """(doc_id, path, text) -> doc_id, path, own_license, own_score, license, license_from, levels_up.

    Paths are names joined by ``/``; levels_up is null for own licences and 0 for
    the file's own directory.
    """
    files = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), "text")
    own = materialize(_own_licenses(files, fitted), "license-own")
    own = own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    is_file = F.col("own_license").isNotNull() & (F.col("license_words") >= FILE_SHARE * F.col("n_words"))
    speaks = own.where(is_file).groupBy(F.col("dir").alias("up")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("m"))
    speaks = materialize(speaks.select("up", F.col("m.own_license").alias("license"), F.col("m.path").alias("license_from")), "license-dirs")
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("levels_up"), F.array_join(F.slice(parts, 1, F.size(parts) - k), "/").alias("up")))
    dirs = own.select("dir").distinct().select("dir", F.inline(F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("levels_up"), F.lit("").alias("up")))).otherwise(ups)))
    nearest = sized_join(dirs, speaks, "up", "inner", 120).groupBy("dir").agg(F.min(F.struct("levels_up", "license", "license_from")).alias("near"))
    nearest = materialize(nearest, "license-nearest")
    out = sized_join(own, nearest, "dir", "left", 160)
    mine = F.col("own_license").isNotNull()
    return out.select(
        "doc_id", "path", "own_license", "own_score",
        F.when(mine, F.col("own_license")).otherwise(F.col("near.license")).alias("license"),
        F.when(mine, F.col("path")).otherwise(F.col("near.license_from")).alias("license_from"),
        F.when(~mine, F.col("near.levels_up")).alias("levels_up"),
    )


def document_path() -> Column:
    """``documents`` has no paths: source, language and id stand for them, 64 ids to a directory."""
    group = F.coalesce(F.floor(F.col("doc_id") / 64).cast("string"), F.lit(""))
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), group, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", document_path().alias("path"), "text"), fit(docs, [*TEMPLATES, *BODIES]))
