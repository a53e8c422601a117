"""Large groups, hot keys, very long texts, clashing columns, ties and null ids; loops beside vectorised code."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftmesh.llm import decontaminate, license_scan, ngram_join, quality_classifier, quality_rules, secret_scan, source_mixing, substring_dedup, toxicity, url_filter
from weftmesh.llm.words import pieces, unused


def _components(texts):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def test_ngram_join_fragmented_group(spark, monkeypatch):
    """Copies near the threshold: hardly any link with one leader, many clusters and several groups to open."""
    rng, base = random.Random(3), [f"w{k}" for k in range(120)]
    texts = []
    for k in range(500):
        near = list(base)
        for j in rng.sample(range(120), 2 + k % 2):
            near[j] = f"n{k}_{j}"
        texts.append(" ".join(near))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expected = _components(texts)
    assert 1 < len(set(expected)) < 400
    for lot in (128, 16):
        monkeypatch.setattr(ngram_join, "LOT", lot)
        monkeypatch.setattr(ngram_join, "GROUP", lot)
        monkeypatch.setattr(ngram_join, "TOKEN_CLUSTERS", 20)
        monkeypatch.setattr(ngram_join, "ASKED", 10)
        found = {r.doc_id: r.component_id for r in ngram_join.join_components(table).collect()}
        assert [found[k] for k in range(500)] == expected


def test_lots_link_as_pairs_do():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 300)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 300), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 40))])) for _ in range(60)]
    found = ngram_join.overlaps(sets)
    for a in range(60):
        for b in range(60):
            assert found[a, b] == len(np.intersect1d(sets[a], sets[b])) or a == b and found[a, a] <= len(sets[a])
    tree, hubs = ngram_join.closed([base, base[:290], base[10:], np.arange(50)])
    assert len(tree) == 2 and len(hubs) == 1 and 3 not in {x for t in tree for x in t}


def test_representatives_of_clashing_tables(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near = text.replace("w7 ", "changed ")
    rows = [(5, text, 1, 2, "a"), (5, near, 3, 4, "b"), (7, text, 5, 6, "c"), (9, "other words", 7, 8, "d"), (9, "other words", 7, 8, "d"), (None, text, 9, 9, "e"), (3, "", 1, 1, "f"), (3, None, 1, 1, "g")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, _id bigint, _rows bigint, _docs_ string")
    kept = ngram_join.representatives(table)
    assert kept.columns == table.columns
    got = [tuple(r) for r in kept.collect()]
    assert sum(r[0] == 5 for r in got) == 1 and not any(r[0] in (7, None) for r in got)
    assert sum(r[0] == 9 for r in got) == 1 and sum(r[0] == 3 for r in got) == 2
    assert not ngram_join.representatives(table.where("doc_id > 100")).count()


def test_repeats_hot_passage_and_extreme_ids(spark):
    """One passage in a third of the rows, a second one that the first holder of its anchors lacks, ids at both ends."""
    rng = random.Random(8)
    passage, line = [f"p{k}" for k in range(70)], [f"c{k}" for k in range(14)]
    shared = [f"q{k}" for k in range(55)]
    rows = []
    for k in range(150):
        own = [f"u{k}_{j}" for j in range(rng.randint(20, 60))]
        at = rng.randint(0, len(own))
        if k % 3 == 0:
            own[at:at] = passage
        elif k % 3 == 1:
            own[at:at] = line if k < 60 else shared[:20] + line + shared[20:]
        rows.append((k - 75, " ".join(own)))
    rows += [((1 << 63) - 1, " ".join(["x", *passage])), (None, " ".join(["y", *passage])), (-(1 << 63), " ".join(passage[:52])), (5000, "z " * 90), (5001, "z " * 60 + " ".join(passage))]
    starts, inf = {}, float("inf")
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            starts[tuple(w[k : k + 50])] = min(starts.get(tuple(w[k : k + 50]), inf), inf if i is None else i)
    expected = {}
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - 49):
            if starts[tuple(w[k : k + 50])] < (inf if i is None else i):
                gone.update(range(k, k + 50))
        expected[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, node bigint, key bigint")
    found = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.dedup(table).collect()}
    assert found == expected and sum(n for _, n, _ in found.values()) > 3000


def test_extension_stops_at_differences():
    own = np.arange(100, dtype=np.uint64)
    other = np.concatenate([[np.uint64(999)], own[20:60], [np.uint64(998)]])
    assert substring_dedup.extended(own, 30, other, 11) == (20, 60)
    packed = substring_dedup._packed([own[:3], own[:0], own[5:6]])
    assert substring_dedup._unpacked(np.frombuffer(packed[0].as_py(), np.uint8)).tolist() == [0, 1, 2] and packed[1].as_py() == b""


def test_long_text_of_secrets(spark):
    n = 20_000
    text = "password=hunter2hunter2 x" * n
    table = spark.createDataFrame([(1, text, "en", "s", len(text), "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint, _spans string, _hash int")
    begun = time.time()
    found = secret_scan.find_spans(table.select("doc_id", "text")).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).head()
    assert found.n == n and (found.last.start, found.last.end) == (25 * (n - 1), 25 * (n - 1) + 23)
    masked = secret_scan.redact(table)
    assert masked.columns == table.columns
    row = masked.head()
    assert row.text == "[SECRET] x" * n and row.n_chars == 10 * n and (row._spans, row._hash) == ("a", 1)
    assert time.time() - begun < 60


def test_owned_secrets_match_brute_force(spark):
    rng = random.Random(12)
    values = ["".join(rng.choice("abcdefgABCDEFG1234567") for _ in range(26)) + "aA1" for _ in range(12)]
    rows = [(k, f"see {rng.choice(values)} and {rng.choice(values)}", rng.choice(["a", "b", "c", None, ""]), rng.choice(["x", "y", None])) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, repository string, owner string")
    found = {r.doc_id: {(s.start, s.end) for s in r.spans} for r in secret_scan.scan(secret_scan.find_spans(table).drop("text").cache()).collect()}
    where = {v: ({r[2] for r in rows if v in r[1]}, {r[3] for r in rows if v in r[1]}) for v in values}
    for k, text, _, _ in rows:
        want = {m.span() for m in re.finditer(r"[A-Za-z0-9_-]{24,}", text) if len(where[m[0]][0]) <= 2 and len(where[m[0]][1]) <= 2}
        assert found[k] == want
    assert any(found.values()) and not all(found.values())


def test_running_totals(spark):
    for n in (0, 1, secret_scan.BLOCK, secret_scan.BLOCK + 1, 3 * secret_scan.BLOCK + 7):
        values = [(7 * k) % 11 for k in range(n)]
        row = spark.createDataFrame([(values,)], "v array<int>").select(secret_scan._before(F.col("v"), lambda a, b: a + b).alias("s"), secret_scan._before(F.col("v"), F.greatest).alias("m")).head()
        assert row.s == [sum(values[:k]) for k in range(n)] and row.m == [max([0, *values[:k]]) for k in range(n)]


def test_mixing_carries_columns_and_reruns_agree(spark):
    rows = [(k if k % 7 else None, ["a", "b", None][k % 3], k % 9, 0.5, f"n{k}", k) for k in range(400)] + [(3, "a", 2, 0.5, "tie", 1)] * 5
    table = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, quality double, _note string, _key bigint").cache()
    first = source_mixing.mix(table)
    assert first.columns == [*table.columns, "source_size", "target", "taken"]
    key = lambda r: str(tuple(r))
    one, two = sorted(map(tuple, first.collect()), key=key), sorted(map(tuple, source_mixing.mix(table.repartition(7)).collect()), key=key)
    assert one == two and sorted((r[:6] for r in one), key=str) == sorted(rows, key=str)
    assert not source_mixing.mix(table.where("size > 100").cache()).count()


def test_posterior_and_kept_match_a_plain_loop(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["word", "another", "thing", "###", "x"]) for _ in range(rng.randint(0, 120))) for _ in range(150)] + [None, "", "a " * 3000]
    table = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id bigint, text string, _words bigint")
    stats = quality_rules.with_stats(table).cache()
    assert [r._words for r in stats.orderBy("doc_id").collect()] == list(range(len(texts)))
    judged = quality_rules.judge(stats).collect()
    names = quality_rules.default_rules()
    votes = {r.doc_id: tuple(r[n] for n in names) for r in stats.select("doc_id", *[v.alias(n) for n, v in names.items()]).collect()}
    counts = {}
    for v in votes.values():
        counts[v] = counts.get(v, 0) + 1
    order = sorted(counts.items(), key=lambda x: ",".join("-" if y is None else str(y) for y in x[0]))
    prior, likely = quality_rules.estimate(order, len(names))
    for r in judged:
        odds = math.log(prior / (1 - prior)) + sum(math.log(likely[j][1][v] / likely[j][0][v]) for j, v in enumerate(votes[r.doc_id]) if v is not None)
        p = 1 / (1 + math.exp(-odds))
        assert r.quality_probability == pytest.approx(p, abs=1e-9)
        assert r.kept == (not r.base_failed and p >= 0.5)
    assert any(r.kept for r in judged) and not all(r.kept for r in judged)


def test_forest_walk_matches_a_plain_loop():
    rng = np.random.default_rng(2)
    x = rng.random((300, 4))
    forest = quality_classifier.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    for row, got in zip(x[:50], forest.score(x[:50]), strict=True):
        z = forest.base if hasattr(forest, "base") else 0.0
        inner = forest.feature.shape[1]
        for t in range(len(forest.feature)):
            node = 0
            while node < inner:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            z += forest.leaf[t, node - inner]
        alone = forest.score(row[None])[0]
        assert alone == pytest.approx(got)
        assert 0 <= got <= 1 and (not hasattr(forest, "base") or got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6))


def test_windows_cover_every_word():
    texts = [" ".join(["w"] * n) for n in (0, 1, 31, 32, 33, 48, 49, 64, 500)]
    for piece in pieces(pa.array(texts), True):
        for stride in (toxicity.STRIDE, toxicity.WINDOW):
            doc, start, length = toxicity.windows(piece, stride)
            for k, t in enumerate(texts):
                n, at = len(t.split()), piece.at[k]
                mine = [(s - at, s - at + m) for d, s, m in zip(doc, start, length, strict=True) if d == k]
                plain, p = [], 0
                while n:
                    plain.append((p, min(n, p + toxicity.WINDOW)))
                    if p + toxicity.WINDOW >= n:
                        break
                    p += stride
                assert {x for a, b in mine for x in range(a, b)} == set(range(n)) and all(0 <= a < b <= n for a, b in mine)
                assert len(mine) in (len(plain), len(plain) + 1)


def test_scores_of_a_text_without_spaces():
    rng = random.Random(1)
    net = toxicity.fit([" ".join(rng.choice(["good", "fine", "calm"] if k % 2 else ["vile", "awful", "calm"]) for _ in range(40)) for k in range(60)], np.array([(k + 1) % 2 for k in range(60)], float))
    scores = [net.score(p)[0] for t in ("x" * 1_000_000, "x" * 999_000 + "vile" * 250, "") for p in pieces(pa.array([t]), True)]
    assert all(0 <= s <= 1 for s in scores) and scores[0] != scores[1]


def test_urls_of_clashing_tables(spark):
    rows = [(k, f"https://h{k % 5}.net/{'es' if k % 2 else 'x'}/p", k, "t") for k in range(60)] + [(60, None, 1, "t"), (60, "no scheme", 1, "t")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, _mined bigint, _Tokens string")
    found = url_filter.judge(table)
    assert found.columns[:4] == table.columns and sorted(tuple(r)[:4] for r in found.where("url is not null").collect()) == sorted(r for r in rows if r[1])
    assert unused(["A", "b"], "a", "b", "c") == ("a_", "b_", "c")


def test_rules_within_more_general_ones_go():
    rng = random.Random(5)
    found = [(frozenset(rng.sample("abcdef", rng.randint(1, 3))), rng.choice(["allow", "block"]), rng.choice([0.8, 0.9, 1.0]), rng.random()) for _ in range(300)]
    kept = url_filter.Rules.of(found).rules
    plain = []
    for rule in sorted(found, key=lambda r: (-r[2], -r[3], len(r[0]), sorted(r[0]), r[1])):
        if not any(k[1] == rule[1] and k[0] <= rule[0] for k in plain):
            plain.append(rule)
    assert kept == plain


def test_leaks_in_several_blocks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(f"i{k}_{rng.randint(0, 9)}" for _ in range(30))) for k in range(25)] + [(99, " ".join(f"long{k}" for k in range(3000)))]
    rows = [(k, "before " + items[k][1] + " after") for k in range(0, 25, 3)] + [(0, "before " + items[0][1]), (None, items[5][1]), (500, "x " * 50 + items[-1][1]), (501, "clean words only here now")]
    table, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted((tuple(r) for r in decontaminate.find_leaks(table, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 4)
    parts = sorted((tuple(r) for r in decontaminate.find_leaks(table, bench).collect()), key=str)
    assert parts == whole and {(r[0], r[1]) for r in whole} == {(k, k) for k in range(0, 25, 3)} | {(None, 5), (500, 99)}
    assert sum(r[:2] == (0, 0) for r in whole) == 2
    assert [r.doc_id for r in decontaminate.clean(table, bench).collect()] == [501]


def test_whole_licence_files_speak_for_their_directory(spark):
    bodies = {name: text for name, text in license_scan.BODIES if len(text.split()) > 100}
    rows, k = [], 0
    for name, text in bodies.items():
        w = text.split()
        lines = "\n".join(" ".join(w[a : a + 12]) for a in range(0, len(w), 12))
        rows += [(k, f"{name}/LICENSE", f"Copyright 2024 Some Holder\n\n{lines}"), (k + 1, f"{name}/src/a.txt", "prose of its own"), (k + 2, f"{name}/src/a.txt", "prose of its own")]
        k += 3
    rows += [(90, "t/A", "All rights reserved."), (91, "t/B", "All rights reserved."), (92, "t/x/y", "prose"), (93, "t/x/z", "word " * 50_000 + "\nAll rights reserved.")]
    table = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    found = {r.doc_id: r for r in license_scan.scan(table, license_scan.fit(table, [*license_scan.TEMPLATES, *license_scan.BODIES])).collect()}
    for n, name in enumerate(bodies):
        assert found[3 * n].own_license == name and found[3 * n + 1].license == found[3 * n + 2].license == name
    assert (found[92].license, found[92].license_from) == ("proprietary", "t/A") and found[93].own_license == "proprietary"


def test_samples_take_one_row_of_an_id(spark):
    table = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "doc_id bigint, quality int")
    got = sorted(tuple(r) for r in quality_classifier.labelled_sample(table, labels, "quality", F.lit(True), 10).collect())
    assert got == [(1, 0, "a"), (2, 1, "c")]
