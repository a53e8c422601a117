"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; brute force on small corpora."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from weftmesh.llm import decontaminate, license_scan, ngram_join, quality_classifier, quality_rules, secret_scan, source_mixing, substring_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, junk, nulls and odd white space."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(300)] + ["Ünï", "é", "x\u00a0y", "a\u0085b"]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 160))]
        if texts and kind < 0.2:
            own = words(rng.choice(texts))
            for _ in range(rng.randint(0, 3)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
        elif kind < 0.4:
            cut = rng.randint(45, 70)
            own = own[:40] + passage[:cut] + own[40:]
        elif kind < 0.5:
            own = ["again", "and", "Again"] * rng.randint(1, 40)
        texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    return rows + [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, " \n\t ", "en", "s0", 4), (5, texts[5], "en", "s2", len(texts[5])), (None, texts[7], "en", "s1", 1)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def test_ngram_join_matches_brute_force(docs, rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    expected = []
    for k, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        expected.append((r[0], len(sets[k]), r[0] if not sets[k] else min(ids, default=None)))
    found = [tuple(r) for r in ngram_join.join_components(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_ngram_join_large_group_and_common_passage(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(150):
        near = list(base)
        near[rng.randrange(200)] = f"n{k}"
        rows.append((k, " ".join(near)))
    common = [f"c{k}" for k in range(60)]
    rows += [(1000 + k, " ".join([f"u{k}_{j}" for j in range(150)] + common)) for k in range(150)]
    found = {r.doc_id: r.component_id for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(found[k] == 0 for k in range(150))
    assert all(found[1000 + k] == 1000 + k for k in range(150))


def test_representatives_keep_columns(docs):
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))


def removed_words(rows):
    starts = {}
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - 49):
            i = r[0] if r[0] is not None else float("inf")
            key = tuple(w[k : k + 50])
            starts[key] = min(starts.get(key, i), i)
    out = []
    for r in rows:
        w, gone = words(r[1]), set()
        for k in range(len(w) - 49):
            if starts[tuple(w[k : k + 50])] < (r[0] if r[0] is not None else float("inf")):
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup_matches_brute_force(docs, rows):
    found = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.dedup(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(found, key=key) == sorted(removed_words(rows), key=key)
    assert sum(r[2] for r in found) > 0


def base_stats(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeat = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), n < 10 or 100 * len(repeat) > 20 * n


def test_quality_rules_base_matches_brute_force(docs, rows):
    judged = quality_rules.judge(quality_rules.with_stats(docs).cache())
    found = [tuple(r) for r in judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(found, key=key) == sorted([(r[0], *base_stats(r[1])) for r in rows], key=key)
    assert not judged.where("base_failed and kept").count()


def test_quality_rules_estimate_tells_accurate_rules():
    rng = random.Random(5)
    votes = Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        votes[tuple((int(good) if rng.random() < accuracy else int(not good)) if rng.random() < 0.8 else None for accuracy in (0.95, 0.8, 0.55))] += 1
    _, likely = quality_rules.estimate(list(votes.items()), 3)
    right = [(likely[j][1][1] / (likely[j][1][1] + likely[j][1][0])) for j in range(3)]
    assert right[0] > right[1] > right[2]


KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
SECRETS = [
    "Ünï password = 'hunter2hunter2' and token=abc token=secret: abcdefghij",
    "AKIAABCDEFGH12345 x AKIA12 akia AKIAAKIA1234567890",
    "f" * 40 + " 0123456789abcdef0123456789abcdef password=" + "0a" * 20,
    "API_KEY:\"ABCDEFGHIJ==\" apikey = short Secret=ABCDEFGH.12345678",
    "owned Abcdefgh1234567890Zyxwvuts9 here",
    "nothing at all", "", None,
]


def test_secret_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(SECRETS)], DOCS)
    found = {r.doc_id: r for r in secret_scan.scan(secret_scan.find_spans(docs.selectExpr("doc_id", "source as repository", "source as owner", "text")).drop("text").cache()).select("doc_id", secret_scan.digest(secret_scan.F.col("base")).alias("base"), secret_scan.digest(secret_scan.F.col("spans")).alias("spans")).collect()}
    assert len(found) == len(SECRETS)
    for k, text in enumerate(SECRETS):
        spans = [(m.start(), i, m.end(), kind) for i, (kind, pattern, keep) in enumerate(KINDS) for m in pattern.finditer(text or "") if keep(m)]
        assert found[k].base == ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans))
    assert "owned:6:33" in found[4].spans


def test_copied_values_are_no_owned_secrets(spark):
    value = "Abcdefgh1234567890Zyxwvuts9"
    docs = spark.createDataFrame([(k, f"see {value}", "en", f"s{k}", 0) for k in range(5)], DOCS)
    found = secret_scan.scan(secret_scan.find_spans(docs.selectExpr("doc_id", "source as repository", "source as owner", "text")).drop("text").cache())
    assert all(not r.spans for r in found.collect())


def test_redaction_masks_spans_only(spark):
    docs = spark.createDataFrame([(1, "a password=abcdefgh1 b", "en", "s", 22), (2, "clean", "en", "s", 5), (3, None, "en", "s", None)], DOCS)
    found = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert found[1].text == "a [SECRET] b" and found[1].n_chars == 12
    assert found[2].text == "clean" and found[3].text is None


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.randint(0, 40), rng.random() + 0.1) for k in range(3000)]
    table = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, quality double").cache()
    found = source_mixing.mix(table).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, source_mixing.mix(table).collect())) if all(r.source for r in found) else True
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert target[s] <= 3 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= 40


def test_leaks_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([12, 25, 40])))) for k in range(12)] + [(50, "Two words"), (51, None), (52, "")]
    rows = []
    for k in range(80):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if k % 4 == 0:
            item = words(rng.choice(items[:12])[1])
            if k % 8 == 0:
                item[len(item) // 2] = "changed"
            own[10:10] = item
        rows.append((k, " ".join(own)))
    rows += [(90, "here are tWo WORDS."), (91, "two words"), (92, None), (93, "")]
    expected = set()
    for d, text in rows:
        w = words(lower(text))
        for i, item in items:
            v = words(lower(item))
            if not v or not w:
                continue
            size = min(len(v), len(w)) if len(v) >= 5 else len(v)
            grams = lambda x: Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) if len(x) >= 5 else Counter([tuple(x)])
            want = grams(v)
            for k in range(len(w) - size + 1):
                have = grams(w[k : k + size])
                both = sum((have & want).values())
                if both >= 0.8 * (sum(have.values()) + sum(want.values()) - both):
                    expected.add((d, i))
    docs, table = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, table).collect()}
    assert found == expected and expected
    kept = {r.doc_id for r in decontaminate.clean(docs, table).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in expected}


def test_hamming_blocks_find_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(4)
    index = decontaminate.Index(list(range(50)), [" ".join(f"a{k}_{j}" for j in range(20)) for k in range(50)])
    prints = index.prints[:30] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (decontaminate.RADIUS, 30)).astype(np.uint64), axis=0)
    window, item, _ = index.near(prints, 20)
    found = set(zip(window.tolist(), item.tolist(), strict=True))
    brute = {(w, i) for w in range(30) for i in range(50) if int(np.bitwise_count(prints[w] ^ index.prints[i])) <= decontaminate.RADIUS}
    assert found == brute


def test_urls(spark):
    urls = [
        ("http://EXAMPLE.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://a.b.com/", "a.b.com", "/", "com/", "allow"),
        ("https://b.com", "b.com", "", None, "allow"),
        ("x://y.net/es/?u=http://z.com/", "y.net", "/es/", "net/es/", "block"),
        ("http://netx/fr/", "netx", "/fr/", None, "allow"),
        ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u[0], "clash") for k, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    found = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule)
        assert rule is None or found[k].verdict == verdict


def test_mined_rules_judge_the_rest(spark):
    rows = [(k, f"http://h{k % 9}.net/{'es' if k % 2 else 'de'}/casino/{k}") for k in range(200)] + [(1000 + k, f"http://g{k % 9}.com/news/{k}") for k in range(200)] + [(5000, "http://z.org/es/casino/1"), (5001, "http://z.org/news/1")]
    found = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert found[5000].verdict == "block" and found[5000].rule is None and found[5000].mined_rule
    assert found[5001].verdict == "allow"


def test_rule_index_matches_brute_force():
    rng = random.Random(8)
    tokens = [f"t{k}" for k in range(12)]
    rules = url_filter.Rules.of([(frozenset(rng.sample(tokens, rng.randint(1, 3))), rng.choice(["block", "allow"]), round(rng.random(), 2), rng.random()) for _ in range(40)])
    for _ in range(200):
        have = rng.sample(tokens, rng.randint(0, 6))
        brute = next((n for n, r in enumerate(rules.rules) if r[0] <= set(have)), None)
        assert rules.match(have) == brute


def test_licences_and_inheritance(spark):
    files = [
        (1, "a/b/c.txt", "some words of prose that outnumber the words of its notice by far\nLicensed under the Apache License, Version 2.0."),
        (2, "a/LICENSE", "Released under the MIT License."),
        (3, "a/b/d.txt", "plain prose without a notice"),
        (4, "x/y/z.txt", "plain prose"), (5, "a/b/e/f.txt", None), (6, "a/b/e/f.txt", ""), (7, None, "all rights of the reserved kind are words"),
    ]
    table = spark.createDataFrame(files, "doc_id bigint, path string, text string")
    found = {r.doc_id: r for r in license_scan.scan(table, license_scan.fit(table)).collect()}
    assert len(found) == len(files)
    assert found[1].own_license == found[1].license == "Apache-2.0"
    assert (found[3].license, found[3].license_from, found[3].levels_up) == ("MIT", "a/LICENSE", 1)
    assert found[5].license == found[6].license == "MIT" and found[4].license is None and found[7].own_license is None


def test_licence_weights_of_all_words(spark):
    """Every word has its own document frequency, held by the driver or looked up; equal to brute force."""
    rng = random.Random(4)
    texts = [" ".join(["by", "the"] * (k % 10 < 9) + [f"w{rng.randint(0, 40)}" for _ in range(12)] + ["license", "software"] * (k % 20 == 0)) for k in range(300)]
    texts += ["Released under the MIT License by", "by Licensed under CC BY-NC 4.0.\nw1 w2", "All rights reserved. w3 w3", "All rights reserved. w1"] * 2
    texts += [" ".join(rng.choice(license_scan.TEMPLATES)[1].split() + [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 3))]) for _ in range(60)] + [None, ""]
    table = spark.createDataFrame([(k, f"d{k}/x", t) for k, t in enumerate(texts)], "doc_id bigint, path string, text string")
    df = Counter(t for text in texts for t in set(license_scan._terms((text or "").encode())))
    matcher = license_scan.Matcher.of(license_scan.TEMPLATES, df, len(texts))
    expected = {}
    for k, text in enumerate(texts):
        lines = [license_scan._terms(x) for x in (text or "").encode().split(b"\n")]
        scores = [matcher.best(x) for x in [*lines, [t for x in lines for t in x]]]
        top = max([s for s, _ in scores if s >= license_scan.SIMILARITY], default=0.0)
        expected[k] = round(top, 9)
    for common in (20_000, 3):
        fitted = license_scan.fit(table, common=common)
        assert {bytes(r.term): r.n for r in fitted.counts.collect()} == df
        found = {r.doc_id: round(r.own_score, 9) for r in license_scan.scan(table, fitted).collect()}
        assert found == expected
    fitted, hint = license_scan.fit(table, common=3), license_scan.hint_of(matcher)
    assert any(fitted.matcher.unknown(fitted.matcher.segments((t or "").encode(), hint)) for t in texts)  # some are looked up
    assert expected[300] > 0.9 and sum(s > 0 for s in expected.values()) > 20


def test_licence_bound_drops_nothing():
    """The skip before the cosine keeps every segment that best() scores at the threshold, repeated words included."""
    common = {b"all": 50_000, b"the": 50_000, b"of": 50_000, b"to": 50_000, b"or": 50_000, b"and": 50_000}
    found = {t: common.get(t, 1_000) for _, text in license_scan.TEMPLATES for t in license_scan._terms(text.encode())}
    matcher = license_scan.Matcher.of(license_scan.TEMPLATES, found, 100_000)
    hint = license_scan.hint_of(matcher)
    rng = random.Random(2)
    texts = ["All rights reserved. All rights reserved. Acme"]
    for _ in range(300):
        own = rng.choice(license_scan.TEMPLATES)[1].split() * rng.randint(1, 3)
        texts.append(" ".join(own + [rng.choice(["Acme", "other", "words"]) for _ in range(rng.randint(0, 6))]))
    kept = 0
    for text in texts:
        score, k = matcher.best(license_scan._terms(text.encode()))
        name, top, *_ = matcher.document(text.encode(), hint)
        wanted = (matcher.names[-k], score) if score >= license_scan.SIMILARITY else (None, 0.0)
        assert (name, top) == wanted
        kept += name is not None
    assert matcher.document(texts[0].encode(), hint)[0] == "proprietary" and 0 < kept < len(texts)


def test_licence_hint_drops_nothing(spark):
    matcher = license_scan.Matcher.of(license_scan.TEMPLATES, {}, 1000)
    hint = license_scan.hint_of(matcher)
    rng = random.Random(1)
    for _ in range(300):
        text = rng.choice(license_scan.TEMPLATES)[1].split()
        some = rng.sample(text, rng.randint(1, len(text))) + ["other"] * rng.randint(0, 2)
        raw = " ".join(some).encode()
        if matcher.best(license_scan._terms(raw))[0] >= license_scan.SIMILARITY:
            assert hint.search(raw)


def labelled(spark, n=400, toxic=False):
    rng = random.Random(12)
    clean = ["the", "of", "and", "river", "stone", "walks", "light", "green", "paper", "door"]
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        w = [rng.choice(clean) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 120))]
        if bad and toxic:
            for _ in range(max(2, len(w) // 15)):
                w[rng.randrange(len(w))] = rng.choice(["vilewort", "vilewortig", "nastor"])
        elif bad:
            w = ["SPAM!!"] * 30
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, int(not bad), int(bad)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, "word " * 30_000, "en", "s", 0), (3, rows[3][1], "en", "s", 0)]
    labels += [(n, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_classifier(spark):
    docs, labels = labelled(spark)
    forest = quality_classifier.train(docs, labels, ~quality_classifier.held_out())
    scored = quality_classifier.score(docs.withColumn("score", docs.doc_id), forest)
    held = [r for r in scored.where(quality_classifier.held_out() & (scored.doc_id < 400)).collect()]
    assert len(held) > 50 and sum((r.score >= 0.7) == (r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in scored.collect())
    none = quality_classifier.train(docs, labels.limit(0), ~quality_classifier.held_out())
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}


def test_toxicity_reads_whole_words(monkeypatch):
    """The character input is the mean over all grams of a word, however long."""
    rng = np.random.default_rng(3)
    net = toxicity.Network.fresh(np.zeros(0, np.uint64), rng)
    for lot in (toxicity.GRAM_LOT, 7):
        monkeypatch.setattr(toxicity, "GRAM_LOT", lot)
        texts = ["x" * 10_000, "x" * 9_000 + "kill" + "x" * 996, "a bc Def ghij Ünïcödé_wörd/over-eighteen_bytes", "", "x" * 18, "x" * 17 + "y"]
        (piece,) = toxicity.pieces(toxicity.pa.array(texts), True)
        vocab, inverse = toxicity.vocabulary(piece, net.known)
        x = net.inputs(vocab)
        seen = [w.encode().lower() for t in texts for w in words(t)]
        for raw, place in zip(seen, inverse, strict=True):
            codes = []
            for at in range(-1, max(len(raw) - toxicity.CHAR_GRAM + 1, 0)):
                code = 0
                for k in range(toxicity.CHAR_GRAM):
                    value = 7 if at + k < 0 else int(toxicity._LOWER[raw[at + k]]) if at + k < len(raw) else 9
                    code += value * int(toxicity.PLACES[k])
                codes.append(code % (1 << 64))
            rows = (toxicity.mix(np.array(codes, np.uint64)) % np.uint64(toxicity.CHAR_BUCKETS)).astype(int)
            assert np.allclose(x[place, toxicity.WORD_DIM :], net.weights["char"][rows].mean(axis=0, dtype=float), atol=1e-6)
        scores = net.score(piece)
        assert scores[0] != scores[1] and scores[4] != scores[5]
        one = [net.score(p) for t in texts for p in toxicity.pieces(toxicity.pa.array([t]), True)]
        assert np.allclose(scores, np.concatenate(one))


def test_toxicity(spark):
    docs, labels = labelled(spark, toxic=True)
    net = toxicity.train(docs, labels, ~toxicity.held_out())
    scored = toxicity.score(docs, net)
    held = [r for r in scored.where(toxicity.held_out() & (scored.doc_id < 400)).collect()]
    assert len(held) > 50 and sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held) >= 0.9 * len(held)
    empty = scored.where("doc_id in (400, 401)").collect()
    assert len(empty) == 2 and all(r.score < 0.1 for r in empty)


def test_gradients_match_differences():
    import numpy as np
    import pyarrow as pa

    from weftmesh.llm.words import pieces

    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(np.zeros(0, np.uint64), rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    piece = next(pieces(pa.array(["one two three four", "five six"]), True))
    words_, inverse = toxicity.vocabulary(piece, net.known)
    _, start, length = toxicity.windows(piece)
    mask = np.arange(toxicity.WINDOW)[None, :] < length[:, None]
    ids = inverse[np.minimum(start[:, None] + np.arange(toxicity.WINDOW), len(inverse) - 1)]
    x = net.inputs(words_).astype(np.float64)
    kept = {}
    net.logits(x, ids, mask, kept)
    g, dx = net.gradients(x, ids, mask, kept, np.array([1.0, -0.5]))
    value = lambda: float(net.logits(x, ids, mask) @ np.array([1.0, -0.5]))
    for name in ("hf", "xb", "a", "v", "o", "cf"):
        at = tuple(0 for _ in net.weights[name].shape)
        old = net.weights[name][at]
        net.weights[name][at] = old + 1e-3
        up = value()
        net.weights[name][at] = old - 1e-3
        down = value()
        net.weights[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)
    x[0, 0] += 1e-3
    up = value()
    x[0, 0] -= 2e-3
    assert dx[0, 0] == pytest.approx((up - value()) / 2e-3, abs=2e-3)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert not ngram_join.join_components(none).count()
    assert not substring_dedup.dedup(none).count()
    assert not decontaminate.find_leaks(docs, items).count()
    assert not decontaminate.find_leaks(none, spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).count()
    assert not quality_rules.judge(quality_rules.with_stats(none)).count()
    assert not secret_scan.redact(none).count()
    assert not source_mixing.mix(none.selectExpr("doc_id", "source", "n_chars as size", "1.0D as quality")).count()
    assert not license_scan.scan(none.selectExpr("doc_id", "source as path", "text"), license_scan.fit(none)).count()
    assert not url_filter.judge(none.selectExpr("doc_id as page_id", "text as url")).count()
    assert not quality_classifier.score(none, quality_classifier.train(none, labels, quality_classifier.F.lit(True))).count()
    assert not toxicity.score(none, toxicity.train(none, labels, toxicity.F.lit(True))).count()


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 200)
    clean = docs.where("doc_id is null or doc_id < 200")
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    more = spark.createDataFrame([(900, "river stone light " * 3 + leak + " green paper door walks the river of light", "en", "s", 0), (901, "the green river and the stone walks of paper with password=abcdef123456 light door", "en", "t", 0)], DOCS)
    clean.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        table = spark.createDataFrame(out.collect(), DOCS)
    ids = {r.doc_id: r.text for r in table.collect()}
    assert 900 not in ids
    assert not any(k % 4 == 0 for k in ids if k is not None and k < 200)
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in result.collect()} == set(ids)
