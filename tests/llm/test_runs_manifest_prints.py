"""Run detection, Merkle manifest and winnowing against plain versions of their contracts."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newswatch.llm import merkle_manifest, queries, run_detection, winnowing
from newswatch.llm.common import table
from tests.llm import brute
from tests.oracle_check import compare, connect


def batch_of(docs):
    words = np.array([w for d in docs for w in d], np.int64)
    first, begin = np.zeros(len(words), bool), 0
    for d in docs:
        if d:
            first[begin] = True
        begin += len(d)
    return words, first


def test_runs_of_random_words_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(0, 6)):
            n = rnd.choice([0, 1, 5, 6, 20, 60, 150])
            w = [rnd.randint(0, rnd.choice([1, 2, 5, 50])) for _ in range(n)]
            if n > 8 and rnd.random() < 0.7:
                a = rnd.randrange(n)
                p = 1 + (n - a) // rnd.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        want, begin = [], 0
        for d in docs:
            want += [(s + begin, n, q) for s, n, q in brute.runs(d)]
            begin += len(d)
        got = zip(*(c.tolist() for c in run_detection.runs_of(*batch_of(docs))), strict=True)
        assert list(got) == want, docs


def test_grammar_derives_every_word_and_repeats_no_pair():
    rnd = random.Random(5)
    docs = [[rnd.randint(0, 3) for _ in range(rnd.randint(1, 80))] for _ in range(9)] + [[7] * 100]
    words, first = batch_of(docs)
    g = run_detection.re_pair(words, first)

    def derived(x):
        return [x] if x < g.n_words else derived(g.left[x - g.n_words]) + derived(g.right[x - g.n_words])

    for rule, place in zip(g.rule.tolist(), g.place.tolist(), strict=True):
        n = g.length[g.n_words + rule]
        assert derived(g.n_words + rule) == words[place : place + n].tolist()
        assert not first[place + 1 : place + n].any()  # no rule reaches into the next document
    # One symbol is left of each document: a binary tree has as many inner nodes as leaves, less one.
    assert len(g.rule) == sum(len(d) - 1 for d in docs)


def test_very_long_run_and_thue_morse():
    bits = [0]
    while len(bits) < 1 << 13:
        bits += [1 - b for b in bits]  # cube-free, and a trap for hashes that overflow
    docs = [[1] * 60_000, bits, list(range(1000)) * 9]
    got = list(zip(*(c.tolist() for c in run_detection.runs_of(*batch_of(docs))), strict=True))
    assert got == [(0, 60_000, 1), (60_000 + len(bits), 9000, 1000)]


def test_run_query_equals_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = collections.Counter(tuple(r) for r in queries.op11_run_detection(spark, "").collect())
    want = []
    for doc_id, text in rows:
        w = brute.planted_words(doc_id, text)
        found = brute.runs(w) if len(w) < 5000 else [(0, len(w), 1)]  # the one long fixture is one word
        best = max(found, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]), default=(None,) * 3)
        exponent = None if best[0] is None else 1000 * best[1] // best[2]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((doc_id, len(found), *best, exponent, brute.sha(lines.encode()), brute.sha(brute.collapsed(w, found).encode())))
    assert got == collections.Counter(want)


def test_of_equal_exponents_the_first_run_is_the_strongest(spark):
    schema = "runs array<struct<start: bigint, length: bigint, period: bigint>>"
    cases = [[], [(0, 8, 2), (20, 12, 3), (40, 9, 2)], [(3, 12, 3), (3, 8, 2), (9, 40, 10)], [(1, 3 * 10**8 + 1, 3), (2, 10**8, 1)]]
    got = spark.createDataFrame([(c,) for c in cases], schema).select(run_detection.strongest(F.col("runs")).alias("b")).collect()
    assert [tuple(r.b) if r.b else None for r in got] == [None, (40, 9, 2), (3, 12, 3), (1, 3 * 10**8 + 1, 3)]


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest_by_hand(rows):
    """Rows (FIELDS) to a multiset of what the query returns."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, brute.leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = brute.tree([x[2] for x in groups[g]])
    root, above = brute.tree([trees[g][0] for g in order])
    out = []
    for g, upper in zip(order, above, strict=True):
        for (_, _, own, r), path in zip(groups[g], trees[g][1], strict=True):
            whole = path + upper
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            claimed = brute.leaf((*r[:3], r[3] + 1, r[4])) if changed else own
            proof = brute.sha("".join(h for _, h in whole).encode())
            out.append((r[0], own, trees[g][0], root, proof, brute.fold(claimed, whole), brute.fold(claimed, whole) == root))
    return collections.Counter(out)


def test_manifest_query_equals_brute_force(spark, docs, monkeypatch):
    lang = F.when(F.col("doc_id") == -4, F.lit(None)).when(F.col("doc_id") == -5, F.lit("é")).otherwise(F.col("lang"))
    some = docs.withColumn("lang", lang).withColumns({"leaf": F.lit(1), "key": F.lit("k"), "rank": F.lit(2), "path": F.lit("p"), "a.b": F.lit(0)})
    some = some.withColumn("n_chars", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")))
    monkeypatch.setattr(queries, "table", lambda *_: some)
    got = collections.Counter(tuple(r) for r in queries.op12_merkle_manifest(spark, "").collect())
    assert got == manifest_by_hand([tuple(r) for r in some.select(*FIELDS).collect()])
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 513, 70_001])
def test_manifest_of_every_size_over_one_and_more_tiers(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(3).alias("n_chars"), F.lit("t").alias("text"))
    proved = merkle_manifest.manifest(rows, FIELDS, "lang", "doc_id")
    checked = proved.select("leaf", "subroot", "root", merkle_manifest.folded("leaf", "path").alias("f"), F.size("path").alias("n"))
    top, _ = brute.tree([brute.leaf((k, "s", "en", 3, "t")) for k in range(n)])
    assert checked.filter("f = root").count() == n
    assert [tuple(r) for r in checked.select("subroot", "root", "n").distinct().collect()] == [(top, top, (n - 1).bit_length())]


@pytest.mark.parametrize("name", sorted(queries.oracle()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    rows, problems = compare(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle()[name])
    assert rows and not problems


def plain_print(text):
    """Entries by position: of each window of stretches the least hash, the rightmost of equal ones."""
    k = min(winnowing.K, len(text))
    grams, windows = brute.winnowed(text, k, winnowing.WINDOW) if text else ([], [])
    h = [int(winnowing.rolling(np.frombuffer(g.encode("utf-32-le"), "<u4"), k)[0]) for g in grams]
    kept = sorted({min(w, key=lambda j: (h[j], -j)) for w in windows})
    return [(h[j] - (1 << 64) if h[j] >> 63 else h[j], j) for j in kept]


def test_winnowing_query_equals_brute_force(spark, docs, rows, monkeypatch):
    some = docs.filter("doc_id IS NULL OR doc_id < 150 AND doc_id <> -17").withColumns({"turned": F.lit(1), "stretch": F.lit(2), "mark": F.lit("x"), "ahead": F.lit(True)})
    monkeypatch.setattr(queries, "table", lambda *_: some)
    got = collections.Counter(
        (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
        for r in queries.op13_winnowing(spark, "").collect()
    )
    marks = {(r.doc_id, r.text): r.m for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("m")).distinct().collect()}
    kept = [(d, t) for d, t in rows if d is None or d < 150 and d != -17]
    kept.sort(key=lambda r: (r[0] is None, -(r[0] or 0), marks[r]))
    out = []
    for (d, t), (_, other) in zip(kept, kept[1:] + kept[:1], strict=True):
        t, other = t or "", other or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + other[:half]
        own, of_changed, of_next = (plain_print(x) for x in (t, changed, other))

        def near(a, b):
            x, y = {h for h, _ in a}, {h for h, _ in b}
            return (sum(h in y for h, _ in a) + sum(h in x for h, _ in b)) / (len(a) + len(b)) if a or b else 1.0

        shown = [" ".join(f"{h % (1 << 64):x}:{p}" for h, p in e) for e in (own, of_changed)]
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), *shown, round(near(own, of_changed), 9), round(near(own, of_next), 9)))
    assert got == collections.Counter(out)


def test_shared_stretches_are_always_met():
    rnd = random.Random(11)
    letters = "ab cdé\U0001f600"
    for _ in range(200):
        common = "".join(rnd.choice(letters) for _ in range(winnowing.K + winnowing.WINDOW - 1))
        a, b = ("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 300))) for _ in range(2))
        (one, at), (two, to) = winnowing.fingerprint(a + common + b), winnowing.fingerprint(b + common + a)
        inside = {h for h, p in zip(one.tolist(), at.tolist(), strict=True) if len(a) <= p}
        assert inside & set(two.tolist())


def test_empty_single_and_repeated_rows(spark, sf_dir):
    empty = table(spark, sf_dir, "documents").limit(0)
    assert run_detection.find_runs(empty).count() == winnowing.compare_neighbours(empty).count() == winnowing.fingerprints(empty).count() == 0
    assert merkle_manifest.manifest(empty, FIELDS, "lang", "doc_id").count() == 0
    one = spark.createDataFrame([(5, "z" * 500)], "doc_id long, text string")
    got = winnowing.compare_neighbours(one).collect()
    assert [(r.edited, r.near_edited, r.near_next) for r in got] == [("z" * 500, 1.0, 1.0)]
    two = winnowing.compare_neighbours(one.union(one)).collect()
    assert [(r.edited, r.near_next) for r in two] == [("z" * 500, 1.0)] * 2
