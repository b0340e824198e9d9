"""Joins, rules, repeats, leaks and licences over documents, against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newswatch.llm import decontaminate, license_scan, ngram_join, quality_rules, suffix_dedup
from newswatch.llm.common import table
from newswatch.llm.components import components
from tests.llm import brute


def test_join_finds_every_link(docs, rows):
    got = ngram_join.classes(ngram_join.join(docs)).collect()
    # Rows of one id are one node: their texts are tied together.
    ids = [d for d, _ in rows if d is not None]
    twin = {}
    texts = {}
    for k, (d, t) in enumerate(rows):
        if d is not None:
            node = d if d not in texts else 10_000_000 + k
            texts[node] = t
            twin.setdefault(d, []).append(node)
    of = brute.components(texts)
    merged = {n: n for n in set(of.values())}

    def find(x):
        while merged[x] != x:
            x = merged[x]
        return x

    for nodes in twin.values():
        for n in nodes[1:]:
            a, b = find(of[nodes[0]]), find(of[n])
            merged[max(a, b)] = min(a, b)
    want = collections.Counter((d, len(brute.shingles(t)), find(of[d]) if d is not None else None) for d, t in rows)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len(ids) > len({r.component_id for r in got})


def test_join_of_chains_and_stars(spark):
    """Sets that link only to their neighbours, a large group of near copies, and a common shingle in all."""
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    texts = {}
    for k in range(12):  # each differs from the one before in two places
        base[k * 5] = f"c{k}"
        texts[k] = "one common run of words here " + " ".join(base)
    for k in range(100, 160):
        own = [f"v{j}" for j in range(80)]
        own[rnd.randrange(80)] = f"x{k}"
        texts[k] = "one common run of words here " + " ".join(own)
    for k in range(200, 240):
        texts[k] = "one common run of words here " + " ".join(f"u{rnd.randrange(10**6)}" for _ in range(12))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.classes(ngram_join.join(frame)).collect()}
    assert got == brute.components(texts)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 150)}, 200: 200, 300: 200}


def test_one_of_each_keeps_rows_and_columns(docs, rows):
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert None in ids
    assert -4 not in ids and -5 in ids  # "a b" twice: the smaller id stays


def test_counts_of_quality_rules(docs, rows, spark, sf_dir):
    got = quality_rules.judge(docs, table(spark, sf_dir, "labels")).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = collections.Counter((d, *(brute.quality_counts(t)[n] for n in names)) for d, t in rows)
    assert collections.Counter((r.doc_id, *(r[n] for n in names)) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


@pytest.mark.parametrize("n,k,p", [(1, 0, 0.5), (75, 0, 0.05), (500, 3, 0.02), (4000, 5, 0.004), (100_000, 350, 0.004), (50, 10, 0.1)])
def test_binomial_tail(spark, n, k, p):
    terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p) for j in range(k + 1)]
    want = 1.0 if k >= n * p else sum(map(math.exp, terms))
    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n), F.lit(k), p).alias("v")).first().v
    assert got == pytest.approx(want, rel=1e-8)


def test_cutoffs_are_safe_and_used(spark):
    """Junk with many symbols is caught where labels suffice, and nowhere else."""
    good = " ".join(f"word{k}" for k in range(60))
    junk = " ".join(f"word{k}###" for k in range(60))
    rows = [(k, good, "en") for k in range(3000)] + [(5000 + k, junk, "en") for k in range(200)] + [(9000 + k, junk, "xx") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 3000, 1).otherwise(0).alias("quality"))
    kept = {r.doc_id for r in quality_rules.good_documents(docs, labels).collect()}
    assert kept == set(range(3000)) | set(range(9000, 9020))


def test_repeats(docs, rows):
    got = collections.Counter(tuple(r) for r in suffix_dedup.report(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    texts = [(d, (t or "").encode()) for d, t in rows]
    counts = brute.window_counts([t for _, t in texts], 400)
    want = collections.Counter()
    for d, t in texts:
        n, spans, kept = brute.removed(t, counts, 400)
        want[(d, len(t), n, spans, brute.sha(kept))] += 1
    assert got == want


def test_a_passage_in_many_surroundings_is_found_across_shards(spark):
    """With one segment to a shard, only what the shards tell each other shows the passage."""
    rnd = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(120))
    own = lambda n: " ".join(f"o{rnd.randrange(10**8)}" for _ in range(n))
    rows = [(k, f"{own(60)} {passage} {own(60)}") for k in range(12)] + [(50, own(200))]
    want = {}
    counts = brute.window_counts([t.encode() for _, t in rows], 400)
    for d, t in rows:
        want[d] = brute.removed(t.encode(), counts, 400)[:2]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (1, 3, 1000):
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.report(frame, most_segments=most).collect()}
        assert got == want and got[50] == (0, 0) and got[0][0] > 400


def test_repeats_are_measured_in_bytes_not_words(spark):
    """Sixty shared words below 400 bytes stay, longer ones go; `n_bytes` is the input's size either way."""
    rnd = random.Random(8)
    own = lambda: " ".join(f"o{rnd.randrange(10**8)}" for _ in range(60))
    short = " ".join(f"s{k:03}" for k in range(60))
    long = " ".join(f"long{k:03}" for k in range(60))
    assert len(short) + 2 < 400 < len(long)
    rows = [(k, f"{own()} {p} {own()}") for k, p in enumerate([short, short, long, long])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.report(frame).collect()}
    assert [got[k].n_bytes for k in range(4)] == [len(t) for _, t in rows]
    assert [got[k].changed for k in range(4)] == [False, False, True, True]
    left = {r.doc_id: r.text for r in suffix_dedup.without_repeats(frame).collect()}
    assert left[0] == rows[0][1] and left[1] == rows[1][1]
    assert all(long not in left[k] and rows[k][1].startswith(left[k][:300]) for k in (2, 3))


def test_merged_transforms_on_small_alphabets(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 20)
    rnd = random.Random(11)
    for _ in range(150):
        window = rnd.choice([20, 33, 64])
        letters = rnd.choice([b"a", b"ab", b"abcdefghijklmnop"])
        base = bytes(rnd.choice(letters) for _ in range(400))
        pieces = []
        for _ in range(rnd.randint(1, 10)):
            x = b""
            for _ in range(rnd.randint(1, 4)):
                at = rnd.randint(0, 300)
                x += base[at : at + rnd.randint(5, 200)] if rnd.random() < 0.6 else bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 80)))
            pieces.append(x)
        pieces = sorted({p for p in pieces if len(p) >= window})
        if not pieces:
            continue
        counts = brute.window_counts(pieces, window)
        marks = [bytearray(len(p)) for p in pieces]
        for s, low, high in suffix_dedup.repeated_windows(pieces, [1] * len(pieces), window):
            marks[s][low:high] = b"\1" * (high - low)
        for p, m in zip(pieces, marks, strict=True):
            assert bytes(b for b, x in zip(p, m, strict=True) if not x) == brute.removed(p, counts, window)[2]


def test_a_call_merges_several_transforms(monkeypatch):
    """With the default sizes what is merged at a time has more than one shard."""
    shards, merged = [], suffix_dedup.merged
    monkeypatch.setattr(suffix_dedup, "merged", lambda orders, *rest: shards.append(len(orders)) or merged(orders, *rest))
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(5000)]
    common = " ".join(rnd.choice(words) for _ in range(90)).encode()
    segments = [" ".join(rnd.choice(words) for _ in range(120)).encode() + common for _ in range(suffix_dedup.CHUNK // 1200)]
    got = {s: (low, high) for s, low, high in suffix_dedup.repeated_windows(segments, [1] * len(segments), 400)}
    assert shards[0] > 2 and len(got) == len(segments)
    assert all(low <= len(s) - len(common) and high == len(s) for s, (low, high) in zip(segments, (got[k] for k in range(len(segments))), strict=True))


@pytest.mark.parametrize("stage", ["quality", "repeats", "copies"])
def test_stages_keep_columns_of_any_name(spark, sf_dir, stage):
    docs = table(spark, sf_dir, "documents").filter("doc_id < 120")
    names = ["kept", "whole", "digest__", "row__", "a.b", "document", "limits", "n_words", "changed", "c", "n", "set_id"]
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    one = {
        "quality": lambda d: quality_rules.good_documents(d, table(spark, sf_dir, "labels")),
        "repeats": suffix_dedup.without_repeats,
        "copies": ngram_join.one_of_each,
    }[stage]
    plain = {tuple(r) for r in one(docs).collect()}
    got = one(wide)
    assert got.columns == wide.columns and got.schema == wide.schema
    found = got.collect()
    assert {tuple(r)[: len(docs.columns)] for r in found} == plain
    assert all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)


def test_suffix_order():
    rnd = random.Random(2)
    for _ in range(50):
        sequences = [[rnd.randint(10, 12) for _ in range(rnd.randint(0, 20))] + [k] for k in range(5)]
        flat = [x for s in sequences for x in s]
        want = sorted(range(len(flat)), key=lambda k: flat[k:])
        assert suffix_dedup.suffix_order(np.array(flat)).tolist() == want


def test_texts_without_repeats_keep_rows(docs, rows):
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    texts = collections.defaultdict(list)
    for r in left.collect():
        texts[r.doc_id].append(r.text)
    assert -14 not in texts and -15 not in texts  # copies of each other
    assert texts[-1] == [None] and texts[-9] == ["y" * 399]
    assert "tail one" in texts[-12][0]


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "one"), (-4, "capital of France? Paris"), (-5, "人工智能的定义是什么？它是研究如何让机器思考的科学。"), (-6, " .!"), (-7, "same id"), (5, "item id seen twice. with an answer of some words")], "item_id long, text string")
    return table(spark, sf_dir, "benchmark").unionByName(odd)


@pytest.fixture(scope="module")
def with_items(spark, docs):
    odd = [
        (-101, "so the capital of France? Paris it is"), (-102, "the capital of Paris, France"), (-103, "前面的文字人工智能的定义是什么？它是研究如何让机器思考的科学。后面的文字"),
        (-104, "One!"), (-105, "one more"), (-106, "人工智能" * 40), (-107, "item id seen twice — with an answer of some words"),
    ]
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))


def test_leaks_equal_full_scoring(docs, with_items, items):
    rows = [tuple(r) for r in with_items.collect()]
    want = brute.leaks(rows, [tuple(r) for r in items.select("item_id", "text").collect()])
    got = decontaminate.find(with_items, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 3
    assert {(-101, -4), (-103, -5), (-104, -3), (-16, -7), (-107, 5)} <= want and not {-102, -105, -106} & {d for d, _ in want}
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    leaky = {d for d, _ in brute.leaks(list(enumerate(t for _, t in texts)), [tuple(r) for r in items.select("item_id", "text").collect()])}
    assert collections.Counter(tuple(r) for r in clean.select("doc_id", "text").collect()) == collections.Counter(t for k, t in enumerate(texts) if k not in leaky)


def test_split_index_finds_the_same(with_items, items):
    plain = lambda df: sorted((r.doc_id, r.item_id, r.passage, round(r.score, 9), r.question_overlap) for r in df.collect())
    assert len(list(decontaminate.indexes(items, 4000))) > 2
    assert plain(decontaminate.find(with_items, items, most_bytes=4000)) == plain(decontaminate.find(with_items, items))


def test_planted_items_are_found_and_clean_ones_left(spark, items):
    texts = {r.item_id: r.text for r in items.filter("item_id >= 0").collect()}
    filler = " ".join(f"filler{k % 97} of the" for k in range(300))
    rows = [(k, f"{filler} {t} {filler}") for k, t in texts.items() if len(t.split()) > 12] + [(10_000, filler)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {(k, k) for k, _ in rows[:-1]} <= got
    assert not any(d == 10_000 for d, _ in got)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return license_scan.train(table(spark, sf_dir, "documents"), sample_docs=100, sample_paragraphs=1000)


def test_licence_classifier(spark, model, docs, rows):
    assert model.held_out_accuracy > 0.95
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": ("gpl", True),
        "Released under the MIT License.": ("mit", True),
        "Licensed under the Apache License, Version 2.0.": ("apache", True),
        "Licensed under CC BY-NC 4.0.": ("cc-by-nc", True),
        "Licensed under CC BY-SA 4.0.": ("cc-by-sa", True),
    }
    frame = spark.createDataFrame([(k, f"first line\n{x}") for k, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.notices for r in license_scan.scan(frame, model).collect()}
    for k, (family, sure) in enumerate(lines.values()):
        (notice,) = got[k]
        assert (notice.line, notice.family, notice.confirmed) == (1, family, sure)
    summary = license_scan.summary(license_scan.scan(docs, model)).collect()
    assert len(summary) == len(rows)
    known = ("GNU General Public License, version 3", "MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "All rights reserved.")
    want = collections.Counter((d, sum(x in (t or "") for x in known)) for d, t in rows)
    assert collections.Counter((r.doc_id, r.n_confirmed) for r in summary) == want


def test_short_notices_of_the_proprietary_family(spark, model, docs, rows):
    """Every notice line of the documents is confirmed, 'All rights reserved.' as well."""
    lines = ["All rights reserved.", "Copyright 2020 A. Maker. All rights reserved.", "Proprietary and confidential."]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in license_scan.summary(license_scan.scan(frame, model)).collect()}
    assert got == dict.fromkeys(range(3), "proprietary")
    known = {
        "GNU General Public License, version 3": "gpl", "MIT License": "mit", "Apache License, Version 2.0": "apache",
        "CC BY-NC 4.0": "cc-by-nc", "All rights reserved.": "proprietary",
    }
    want = collections.Counter((d, ",".join(sorted({f for x, f in known.items() if x in (t or "")})), sum(x in (t or "") for x in known)) for d, t in rows)
    summary = license_scan.summary(license_scan.scan(docs, model)).collect()
    assert collections.Counter((r.doc_id, r.families, r.n_confirmed) for r in summary) == want
    assert any("proprietary" in f for _, f, _ in want)


def test_wrapped_notices_are_joined(spark, model):
    """A notice over several lines is one notice, named by its first line; blank lines part paragraphs."""
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction."
    bsd = "# Redistribution and use in source and\n# binary forms, with or without\n# modification, are permitted provided that\n# the following conditions are met."
    texts = {
        f"Some project\n\n{mit}\n\nmore text": [(2, "mit")],
        f"a line of text before it\n{bsd}\na line of text behind": [(1, "bsd")],
        "Released under\nthe MIT License.": [(0, "mit")],
        f"{mit}\n{bsd}\nReleased under the MIT License.": [(0, "mit"), (3, "bsd"), (7, "mit")],
        "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0\nInternational License.": [(0, "cc-by-sa")],
        "Permission is\n\nhereby granted,\n\nfree of charge": [],
        "one line\n\nand another line\nof text": [],
    }
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(n.line, n.family) for n in r.notices if n.confirmed] for r in license_scan.scan(frame, model).collect()}
    assert got == dict(enumerate(texts.values()))


def test_no_predicted_line_is_passed_over(spark, sf_dir):
    """Sampled lines with the words of notices take no notice away, and the cues lose nothing that is predicted."""
    plain = ["The licensed plumber came by at 4 under contract, cc the office, 0 to pay.", "A file in the public domain of released rights was reserved by its author.", "He may obtain a copy of this work at a licence shop."]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").limit(40).unionByName(spark.createDataFrame([(-k, x) for k, x in enumerate(plain, 1)], "doc_id long, text string"))
    model = license_scan.train(docs, sample_docs=100, sample_paragraphs=300)
    (found,) = license_scan.scan(spark.createDataFrame([(1, "Licensed under CC BY 4.0.")], "doc_id long, text string"), model).collect()
    assert [n.family for n in found.notices] in (["cc-by"], [license_scan.UNKNOWN])
    rnd = random.Random(7)
    notices = [t.split() for ts in license_scan.TEMPLATES.values() for t in ts]
    lines = list(plain)
    for _ in range(400):
        words = rnd.choice(notices)
        at = rnd.randrange(len(words))
        lines.append(" ".join(words[at : at + rnd.randint(1, 6)] + rnd.sample(plain[0].split(), rnd.randint(0, 3))))
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    judged = frame.select("doc_id", license_scan.let(license_scan.words_of(F.col("text")), lambda w: license_scan.predict(w, model)).alias("p"))
    want = {(r.doc_id, r.p.family) for r in judged.collect() if r.p.family != license_scan.NONE}
    assert {(r.doc_id, n.family) for r in license_scan.scan(frame, model).collect() for n in r.notices} == want and len(want) > 20


def test_pipeline_keeps_one_of_repeated_rows(spark, sf_dir):
    """A row stored twice, and copies without an id, come out of the second and third stage once and whole."""
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(120))
    rows = [(1, text(1)), (1, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (None, text(3)), (4, text(4)), (None, text(5)), (None, text(5).upper()), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = corpus_pipeline.near_copies(spark, docs, sf_dir)
    got = [(r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.repeated_strings(spark, one, sf_dir).collect()]
    assert one.columns == docs.columns
    assert collections.Counter(got) == collections.Counter([(1, text(1)), (None, text(2)), (3, text(3)), (4, text(4)), (None, text(5)), (None, "")])
