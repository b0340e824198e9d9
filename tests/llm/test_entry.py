"""Registered queries, the pipeline, and empty tables."""

import collections

import pytest

import __spark_entry__
import corpus_pipeline
from newswatch.llm import chat_tree, decontaminate, html_extract, license_scan, ngram_join, packing, quality_rules, suffix_dedup, token_output, warc
from newswatch.llm.common import table
from tests.llm import brute


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"
    ]


def test_pipeline_equals_brute_force(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").filter("doc_id < 300")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    # Too few labels here to prove any cutoff: the base rules alone decide.
    left = {d: t for d, t in rows.items() if not brute.quality_counts(t)["base_failed"]}
    of = brute.components(left)
    left = {d: t for d, t in left.items() if of[d] == d}
    counts = brute.window_counts([t.encode() for t in left.values()], 400)
    left = {d: brute.removed(t.encode(), counts, 400)[2].decode("utf-8", "ignore") for d, t in left.items()}
    index = next(decontaminate.indexes(table(spark, sf_dir, "benchmark"), 1 << 24))
    left = {d: t for d, t in left.items() if t.strip() and not list(index.hits([decontaminate.words_of(t.encode())], decontaminate.Rules()))}
    got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) == set(left)


@pytest.mark.parametrize("name", ["documents", "pages", "conversations"])
def test_empty_tables(spark, sf_dir, name, word_tokenizer, byte_tokenizer):
    empty = table(spark, sf_dir, name).limit(0)
    labels, items = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    if name == "documents":
        results = [
            ngram_join.classes(ngram_join.join(empty)), ngram_join.one_of_each(empty), suffix_dedup.report(empty), suffix_dedup.without_repeats(empty),
            quality_rules.judge(empty, labels), quality_rules.judge(empty, labels.limit(0)), quality_rules.good_documents(empty, labels),
            decontaminate.find(empty, items), decontaminate.find(empty, items.limit(0)), decontaminate.clean_documents(empty, items),
            packing.pack(empty, word_tokenizer, 2), token_output.read_documents(token_output.write(empty, word_tokenizer, 49_408, 2)),
            license_scan.summary(license_scan.scan(empty, license_scan.train(table(spark, sf_dir, name), 20, 100))),
        ]
    elif name == "pages":
        results = [html_extract.extract(empty), warc.captures(warc.whole_records(warc.read_segments(spark, warc.write_archives(empty))))]
    else:
        results = [chat_tree.read_conversations(chat_tree.format_conversations(empty, byte_tokenizer), byte_tokenizer)]
    assert [r.count() for r in results] == [0] * len(results)
