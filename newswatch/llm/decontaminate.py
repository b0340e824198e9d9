"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Index: for each word the items that have it, in order, with BM25 weights divided by the item's
score against itself, so that a score is the share of an item that a passage has. Per
word and block of items the highest weight is kept.

Query: a document is cut into overlapping passages, twice as long as the longest item and one
such length apart, so every occurrence lies whole in one. The distinct words of a passage are
the query. Passages whose block maxima cannot reach the threshold are passed over for whole
batches at a time; the others walk the lists by block-max WAND, which retrieves all items at
or above the threshold. A retrieved item is verified: enough of the word sequences of its
question (all but the last sentence) and of its answer (the last) must be in the passage.

Words are folded runs of letters and digits; scripts written without spaces count each character as a
word. Counts of words over the items, for their weights, come from all items, as does the length of a passage, so
what is found does not depend on how many indexes the benchmark is split into.

Size: the items of one index are collected only up to `most_bytes` of text; a larger benchmark
is split by item into as many indexes that read the documents in turn. Documents are never shuffled.

Defined results: items and documents with a null or empty text or without words match nothing; an item of two to
four words is too short for shares and is found where all its words stand in a row; an item of one word has
no answer beside its question and is found only in a document that is this word; items of equal
ids are one item in the result; documents of equal ids are one document; a null document id is
kept as it is; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswatch.llm.common import batches, bytes_of, text_of, written

HITS = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double"
BLOCK = 2  # items of a block: so few that the bound of a passage is close to its best score
K1, B = 1.2, 0.75
SHORT = 5  # words of an item; fewer must stand in a row
# Upper-case letters to lower case, ASCII punctuation to spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256))
# UTF-8 of punctuation and of characters written without spaces between words: Thai, Lao, Burmese, Khmer, kana, Chinese.
MARKS = re.compile(rb"\xe3\x80[\x80-\xbf]|\xef\xbc[\x81-\x8f\x9a-\xa0]|\xe2\x80[\x80-\xbf]")
UNSPACED = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1(?:[\x80\x81\x9e\x9f][\x80-\xbf]|\x82[\x80-\x9f])|[\xe3-\xe9][\x80-\xbf]{2}|\xf0[\xa0-\xaf][\x80-\xbf]{2}")
SENTENCE = re.compile(rb"[.?!](?=\s)|\n|\xe3\x80\x82|\xef\xbc[\x81\x8e\x9f]")


def words_of(text: bytes) -> list[bytes]:
    folded = text.translate(FOLD)
    if not folded.isascii():
        folded = UNSPACED.sub(rb" \g<0> ", MARKS.sub(b" ", folded))
    return folded.split()


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The words of all but the last sentence and of the last; short ones are drawn up to a quarter."""
    words = words_of(text)
    at = [0, *(m.end() for m in SENTENCE.finditer(text))]
    ends = list(accumulate(len(words_of(text[a:b])) for a, b in pairwise(at)))
    least = max(1, min(8, len(words) // 4))
    cut = max((e for e in ends if least <= e <= len(words) - least), default=len(words) - max(least, len(words) // 4))
    return words[:cut], words[cut:]


@dataclass(frozen=True)
class Rules:
    threshold: float = 0.5  # share of an item's own BM25 score
    overlap: float = 0.5  # share of the word sequences of question and answer
    run: int = 3  # words in a sequence


class Index:
    """Inverted index of the test items with weights, list maxima and block maxima."""

    def __init__(self, items: list[tuple[int, bytes]], found_in: dict[bytes, int], n_items: int, mean: float, longest: int):
        """`found_in` counts, over all `n_items` items, of `mean` and at most `longest` words, those that have each word of these."""
        split = [words_of(t) for _, t in items]
        keep = [k for k, w in enumerate(split) if w]
        self.ids = [items[k][0] for k in keep]
        split = [split[k] for k in keep]
        self.parts = [question_and_answer(items[k][1]) if len(w) >= SHORT else (w, []) for k, w in zip(keep, split, strict=True)]
        self.longest = longest
        self.terms: dict[bytes, int] = {}
        n = len(split)
        rows, cols, tfs = [], [], []
        for k, words in enumerate(split):
            counts: dict[bytes, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            for w, tf in counts.items():
                rows.append(self.terms.setdefault(w, len(self.terms)))
                cols.append(k)
                tfs.append(tf)
        rows, cols, tfs = np.array(rows, np.int64), np.array(cols, np.int64), np.array(tfs, float)
        listed = np.bincount(rows, minlength=len(self.terms))
        df = np.array([found_in[w] for w in self.terms], np.int64)
        lengths = np.array([len(w) for w in split], float)
        weight = np.log(1 + (n_items - df[rows] + 0.5) / (df[rows] + 0.5)) * tfs * (K1 + 1)
        weight /= tfs + K1 * (1 - B + B * lengths[cols] / mean) if n else 1
        weight /= np.bincount(cols, weight, minlength=n)[cols] if n else 1
        order = np.lexsort((cols, rows))
        self.items, self.weights = cols[order], weight[order]
        self.starts = np.concatenate([[0], np.cumsum(listed)]).astype(np.int64)
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, rows, weight)
        # Block maxima: one entry per word and block that has it.
        self.n_blocks = -(-n // BLOCK)
        key = rows[order] * max(1, self.n_blocks) + self.items // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_of = self.items[first] // BLOCK
        self.block_most = np.maximum.reduceat(self.weights, first) if n else np.zeros(0)
        self.block_starts = np.searchsorted(first, self.starts)

    def blocks(self, term: int) -> dict[int, float]:
        a, b = self.block_starts[term], self.block_starts[term + 1]
        return dict(zip(self.block_of[a:b].tolist(), self.block_most[a:b].tolist(), strict=True))

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold, by block-max WAND over the terms' lists."""
        lists = [
            (self.items[self.starts[t] : self.starts[t + 1]].tolist(), self.weights[self.starts[t] : self.starts[t + 1]].tolist(), self.most[t], self.blocks(t))
            for t in terms
        ]
        at = [0] * len(lists)
        found, limit = [], threshold - 1e-9

        def skip(k: int, item: int) -> None:
            items = lists[k][0]
            while at[k] < len(items) and items[at[k]] < item:
                at[k] += 1

        while True:
            live = sorted((lists[k][0][at[k]], k) for k in range(len(lists)) if at[k] < len(lists[k][0]))
            total, pivot = 0.0, None
            for item, k in live:
                total += lists[k][2]
                if total >= limit:
                    pivot = item
                    break
            if pivot is None:
                return found
            ahead = [k for item, k in live if item <= pivot]
            block = pivot // BLOCK
            if sum(lists[k][3].get(block, 0.0) for k in ahead) < limit:
                # Nothing up to the end of the block can be reached by these lists; the next list may join earlier.
                beyond = min([(block + 1) * BLOCK, *(item for item, _ in live if item > pivot)])
                for k in ahead:
                    skip(k, beyond)
            elif live[0][0] == pivot:
                score = sum(lists[k][1][at[k]] for k in ahead)
                if score >= limit:
                    found.append((pivot, score))
                for k in ahead:
                    at[k] += 1
            else:
                for k in ahead:
                    skip(k, pivot)

    def verify(self, item: int, words: list[bytes], run: int) -> tuple[float, float]:
        """Shares of the question's and the answer's word sequences that the passage has; all or nothing of a short item."""
        whole, answer = self.parts[item]
        if not answer:
            n = len(whole)
            there = words == whole if n == 1 else any(words[k : k + n] == whole for k in range(len(words) - n + 1))
            return float(there), float(there)
        shares = []
        for part in self.parts[item]:
            n = min(run, max(1, len(part)))
            own = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}
            there = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            shares.append(len(own & there) / len(own) if part else 1.0)
        return shares[0], shares[1]

    def candidates(self, texts: list[list[bytes]], threshold: float) -> Iterator[tuple[int, int, int, list[int]]]:
        """(text, first word, last word, terms) of the passages whose block maxima reach the threshold."""
        get, step = self.terms.get, max(1, self.longest)
        known = [np.fromiter((get(w, -1) for w in words), np.int64, len(words)) for words in texts]
        lengths = np.array([len(k) for k in known], np.int64)
        n_passages = np.maximum(1, -(-lengths // step) - 1)
        first_passage = np.cumsum(n_passages) - n_passages
        owner = np.repeat(np.arange(len(texts)), n_passages)
        flat = np.concatenate(known) if known else np.zeros(0, np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text = np.repeat(np.arange(len(texts)), lengths)
        hit = flat >= 0
        flat, part, text = flat[hit], place[hit] // step, text[hit]
        # A word in stretch j lies in the passages that begin with stretch j - 1 and j.
        keys = []
        for passage in (part - 1, part):
            ok = (passage >= 0) & (passage < n_passages[text])
            keys.append((first_passage[text[ok]] + passage[ok]) * len(self.terms) + flat[ok])
        pairs = np.unique(np.concatenate(keys))
        passage, term = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
        limit = threshold - 1e-9
        strong = np.bincount(passage, self.most[term], minlength=len(owner)) >= limit
        passage, term = passage[strong[passage]], term[strong[passage]]
        lists = self.block_starts[term + 1] - self.block_starts[term]
        work = np.cumsum(lists)
        begins = np.flatnonzero(np.diff(passage, prepend=-1))  # pairs are in order of passages
        k = 0
        while k < len(begins):  # some passages at a time, so that their bounds stay in little memory
            done = work[begins[k] - 1] if begins[k] else 0
            stop = max(k + 1, int(np.searchsorted(work[begins[1:] - 1], done + (1 << 20), "right")) + 1) if k + 1 < len(begins) else k + 1
            stop = min(stop, k + (1 << 23) // max(1, self.n_blocks) + 1)
            low, high = begins[k], begins[stop] if stop < len(begins) else len(passage)
            n = lists[low:high]
            entry = np.arange(int(n.sum())) + np.repeat(self.block_starts[term[low:high]] - (np.cumsum(n) - n), n)
            row = np.repeat(np.searchsorted(begins[k:stop], np.arange(low, high), "right") - 1, n)
            bound = np.bincount(row * self.n_blocks + self.block_of[entry], self.block_most[entry], minlength=(stop - k) * self.n_blocks)
            for r in np.flatnonzero(bound.reshape(stop - k, self.n_blocks).max(axis=1, initial=0) >= limit):
                a = begins[k + r]
                b = begins[k + r + 1] if k + r + 1 < len(begins) else len(passage)
                p, t = int(passage[a]), int(owner[passage[a]])
                start = (p - int(first_passage[t])) * step
                yield t, start, start + 2 * step, term[a:b].tolist()
            k = stop

    def hits(self, texts: list[list[bytes]], rules: Rules) -> Iterator[tuple[int, int, int, float, float, float]]:
        """(text, item, first word of the passage, score, question overlap, answer overlap) of verified items."""
        for t, start, stop, terms in self.candidates(texts, rules.threshold):
            words = texts[t][start:stop]
            for item, score in self.retrieve(terms, rules.threshold):
                question, answer = self.verify(item, words, rules.run)
                if question >= rules.overlap and answer >= rules.overlap:
                    yield t, item, start, score, question, answer


def word_counts(rows: DataFrame) -> DataFrame:
    """Items that have each word; under a null word the items, their words and those of the longest."""

    def count(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_, "text"):
            found: Counter = Counter()
            split = [w for w in map(words_of, bytes_of(batch.column(1))) if w]
            for words in split:
                found.update(set(words))
            columns = [[None, *found], [len(split), *found.values()], *([f(map(len, split)), *[0] * len(found)] for f in (sum, lambda x: max(x, default=0)))]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "items", "words", "longest"])

    counted = rows.mapInArrow(count, "word binary, items long, words long, longest long")
    return counted.groupBy("word").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest"))


def indexes(items: DataFrame, most_bytes: int) -> Iterator[Index]:
    """Indexes of all items, each over at most about `most_bytes` of text, with weights from all of them."""
    rows = items.select(F.col("item_id").cast("long"), text_of("text").cast("binary").alias("text")).filter(F.octet_length("text") > 0)
    counts = written(word_counts(rows), "item-words")
    total = counts.filter("word IS NULL").first()
    n_items, n_words, longest = (total["items"], total.words, total.longest) if total else (0, 0, 0)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    slices = max(1, -(-size * 5 // (4 * most_bytes)) if size > most_bytes else 1)
    for k in range(slices):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k) if slices > 1 else rows
        # The words of a slice are fewer than its bytes.
        known = counts.join(word_counts(own).select("word"), "word", "left_semi") if slices > 1 else counts.filter("word IS NOT NULL")
        found_in = {bytes(r.word): r["items"] for r in known.select("word", "items").toLocalIterator()}
        texts = sorted(((r.item_id, bytes(r.text)) for r in own.toLocalIterator()), key=lambda r: (r[0] is None, r))
        yield Index(texts, found_in, n_items, n_words / max(1, n_items), longest)


def find(docs: DataFrame, items: DataFrame, rules: Rules = Rules(), most_bytes: int = 16 << 20) -> DataFrame:
    """One row per document and item it contains: the best verified passage."""
    spark, found = docs.sparkSession, None
    source = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    for index in indexes(items, most_bytes):
        shared = spark.sparkContext.broadcast(index)

        def search(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches(rows, "text"):
                names = batch.column(0).to_pylist()
                out = [
                    (names[t], index.ids[i], start, score, question, answer)
                    for t, i, start, score, question, answer in index.hits([words_of(x) for x in bytes_of(batch.column(1))], rules)
                ]
                if out:
                    kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                        ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"],
                    )

        hits = written(source.mapInArrow(search, HITS), "leaks")
        found = hits if found is None else found.unionByName(hits)
    best = F.max_by(F.struct("passage", "score", "question_overlap", "answer_overlap"), F.struct("score", -F.col("passage")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best"), F.count(F.lit(1)).alias("n_passages")).select(
        "doc_id", "item_id", "best.*", "n_passages"
    )


def clean_documents(docs: DataFrame, items: DataFrame, rules: Rules = Rules(), most_bytes: int = 16 << 20) -> DataFrame:
    """The rows of `docs`, all columns, in which no item was verified; rows are judged where they are read."""
    spark, column = docs.sparkSession, docs.columns.index("text")
    for index in indexes(items, most_bytes):
        shared = spark.sparkContext.broadcast(index)

        def keep(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches(rows, "text"):
                bad = {t for t, *_ in index.hits([words_of(x) for x in bytes_of(batch.column(column))], rules)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
