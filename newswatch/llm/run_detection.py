"""Periodic runs of words, found on a grammar: Re-Pair, boundaries of nonterminals, derivation positions.

A run is a longest stretch of consecutive words with smallest period q (words q apart are equal)
and at least max(6, 4 q) words.

1. The words of a batch of whole documents become numbers and one grammar by Re-Pair. A round replaces
   every pair that is more frequent than the pairs it overlaps (the most frequent pair is
   always one of them; ties by a mixed number), until no pair is met twice. What is left of each document
   is joined two by two to one symbol.
2. A run that lies in the derivation crosses the boundary between the two sides of exactly one
   lowest nonterminal. So each nonterminal is looked at once, in its first place, for all periods:
   a run of period q over the boundary m holds one of the stretches of 3 q words that start at m - 3 q,
   m - 2 q, m - q or m. Those are compared by prefix hashes and stretched within the nonterminal.
3. The runs found are moved to all places where their nonterminal is derived, and of those with
   one period that lie in each other the longest stays. Every run is then compared word by word; if a hash had
   been wrong, the batch is done again with another base, so results are exact.

A task holds one batch of documents (about two megabytes of text, or one longer document); nothing is shuffled.

Defined results: null and empty texts and those without words have no runs and an empty collapsed
text; repeated rows and rows without an id are each treated alone; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswatch.llm.common import batches, bytes_of, text_of

LEAST_WORDS, LEAST_PERIODS = 6, 4
PRIME = (1 << 31) - 1  # products of two rests fit into 63 bits
AT_ONCE = 1 << 20  # boundaries times periods compared at a time
BATCH_BYTES = 2 << 20
RUNS = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


@dataclass
class Grammar:
    """Binary rules and where they are derived; symbols below `n_words` are words."""

    n_words: int
    left: np.ndarray  # sides of each rule
    right: np.ndarray
    length: np.ndarray  # words that each symbol, words included, stands for
    rule: np.ndarray  # of each derivation of a rule, which one and where it starts
    place: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers in no particular order: pairs that are equally frequent are taken by these."""
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64)


def re_pair(words: np.ndarray, first: np.ndarray) -> Grammar:
    """A grammar of the documents whose words stand in `words`; `first` marks the first word of each."""
    n_words = int(words.max()) + 1 if len(words) else 0
    lengths, lefts, rights = [np.ones(n_words, np.int64)], [], []
    rules, places = [], []
    symbol, place = words.astype(np.int64), np.arange(len(words))
    n_symbols = n_words

    def replaced(at: np.ndarray, of: np.ndarray, pairs: int, example: np.ndarray) -> None:
        """Put new symbols where the pairs at `at` start; pair number `of` is like the one at `example`."""
        nonlocal symbol, place, n_symbols
        every = np.concatenate(lengths) if len(lengths) > 1 else lengths[0]
        lengths[:] = [every, every[symbol[example]] + every[symbol[example + 1]]]
        lefts.append(symbol[example])
        rights.append(symbol[example + 1])
        rules.append(n_symbols - n_words + of)
        places.append(place[at])
        symbol = symbol.copy()
        symbol[at] = n_symbols + of
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        symbol, place = symbol[stays], place[stays]
        n_symbols += pairs

    while len(symbol) > 1:
        inside = ~first[place[1:]]
        code, _ = pd.factorize(symbol[:-1] * n_symbols + symbol[1:])
        count = np.bincount(code[inside], minlength=1)
        met = np.where(inside, count[np.minimum(code, len(count) - 1)], 0)
        if met.max(initial=0) < 2:
            break
        # A place's weight; equal neighbours are the same pair, which overlaps itself.
        weight = np.where(met > 1, (met << 41) | mixed(code), -1)
        change = np.flatnonzero(unlike_before(weight))
        value = weight[change]
        peak = (value >= 0) & (value > np.concatenate([[-2], value[:-1]])) & (value > np.concatenate([value[1:], [-2]]))
        size = np.diff(np.concatenate([change, [len(weight)]]))
        offset = np.arange(len(weight)) - np.repeat(change, size)
        at = np.flatnonzero(np.repeat(peak, size) & (offset % 2 == 0))
        of, known = pd.factorize(code[at])
        example = np.empty(len(known), np.int64)
        example[of[::-1]] = at[::-1]
        replaced(at, of, len(known), example)

    while len(symbol) > 1:
        starts = np.flatnonzero(first[place])
        size = np.diff(np.concatenate([starts, [len(symbol)]]))
        offset = np.arange(len(symbol)) - np.repeat(starts, size)
        at = np.flatnonzero((offset % 2 == 0) & (offset + 1 < np.repeat(size, size)))
        if not len(at):
            break
        replaced(at, np.arange(len(at)), len(at), at)

    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Grammar(n_words, joined(lefts), joined(rights), joined(lengths), joined(rules), joined(places))


class Compare:
    """Equality of stretches of words by prefix sums of powers, modulo a prime."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        self.power = np.ones(n + 1, np.int64)
        filled, step = 1, base
        while filled <= n:
            some = min(filled, n + 1 - filled)
            self.power[filled : filled + some] = self.power[:some] * step % PRIME
            filled, step = filled * 2, step * step % PRIME
        self.sums = np.concatenate([[0], np.cumsum((words.astype(np.int64) + 1) * self.power[:n] % PRIME)])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` words from a on equal those from b on; a < b."""
        one = (self.sums[a + size] - self.sums[a]) % PRIME
        two = (self.sums[b + size] - self.sums[b]) % PRIME
        return one * self.power[b - a] % PRIME == two

    def reach(self, a: np.ndarray, q: np.ndarray, most: np.ndarray, sign: int) -> np.ndarray:
        """How many words beyond a (on, or back for sign -1) equal those q further, `most` at most."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            half = (low + high + 1) // 2
            from_ = a if sign > 0 else a - half
            same = self.equal(from_, from_ + q, half)
            low, high = np.where(open_ & same, half, low), np.where(open_ & ~same, half - 1, high)
        return low


def unlike_before(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def longest(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which intervals lie in no other one of their key; of equal ones the first."""
    order = np.lexsort((-end, start, key))
    key, end = key[order], end[order]
    span = int(end.max(initial=0)) + 1
    rank = np.cumsum(unlike_before(key))
    reached = rank * span + end
    before = np.concatenate([[-1], np.maximum.accumulate(reached)])[: len(key)]
    return order[(before // span != rank) | (before < reached)]


def boundary_runs(words: np.ndarray, g: Grammar, start: np.ndarray, compare: Compare) -> tuple[np.ndarray, ...]:
    """Rules and the runs over their boundary, within them: rule, start from the rule's start, length, period."""
    size = g.length[g.n_words :]
    rule = np.flatnonzero(size >= LEAST_WORDS)
    found: list[tuple[np.ndarray, ...]] = []
    most = size[rule] // LEAST_PERIODS
    done = np.concatenate([[0], np.cumsum(most)])
    cuts = np.searchsorted(done, np.arange(0, int(done[-1]) + AT_ONCE, AT_ONCE), "left").clip(max=len(rule))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        x = np.repeat(rule[a:b], most[a:b])
        q = np.arange(len(x)) - np.repeat(done[a:b] - done[a], most[a:b]) + 1
        low = start[x]
        high, middle = low + size[x], low + g.length[g.left[x]]
        for back in (3, 2, 1, 0):
            c = middle - back * q
            some = np.flatnonzero((c >= low) & (c + 3 * q <= high))
            some = some[words[c[some]] == words[c[some] + q[some]]]
            some = some[compare.equal(c[some], c[some] + q[some], 2 * q[some])]
            if not len(some):
                continue
            c, p, lo, hi = c[some], q[some], low[some], high[some]
            left = c - compare.reach(c, p, c - lo, -1)
            right = c + 3 * p + compare.reach(c + 2 * p, p, hi - c - 3 * p, 1)
            long = right - left >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
            found.append((x[some][long], (left - lo)[long], (right - left)[long], p[long]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    x, offset, length, q = (np.concatenate(c) for c in zip(*found, strict=True))
    # The same stretch with a multiple of its period, or met from two stretches: the smallest period stays.
    order = np.lexsort((q, length, offset, x))
    x, offset, length, q = x[order], offset[order], length[order], q[order]
    new = unlike_before(x, offset, length)
    return x[new], offset[new], length[new], q[new]


def runs_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of a batch of documents, by start, then period."""
    g = re_pair(words, first)
    start = np.zeros(len(g.left), np.int64)
    start[g.rule[::-1]] = g.place[::-1]  # one place of each rule stands for all
    order = np.argsort(g.rule, kind="stable")
    place, n_places = g.place[order], np.bincount(g.rule, minlength=len(g.left))
    first_place = np.cumsum(n_places) - n_places
    rng = np.random.default_rng(len(words))
    while True:
        compare = Compare(words, int(rng.integers(1 << 20, PRIME - 1)))
        x, offset, length, q = boundary_runs(words, g, start, compare)
        times = n_places[x]
        which = np.repeat(first_place[x] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        at, length, q = place[which] + np.repeat(offset, times), np.repeat(length, times), np.repeat(q, times)
        best = longest(q, at, at + length)
        at, length, q = at[best], length[best], q[best]
        # The smallest period of a stretch.
        order = np.lexsort((q, length, at))
        at, length, q = at[order], length[order], q[order]
        new = unlike_before(at, length)
        at, length, q = at[new], length[new], q[new]
        pairs = length - q
        i = np.repeat(at - (np.cumsum(pairs) - pairs), pairs) + np.arange(int(pairs.sum()))
        if (words[i] == words[i + np.repeat(q, pairs)]).all():
            order = np.lexsort((q, at))
            return at[order], length[order], q[order]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of every row of `docs` (doc_id, text).

    The collapsed text keeps of each run its first period: a word is left out if any run holds it
    behind that run's first q words. The words that stay are joined by one space.
    """

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text", BATCH_BYTES):
            split = [t.split() for t in bytes_of(batch.column(1))]
            n = np.array([len(w) for w in split], np.int64)
            begin = np.cumsum(n) - n
            every = [w for words in split for w in words]
            words = pd.factorize(np.array(every, object))[0] if every else np.zeros(0, np.int64)
            first = np.zeros(len(every), bool)
            first[begin[n > 0]] = True
            at, length, period = runs_of(words, first)
            gone = np.zeros(len(every) + 1, np.int64)
            np.add.at(gone, at + period, 1)
            np.add.at(gone, at + length, -1)
            gone = np.cumsum(gone)[:-1] > 0
            owner = np.searchsorted(begin, at, "right") - 1  # empty documents end where the next begins
            bounds = np.searchsorted(owner, np.arange(len(split) + 1))
            cut = np.concatenate([[0], np.cumsum(gone)])
            collapsed = []
            for d, own in enumerate(split):
                a = begin[d]
                if cut[a + len(own)] > cut[a]:
                    own = [w for w, g in zip(own, gone[a : a + len(own)].tolist(), strict=True) if not g]
                collapsed.append(b" ".join(own))
            run = pa.StructArray.from_arrays([pa.array(at - begin[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), run), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(find, RUNS)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, then the smallest start, then period; null without runs."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")

    def better(best: Column, run: Column) -> Column:
        greater = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | greater, run).otherwise(best)  # runs come by start, then period

    return F.aggregate(runs, none, better)
