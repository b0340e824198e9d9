"""What several training-data operators share: reading tables, scratch tables, word ids."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswatch.session import scratch_path, use_small_batches

# The separators of a word: the ASCII white space characters.
SPACES = " \t\n\x0b\x0c\r"
# A word that ends with an ASCII letter or digit and signs behind it (no apostrophe, which may belong to a word).
SIGNS_BEHIND = re.compile(rb"(.*[a-z0-9])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """`df` as a table in the shared folder: lineage is cut, and lost executors lose nothing."""
    use_small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def running_offsets(spark: SparkSession, totals: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`, the sum of `value` over the rows before, to a table of one row per partition.

    The table has as many rows as the job has partitions (times a constant), so
    one window without keys is bounded.
    """
    from pyspark.sql import Window

    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


# A comma or stop before white space that does not follow a Latin letter or a digit.
UNUSUAL = re.compile(rb"[,.](?<![A-Za-z0-9].)(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].)(?=[ \n])")


def simplified(text: bytes) -> bytes:
    """A text with the same ids and fewer different words: lower case, commas and stops on their own.

    Special tokens are matched as they are written, and signs next to each other are one
    piece; a text that may have either stays as it is (but for its case).
    """
    if b"<|" in text:
        return text
    text = text.lower()  # ASCII letters only
    if UNUSUAL.search(text):
        return text
    return text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b",\n", b" ,\n").replace(b".\n", b" .\n")


class Numbers(dict):
    """Numbers keys from 0 as they are met."""

    def __missing__(self, key: object) -> int:
        self[key] = n = len(self)
        return n


class WordIds:
    """Ids of whole texts by a tokenizer that never joins text across white space.

    Texts are cut at ASCII white space; the distinct words of a batch are looked up, each new one is
    encoded once by the tokenizers library and kept; the ids of a text are those of its words. The
    store is emptied when it holds `room` words, which changes nothing but speed.
    """

    def __init__(self, path: str, room: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.room = room
        self._clear()

    def _clear(self) -> None:
        # A word's number; where its ids start and how many there are; ids. A whole number stands for itself.
        self.known = Numbers()
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _store(self, numbers: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.size[numbers] = sizes
        self.first[numbers] = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, flat])

    def _learn(self, words: list[bytes | int]) -> None:
        """Encode words that have numbers but no ids yet; of one in upper case or with signs behind, only its parts."""
        whole, made = [], []
        for w in words:
            if isinstance(w, int) or b"<|" in w:  # special tokens are matched as they are written
                whole.append(w)
                continue
            m = SIGNS_BEHIND.fullmatch(plain := w.lower())
            parts = m.groups() if m else (plain,)
            if parts == (w,):
                whole.append(w)
            else:
                made.append((w, parts))
        done = len(self.first)
        at = np.fromiter((self.known[p] for _, own in made for p in own), np.int64)
        whole.extend(dict.fromkeys(p for _, own in made for p in own if self.known[p] >= done + len(words)))
        new = np.zeros(len(self.known) - done, np.int64)
        self.first, self.size = np.concatenate([self.first, new]), np.concatenate([self.size, new])
        texts = [w for w in whole if not isinstance(w, int)]
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in texts], add_special_tokens=False)
        lists = [e.ids for e in encoded] + [[w] for w in whole if isinstance(w, int)]
        order = texts + [w for w in whole if isinstance(w, int)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self._store(np.fromiter(map(self.known.__getitem__, order), np.int64, len(order)), sizes, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())))
        if made:
            n_parts = np.fromiter((len(own) for _, own in made), np.int64, len(made))
            flat, each = self._gather(at)
            numbers = np.fromiter((self.known[w] for w, _ in made), np.int64, len(made))
            self._store(numbers, np.add.reduceat(each, np.cumsum(n_parts) - n_parts), flat)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stored words one after another, and how many each has."""
        first, lengths = self.first[at], self.size[at]
        total, before = int(lengths.sum()), np.cumsum(lengths) - lengths
        return self.ids[np.arange(total) + np.repeat(first - before, lengths)], lengths

    def encode(self, texts: list[bytes], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers, with `end` after them if given."""
        split: list[list] = [simplified(t).split() for t in texts]
        if end is not None:
            for words in split:
                words.append(end)
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        # The words of the batch are numbered among themselves first: its distinct ones are few.
        local = Numbers()
        at = np.fromiter(map(local.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        if len(self.known) > self.room:
            self._clear()
        done = len(self.known)
        number = np.fromiter(map(self.known.__getitem__, local), np.int64, len(local))
        if len(self.known) > done:
            self._learn([w for w, n in zip(local, number.tolist(), strict=True) if n >= done])
        flat, each = self._gather(number[at])
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(n_words)])]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    """The store of this Python worker: the tasks that it runs one after another share it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def batches(rows: Iterator[pa.RecordBatch], texts: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text column of each holds about `most_bytes`, one row at least.

    What Arrow keeps of the batches before is given back, as a worker lives for many tasks.
    """
    for batch in rows:
        column = batch.column(batch.schema.get_field_index(texts))
        if not batch.num_rows:
            continue
        if column.nbytes <= most_bytes:
            yield batch
        else:
            start, held = 0, 0
            for k, size in enumerate(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()):
                if held and held + size > most_bytes:
                    yield batch.slice(start, k - start)
                    start, held = k, 0
                held += size
            yield batch.slice(start)
        del batch, column
        pa.default_memory_pool().release_unused()
