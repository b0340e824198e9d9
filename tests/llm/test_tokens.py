"""Bit-packed output and power-of-two packing: exact round trips."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newswatch.llm import packing, token_output
from newswatch.llm.common import WordIds, batches, bytes_of, written
from newswatch.session import BATCH_BYTES


@pytest.fixture(scope="module")
def encoded(rows, word_tokenizer):
    tokenizer = Tokenizer.from_file(word_tokenizer)
    return [(d, t or "", np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t in rows]


def test_word_store_equals_the_library(word_tokenizer):
    tokenizer, store, rnd = Tokenizer.from_file(word_tokenizer), WordIds(word_tokenizer, room=500), random.Random(7)
    pool = [*"aAbZ é É ß \t\n'\".,!*#_-09K", "\x85", "\x1c", "́", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "IT'S,", "a***", "x'."]
    for _ in range(1500):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30)))
        assert store.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("width", [1, 5, 8, 11, 16, 17, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 70_003, dtype=np.uint64).astype(np.uint32)
    packed = token_output.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert (token_output.unpack(packed, width, 0, len(ids)) == ids).all()
    assert (token_output.unpack(packed, width, 12_345, 69_999) == ids[12_345:69_999]).all()
    assert len(token_output.unpack(packed, width, 5, 5)) == 0


def test_width():
    assert [token_output.width_of(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def test_files_hold_every_document_in_order(docs, encoded, word_tokenizer):
    files = token_output.write(docs, word_tokenizer, 49_408, 2, block_ids=5000)
    got = [tuple(r) for r in token_output.read_documents(files).collect()]
    want, start = [], 0
    for d, _, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0], x[1].encode())):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(got, key=key) == want
    every = np.concatenate([ids for _, _, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0], x[1].encode()))])
    part = sorted(token_output.read_range(files, 7000, 19_000).collect())
    assert part[0].place == 7000
    assert [i for r in part for i in r.ids] == every[7000:19_000].tolist()


def test_pieces_are_powers_of_two_and_hold_each_id_once(docs, encoded, word_tokenizer):
    got = packing.digests(packing.pack(docs, word_tokenizer, 2, longest=512)).collect()
    assert sorted(p.sequence_id for p in got) == list(range(len(got)))
    want = sorted(
        (str(d), start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids))
        for d, _, ids in encoded
        for start, n in packing.decompose(len(ids), 512)
    )
    assert sorted((str(p.doc_id), p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got) == want
    assert all(p.length <= 512 and p.length & (p.length - 1) == 0 and p.offset == 0 for p in got)


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 4097])
def test_decomposition_covers_without_overlap(n):
    at = 0
    for start, length in packing.decompose(n, 512):
        assert start == at
        at += length
    assert at == n


def test_batches_are_cut_without_copying_their_texts():
    texts = ["é" * 500_000, None, "", *["x" * 40_000] * 200]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    cut = list(batches(iter([batch]), "text", 1 << 20))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1 << 20  # the texts have nine times as much
    assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
    assert all(sum(map(len, bytes_of(b.column(1)))) <= 1 << 20 for b in cut)


def test_a_session_without_a_batch_size_gets_small_batches(spark):
    def sizes(rows):
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    own = spark.conf.get(BATCH_BYTES)
    try:
        spark.conf.unset(BATCH_BYTES)
        found = [r.n for r in written(docs.mapInArrow(sizes, "n long"), "batch-sizes").collect()]
        spark.conf.set(BATCH_BYTES, "8m")
        written(docs, "batch-rows")
        assert spark.conf.get(BATCH_BYTES) == "8m"  # a size that is named stays
    finally:
        spark.conf.set(BATCH_BYTES, own)
    assert sum(found) > 20_000_000
    assert max(found) < 4 << 20
