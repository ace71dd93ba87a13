import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanery.llm import token_files as tf

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


ODD = ["a", "Z", "é", "日", "9", "٣", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", " ", "'", "'s", "'ll", ".", ",", "-", "_", "<|endoftext|>", "😀", "́", "\x00", "!"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=25).map("".join), min_size=1, max_size=4))
def test_ids_are_the_tokenizers(texts):
    t = _tokenizer()
    raw = [x.encode() for x in texts]
    ids, ends = tf.token_ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), _pieces(), 0)
    got = [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:])]
    assert got == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]


def _tokenizer(held=[]):  # noqa: B006
    if not held:
        held.append(Tokenizer.from_file(FILE))
        held[0].encode_special_tokens = True
    return held[0]


def _pieces(held=[]):  # noqa: B006
    if not held:
        held.append(tf.Pieces(FILE, 50))  # full now and then
    return held[0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 300), st.integers(1, 40), st.integers(1, 5), st.integers(0, 2**32))
def test_blocks_round_trip(n, kinds, lanes, every, seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.geometric(0.1, n), kinds).astype(np.uint32) * 7
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    table = tf.Table(symbols, tf.scaled(counts[symbols], 12))
    assert table.frequency.sum() == 1 << table.bits and (table.frequency[symbols] > 0).all()
    block = tf.encode_block(ids, table, lanes, every)
    assert (tf.decode_block(block, table) == ids).all()
    first, last = sorted(rng.integers(0, n + 1, 2).tolist())
    assert (tf.decode_block(block, table, first, last) == ids[first:last]).all()
    broken = bytearray(block)
    broken[rng.integers(len(block))] ^= 1
    with pytest.raises(ValueError):
        tf.decode_block(bytes(broken), table)


def expected(rows, t):
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_all_documents_in_order(spark, tmp_path, tokenizer, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdé日", k=rng.randint(1, 9)))
    rows = [(7 * i % 1000 - 300, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(250)]
    rows += [(5000, None), (5001, ""), (5002, "!" * 50), (5003, " ".join(word() for _ in range(40_000)))] + [(6000, "the same row")] * 40
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, ids string").repartition(5)
    monkeypatch.setattr(tf, "FRAME", 1000)
    monkeypatch.setattr(tf, "BLOCK", 300)
    tf.write_token_files(docs, f"{tmp_path}/t", FILE, shard=4000)
    got = tf.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    want = expected(rows, tokenizer)
    assert [tuple(r)[:4] for r in got] == want
    assert [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got] == [w[3] for w in want]
    frames = spark.read.parquet(f"{tmp_path}/t/frames").select("shard", "frame", "lengths").collect()
    assert len({r.shard for r in frames}) > 5 and max(len(r.lengths) for r in frames) > 1


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tf.write_token_files(docs, f"{tmp_path}/e", FILE)
    assert tf.read_token_files(spark, f"{tmp_path}/e").count() == 0


def test_query_on_nulls(spark, tokenizer):
    docs = spark.createDataFrame([(3, "b c"), (1, None), (2, "a")], "doc_id long, text string")
    assert sorted(map(tuple, tf.op11_token_files(docs).collect())) == expected([(3, "b c"), (1, None), (2, "a")], tokenizer)
