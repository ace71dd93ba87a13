"""Token ids in binary files: interleaved static range ANS blocks.

``write_token_files`` tokenizes whole texts, appends ``end_id`` to each, puts the
documents in ascending order of id and writes two tables of Parquet files:

``symbols``  (symbol int, frequency long): the frequency table that all blocks
             share; frequencies sum to a power of two and each symbol that occurs
             has one at least.
``frames``   (shard int, frame int, before long, doc_ids array, lengths
             array<long>, blocks array<binary>): whole documents in order, about
             ``FRAME`` ids in a row.  Rows are ordered by (shard, frame);
             ``before`` is the number of ids of the shard before the row.

A block codes ``BLOCK`` ids and is independent of all others.  Its bytes, little-endian:

    magic "RNS1", ids, lanes, steps between checkpoints, words, crc32 of the ids
    as unsigned 32-bit integers (five unsigned 32-bit integers after the magic);
    for each checkpoint the number of words read before it (32 bits) and the
    state of each lane (64 bits); the words (32 bits); crc32 of all before.

Id i of a block belongs to lane i mod ``lanes`` and is decoded in step i div
``lanes``; states lie in [2^31, 2^63) and read one word when they fall below.
A checkpoint holds all that is needed to begin there, so that ids from the
middle of a block are decoded without those before (``decode_block``).

Frequencies need all ids first: ids are written once to the shared folder,
counted, dealt to shards by range of id, and coded there.  Every later reader
starts from files.  Texts are split at places where no token can span, each
distinct piece is tokenized once a worker, as long as the worker's table of at
most ``CACHE`` pieces has room.

Cases: null and empty texts have the end id alone; repeated rows are coded each;
rows of equal id come in any order among each other, so that with different texts
under one id their starts may swap; null ids come first; an empty table gives
empty files; a long text stays in one row, in several blocks; other columns aren't
read, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import mixed
from .buffers import binaries, flat, slices
from .common import shared_folder, written

#: Bytes of texts worked on at a time.
SLICE = 2 << 20
#: Pieces that are encoded as one text.
JOINED = 512
#: Pieces of texts whose ids a worker keeps.
CACHE = 1 << 19
#: Sum of the frequencies, as a power of two; larger where the vocabulary needs it.
BITS = 20
LANES = 2048
BLOCK = 1 << 19
#: Steps of a block from one checkpoint to the next.
CHECKPOINT = 128
FRAME = 1 << 20
#: Ids of a shard; there are at most 2^16 shards.
SHARD = 1 << 22
_LOW = np.uint64(1 << 31)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_HEAD = struct.Struct("<4s5I")


# Tokenizing


def _classes() -> np.ndarray:
    """Byte -> 0 other ASCII, 1 letter, 2 digit, 3 white space, 4 no ASCII, or a control character that some engines take for white space."""
    kinds = np.zeros(256, np.uint8)
    for c in range(128):
        kinds[c] = 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 if c == 32 or 9 <= c <= 13 else 4 if 28 <= c <= 31 else 0
    kinds[128:] = 4
    return kinds


_CLASS = _classes()


def safe_cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of UTF-8 ``data`` at which a text may be cut without any change of its ids: all of ``starts``, and some between.

    A byte-level tokenizer's pieces have white space at their beginning only, and letters and digits in runs of their own.
    So a cut is safe before white space, unless white space comes before, and after a letter or digit before ASCII of another kind.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    left, right = kind[:-1], kind[1:]
    cut = (left != right) & (((right == 3) & (left < 3)) | (((left == 1) | (left == 2)) & (right < 4)))
    cut = np.concatenate(([True], cut))
    # white space after a character of several bytes, unless that may be white space (its lead byte is C2, E1, E2 or E3)
    wide = np.flatnonzero((left == 4) & (right == 3) & (data[:-1] >= 0x80)) + 1
    second, third = data[np.maximum(wide - 2, 0)], data[np.maximum(wide - 3, 0)]
    cut[wide[~((second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3)))]] = True
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class Pieces:
    """Ids of pieces of texts, each encoded once as long as there is room."""

    def __init__(self, file: str, most: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a character of its name is a byte
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.most, self.known = most, pa.array([], pa.binary())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.powers, self.inverse = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and their ``len + 1`` offsets.

        Pieces that begin with white space and end with none are encoded as one text, as a cut between any two is safe, and
        taken apart by the bytes of each id.  The others are encoded one by one.
        """
        data, at = flat(pieces)
        before, behind = data[np.maximum(at[1:] - 2, 0)], data[np.maximum(at[1:] - 3, 0)]
        last = data[at[1:] - 1]
        ends_well = (_CLASS[last] < 3) | ((last >= 0x80) & (before != 0xC2) & ~((behind >= 0xE1) & (behind <= 0xE3)))
        joins = (_CLASS[data[at[:-1]]] == 3) & ends_well & (np.diff(at) > 1)
        sizes = np.zeros(len(pieces), np.int64)
        found = []
        for rows, step in ((np.flatnonzero(joins), JOINED), (np.flatnonzero(~joins), 1)):
            some, marks = flat(pieces.take(pa.array(rows)))
            raw, cuts = some.tobytes(), np.append(np.arange(0, len(rows), step), len(rows))
            texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(marks[cuts[:-1]].tolist(), marks[cuts[1:]].tolist())]
            ids = [e.ids for k in range(0, len(texts), 32) for e in self.tokenizer.encode_batch_fast(texts[k : k + 32], add_special_tokens=False)]
            own = np.fromiter(chain.from_iterable(ids), np.uint32)
            if step == 1:
                sizes[rows] = list(map(len, ids))
            else:
                sizes[rows] = np.diff(np.searchsorted(np.cumsum(self.sizes[own]), marks[1:]) + 1, prepend=0)
            found.append((rows, own))
        order = np.argsort(np.concatenate([r for r, _ in found]), kind="stable")
        all_ids = np.concatenate([i for _, i in found])
        own = np.concatenate([sizes[r] for r, _ in found])
        begin = np.cumsum(own) - own
        return gathered(all_ids, begin[order], own[order])

    def lookup(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the (distinct) pieces, and the ``len + 1`` offsets of each piece's."""
        h = self.hashes_of(*flat(pieces))
        at = np.full(len(pieces), -1)
        if len(self.hashes):
            near = np.searchsorted(self.hashes, h).clip(max=len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[near] == h)
            row = self.rows[near[hit]]
            same = pc.equal(self.known.take(pa.array(row)), pieces.take(pa.array(hit))).to_numpy(zero_copy_only=False)  # a hash is no proof
            at[hit[same]] = row[same]
        new = np.flatnonzero(at < 0)
        ids, ends = self.ids, self.ends
        if len(new):
            fresh = pieces.take(pa.array(new))
            some, marks = self.encode(fresh)
            at[new] = len(self.known) + np.arange(len(new))
            ids, ends = np.concatenate([ids, some]), np.concatenate([ends, ends[-1] + marks[1:]])
            if len(self.known) + len(new) <= self.most:
                order = np.argsort(h[new])
                place = np.searchsorted(self.hashes, h[new][order])
                self.hashes, self.rows = np.insert(self.hashes, place, h[new][order]), np.insert(self.rows, place, at[new][order])
                self.known, self.ids, self.ends = pa.concat_arrays([self.known, fresh]), ids, ends
        return gathered(ids, ends[at], ends[at + 1] - ends[at])

    def hashes_of(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each piece, from running sums of its bytes times powers of an odd number."""
        if len(self.powers) < len(data):
            self.powers, self.inverse = (np.cumprod(np.full(2 * len(data), f, np.uint64)) for f in (_FACTOR, _INVERSE))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)])))
        return mixed((sums[at[1:]] - sums[at[:-1]]) * self.inverse[at[:-1]] + np.diff(at).astype(np.uint64))


def gathered(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated runs of ``values``, and their offsets in it."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    place = np.repeat(begin - ends[:-1], sizes)
    place += np.arange(ends[-1])
    return values[place], ends


_WORKER: dict[str, Pieces] = {}


def token_ids(data: np.ndarray, offsets: np.ndarray, pieces: Pieces, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with ``end_id`` behind, and their ``len + 1`` offsets."""
    cuts = safe_cuts(data, offsets[:-1])
    coded = binaries(data, np.append(cuts, len(data))).dictionary_encode()
    held, ends = pieces.lookup(coded.dictionary.cast(pa.binary()))
    which = coded.indices.to_numpy()
    ids, run = gathered(held, ends[which], ends[which + 1] - ends[which])
    texts = run[np.searchsorted(cuts, offsets)]  # ids before each text
    out = np.full(len(ids) + len(offsets) - 1, end_id, np.uint32)
    place = np.repeat(np.arange(len(texts) - 1), np.diff(texts))
    place += np.arange(len(ids))
    out[place] = ids
    return out, texts + np.arange(len(texts))


def tokens(docs: DataFrame, file: str, end_id: int, cache: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids): ids as bytes of the narrowest unsigned type, 16 bits for vocabularies up to 65536."""
    width = id_width(file, end_id)

    def run(batches):
        if file not in _WORKER:
            _WORKER.clear()
            _WORKER[file] = Pieces(file, cache)
        for b in slices(batches, "t", SLICE):
            ids, ends = token_ids(*flat(b.column("t")), _WORKER[file], end_id)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), binaries(ids.astype(width).view(np.uint8), ends * np.dtype(width).itemsize).cast(pa.binary())], names=["doc_id", "ids"])
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def id_width(file: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(file).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


# Coding


class Table:
    """The shared frequencies: symbols in ascending order, frequency and sum of those before, by symbol."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray):
        self.bits = int(frequencies.sum()).bit_length() - 1 if len(frequencies) else 0
        size = int(symbols[-1]) + 1 if len(symbols) else 0
        self.frequency, self.below = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.frequency[symbols] = frequencies
        self.below[symbols] = np.cumsum(frequencies) - frequencies
        self.symbol = np.repeat(symbols.astype(np.uint32), frequencies)


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to 2^bits, or to a larger power where there are too many symbols, each 1 at least, near the shares of ``counts``."""
    bits = max(bits, len(counts).bit_length() + 2)
    room = (1 << bits) - len(counts)
    out = np.maximum(1, np.floor(counts / counts.sum() * room)).astype(np.int64)
    out[np.argmax(counts)] += (1 << bits) - out.sum()
    return out


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """One block; ``ids`` isn't empty."""
    lanes = min(lanes, len(ids))
    steps = -(-len(ids) // lanes)
    states, words, marks = np.full(lanes, _LOW, np.uint64), [], []
    shift, wide = np.uint64(table.bits), np.uint64(32)
    places, limit = ids.astype(np.int64), np.uint64(63 - table.bits)
    freq, below = table.frequency[places], table.below[places]
    for t in range(steps - 1, -1, -1):
        s = slice(t * lanes, (t + 1) * lanes)
        f = freq[s]
        x = states[: len(f)]
        full = np.flatnonzero((x >> limit) >= f)
        if len(full):
            high = x[full]
            words.append(high.astype("<u4"))  # the lower half
            x[full] = high >> wide
        q = x // f
        states[: len(f)] = (q << shift) + (x - q * f) + below[s]
        if t % every == 0:
            marks.append((sum(map(len, words[marks[-1][2] :] if marks else words)), states.astype("<u8").tobytes(), len(words)))
    total = sum(map(len, words))
    held, read = [], total
    for n, state, _ in marks:  # from the last checkpoint to the first: words that are read after it
        read -= n
        held.append(struct.pack("<I", read) + state)
    body = b"".join([_HEAD.pack(b"RNS1", len(ids), lanes, every, total, zlib.crc32(ids.astype("<u4").tobytes())), *reversed(held), *[w.tobytes() for w in reversed(words)]])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (all, if none are given) of a block, from the nearest checkpoint before; damage raises ValueError."""
    if len(block) < _HEAD.size + 4 or zlib.crc32(memoryview(block)[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    magic, n, lanes, every, n_words, crc = _HEAD.unpack_from(block)
    if magic != b"RNS1":
        raise ValueError("not a block")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    steps, size = -(-n // lanes), 4 + 8 * lanes
    n_marks = -(-steps // every)
    mark = first // lanes // every
    at = _HEAD.size + mark * size
    read = struct.unpack_from("<I", block, at)[0]
    states = np.frombuffer(block, "<u8", lanes, at + 4).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, _HEAD.size + n_marks * size).astype(np.uint64)
    shift, wide, below = np.uint64(table.bits), np.uint64(32), np.uint64((1 << table.bits) - 1)
    begin, end = mark * every, -(-last // lanes)
    out = np.empty((end - begin) * lanes, np.uint32)
    for t in range(begin, end):
        x = states[: min(lanes, n - t * lanes)]
        slot = x & below
        s = table.symbol[slot.view(np.int64)].astype(np.int64)  # signed places are gathered faster
        out[(t - begin) * lanes : (t - begin) * lanes + len(s)] = s
        x = table.frequency[s] * (x >> shift) + slot - table.below[s]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << wide) | words[read : read + len(low)]
            read += len(low)
        states[: len(s)] = x
    ids = out[first - begin * lanes : last - begin * lanes]
    if first == 0 and last == n and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("ids differ from their checksum")
    return ids


# Files


def count_symbols(coded: DataFrame, width: str) -> DataFrame:
    """(symbol, n) of all ids; a task emits each symbol once a batch."""

    def run(batches):
        for b in batches:
            data, _ = flat(b.column(0))
            n = np.bincount(data.view(width))
            symbols = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(symbols.astype(np.int32)), pa.array(n[symbols].astype(np.int64))], names=["symbol", "n"])

    return coded.select("ids").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def _table(rows) -> Table:
    rows = sorted(map(tuple, rows))
    return Table(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))


def write_token_files(docs: DataFrame, path: str, file: str, end_id: int = 0, cache: int = CACHE, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Files of all of ``docs`` under ``path``; ``file`` is the tokenizer's."""
    spark = docs.sparkSession
    coded = written(tokens(docs, file, end_id, cache, id_col, text_col).withColumn("k", F.monotonically_increasing_id()), "token-ids")
    width = id_width(file, end_id)
    counts = sorted(map(tuple, count_symbols(coded, width).collect()))  # no more rows than the vocabulary has
    n = np.array([c for _, c in counts], np.int64)
    frequency = scaled(n, BITS) if len(n) else n
    symbols = np.array([s for s, _ in counts], np.int64)
    spark.createDataFrame(list(zip(symbols.tolist(), frequency.tolist())), "symbol int, frequency long").coalesce(1).write.parquet(f"{path}/symbols")
    table = spark.sparkContext.broadcast((symbols, frequency))
    shards = min(1 << 16, max(1, -(-int(n.sum()) // shard)))

    def run(batches):
        from pyspark import TaskContext

        coder, part, frame, before = None, TaskContext.get().partitionId(), 0, 0
        held_docs, held_ids, held = [], [], 0

        def row():
            ids = np.concatenate(held_ids)
            blocks = [encode_block(ids[i : i + BLOCK], coder) for i in range(0, len(ids), BLOCK)]
            docs_, lengths = pa.concat_arrays([d for d, _ in held_docs]), np.concatenate([m for _, m in held_docs])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([before], pa.int64()), one(docs_), one(pa.array(lengths)), one(pa.array(blocks, pa.binary()))], names=["shard", "frame", "before", "doc_ids", "lengths", "blocks"])

        for b in batches:
            coder = coder or Table(*table.value)
            data, at = flat(b.column("ids"))
            ids, ends = data.view(width).astype(np.uint32), at // np.dtype(width).itemsize
            begin = 0
            while begin < b.num_rows:  # whole documents, as many as fill the row
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + FRAME - held, side="right")) - 1)
                held_docs.append((b.column("doc_id").slice(begin, end - begin), np.diff(ends[begin : end + 1])))
                held_ids.append(ids[ends[begin] : ends[end]])
                held += int(ends[end] - ends[begin])
                begin = end
                if held >= FRAME or begin < b.num_rows:
                    yield row()
                    frame, before, held_docs, held_ids, held = frame + 1, before + held, [], [], 0
        if held:
            yield row()

    kind = coded.schema["doc_id"].dataType.simpleString()
    dealt = coded.repartitionByRange(shards, "doc_id", "k").sortWithinPartitions("doc_id", "k").select("doc_id", "ids")
    dealt.mapInArrow(run, f"shard int, frame int, before long, doc_ids array<{kind}>, lengths array<long>, blocks array<binary>").write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(f"{path}/frames")


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, and ``ids`` (array<int>) if asked for: one row a document, decoded from the files."""
    frames = spark.read.parquet(f"{path}/frames")
    sums = frames.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    offsets = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("offset"))  # 2^16 rows at most
    table = spark.sparkContext.broadcast(_table(spark.read.parquet(f"{path}/symbols").collect()))  # the vocabulary

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                blocks = b.column("blocks")[k].as_py()
                got = np.concatenate([decode_block(x, table.value) for x in blocks]).astype("<u4")
                n = b.column("lengths")[k].values.to_numpy()
                ends = np.concatenate(([0], np.cumsum(n)))
                view = memoryview(got.view(np.uint8))
                crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
                cols = [pa.array([b.column("shard")[k].as_py()] * len(n), pa.int32()), b.column("doc_ids")[k].values, pa.array(ends[:-1] + b.column("before")[k].as_py()), pa.array(n), pa.array(crc, pa.int64())]
                names = ["shard", "doc_id", "at", "n_tokens", "ids_crc32"]
                if ids:
                    cols, names = [*cols, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(got.astype(np.int32)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = frames.schema["doc_ids"].dataType.elementType.simpleString()
    rows = frames.mapInArrow(run, f"shard int, doc_id {kind}, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))
    placed = rows.join(F.broadcast(offsets), "shard")
    return placed.select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def op11_token_files(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(docs.sparkSession).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(docs.sparkSession, path, ids=False)
