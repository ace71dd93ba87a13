"""LM scoring by masked pseudo-likelihood.

A small network predicts every token from the tokens on both sides of it:
embeddings of ``SIDE`` tokens before and after, one tanh layer, and a softmax in
two steps (class of the token, then the token in its class).  The score of a
document is the sum of its tokens' conditional log-probabilities.

Word counts over all documents give the vocabulary: the most frequent words have
tokens of their own, and their number grows with the square root of the distinct
words, as do the buckets that the others share and the classes.  The probability
of a word in a bucket is the bucket's times the word's share of it, from its count
over all documents, so every distinct word has its own.

Training is local descent
with averaging: in each round every task trains a copy on all its documents,
each position in one round, and the copies are averaged, weighted by their
tokens, in sums of integers, so that reruns over the same input splits agree.
A task hands on one model, whose size follows the vocabulary.

Cases: null and empty texts have no tokens and score 0; repeated rows each give
their row; the model of an empty table is its initial one, and scores no rows; a
text of any length is one row, scored in batches; other columns aren't read,
whatever their names.  Words are told apart by a 64-bit hash, and rows meet the
shares of their words by one of id and text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, row_key, words, written

#: Frequent words with a token of their own, and shared tokens of all others, at least; the latter are one for ``TOP_WORDS // OTHERS`` of the former.
TOP_WORDS, OTHERS = 960, 64
#: So many tokens of their own for each square root of the distinct words.
ROOTS = 1
#: Classes at least; a power of two whose square holds all tokens.
CLASSES = 32
DIM, HIDDEN, SIDE = 16, 16, 2
ROUNDS = 2
BATCH = 8192
RATE = 0.5
_SCALE = 1 << 24


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, h): for each row its words' hashes, and one of its id and text."""
    return docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.transform(words(text_col), lambda w: F.xxhash64(w)).alias("h"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, n): all words of all documents, by hash."""
    return texts.select(F.explode("h").alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def vocabulary_size(distinct: int) -> int:
    return max(TOP_WORDS, math.ceil(ROOTS * math.sqrt(distinct)))


def most_frequent(counts: DataFrame, top: int) -> list[int]:
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(top).collect()]


def vocabulary(texts: DataFrame, top: int = TOP_WORDS) -> list[int]:
    """The hashes of the most frequent words of all documents, ties by the hash."""
    return most_frequent(word_counts(texts), top)


def _named(docs: DataFrame, vocab: list[int]) -> DataFrame:
    return F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in vocab], "w long"))


def bucket_shares(counts: DataFrame, vocab: list[int]) -> DataFrame:
    """(w, nats): for every word outside the vocabulary the logarithm of its share of its bucket, times ``_SCALE``."""
    bucket = F.pmod(F.col("w"), F.lit(Tokenizer(vocab).others))
    rest = counts.join(_named(counts, vocab), "w", "left_anti").withColumn("bucket", bucket)
    totals = rest.groupBy("bucket").agg(F.sum("n").alias("total"))
    return rest.join(F.broadcast(totals), "bucket").select("w", F.round(F.log(F.col("n") / F.col("total")) * _SCALE).cast("long").alias("nats"))


def n_classes(size: int) -> int:
    return max(CLASSES, 1 << math.ceil(math.log2(math.sqrt(size))))


class Network:
    """The model: ``flat`` holds all parameters, the attributes are views of it."""

    def __init__(self, size: int, flat: np.ndarray | None = None):
        self.size, self.classes = size, n_classes(size)
        self.members = size // self.classes
        self.shapes = {"emb": (size + 1, DIM), "w": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "cls": (HIDDEN, self.classes), "cls_b": (self.classes,), "out": (size, HIDDEN), "out_b": (size,)}
        n = sum(int(np.prod(s)) for s in self.shapes.values())
        if flat is None:
            flat = np.random.default_rng(7).normal(0, 0.1, n).astype(np.float32)
        self.flat, at = flat.astype(np.float32), 0
        for name, shape in self.shapes.items():
            k = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + k].reshape(shape))
            at += k

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.take(self.emb, context.ravel(), axis=0).reshape(len(context), -1)
        return x, np.tanh(x @ self.w + self.b)

    @staticmethod
    def _exp(z: np.ndarray, tame: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
        """exp(z - top), in place, its sum by row, and ``top``: 0 if ``tame``, else the row's maximum."""
        top = np.float32(0) if tame else z.max(axis=1, keepdims=True)
        if not tame:
            z -= top
        np.exp(z, out=z)
        return z, z @ np.ones((z.shape[1], 1), z.dtype), top

    def tame(self) -> bool:
        """Whether no hidden layer, of values from -1 to 1, can bring a sum beyond what exp() bears in single precision."""
        most = lambda w, b, axis: (np.abs(w).sum(axis=axis) + np.abs(b)).max(initial=0)
        return max(most(self.cls, self.cls_b, 0), most(self.out, self.out_b, 1)) < 70

    def by_class(self, target: np.ndarray):
        """The rows in order of their class, the classes in that order, and (class, slice) for those that occur."""
        cls = target // self.members
        order = np.argsort(cls.astype(np.uint16) if self.classes < 1 << 16 else cls, kind="stable")  # a radix sort if narrow
        ends = np.cumsum(np.bincount(cls, minlength=self.classes))
        return order, cls[order], [(c, slice(b, e)) for c, (b, e) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())) if e > b]

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, cls, groups = self.by_class(target)
        target = target[order]
        _, h = self.hidden(np.take(context, order, axis=0))
        tame = self.tame()
        z = h @ self.cls
        z += self.cls_b
        own = z[np.arange(len(target)), cls]
        _, total, top = self._exp(z, tame)
        lp = own - (np.log(total) + top)[:, 0]
        for c, rows in groups:
            s = slice(c * self.members, (c + 1) * self.members)
            z = h[rows] @ self.out[s].T
            z += self.out_b[s]
            own = z[np.arange(len(z)), target[rows] - s.start]
            _, total, top = self._exp(z, tame)
            lp[rows] += own - (np.log(total) + top)[:, 0]
        out = np.empty_like(lp)
        out[order] = lp
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One descent step on the mean negative log-probability of a batch; the gradients are sums, so that its rows are put in order of their class."""
        n = len(target)
        order, cls, groups = self.by_class(target)
        context, target = np.take(context, order, axis=0), target[order]
        x, h = self.hidden(context)
        tame = self.tame()
        z = h @ self.cls
        z += self.cls_b
        p, total, _ = self._exp(z, tame)
        p /= total
        p[np.arange(n), cls] -= 1
        dh = p @ self.cls.T
        grad_cls, grad_cls_b = h.T @ p, p.sum(axis=0)
        for c, rows in groups:
            s = slice(c * self.members, (c + 1) * self.members)
            own = h[rows]
            z = own @ self.out[s].T
            z += self.out_b[s]
            q, total, _ = self._exp(z, tame)
            q /= total
            q[np.arange(len(q)), target[rows] - s.start] -= 1
            dh[rows] += q @ self.out[s]
            # a class is corrected by its own share of the batch, or rare ones would stand still
            scale = np.float32(rate / max(len(q), n / self.classes))
            self.out[s] -= scale * (q.T @ own)
            self.out_b[s] -= scale * q.sum(axis=0)
        dz = dh * (1 - h * h)
        dx = dz @ self.w.T
        # sums by token: tokens in order, then one sum for each run of equal ones
        ids = context.ravel()
        at = np.argsort(ids.astype(np.uint16) if self.size < 1 << 16 else ids, kind="stable")
        ids = ids[at]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        sums = np.add.reduceat(np.take(dx.reshape(-1, DIM), at, axis=0), first, axis=0)
        seen = np.diff(np.r_[first, len(ids)])[:, None]
        self.emb[ids[first]] -= (np.float32(rate) * sums / np.maximum(seen, n / 64)).astype(np.float32)
        scale = np.float32(rate / n)
        self.w -= scale * (x.T @ dz)
        self.b -= scale * dz.sum(axis=0)
        self.cls -= scale * grad_cls
        self.cls_b -= scale * grad_cls_b


class Tokenizer:
    """Words' hashes to token ids: frequent words first, the others by the remainder."""

    def __init__(self, vocab: list[int]):
        self.vocab = np.array([*vocab, 0], dtype=np.int64)
        self.top = len(vocab)
        self.mask = (1 << (16 * self.top + 15).bit_length()) - 1
        # two tables with a place for each value of some bits; the few words whose places are taken are looked up in order
        self.tables, left = [], np.arange(self.top)
        for shift in (0, 32):
            table = np.full(self.mask + 1, self.top, dtype=np.int32)
            place = (self.vocab[left] >> shift) & self.mask
            table[place] = left
            self.tables.append((shift, table))
            left = left[table[place] != left]
        self.left = left[np.argsort(self.vocab[left])]
        self.others = max(OTHERS, self.top * OTHERS // TOP_WORDS)
        classes = n_classes(self.top + self.others)
        self.size = -(-(self.top + self.others) // classes) * classes

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = (self.top + hashes % self.others).astype(np.int32)
        for shift, table in self.tables:
            at = np.take(table, (hashes >> shift) & self.mask)
            out = np.where((np.take(self.vocab, at) == hashes) & (at < self.top), at, out)
        if len(self.left):
            at = self.left[np.searchsorted(self.vocab[self.left], hashes).clip(max=len(self.left) - 1)]
            out = np.where(self.vocab[at] == hashes, at.astype(np.int32), out)
        return out


class _Batch:
    """The tokens of some texts, one after the other, with ``SIDE`` times ``pad`` between them."""

    def __init__(self, column: pa.Array, tokens_of: Tokenizer):
        ends = column.offsets.to_numpy()
        self.n = np.diff(ends)
        self.tokens = tokens_of(column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]])
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.at = np.arange(len(self.tokens)) + SIDE * (self.doc + 1)
        self.padded = np.full(len(self.tokens) + SIDE * (len(self.n) + 1), tokens_of.size, dtype=np.int32)
        self.padded[self.at] = self.tokens

    def part(self, begin: int, end: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """For every ``step``-th token its neighbours before and after, and the token."""
        at = self.at[begin:end:step]
        return np.stack([np.take(self.padded, at + k) for k in range(-SIDE, SIDE + 1) if k], axis=1), self.tokens[begin:end:step]


def train(texts: DataFrame, vocab: list[int], rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Parameters after ``rounds`` rounds over all rows of :func:`hashed`; a round takes every ``rounds``-th position."""
    size = Tokenizer(vocab).size
    flat = Network(size).flat
    for r in range(rounds):
        now = flat

        def run(batches, now=now, r=r):
            tokens_of, net, held, n_held, seen = Tokenizer(vocab), Network(size, now), [], 0, 0

            def learn(least: int) -> None:
                nonlocal held, n_held, seen
                if n_held < max(least, 1):
                    return
                context, target = (np.concatenate(x) for x in zip(*held))
                end = len(target) if least == 1 else len(target) // BATCH * BATCH
                for at in range(0, end, BATCH):
                    net.step(context[at : at + BATCH], target[at : at + BATCH], rate)
                seen += end
                held = [(context[end:], target[end:])]
                n_held = len(target) - end

            for b in batches:
                found = _Batch(b.column(0), tokens_of)
                for at in range(r, len(found.tokens), 8 * BATCH):
                    held.append(found.part(at, at + 8 * BATCH, rounds))
                    n_held += len(held[-1][1])
                    learn(4 * BATCH)
            learn(1)
            if seen:
                values = np.rint(net.flat.astype(np.float64) * _SCALE).astype(np.int64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values) + 1)), pa.array(np.r_[values, seen])], names=["i", "v"])

        # as many rows as there are parameters, whatever the input
        sums = texts.select("h").mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toArrow()
        if sums.num_rows:
            order = np.argsort(sums["i"].to_numpy())
            total = np.array([float(v) for v in sums["v"].to_pylist()])[order]
            flat = (total[:-1] / total[-1] / _SCALE).astype(np.float32)
    return flat


def score(texts: DataFrame, vocab: list[int], flat: np.ndarray, shares: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``pll`` (sum of log-probabilities): one row for each row of :func:`hashed`; of words outside the vocabulary if ``shares`` are given, else of their buckets."""
    size = Tokenizer(vocab).size

    def run(batches):
        tokens_of, net = Tokenizer(vocab), Network(size, flat)
        for b in batches:
            found = _Batch(b.column(2), tokens_of)
            total = np.zeros(b.num_rows)
            for at in range(0, len(found.tokens), 2 * BATCH):
                lp = net.log_prob(*found.part(at, at + 2 * BATCH))
                doc = found.doc[at : at + 2 * BATCH]
                total[doc[0] : doc[-1] + 1] += np.bincount(doc - doc[0], weights=lp)
            n_others = np.bincount(found.doc[found.tokens >= tokens_of.top], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.n.astype(np.int64)), pa.array(total), b.column(1), pa.array(n_others.astype(np.int64))], names=["doc_id", "n_tokens", "pll", "key", "n_others"])

    scored = texts.select("doc_id", "key", "h").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_tokens long, pll double, key long, n_others long")
    if shares is not None:
        outside = texts.select("key", F.explode("h").alias("w")).join(_named(texts, vocab), "w", "left_anti")
        # sums over all rows of a key: repeated rows have equal words, so each takes its part by the number of its own
        sums = outside.join(shares.hint("shuffle_hash"), "w").groupBy("key").agg(F.sum("nats").alias("nats"), F.count("*").alias("of"))
        scored = scored.join(sums, "key", "left").withColumn("pll", F.col("pll") + F.coalesce(F.col("nats") / _SCALE * (F.col("n_others") / F.col("of")), F.lit(0.0)))
    return scored.select("doc_id", "n_tokens", "pll")


def op10_lm_score(docs: DataFrame) -> DataFrame:
    """``pll`` and its mean a token, from a model of the same documents."""
    texts = written(hashed(docs), "hashes")
    counts = checkpoint(word_counts(texts))
    vocab = most_frequent(counts, vocabulary_size(counts.count()))
    scored = score(texts, vocab, train(texts, vocab), shares=bucket_shares(counts, vocab))
    return scored.select("doc_id", "n_tokens", F.round("pll", 3).alias("pll"), F.round(F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).otherwise(0.0), 4).alias("mean_lp"))
