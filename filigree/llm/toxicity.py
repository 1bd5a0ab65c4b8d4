"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams (``min_n`` to
``max_n`` bytes with its boundaries, hashed into ``buckets``), a document is
the mean of its words, and two softmax outputs are linear in it.  Embeddings
and output weights start at random and are trained jointly in numpy, so
misspellings that were never seen score through the n-grams they share.  A
group lasso sets embeddings of n-grams that tell little to zero; else the mean
of a long text would be noise.

The model is fitted on at most ``per_class`` labelled rows of each class,
those of least hash, whose ``crc32(doc_id) mod 4`` is not 2; the output bias
is then corrected for the class shares of all such rows.  Scoring folds
embedding and output weights into one number a bucket: it needs no other
column than the text and runs where the text lies.

Defined cases: a null or wordless text gets the prior; null ids are not held
out; of repeated labels the largest counts; without labels the score is 0, and
with labels of one class it is that class; a score equal to the threshold is
predicted toxic; very long texts are scored in whole, and fitted on where they
fit ``fit_bytes``; repeated rows are scored alike, and fitted on once; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

#: Bytes as words see them: lower case, digits alike, ASCII punctuation as space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[48:58] = 48
_VALUE = tk.mix(np.arange(1, 257, dtype=tk.U64))


@dataclass
class Grams:
    """n-grams of a block: bucket, word, and the words' documents and n-gram counts."""

    bucket: np.ndarray
    word: np.ndarray
    doc: np.ndarray
    per_word: np.ndarray
    key: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray, min_n: int, max_n: int, bits: int) -> Grams:
    n_docs, n = len(offsets) - 1, len(data)
    owner = np.repeat(np.arange(n_docs), np.diff(offsets))
    text = np.full(n + n_docs + 1, 0x20, np.uint8)
    text[np.arange(n) + owner + 1] = _FOLD[data]
    solid = text != 0x20
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    number = np.cumsum(solid[1:] & ~solid[:-1])  # of the word at the next byte, from 1
    value = _VALUE[text]
    h, inner = value.copy(), np.ones(len(text), bool)
    buckets, words = [], []
    for size in range(2, max_n + 1):
        h = h[:-1] * tk.U64(0x9E3779B97F4A7C15) + value[size - 1 :]
        if size > 2:
            inner = inner[:-1] & solid[size - 2 : len(solid) - 1]
        else:
            inner = inner[:-1]
        if size >= min_n:
            at = np.flatnonzero(inner)
            buckets.append((tk.mix(h[at]) >> tk.U64(64 - bits)).astype(np.int64))
            words.append(number[at] - 1)
    # the whole word
    key = tk.span_hash(tk.prefix_hash(text), starts, ends)
    buckets.append((tk.mix(key) >> tk.U64(64 - bits)).astype(np.int64))
    words.append(np.arange(len(starts)))
    word = np.concatenate(words)
    shift = offsets[:-1] + np.arange(n_docs) + 1
    return Grams(np.concatenate(buckets), word, np.searchsorted(shift, starts, "right") - 1, np.bincount(word, minlength=len(starts)), key)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, towards toxic
    bias: float
    min_n: int
    max_n: int
    bits: int

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n_docs = len(offsets) - 1
        out = np.full(n_docs, self.bias)
        if not len(data):
            return out
        g = grams(data, offsets, self.min_n, self.max_n, self.bits)
        per_word = np.bincount(g.word, self.weight[g.bucket], minlength=len(g.doc)) / np.maximum(g.per_word, 1)
        words = np.bincount(g.doc, minlength=n_docs)
        return out + np.bincount(g.doc, per_word, minlength=n_docs) / np.maximum(words, 1)


class _Sums:
    """Products with a sparse matrix given by rows, and with its transpose, a stretch of entries at a time."""

    stretch = 500_000

    def __init__(self, row: np.ndarray, col: np.ndarray, weight: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.by_row, self.by_col = self._side(row, col, weight), self._side(col, row, weight)

    @classmethod
    def _side(cls, keys: np.ndarray, index: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        order = np.argsort(keys, kind="stable").astype(np.int32)
        keys, index, weight = keys[order], index[order].astype(np.int32), weight[order].astype(np.float32)[:, None]
        out, at = [], 0
        while at < len(keys):
            end = min(at + cls.stretch, len(keys))
            end = int(np.searchsorted(keys, keys[end - 1], "right"))  # whole sums
            begin = np.flatnonzero(np.concatenate([[True], keys[at + 1 : end] != keys[at : end - 1]]))
            out.append((keys[at:end][begin], begin, index[at:end], weight[at:end]))
            at = end
        return out

    @staticmethod
    def _sum(side: list[tuple[np.ndarray, ...]], rows: int, x: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, x.shape[1]), np.float32)
        for keys, begin, index, weight in side:
            out[keys] = np.add.reduceat(x[index] * weight, begin, axis=0)
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        return self._sum(self.by_row, self.shape[0], x)

    def transposed(self, x: np.ndarray) -> np.ndarray:
        return self._sum(self.by_col, self.shape[1], x)


def train(data: np.ndarray, offsets: np.ndarray, label: np.ndarray, prior: float, min_n: int = 3, max_n: int = 6, bits: int = 18, dim: int = 6, steps: int = 80, screen: int = 20, rate: float = 0.1, scale: float = 20.0, shrink: float = 0.6, decay: float = 1e-4, min_docs: int = 5, seed: int = 7) -> Model:
    """Fit on texts in memory; ``prior`` is the share of label 1 that scores are corrected to."""
    weight = np.zeros(1 << bits)
    share = float(np.clip(prior, 1e-6, 1 - 1e-6))
    if not len(label) or label.min() == label.max():
        return Model(weight, -30.0 if not len(label) or label.max() == 0 else 30.0, min_n, max_n, bits)
    keys, docs, gw, gb, seen = [], [], [], [], np.zeros(0, tk.U64)
    for first, _, d, o in tk.blocks(data, offsets, 256 << 10):
        g = grams(d, o, min_n, max_n, bits)
        keys.append(g.key)
        docs.append((g.doc + first).astype(np.int32))
        # n-grams of words that no earlier block had, each word once
        fresh, at = np.unique(g.key, return_index=True)
        new = ~np.isin(fresh, seen, assume_unique=True)
        rank = np.full(len(g.key), -1, np.int64)
        rank[at[new]] = np.arange(new.sum())
        own = rank[g.word]
        gw.append((own[own >= 0] + len(seen)).astype(np.int32))
        gb.append(g.bucket[own >= 0].astype(np.int32))
        seen = np.concatenate([seen, fresh[new]])
    key, doc, gw, gb = np.concatenate(keys), np.concatenate(docs).astype(np.int64), np.concatenate(gw), np.concatenate(gb)
    del keys, docs
    order = np.argsort(seen, kind="stable")
    unique, word = seen, order[np.searchsorted(seen[order], key)]
    del key
    n_docs = len(label)
    pair, count = np.unique(doc * len(unique) + word, return_counts=True)
    d, w = pair // len(unique), pair % len(unique)
    # n-grams of few documents would only be learned by heart
    share_of = (1 / np.bincount(gw, minlength=len(unique)))[gw].astype(np.float32)
    in_docs = np.bincount(w, minlength=len(unique))
    often = np.bincount(gb, in_docs[gw], minlength=1 << bits)[gb] >= min_docs
    gw, share_of = gw[often], share_of[often]
    used, gb = np.unique(gb[often], return_inverse=True)
    in_word = _Sums(gw, gb, share_of, (len(unique), len(used)))
    in_doc = _Sums(d, w, (count / np.bincount(doc, minlength=n_docs)[d]).astype(np.float32), (n_docs, len(unique)))

    r = np.random.default_rng(seed)
    embedding = (r.standard_normal((len(used), dim)) * 0.01).astype(np.float32)
    params = [embedding, (r.standard_normal((dim, 2)) / np.sqrt(dim)).astype(np.float32), np.zeros((1, 2), np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = np.stack([label == 0, label == 1], 1).astype(np.float32)
    balance = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())).astype(np.float32)[:, None]
    for step in range(1, steps + 1):
        e, out, bias = params
        x = in_doc.times(in_word.times(e)) * np.float32(scale)
        z = x @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - target) * balance
        dx = dz @ out.T * np.float32(scale)
        slopes = [in_word.transposed(in_doc.transposed(dx)) + np.float32(decay / max(1, len(used))) * e, x.T @ dz + np.float32(decay) * out, dz.sum(0, keepdims=True)]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            size = np.sqrt(second[i] / (1 - 0.99**step))
            if not i and size.size:  # one step size an n-gram, and rare ones move little
                size = np.sqrt(np.square(size).mean(1, keepdims=True)) + 0.02 * size.max()
            params[i] = params[i] - np.float32(rate) * (first[i] / (1 - 0.9**step)) / (size + 1e-12)
        if step > 5:  # a group lasso: n-grams that tell little go to zero as a whole
            length = np.sqrt(np.square(params[0]).sum(1, keepdims=True))
            params[0] = params[0] * np.maximum(0, 1 - rate * shrink / np.maximum(length, 1e-9)).astype(np.float32)
        if step % screen == 0:  # those at zero stay there, and cost nothing further
            live = np.abs(params[0]).sum(1) > 0
            number = np.cumsum(live) - 1
            rest = live[gb]
            gw, gb, share_of, used = gw[rest], number[gb[rest]], share_of[rest], used[live]
            params[0], first[0], second[0] = params[0][live], first[0][live], second[0][live]
            in_word = _Sums(gw, gb, share_of, (len(unique), len(used)))
    e, out, bias = params
    weight[used] = (e @ (out[:, 1] - out[:, 0])) * scale
    return Model(weight, float(bias[0, 1] - bias[0, 0]) + float(np.log(share / (1 - share))), min_n, max_n, bits)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, fit_bytes: int = 32 << 20) -> Model:
    """Fitted on at most ``per_class`` whole texts of each class, and no more of them than ``fit_bytes`` hold."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where(~held_out())
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("label = 0").orderBy(*order).limit(per_class).unionAll(known.where("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    room = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.partitionBy("label").orderBy(*order))
    rows = texts.withColumn("room", room).where(F.col("room") <= fit_bytes).orderBy("doc_id").select("label", "text").toArrow()
    data, offsets = tk.utf8(rows["text"]) if len(rows) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return train(data, offsets, rows["label"].to_numpy(), counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score in [0, 1] and predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(2))
            logits = [model.logits(d, o) for _, _, d, o in tk.blocks(data, offsets, 1 << 20)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(logits) if logits else np.zeros(0), -500, 500)))
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "score": p, "predicted": (p >= threshold).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
