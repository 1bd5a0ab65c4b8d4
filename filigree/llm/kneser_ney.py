"""Quality classifier: interpolated modified Kneser-Ney n-gram model of words over trusted text.

Tokens are words (runs of letters), numbers (all alike) and single signs.  An
n-gram is a word after the word before it, or after the start of its text.
Neither the vocabulary nor the n-grams have a bound; both grow with the trusted
text.  Words are known by 48 bits of a hash, and so are n-grams.

* Counting: tasks add up the n-grams of chunks of trusted text, which meet by
  n-gram.  Counts of counts give the discounts, distinct words before a word
  the lower order.  Joins with the sums of the word before and of the word give
  each n-gram's value, kept in the shard of its key; n-grams are joined in
  ``PARTS`` parts, one after the other, which bounds the disk.
* Scoring: a chunk of documents looks up the most frequent keys (at most
  ``LOCAL``) in a table that is shipped, and asks each shard once for its other
  distinct keys, with the documents that hold them.  Shards join the questions
  with their entries and answer with sums by document, which are added up by
  chunk.  Frequent keys are looked up, so no shard is hot; questions are
  streamed past a shard's entries.  All documents are scored, in ``SCORED``
  parts by a hash of the row, which changes no score.
* A document is rejected if its perplexity exceeds its language's threshold,
  the ``quantile`` of trusted documents that were held out of the counts.

Trusted are documents whose labels all say quality 1; those with
``crc32(doc_id) mod 4 = 3`` are held out for the thresholds.

Defined cases: a null or empty text, or one of white space, has no perplexity
and is rejected; a language with fewer than ``least`` held-out documents (null
is a language) takes the threshold of all; without any trusted rows nothing
with a token is rejected; a perplexity equal to the threshold is kept; very
long texts are read in whole, in one chunk each; repeated rows are handled
alike; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import forget, keep, let_go

HEADS, ENDINGS = 1000, 1024
CONTEXTS = ENDINGS + 1 + HEADS  # endings, the start of a text, heads
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 1 << 15
FILTER_BITS = 23
_ZSTD = "zstd"

#: Kinds of bytes: white space, letters, digits, signs that stand alone.
_KIND = np.full(256, 3, np.uint8)
_KIND[:33] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_NUMBER = tk.U64(7 << 16 | 7 << 40)


def tokens(data: np.ndarray, offsets: np.ndarray, suffix: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hashes of the tokens, the classes of their endings, and their documents."""
    n = len(data)
    if not n:
        return np.zeros(0, tk.U64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    kind = _KIND[data]
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    starts, ends = offsets[:-1], offsets[1:]
    before[starts[starts < n]] = 0
    after[ends[ends > 0] - 1] = 0
    alone = kind == 3
    begin = np.flatnonzero((kind > 0) & ((kind != before) | alone))
    end = np.flatnonzero((kind > 0) & ((kind != after) | alone)) + 1
    prefix = tk.prefix_hash(data)
    word = tk.span_hash(prefix, begin, end)
    ending = (tk.span_hash(prefix, np.maximum(begin, end - suffix), end) % tk.U64(ENDINGS)).astype(np.int32)
    number = kind[begin] == 2
    word[number] = _NUMBER
    ending[number] = 0
    return word >> tk.U64(16), ending, np.searchsorted(offsets, begin, "right") - 1


def chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with about CHUNK_BYTES of text, and their tokens, ending classes and documents."""

    def read(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held)
        data, offsets = tk.utf8(table.column(text))
        words, endings, docs = [], [], []
        for first, _, d, o in tk.blocks(data, offsets):
            w, e, doc = tokens(d, o)
            words.append(w)
            endings.append(e)
            docs.append(doc + first)
        if not words:
            return table, np.zeros(0, tk.U64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        return table, np.concatenate(words), np.concatenate(endings), np.concatenate(docs)

    held, size, rows = [], 0, 0
    for batch in batches:
        at = 0
        while at < len(batch):
            part = batch.slice(at, 1024)
            at += len(part)
            held.append(part)
            size += int(pa.compute.sum(pa.compute.binary_length(part.column(text))).as_py() or 0)
            rows += len(part)
            if size >= CHUNK_BYTES or rows + 1024 > CHUNK_ROWS:
                yield read(held)
                held, size, rows = [], 0, 0
    if rows:
        yield read(held)
    tk.release()


def contexts(words: np.ndarray, endings: np.ndarray, doc: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the token before each token, and the token's place among the sorted heads or -1."""
    head = np.full(len(words), -1, np.int32)
    if len(heads) and len(words):
        at = np.minimum(np.searchsorted(heads, words), len(heads) - 1)
        head = np.where(heads[at] == words, at, -1).astype(np.int32)
    own = np.where(head >= 0, ENDINGS + 1 + head, endings)
    left = np.full(len(words), ENDINGS, np.int64)
    left[1:] = np.where(doc[1:] == doc[:-1], own[:-1], ENDINGS)
    return left, head


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays by planes of bytes, compressed; ``unpacked`` gives them back."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays if len(a))
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], "<i8").tobytes()
    return head + pa.compress(raw, codec=_ZSTD, asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    sizes = np.frombuffer(blob, "<i8", 2 * n, 8).reshape(n, 2)
    total = int((sizes[:, 0] * sizes[:, 1]).sum())
    raw, at, out = np.frombuffer(pa.decompress(blob[8 + 16 * n :], decompressed_size=total, codec=_ZSTD, asbytes=True), np.uint8), 0, []
    for length, width in sizes.tolist():
        part = np.ascontiguousarray(raw[at : at + length * width].reshape(width, length).T)
        out.append(part.view(f"<u{width}").reshape(-1))
        at += length * width
    return out


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    """Shard of 48-bit words; it grows with the word, so sorted words lie shard by shard."""
    return ((words >> tk.U64(32)) * tk.U64(shards) >> tk.U64(16)).astype(np.int64)


def n_shards(n_bytes: int) -> int:
    """Shards of 32 MB of text up to 1024 of them, beyond that of 2 GB; a shard's counts fit a task."""
    return min(1 << 16, max(-(-n_bytes >> 31), min(1024, -(-n_bytes >> 25)), 1))


def slices(words: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, last + 1) of sorted words."""
    shard = shard_of(words, shards)
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(words) else np.zeros(0, np.int64)
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(words)).tolist()):
        yield int(shard[a]), a, b


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with a share of a chunk's tokens that a head could have."""
    for _, words, _, _ in chunks(batches, 0):
        seen, n = np.unique(words, return_counts=True)
        often = n * 50_000 >= len(words)
        yield pa.record_batch({"w": seen[often].astype(np.int64), "n": n[often].astype(np.int64)})


def _count(heads: np.ndarray, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, endings, doc in chunks(batches, 0):
            left, _ = contexts(words, endings, doc, heads)
            seen, inverse = np.unique(words, return_inverse=True)
            code, n = np.unique(inverse * CONTEXTS + left, return_counts=True)
            begin = np.searchsorted(code, np.arange(len(seen) + 1) * CONTEXTS)
            for s, a, b in slices(seen, shards):
                x, y = begin[a], begin[b]
                yield pa.record_batch({"shard": pa.array([s], pa.int32()), "blob": [packed(seen[a:b], np.diff(begin[a : b + 1]).astype("<u4"), (code[x:y] % CONTEXTS).astype("<u2"), n[x:y].astype("<u4"))]})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the counts of each shard; rows come sorted by shard, questions are added to a shard's counts one by one."""

    def out(shard: int, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        words, codes, n = _added(parts)
        begin = np.searchsorted(codes, np.arange(len(words) + 1) * CONTEXTS)
        return pa.record_batch({"shard": pa.array([shard], pa.int32()), "blob": [packed(words, np.diff(begin).astype("<u4"), (codes % CONTEXTS).astype("<u2"), n.astype("<u8"))]})

    now, parts, rows = None, [], 0
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if now is not None and shard != now:
                yield out(now, parts)
                parts, rows = [], 0
            now = shard
            parts.append(unpacked(blob.as_py()))
            rows += len(parts[-1][2])
            if rows > 4_000_000 and len(parts) > 1:
                words, codes, n = _added(parts)
                begin = np.searchsorted(codes, np.arange(len(words) + 1) * CONTEXTS)
                parts, rows = [[words, np.diff(begin).astype("<u4"), (codes % CONTEXTS).astype("<u2"), n.astype("<u8")]], 0
    if now is not None:
        yield out(now, parts)
    tk.release()


def _added(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted words, sorted codes of word number and class, and counts."""
    words = np.unique(np.concatenate([p[0] for p in parts]))
    codes = np.concatenate([np.repeat(np.searchsorted(words, p[0]), p[1].astype(np.int64)) * CONTEXTS + p[2].astype(np.int64) for p in parts])
    n = np.concatenate([p[3].astype(np.int64) for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    cut = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return words, codes[cut], np.add.reduceat(n, cut) if len(cut) else n


def _statistics(heads: np.ndarray):
    """Rows (what, a, b, n): 0 counts of counts, 1 those of distinct classes, 2 sums of a class, 3 counts of a head word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1):
                words, each, left, n = unpacked(blob.as_py())
                n, each, left = n.astype(np.int64), each.astype(np.int64), left.astype(np.int64)
                rows = [np.stack([np.full(4, 0), np.arange(1, 5), np.zeros(4, int), [(n == k).sum() for k in (1, 2, 3, 4)]], 1)]
                rows.append(np.stack([np.full(6, 1), np.arange(1, 7), np.zeros(6, int), [*((each == k).sum() for k in (1, 2, 3, 4)), each.sum(), len(each)]], 1))
                for k in range(4):  # all, and distinct words with a count of 1, 2 and more
                    sums = np.bincount(left, n if not k else (np.minimum(n, 3) == k), minlength=CONTEXTS).astype(np.int64)
                    at = np.flatnonzero(sums)
                    rows.append(np.stack([np.full(len(at), 2), at, np.full(len(at), k), sums[at]], 1))
                if len(heads):
                    at = np.minimum(np.searchsorted(heads, words), len(heads) - 1)
                    which = np.repeat(np.where(heads[at] == words, at, -1), each)
                    own = which >= 0
                    rows.append(np.stack([np.full(own.sum(), 3), which[own], left[own], n[own]], 1))
                table = np.concatenate(rows)
                yield pa.record_batch({c: np.ascontiguousarray(table[:, i]).astype(np.int64) for i, c in enumerate(("what", "a", "b", "n"))})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from how many n-grams have counts of 1 to 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 0.75, 0.9])  # too few counts to estimate
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(min(max(d, 0.05), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


@dataclass
class Model:
    """Counts by shard (a table), and what has a proven bound: heads, sums of classes, discounts."""

    counts: DataFrame
    shards: int
    heads: np.ndarray  # sorted
    total: np.ndarray  # tokens after a class
    left: np.ndarray  # mass that a class leaves to the lower order
    high: np.ndarray  # discounts of the order of n-grams
    low: np.ndarray  # and of the lower order
    distinct: int  # n-grams
    types: int
    head_table: np.ndarray  # log probability by head and class

    def lower(self, classes: np.ndarray) -> np.ndarray:
        """Probability of words after that many distinct classes."""
        every = max(self.distinct, 1)
        return np.maximum(classes - self.low[np.minimum(classes, 3)], 0) / every + self.spare / (self.types + 1)

    spare: float = 1.0  # mass of the lower order that is spread evenly

    def questions(self, extra: list[str]):
        return _questions(self, extra)

    def answers(self):
        return _answers(self)

    def log(self, count: np.ndarray, left: np.ndarray, lower: np.ndarray) -> np.ndarray:
        own = (count - self.high[np.minimum(count, 3)]) / np.maximum(self.total[left], 1)
        return np.log(np.where(count > 0, own, 0) + self.left[left] * lower)


def trusted_labels(labels: DataFrame) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 3
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", held.alias("held"))


def _maybe(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS hashed ids: rows that it lacks need not be shuffled to be joined with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, np.uint8)
        for batch in batches:
            bits[batch.column(0).to_numpy()] = 1
        words = np.packbits(bits).view("<i8")
        at = np.flatnonzero(words)
        yield pa.record_batch({"i": at.astype(np.int64), "w": words[at]})

    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    rows = ids.select(place.alias("i")).mapInArrow(run, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()  # 2**17 rows at most
    out = np.zeros(1 << (FILTER_BITS - 6), "<i8")
    out[rows["i"].to_numpy()] = rows["w"].to_numpy()
    return np.unpackbits(out.view(np.uint8)).astype(bool)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts to count.  One join strategy at every size, as labels grow with the corpus."""
    ids = keep(trusted_labels(labels).where("not held").select("doc_id"), "trusted")
    there = _maybe(ids)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(there[batch.column(0).to_numpy()]))

    own = docs.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("i"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = keep(own.mapInArrow(likely, f"doc_id {kind}, text string").join(ids.hint("merge"), "doc_id").select("text"), "trusted-texts", drop_shuffles=True)
    forget(ids)
    return texts


def fit(docs: DataFrame, labels: DataFrame, n_heads: int = HEADS, shards: int | None = None) -> Model:
    """A smaller model, of words after the class of the token before; ``classify`` uses ``fit_words``.

    The ``n_heads`` most frequent words are classes of their own, other words are classed by their endings.
    """
    if not 0 <= n_heads <= HEADS:
        raise ValueError(f"n_heads must be between 0 and {HEADS}")
    texts = trusted_texts(docs, labels)
    shards = shards or n_shards(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    often = texts.mapInArrow(_frequent, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(n_heads).collect()
    heads = np.sort(np.array([r.w for r in often], tk.U64))
    asked = texts.mapInArrow(_count(heads, shards), "shard int, blob binary")
    counts = keep(asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_merge, "shard int, blob binary"), "counts")
    forget(texts)
    sums = counts.mapInArrow(_statistics(heads), "what long, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).toArrow()  # by head and class at most
    what, a, b, n = (sums[c].to_numpy() for c in ("what", "a", "b", "n"))
    pick = lambda k, size: np.bincount(a[what == k], n[what == k], minlength=size + 1)[1 : size + 1].astype(np.int64).tolist()
    high, low = discounts(pick(0, 4)), discounts(pick(1, 4))
    *of_low, distinct, types = pick(1, 6)
    by_class = np.zeros((4, CONTEXTS))
    by_class[b[what == 2], a[what == 2]] = n[what == 2]
    total = by_class[0]
    left = np.where(total > 0, high[1:] @ by_class[1:] / np.maximum(total, 1), 1.0)
    more = types - of_low[0] - of_low[1]
    spare = float(low[1:] @ [of_low[0], of_low[1], more]) / distinct if distinct else 1.0
    model = Model(counts, shards, heads, total, left, high, low, distinct, types, np.zeros((0, 0), np.float32), spare)
    own = np.zeros((len(heads), CONTEXTS), np.int64)
    own[a[what == 3], b[what == 3]] = n[what == 3]
    lower = model.lower((own > 0).sum(1))
    model.head_table = np.stack([model.log(row, np.arange(CONTEXTS), p) for row, p in zip(own, lower)]).astype(np.float32) if len(heads) else np.zeros((0, CONTEXTS), np.float32)
    return model


def _questions(model: Model, extra: list[str]):
    """A row for each document of a chunk, and one for each shard with the n-grams that the chunk asks it for.

    Chunks are named by task, number and content, so a task that runs again
    names them alike.  ``asked`` says how many answers a chunk waits for.
    """
    heads, table, shards = model.heads, model.head_table, model.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where = task.partitionId() if task else 0
        for number, (rows, words, endings, doc) in enumerate(chunks(batches, len(extra))):
            n_docs = len(rows)
            chunk = f"{where}-{number}-{zlib.crc32(words.tobytes())}-{n_docs}"
            left, head = contexts(words, endings, doc, heads)
            known = head >= 0
            sums = np.bincount(doc[known], table[head[known], left[known]].astype(float), minlength=n_docs) if known.any() else np.zeros(n_docs)
            rest = ~known
            seen, inverse = np.unique(words[rest], return_inverse=True)
            code, n = np.unique((inverse * n_docs + doc[rest]) * CONTEXTS + left[rest], return_counts=True)
            begin = np.searchsorted(code, np.arange(len(seen) + 1) * (n_docs * CONTEXTS))
            out = []
            for s, a, b in slices(seen, shards):
                part, times = code[begin[a] : begin[b]], n[begin[a] : begin[b]]
                out.append((s, packed(seen[a:b], np.diff(begin[a : b + 1]).astype("<u4"), (part // CONTEXTS % n_docs).astype("<u2"), (part % CONTEXTS).astype("<u2"), times.astype("<u4"))))
            own = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns[: len(extra)]], names=extra)
            # documents travel with the questions, spread over the shards
            spread = np.full(n_docs, (where + number) % shards, np.int32)
            yield pa.record_batch({"chunk": [chunk] * n_docs, "shard": spread, "blob": pa.nulls(n_docs, pa.binary()), "at": pa.array(np.arange(n_docs, dtype=np.int32)), "n": np.bincount(doc, minlength=n_docs), "sum": sums, "asked": np.full(n_docs, len(out), np.int32), "own": own})
            for at in range(0, len(out), 64):
                group = out[at : at + 64]
                k = len(group)
                yield pa.record_batch({"chunk": [chunk] * k, "shard": pa.array([s for s, _ in group], pa.int32()), "blob": [x for _, x in group], "at": pa.nulls(k, pa.int32()), "n": pa.nulls(k, pa.int64()), "sum": pa.nulls(k, pa.float64()), "asked": pa.nulls(k, pa.int32()), "own": pa.nulls(k, own.type)})

    return run


def _answers(model: Model):
    """Rows come sorted by shard, its counts first: sums of log probabilities by document of each question."""
    settings = Model(None, model.shards, model.heads[:0], model.total, model.left, model.high, model.low, model.distinct, model.types, model.head_table[:0], model.spare)  # type: ignore[arg-type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, codes, count, lower = None, np.zeros(0, tk.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            answers, through = [], batch.filter(batch.column(3).is_valid())
            if len(through):
                yield through
            asking = batch.filter(batch.column(3).is_null())
            for chunk, shard, blob in zip(asking.column(0).to_pylist(), asking.column(1).to_pylist(), asking.column(2)):
                parts = unpacked(blob.as_py())
                if shard != now:  # a shard without counts answers as well
                    now, words, codes, count, lower = shard, np.zeros(0, tk.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                if chunk is None:
                    words, each, left, count = parts[0], parts[1].astype(np.int64), parts[2].astype(np.int64), parts[3].astype(np.int64)
                    codes, lower = np.repeat(np.arange(len(words)), each) * CONTEXTS + left, settings.lower(each)
                    continue
                asked, each, doc, left, times = parts[0], parts[1].astype(np.int64), parts[2].astype(np.int64), parts[3].astype(np.int64), parts[4].astype(float)
                n, p = np.zeros(len(left), np.int64), np.full(len(left), settings.lower(np.zeros(1, np.int64))[0])
                if len(words):
                    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                    found = np.repeat(words[at] == asked, each)
                    at = np.repeat(at, each)
                    code = at * CONTEXTS + left
                    spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    n = np.where(found & (codes[spot] == code), count[spot], 0)
                    p = np.where(found, lower[at], p)
                value = np.bincount(doc, settings.log(n, left, p) * times)
                docs = np.flatnonzero(value)
                answers.append((chunk, shard, packed(docs.astype("<u2"), value[docs].astype("<f4").view("<u4"))))
            if answers:
                rest = {f.name: pa.nulls(len(answers), f.type) for f in list(batch.schema)[3:]}
                yield pa.record_batch({"chunk": [x[0] for x in answers], "shard": pa.array([x[1] for x in answers], pa.int32()), "blob": pa.array([x[2] for x in answers], pa.binary()), **rest})
        tk.release()

    return run


_START = tk.U64((1 << 48) - 1)
LOCAL = 1 << 17
#: Entries are made, and documents scored, in so many parts one after the other: the shuffle files of one are on disk at a time.
PARTS, SCORED = 4, 4


def pair_keys(left: np.ndarray, words: np.ndarray) -> np.ndarray:
    return tk.mix(tk.mix(left + tk.U64(1)) + words) >> tk.U64(16)


def word_keys(words: np.ndarray, kind: int) -> np.ndarray:
    """Keys of words as tokens (1) and as last tokens of a text (2)."""
    return tk.mix(words ^ tk.U64(kind * 0x5851F42D4C957F2D)) >> tk.U64(16)


def befores(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The word before each word."""
    left = np.full(len(words), _START, tk.U64)
    left[1:] = np.where(doc[1:] == doc[:-1], words[:-1], _START)
    return left


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, words, _, doc in chunks(batches, 0):
        left = befores(words, doc)
        order = np.lexsort((words, left))
        u, w = left[order], words[order]
        at = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])) if len(u) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(u)))
        for i in range(0, len(at), 1 << 16):
            yield pa.record_batch({"u": u[at[i : i + (1 << 16)]].view(np.int64), "w": w[at[i : i + (1 << 16)]].view(np.int64), "n": n[i : i + (1 << 16)]})


@dataclass
class WordModel:
    """Log probabilities by key in shards (a table), and a bounded number of the most frequent keys.

    With q the lower order and l(u) the mass that u leaves to it, a token's log
    probability is log q(w) + log l(u), and for n-grams that were counted the
    rest, log(1 + own / (l(u) q(w))).  As each token but the last is the next
    one's context, a text is the sum of log q(w) + log l(w) of its tokens, less
    log l of the last one, and the rests of its n-grams; what was never counted
    adds a constant a token.
    """

    made: list[DataFrame]  # shard, packed keys and values
    shards: int
    unseen: float  # log probability in the lower order of a word without counts
    start: float  # log of the mass that the start of a text leaves
    keys: np.ndarray  # most frequent ones, sorted
    values: np.ndarray

    @property
    def counts(self) -> DataFrame:
        return reduce(DataFrame.unionAll, self.made)

    def questions(self, extra: list[str]):
        return _word_questions(self, extra)

    def answers(self):
        return _word_answers


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and key: a row a shard, its entries in order."""

    def out(shard: int, parts: list) -> pa.RecordBatch:
        keys, values = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return pa.record_batch({"shard": pa.array([shard], pa.int32()), "blob": pa.array([packed(np.diff(keys, prepend=0).astype("<u8"), values.view("<u4"))], pa.binary())})

    now, parts = None, []
    for batch in batches:
        shard, key, value = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype("<f4")
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        for x, y in zip(cut.tolist(), np.append(cut[1:], len(shard)).tolist()):
            if now is not None and int(shard[x]) != now:
                yield out(now, parts)
                parts = []
            now = int(shard[x])
            parts.append((key[x:y], value[x:y]))
    if now is not None:
        yield out(now, parts)
    tk.release()


def fit_words(docs: DataFrame, labels: DataFrame, shards: int | None = None, local: int = LOCAL, parts: int = PARTS) -> WordModel:
    """N-grams of a word after the word before it, counted and joined with their contexts' and words' sums."""
    texts = trusted_texts(docs, labels)
    shards = shards or n_shards(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    pairs = keep(texts.mapInArrow(_count_pairs, "u long, w long, n long").groupBy("u", "w").agg(F.sum("n").alias("n")), "pairs", drop_shuffles=True)
    forget(texts)
    few = lambda c: [F.count_if(F.col(c) == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    of_high = pairs.agg(F.count("*").alias("all"), *few("n")).first()
    high = discounts([of_high[f"n{k}"] for k in (1, 2, 3, 4)])
    more = lambda c: (F.when(F.col(c) == 1, 1.0 * high[1]).when(F.col(c) == 2, 1.0 * high[2]).otherwise(1.0 * high[3]))
    before = pairs.groupBy("u").agg(F.sum("n").alias("total"), F.sum(more("n")).alias("lost")).select("u", "total", (F.col("lost") / F.col("total")).alias("left"))
    types = keep(pairs.groupBy("w").agg(F.count("*").alias("classes"), F.sum("n").alias("times")), "types")
    of_low = types.agg(F.count("*").alias("all"), *few("classes")).first()
    low = discounts([of_low[f"n{k}"] for k in (1, 2, 3, 4)])
    distinct, every = of_high["all"], of_low["all"]
    spare = float(low[1:] @ [of_low["n1"], of_low["n2"], every - of_low["n1"] - of_low["n2"]]) / distinct if distinct else 1.0
    unseen = spare / (every + 1)
    before = keep(before, "contexts")
    lower = F.greatest(F.col("classes") - F.when(F.col("classes") == 1, float(low[1])).when(F.col("classes") == 2, float(low[2])).otherwise(float(low[3])), F.lit(0.0)) / max(distinct, 1) + unseen
    words = types.select("w", "times", lower.alias("q"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w, n, total, left, q = (batch.column(i).to_numpy() for i in range(6))
            own = (n - high[np.minimum(n, 3)]) / total
            key = pair_keys(u.view(tk.U64), w.view(tk.U64))
            yield pa.record_batch({"shard": shard_of(key, shards).astype(np.int32), "key": key.view(np.int64), "value": np.log1p(own / (left * q)).astype(np.float32)})

    def tokens_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, q, left = (batch.column(i).to_numpy() for i in range(3))
            for kind, value in ((1, np.log(q) - np.log(unseen) + np.log(left)), (2, -np.log(left))):
                key = word_keys(w.view(tk.U64), kind)
                yield pa.record_batch({"shard": shard_of(key, shards).astype(np.int32), "key": key.view(np.int64), "value": value.astype(np.float32)})

    schema = "shard int, key long, value float"

    def of_pairs(some: DataFrame) -> DataFrame:
        return some.join(before.hint("merge"), "u").join(words.select("w", "q").hint("merge"), "w").select("u", "w", "n", "total", "left", "q").mapInArrow(entries, schema)

    def of_words(some: DataFrame) -> DataFrame:
        return some.join(before.select(F.col("u").alias("w"), "left").hint("merge"), "w", "left").select("w", "q", F.coalesce("left", F.lit(1.0)).alias("left")).mapInArrow(tokens_, schema)

    # The most frequent keys are those found more often than the one at place ``local``.
    top = pairs.select("n").unionAll(types.select(F.col("times").alias("n"))).orderBy(F.desc("n")).limit(local).agg(F.count("*").alias("all"), F.min("n").alias("n")).first()
    least = top["n"] if top["all"] == local and local else 0
    often = of_pairs(pairs.where(F.col("n") > least)).unionAll(of_words(words.where(F.col("times") > least))).select("key", "value").toArrow() if local else None
    keys = often["key"].to_numpy().view(tk.U64) if often else np.zeros(0, tk.U64)
    values = often["value"].to_numpy() if often else np.zeros(0, np.float32)
    order = np.argsort(keys, kind="stable")
    first = before.where(F.col("u") == int(_START)).first()
    made, parts = [], max(1, min(parts, shards))
    let_go(docs.sparkSession)
    for part in range(parts):
        some = of_pairs(pairs.where(F.pmod(F.xxhash64("u", "w"), F.lit(parts)) == part))
        table = some if part else some.unionAll(of_words(words))
        made.append(keep(table.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key").mapInArrow(_pack_shards, "shard int, blob binary"), "counts", drop_shuffles=True))
    for done in (pairs, types, before):
        forget(done)
    let_go(docs.sparkSession)
    return WordModel(made, shards, float(np.log(unseen)), float(np.log(first.left)) if first else 0.0, keys[order], values[order])


def _word_questions(model: WordModel, extra: list[str]):
    """Rows as of ``_questions``: each shard is asked for keys that a chunk has and the task does not, by document."""
    shards, unseen, start, local, values = model.shards, model.unseen, model.start, model.keys, model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where = task.partitionId() if task else 0
        for number, (rows, words, _, doc) in enumerate(chunks(batches, len(extra))):
            n_docs = len(rows)
            chunk = f"{where}-{number}-{zlib.crc32(words.tobytes())}-{n_docs}"
            last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if len(words) else np.zeros(0, np.int64)
            keys = np.concatenate([pair_keys(befores(words, doc), words), word_keys(words, 1), word_keys(words[last], 2)])
            who = np.concatenate([doc, doc, doc[last]])
            n = np.bincount(doc, minlength=n_docs)
            sums = n * unseen + (n > 0) * start
            if len(local) and len(keys):
                at = np.minimum(np.searchsorted(local, keys), len(local) - 1)
                known = local[at] == keys
                sums = sums + np.bincount(who[known], values[at[known]].astype(float), minlength=n_docs)
                keys, who = keys[~known], who[~known]
            seen, inverse = np.unique(keys, return_inverse=True)
            code, times = np.unique(inverse * n_docs + who, return_counts=True)
            begin = np.searchsorted(code, np.arange(len(seen) + 1) * n_docs)
            out = []
            for s, a, b in slices(seen, shards):
                part, k = code[begin[a] : begin[b]], times[begin[a] : begin[b]]
                out.append((s, packed(np.diff(seen[a:b], prepend=tk.U64(0)).astype("<u8"), np.diff(begin[a : b + 1]).astype("<u4"), (part % n_docs).astype("<u2"), k.astype("<u4"))))
            own = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns[: len(extra)]], names=extra)
            spread = np.full(n_docs, (where + number) % shards, np.int32)
            yield pa.record_batch({"chunk": [chunk] * n_docs, "shard": spread, "blob": pa.nulls(n_docs, pa.binary()), "at": pa.array(np.arange(n_docs, dtype=np.int32)), "n": n, "sum": sums, "asked": np.full(n_docs, len(out), np.int32), "own": own})
            for at in range(0, len(out), 64):
                group = out[at : at + 64]
                k = len(group)
                yield pa.record_batch({"chunk": [chunk] * k, "shard": pa.array([s for s, _ in group], pa.int32()), "blob": pa.array([x for _, x in group], pa.binary()), "at": pa.nulls(k, pa.int32()), "n": pa.nulls(k, pa.int64()), "sum": pa.nulls(k, pa.float64()), "asked": pa.nulls(k, pa.int32()), "own": pa.nulls(k, own.type)})

    return run


def _word_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, its entries first: sums of values by document of each question."""
    now, keys, values = None, np.zeros(0, tk.U64), np.zeros(0, np.float32)
    for batch in batches:
        answers, through = [], batch.filter(batch.column(3).is_valid())
        if len(through):
            yield through
        asking = batch.filter(batch.column(3).is_null())
        for chunk, shard, blob in zip(asking.column(0).to_pylist(), asking.column(1).to_pylist(), asking.column(2)):
            parts = unpacked(blob.as_py())
            if shard != now:  # a shard without entries answers as well
                now, keys, values = shard, np.zeros(0, tk.U64), np.zeros(0, np.float32)
            if chunk is None:  # a row a part
                keys, values = np.concatenate([keys, np.cumsum(parts[0], dtype=tk.U64)]), np.concatenate([values, parts[1].view("<f4")])
                order = np.argsort(keys, kind="stable")
                keys, values = keys[order], values[order]
                continue
            asked, each, doc, times = np.cumsum(parts[0], dtype=tk.U64), parts[1].astype(np.int64), parts[2].astype(np.int64), parts[3].astype(float)
            sums = np.zeros(0)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                value = np.where(keys[at] == asked, values[at], 0).astype(float)
                sums = np.bincount(doc, np.repeat(value, each) * times)
            docs = np.flatnonzero(sums)
            answers.append((chunk, shard, packed(docs.astype("<u2"), sums[docs].astype("<f4").view("<u4"))))
        if answers:
            rest = {f.name: pa.nulls(len(answers), f.type) for f in list(batch.schema)[3:]}
            yield pa.record_batch({"chunk": [x[0] for x in answers], "shard": pa.array([x[1] for x in answers], pa.int32()), "blob": pa.array([x[2] for x in answers], pa.binary()), **rest})
    tk.release()


def perplexities(docs: DataFrame, model: Model | WordModel, extra: list[str]) -> DataFrame:
    """``extra`` columns, n_tokens and perplexity (null for no tokens) of each row."""
    own = docs.select(*extra, "text")
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in own.schema[:-1])
    schema = f"chunk string, shard int, blob binary, at int, n long, sum double, asked int, own struct<{kinds}>"
    asked = own.mapInArrow(model.questions(extra), schema)
    counts = model.counts.select(F.lit(None).cast("string").alias("chunk"), "shard", "blob", *(F.lit(None).cast(t).alias(c) for c, t in asked.dtypes[3:]))
    answers = counts.unionAll(asked).repartitionById(model.shards, F.col("shard")).sortWithinPartitions("shard", F.col("chunk").asc_nulls_first()).mapInArrow(model.answers(), schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk, its answers first, in the order of shards."""
        now, sums, met = None, np.zeros(0), 0
        for batch in batches:
            chunk, at, blobs, asked = batch.column(0).to_pylist(), batch.column(3), batch.column(2), batch.column(6)
            rows, values = [], []
            for i, c in enumerate(chunk):
                if c != now:
                    now, sums, met = c, np.zeros(CHUNK_ROWS), 0
                if at[i].is_valid:
                    if asked[i].as_py() != met:
                        raise RuntimeError("a task that ran again read other rows than before: the documents' order is not fixed")
                    rows.append(i)
                    values.append(sums[at[i].as_py()])
                else:
                    met += 1
                    docs_, value = unpacked(blobs[i].as_py())
                    sums[docs_.astype(np.int64)] += value.view("<f4").astype(float)
            part = batch.take(pa.array(rows, pa.int64()))
            n = part.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                value = np.exp(-(part.column(5).to_numpy(zero_copy_only=False) + np.array(values)) / n)
            yield pa.record_batch({**{c: part.column(7).field(i) for i, c in enumerate(extra)}, "n_tokens": n, "perplexity": pa.array(value, mask=n == 0)})

    sorted_ = answers.repartition("chunk").sortWithinPartitions("chunk", F.col("at").asc_nulls_first(), "shard")
    result = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1])
    return sorted_.mapInArrow(add, f"{result}, n_tokens long, perplexity double")


def limits(scores: DataFrame, labels: DataFrame, quantile: float, least: int) -> tuple[DataFrame, float]:
    """Thresholds of the languages with enough held-out trusted documents, and the one of all."""
    held = scores.join(trusted_labels(labels).where("held"), "doc_id").where("perplexity is not null")
    at = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = held.groupBy(F.coalesce("lang", F.lit("")).alias("lang_key")).agg(at.alias("limit"), F.count("*").alias("n")).where(F.col("n") >= least).select("lang_key", "limit")
    every = held.agg(at).first()[0]
    return by_lang, float("inf") if every is None else float(every)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.975, least: int = 30, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, lang, n_tokens, perplexity, limit and kept, and the columns ``extra``."""
    model = fit_words(docs, labels)
    scores, parts = [], min(SCORED, model.shards)
    for part in range(parts):
        some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == part) if parts > 1 else docs
        scores.append(keep(perplexities(some, model, ["doc_id", "lang", *extra]), "perplexities", drop_shuffles=True))
    scores = reduce(DataFrame.unionAll, scores)
    for done in model.made:
        forget(done)
    by_lang, every = limits(scores, labels, quantile, least)
    keyed = scores.withColumn("lang_key", F.coalesce("lang", F.lit(""))).join(by_lang, "lang_key", "left")
    limit = F.coalesce("limit", F.lit(every))
    return keyed.select(*extra, "doc_id", "lang", "n_tokens", "perplexity", limit.alias("limit"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """``docs`` without the rejected rows, which are known by two hashes; columns of any name pass through."""
    names = [f"_keep_good_{i}" for i in range(len(docs.columns))]
    keys = ("_kg_1", "_kg_2")

    def keyed(d: DataFrame, at: dict[str, str]) -> list:
        return [F.xxhash64(*(at[c] for c in ("doc_id", "lang", "text"))).alias(keys[0]), F.xxhash64(F.lit(1), *(at[c] for c in ("text", "lang", "doc_id"))).alias(keys[1])]

    plain = docs.select("doc_id", "lang", "text", *keyed(docs, {c: c for c in ("doc_id", "lang", "text")}))
    verdict = classify(plain, labels, extra=keys, **settings)
    bad = verdict.where("not kept").select(*keys).distinct()
    own = docs.toDF(*names)
    return own.select("*", *keyed(own, dict(zip(docs.columns, names)))).join(bad, list(keys), "left_anti").drop(*keys).toDF(*docs.columns)
