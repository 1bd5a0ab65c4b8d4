"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are cut into overlapping word windows
(passages) with TF-IDF weights (the square of the inverse frequency) over the
benchmark's vocabulary.  A
randomised SVD of all benchmark and corpus passages gives a latent basis: each
worker multiplies its passages with a random matrix and back, only sums of
vocabulary size by ``rank`` are shuffled.  A candidate (passage, item) is a leak
if the longest common subsequence of words, in the passage and as many words
around it as the item has, covers ``cover`` of the item and
the item's answer, its last ``answer_words`` words, is there by half or more.

Candidates are the pairs of two searches:

* An exact bound: of a leaked item's ``n`` words ``need`` are there in order, so
  of its ``n - need + votes`` rarest ones at least ``votes`` are.  Every pair
  that keeps this is compared, so no leak is lost, whatever the corpus' size.
* The passages that share such a word with any item and whose latent cosine to
  an item reaches ``cosine``.  The cosine is over words of the vocabulary alone:
  what other words weigh depends on the number of documents.

Document frequencies and the basis count every passage of every row, and every
row is searched; only a caller that names ``fit_rows`` gets a basis of so many
documents, those of least id hash.  The benchmark is read in blocks of
``block_items`` items.  A block's index is all that the driver and a task hold,
so no size of the benchmark is assumed; each block costs a pass over the
documents for the numbers of their words, which are written once and read for
the frequencies and in each round of the basis, and a pass for the search.

Defined cases: null or wordless texts leak nothing and null or wordless items
are never found; items of fewer than ``min_words`` words must be there word by
word; equal items are all reported; repeated rows are handled alike; ids of
items may be of any type that sorts; very long texts are searched in whole; an
empty table of documents gives no rows, and an empty benchmark no leaks; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as tk
from .store import KEY, forget, keep, row_keys

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BITS = 20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, doc = tk.runs(_WORD[data], offsets)
    return tk.span_hash(tk.prefix_hash(data, lower=True), starts, ends), doc


class Vocabulary:
    """Numbers of known word hashes, 0 for others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.near = np.zeros(1 << _BITS, bool)
        self.near[(self.hashes >> tk.U64(64 - _BITS)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hashes) + 1

    def number(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int32)
        at = np.flatnonzero(self.near[(words >> tk.U64(64 - _BITS)).astype(np.int64)])
        if len(at) and len(self.hashes):
            n = np.minimum(np.searchsorted(self.hashes, words[at]), len(self.hashes) - 1)
            out[at] = np.where(self.hashes[n] == words[at], n + 1, 0)
        return out


def windows(doc: np.ndarray, step: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of ``blocks`` steps of words inside one document: first and last word, and document."""
    n = len(doc)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, n))
    each = np.maximum(1, -(-(count - step * blocks) // step) + 1)
    owner = np.repeat(np.arange(len(first)), each)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = first[owner] + k * step
    return start, np.minimum(start + step * blocks, first[owner] + count[owner]), doc[first[owner]]


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the groups of these sizes."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


@dataclass
class LeakIndex:
    vocabulary: Vocabulary
    idf: np.ndarray
    basis: np.ndarray  # vocabulary x rank
    item_ids: list
    items: list[np.ndarray]  # word hashes
    passages: np.ndarray  # latent unit vectors of the items' passages
    owner: np.ndarray  # their items
    least: np.ndarray  # cosine that each needs; a shorter item can fill less of a window
    step: int
    blocks: int
    cosine: float
    cover: float
    answer_words: int
    min_words: int
    frequency: np.ndarray  # documents of each vocabulary entry
    votes: int = 3

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float]]:
        """(document, item, share of the item that is covered), best per pair."""
        words, doc = words_of(data, offsets)
        number = self.vocabulary.number(words)
        start, end, whose = windows(doc, self.step, self.blocks)
        known_square = np.cumsum(np.concatenate([[0.0], np.where(number > 0, self.idf[number], 0).astype(np.float64) ** 2]))
        found: dict[tuple[int, int], float] = dict.fromkeys(self.short_runs(words, number, doc), 1.0)
        tried: set[tuple[int, int]] = set()

        def judge(window: int, item: int) -> None:
            if (int(start[window]), item) in tried:
                return
            tried.add((int(start[window]), item))
            d = int(whose[window])
            share = self.verify(item, words, doc, int(start[window]), int(end[window]))
            if share and share > found.get((d, item), 0):
                found[d, item] = share

        for window, item in self.bounded(number, doc, start, end, whose):
            judge(window, item)
        # A passage without an item's rare words holds no leak.
        rare = np.cumsum(np.concatenate([[0], self.rare_count[number] + self.short_count[number] > 0]))
        reach = max((len(x) for x in self.items), default=0)
        may = rare[np.minimum(end + reach, len(words))] > rare[np.maximum(start - reach, 0)]
        start, end, whose = start[may], end[may], whose[may]
        for at in range(0, len(start), 8192):
            s, e = start[at : at + 8192], end[at : at + 8192]
            length = e - s
            inside = np.repeat(s, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            row = np.repeat(np.arange(len(s)), length)
            known = number[inside] > 0
            inside, row = inside[known], row[known]
            cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            latent = np.zeros((len(s), self.basis.shape[1]), np.float32)
            latent[row[cut]] = np.add.reduceat(self.weighted[number[inside]], cut, axis=0)
            norm = np.sqrt(np.maximum(known_square[e] - known_square[s], 0)).astype(np.float32)
            near = latent @ self.passages.T
            rows, cols = np.nonzero((near >= norm[:, None] * self.least) & (norm > 0)[:, None])
            for r, item in {(r, int(self.owner[c])) for r, c in zip(rows.tolist(), cols.tolist())}:
                judge(at + r, item)
        return [(d, i, v) for (d, i), v in found.items()]

    def prepare(self) -> None:
        self.weighted = (self.basis * self.idf[:, None]).astype(np.float32)
        self.answers = [np.unique(item[-self.answer_words :]) for item in self.items]
        self.size = np.array([len(x) for x in self.items], np.int64)
        rare: list[tuple[int, int]] = []  # entry of the vocabulary, item
        short: list[tuple[int, int]] = []
        self.anchor = np.zeros(len(self.items), np.int64)
        self.runs = np.zeros((len(self.items), self.min_words), tk.U64)
        for i, item in enumerate(self.items):
            n, number = len(item), self.vocabulary.number(item)
            order = np.argsort(self.frequency[number], kind="stable")
            if 0 < n < self.min_words:
                self.anchor[i] = order[0]
                self.runs[i, :n] = item
                short.append((int(number[order[0]]), i))
            elif n:
                need = int(np.argmax(np.arange(n + 1) / n >= self.cover))
                rare += [(v, i) for v in np.unique(number[order[: n - need + self.votes]]).tolist()]
        self.least_votes = np.array([min(self.votes, int(np.argmax(np.arange(n + 1) / n >= self.cover))) if n else 1 for n in self.size.tolist()], np.int64)
        self.rare_count, self.rare_first, self.rare_items = self._lists(rare)
        self.short_count, self.short_first, self.short_items = self._lists(short)

    def _lists(self, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items by vocabulary entry: count, first place, items."""
        v, item = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        count = np.bincount(v, minlength=len(self.vocabulary))
        return count, np.cumsum(count) - count, item

    def short_runs(self, words: np.ndarray, number: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) of items under ``min_words`` that are there word by word."""
        hit = np.flatnonzero(self.short_count[number])
        each = self.short_count[number[hit]]
        item = self.short_items[np.repeat(self.short_first[number[hit]], each) + _within(each)]
        at = np.repeat(hit, each) - self.anchor[item]
        ok = (at >= 0) & (at + self.size[item] <= len(words))
        at, item = at[ok], item[ok]
        for k in range(self.min_words):
            ok = k >= self.size[item]
            spot = np.where(ok, at, at + k)
            ok |= (words[spot] == self.runs[item, k]) & (doc[spot] == doc[at])
            at, item = at[ok], item[ok]
        return list(set(zip(doc[at].tolist(), item.tolist())))

    def bounded(self, number: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, whose: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
        """(window, item) pairs with as many of the item's rarest words as a leak must have; about ``most`` hits at a time."""
        if not len(start) or not len(self.rare_items):
            return
        step, width, reach, n = self.step, self.step * self.blocks, int(self.size.max()), len(number)
        cost = np.cumsum(np.concatenate([[0], self.rare_count[number]]))
        until = cost[np.minimum(end + reach, n)]
        a = 0
        while a < len(start):
            lo = max(int(start[a]) - reach, 0)
            b = max(a + 1, int(np.searchsorted(until, cost[lo] + most, "right")))
            hi = min(int(end[b - 1]) + reach, n)
            hit = lo + np.flatnonzero(self.rare_count[number[lo:hi]])
            each = self.rare_count[number[hit]]
            item = self.rare_items[np.repeat(self.rare_first[number[hit]], each) + _within(each)]
            p = np.repeat(hit, each)
            first = np.searchsorted(whose, doc[p])
            last = np.searchsorted(whose, doc[p], "right") - 1
            away, size = p - start[first], self.size[item]
            # windows that reach the word with the item's length on both sides
            low = np.maximum(np.minimum(first + np.maximum((away - width - size) // step + 1, 0), last), a)
            high = np.minimum(np.minimum(first + (away + size) // step, last), b - 1)
            times = np.maximum(high - low + 1, 0)
            window = np.repeat(low, times) + _within(times)
            pair, votes = np.unique(window * len(self.items) + np.repeat(item, times), return_counts=True)
            window, item = np.divmod(pair, len(self.items))
            ok = votes >= self.least_votes[item]
            yield from zip(window[ok].tolist(), item[ok].tolist())
            a = b

    def verify(self, item: int, words: np.ndarray, doc: np.ndarray, start: int, end: int) -> float:
        own = self.items[item]
        d, n = doc[start], len(own)
        lo, hi = max(0, start - n), min(len(words), end + n)
        text = words[lo:hi][doc[lo:hi] == d]
        answer = self.answers[item]
        if np.isin(answer, text).sum() * 2 < len(answer):
            return 0.0
        share = common_subsequence(own, text) / n
        if n < self.min_words:
            runs = np.lib.stride_tricks.sliding_window_view(text, n) if len(text) >= n else np.zeros((0, n))
            return 1.0 if len(runs) and (runs == own).all(1).any() else 0.0
        return share if share >= self.cover else 0.0


def _texts(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return tk.utf8(pa.array(rows, pa.string()))


def _numbers(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows of some documents each: how many words they have, and the words' numbers."""
    width = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(0))
            for lo, hi, d, o in tk.blocks(data, offsets):
                words, doc = words_of(d, o)
                yield pa.record_batch({"length": [np.bincount(doc, minlength=hi - lo).astype("<i4").tobytes()], "number": [vocabulary.number(words).astype(width).tobytes()]})

    return keep(docs.select("text").mapInArrow(run, "length binary, number binary"), "word-numbers")


def _numbered(batch: pa.RecordBatch, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of each document and numbers of the words, of each row that ``_numbers`` made."""
    width = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
    for length, number in zip(batch.column(0), batch.column(1)):
        yield np.frombuffer(length.as_buffer(), "<i4").astype(np.int64), np.frombuffer(number.as_buffer(), width).astype(np.int64)


def _document_frequencies(numbers: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for length, number in _numbered(batch, vocabulary):
                n += len(length)
                known = number > 0
                df += np.bincount(np.unique(np.repeat(np.arange(len(length)), length)[known] * len(df) + number[known]) % len(df), minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.record_batch({"v": np.append(seen, -1), "n": np.append(df[seen], n)})

    counts = {r.v: r.n for r in numbers.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()}
    n = counts.pop(-1, 0) or 0
    return np.array([counts.get(v, 0) for v in range(len(vocabulary))], float), n


def _tfidf(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, idf: np.ndarray, step: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """Sparse unit rows: row, column, value; the number of rows and their documents."""
    words, doc = words_of(data, offsets)
    number = vocabulary.number(words)
    start, end, whose = windows(doc, step, blocks)
    length = end - start
    at = np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    row, col = np.repeat(np.arange(len(start)), length), number[at]
    norm = np.sqrt(np.bincount(row, idf[col] ** 2, minlength=len(start)))
    value = idf[col] / np.maximum(norm[row], 1e-12)
    known = col > 0
    return row[known], col[known], value[known].astype(np.float32), len(start), whose


def _there_and_back(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    """A'A x for sparse rows A."""
    out = np.zeros_like(x)
    if not len(row):
        return out
    cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    y = np.zeros((n, x.shape[1]), np.float32)
    y[row[cut]] = np.add.reduceat(x[col] * value[:, None], cut, axis=0)
    order = np.argsort(col, kind="stable")
    c = col[order]
    cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    out[c[cut]] = np.add.reduceat(y[row[order]] * value[order][:, None], cut, axis=0)
    return out


def _corpus_there_and_back(length: np.ndarray, number: np.ndarray, x: np.ndarray, idf: np.ndarray, usual: np.ndarray, step: int, blocks: int) -> tuple[np.ndarray, int]:
    """A'A x for the passages A of documents of these lengths, without the inverse frequencies on the left, and the number of passages.

    Passages are runs of ``blocks`` steps, so steps are multiplied once and
    passages are sums of them.  Words with a place in ``usual`` are counted in a
    dense matrix, others are added one by one.
    """
    length = length[length > 0]
    steps = -(-length // step)  # of each document
    n = int(steps.sum())
    out = np.zeros_like(x)
    if not n:
        return out, 0
    of_doc, k = np.repeat(np.arange(len(length)), length), _within(length)
    at = (np.cumsum(steps) - steps)[of_doc] + k // step
    known = np.flatnonzero(number)
    word, at_known = number[known], at[known]
    place = usual[word]
    dense = place >= 0
    width = int(usual.max()) + 1
    counts = np.bincount(at_known[dense] * width + place[dense], minlength=n * width).reshape(n, width).astype(np.float32)
    which = np.flatnonzero(usual >= 0)
    which = which[np.argsort(usual[which])]
    weighted = (x * idf[:, None]).astype(np.float32)
    sums = counts @ weighted[which]
    rest, at_rest = word[~dense], at_known[~dense]
    if len(rest):
        cut = np.flatnonzero(np.concatenate([[True], at_rest[1:] != at_rest[:-1]]))
        sums[at_rest[cut]] += np.add.reduceat(weighted[rest], cut, axis=0)
    square = np.bincount(at, idf[number].astype(np.float64) ** 2, minlength=n)
    # A document's passages begin at its steps but for the last ones.
    each = np.maximum(steps - blocks + 1, 1)
    first = np.repeat(np.cumsum(steps) - steps, each) + _within(each)
    last = np.repeat(np.cumsum(steps), each)
    total, norm = np.zeros((len(first), x.shape[1]), np.float32), np.zeros(len(first))
    for j in range(blocks):
        there = first + j < last
        total[there] += sums[first[there] + j]
        norm[there] += square[first[there] + j]
    total /= np.maximum(norm, 1e-24)[:, None]
    back = np.zeros_like(sums)
    for j in range(blocks):
        there = first + j < last
        back[first[there] + j] += total[there]  # no step twice: passages begin at different steps
    out[which] = counts.T @ back
    if len(rest):
        order = np.argsort(rest, kind="stable")
        c = rest[order]
        cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        out[c[cut]] += np.add.reduceat(back[at_rest[order]], cut, axis=0)
    return out, len(first)


def _basis(numbers: DataFrame, items: tuple[np.ndarray, np.ndarray], vocabulary: Vocabulary, idf: np.ndarray, frequency: np.ndarray, step: int, blocks: int, rank: int, rounds: int, corpus_share: float = 0.01) -> np.ndarray:
    """Right singular vectors of benchmark and corpus passages by randomised subspace iteration."""
    v = len(vocabulary)
    x = np.linalg.qr(np.random.default_rng(11).standard_normal((v, min(v, rank))))[0].astype(np.float32)
    own = _tfidf(*items, vocabulary, idf, step, blocks)
    usual = np.full(v, -1, np.int64)
    often = np.argsort(-frequency[1:], kind="stable")[:256] + 1
    usual[often] = np.arange(len(often))
    columns = [f"y{i}" for i in range(x.shape[1])]
    for _ in range(rounds if v > 1 else 0):

        def run(batches: Iterator[pa.RecordBatch], x: np.ndarray = x) -> Iterator[pa.RecordBatch]:
            total, rows = np.zeros(x.shape), 0
            for batch in batches:
                for length, number in _numbered(batch, vocabulary):
                    y, n = _corpus_there_and_back(length, number, x, idf, usual, step, blocks)
                    total += y
                    rows += n
            total *= idf[:, None]
            hit = np.flatnonzero(np.abs(total).sum(1))
            yield pa.record_batch({"v": np.append(hit, -1), **{c: np.append(total[hit, i], float(rows)) for i, c in enumerate(columns)}})
            tk.release()

        # Partial products meet by vocabulary entry; there are ``len(vocabulary)`` sums.
        table = numbers.mapInArrow(run, "v long, " + ", ".join(f"{c} double" for c in columns)).groupBy("v").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        ids, y = table["v"].to_numpy(), np.stack([table[c].to_numpy() for c in columns], 1)
        corpus = np.zeros_like(x)
        corpus[ids[ids >= 0]] = y[ids >= 0]
        rows = float(y[ids < 0].max()) if (ids < 0).any() else 0.0
        # The corpus turns the basis a little; at equal weight the benchmark's rare words would not be in it.
        bench = _there_and_back(*own[:4], x)
        x = np.linalg.qr(bench + corpus * (corpus_share * own[3] / rows if rows else 0.0))[0].astype(np.float32)
    return x


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = 48,
    step: int = 32,
    blocks: int = 2,
    cosine: float = 0.5,
    cover: float = 0.7,
    answer_words: int = 6,
    min_words: int = 8,
    fit_rows: int | None = None,
    rounds: int = 3,
    block_items: int = 2000,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document: the columns ``extra``, doc_id, item_ids (sorted), best cover and leaked.

    Each block of items is a pass of its own over the documents, with that
    block's index alone; what several passes find is joined by row.
    """
    docs = docs.select(*extra, "doc_id", "text")
    texts = benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text")
    rows = texts.toLocalIterator()
    sample = None
    if fit_rows is not None:
        ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))  # a row an id
    kind = benchmark.schema["item_id"].dataType
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema[:-1])

    def search(index: LeakIndex, at: DataFrame, fields: str) -> DataFrame:
        names, ids_of = at.columns[:-1], pa.list_(to_arrow_type(kind))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = replace(index)
            own.prepare()
            for batch in batches:
                items: list[set] = [set() for _ in range(len(batch))]
                best = np.zeros(len(batch))
                data, offsets = tk.utf8(batch.column(batch.num_columns - 1))
                for lo, _, d, o in tk.blocks(data, offsets):
                    for doc, item, share in own.search(d, o):
                        items[lo + doc].add(own.item_ids[item])
                        best[lo + doc] = max(best[lo + doc], share)
                yield pa.record_batch({**{c: batch.column(i) for i, c in enumerate(names)}, "item_ids": pa.array([sorted(x) for x in items], ids_of), "cover": best, "leaked": best > 0})

        return at.mapInArrow(run, f"{fields}item_ids array<{kind.simpleString()}>, cover double, leaked boolean")

    block = [r for _, r in zip(range(block_items), rows)]
    more = [r for _, r in zip(range(block_items), rows)]
    settings = (rank, step, blocks, cosine, cover, answer_words, min_words, rounds)
    if not more:
        return search(_index(docs, sample, block, *settings), docs, fields)
    found: DataFrame | None = None
    own = [f"_leaks{k}" for k in KEY]  # ``extra`` may have the plain names
    keyed = docs.select(*(c.alias(n) for c, n in zip(row_keys(), own)), *extra, "doc_id", "text")
    while block:
        part = search(_index(docs, sample, block, *settings), keyed.select(*own, "text"), "".join(f"{k} long, " for k in own)).where("leaked")
        part = keep(part.select(*own, "item_ids", "cover"), "leaks")
        found = part if found is None else found.unionAll(part)
        block, more = more, [r for _, r in zip(range(block_items), rows)]
    every = found.groupBy(*own).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("cover").alias("cover"))
    joined = keyed.drop("text").join(every, own, "left")
    none = F.array().cast(f"array<{kind.simpleString()}>")
    return joined.select(*extra, "doc_id", F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("cover", F.lit(0.0)).alias("cover"), F.col("cover").isNotNull().alias("leaked"))


def _index(docs: DataFrame, sample: DataFrame | None, block: list, rank: int, step: int, blocks: int, cosine: float, cover: float, answer_words: int, min_words: int, rounds: int) -> LeakIndex:
    """The index of some items; its basis is fitted on all of ``docs`` or on ``sample``."""
    data, offsets = _texts([r.text for r in block])
    words, doc = words_of(data, offsets)
    vocabulary = Vocabulary(words)
    numbers = _numbers(docs, vocabulary)
    df, n = _document_frequencies(numbers, vocabulary)
    idf = np.log((n + 1) / (df + 1)).clip(0.05).astype(np.float32)
    idf[0] = np.log(n + 2) * 0.7  # a word outside the benchmark
    idf **= 2  # rare words tell items apart, a language's common ones only tell languages
    fitted = numbers if sample is None else _numbers(sample, vocabulary)
    basis = _basis(fitted, (data, offsets), vocabulary, idf, df, step, blocks, rank, rounds)
    for done in {id(x): x for x in (numbers, fitted)}.values():
        forget(done)
    row, col, value, n_rows, whose = _tfidf(data, offsets, vocabulary, idf, step, blocks)
    latent = np.zeros((n_rows, basis.shape[1]), np.float32)
    np.add.at(latent, row, basis[col] * value[:, None])
    caught = np.linalg.norm(latent, axis=1)  # what the basis keeps of a passage; of its copy it keeps as much
    latent /= np.maximum(caught[:, None], 1e-9)
    start, end, _ = windows(doc, step, blocks)
    least = np.maximum(cosine * caught * np.sqrt((end - start) / (step * blocks)), 0.05).astype(np.float32)
    return LeakIndex(vocabulary, idf, basis, [r.item_id for r in block], [words[doc == i] for i in range(len(block))], latent, whose, least, step, blocks, cosine, cover, answer_words, min_words, df)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **settings: int | float) -> DataFrame:
    """``docs`` without the rows that leak, which two hashes tell apart, so ids may repeat or be null; columns of any name pass through."""
    names = [f"_remove_leaks_{i}" for i in range(len(docs.columns))]
    plain = docs.select("doc_id", "text", *row_keys())
    bad = find_leaks(plain, benchmark, extra=KEY, **settings).where("leaked").select(*KEY).distinct()
    own = docs.toDF(*names)
    at = dict(zip(docs.columns, names))
    return own.select("*", *row_keys(at["doc_id"], at["text"])).join(bad, list(KEY), "left_anti").drop(*KEY).toDF(*docs.columns)
