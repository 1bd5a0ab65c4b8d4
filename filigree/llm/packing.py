"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they lie; only piece lengths matter for packing,
and there are at most ``capacity`` different ones.  So the packing is solved
on the histogram of lengths: a bin *pattern* is a multiset of lengths with a
multiplicity, the histogram fits the driver whatever the corpus holds, and the
pieces of one length are then dealt to the pattern slots by rank.

The first solution is best fit decreasing.  A local search then moves lengths
between underfull bins (moves, one-for-one and two-for-one exchanges), always
from an emptier to a fuller bin so that the sum of squared fills grows, until
bins become empty or the lower bound is met.

Defined cases: a null or empty text is one piece, its end token; repeated rows
are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import spread_rank
from .store import keep

Pattern = tuple[int, ...]


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Patterns (lengths, largest first) and how many bins have each."""
    open_: dict[int, list[list]] = {capacity: []}  # room -> [pattern, bins]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in open_ if r >= length):
            groups = open_[room]
            each = room // length
            while groups and left:
                pattern, bins = groups.pop()
                full = min(bins, left // each)
                if full:
                    open_.setdefault(room - each * length, []).append([pattern + (length,) * each, full])
                    left -= full * each
                if full < bins:
                    rest = bins - full
                    if left:  # fewer than one bin takes
                        open_.setdefault(room - left * length, []).append([pattern + (length,) * left, 1])
                        left, rest = 0, rest - 1
                    if rest:
                        groups.append([pattern, rest])
            if not left:
                break
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                open_.setdefault(capacity - each * length, []).append([(length,) * each, full])
            if rest:
                open_.setdefault(capacity - rest * length, []).append([(length,) * rest, 1])
    out: dict[Pattern, int] = {}
    for groups in open_.values():
        for pattern, bins in groups:
            out[pattern] = out.get(pattern, 0) + bins
    return out


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and with lengths over half as they can't share."""
    best = -(-sum(s * n for s, n in histogram.items()) // capacity)
    for cut in range(1, capacity // 2 + 1):
        large = sum(n for s, n in histogram.items() if s > capacity - cut)
        middle = [(s, n) for s, n in histogram.items() if capacity // 2 < s <= capacity - cut]
        small = sum(s * n for s, n in histogram.items() if cut <= s <= capacity // 2)
        half = sum(n for _, n in middle)
        room = half * capacity - sum(s * n for s, n in middle)
        best = max(best, large + half + max(0, -(-(small - room) // capacity)))
    return best


def _exchange(donor: Pattern, taker: Pattern, room: int) -> tuple[int, Pattern, Pattern] | None:
    """The exchange that fills ``taker`` most: (gain, lengths to it, lengths back)."""
    best: tuple[int, Pattern, Pattern] | None = None
    for i, a in enumerate(donor):
        if i and donor[i - 1] == a:
            continue
        if a <= room and (best is None or a > best[0]):
            best = (a, (a,), ())
        for b in dict.fromkeys(taker):
            if 0 < a - b <= room and (best is None or a - b > best[0]):
                best = (a - b, (a,), (b,))
        for a2 in donor[i + 1 :]:
            for b in dict.fromkeys(taker):
                if 0 < a + a2 - b <= room and (best is None or a + a2 - b > best[0]):
                    best = (a + a2 - b, (a, a2), (b,))
        if best and best[0] == room:
            break
    return best


def _swap(pattern: Pattern, out: Pattern, into: Pattern) -> Pattern:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *into], reverse=True))


def local_search(patterns: dict[Pattern, int], capacity: int, bound: int, max_steps: int = 3000) -> dict[Pattern, int]:
    """Empty the emptiest bins by exchanges that increase the sum of squared fills."""
    patterns = dict(patterns)
    stuck: set[Pattern] = set()
    for _ in range(max_steps):
        if sum(patterns.values()) <= bound:
            break
        fills = sorted((sum(p), p) for p in patterns if sum(p) < capacity)
        donor = next((p for _, p in fills if p not in stuck), None)
        if donor is None:
            break
        found = None
        for fill, taker in reversed(fills):
            if fill < sum(donor):
                break
            if taker == donor and patterns[donor] < 2:
                continue
            move = _exchange(donor, taker, capacity - fill)
            if move and (found is None or move[0] > found[0][0]):
                found = (move, taker)
                if move[0] == capacity - fill:
                    break
        if not found:
            stuck.add(donor)
            continue
        (_, give, back), taker = found
        times = patterns[donor] // 2 if taker == donor else min(patterns[donor], patterns[taker])
        for p in (donor, taker):
            patterns[p] -= times
            if not patterns[p]:
                del patterns[p]
        for p in (_swap(donor, give, back), _swap(taker, back, give)):
            if p:
                patterns[p] = patterns.get(p, 0) + times
                stuck.discard(p)
                room = capacity - sum(p)
                stuck -= {d for d in stuck if sum(d) <= sum(p) and room and _exchange(d, p, room)}
    return patterns


def slots(patterns: dict[Pattern, int]) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first sequence, offset), sorted by length and rank."""
    out, first, base = [], {}, 0
    for pattern in sorted(patterns, reverse=True):
        bins, offset = patterns[pattern], 0
        for length in sorted(set(pattern), reverse=True):
            k = pattern.count(length)
            out.append((length, first.get(length, 0), k, base, offset))
            first[length] = first.get(length, 0) + k * bins
            offset += k * length
        base += bins
    return np.array(sorted(out), np.int64).reshape(-1, 5)


#: Texts whose words are not plain runs of Latin-1 letters and others: the tokenizer sees their words whole.
_SPECIAL = re.compile(r"['\u0100-\U0010ffff\u00aa\u00b5\u00ba\x00-\x08\x0e-\x1f\x7f-\xa0]|<\|")
_PIECE = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[^\sa-z\u00df-\u00f6\u00f8-\u00ff]+")
_LETTER = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]")


class WordIds:
    """Token ids of texts from a cache of words, as white space and changes between letters and others never join tokens.

    A worker keeps one for all its tasks; at ``limit`` words it starts anew.
    """

    _kept: dict[str, WordIds] = {}

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.full, self.limit = Tokenizer.from_file(path), limit
        self.model = self.full.model
        printable = {b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
        rest = (b for b in range(256) if b not in printable)
        self.bytes_as = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}  # byte-level alphabet
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _learn(self, words: list[str]) -> None:
        if len(self.words) > self.limit:
            self.words = {}
        others = []
        for w in dict.fromkeys(words):
            if w not in self.words:
                if _LETTER.match(w) and _PIECE.fullmatch(w):
                    raw = w if w.isascii() else w.encode().decode("latin-1").translate(self.bytes_as)
                    self.words[w] = np.array([t.id for t in self.model.tokenize(raw)], "<u4").tobytes()
                else:
                    others.append(w)
        for w, e in zip(others, self.full.encode_batch_fast(others, add_special_tokens=False)):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = re.split(r"[ \n]+", text) if _SPECIAL.search(text) else _PIECE.findall(text.lower())
        try:
            known = self.words
            return b"".join([known[w] for w in parts])
        except KeyError:
            self._learn(parts)
            known = self.words
            return b"".join([known[w] for w in parts])


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(path)
        end, whole = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            ids, rows = batch.column(0), {k: [] for k in ("at", "piece", "start", "length", "ids_crc32")}
            for at, text in enumerate(batch.column(1).to_pylist()):
                joined = words.ids(text or "") + end
                for piece, start in enumerate(range(0, len(joined), whole)):
                    cut = joined[start : start + whole]
                    for k, v in (("at", at), ("piece", piece), ("start", start // 4), ("length", len(cut) // 4), ("ids_crc32", zlib.crc32(cut))):
                        rows[k].append(v)
            at = pa.array(rows.pop("at"), pa.int64())
            yield pa.record_batch({"doc_id": ids.take(at), "piece": pa.array(rows["piece"], pa.int32()), **{k: pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")}})

    return run


def _deal(table: np.ndarray, wide: int):
    keys = table[:, 0] * wide + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run_ = table[np.searchsorted(keys, length * wide + rank, "right") - 1]
            step = rank - run_[:, 1]
            yield pa.record_batch(
                {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": run_[:, 3] + step // run_[:, 2], "offset": run_[:, 4] + step % run_[:, 2] * length}
            )

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, rows_per_part: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = keep(docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    total = sum(histogram.values())
    table = slots(local_search(best_fit_decreasing(histogram, capacity), capacity, lower_bound(histogram, capacity))) if histogram else np.zeros((1, 5), np.int64)
    ranked = spread_rank(pieces, "length", F.xxhash64("doc_id", "piece"), ["doc_id", "piece", "ids_crc32"], max(8, -(-total // rows_per_part)))
    return ranked.mapInArrow(_deal(table, total + 1), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
