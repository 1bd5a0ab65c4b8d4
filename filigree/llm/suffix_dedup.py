"""Suffix-array deduplication: remove every byte covered by a long string that occurs twice.

Plan
----
1. Each window of ``length`` bytes names one *anchor*, its leftmost ``k``-gram
   of least hash.  Equal windows name equal anchors at equal offsets, so the
   windows that share an anchor occurrence form one short *context* and only
   contexts with equal anchor hashes need to be compared.  One row an anchor
   (about ``2 / (length - k)`` of the bytes) is shuffled, never the windows.
2. Anchors that occur once are dropped.  Where all contexts of an anchor are
   equal, all their windows repeat.  Of the others one *representative* of
   every distinct context, with its count, is cut into bins of ``bin_width``
   window starts; windows of a bin share a core of ``length - bin_width + 1``
   bytes, which becomes one symbol.
3. The strings of a bin are suffix-sorted by the linear grouping construction
   (:func:`suffix_array`).  A window repeats where its suffix agrees with a
   neighbour in suffix order for a whole window, or where its string has a
   count of two or more.
4. Bins with more than ``hot_strings`` distinct strings would not fit a task;
   their windows are counted one by one with map-side combining instead, which
   splits any hot group and gives the same rows.

Defined cases: a null or short text has no windows and stays as it is;
repeated rows count as copies of one another; windows never cross documents;
``doc_id`` may be null or repeated; very long texts are read by segments that
overlap by a window; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import keep, row_keys

ROW = ("rk", "rk2")

_LOW = 21  # bits of a key that hold the position, so that ties go to the leftmost
_SEGMENT = 1 << 20


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last symbol must be its only smallest.

    Phase one keeps suffixes in ordered groups and visits the groups from the
    last to the first.  Every suffix of the visited group points to its
    previous smaller suffix; the targets are moved behind their own group, by
    how many pointers they got, so that groups end up as the runs of one
    Lyndon prefix.  Phase two goes through the groups once in ascending order:
    each suffix that is emitted fixes its left neighbour and the neighbour's
    chain of pointers.  Nothing is renamed and nothing recurses.
    """
    n = len(text)
    symbols = np.asarray(text)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.ones(n, bool)
    first[1:] = ranked[1:] != ranked[:-1]
    begins = np.flatnonzero(first)
    starts = begins[np.cumsum(first) - 1]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group_of = np.empty(n, np.int64)
    group_of[order] = starts
    limit = np.zeros(n, np.int64)
    limit[begins] = np.append(begins[1:], n)
    row, place, group, limit = order.tolist(), place.tolist(), group_of.tolist(), limit.tolist()
    smaller = [-1] * n

    top = n
    while top:
        start = group[row[top - 1]]
        pointed: dict[int, int] = {}
        members = row[start:top]
        if len(members) > 1:
            members.sort()
        for s in members:
            j = s - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[s] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        top = start
        if not pointed:
            continue
        most = max(pointed.values())
        if most == 1:
            levels = [list(pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, c in pointed.items():
                by_count.setdefault(c, []).append(p)
            levels = [by_count[c] for c in sorted(by_count, reverse=True)]
        for targets in levels:
            moved: dict[int, int] = {}
            for p in targets:
                g = group[p]
                m = moved.get(g, 0) + 1
                moved[g] = m
                to, at = limit[g] - m, place[p]
                q = row[to]
                row[to], row[at] = p, q
                place[p], place[q] = to, at
            for p in targets:
                g = group[p]
                group[p] = limit[g] - moved[g]
            for g, m in moved.items():
                cut = limit[g] - m
                if cut != g:
                    limit[cut] = limit[g]
                    limit[g] = cut

    out, free, placed = [0] * n, list(range(n)), [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
    return out


def repeated_starts(strings: list[tuple[bytes, bytes]], core: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """For strings left + core + right: rows (first, last) of the repeated windows by start, or (-1, -1).

    ``core`` numbers the core symbols.  A window is ``width`` symbols that hold
    the core; equal windows of two strings, or any window of a string of
    weight two or more, repeat.
    """
    lengths = np.array([len(a) + len(b) + 2 for a, b in strings], np.int64)
    left = np.array([len(a) for a, _ in strings], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    # 0 ends the text, 1 ends a string, 2-257 are bytes, further symbols are cores.
    raw = np.frombuffer(b"".join(a + b"\0" + b + b"\0" for a, b in strings), np.uint8)
    text = raw.astype(np.int64) + 2
    text[offsets[:-1] + left] = core + 258
    text[offsets[1:] - 1] = 1
    n = len(text)
    order = np.asarray(suffix_array([*text.tolist(), 0]), np.int64)
    padded = np.concatenate([text, np.zeros(width + 1, np.int64)])
    same = np.ones(n, bool)
    for k in range(width):
        column = padded[order + k]
        same &= column[1:] == column[:-1]
    twice = np.zeros(n + 1, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    owner = np.repeat(np.arange(len(strings)), lengths)
    at = np.arange(n) - offsets[owner]
    window = (at <= left[owner]) & (at + width <= lengths[owner] - 1)
    found = np.flatnonzero(window & (twice[:n] | (weight[owner] > 1)))
    out = np.full((len(strings), 2), -1, np.int64)
    if len(found):
        rows, begin = np.unique(owner[found], return_index=True)
        out[rows, 0] = at[found[begin]]
        out[rows, 1] = at[found[np.append(begin[1:], len(found)) - 1]]
    return out


def _slide_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def _contexts(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, context hash, document, first window start, further starts, anchor offset."""
    low = tk.U64((1 << _LOW) - 1)
    for seg in range(0, max(1, len(data)), _SEGMENT):
        part = data[seg : seg + _SEGMENT + length - 1]
        m = len(part) - length + 1
        if m <= 0:
            continue
        prefix = tk.prefix_hash(part)
        grams = np.arange(len(part) - k + 1)
        h = tk.span_hash(prefix, grams, grams + k)
        chosen = (_slide_min((h & ~low) | grams.astype(tk.U64), length - k + 1) & low).astype(np.int64)
        doc = np.searchsorted(offsets, np.arange(seg, seg + m), "right") - 1
        starts = np.flatnonzero(np.arange(seg, seg + m) + length <= offsets[doc + 1])
        if not len(starts):
            continue
        anchor = chosen[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(fresh)
        lo, hi, p = starts[at], starts[np.append(at[1:], len(starts)) - 1], anchor[at]
        context = tk.mix(tk.span_hash(prefix, lo, hi + length) + (p - lo).astype(tk.U64))
        yield h[p], context, doc[lo], lo + seg - offsets[doc[lo]], hi - lo, p - lo


def _anchor_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk, rk2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = tk.utf8(batch.column(2))
            for first, last, d, o in tk.blocks(data, offsets):
                for h, t, doc, lo, span, off in _contexts(d, o, length, k):
                    yield pa.record_batch(
                        {"h": h.view(np.int64), "t": t.view(np.int64), "rk": rk[first:last][doc], "rk2": rk2[first:last][doc], "lo": lo.astype(np.int64), "span": span.astype(np.int32), "off": off.astype(np.int32)}
                    )

    return run


def _bin_rows(length: int, b: int):
    """Cut representatives into bins: hash of bin and core, id of the context, count, largest offset, left and right bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(0))
            lists = batch.column(1)
            flat = lists.flatten()
            counts = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            tid, n, h, lo, span, off = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            bounds = np.concatenate([[0], np.cumsum(counts)])
            for first, last, d, o in tk.blocks(data, offsets):
                reps = np.arange(bounds[first], bounds[last])
                if not len(reps):
                    continue
                base = np.repeat(o[:-1], counts[first:last])
                low, high = (off[reps] - span[reps]) // b, off[reps] // b
                each = high - low + 1
                r = np.repeat(np.arange(len(reps)), each)
                cell = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each) + low[r]
                p = (base + lo[reps] + off[reps])[r]
                o_hi = np.minimum(off[reps][r], cell * b + b - 1)
                o_lo = np.maximum((off[reps] - span[reps])[r], cell * b)
                core, core_end = p - cell * b, p - cell * b - (b - 1) + length
                g = tk.mix(tk.mix(h[reps][r].view(tk.U64) + cell.astype(tk.U64)) + tk.span_hash(tk.prefix_hash(d), core, core_end))
                raw = d.tobytes()
                yield pa.record_batch(
                    {
                        "g": g.view(np.int64),
                        "tid": tid[reps][r],
                        "n": n[reps][r],
                        "o_hi": o_hi.astype(np.int32),
                        "lhs": pa.array([raw[x:y] for x, y in zip((p - o_hi).tolist(), core.tolist())], pa.binary()),
                        "rhs": pa.array([raw[x:y] for x, y in zip(core_end.tolist(), (p - o_lo + length).tolist())], pa.binary()),
                    }
                )

    return run


def _sort_bins(b: int, symbols: int = 150_000):
    def run(table: pa.Table) -> pa.Table:
        g = table["g"].to_numpy()
        order = np.argsort(g, kind="stable")
        tid, weight, o_hi = table["tid"].to_numpy()[order], table["n"].to_numpy()[order], table["o_hi"].to_numpy()[order]
        lhs, rhs = table["lhs"].to_pylist(), table["rhs"].to_pylist()
        strings = [(lhs[i], rhs[i]) for i in order.tolist()]
        core = np.unique(g[order], return_inverse=True)[1]
        found, at, per = [], 0, max(1, symbols // (2 * b))
        while at < len(strings):
            end = min(at + per, len(strings))
            while end < len(strings) and core[end] == core[end - 1]:
                end += 1
            found.append(repeated_starts(strings[at:end], core[at:end] - core[at], weight[at:end], b))
            at = end
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        hit = found[:, 0] >= 0
        return pa.table({"tid": tid[hit], "o_hi": (o_hi[hit] - found[hit, 0]).astype(np.int32), "o_lo": (o_hi[hit] - found[hit, 1]).astype(np.int32)})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each document's intervals and drop what they cover."""
    for batch in batches:
        data, offsets = tk.utf8(batch.column(1))
        raw = data.tobytes()
        lists = batch.column(2)
        counts = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
        flat = lists.flatten()
        begin, end = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        kept, spans = [], []
        for i in range(len(batch)):
            text = raw[offsets[i] : offsets[i + 1]]
            own: list[dict[str, int]] = []
            if counts[i]:
                s, e = begin[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]]
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                fresh = np.ones(len(s), bool)
                fresh[1:] = s[1:] > e[:-1]
                at = np.flatnonzero(fresh)
                pairs = list(zip(s[at].tolist(), e[np.append(at[1:], len(s)) - 1].tolist()))
                own = [{"start": x, "end": y} for x, y in pairs]
                edges = [0, *(z for pair in pairs for z in pair), len(text)]
                text = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
            kept.append(text)
            spans.append(own)
        yield pa.record_batch(
            {
                "doc_id": batch.column(0),
                "n_bytes": np.diff(offsets),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary()),
            }
        )


def _key() -> list[Column]:
    return [c.alias(n) for c, n in zip(row_keys(), ROW)]


def remove_repeats(docs: DataFrame, length: int = 200, k: int = 40, bin_width: int = 16, hot_strings: int = 4096, bucket_strings: int = 20_000) -> DataFrame:
    """Per document: doc_id, n_bytes, removed spans (byte offsets, end exclusive) and the bytes that stay."""
    if not 1 < bin_width <= k < length:
        raise ValueError("1 < bin_width <= k < length must hold")
    spark = docs.sparkSession
    b = bin_width
    texts = docs.select(*_key(), "text").where(F.octet_length("text") >= length)
    anchors = texts.mapInArrow(_anchor_rows(length, k), "h long, t long, rk long, rk2 long, lo long, span int, off int")

    groups = anchors.groupBy("h").agg(F.count("*").alias("c"), F.min("t").alias("t0"), F.max("t").alias("t1")).where("c > 1").select("h", (F.col("t0") == F.col("t1")).alias("full"))
    # Written first: both sides of the join are then plain exchanges, and one hot anchor's rows can be split.
    groups = keep(groups, "groups")
    members = keep(anchors.join(groups, "h").select("h", F.xxhash64("h", "t").alias("tid"), *ROW, "lo", "span", "off", "full"), "members")

    reps = members.where("not full").groupBy("tid").agg(F.count("*").alias("n"), F.min_by(F.struct(*ROW, "h", "lo", "span", "off"), F.struct(*ROW, "lo")).alias("at"))
    by_doc = reps.groupBy(*(F.col(f"at.{c}").alias(c) for c in ROW)).agg(F.collect_list(F.struct("tid", "n", "at.h", "at.lo", "at.span", "at.off")).alias("reps"))
    bins = keep(
        docs.select(*_key(), "text").join(by_doc, list(ROW)).select("text", "reps").mapInArrow(_bin_rows(length, b), "g long, tid long, n long, o_hi int, lhs binary, rhs binary"),
        "bins",
    )
    sizes = keep(bins.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("c")).where("c > 1").select("g", "m"), "sizes")
    shared = bins.join(sizes, "g")
    n_buckets = max(1, bins.count() // bucket_strings)
    sorted_ = shared.where(F.col("m").between(1, hot_strings)).select(F.pmod("g", F.lit(n_buckets)).alias("bucket"), "g", "tid", "n", "o_hi", "lhs", "rhs")
    # Sorting costs far more than its bytes tell: as many tasks as buckets, up to a limit.
    sorted_ = sorted_.repartition(min(n_buckets, 20_000), "bucket").groupBy("bucket").applyInArrow(_sort_bins(b), "tid long, o_hi int, o_lo int")
    # One row a window; its bytes around the core are its offset and its text at once.
    skip = F.explode(F.expr(f"sequence(0, octet_length(lhs) + octet_length(rhs) - {b - 1})")).alias("skip")
    windows = (
        shared.where(F.col("m") > hot_strings)
        .select("g", "tid", "n", "o_hi", "lhs", "rhs", skip)
        .select(
            "tid",
            "n",
            (F.col("o_hi") - F.col("skip")).alias("o"),
            F.expr(f"xxhash64(g, octet_length(lhs) - skip, substring(lhs, skip + 1), substring(rhs, 1, {b - 1} - octet_length(lhs) + skip))").alias("w"),
        )
    )
    twice = windows.groupBy("w").agg(F.sum("n").alias("c")).where("c > 1").select("w")
    counted = windows.join(twice, "w", "left_semi").select("tid", F.col("o").cast("int").alias("o_hi"), F.col("o").cast("int").alias("o_lo"))
    found = keep(sorted_.unionByName(counted).groupBy("tid").agg(F.max("o_hi").alias("o_hi"), F.min("o_lo").alias("o_lo")), "found")

    anchor = F.col("lo") + F.col("off")
    spans = (
        members.where("full")
        .select(*ROW, F.col("lo").alias("start"), (F.col("lo") + F.col("span") + length).alias("end"))
        .unionByName(members.where("not full").join(found, "tid").select(*ROW, (anchor - F.col("o_hi")).alias("start"), (anchor - F.col("o_lo") + length).alias("end")))
    )
    # as a set: equal rows have equal spans, and a row that is there a million times needs them once
    listed = spans.groupBy(*ROW).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = docs.select(*_key(), "doc_id", "text").join(listed, list(ROW), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, spans array<struct<start: bigint, `end`: bigint>>, kept binary")
