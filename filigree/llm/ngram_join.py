"""N-gram Jaccard join by a size-aware heavy-light scheme.

A document is its set of distinct word shingles; equal sets form one class,
and all further work is on one class each.  Two classes link when their
Jaccard similarity is at least 4/5 (``100 * both >= 80 * either``).

* Light sets (at most ``boundary`` shingles): every subset of the size that a
  partner of given size must share is enumerated.  Sets with a subset in
  common are linked by construction, so a star per subset suffices.
* Heavy sets: inverted lists over the sets' prefixes in one global order;
  lists known to be long are scanned in parts of about ``list_rows`` members.
  Shingles found often come last in it (a bounded table of counts), so that
  common passages stay out of prefixes.  A list is scanned in order of size:
  each member is paired with the one before it; then, where a list still holds
  several components, with ``lags`` others in a hashed order.  After that only
  pairs of one list that lie in different components are still compared.  No
  link that could join two components is left out, and large groups of near
  copies never meet all pairs.
* The boundary is where the estimated rows of both schemes, from the histogram
  of sizes, are least.

Candidates pass bounds that lose nothing, by size, position, parity maps (two
sets differ in as many shingles at least as their maps do in bits) and bin
counts, before their texts are fetched and compared exactly.

Defined cases: without words the set is empty and the document stands alone;
with fewer words than ``width`` the whole sequence is one shingle; repeated
rows and equal texts share a class; a null id takes part in links but never
names a component, unless all ids are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .store import KEY, forget, keep, let_go, row_keys

BINS = 256
#: Members of an inverted list that one task scans; the lists of shingles that are known to have more are split.
LIST_ROWS = 50_000
WORDS = 8  # of 64 bits, of a set's parity map
MAP = [f"m{i}" for i in range(WORDS)]


def needed(a: int, b: int) -> int:
    """Shingles that sets of sizes a and b must share: both >= 4/5 (a + b - both)."""
    return -(-4 * (a + b) // 9)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def partners(a: int, most: int) -> range:
    return range(-(-4 * a // 5), min(most, 5 * a // 4) + 1)


def light_rows(a: int, boundary: int) -> int:
    return sum(math.comb(a, needed(a, b)) for b in partners(a, boundary))


def choose_boundary(histogram: dict[int, int], most: int = 24, scan: float = 2.0) -> int:
    """Largest light size, by the rows that both schemes would shuffle and scan."""

    def cost(x: int) -> float:
        light = sum(n * light_rows(a, x) for a, n in histogram.items() if a <= x)
        heavy = sum(n * (1 + scan) * int(prefix_length(np.int64(a))) for a, n in histogram.items() if 5 * a >= 4 * (x + 1))
        return light + heavy

    return min(range(most + 1), key=lambda x: (cost(x), x))


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their documents, and the documents' counts."""
    n = len(offsets) - 1
    _, _, doc, h = tk.lower_words(data, offsets)
    values, owner = tk.distinct_by_doc(*tk.shingle_hashes(h, doc, n, width))
    return values, owner, np.bincount(owner, minlength=n)


def _frequent(width: int, local: int, chunk: int = 3_000_000):
    """Shingles that a task meets in ``local`` documents or more, a chunk at a time."""

    def count(parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(parts))
        at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        n = np.diff(np.append(at, len(values)))
        often = n >= local
        return pa.record_batch({"g": values[at][often].view(np.int64), "n": n[often]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            data, offsets = tk.utf8(batch.column(0))
            for _, _, d, o in tk.blocks(data, offsets):
                parts.append(sets_of(d, o, width)[0])
                size += len(parts[-1])
                if size >= chunk:
                    yield count(parts)
                    parts, size = [], 0
        if size:
            yield count(parts)

    return run


def _signatures(width: int, frequent: np.ndarray, counts: np.ndarray, list_rows: int):
    """Per document: id, row key, set size, class, bin counts and ordered prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(2))
            for lo, hi, d, o in tk.blocks(data, offsets):
                values, owner, n = sets_of(d, o, width)
                begin = np.concatenate([[0], np.cumsum(n)])
                full = n > 0
                total = np.zeros(hi - lo, tk.U64)
                if len(values):
                    total[full] = np.add.reduceat(tk.mix(values ^ tk.U64(0x5851F42D4C957F2D)), begin[:-1][full])
                cid = tk.mix(total + n.astype(tk.U64))
                bins = np.bincount(owner * BINS + (values >> tk.U64(56)).astype(np.int64), minlength=(hi - lo) * BINS)
                bins = np.minimum(bins, 255).astype(np.uint8).tobytes()
                odd = np.bincount(owner * 64 * WORDS + (values >> tk.U64(8)).astype(np.int64) % (64 * WORDS), minlength=(hi - lo) * 64 * WORDS) & 1
                parity = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, WORDS)
                rank = np.zeros(len(values), np.int64)
                if len(frequent) and len(values):
                    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                    rank = np.where(frequent[at] == values, counts[at], 0)
                order = np.lexsort((values, rank, owner))
                ordered = values[order].view(np.int64)
                place = np.arange(len(values)) - begin[:-1][owner]
                head = place < prefix_length(n)[owner]
                length = np.where(full, prefix_length(n), 0)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(lo, hi - lo),
                        "rk": batch.column(1).slice(lo, hi - lo),
                        "n": n.astype(np.int64),
                        "cid": cid.view(np.int64),
                        **{c: np.ascontiguousarray(parity[:, i]) for i, c in enumerate(MAP)},
                        "bins": pa.array([bins[i * BINS : (i + 1) * BINS] if n[i] else None for i in range(hi - lo)], pa.binary()),
                        "prefix": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), ordered[head]),
                        "lists": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), (rank[order][head] // list_rows + 1).astype(np.int32)),
                    }
                )

    return run


def _subsets(boundary: int, width: int):
    """Light sets: a row for each subset that a partner of each size would share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            keys, cids, sizes, small = [], [], [], []
            for lo, _, d, o in tk.blocks(data, offsets):
                values, _, n = sets_of(d, o, width)
                begin = np.concatenate([[0], np.cumsum(n)])
                mixed = tk.mix(values + tk.U64(77))
                for i in np.flatnonzero((n > 0) & (n <= boundary)).tolist():
                    own, a = mixed[begin[i] : begin[i + 1]], int(n[i])
                    total = own.sum(dtype=tk.U64)
                    for b in partners(a, boundary):
                        gone = list(combinations(range(a), a - needed(a, b)))
                        left = total - own[np.array(gone, np.int64)].sum(axis=1, dtype=tk.U64) if gone and gone[0] else np.array([total])
                        keys.append(tk.mix(left + tk.U64(min(a, b) * 64 + max(a, b))).view(np.int64))
                        cids += [batch.column(0)[lo + i].as_py()] * len(left)
                        sizes += [a] * len(left)
                        small += [min(a, b)] * len(left)
            yield pa.record_batch({"key": np.concatenate(keys) if keys else np.zeros(0, np.int64), "cid": pa.array(cids, pa.int64()), "n": pa.array(sizes, pa.int64()), "least": pa.array(small, pa.int64())})

    return run


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bins allow the overlap they need; a full bin counts as unbounded."""
    for batch in batches:
        if not len(batch):
            continue
        n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bins_a", "bins_b"))
        least = np.minimum(a, b)
        ok = (least == 255).any(1) | (9 * least.sum(1, dtype=np.int64) >= 4 * n)
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(ok))


def _linked(width: int):
    """Pairs of texts that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep_row = np.zeros(len(batch), bool)
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sides = []
                for c in ("text_a", "text_b"):
                    data, offsets = tk.utf8(part.column(part.schema.get_field_index(c)))
                    values, _, n = sets_of(data, offsets, width)
                    sides.append((values, np.concatenate([[0], np.cumsum(n)])))
                (va, ba), (vb, bb) = sides
                for i in range(len(part)):
                    x, y = va[ba[i] : ba[i + 1]], vb[bb[i] : bb[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep_row[at + i] = 100 * both >= 80 * (len(x) + len(y) - both)
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep_row))

    return run


def _near(n_a: Column, p_a: Column, n_b: Column, p_b: Column) -> Column:
    """Size and position bounds of a pair that shares a prefix shingle.

    At the first shingle that two sets share, all they share is still to come;
    a pair that links passes there, whatever its later shared shingles say.
    """
    rest = F.least(n_a - p_a, n_b - p_b)
    return (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)) & (9 * rest >= 4 * (n_a + n_b))


def _alike(a: str, b: str) -> Column:
    """Parity maps of two sets allow the overlap they need; ``a`` and ``b`` end the columns' names."""
    apart = sum((F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in MAP), F.lit(0))
    return F.col(f"n{a}") + F.col(f"n{b}") >= 9 * apart


def _key() -> Column:
    return F.struct(*row_keys()).alias("rk")


class _Texts:
    """Bin counts and texts of classes, one document each."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int):
        self.docs, self.classes, self.width, self.used = docs, classes, width, []

    def links(self, pairs: DataFrame) -> DataFrame:
        side = lambda c, *cols: self.classes.select(F.col("cid").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in cols))
        bounded = pairs.join(side("a", "n", "bins", "rk"), "a").join(side("b", "n", "bins", "rk"), "b")
        likely = keep(bounded.select("a", "b", "n_a", "n_b", "bins_a", "bins_b").mapInArrow(_possible, "a long, b long"), "likely")
        used = likely.select(F.col("a").alias("cid")).unionAll(likely.select(F.col("b").alias("cid"))).distinct()
        texts = self.docs.select(_key(), "text").join(self.classes.join(used, "cid").select("cid", "rk"), "rk").groupBy("cid").agg(F.first("text").alias("text"))
        one = lambda c: texts.select(F.col("cid").alias(c), F.col("text").alias(f"text_{c}"))
        self.used.append(likely)
        return likely.join(one("a"), "a").join(one("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_linked(self.width), "a long, b long")


def _split(seed: int) -> Column:
    """The part of its list that a member is scanned in."""
    return F.pmod(F.xxhash64("cid", F.lit(seed + 7)), F.col("k"))


def _open(entries: DataFrame, parts: DataFrame, maps: DataFrame) -> DataFrame:
    """Entries of the lists that hold several components, with their component and parity map."""
    placed = entries.join(parts, F.col("cid") == F.col("node"), "left").select("g", "k", "cid", "n", "p", F.coalesce("component", "cid").alias("part"))
    placed = keep(placed, "placed")
    mixed = placed.groupBy("g").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("g")
    out = keep(placed.join(mixed, "g", "left_semi").join(maps, "cid").select("g", "k", "cid", "n", "p", "part", *MAP), "open")
    forget(placed)
    return out


def jaccard_join(docs: DataFrame, width: int = 5, local: int = 4, frequent_limit: int = 1 << 17, boundary: int | None = None, lags: int = 4, list_rows: int = LIST_ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id, and component_id, the least doc_id that links lead to."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # An order of shingles: any is right, one that puts frequent ones last is fast.
    often = docs.select("text").mapInArrow(_frequent(width, local), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(frequent_limit).toArrow()
    frequent, counts = often["g"].to_numpy().view(tk.U64), often["n"].to_numpy()
    order = np.argsort(frequent)
    sets = keep(
        docs.select("doc_id", _key(), "text").mapInArrow(_signatures(width, frequent[order], counts[order], list_rows), f"doc_id {kind}, rk struct<{KEY[0]}: bigint, {KEY[1]}: bigint>, n long, cid long, {', '.join(f'{c} long' for c in MAP)}, bins binary, prefix array<long>, lists array<int>"),
        "sets",
    )
    grouped = sets.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first_doc"), F.min("n").alias("n"), F.min("rk").alias("rk"), F.min_by("bins", "rk").alias("bins"), F.min_by(F.struct("prefix", "lists"), "rk").alias("at"))
    if boundary is None:
        histogram = {r.n: r.c for r in sets.where("n between 1 and 64").groupBy("n").agg(F.countDistinct("cid").alias("c")).collect()}  # 64 rows at most
        boundary = choose_boundary(histogram)
    classes = sets.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first_doc"), F.min("n").alias("n"), F.min("rk").alias("rk"), *(F.first(c).alias(c) for c in MAP), F.min_by("bins", "rk").alias("bins"))
    classes = keep(classes, "classes")
    let_go(docs.sparkSession)
    texts = _Texts(docs, classes, width)

    links, made = [], []
    if boundary:
        light = docs.select(_key(), "text").where(F.octet_length("text") > 0).join(classes.where(F.col("n") <= boundary).select("cid", "rk"), "rk")
        rows = keep(light.select("cid", "text").mapInArrow(_subsets(boundary, width), "key long, cid long, n long, least long"), "subsets")
        # A set of the smaller size is linked with every set that has the subset.
        centres = rows.where("n = least").groupBy("key").agg(F.min("cid").alias("b"))
        made.append(rows)
        links.append(rows.join(centres, "key").where("cid <> b").select(F.col("cid").alias("a"), "b"))

    entries = grouped.where(5 * F.col("n") >= 4 * (boundary + 1)).select("cid", "n", F.posexplode(F.arrays_zip(F.col("at.prefix").alias("prefix"), F.col("at.lists").alias("lists"))).alias("p", "e")).select("cid", "n", "p", F.col("e.prefix").alias("g"), F.col("e.lists").alias("k"))
    by_size = Window.partitionBy("g", _split(0)).orderBy("n", "cid")
    entry = F.struct("cid", "n", "p")
    scanned = entries.select("g", "k", "cid", "n", "p", F.lag(entry).over(by_size).alias("before"), F.lead("cid").over(by_size).alias("after"))
    lists = keep(scanned.where("before is not null or after is not null or k > 1").select("g", "k", "cid", "n", "p", "before"), "lists")
    heavy = F.greatest("n_a", "n_b") > boundary
    first = (
        lists.where("before is not null")
        .select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("p").alias("p_a"), F.col("before.cid").alias("b"), F.col("before.n").alias("n_b"), F.col("before.p").alias("p_b"))
        .where(heavy & _near(F.col("n_a"), F.col("p_a"), F.col("n_b"), F.col("p_b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    first = keep(first, "first")
    links.append(texts.links(first))
    found = links[0]
    for more in links[1:]:
        found = found.unionAll(more)
    found = keep(found, "found")
    for done in made:
        forget(done)
    parts = keep(components(found), "parts")

    # Lists that still hold several components: meet some of another component, then compare across.
    maps = classes.select("cid", *MAP)
    open_ = _open(lists.select("g", "k", "cid", "n", "p"), parts, maps)
    forget(lists)
    let_go(docs.sparkSession)
    shuffled = Window.partitionBy("g", _split(1)).orderBy(F.xxhash64("cid", F.lit(1)), "cid")
    row = F.struct("cid", "n", "p", "part", *MAP)
    met = open_.select(row.alias("x"), F.array(*(F.lag(row, k).over(shuffled) for k in range(1, lags + 1))).alias("ys")).select("x", F.explode(F.filter("ys", lambda y: y["part"] != F.col("x.part"))).alias("y"))
    met = met.select(*(F.col(f"x.{c}").alias(f"{c}_a") for c in ("cid", "n", "p", *MAP)), *(F.col(f"y.{c}").alias(f"{c}_b") for c in ("cid", "n", "p", *MAP)))
    near = heavy & _near(F.col("n_a"), F.col("p_a"), F.col("n_b"), F.col("p_b")) & _alike("_a", "_b")
    pair = [F.greatest("cid_a", "cid_b").alias("a"), F.least("cid_a", "cid_b").alias("b")]
    second = keep(met.where(near).select(*pair).distinct().join(first, ["a", "b"], "left_anti"), "second")
    bridges = keep(texts.links(second), "bridges")
    if not bridges.isEmpty():
        found = keep(found.unionAll(bridges), "found")
        parts = keep(components(found), "parts")
        before = open_
        open_ = _open(before.select("g", "k", "cid", "n", "p"), parts, maps)
        forget(before)
    x, y = (open_.select("g", *(F.col(c).alias(f"{c}{end}") for c in ("cid", "n", "p", "part", *MAP))) for end in ("_a", "_b"))
    across = x.join(y, (x["g"] == y["g"]) & (F.col("cid_a") > F.col("cid_b")) & (F.col("part_a") != F.col("part_b")) & near).select(*pair).distinct()
    across = keep(across.join(first.unionAll(second), ["a", "b"], "left_anti"), "across")
    bridges = keep(texts.links(across), "bridges")
    if not bridges.isEmpty():
        parts = keep(components(found.unionAll(bridges)), "parts")
    for done in (open_, first, second, across, bridges, found, *texts.used):
        forget(done)

    named = classes.join(parts, F.col("cid") == F.col("node"), "left").select("cid", "first_doc", F.coalesce("component", "cid").alias("part"))
    least = named.groupBy("part").agg(F.min("first_doc").alias("component_id"))
    final = named.join(least, "part").select("cid", "component_id", "part")
    joined = sets.select("doc_id", "rk", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(final, "cid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("cid").alias("class_id"),
        F.col("part").alias("part_id"),
        F.col("rk").alias("row_key"),
    )
    # A few numbers a row: what they were made of goes.
    joined = keep(joined, "joined")
    for done in (sets, classes, parts):
        forget(done)
    let_go(docs.sparkSession)
    return joined


def keep_one(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of least doc_id (null ids last).

    Rows are told apart by ``doc_id`` and text, never by ``doc_id`` alone, so
    two different texts of one id are two documents; equal rows are one.  Rows
    without words are linked with nothing and all stay.  Columns of any name
    pass through.
    """
    names = [f"_keep_one_{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    at = dict(zip(docs.columns, names))
    keyed = own.select("*", *row_keys(at["doc_id"], at["text"]))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    rows = joined.where("part_id is not null").groupBy("part_id", "doc_id", "row_key").agg(F.count("*").alias("times"))
    chosen = keep(rows.groupBy("part_id").agg(F.min_by(F.struct("row_key", "times"), order).alias("x")).select("x.row_key.*", "x.times"), "chosen")
    alone = joined.where("part_id is null").select("row_key.*").distinct()
    once = keyed.join(chosen.where("times = 1").drop("times").unionByName(alone), list(KEY), "left_semi").drop(*KEY)
    # Equal rows of a chosen document: any one, met with map-side combining.
    more = keyed.join(chosen.where("times > 1").drop("times"), list(KEY), "left_semi").groupBy(*KEY).agg(F.first(F.struct(*names)).alias("x")).select("x.*")
    return once.unionByName(more).toDF(*docs.columns)
