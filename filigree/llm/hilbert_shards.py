"""Sharding along a Hilbert curve over document metadata, in DataFrame operations alone.

Language and source are quantised to ``2**bits`` levels by their quantiles, in
their own order (as the bytes after what all values begin with; seven of them
count), and size to as many by its logarithm; a cell's place on the
three-dimensional Hilbert curve comes from a constant table of ``8**bits``
entries.  Rows sorted by that place are cut into shards of equal counts, so a
shard covers a compact box of each dimension and file statistics prune on any.

Law ``rows``: the counts of two shards differ by one at most.  Rows of equal
texts are a group: they share a cell (that of the group's least language and
source) and follow one another, so a group is split only where a shard is full.
No row is moved with its text: texts are reduced to size and hashes in the scan.

Defined cases: a null or empty text has size 1 and CRC 0, and all of them are
one group; null language or source is a level of its own; rows tie by text,
then by ``doc_id``, and repeated rows are rows like any other; a very long text
has the last level of size; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered, spread_sort
from .store import keep


def curve_index(axes: list[int], bits: int) -> int:
    """Place of a cell on the Hilbert curve (Skilling's transform)."""
    x, n = list(axes), len(axes)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b) & 1
    return out


def curve_table(bits: int) -> Column:
    side = 1 << bits
    places = (curve_index([a, b, c], bits) for a in range(side) for b in range(side) for c in range(side))
    return F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")


def ordered_value(c: Column, skip: int) -> Column:
    """The seven bytes after the first ``skip`` ones as a number of the same order."""
    head = F.hex(F.substring(c.cast("binary"), skip + 1, 7))
    return F.conv(F.rpad(head, 14, "0"), 16, 10).cast("long")


def common_prefix(low: str | None, high: str | None) -> int:
    """Bytes that the least and the greatest value begin with, and so all between."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def quantised(docs: DataFrame, names: list[str], side: int) -> list[Column]:
    """Levels 1 to ``side - 1`` of each column by its quantiles, in its order; 0 for null."""
    ends = docs.agg(*(f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("low", F.min), ("high", F.max)))).first()
    values = [ordered_value(F.col(n), common_prefix(ends[f"low{i}"], ends[f"high{i}"])) for i, n in enumerate(names)]
    shares = [k / (side - 1) for k in range(1, side - 1)]
    cuts = docs.agg(*(F.percentile_approx(v, shares, 10_000).alias(str(i)) for i, v in enumerate(values))).first()
    levels = []
    for i, v in enumerate(values):
        # a value of a larger share than a level's is a cut itself, so no two such values meet in a level
        above = [F.when(v > c, 1).otherwise(0) for c in sorted(set(cuts[str(i)] or []))]
        levels.append(F.when(F.col(names[i]).isNull(), 0).otherwise(sum(above, F.lit(1))))
    return levels


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 5, rows_per_part: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the cell on the curve of each row."""
    if shards < 1 or not 2 <= bits <= 5:
        raise ValueError("shards must be positive and bits between 2 and 5")
    side = 1 << bits
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lang, source = quantised(docs, ["lang", "source"], side)
    size = F.octet_length(text).cast("long") + 1
    # Powers of two to the 18 / side: levels of size up to 2**18 bytes, the last one open.
    log = F.least(F.floor(F.log2(size.cast("double")) * F.lit(side / 18.0)), F.lit(side - 1)).cast("int")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"), lang.alias("_l"), source.alias("_s"), log.alias("_z"))
    rows = keep(rows, "rows")
    # Equal texts lie together: a group has the least language and source of its rows.
    # Written first: both sides of the join are then plain exchanges, and the rows of one text can be split.
    groups = keep(rows.groupBy("_text", "text_crc32").agg(F.min(F.col("_l") * side + F.col("_s")).alias("_at")), "groups")
    cell = F.element_at(curve_table(bits), F.col("_at") * side + F.col("_z") + 1)
    placed = rows.join(groups, ["_text", "text_crc32"]).select("doc_id", "size", "text_crc32", "_text", cell.alias("cell"))
    n = rows.count()
    placed, counts = spread_sort(keep(placed, "placed"), ["cell", "_text", "text_crc32", "doc_id"], -(-n // rows_per_part))
    # The first n % shards shards hold one row more.
    small, more = divmod(n, shards)
    cut = more * (small + 1)
    r = F.col("rank")
    shard = F.when(r < cut, F.floor(r / F.lit(small + 1))).otherwise(F.floor((r - cut) / F.lit(max(1, small))) + more)
    slot = F.when(r < cut, r % (small + 1)).otherwise((r - cut) % max(1, small))
    return numbered(placed, counts).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell"
    )
