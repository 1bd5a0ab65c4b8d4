"""Sharding and quality rules against plain Python."""

import math
import re
import zlib
from collections import Counter

import xxhash
from filigree.llm.hilbert_shards import curve_index, hilbert_shards
from filigree.llm.importance_rules import quality_rules

from .corpus import documents, pairs


def test_curve_visits_neighbours():
    at = {curve_index([a, b, c], 3): (a, b, c) for a in range(8) for b in range(8) for c in range(8)}
    assert sorted(at) == list(range(512))
    for i in range(511):
        assert sum(abs(x - y) for x, y in zip(at[i], at[i + 1])) == 1


def plain_levels(values, side):
    """Ranks of the quantiles that each value passes, computed over the sorted values."""
    have = sorted(v.encode() for v in values if v is not None)
    cuts = sorted({have[max(0, math.ceil(len(have) * k / (side - 1)) - 1)] for k in range(1, side - 1)}) if have else []
    return [0 if v is None else 1 + sum(v.encode() > c for c in cuts) for v in values]


def plain_places(rows, bits):
    """Cell of each (doc_id, text, lang, source): that of its group of equal texts."""
    side = 1 << bits
    lang, source = (plain_levels([r[k] for r in rows], side) for k in (2, 3))
    least = {}
    for r, at in zip(rows, zip(lang, source)):
        least[r[1] or ""] = min(least.get(r[1] or "", at), at)
    size = [min(int(math.log2(len((r[1] or "").encode()) + 1) * side / 18), side - 1) for r in rows]
    return [curve_index([*least[r[1] or ""], z], bits) for r, z in zip(rows, size)]


def test_shards_are_even_runs_of_the_curve(spark):
    docs = documents(spark)
    got = hilbert_shards(docs, 7, rows_per_part=5).collect()
    texts = pairs(docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and sorted(counts) == list(range(7))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    sorted_ = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in sorted_] == sorted(r.cell for r in got)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert hilbert_shards(documents(spark, [])).collect() == []
    assert [r.shard for r in hilbert_shards(documents(spark, [(1, "a", "en", "s")]), 16).collect()] == [0]
    # cells computed again from the rows
    own = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    want = Counter((d, zlib.crc32((t or "").encode()), c) for (d, t, _, _), c in zip(own, plain_places(own, 5)))
    assert Counter((r.doc_id, r.text_crc32, r.cell) for r in got) == want
    # a group of equal texts is a run
    for crc in {r.text_crc32 for r in got}:
        at = [i for i, r in enumerate(sorted_) if r.text_crc32 == crc]
        assert at == list(range(at[0], at[0] + len(at)))


def test_levels_keep_order_and_tell_usual_values_apart(spark):
    langs = ["en"] * 60 + ["fr"] * 15 + ["de"] * 15 + ["es"] * 10 + [None] * 5
    rows = [(i, f"text {i}", langs[i % 105], f"source{i % 20}") for i in range(210)]
    docs = documents(spark, rows + [(None, None, None, None)] * 3)
    level = dict(zip(langs, plain_levels([r[2] for r in rows], 32)))
    assert len({level[x] for x in ("en", "fr", "de", "es", None)}) == 5 and level[None] == 0 < level["de"] < level["en"] < level["es"] < level["fr"]
    own = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert len(set(plain_levels([f"source{i % 20}" for i in range(210)], 32))) == 20
    got = hilbert_shards(docs, 4).collect()
    assert Counter((r.doc_id, r.cell) for r in got) == Counter((d, c) for (d, _, _, _), c in zip(own, plain_places(own, 5)))


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_rules_against_plain_python(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality_rules(docs, labels, buckets=500)
    want = sorted(((d, *base(t)) for d, t in pairs(docs)), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()), key=repr) == want
    # the score and the threshold, with hashes, ratios and means made here
    mixed = lambda raw, seed: xxhash.xxh64(raw, seed=seed % (1 << 64)).intdigest()
    pack = lambda x: x.to_bytes(8, "little")

    def feats(t):
        h = [mixed(x.encode(), 42) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return [signed(x) % 500 for x in h] + [signed(mixed(pack(b), mixed(pack(a), 42))) % 500 for a, b in zip(h, h[1:])]

    good_ids = {i for i in range(60) if i % 3 > 0}
    held = {i for i in good_ids if zlib.crc32(str(i).encode()) % 4 == 3}
    raw, good = [1.0] * 500, [1.0] * 500
    for d, t in pairs(docs):
        for b in feats(t):
            raw[b] += 1
            good[b] += d in good_ids - held
    ratio = [math.log(g / sum(good)) - math.log(r / sum(raw)) for g, r in zip(good, raw)]
    mean = lambda t: sum(ratio[b] for b in feats(t)) / len(feats(t)) if feats(t) else 0.0
    known = sorted(mean(t) for d, t in pairs(docs) if d in held and feats(t))
    limit = known[math.ceil(0.02 * len(known)) - 1]
    texts = {(d, base(t)): t for d, t in pairs(docs)}
    for r in got.collect():
        s = mean(texts[r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)])
        assert abs(s - r.score) < 1e-6
        if abs(s - limit) > 1e-6:
            assert r.kept == (not r.base_failed and s >= limit)
    assert {r.kept for r in got.collect()} == {True, False}


def test_rules_tell_words_by_their_beginnings(spark):
    """Words that differ before their ending are different n-grams."""
    docs = documents(spark, [(i, " ".join(f"{'good' if i < 30 else 'evil'}{j}" for j in range(40)), "en", "s") for i in range(60)])
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert all(r.kept == (r.doc_id < 30) for r in quality_rules(docs, labels).collect())


def test_rules_on_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules(documents(spark, []), labels, buckets=50).collect() == []
    assert all(abs(r.score) < 5 for r in quality_rules(documents(spark), labels, buckets=50).collect())


def test_rules_count_every_labelled_row(spark):
    """More trusted rows than were once fitted on (20,000 and 5,000 held out): score and threshold of all of them."""
    n = 28_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat(repeat('a b c ', int(id % 9)), 'w', id % 400, ' x', id % 60) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality")
    got = {r.doc_id: r for r in quality_rules(docs, labels, buckets=1 << 16, quantile=0.3, min_words=1, max_repeat=100).collect()}
    mixed = lambda raw, seed=42: xxhash.xxh64(raw, seed=seed % (1 << 64)).intdigest()
    count = Counter(), Counter()
    signed = lambda x: (x - (1 << 64) if x >> 63 else x) % (1 << 16)
    hashes, held = {}, [d for d in range(n) if zlib.crc32(str(d).encode()) % 4 == 3]
    assert n - len(held) > 20_000 and len(held) > 5_000
    out = set(held)
    for d in range(n):
        ts = ["a", "b", "c"] * (d % 9) + [f"w{d % 400}", f"x{d % 60}"]
        h = [mixed(t.encode()) for t in ts]
        hashes[d] = [signed(x) for x in h] + [signed(mixed(b.to_bytes(8, "little"), mixed(a.to_bytes(8, "little")))) for a, b in zip(h, h[1:])]
        count[0].update(hashes[d])
        if d not in out:
            count[1].update(hashes[d])
    raw, good = (sum(c.values()) + (1 << 16) for c in count)
    ratio = {b: math.log((count[1][b] + 1) / good) - math.log((count[0][b] + 1) / raw) for b in count[0]}
    score = {d: sum(ratio[b] for b in f) / len(f) for d, f in hashes.items()}
    assert max(abs(score[d] - got[d].score) for d in range(n)) < 1e-6
    limit = sorted(score[d] for d in held)[math.ceil(0.3 * len(held)) - 1]
    assert all(got[d].kept == (score[d] >= limit) for d in range(n) if abs(score[d] - limit) > 1e-6)
