"""The model against a plain version of itself, separation of junk, and defined cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from filigree.llm import textkit as tk
from filigree.llm.kneser_ney import ENDINGS, classify, fit, fit_words, keep_good, n_shards, packed, perplexities, tokens, unpacked

from .corpus import SCHEMA, documents, pairs, prose


def corpus(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(160):
        t = prose(r, r.choice([15, 60, 200]))
        if i % 8 == 7:
            t = " ".join(w + r.choice(["%%%", "&&&", "$$$"]) for w in t.split())
        rows.append((i, t, ["en", "de", None][i % 3], "s"))
        labels.append((i, int(i % 8 != 7), 0))
    rows += [(500, None, "en", "s"), (501, "", None, None), (None, prose(r, 50), "xx", None), rows[2]]
    return documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (6, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


TOKEN = re.compile(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[!-/:-@\[-`{-\x7f]")


def plain_tokens(text):
    return ["0" if t[0] in "0123456789" else t for t in TOKEN.findall(text or "")]


def ending(token):
    """Class of a token's last two bytes, each hashed on its own."""
    if token == "0":
        return ("ending", 0)
    raw = np.frombuffer(token.encode()[-2:], np.uint8)
    return ("ending", int(tk.span_hash(tk.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0] % ENDINGS))


def plain_model(texts, heads):
    """p(token | class of the token before) over dictionaries; tokens of ``heads`` are classes of their own."""
    kind = lambda t: t if t in heads else ending(t)
    grams = lambda ts: list(zip([None, *map(kind, ts[:-1])], ts))
    high = Counter(g for t in texts for g in grams(plain_tokens(t)))
    low = Counter(w for _, w in high)

    def discount(counts):
        n = [sum(c == x for c in counts.values()) for x in (1, 2, 3, 4)]
        if not all(n[:3]):
            return (0.5, 0.75, 0.9)
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(v, 0.05), x) for x, v in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2])))

    dh, dl = discount(high), discount(low)
    total, left = Counter(), defaultdict(float)
    for (v, _), c in high.items():
        total[v] += c
        left[v] += dh[min(c, 3) - 1]
    spare = sum(dl[min(c, 3) - 1] for c in low.values()) / len(high)

    def lower(w):
        c = low.get(w, 0)
        return ((c - dl[min(c, 3) - 1]) / len(high) if c else 0) + spare / (len(low) + 1)

    def perplexity(text):
        ts, log = plain_tokens(text), 0.0
        for v, w in grams(ts):
            c = high.get((v, w), 0)
            own = (c - dh[min(c, 3) - 1]) / total[v] if c else 0
            log += math.log(own + (left[v] / total[v] if total[v] else 1) * lower(w))
        return math.exp(-log / len(ts))

    return perplexity


@pytest.mark.parametrize("heads", [20, 1000])
def test_perplexity_against_plain_version(spark, heads):
    """Few heads: most n-grams are asked of the shards."""
    docs, labels = corpus(spark)
    trusted = [t for d, t in pairs(docs) if d is not None and d < 160 and d % 8 != 7 and d != 6 and t is not None and zlib.crc32(str(d).encode()) % 4 != 3]
    model = fit(docs, labels, heads, shards=3)
    words = {int(tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]): w for t in trusted for w in plain_tokens(t)}
    p = plain_model(trusted, {words[int(h)] for h in model.heads})
    assert len(model.heads) == min(heads, len(words))
    got = perplexities(docs, model, ["doc_id"]).collect()
    texts = dict(pairs(docs))
    assert len(got) == 164
    for r in got:
        if r.doc_id is not None and r.n_tokens:
            assert r.n_tokens == len(plain_tokens(texts[r.doc_id]))
            assert r.perplexity == pytest.approx(p(texts[r.doc_id]), rel=1e-4)
    assert {r.perplexity for r in got if not r.n_tokens} == {None}


def test_thresholds_are_quantiles_by_language(spark):
    docs, labels = corpus(spark)
    got = classify(docs, labels, least=5, quantile=0.9).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 8 != 7 and r.doc_id not in (5, 6) and zlib.crc32(str(r.doc_id).encode()) % 4 == 3]
    for lang in ("en", "de", None):
        own = sorted(r.perplexity for r in held if r.lang == lang)
        assert len(own) >= 5
        assert {r.limit for r in got if r.lang == lang} == {own[math.ceil(0.9 * len(own)) - 1]}
    every = sorted(r.perplexity for r in held)
    assert {r.limit for r in got if r.lang == "xx"} == {every[math.ceil(0.9 * len(every)) - 1]}
    assert all(r.kept == (r.perplexity is not None and r.perplexity <= r.limit) for r in got)


def test_packing_of_arrays():
    arrays = [np.array([1, 5, 1 << 47], "<u8"), np.array([], "<u2"), np.array([3, 70000], "<u4")]
    assert [x.tolist() for x in unpacked(packed(*arrays))] == [x.tolist() for x in arrays]
    assert [n_shards(n) for n in (0, 1, 1 << 25, 1 << 26, 1 << 41, 1 << 60)] == [1, 1, 1, 2, 1024, 1 << 16]


def test_columns_of_any_name_pass_the_filter(spark):
    docs, labels = corpus(spark)
    clash = docs.withColumnsRenamed({"h": "_row", "rk": "_kg_1", "words": "kept", "n": "chunk"})
    kept = keep_good(clash, labels, least=5)
    assert kept.schema == clash.schema and {r["_row"] for r in kept.collect()} == {"x"}


def test_junk_goes_and_prose_stays(spark):
    docs, labels = corpus(spark)
    got = classify(docs, labels, least=5).collect()
    assert len(got) == 164
    assert all(r.kept == (r.doc_id is None or (r.doc_id < 160 and r.doc_id % 8 != 7)) for r in got)
    kept = keep_good(docs, labels, least=5)
    assert kept.schema == SCHEMA and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in got if r.kept), key=repr)


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = corpus(spark)[0]
    assert all(r.kept == (r.n_tokens > 0) for r in classify(docs, labels).collect())
    assert classify(documents(spark, []), labels).collect() == []


@pytest.mark.parametrize("local", [0, 40])
def test_words_follow_words(spark, local):
    """Every word is a context of its own, whatever its frequency: the plain version with all words as heads."""
    docs, labels = corpus(spark)
    trusted = [t for d, t in pairs(docs) if d is not None and d < 160 and d % 8 != 7 and d != 6 and t is not None and zlib.crc32(str(d).encode()) % 4 != 3]
    every = {w for t in texts_of(docs) for w in plain_tokens(t)}
    p = plain_model(trusted, every)
    texts = dict(pairs(docs))
    got = perplexities(docs, fit_words(docs, labels, shards=3, local=local), ["doc_id"]).collect()
    assert len(got) == 164
    assert all(r.perplexity == pytest.approx(p(texts[r.doc_id]), rel=1e-4) for r in got if r.doc_id is not None and r.n_tokens)


def test_rare_words_are_contexts_in_the_query(spark):
    """Contexts that end alike, each rarer than the 1,000 most frequent words: only one of them was followed by the word."""
    usual = " ".join(f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP")
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 3][:6]  # counted, not held out
    rows = [(i, usual, "en", "s") for i in ids[:4]] + [(ids[4], "firstxx alpha " * 3, "en", "s"), (ids[5], "secondxx beta " * 3, "en", "s"), (200, "firstxx alpha", "en", "s"), (201, "secondxx alpha", "en", "s")]
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    got = {r.doc_id: r.perplexity for r in classify(documents(spark, rows), labels).collect()}
    assert got[200] * 1.5 < got[201]


def test_parts_bound_the_disk_and_change_no_score(spark, monkeypatch):
    """Entries and scores are made a part at a time, whose shuffle files go when it is written."""
    from filigree.llm import kneser_ney

    docs, labels = corpus(spark)
    want = {(r.doc_id, r.n_tokens): (r.kept, r.perplexity) for r in classify(docs, labels, least=5).collect()}
    made, keep = [], kneser_ney.keep
    monkeypatch.setattr(kneser_ney, "keep", lambda df, name, **k: made.append((name, k.get("drop_shuffles"))) or keep(df, name, **k))
    monkeypatch.setattr(kneser_ney, "n_shards", lambda _: 3)
    got = classify(docs, labels, least=5).collect()
    assert made.count(("counts", True)) == 3 and made.count(("perplexities", True)) == 3 and ("pairs", True) in made
    assert len(got) == 164
    assert all(r.kept == want[r.doc_id, r.n_tokens][0] and r.perplexity == pytest.approx(want[r.doc_id, r.n_tokens][1]) for r in got)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def texts_of(docs):
    return [t for _, t in pairs(docs)]
