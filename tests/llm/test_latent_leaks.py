"""Planted items and paraphrases, against a search of all windows by common subsequence."""

import random

import numpy as np
from filigree.llm.latent_leaks import common_subsequence, find_leaks, remove_leaks

from .corpus import SCHEMA, documents, prose, texts


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 30))] for _ in range(2))
        assert common_subsequence(np.array(a), np.array(b)) == lcs(a, b)


def planted():
    r = random.Random(8)
    fresh = lambda n: " ".join("".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n))
    items = [fresh(r.randint(15, 60)) for _ in range(30)] + [fresh(4), "", None, "the of"]
    rows, want = [], {}
    for i in range(30):
        body = items[i]
        if i % 3 == 1:  # a paraphrase: every seventh word differs
            body = " ".join(w if k % 7 != 3 else "other" for k, w in enumerate(body.split()))
        rows.append((i, prose(r, r.choice([0, 30, 250])) + " " + body.upper() + ". " + prose(r, 120), "en", "s"))
        want[i] = [i]
    rows.append((30, prose(r, 20) + " " + items[30] + " " + prose(r, 20), "en", "s"))
    want[30] = [30]
    rows += [(100 + i, t, None, None) for i, t in enumerate(texts(n=40))]
    rows += [(200, fresh(200), "en", "s"), (201, " ".join(items[5].split()[: len(items[5].split()) // 2]), "en", "s"), (None, items[7], None, None), rows[3]]
    return items, rows, want


def test_planted_leaks(spark):
    items, rows, want = planted()
    docs = documents(spark, rows)
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, items[2])], "item_id long, text string")
    for block in (2000, 13, 6):  # one pass, three and six
        got = find_leaks(docs, bench, fit_rows=40, rank=40, block_items=block).collect()
        assert len(got) == len(rows)
        found = {r.doc_id: r.item_ids for r in got if r.leaked}
        hits = sum(set(v) <= set(found.get(k, [])) for k, v in want.items())
        assert hits >= 0.9 * len(want) and found[2] == [2, 99] and found[None] == [7]
        assert set(found) <= set(want) | {None}
    kept = remove_leaks(docs, bench, fit_rows=40, rank=40)
    assert kept.schema == SCHEMA and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in found)


def test_rows_of_one_id_and_clashing_names(spark):
    """Two texts of one id: the one that leaks goes, the other stays; names of the operator's own are columns like others."""
    items, rows, _ = planted()
    bench = spark.createDataFrame([("first", items[0]), ("second", items[3]), ("none", None)], "item_id string, text string")
    docs = documents(spark, [(1, rows[0][1], "en", "s"), (1, "an er tho", "en", "s"), (1, "an er tho", "en", "s"), (None, rows[3][1], None, None), (None, "is st", None, None)])
    docs = docs.withColumnsRenamed({"h": "_rk1", "rk": "_rk2", "n": "leaked"})
    for block in (2000, 1):
        got = {(r.doc_id, r.leaked, *r.item_ids) for r in find_leaks(docs, bench, fit_rows=40, block_items=block).collect()}
        assert got == {(1, True, "first"), (1, False), (None, True, "second"), (None, False)}
        kept = remove_leaks(docs, bench, fit_rows=40, block_items=block)
        assert kept.schema == docs.schema and sorted(r.text for r in kept.collect()) == ["an er tho", "an er tho", "is st"]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_leaks(documents(spark, []), bench).collect() == []
    assert not any(r.leaked for r in find_leaks(documents(spark), bench.limit(0)).collect())


def test_no_leak_is_lost_as_the_corpus_grows(spark, monkeypatch):
    """Whole copies of short items in foreign prose, with frequencies as of a corpus 100,000 times as large."""
    from filigree.llm import latent_leaks

    r = random.Random(5)
    items, rows, _ = planted()
    items = [x for x in items if x and len(x.split()) >= 8] + [prose(r, r.randint(15, 25)) for _ in range(30)]
    rows = [(i, prose(r, r.choice([30, 70, 250])) + " " + x + " " + prose(r, 120), "en", "s") for i, x in enumerate(items)]
    rows += [(100 + i, " ".join(w for k, w in enumerate(x.split()) if k % 4) + " " + prose(r, 80), "en", "s") for i, x in enumerate(items)]
    docs = documents(spark, rows)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    count = latent_leaks._document_frequencies

    def larger(docs, vocabulary):
        df, n = count(docs, vocabulary)
        return df * 100_000, n * 100_000

    monkeypatch.setattr(latent_leaks, "_document_frequencies", larger)
    got = {(x.doc_id, i) for x in find_leaks(docs, bench, fit_rows=40).collect() for i in x.item_ids}
    index = latent_leaks._index(docs, docs, bench.orderBy("item_id").collect(), 4, 32, 2, 0.5, 0.7, 6, 8, 1)
    index.prepare()
    want = set()
    for d, t, *_ in rows:  # every window with every item
        words, doc = latent_leaks.words_of(*latent_leaks._texts([t]))
        for s, e, _ in zip(*latent_leaks.windows(doc, 32, 2)):
            want |= {(d, i) for i in range(len(items)) if index.verify(i, words, doc, s, e)}
    assert {(i, i) for i in range(len(items))} <= want and got == want


def many(spark):
    """More short documents than the basis was once fitted on, and a benchmark of their words."""
    r = random.Random(12)
    words = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(3)) for _ in range(120)]
    rows = [(i, " ".join(r.choice(words[i % 7 :: 7]) for _ in range(r.choice([3, 40, 90]))), "en", "s") for i in range(2300)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(20, 100)))) for i in range(12)]
    return documents(spark, rows), rows, spark.createDataFrame(items, "item_id long, text string"), items


def test_basis_counts_every_document(spark, monkeypatch):
    """The basis against a plain iteration over the passages of all documents; sums of a vocabulary entry are not one row a dimension."""
    from filigree.llm import latent_leaks

    docs, rows, bench, items = many(spark)
    made, index = [], latent_leaks._index
    monkeypatch.setattr(latent_leaks, "_index", lambda *a: made.append(index(*a)) or made[-1])

    def no_rows(*_):
        raise AssertionError("a row for each dimension")

    monkeypatch.setattr(latent_leaks.F, "posexplode", no_rows)
    assert find_leaks(docs, bench, rank=6).count() == len(rows)
    own = made[0]
    at = lambda ts: latent_leaks._tfidf(*latent_leaks._texts(ts), own.vocabulary, own.idf, 32, 2)
    corpus, bench_rows = at([r[1] for r in rows]), at([t for _, t in items])
    x = np.linalg.qr(np.random.default_rng(11).standard_normal((len(own.vocabulary), 6)))[0].astype(np.float32)
    for _ in range(3):
        y = latent_leaks._there_and_back(*bench_rows[:4], x) + latent_leaks._there_and_back(*corpus[:4], x) * (0.01 * bench_rows[3] / corpus[3])
        x = np.linalg.qr(y)[0].astype(np.float32)
    assert own.basis.shape == x.shape and np.abs(own.basis - x).max() < 1e-3


def test_pipeline_stage_fits_its_basis_on_every_document(spark, monkeypatch, tmp_path):
    import corpus_pipeline
    from filigree.llm import latent_leaks

    docs, rows, bench, _ = many(spark)
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, basis = [], latent_leaks._basis
    monkeypatch.setattr(latent_leaks, "_basis", lambda source, *a, **k: seen.append(latent_leaks._document_frequencies(source, a[1])[1] if "number" in source.columns else source.count()) or basis(source, *a, **k))
    corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert seen == [len(rows)]
