"""Held-out accuracy, folded scoring against the plain model, and defined cases."""

import random
import zlib

import numpy as np
from filigree.llm import textkit as tk
from filigree.llm.toxicity import Model, fit, grams, score, train

from .corpus import documents, prose


def plain_grams(word, min_n, max_n):
    w = b" " + word + b" "
    return [w[i : i + n] for n in range(min_n, max_n + 1) for i in range(len(w) - n + 1)] + [word]


def test_grams_and_mean_of_means():
    texts = ["The cat, the CAT!", "", "naïve a1b2", "\n"]
    import pyarrow as pa

    data, offsets = tk.utf8(pa.array(texts))
    g = grams(data, offsets, 3, 5, 18)
    words = [b"the", b"cat", b"the", b"cat", "naïve".encode(), b"a0b0"]
    assert g.doc.tolist() == [0, 0, 0, 0, 2, 2]
    assert g.per_word.tolist() == [len(plain_grams(w, 3, 5)) for w in words]
    assert len(set(g.key.tolist())) == 4
    weight = np.random.default_rng(1).standard_normal(1 << 18)
    by_word = [np.mean(weight[g.bucket[g.word == i]]) for i in range(6)]
    want = [0.5 + np.mean(by_word[:4]), 0.5, 0.5 + np.mean(by_word[4:]), 0.5]
    assert np.allclose(Model(weight, 0.5, 3, 5, 18).logits(data, offsets), want)


def corpus(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = prose(r, r.choice([30, 80, 200])).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[r.randrange(len(words))] = r.choice(["vuxomak", "vuxomas!", "Vuxomaki", "quzzil", "quzzils"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "an er vuxxomak and quzzzil here vuxomaq", "en", "s"), (1001, None, "en", "s"), (None, "", None, None), (7, rows[7][1], "en", "s")]
    return documents(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = corpus(spark)
    got = score(docs, fit(docs, labels)).collect()
    assert len(got) == 404
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 50 and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert next(r for r in got if r.doc_id == 1000).predicted == 1  # never seen spellings
    assert next(r for r in got if r.doc_id == 1001).predicted == 0


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(documents(spark), labels)
    assert {r.predicted for r in score(documents(spark), model).collect()} == {0}
    assert score(documents(spark, []), model).collect() == []


def test_joint_steps_do_the_work():
    """Without them, embeddings are random; with them, held-out texts are told apart."""
    import pyarrow as pa

    r = random.Random(9)
    texts, label = [], []
    for i in range(300):
        words = prose(r, 60).split(" ")
        if i % 3 == 0:
            words[::20] = [r.choice(["vuxomak", "vuxomas", "quzzil"])] * len(words[::20])
        texts.append(" ".join(words))
        label.append(int(i % 3 == 0))
    data, offsets = tk.utf8(pa.array(texts))
    label, cut = np.array(label), offsets[200]
    right = []
    for steps in (0, 80):
        model = train(data[:cut], offsets[:201], label[:200], 1 / 3, steps=steps)
        right.append(((model.logits(data[cut:], offsets[200:] - cut) > 0) == (label[200:] == 1)).mean())
    assert right[0] < 0.8 and right[1] > 0.97


def test_long_and_repeated_texts(spark):
    """Scored in whole; a row that does not fit the bound is not fitted on."""
    docs, labels = corpus(spark)
    more = documents(spark, [(5, "vuxomak " * 200_000, "en", "s"), (6, "an er " * 300_000 + "vuxomak quzzil " * 60_000, "en", None)])
    model = fit(docs.unionByName(more), labels, fit_bytes=1 << 20)
    got = {r.doc_id: r.score for r in score(more, model).collect()}
    assert got[5] > 0.9 and got[6] > 0.3
    twice = [r.score for r in score(docs.where("doc_id = 7"), model).collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
