"""Base places against a plain scan; labels of whole, broken and unrelated statements."""

import math
import random
import re

from filigree.llm.licenses import PHRASES, TEMPLATES, scan

from .corpus import documents, pairs, prose, texts


def plain(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    hits = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def corpus():
    r = random.Random(2)
    out = texts() + [prose(r, 40) + "\n" + t + ".\n" + prose(r, 30) for _, _, t in TEMPLATES]
    out += ["All rights reserved. all RIGHTS, reserved! CC-BY cc by", "all rights", "reserved", "general public", "license", "cc", "by", "GENERAL PUBLIC LICENSE"]
    out += ["the license of the software under the version and this work", "public license general cc free of"]
    return out


def test_base_places(spark):
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(corpus())] + [(3, "cc by", None, None), (None, "cc\nby", None, None)])
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan(docs).collect()), key=repr)
    assert got == sorted(((d, *plain(t)) for d, t in pairs(docs)), key=repr)


def test_templates(spark):
    ts = corpus()
    start = len(texts())
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(ts)])
    got = {r.doc_id: r for r in scan(docs).collect()}
    for i, (label, _, _) in enumerate(TEMPLATES):
        r = got[start + i]
        assert label in r.labels.split(","), (label, r)
        assert 0.7 <= r.score <= 1
    for i in [*range(start), len(ts) - 2, len(ts) - 1]:
        assert got[i].labels == "" and got[i].score == 0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got.values())
    assert scan(documents(spark, [])).collect() == []


def test_several_statements(spark):
    """Statements keep their labels whatever other statements their file has."""
    r = random.Random(4)
    rows, want = [], []
    for i in range(60):
        some = r.sample(TEMPLATES, [2, 5, 10, len(TEMPLATES)][i % 4])
        rows.append((i, "".join(prose(r, 30) + ".\n" + t + ".\n" for _, _, t in some), None, None))
        want.append({label for label, _, _ in some})
    got = {x.doc_id: set(x.labels.split(",")) for x in scan(documents(spark, rows)).collect()}
    assert all(want[i] <= got[i] for i in range(60))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def aligned(text, idf, agree=3, share=0.7):
    """Labels and scores by every template at every shift."""
    w = words(text)
    found = {}
    for label, key, statement in TEMPLATES:
        own = words(statement)
        key = words(key)
        if not any(w[i : i + len(key)] == key for i in range(len(w))):
            continue
        enough = max(2, min(agree, len(set(own) & set(w))))
        for shift in range(-len(own), len(w)):
            hit = [(x, idf[x]) for p, x in enumerate(own) if 0 <= shift + p < len(w) and w[shift + p] == x]
            score = sum(v for _, v in hit) / sum(idf[x] for x in own)
            if len({x for x, _ in hit}) >= enough and score >= share:
                found[label] = max(found.get(label, 0), score)
    return found


def test_alignments_against_all_shifts(spark):
    """Whole, cut, edited and joined statements: every template at every place, with frequencies counted here."""
    r = random.Random(8)
    rows = []
    for i in range(90):
        parts = []
        for _, _, t in r.sample(TEMPLATES, r.choice([1, 1, 2, 4])):
            w = t.split()
            for _ in range(r.choice([0, 0, 1, 3, len(w) // 4])):
                w[r.randrange(len(w))] = r.choice(["edited", "license", "of", "the"])
            cut = r.choice([0, 0, len(w) // 5])
            parts.append(prose(r, 12) + " " + " ".join(w[cut:]))
        rows.append((i, " ".join(parts), None, None))
    rows += [(900 + i, t, None, None) for i, t in enumerate(texts(n=10))]
    docs = documents(spark, rows)
    every = {x for _, k, t in TEMPLATES for x in words(t) + words(k)} | {x for p in PHRASES for x in p.split()}
    sets = [set(words(t)) for _, t, *_ in rows]
    idf = {x: max(0.1, math.log((len(rows) + 1) / (sum(x in s for s in sets) + 0.5))) for x in every}
    got = {x.doc_id: x for x in scan(docs).collect()}
    near = 0
    for d, t, *_ in rows:
        want = aligned(t, idf)
        base = {x for x in plain(t)[4].split(",") if x}
        if any(abs(v - 0.7) < 1e-6 for v in want.values()):
            near += 1
            continue
        assert {x for x in got[d].labels.split(",") if x} == base | set(want), d
        assert abs(got[d].score - max([1.0 if base else 0.0, *want.values()])) < 1e-6
    assert near < 3 and sum(got[i].labels != "" for i in range(90)) > 60


def test_long_text_keeps_its_last_words(spark):
    text = "an er tho " * 400_000 + "Released under the MIT License. All rights reserved"
    r = scan(documents(spark, [(1, text, None, None)])).first()
    assert r.n_words == 1_200_008 and r.first_word == r.last_word == 1_200_005 and {"mit", "reserved"} <= set(r.labels.split(","))
