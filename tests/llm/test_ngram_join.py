"""Sizes, classes and components against all pairs."""

import random
import re

import pytest
from filigree.llm.components import components
from filigree.llm.ngram_join import choose_boundary, jaccard_join, keep_one, light_rows

from .corpus import SCHEMA, documents, pairs, prose, texts


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)), key=repr)


def corpus():
    r = random.Random(6)
    out = texts(n=30)
    for n in [*range(5, 30), 60, 200]:  # light and heavy sets with edits at either end and inside
        w = prose(r, n).split(" ")
        for _ in range(3):
            e = list(w)
            e[r.choice([0, -1, r.randrange(len(e))])] = "edit" + str(r.randint(0, 3))
            out.append(" ".join(e))
        out += [" ".join(w), " ".join([*w, "more"]), " ".join(w[1:]), " ".join(w).upper()]
    base = prose(r, 200).split(" ")
    for i in range(25):  # a drifting chain of near copies
        base = list(base)
        base[r.randrange(len(base))] = f"d{i}"
        out.append(" ".join(base))
    return out


@pytest.mark.parametrize("boundary", [None, 0, 12])
def test_against_all_pairs(spark, boundary):
    docs = documents(spark, [(1000 - i, t, None, None) for i, t in enumerate(corpus())] + [(5, corpus()[40], None, None), (None, corpus()[41], None, None), (1000, None, None, None), (7, "same seven words that stand all alone", None, None)])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(docs, boundary=boundary).collect()), key=repr)
    assert got == brute(pairs(docs))


def test_cost_boundary():
    assert choose_boundary({}) == 0
    assert 1 <= choose_boundary({a: 100 for a in range(1, 40)}) <= 24
    assert light_rows(5, 5) == 5 + 1 and light_rows(9, 9) == 9 + 9  # C(5, 4) + C(5, 5); C(9, 8) twice


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(-5, 7000), (7000, -5), (3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(50)} == {1000} and got[7000] == -5
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_links_are_contracted_at_once(spark, monkeypatch):
    """Links that fit a task need no rounds over all tables; those that do not give the same components."""
    from filigree.llm import components as module

    r = random.Random(4)
    links = [(i, i + 1) for i in range(120)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(110)] + [(900, 500), (500, 900), (3, 3)]
    made = spark.createDataFrame(links, "a long, b long").repartition(7)
    in_rounds = sorted(map(tuple, components(made, local=0).collect()))

    def no_round(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(module, "_star", no_round)
    assert sorted(map(tuple, components(made).collect())) == in_rounds
    assert len(in_rounds) == len({x for link in links if link[0] != link[1] for x in link})


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    joined = jaccard_join(docs)
    kept = keep_one(docs, joined)
    assert kept.schema == SCHEMA
    firsts = {c for d, _, c in brute(pairs(docs)) if d is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(firsts)
    assert jaccard_join(documents(spark, [])).collect() == []


def test_rows_of_one_id_and_clashing_names(spark):
    """Different texts of one id are different documents; equal rows are one; null ids take part; wordless rows stay."""
    r = random.Random(2)
    a, b, c = (prose(r, 30) for _ in range(3))
    docs = documents(spark, [(1, a, "en", "s"), (1, b, "en", "s"), (2, c, "en", "s"), (2, c, "en", "s"), (3, c + " end", None, None), (None, a, None, None), (None, None, None, None), (4, " ", None, None), (4, " ", None, None)])
    docs = docs.withColumnsRenamed({"h": "_one", "rk": "_rk1", "n": "part_id", "g": "row_key"})
    kept = keep_one(docs, jaccard_join(docs))
    assert kept.schema == docs.schema
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted([(1, a), (1, b), (2, c), (None, None), (4, " "), (4, " ")], key=repr)


def test_long_lists_are_split(spark):
    """Lists that are known to be long are scanned in parts, with the same result."""
    r = random.Random(7)
    base = prose(r, 60).split(" ")
    rows = []
    for i in range(200):
        w = list(base)
        w[r.randrange(len(w))] = f"e{i % 50}"
        rows.append((i, " ".join(w), None, None))
    docs = documents(spark, rows)
    want = sorted(tuple(x) for x in brute(pairs(docs)))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join(docs, boundary=0, list_rows=20).collect())
    assert got == want
