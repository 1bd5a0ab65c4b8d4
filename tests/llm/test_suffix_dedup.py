import random

import pytest
from filigree.llm.suffix_dedup import remove_repeats, suffix_array

from .corpus import documents, pairs


def test_suffix_array_equals_sorting():
    r = random.Random(5)
    for _ in range(400):
        t = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 40))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = {}
    for _, b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((d, len(b), bytes(x for x, g in zip(b, gone) if not g), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4096, 1])
def test_against_brute_force(spark, hot):
    docs = documents(spark)
    got = remove_repeats(docs, length=60, k=20, bin_width=8, hot_strings=hot)
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got.collect()), key=repr) == brute(pairs(docs), 60)


def test_empty_table(spark):
    assert remove_repeats(documents(spark, [])).collect() == []


def test_texts_over_a_megabyte(spark):
    """Repeats across the seams of segments and blocks, and between them, at the production length."""
    r = random.Random(11)
    base = bytearray(r.choice(b"abcdefgh ") for _ in range(1_300_000))
    seam = 1 << 20
    passage = bytes(r.choice(b"xyzuvw ") for _ in range(700))
    base[seam - 350 : seam + 350] = passage  # over the seam
    base[200_000:200_700] = passage
    other = bytes(r.choice(b"ijklmno ") for _ in range(900_000)) + bytes(base[seam - 500 : seam - 100]) + bytes(r.choice(b"pqrs ") for _ in range(300_000))
    rows = [(1, base.decode(), None, None), (2, other.decode(), None, None), (3, "short", None, None), (4, passage[100:320].decode(), None, None)]
    docs = documents(spark, rows)
    got = {x.doc_id: x for x in remove_repeats(docs).collect()}
    raw, count = {d: t.encode() for d, t, *_ in rows}, {}
    for b in raw.values():
        for i in range(len(b) - 199):
            k = hash(b[i : i + 200])
            count[k] = count.get(k, 0) + 1
    for d, b in raw.items():
        runs = []
        for i in range(len(b) - 199):
            if count[hash(b[i : i + 200])] > 1:
                if runs and runs[-1][1] >= i:
                    runs[-1][1] = i + 200
                else:
                    runs.append([i, i + 200])
        assert [(s.start, s.end) for s in got[d].spans] == [tuple(x) for x in runs], d
        kept, at = b"", 0
        for s, e in runs:
            kept, at = kept + b[at:s], e
        assert bytes(got[d].kept) == kept + b[at:]
    assert len(got[1].spans) == 2 and len(got[2].spans) == 1 and got[4].kept == b""


def test_many_equal_rows(spark):
    """A row that is there many times needs its spans once."""
    text = documents(spark).where("doc_id = 40").first().text + "x" * 300
    docs = documents(spark, [(7, text, None, None)] * 500)
    got = remove_repeats(docs).collect()
    assert len(got) == 500 and all(r.kept == b"" and len(r.spans) == 1 for r in got)
