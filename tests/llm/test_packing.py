import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from filigree.llm.packing import WordIds, best_fit_decreasing, local_search, lower_bound, pack

from .corpus import documents, pairs

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def test_round_trip(spark):
    docs = documents(spark)
    path = str(public.path("word_bpe_49k.json"))
    got = pack(docs, path, capacity=256, rows_per_part=10).collect()
    encode = tokenizers.Tokenizer.from_file(path)
    want = []
    for d, t in pairs(docs):
        ids = encode.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, i, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for i, s in enumerate(range(0, len(ids), 256))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 256) + 1
    assert pack(documents(spark, []), path).collect() == []


def test_word_cache_equals_the_tokenizer():
    path = str(public.path("word_bpe_49k.json"))
    encode, words = tokenizers.Tokenizer.from_file(path), WordIds(path, limit=50)
    r = random.Random(9)
    bits = ["it's", "we'LL", "naïve", "ÄÖÜß", "中文", "a中b", "e\u0301", "x\x1cy", "\xa0", "<|endoftext|>", "##", "1234", "½x²", "ΑΣ", "'s", "...a", "The", "ing,", "İ", "\U0001f600", "ªº", "\x85", "a\tb", "ÿ", "÷×"]
    for _ in range(600):
        text = "".join(r.choice(bits) + r.choice(["", " ", "\n", "  "]) for _ in range(r.randint(0, 6)))
        assert np.frombuffer(words.ids(text), "<u4").tolist() == encode.encode(text, add_special_tokens=False).ids, repr(text)


def one_by_one(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= x]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= x
        else:
            room.append(capacity - x)
    return len(room)


def test_histogram_packing_equals_packing_one_by_one():
    r = random.Random(3)
    for _ in range(150):
        lengths = [r.randint(1, 40) for _ in range(r.randint(1, 120))]
        hist = {x: lengths.count(x) for x in set(lengths)}
        first = best_fit_decreasing(hist, 40)
        assert sum(first.values()) == one_by_one(lengths, 40)
        bound = lower_bound(hist, 40)
        better = local_search(first, 40, bound)
        assert bound <= sum(better.values()) <= sum(first.values())
        assert sorted(x for p, n in better.items() for x in p * n) == sorted(lengths)
        assert all(sum(p) <= 40 for p in better)


def test_search_empties_a_bin():
    hist = {4: 3, 3: 6}  # bins of 10 hold 4 + 3 + 3 three times, where best fit takes 4 + 4 first
    first = best_fit_decreasing(hist, 10)
    assert sum(first.values()) == 4
    assert sum(local_search(first, 10, lower_bound(hist, 10)).values()) == 3
