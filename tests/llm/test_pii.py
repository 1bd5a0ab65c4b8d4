"""Base spans against patterns written out again, and what the field adds."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
from filigree.llm.pii import KINDS, N, SkipChain, base_spans, candidates, clamp, find_personal_data, fit, fit_potentials, redact, shape

from .corpus import SCHEMA, documents, pairs


def plain(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TEXTS = [
    "mail ré.user+x@mail.example.com, or a@b; x@y.z",
    "hosts 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5 and 0000000000255.1.1.01",
    "cards 4111 1111 1111 1111, 4111111111111112 and 4111-1111-1111-1111 99",
    "call +1 (743) 555-3824 or +49 30 1 or +123456789012345678",
    "4111111111111111 again 4111111111111111 and ref 4111/1111/1111/1111 end",
    "+1 (743) 555-3824 \U0001f600 10.0.0.1",
    "no 12 small 7 numbers",
]


def docs_of(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(50 + i, f"word 41111111111111{i:02d} and host 10.0.{i}.1 call +1 (743) 555-38{i:02d} x", "en", "s") for i in range(60)]
    return documents(spark, rows + [(900, None, None, None), (901, "", "en", "s"), (None, "x@y.zz", None, None), rows[0]])


def test_base_spans(spark):
    docs = docs_of(spark)
    got = find_personal_data(docs, fit(docs)).collect()
    say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    want = [(d, *(sum(s[1] == k for s in plain(t or "")) for k in range(4)), say(plain(t or ""))) for d, t in pairs(docs)]
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_spans) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert not set(filter(None, r.base_spans.split(","))) - set(r.spans.split(","))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_repeats_share_labels(spark):
    docs = docs_of(spark)
    got = {r.doc_id: r for r in find_personal_data(docs, fit(docs)).collect()}
    at = TEXTS[4].index("4111/")
    assert f"card:{at}:{at + 19}" in got[4].spans.split(",")  # malformed, but the digits of a card
    assert got[6].spans == "" and got[900].spans == ""


def test_redaction_keeps_columns(spark):
    docs = docs_of(spark)
    out = redact(docs, fit(docs))
    assert out.schema == SCHEMA
    texts = {r.doc_id: r.text for r in out.collect()}
    assert "[EMAIL]" in texts[0] and "user+x@" not in texts[0]
    assert texts[5] == "[PHONE] \U0001f600 [IP]" and texts[900] is None and texts[901] == ""
    assert redact(documents(spark, []), fit(documents(spark, []))).collect() == []
    assert base_spans("") == []


def test_every_repeat_shares_the_label(spark):
    """One valid match and any number of malformed spellings, in one token or several, of shapes that are common elsewhere."""
    cases = [
        ("card", "4111111111111111", "4111.1111.1111.1111"),
        ("card", "4111 1111 1111 1111", "4111/1111/1111/1111"),
        ("card", "4111111111111111", "4111. 1111. 1111. 1111"),
        ("email", "someone@mail.example.com", "someone@mail_example_com"),
        ("ip", "10.20.30.40", "10-20-30-40"),
        ("phone", "+49 30 12 34 56 78", "49 30 12 34 56 78"),
        ("phone", "+493012345678", "49/30/12/34/56/78"),
    ]
    rows = [(i * 100 + n, f"see {good} then " + " word or ".join([bad] * n) + " end", "en", "s") for i, (_, good, bad) in enumerate(cases) for n in (1, 2, 3, 50)]
    usual = " and ".join(["on 10-20-30-41 we had 1234 of 56 78 at x@y_z or 1234.5678.1234.5678 or 12. 4111. or 1234/5678/1234/5678"] * 50)
    docs = documents(spark, rows + [(9000 + i, usual, "en", "s") for i in range(5)])
    got = {r.doc_id: r for r in find_personal_data(docs, fit(docs)).collect()}
    for d, text, *_ in rows:
        kind, good, bad = cases[d // 100]
        want = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(re.escape(bad), text) if m.start() > len(good)]
        missing = set(want) - set(got[d].spans.split(","))
        assert not missing, (d, text[:80], got[d].spans[:200])
        assert len(got[d].spans.split(",")) == len(set(got[d].base_spans.split(",")) | set(want))
    assert all(got[9000 + i].spans == got[9000 + i].base_spans for i in range(5))


def test_patterns_on_random_and_very_long_runs():
    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice("a1.@-+ 0%9_x2") for _ in range(r.randint(0, 40)))
        assert base_spans(t) == plain(t), t
    n = 300_000
    for t in ("1." + "1" * n, "a" * n + " @", "1.1." * n, "+1" + "(" * n, "a@b." * n, "@a.b" * n, "12 " * n, "a@" * n, "x." * n + "@"):
        began = time.time()
        spans = base_spans(t)
        clamp(candidates(t), spans)
        assert time.time() - began < 20, t[:8]


def test_clamp_against_all_pairs():
    r = random.Random(6)
    for _ in range(300):
        tokens, at = [], 0
        for i in range(r.randint(0, 12)):
            at += r.randint(1, 3)
            tokens.append((i, at, at := at + r.randint(1, 6), "x", i))
        spans = sorted((s := r.randint(0, 50), r.randrange(4), s + r.randint(1, 9)) for _ in range(r.randint(0, 8)))
        want = [next((k for s, k, e in spans if s < end and e > start), -1) for _, start, end, _, _ in tokens]
        assert clamp(tokens, spans) == want


def field(seed=3):
    g = np.random.default_rng(seed)
    repeat = g.normal(size=(N, N))
    return SkipChain({}, g.normal(size=N), g.normal(size=(N, N)), repeat + repeat.T, rounds=200, damping=0.5)


def enumerated(model, tokens, clamped):
    """Log marginals by summing over all labels of tokens and hubs."""
    near, hubs = SkipChain.links(tokens)
    hubs = [m for m in hubs.values() if len(m) > 1]
    unary = [model.unary.get(shape(t[3]), model.default) for t in tokens]
    total = np.zeros((len(tokens), N))
    for own in itertools.product(range(N), repeat=len(tokens)):
        if any(k >= 0 and own[i] != k for i, k in enumerate(clamped)):
            continue
        score = sum(unary[i][k] for i, k in enumerate(own) if clamped[i] < 0) + sum(model.chain[own[i], own[j]] for i, j in near)
        weight = np.exp(score)
        for members in hubs:
            weight *= sum(np.exp(sum(model.repeat[own[i], h] for i in members)) for h in range(N))
        for i, k in enumerate(own):
            total[i, k] += weight
    return total / total.sum(1, keepdims=True)


def test_marginals_against_enumeration():
    """Exact where the field has no loop: a chain with a clamped token, and repeats around one hub."""
    chain = [(i, 10 * i, 10 * i + 2, f"1{i}", i) for i in range(5)]
    star = [(3 * i, 30 * i, 30 * i + 8, "123456-7" if i % 2 else "1234567", 3 * i) for i in range(4)]
    for tokens, clamped in ((chain, [-1] * 5), (chain, [-1, 2, -1, -1, -1]), (star, [-1] * 4)):
        model = field()
        got = np.exp(model.beliefs(tokens, clamped, {}))
        got /= got.sum(1, keepdims=True)
        assert np.allclose(got, enumerated(model, tokens, clamped), atol=1e-6)


def test_potentials_fit_the_labels():
    """Of a shape that is a card half the time, repeats of a card are cards, and others are not."""
    counts = Counter({("16", N, N, 2, 2): 50, ("16", N, N, N - 1, N - 1): 50, ("5", N, N, N, N - 1): 200, ("5", 3, N, N, 3): 30, ("5", N, 3, N, 3): 30})
    model = fit_potentials(counts)
    say = lambda *parts: int(np.sum(parts, 0).argmax())
    assert say(model.unary["16"], model.repeat[2]) == 2 and say(model.unary["16"], model.repeat[N - 1]) == N - 1
    assert say(model.unary["5"]) == N - 1 and say(model.unary["5"], model.chain[3]) == 3 and say(model.unary["5"], model.chain[:, 3]) == 3
    assert fit_potentials(Counter()).unary == {}
