"""Personal data: exact patterns, extended by a skip-chain conditional random field.

The base spans are the leftmost matches of four patterns that pass their
checks.  Tokens around them (those with a digit or ``@``; no other token can
be personal data here) then form a conditional random field:

* unary potentials: log odds of a label given the token's shape;
* chain potentials between candidate tokens that follow one another;
* skip potentials between each token and the hub variables of its keys (same
  digits, same four numbers of an address, or same letters and digits without
  case and punctuation), through which all repeats share labels.

Loopy sum-product message passing over the whole document makes labels agree:
a malformed number is marked where the same digits stand in a valid one.
A hub whose key is that of a whole base span is observed and settles its tokens,
however many repeats no pattern matches and however usual their shape is
elsewhere; tokens in a row that together have a span's digits are one token.
Tokens of base spans are clamped.  Decoded tokens outside base spans add
spans; base spans always stay.

Potentials maximise the penalised pseudo-likelihood of the labels that the base
patterns give, over the counted configurations (shape, labels of both
neighbours and of equal repeats) of all documents; application covers every
whole text.  The cost is linear in a text's length: patterns read a run of
characters once, and a repeat is linked to its hubs, never to other repeats.

Defined cases: a null or empty text has no spans; repeated rows are handled
alike; offsets count code points, ends are exclusive; spans of different kinds
may overlap, and a token that several meet has the kind of the first; very long
texts are one field; an empty table gives no rows, and potentials of no data
add spans only for repeats of base ones; other columns are ignored, and pass
``redact`` whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that a long run of their characters is read once: a number is only
#: tried from its first digit, and an address from its ``@`` (``emails``).
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LONG = re.compile(r"[0-9](?:[\x20-]?[0-9]){11}")  # twelve digits at least, as a card needs
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NUMBER = re.compile(r"[0-9]+")
_PLAIN = re.compile(r"[\W_]+")
_WORDS = re.compile(r"\w")

Span = tuple[int, int, int]  # start, kind, end
Token = tuple[int, int, int, str, int]  # first number, start, end, text, last number
N = len(KINDS) + 1  # labels: the kinds, then none


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``local@domain``, an ``@`` at a time; each has one."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            before = text[low:at]
            local = len(before) - len(before.rstrip(_LOCAL))
            if local:
                out.append((at - local, m.end()))
        low = max(at + 1, out[-1][1] if out else 0)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Matches that pass their checks, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    if _LONG.search(text):
        for m in CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    out.sort()
    return out


def shape(token: str) -> str:
    """What a unary potential sees: counts of characters by class, coarsely, and whether a card's checksum fails."""
    number = _NOT_DIGIT.sub("", token)
    digits = len(number)
    letters = sum(c.isalpha() for c in token)
    return f"{min(digits, 20)}{'a' * min(2, (letters + 3) // 4)}{'@' * ('@' in token)}{'+' * (token[0] == '+')}{'(' * ('(' in token)}{'-' * min(3, token.count('-'))}{'.' * min(3, token.strip('.,').count('.'))}{'!' * (12 <= digits <= 19 and not luhn(number))}"


def similar(token: str) -> str:
    """Key of tokens that share potentials: six digits or more, else the letters and digits; '' for short ones."""
    digits = _NOT_DIGIT.sub("", token)
    if len(digits) >= 6 and "@" not in token:
        return digits
    plain = _PLAIN.sub("", token).lower()
    return plain if len(plain) >= 6 else ""


def address(token: str) -> str:
    """Key of tokens with the four numbers of an address; '' for others."""
    parts = _NUMBER.findall(token)
    return "ip:" + ".".join(p.lstrip("0") or "0" for p in parts) if len(parts) == 4 and "@" not in token and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts) else ""


def keys(token: str) -> list[str]:
    return [k for k in (similar(token), address(token)) if k]


def span_keys(text: str, spans: list[Span]) -> dict[str, int]:
    """Kinds of the keys of base spans as wholes, the first span's where several share one."""
    out: dict[str, int] = {}
    for s, k, e in spans:
        whole = text[s:e]
        if key := address(whole) if k == 1 else _NOT_DIGIT.sub("", whole) if k >= 2 else similar(whole):
            out.setdefault(key, k)
    return out


def joined(text: str, tokens: list[Token], clamped: list[int], known: dict[str, int]) -> tuple[list[Token], list[int]]:
    """Tokens, with those in a row that together have the digits of a card or phone made one."""
    sizes = sorted({len(k) for k, kind in known.items() if kind >= 2}, reverse=True)
    if not sizes:
        return tokens, clamped
    digits = [_NOT_DIGIT.sub("", t[3]) if k < 0 and "@" not in t[3] else "" for t, k in zip(tokens, clamped)]
    out, kinds, i = [], [], 0
    while i < len(tokens):
        together, ends = digits[i], {}
        j = i
        while together and len(together) < sizes[0] and j + 1 < len(tokens) and digits[j + 1]:
            gap = text[tokens[j][2] : tokens[j + 1][1]]
            if len(gap) > 4 or _WORDS.search(gap):
                break
            j += 1
            together += digits[j]
            ends[len(together)] = j
        j = next((ends[n] for n in sizes if n in ends and known.get(together[:n], -1) >= 2), i)
        first, start, _, token, last = tokens[i]
        if j > i:
            token, last = text[start : tokens[j][2]], tokens[j][4]
        out.append((first, start, tokens[j][2], token, last))
        kinds.append(clamped[i])
        i = j + 1
    return out, kinds


def candidates(text: str) -> list[Token]:
    """Tokens with a digit or @."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    return [(i, m.start(), m.end(), m[0], i) for i, m in enumerate(_TOKEN.finditer(text)) if "@" in m[0] or _DIGIT.search(m[0])]


def clamp(tokens: list[Token], spans: list[Span]) -> list[int]:
    """The kind of the base span that a token meets, or -1."""
    out, live, at = [], [], 0
    for _, start, end, _, _ in tokens:
        while at < len(spans) and spans[at][0] < end:
            live.append(spans[at])
            at += 1
        live = [s for s in live if s[2] > start]
        out.append(live[0][1] if live else -1)
    return out


class SkipChain:
    """Potentials of the field, and inference by loopy sum-product."""

    def __init__(self, unary: dict[str, np.ndarray], default: np.ndarray, chain: np.ndarray, repeat: np.ndarray, rounds: int = 8, damping: float = 0.3):
        self.unary, self.default, self.chain, self.repeat = unary, default, chain, repeat
        self.rounds, self.damping = rounds, damping

    @staticmethod
    def links(tokens: list[Token]) -> tuple[list[tuple[int, int]], dict[str, list[int]]]:
        """Chain edges between candidate tokens, and the tokens of each key."""
        near = [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1][0] == tokens[i][4] + 1]
        hubs: dict[str, list[int]] = {}
        for i, t in enumerate(tokens):
            for key in keys(t[3]):
                hubs.setdefault(key, []).append(i)
        return near, hubs

    def decode(self, tokens: list[Token], clamped: list[int], known: dict[str, int]) -> list[int]:
        return self.beliefs(tokens, clamped, known).argmax(1).tolist()

    def beliefs(self, tokens: list[Token], clamped: list[int], known: dict[str, int]) -> np.ndarray:
        """Log marginals of the tokens' labels, up to a constant each."""
        n = len(tokens)
        unary = np.array([self.unary.get(shape(t[3]), self.default) for t in tokens])
        near, hubs = self.links(tokens)
        far, fixed = [], list(clamped)
        for key, members in hubs.items():
            if key in known:  # an observed hub
                for i in members:
                    fixed[i] = known[key] if fixed[i] < 0 else fixed[i]
                continue
            sure = [clamped[i] for i in members if clamped[i] >= 0 and not (clamped[i] == 1 and not key.startswith("ip:"))]
            if sure:  # parts of base spans
                unary[members] += self.repeat[Counter(sure).most_common(1)[0][0]]
            elif len(members) > 1:
                far += [(i, n) for i in members]
                unary = np.concatenate([unary, np.zeros((1, N))])
                n += 1
        for i, k in enumerate(fixed):
            if k >= 0:
                unary[i] = -30.0
                unary[i, k] = 0.0
        edges = near + far
        if not edges:
            return unary[: len(tokens)]
        a, b = np.array(edges).T
        pot = np.concatenate([np.repeat(self.chain[None], len(near), 0), np.repeat(self.repeat[None], len(far), 0)])
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(src), N))
        for _ in range(self.rounds):
            belief = unary.copy()
            np.add.at(belief, dst, message)
            out = np.logaddexp.reduce((belief[src] - message[back])[:, :, None] + pot, axis=1)
            out -= np.logaddexp.reduce(out, axis=1)[:, None]
            message = self.damping * message + (1 - self.damping) * out
        belief = unary.copy()
        np.add.at(belief, dst, message)
        return belief[: len(tokens)]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        tokens = candidates(text)
        if not tokens:
            return base, base
        clamped = clamp(tokens, base)
        if all(k >= 0 for k in clamped):
            return base, base
        known = span_keys(text, base)
        tokens, clamped = joined(text, tokens, clamped, known)
        labels = self.decode(tokens, clamped, known)
        added: list[list[int]] = []
        last = -2
        for (first, start, _, token, number), label, own in zip(tokens, labels, clamped):
            if label == N - 1 or own >= 0:
                continue
            # trailing punctuation stays outside
            s, e = start + len(token) - len(token.lstrip(".,;:!?\"'(<[")), start + len(token.rstrip(".,;:!?\"')>]"))
            if added and added[-1][1] == label and first == last + 1:
                added[-1][2] = max(e, s)
            elif e > s:
                added.append([s, label, e])
            last = number
        return base, sorted(base + [tuple(x) for x in added])


def count_configurations(texts: Iterator[str | None]) -> Counter:
    """How often a token of a shape, its neighbours and its repeats have their labels: (shape, left, right, repeats, own)."""
    out: Counter = Counter()
    for text in texts:
        tokens = candidates(text or "")
        if not tokens:
            continue
        base = base_spans(text or "")
        labels = [k if k >= 0 else N - 1 for k in clamp(tokens, base)]
        known = span_keys(text or "", base)
        same: dict[str, Counter] = {}
        for t, k in zip(tokens, labels):
            same.setdefault(t[3], Counter())[k] += 1
        for i, (t, k) in enumerate(zip(tokens, labels)):
            if k == N - 1 and any(key in known for key in keys(t[3])):
                continue  # a repeat that no pattern matches: of no known label
            left = labels[i - 1] if i and t[0] == tokens[i - 1][4] + 1 else N
            right = labels[i + 1] if i + 1 < len(tokens) and tokens[i + 1][0] == t[4] + 1 else N
            others = same[t[3]] - Counter([k])
            repeats = max(others, key=lambda x: (others[x], -x)) if others else N
            out[shape(t[3]), left, right, repeats, k] += 1
    return out


def fit_potentials(counts: Counter, steps: int = 300, rate: float = 0.2, strength: float = 1.0) -> SkipChain:
    """Potentials of greatest penalised pseudo-likelihood: each label given its token's shape, neighbours and repeats."""
    prior = np.ones(N)
    for (*_, k), n in counts.items():
        prior[k] += n
    prior /= prior.sum()
    default = np.log(0.1 * prior + 0.9 * np.eye(N)[N - 1])
    none = np.zeros((N, N))
    if not counts:
        return SkipChain({}, default, none, none)
    rows = sorted(counts)
    shapes = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(shapes)}
    s = np.array([number[r[0]] for r in rows])
    left, right, repeats, own = np.array([r[1:] for r in rows]).T
    n = np.array([counts[r] for r in rows], float)
    total = n.sum()
    target = np.eye(N)[own]
    params = [np.tile(default, (len(shapes), 1)), none.copy(), none.copy()]
    start = [p.copy() for p in params]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pad = lambda m: np.concatenate([m, np.zeros((1, N))])  # noqa: E731  no neighbour, no potential
    for step in range(1, steps + 1):
        unary, chain, half = params
        repeat = half + half.T
        score = unary[s] + pad(chain)[left] + pad(chain.T)[right] + pad(repeat)[repeats]
        p = np.exp(score - score.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - target) * n[:, None]
        sums = [np.stack([np.bincount(i, error[:, k], minlength=size) for k in range(N)], 1) for i, size in ((s, len(shapes)), (left, N + 1), (right, N + 1), (repeats, N + 1))]
        of_repeat = sums[3][:N] + sums[3][:N].T
        slopes = [sums[0], sums[1][:N] + sums[2][:N].T, of_repeat]
        for i, slope in enumerate(slopes):
            slope = (slope + strength * (params[i] - start[i])) / total
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope * slope
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-10) * min(1.0, 2 * (1 - step / (steps + 1)))
    unary, chain, half = params
    return SkipChain(dict(zip(shapes, unary)), default, chain, half + half.T)


def fit(docs: DataFrame) -> SkipChain:
    """Potentials from all documents; shapes are a few thousand at most, so configurations are bounded as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts += count_configurations(batch.column(0).to_pylist())
        rows = [(*r, n) for r, n in counts.items()]
        yield pa.record_batch({"s": pa.array([r[0] for r in rows], pa.string()), **{c: pa.array([r[i + 1] for r in rows], pa.int64()) for i, c in enumerate(("l", "r", "m", "k", "n"))}})

    sums = docs.select("text").mapInArrow(run, "s string, l long, r long, m long, k long, n long").groupBy("s", "l", "r", "m", "k").agg(F.sum("n").alias("n")).collect()
    return fit_potentials(Counter({(x.s, x.l, x.r, x.m, x.k): x.n for x in sums}))


def text_of(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, model: SkipChain) -> DataFrame:
    """doc_id, counts of base spans, base and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.spans(t or "") for t in batch.column(1).to_pylist()]
            counts = np.zeros((len(found), len(KINDS)), np.int64)
            for i, (base, _) in enumerate(found):
                for _, k, _ in base:
                    counts[i, k] += 1
            yield pa.record_batch({"doc_id": batch.column(0), **{f"n_{k}": counts[:, i] for i, k in enumerate(KINDS)}, "base_spans": [text_of(b) for b, _ in found], "spans": [text_of(a) for _, a in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string")


def redact(docs: DataFrame, model: SkipChain) -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets; other columns as they are."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, k, e in model.spans(text)[1]:
            if e <= at:
                continue
            out += [text[at : max(s, at)], f"[{KINDS[k].upper()}]"] if s >= at else []
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


