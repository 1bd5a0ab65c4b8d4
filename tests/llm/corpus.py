"""A small corpus with every awkward case: nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        *(T.StructField(c, T.StringType()) for c in ("h", "rk", "words", "n", "rank", "g", "score", "label", "length", "cell", "chunk", "key")),
    ]
)


def word(r):
    return "".join(r.choice(["an", "er", "tho", "is", "ré", "ing", "st", "wh"]) for _ in range(r.randint(1, 3)))


def prose(r, n):
    out = []
    for i in range(n):
        out.append(word(r) + r.choice(["", "", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def texts(seed=1, n=60):
    r = random.Random(seed)
    out = [None, "", " \n\t ", "a", "one two three four", "one two three four five", "Ünï cödé \U0001f600 #x"]
    out += [prose(r, r.choice([3, 9, 40, 120, 300])) for _ in range(n)]
    passage = prose(r, 60)
    out += [prose(r, 30) + " " + passage + " " + prose(r, 40) for _ in range(8)]
    out += [out[20], out[20], out[21]]
    near = prose(r, 150).split(" ")
    for _ in range(6):
        edit = list(near)
        edit[r.randrange(len(edit))] = "changed"
        out.append(" ".join(edit))
    out.append(("ab " * 900).strip())
    out.append("x" * 700 + "y" + "x" * 500)
    out.append(prose(r, 6000))
    line = prose(r, 12).replace("\n", " ")
    out.append("\n".join([line, "z", line, "", line]))
    return out


def documents(spark, rows=None):
    if rows is None:
        ts = texts()
        rows = [(i, t, ["en", "fr", None][i % 3], ["src0", "src1", None, "src0"][i % 4]) for i, t in enumerate(ts)]
        rows += [rows[30], rows[30], (None, ts[31], None, None), (None, None, None, None)]
    return spark.createDataFrame([(d, t, l, s, len(t or ""), *["x"] * 12) for d, t, l, s in rows], SCHEMA)


def pairs(df):
    """(doc_id, text) of all rows, as brute-force versions take them."""
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
