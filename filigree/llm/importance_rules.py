"""Quality rules and hashed n-gram importance, in DataFrame operations alone.

Counting rules come first: too few words, or too many words in repeated
8-word windows, fail a document.  The others are judged by the mean
log-likelihood ratio of their hashed n-grams between two smoothed
multinomials, one over trusted documents and one over the whole corpus.  The
n-grams are the single words and the pairs of words in a row, hashed into
``buckets``.  A document is kept where the mean ratio reaches the threshold:
the ``quantile`` of trusted documents that were held out of the multinomial.

The trusted multinomial counts every trusted document but those with
``crc32(doc_id) mod 4 = 3``, the threshold is of all of these, and the corpus
multinomial counts every document.  Every document is scored once; the quantile
is read from the scores, exactly up to 10,000 held-out rows, beyond that within
a ten-thousandth of their ranks.  Labels grow with the corpus, so they are
never shipped: one join by sorting at every size.

Defined cases: a null or empty text has no words, fails and has score 0; null
``doc_id`` is never trusted; repeated rows count repeatedly; a score equal to
the threshold is kept; without trusted rows the corpus is compared with the
uniform distribution and nothing fails by score, and the same without held-out
ones; an empty table gives no rows; very long texts are read in whole, as one
array of words; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

SPACE = "\\x20\\x09-\\x0D"
#: White space and the symbols that are counted.
_BLANKS, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeat_words(df: DataFrame, width: int = 8) -> DataFrame:
    """Add n_repeat_words: how many words lie in windows of ``width`` (8) words found twice or more, by their hashes ``_words``.

    Windows are hashed by doubling; only documents with a repeated hash are
    sorted, so the cost is n log n in a text's words.
    """
    if width != 8:
        raise ValueError("windows are built by three doublings")

    def doubled(name: str, step: int) -> Column:
        h = F.col(name)
        keep = F.size(h) - step
        return F.when(keep > 0, F.zip_with(F.slice(h, F.lit(1), keep), F.slice(h, F.lit(step + 1), keep), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))

    df = df.withColumn("_h", F.col("_words"))
    for step in (1, 2, 4):
        df = df.withColumn("_h", doubled("_h", step))
    df = df.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    last = F.size("_sorted") - 1
    twins = F.zip_with(F.slice("_sorted", F.lit(1), last), F.slice("_sorted", F.lit(2), last), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_starts", F.when(F.col("_again"), F.sort_array(F.array_distinct(F.flatten(twins)))))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("e"), F.lit(0).alias("t")),
        lambda a, p: F.struct((p + width).alias("e"), (a["t"] + width - F.greatest(F.lit(0), a["e"] - p)).alias("t")),
        lambda a: a["t"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_again", "_sorted", "_starts")


def hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def features(h: Column, buckets: int) -> Column:
    """Buckets of single and paired words, by the words' hashes."""
    n = F.size(h) - 1
    single = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    pairs = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.when(n > 0, F.concat(single, pairs)).otherwise(single)


def trusted_ids(labels: DataFrame, held: bool) -> DataFrame:
    """Ids whose labels say quality 1."""
    own = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 3
    return labels.where("quality = 1 and doc_id is not null").where(own if held else ~own).select("doc_id").distinct()


def _hashed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, hashes(words(F.coalesce("text", F.lit("")))).alias("_words"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int) -> list[float]:
    """Log ratio of each bucket: trusted over corpus, each smoothed by one count a bucket."""
    flagged = docs.join(trusted_ids(labels, False).withColumn("_trusted", F.lit(1)).hint("merge"), "doc_id", "left")
    hashed = _hashed(flagged, "_trusted").select("_trusted", F.explode(features(F.col("_words"), buckets)).alias("b"))
    counts = hashed.groupBy("b").agg(F.count("*").alias("raw"), F.count("_trusted").alias("good")).collect()  # at most ``buckets`` rows
    raw, good = [1.0] * buckets, [1.0] * buckets
    for row in counts:
        raw[row.b] += row.raw
        good[row.b] += row.good
    all_raw, all_good = math.fsum(raw), math.fsum(good)
    return [math.log(g / all_good) - math.log(r / all_raw) for g, r in zip(good, raw)]


def mean_ratio(ratios: list[float]) -> Column:
    """Mean ratio of the n-grams of ``_words``; 0 without any."""
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    f = F.col("_f")
    total = F.aggregate(f, F.lit(0.0), lambda a, b: a + F.element_at(table, b + 1))
    return F.when(F.size(f) > 0, total / F.size(f)).otherwise(F.lit(0.0))


def threshold(scored: DataFrame, labels: DataFrame, quantile: float) -> float:
    """The score that ``quantile`` of the held-out trusted documents stay under, of those with words."""
    held = scored.where("n_words > 0").select("doc_id", "score").join(trusted_ids(labels, True).hint("merge"), "doc_id", "left_semi")
    at = held.agg(F.percentile_approx("score", quantile, 10_000)).first()[0]
    return -math.inf if at is None else float(at)


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, quantile: float = 0.02, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    docs = docs.select("doc_id", "text")
    ratios = log_ratios(docs, labels, buckets)
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text")).withColumn("_words", hashes(words(F.col("text"))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = df.withColumn("_lines", lines)
    gone = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    df = df.select(
        "doc_id",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        gone(_SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    df = repeat_words(df).withColumn("_f", features(F.col("_words"), buckets))
    df = df.withColumn("score", mean_ratio(ratios))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    scored = keep(df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score"), "scores")
    limit = threshold(scored, labels, quantile)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(limit)))
