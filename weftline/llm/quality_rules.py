"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over ``BUCKETS`` hashed word and word-pair buckets are counted
over all whole texts, one of the trusted documents (``labels.quality`` = 1) and
one of all documents. A document's score is the mean over its n-grams of
log(p_target / p_raw), so length does not enter; documents under a fixed
threshold are rejected, as are those that fail the base rules (fewer than ten
words, or more than a fifth of the words inside repeated five-word windows).

Only built-in functions run: tokens, windows and hashes stay inside array
expressions of one row, and the bucket counts are summed before they are shuffled.

Cases: a null or empty text has no words, score 0 and fails the base rules; a
document with several labels counts as trusted if any of them is 1; null labels
and null ids are never trusted; without trusted documents all scores are those
of the smoothed counts; repeated rows are counted and returned each; an empty
table gives an empty result; other columns pass through ``keep`` untouched.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import WORD_CLASS, materialize, sized_broadcast, table, words

BUCKETS = 10_000
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Mean log ratio per n-gram under which a document is rejected.
THRESHOLD = -0.1
LEAST_WORDS = 10
WINDOW = 5
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, though ``body`` uses it within further lambdas."""
    return F.transform(F.array(value), body)[0]


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Bucket numbers of all tokens and neighbouring pairs of tokens."""

    def of(t):
        one = F.transform(t, lambda a: F.pmod(F.xxhash64(a), F.lit(buckets)).cast("int"))
        two = F.when(F.size(t) > 1, F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.pmod(F.xxhash64(a, F.lit(" "), b), F.lit(buckets)).cast("int")))
        return F.concat(one, F.coalesce(two, F.array().cast("array<int>")))

    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), of)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows that are found twice or more in the array ``w``. Equal hashes only select the arrays to look at; the windows' own words are compared."""

    def exact(w):
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.struct(F.array_join(F.slice(w, i + 1, F.lit(window)), " ").alias("s"), i.alias("i")))

        def found(z):
            twice = F.transform(z, lambda x, j: F.when(((j > 0) & (z[F.greatest(j - 1, F.lit(0))]["s"] == x["s"])) | ((j < F.size(z) - 1) & (z[F.least(j + 1, F.size(z) - 1)]["s"] == x["s"])), x["i"]))
            return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))

        def covered(p):
            return F.aggregate(F.transform(p, lambda x, j: F.when(j < F.size(p) - 1, F.least(F.lit(window), p[F.least(j + 1, F.size(p) - 1)] - x)).otherwise(window)), F.lit(0), lambda a, x: a + x)

        return let(let(F.sort_array(windows), found), covered)

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(w[i + k] for k in range(window))))
    return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(w)))).cast("long")


def base_rules(text: Column) -> Column:
    """Struct of n_words, word_chars, n_repeat_words, n_symbols and n_dup_lines."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD_CLASS))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        ),
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, log_ratio) of every bucket: ``buckets`` rows. ``trusted`` has a column doc_id without repeats."""
    marked = docs.select("doc_id", "text").join(sized_broadcast(trusted.select("doc_id", F.lit(1).alias("in_target"))), "doc_id", "left")
    counts = marked.select(F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"), F.coalesce("in_target", F.lit(0)).alias("in_target")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("in_target").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = materialize(every.join(F.broadcast(counts), "bucket", "left").na.fill(0), "quality-counts")
    total = counts.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    share = lambda n, of: F.log((n + smoothing) / (of + smoothing * buckets))
    return counts.select("bucket", (share(F.col("target"), total.select("targets").scalar()) - share(F.col("raw"), total.select("raws").scalar())).alias("log_ratio"))


def assess(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct ``quality_rules``: the base rules, base_failed, score, kept."""
    # `buckets` numbers, whatever the corpus; as a constant they are folded into the plan once
    ratios = sorted((r["bucket"], r["log_ratio"]) for r in log_ratios(docs, trusted, buckets).toLocalIterator())
    ordered = F.from_json(F.lit(json.dumps([x for _, x in ratios])), "array<double>")
    score = let(F.struct(ngram_buckets(F.col("text"), buckets).alias("b"), ordered.alias("r")), lambda s: F.when(F.size(s["b"]) == 0, F.lit(0.0)).otherwise(let(s["r"], lambda r: F.aggregate(s["b"], F.lit(0.0), lambda a, b: a + r[b])) / F.size(s["b"])))

    def verdict(r):
        failed = (r["n_words"] < LEAST_WORDS) | (100 * r["n_repeat_words"] > 20 * r["n_words"])
        fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return let(score, lambda s: F.struct(*(r[x].alias(x) for x in fields), failed.alias("base_failed"), s.alias("score"), (~failed & (s >= threshold)).alias("kept")))

    return docs.withColumn("quality_rules", let(base_rules(F.col("text")), verdict))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def keep(docs: DataFrame, trusted: DataFrame, **how) -> DataFrame:
    """The documents that stay, with their own columns."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    slim = docs.select(F.struct(*own).alias("row"), F.col("doc_id"), F.col("text"))
    return assess(slim, trusted, **how).filter("quality_rules.kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assess(docs, trusted_ids(table(spark, sf_dir, "labels"))).select("doc_id", "quality_rules.*")
