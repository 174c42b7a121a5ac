"""Back-off n-gram models: estimation, and the table that decoders look probabilities up in.

A model is a table (n, gram, logp, backoff): words of a gram are joined by spaces, logarithms are to base 10, as in ARPA files. The probability of a word after
others is that of the longest gram that ends in it; each word of the context that is given up costs the back-off weight of the longer context, 0 where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.joins import BROADCAST_ROWS, counted_join
from weftline.operators.matching import _marked
from weftline.sources.scratch import let_go, settled

BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"
#: log10 of the probability of the begin mark, which is never predicted.
NEVER = -99.0
#: Discounts where counts of counts give none in range, as in small or artificial corpora.
FALLBACK = (0.5, 1.0, 1.5)


def _windows(sentence: Column, n: int) -> Column:
    """The n-grams of an array of words."""
    count = F.size(sentence) - (n - 1)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(sentence, i, F.lit(n)), " "))
    return F.when(count > 0, cut).otherwise(F.array().cast("array<string>"))


def _context(gram: Column, n: int) -> Column:
    """All words but the last."""
    return F.substring_index(gram, " ", n - 1) if n > 1 else F.lit("")


def _suffix(gram: Column, n: int) -> Column:
    """All words but the first."""
    return F.substring_index(gram, " ", -(n - 1))


def adjusted_counts(texts: DataFrame, tokens: str, order: int = 3) -> list[DataFrame]:
    """For each length from 1 to ``order`` a settled table (gram, a): of the longest grams their counts; of shorter ones the number of different words before them, or their counts if they begin a sentence.

    A text is a sentence between marks; its words must not hold spaces. The begin mark alone is left out.
    """
    sentence = F.concat(F.array(F.lit(BEGIN)), F.coalesce(F.col(tokens), F.array().cast("array<string>")), F.array(F.lit(END)))
    padded = texts.select(sentence.alias("s"))
    count = F.count("*").alias("a")
    longest = padded.select(F.explode(_windows(F.col("s"), order)).alias("gram")).filter(F.col("gram") != BEGIN)
    out = [settled(longest.groupBy("gram").agg(count))]
    for n in range(order - 1, 0, -1):
        inner = out[0].select(_suffix(F.col("gram"), n + 1).alias("gram")).groupBy("gram").agg(count)
        if n > 1:
            first = padded.filter(F.size("s") >= n).select(F.array_join(F.slice("s", 1, n), " ").alias("gram")).groupBy("gram").agg(count)
            inner = inner.unionByName(first)
        out.insert(0, settled(inner))
    return out


def discounts(counts: list[DataFrame]) -> list[tuple[float, float, float]]:
    """For each length what is taken off counts of 1, 2, and 3 or more, from how many grams have counts of 1 to 4."""
    out = []
    for table in counts:
        t = [0] * 5
        for r in table.filter("a <= 4").groupBy("a").count().collect():  # four rows at most
            t[r["a"]] = r["count"]
        if min(t[1:]) > 0:
            y = t[1] / (t[1] + 2 * t[2])
            d = tuple(k - (k + 1) * y * t[k + 1] / t[k] for k in (1, 2, 3))
        else:
            d = FALLBACK
        out.append(d if all(0 <= x <= k for k, x in zip((1, 2, 3), d, strict=True)) else FALLBACK)
    return out


def _cut(a: Column, d: tuple[float, float, float]) -> Column:
    return F.when(a == 1, d[0]).when(a == 2, d[1]).otherwise(d[2])


def estimate(texts: DataFrame, tokens: str, order: int = 3) -> DataFrame:
    """(n, gram, logp, backoff): an interpolated model with modified Kneser-Ney discounts, over the words of ``texts`` and the unknown word. Probabilities of all words after any context add up to 1.

    Each length is one pass: grams are counted, summed by context, and joined to their context's totals and to the probability of the gram without its
    first word. How many grams share a context or an ending is known from the counts, so hot ones are joined by broadcast and never meet in one task.

    Cases: a null or empty text is a sentence without words; without any text only the unknown word and the marks stand, and the unknown word has all probability.
    """
    counts = adjusted_counts(texts, tokens, order)
    taken = discounts(counts)
    a = F.col("a")
    n_of = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    totals = []
    for n, (table, d) in enumerate(zip(counts, taken, strict=True), 1):
        left = d[0] * n_of(a == 1) + d[1] * n_of(a == 2) + d[2] * n_of(a > 2)
        by = table.groupBy(_context(F.col("gram"), n).alias("context")) if n > 1 else table.groupBy(F.lit("").alias("context"))
        totals.append(settled(by.agg(F.sum("a").alias("total"), (left / F.sum("a")).alias("b"), F.count("*").alias("n"))))
    base = totals[0].first()
    words = counts[0].count()
    spread = (base["b"] if base else 1.0) / (words + 1)  # the unknown word is one of the vocabulary
    total = float(base["total"]) if base else 1.0
    known = counts[0].select("gram", a, ((a - _cut(a, taken[0])) / total + spread).alias("p"))
    grams = [settled(known)]
    for n in range(2, order + 1):
        own = counts[n - 1].select("gram", "a", _context(F.col("gram"), n).alias("context"), _suffix(F.col("gram"), n).alias("ending"))
        own = counted_join(own, totals[n - 1], "context")
        shorter = grams[-1].select(F.col("gram").alias("ending"), F.col("p").alias("q"), F.col("a").alias("n"))
        own = counted_join(own, shorter, "ending")
        grams.append(settled(own.select("gram", "a", ((a - _cut(a, taken[n - 1])) / F.col("total") + F.col("b") * F.col("q")).alias("p"))))
    spark = texts.sparkSession
    marks = spark.createDataFrame([(BEGIN, None), (UNKNOWN, spread)], "gram string, p double")
    out = []
    for n, table in enumerate(grams, 1):
        rows = table.select("gram", "p")
        rows = rows.unionByName(marks) if n == 1 else rows
        weight = F.lit(None).cast("double")
        if n < order:
            # one row on each side of every key
            rows = rows.join(totals[n].select(F.col("context").alias("gram"), "b"), "gram", "left")
            weight = F.log10("b")
        out.append(rows.select(F.lit(n).alias("n"), "gram", F.coalesce(F.log10("p"), F.lit(NEVER)).alias("logp"), weight.alias("backoff")))
    model = out[0]
    for x in out[1:]:
        model = model.unionByName(x)
    model = settled(model)
    let_go(*counts, *totals, *grams)
    return model


def _scores_by_kind(model: DataFrame, texts: DataFrame, key: list[str], tokens: str, order: int = 3) -> DataFrame:
    """``sentence_scores`` of any model: each word is looked up with the words before it; the lookups are counted and made once for each kind."""
    sentence = F.concat(F.array(F.lit(BEGIN)), F.coalesce(F.col(tokens), F.array().cast("array<string>")), F.array(F.lit(END)))
    rows = texts.select(*key, F.posexplode(sentence).alias("i", "w"))
    said = settled(rows.groupBy("w").agg(F.count("*").alias("n")))
    known = settled(said.join(model.filter("n = 1").select(F.col("gram").alias("w"), F.lit(True).alias("known")), "w"))
    marked = counted_join(rows, known, "w").withColumn("w", F.when(F.col("known"), F.col("w")).otherwise(UNKNOWN))
    sentences = marked.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("s"))
    last = lambda i: F.array_join(F.slice("s", F.greatest(i - (order - 1), F.lit(1)), F.least(i, F.lit(order))), " ")
    asked = settled(sentences.select(*key, F.explode(F.transform(F.sequence(F.lit(2), F.size("s")), last)).alias("gram")))
    kinds = settled(asked.groupBy("gram").agg(F.count("*").alias("times")))
    told = kinds.withColumn("size", F.size(F.split("gram", " ")))
    ending = lambda n: F.when(F.col("size") >= n, F.substring_index("gram", " ", -n))
    before = lambda n: F.when(F.col("size") > n, F.substring_index(F.substring_index("gram", " ", -(n + 1)), " ", n))
    for n in range(1, order + 1):
        for name, part, value in [(f"p{n}", ending(n), "logp"), *([(f"b{n}", before(n), "backoff")] if n < order else [])]:
            told = told.withColumn("part", part)
            own = told.filter("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("n"))
            found = settled(own.join(model.filter(F.col("n") == n).select(F.col("gram").alias("part"), F.col(value).alias(name)), "part"))
            told = counted_join(told, found, "part").drop("part")
    logp = F.col("p1")
    for n in range(2, order + 1):
        logp = F.coalesce(F.col(f"p{n}"), logp + F.coalesce(f"b{n - 1}", F.lit(0.0)))
    told = settled(told.select("gram", logp.alias("logp"), F.col("times").alias("n")))
    each = counted_join(asked, told, "gram")
    unknown = F.substring_index("gram", " ", -1) == UNKNOWN
    return each.groupBy(*key).agg((F.count("*") - 1).alias("words"), F.sum(unknown.cast("long")).alias("unknown"), F.sum("logp").alias("logp"))


def _looked_up(told: DataFrame, part: Column, table: DataFrame, value: str, name: str) -> DataFrame:
    """``told`` with ``name``: the ``value`` that ``table`` (gram, value) has for the gram ``part``, null without one."""
    told = settled(told.withColumn("part", part))
    own = told.groupBy("part").agg(F.count("*").alias("n"))
    found = settled(own.join(table.select(F.col("gram").alias("part"), F.col(value).alias(name)), "part"))
    return counted_join(told, found, "part").drop("part")


def _gains(model: DataFrame, k: int, unknown: float) -> DataFrame:
    """(gram, e, b) of the model's grams of ``k`` words: what log10 of the probability of the last word gains over what the shorter grams give it, and the back-off weight (0 without one)."""
    own = model.filter(F.col("n") == k).select("gram", "logp", F.coalesce("backoff", F.lit(0.0)).alias("b"))
    shorter = None
    for j in range(1, k):
        table = model.filter(F.col("n") == j)
        own = _looked_up(own, F.substring_index("gram", " ", -j), table, "logp", "p")
        shorter = F.coalesce("p", F.lit(unknown) if j == 1 else F.col("r"))
        own = _looked_up(own.withColumn("r", shorter).drop("p"), F.substring_index(F.substring_index("gram", " ", -(j + 1)), " ", j), table, "backoff", "w")
        own = own.withColumn("r", F.col("r") + F.coalesce("w", F.lit(0.0))).drop("w")
    return settled(own.select("gram", (F.col("logp") - (F.col("r") if k > 1 else F.lit(0.0))).alias("e"), "b"))


def sentence_scores(model: DataFrame, texts: DataFrame, key: list[str], tokens: str, order: int = 3) -> DataFrame:
    """``key`` columns (told apart by them, not null), words, unknown and logp: how many words each text has, how many of them the model doesn't know, and log10 of the text's probability, end mark included.

    A text's logarithm is a sum: of its words' alone, of the weights of all contexts, and, for each longer gram that the model has, of what it gains over those (``_gains``, worked out once for each gram of the model). So words are met
    with the vocabulary, and of longer grams only those that the model may have leave their task.
    """
    top = model.filter(F.col("gram") == UNKNOWN).select("n", "logp").first()
    if top is None or top["n"] != 1 or not model.filter((F.col("n") > 1) & F.array_contains(F.split("gram", " "), UNKNOWN)).isEmpty():
        return _scores_by_kind(model, texts, key, tokens, order)
    sentence = F.concat(F.array(F.lit(BEGIN)), F.coalesce(F.col(tokens), F.array().cast("array<string>")), F.array(F.lit(END)))
    padded = texts.select(*key, sentence.alias("s"))
    parts = []
    for k in range(1, order + 1):
        gains = _gains(model, k, top["logp"])
        rows = padded.select(*key, F.size("s").alias("size"), F.posexplode(_windows(F.col("s"), k)).alias("i", "gram"))
        # the begin mark is no word that is predicted, and nothing follows the last word
        rows = rows.select(*key, "gram", *([(F.col("i") > 0).alias("said")] if k == 1 else []), (F.col("i") + k < F.col("size")).alias("followed"))
        if gains.count() <= BROADCAST_ROWS:
            met = rows.join(F.broadcast(gains), "gram", "left" if k == 1 else "inner")
        else:
            rows = settled(rows if k == 1 else _marked(rows, gains.select("gram")))
            found = settled(rows.groupBy("gram").agg(F.count("*").alias("n")).join(gains, "gram"))
            met = counted_join(rows, found, "gram")
        weight = F.when(F.col("followed"), F.col("b")) if k < order else F.lit(0.0)
        if k == 1:
            unknown = F.col("said") & (F.col("e").isNull() | (F.col("gram") == UNKNOWN))
            logp = F.when(F.col("said"), F.coalesce("e", F.lit(top["logp"]))).otherwise(0.0) + F.coalesce(weight, F.lit(0.0))
            parts.append(met.groupBy(*key).agg((F.count("*") - 2).alias("words"), F.sum(unknown.cast("long")).alias("unknown"), F.sum(logp).alias("logp")))
        else:
            none = F.lit(0).cast("long")
            parts.append(met.groupBy(*key).agg(none.alias("words"), none.alias("unknown"), F.sum(F.coalesce("e", F.lit(0.0)) + F.coalesce(weight, F.lit(0.0))).alias("logp")))
    total = parts[0]
    for x in parts[1:]:
        total = total.unionByName(x)
    return total.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("words", "unknown", "logp")))
