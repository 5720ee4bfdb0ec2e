"""The language of texts by the character trigrams of their words: counted from labelled texts, applied by a join and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelens.operators.keyword import stored

#: Labelled texts that a trigram must be in; trigrams that a text must share with the model; how far the best
#: language must be ahead of the second, in thousandths of a natural logarithm for each trigram.
LEAST_TEXTS, LEAST_GRAMS, AHEAD = 3, 5, 50


def grams(text: Column) -> Column:
    """The distinct trigrams of a text's words, each word between underscores."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    padded = F.transform(words, lambda w: F.concat(F.lit("_"), w, F.lit("_")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def model(texts: DataFrame) -> DataFrame:
    """gram and a column for each language of ``texts`` (text, lang): the floored thousandfold logarithm of the share of its texts that have the gram.

    Languages are few and come to the driver with their numbers of texts. Rows without a language are left out.
    """
    known = texts.filter("lang IS NOT NULL")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    each = known.select("lang", F.explode(grams(F.col("text"))).alias("gram"))
    by = each.groupBy("gram").agg(F.count(F.lit(1)).alias("every"), *[F.count_if(F.col("lang") == lang).alias(lang) for lang in n])
    weight = {lang: F.floor(1000 * F.log((F.col(lang).cast("double") + 1) / (k + 2))).alias(lang) for lang, k in n.items()}
    return stored(by.filter(F.col("every") >= LEAST_TEXTS).select("gram", *weight.values()))


def detected(texts: DataFrame, model_: DataFrame, key: str) -> DataFrame:
    """key (unique) and detected for each of ``texts`` (key, text): the language that its trigrams speak for; null if there are too few or two are close."""
    langs = model_.columns[1:]
    found = texts.select(key, F.explode(grams(F.col("text"))).alias("gram")).join(model_, "gram").groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(lang).alias(lang) for lang in langs])
    order = F.sort_array(F.array(*[F.struct(F.col(lang).alias("score"), F.lit(lang).alias("lang")) for lang in langs]), asc=False)
    best = found.select(key, "n", order.alias("o"))
    second = F.coalesce(F.get("o", F.lit(1))["score"], F.lit(-(1 << 62)))
    sure = (F.col("n") >= LEAST_GRAMS) & (F.get("o", F.lit(0))["score"] - second >= AHEAD * F.col("n"))
    told = best.select(key, F.when(sure, F.get("o", F.lit(0))["lang"]).alias("detected"))
    return texts.select(key).join(told, key, "left")
