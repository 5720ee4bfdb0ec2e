"""Substring search over an index: files whose text holds a needle, wherever it begins or ends within words.

The vocabulary's terms are found by their character n-grams, so a token that is only a part of a word stands for all words
it is a part of; files that have a word for each token are candidates, and their texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelens.functions.text import tokens
from trovelens.operators.keyword import KeywordIndex, held, looked_up, stored

#: Letters of a gram; tokens that are looked up, the longest ones of a needle.
GRAM, CLUES = 3, 3


def grams_of(word: Column) -> Column:
    """The distinct runs of up to GRAM letters of a word: all of GRAM letters, or the whole of a shorter one."""
    n = F.length(word)
    starts = F.sequence(F.lit(1), F.greatest(n - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(word, i, F.lit(GRAM))))


def vocabulary_grams(index: KeywordIndex) -> DataFrame:
    """gram, term: the terms of the vocabulary by each gram that they hold; 1 to GRAM letters."""
    starts = F.sequence(F.lit(1), F.length("term"))
    every = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*[F.substring(F.col("term"), i, F.lit(n)) for n in range(1, GRAM + 1)]))))
    return index.vocabulary.filter(F.length("term") > 0).select("term", F.explode(every).alias("gram"))


def terms_holding(grams: DataFrame, parts: DataFrame) -> DataFrame:
    """part, term: the terms that have ``part`` (a column of ``parts``, distinct) in them, by the grams they share and then letter by letter."""
    wanted = held(parts.select("part", grams_of(F.col("part")).alias("g")).select("part", F.size("g").alias("n"), F.explode("g").alias("gram")))
    met = grams.join(wanted, "gram").groupBy("part", "term", "n").agg(F.count(F.lit(1)).alias("k")).filter("k = n")
    return met.filter(F.col("term").contains(F.col("part"))).select("part", "term")


def containing(index: KeywordIndex, grams: DataFrame, texts: DataFrame, needles: DataFrame) -> DataFrame:
    """query_id, file_id of the files whose text (file_id, text) has a needle (query_id, needle) in it, letter by letter.

    Needles are cut into tokens as texts are. The first may be the end of a word and the last a beginning, so both stand for all terms that hold
    them; inner ones are whole words, and are terms themselves. A needle of no letter or digit is looked for in all texts.
    """
    t = needles.select("query_id", tokens(F.col("needle")).alias("t"))
    longest = F.slice(F.array_sort(F.transform("t", lambda w, i: F.struct((-F.length(w)).alias("n"), w.alias("part"), ((i > 0) & (i < F.size("t") - 1)).alias("inner")))), 1, CLUES)
    # Short parts stand for most of the vocabulary: they are looked up only where a needle has nothing longer.
    telling = F.filter(longest, lambda c: -c["n"] >= GRAM)
    longest = F.when(F.size(telling) > 0, telling).otherwise(F.slice(longest, 1, 1))
    clues = held(t.select("query_id", F.explode(F.array_distinct(longest)).alias("c")).select("query_id", "c.part", "c.inner").distinct())
    inside = terms_holding(grams, clues.filter("NOT inner").select("part").distinct())
    known = inside.withColumn("inner", F.lit(False)).unionByName(clues.filter("inner").select("part", F.col("part").alias("term"), "inner").distinct())
    found = stored(known)
    met = looked_up(index, found).select("part", "inner", "file_id").distinct().join(clues, ["part", "inner"])
    sizes = clues.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    candidates = met.groupBy("query_id", "file_id").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(sizes), "query_id").filter("k = n").select("query_id", "file_id")
    hits = texts.join(stored(candidates), "file_id").join(held(needles.select("query_id", "needle")), "query_id")
    bare = held(needles.select("query_id", "needle").join(clues.select("query_id").distinct(), "query_id", "left_anti"))
    hits = hits.select("query_id", "file_id", "needle", "text")
    if not bare.isEmpty():
        hits = hits.unionByName(texts.join(bare, F.col("text").contains(F.col("needle"))).select("query_id", "file_id", "needle", "text"))
    return hits.filter(F.col("text").contains(F.col("needle"))).select("query_id", "file_id")
