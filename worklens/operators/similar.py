"""The most similar texts of a block, by filter and verification.

The token-set similarity of two texts needs the longest common subsequence of the words that they do not share, which is
Python's work. Everything else is column arithmetic: the words of a text, their letters, and for a pair the shared words
and lengths. With the letters that both leftovers have as a bound of the subsequence, the similarity has an upper bound
that never lies below it. Per text, the k pairs of the highest bounds are verified first; the k-th best of those known is
the threshold that the bound of any other pair must reach to be verified at all. Equal pairs of texts are verified once,
whatever blocks they meet in. Nothing is lost: a text that is left out has k better ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions.similarity import token_set
from worklens.sources.staging import apart, stage


def profiled(texts: DataFrame, text: str, name: str) -> DataFrame:
    """Adds a struct: sorted distinct words, their number, their length together, and their letters as a set (the k-th
    occurrence of a letter is an element of its own)."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")))
    joined = F.array_join("_words", "")
    letters = F.flatten(F.transform(F.array_distinct(F.split("_joined", "")), lambda c: F.transform(F.sequence(F.lit(1), F.length("_joined") - F.length(F.replace(F.col("_joined"), c, F.lit("")))), lambda k: F.ascii(c).cast("bigint") * (1 << 32) + k)))
    out = texts.withColumn("_words", words).withColumn("_joined", joined)
    profile = F.struct(F.col("_words").alias("words"), F.size("_words").alias("n"), F.length("_joined").alias("length"), F.when(F.length("_joined") > 0, letters).otherwise(F.array().cast("array<bigint>")).alias("letters"))
    return out.withColumn(name, profile).drop("_words", "_joined")


def bounded(pairs: DataFrame, p: str, q: str) -> DataFrame:
    """Adds ``bound``, which the similarity of the profiled texts does not exceed, in the order of its own arithmetic."""
    a, b, s = F.col(p), F.col(q), F.col("_shared")
    pairs = pairs.withColumn("_shared", F.array_intersect(a["words"], b["words"]))
    own = {"_n": F.size("_shared"), "_k": F.length(F.array_join(s, "")), "_gap": (F.size("_shared") > 0).cast("int")}
    pairs = pairs.withColumns(own)
    left = lambda side: side["length"] - F.col("_k") + F.greatest(side["n"] - F.col("_n") - 1, F.lit(0))
    pairs = pairs.withColumns({"_x": left(a), "_y": left(b), "_s": F.col("_k") + F.greatest(F.col("_n") - 1, F.lit(0))})
    letters = F.size(F.array_intersect(a["letters"], b["letters"])) - F.col("_k") + F.greatest(F.least(a["n"], b["n"]) - F.col("_n") - 1, F.lit(0))
    pairs = pairs.withColumn("_lcs", F.least("_x", "_y", letters))
    x, y, n, gap = (F.col(c) for c in ("_x", "_y", "_s", "_gap"))
    with_x, with_y = n + gap + x, n + gap + y
    apart = 100.0 - 100.0 * (x + y - 2 * F.col("_lcs")) / (with_x + with_y)
    sides = F.when(gap > 0, F.greatest(100.0 - 100.0 * (gap + x) / (n + with_x), 100.0 - 100.0 * (gap + y) / (n + with_y)))
    bound = F.when((a["n"] == 0) | (b["n"] == 0), 0.0).when((gap > 0) & ((x == 0) | (y == 0)), 100.0).otherwise(F.greatest(apart, sides))
    # filters are not pushed through columns that are not deterministic: they would copy the whole expression many times
    return pairs.withColumn("bound", bound + 0.0 * F.rand(0)).drop("_shared", "_n", "_k", "_gap", "_x", "_y", "_s", "_lcs")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(l_id, r_id, similar) of the distinct pairs of text ids; texts: id, text."""
    side = lambda name: texts.select(F.col("id").alias(f"{name}_id"), F.col("text").alias(f"{name}_text"))
    pairs = pairs.select("l_id", "r_id").distinct().join(side("l"), "l_id").join(side("r"), "r_id")
    return pairs.select("l_id", "r_id", token_set(F.col("l_text"), F.col("r_text")).alias("similar"))


def waves(pairs: DataFrame, texts: DataFrame, k: int, cutoff: float) -> list[DataFrame]:
    """The pairs (key, l_id, r_id, bound) that are verified, with their similarity: of each key the k of the highest
    bounds; of the next 3 k those that can still be among the k best; of the rest those that can after that.

    Within a key, pairs of equal texts count once."""
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("bound"), "r_id"))
    ranked = stage(pairs.filter(F.col("bound") >= cutoff).withColumn("turn", turn), "bounded")
    done: list[DataFrame] = []
    for low, high in ((0, k), (k, 4 * k), (4 * k, None)):
        part = ranked.filter(F.col("turn") > low)
        part = part.filter(F.col("turn") <= high) if high else part
        if done:
            known = reduce(DataFrame.union, done).select("key", "similar")
            best = known.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similar")))).filter(F.col("place") == k)
            part = part.join(best.select("key", F.col("similar").alias("least")), "key", "left").filter(F.col("bound") >= F.coalesce("least", F.lit(cutoff)))
        found = part.join(verified(part, texts), ["l_id", "r_id"]).select("key", "l_id", "r_id", "bound", "similar")
        done.append(stage(found, "verified") if high else found)
    return done


def block_pairs(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], l_text: str, r_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts: id, text; the left side's distinct texts in blocks: key, l_id, the block's columns and the text; pairs:
    key, l_id, r_id, bound). ``on``: left and right names of the columns that make a block; nulls meet nothing."""
    every = left.select(F.col(l_text).alias("text")).union(right.select(F.col(r_text).alias("text"))).filter("text is not null").distinct()
    texts = stage(profiled(every.withColumn("id", F.monotonically_increasing_id()), "text", "profile"), "texts")
    names = [f"_b{i}" for i in range(len(on))]
    mine = left.select(*(F.col(c).alias(n) for n, (c, _) in zip(names, on)), F.col(l_text).alias("text")).distinct().join(texts, "text")
    mine = stage(mine.withColumnRenamed("id", "l_id").withColumn("key", F.monotonically_increasing_id()), "left")
    theirs = right.select(*(F.col(c).alias(n) for n, (_, c) in zip(names, on)), F.col(r_text).alias("text")).distinct().join(texts, "text")
    theirs = theirs.select(*names, F.col("id").alias("r_id"), F.col("profile").alias("r_profile"))
    pairs = bounded(apart(mine.select("key", "l_id", *names, F.col("profile").alias("l_profile"))).join(theirs, names), "l_profile", "r_profile")
    return texts.select("id", "text"), mine.select("key", "l_id", *names, "text"), pairs.select("key", "l_id", "r_id", "bound")


def most_similar(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], l_text: str, r_text: str, k: int, cutoff: float, other: bool = False) -> DataFrame:
    """Columns of the block (named as on the left), ``l_text``, ``r_text`` and ``similar`` of the distinct texts of each
    block: for each left text at least its k most similar ones of ``cutoff`` or more, and all that tie with the k-th.
    ``other``: a text is not compared with itself. The columns of both sides go by the names given."""
    texts, mine, pairs = block_pairs(left, right, on, l_text, r_text)
    found = reduce(DataFrame.union, waves(pairs.filter("l_id <> r_id") if other else pairs, texts, k, cutoff)).filter(F.col("similar") >= cutoff).drop("bound", "l_id")
    renamed = [F.col(f"_b{i}").alias(c) for i, (c, _) in enumerate(on)]
    out = found.join(apart(mine.select("key", *renamed, F.col("text").alias(l_text))), "key")
    return out.join(texts.select(F.col("id").alias("r_id"), F.col("text").alias(r_text)), "r_id").drop("key", "r_id")

