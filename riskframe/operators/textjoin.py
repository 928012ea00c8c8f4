"""Joins of texts with what they contain, through their grams instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram. Shorter needles are grams themselves.
GRAM = 4
#: Characters of all needles up to which their grams go to every task, so that no gram of a text is shuffled that no needle asks for.
FEW = 200_000


def _grams(text: Column, size: Column) -> Column:
    """Distinct substrings of ``size`` characters; of size 0 the empty one."""
    last = F.length(text) - size + 1
    return F.when(size == 0, F.array(F.lit(""))).when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda p: F.substring(text, p, size)))).otherwise(F.array().cast("array<string>"))


def contains_join(texts: DataFrame, needles: DataFrame, keys, text: str, needle: str) -> DataFrame:
    """(keys, text, needle): distinct pairs of equal ``keys`` whose text contains the needle.

    A needle is looked up by the one of its grams that fewest texts of its key hold, and only those texts are searched for it. An empty
    needle is in every text. Null texts and needles match nothing. Grams of a text meet those of few needles where the text is;
    those of many needles are joined by a shuffle."""
    keys = list(keys)
    n = needles.select(*keys, F.col(needle).alias("_n")).filter("_n IS NOT NULL").distinct().withColumn("_size", F.least(F.lit(GRAM), F.length("_n")))
    held_sizes = n.groupBy("_size").agg(F.sum(F.length("_n") + 1)).collect()  # five at most
    sizes, small = [r[0] for r in held_sizes], F.broadcast if sum(r[1] for r in held_sizes) <= FEW else (lambda df: df)
    if not sizes:
        return texts.select(*keys, text).limit(0).withColumn(needle, F.lit(None).cast("string"))
    t = texts.select(*keys, F.col(text).alias("_t")).filter("_t IS NOT NULL").distinct()
    asked = n.select(*keys, "_n", F.explode(_grams(F.col("_n"), F.col("_size"))).alias("_g"))
    held = t.select(*keys, "_t", F.explode(F.flatten(F.array(*[_grams(F.col("_t"), F.lit(s)) for s in sorted(sizes)]))).alias("_g"))
    counts = held.join(small(asked.select(*keys, "_g").distinct()), [*keys, "_g"], "left_semi").groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_c"))
    rarest = asked.join(counts, [*keys, "_g"], "left").groupBy(*keys, "_n").agg(F.min_by("_g", F.struct(F.coalesce("_c", F.lit(0)), "_g")).alias("_g"))
    return held.join(small(rarest), [*keys, "_g"]).filter(F.expr("contains(_t, _n)")).select(*keys, F.col("_t").alias(text), F.col("_n").alias(needle))


def longest_literal(pattern: Column, strip: str = "") -> Column:
    """The longest run of a glob without * ? [ ]; any text that the glob matches holds it. ``strip``: characters cut off the ends of runs."""
    runs = F.split(F.regexp_replace(pattern, r"\[[^\]]*\]?", "*"), r"[*?]+")
    if strip:
        runs = F.transform(runs, lambda r: F.btrim(r, F.lit(strip)))
    return F.aggregate(runs, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
