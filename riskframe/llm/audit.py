"""Filter interaction audit: exact Shapley values and step counts of five document filters, from coalitions.

1. *Failures.* One pass over the texts gives each document a mask of the filters it fails; filter E (a copy of a text with a smaller
   doc_id) joins narrow rows, never texts. Masks are counted per part and label.
2. *Coalitions.* For each of the 32 sets of filters: how many documents does it remove, how many good, how many toxic ones?
3. *Steps.* In an order, a filter removes what the coalition up to it removes and the one before it does not; every count of
   a step is a difference of two coalitions.
4. *Shapley.* The values are the additive game nearest to the coalitions by the Shapley kernel, under the constraint that they
   add up to what all filters remove. The normal equations with a Lagrange multiplier are solved in rationals, so the result is exact; the
   kernel is infinite at the empty and the full set, which the constraint stands for.

Null texts are empty and empty texts have no words (they fail A, not B or C). Rows without doc_id are documents that are copies of none
and have no labels. Rows that repeat a doc_id count one each; only a *smaller* doc_id makes a copy, so repeats do not remove each other.
Several label rows of a document: 1 if any says 1. Other columns, whatever their names, are not read. No documents give no rows."""

from __future__ import annotations

import hashlib
import itertools
import math
from fractions import Fraction
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
UPPER = bytes(range(65, 91))
MARKS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))
#: What is counted of a coalition.
KINDS = ("all", "good", "toxic")
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(text: bytes) -> int:
    """Mask of the filters A to D that this text fails. bytes.split knows exactly the six ASCII white spaces."""
    words = text.split()
    distinct = len(set(words))
    upper, points = len(text) - len(text.translate(None, UPPER)), len(text.translate(None, CONTINUED))
    return (len(words) < 100) | (100 * distinct < 80 * len(words)) << 1 | (100 * upper > 10 * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


def facts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails) of each document."""
    ex.ready(docs.sparkSession)

    def run(batches):
        ex.release()
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([own_failures(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "fails"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, "doc_id long, part string, digest binary, fails int")


def tabulated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by mask of all five filters. At most 2 ** 5 * 4 rows a part."""
    facts = ex.written(facts_of(docs))
    with_id = facts.filter("doc_id is not null").groupBy("doc_id", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    # the join is by document, not by digest: a text with a third of all copies is no hot key
    first = facts.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("original", F.lit(True))
    label = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    judged = with_id.join(first, ["doc_id", "digest"], "left").join(label, "doc_id", "left")
    copies = judged.withColumn("fails", F.col("fails") + F.when(F.col("original").isNull(), COPY).otherwise(0))
    named = copies.select("part", "fails", *(F.coalesce(c, F.lit(0)).alias(c) for c in KINDS[1:]), "n")
    nameless = facts.filter("doc_id is null").select("part", "fails", F.lit(0).alias("good"), F.lit(0).alias("toxic"), F.lit(1).cast("long").alias("n"))
    return named.unionByName(nameless).groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def coalitions(masks: DataFrame) -> DataFrame:
    """(part, documents, and for each kind an array over the 32 sets of filters: how many of them the set removes)."""
    counted = {"all": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    sums = [F.array(*(F.sum(F.when(F.col("fails").bitwiseAND(s) != 0, value).otherwise(0)) for s in range(SETS))).alias(kind) for kind, value in counted.items()]
    return masks.groupBy("part").agg(F.sum("n").alias("documents"), *sums)


@cache
def _inverse() -> list[list[Fraction]]:
    """The inverse of the bordered normal equations: rows and columns of filters, and of the multiplier."""
    n = len(FILTERS)
    proper = [s for s in range(1, SETS - 1)]
    weight = {s: Fraction(n - 1, math.comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in proper}
    matrix = [[sum(weight[s] for s in proper if s >> i & 1 and s >> j & 1) for j in range(n)] + [Fraction(1)] for i in range(n)] + [[Fraction(1)] * n + [Fraction(0)]]
    size = n + 1
    rows = [row + [Fraction(int(i == j)) for j in range(size)] for i, row in enumerate(matrix)]
    for i in range(size):
        pivot = next(r for r in range(i, size) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(size):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [row[size:] for row in rows]


def shapley(removed: list[int]) -> list[Fraction]:
    """The Shapley value of each filter in the game ``removed`` (by set), from the constrained least squares."""
    n = len(FILTERS)
    right = [sum(Fraction(n - 1, math.comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) * removed[s] for s in range(1, SETS - 1) if s >> i & 1) for i in range(n)] + [Fraction(removed[-1])]
    return [sum(a * b for a, b in zip(row, right, strict=True)) for row in _inverse()[:n]]


def steps_of(part: str, documents: int, removed: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """STEPS rows of one part: all orders, all steps."""
    value, full, orders = shapley(removed), SETS - 1, math.factorial(len(FILTERS))
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            upto = before | 1 << f
            here = removed[upto] - removed[before]
            out.append((part, "".join(FILTERS[i] for i in order), step, documents - removed[upto], here, removed[1 << f] - here, removed[full] - removed[full & ~(1 << f)], good[upto] - good[before], toxic[upto] - toxic[before], int(value[f] * orders)))
            before = upto
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """STEPS rows: for each lang value ('' for null), each of the 120 orders of the filters A to E and each of its five steps.

    kept, removed, redundant (fails the step's filter, went earlier), unique_fails (fails this filter only), good_lost and toxic_lost (of
    the removed), shapley (removed by the step's filter, summed over all orders)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(STEPS))

    def run(batches):
        ex.release()
        for batch in batches:
            for row in batch.to_pylist():
                columns = zip(*steps_of(row["part"], row["documents"], *(row[k] for k in KINDS)), strict=True)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], names=target.names)

    return coalitions(tabulated(docs, labels)).mapInArrow(run, STEPS)
