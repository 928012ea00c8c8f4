"""Join of documents by Jaccard similarity of word shingles: size-aware, light sets and heavy sets apart.

Equal sets are one node. A *light* set (at most ``boundary`` shingles) enumerates its subsets of every size
that a partner must share; two light sets with a subset in common are judged by its size alone. A *heavy* set
goes to the inverted lists of the few shingles that any partner must touch (its rarest ones), and lists are
scanned for partners, which are then compared set by set. Sets near the boundary do both. The boundary is the
size at which enumerating costs more than scanning, from the sizes of all sets.

Rarity comes from a counting sketch of all shingles, of fixed size (``2 ** sketch_bits`` bytes when it is
sent out); it orders shingles, so a poor count costs time and never a link. Groups are never expanded into
all pairs: a list first links its members with the one whose rare shingles are fewest; once components are
known, only members of different components are compared.

Shingles and sets are held by 64-bit hashes (sets also by size). Null texts and texts without words have
empty sets and link with nothing; rows that repeat a doc_id count as that document, whose sets link; rows without
doc_id are left out."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as ex
from .components import components
from .words import mixed, runs_hashed, words_of

#: Cost of one place in an inverted list, with its share of comparisons, in enumerated subsets.
SCAN_COST = 6
LARGEST_LIGHT = 60
SLICES = 16


def shingle_sets(texts: list[bytes | None], n: int = 3) -> list[np.ndarray]:
    """Ordered distinct shingles of each text; a text of fewer words is one shingle."""
    words = words_of(texts, lower=True)
    grams, out = runs_hashed(words.hashes, n), []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo:hi - n + 1]))
        else:
            out.append(runs_hashed(words.hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def node_of(members: np.ndarray) -> int:
    """The digest of a set, as a signed 64-bit value."""
    return int(mixed(mixed(members).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(members))).astype(np.int64)[0])


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any partner, at least."""
    return -(-percent * n // 100)


def facts_and_sketch(docs: DataFrame, n: int, sketch_bits: int) -> DataFrame:
    """(doc_id, version, node, n) of each document (``version``: hash of the text), and for each task slices of its counts of shingles."""
    ex.ready(docs.sparkSession)

    def run(batches):
        ex.release()
        counts = np.zeros(1 << sketch_bits, np.uint16)
        for batch in batches:
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), n)
            place, more = np.unique(np.concatenate(sets) & np.uint64((1 << sketch_bits) - 1) if sets else np.zeros(0, np.uint64), return_counts=True)
            place = place.astype(np.int64)
            counts[place] = np.minimum(counts[place].astype(np.int64) + more, 65535)
            yield pa.record_batch([batch.column("doc_id"), batch.column("version"), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())], names=["doc_id", "version", "node", "n", "slice", "payload"])
        for i, part in enumerate(np.split(counts, SLICES)):
            if part.any():
                yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([i], pa.int64()), pa.array([ex.pack(part)], pa.binary())], names=["doc_id", "version", "node", "n", "slice", "payload"])

    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").mapInArrow(run, "doc_id long, version long, node long, n long, slice long, payload binary")


def sketch_of(parts: DataFrame, sketch_bits: int) -> np.ndarray:
    """The counts of all tasks in classes of half powers of two: 2 ** sketch_bits bytes, at any size of input."""

    def answer(key, own):
        total = np.zeros((1 << sketch_bits) // SLICES, np.int64)
        for _, p in own[0]:
            total += ex.unpack(p)[0]
        return ex.bundles([(key, 0, 0, ex.pack(np.floor(2 * np.log2(total + 1)).astype(np.uint8)))])

    out = np.zeros((SLICES, (1 << sketch_bits) // SLICES), np.uint8)
    for row in ex.by_key(parts.select(F.col("slice").alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("sender"), "payload"), answer).collect():
        out[row.key] = ex.unpack(row.payload)[0]
    return out.reshape(-1)


def boundary_of(facts: DataFrame, percent: int) -> int:
    """The largest size that is light: where all sets together cost least."""
    sizes = {r.n: r["count"] for r in facts.filter(f"n between 1 and {LARGEST_LIGHT}").select("node", "n").distinct().groupBy("n").count().collect()}

    def enumerated(n: int) -> int:
        return sum(math.comb(n, d) for d in range(n - least_overlap(n, percent) + 1))

    cost, best = 0, (0, 0)
    for n in range(1, LARGEST_LIGHT + 1):
        cost += sizes.get(n, 0) * (enumerated(n) - SCAN_COST * (n - least_overlap(n, percent) + 1))
        best = min(best, (cost, -n))
    return -best[1]


def subsets_of(members: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(digest, size) of each subset that a partner of another set must share."""
    n, values = len(members), mixed(members)
    least, total = least_overlap(n, percent), int(values.sum(dtype=np.uint64))
    if least == n and 100 * n < percent * (n + 1):
        return []
    parts = [int(v) for v in values]
    out = []
    for d in range(n - least + 1):
        for gone in itertools.combinations(parts, d):
            out.append(((total - sum(gone)) % (1 << 64), n - d))
    digest = mixed(np.array([x for x, _ in out], np.uint64) ^ np.array([o for _, o in out], np.uint64)).astype(np.int64)
    return list(zip(digest.tolist(), (o for _, o in out), strict=True))


def signatures(docs: DataFrame, n: int, percent: int, boundary: int, sketch: np.ndarray) -> DataFrame:
    """(gram, node, n, place, common): places of heavy sets in inverted lists, and subsets (with their size) of light sets.

    ``place`` counts the rarer shingles of the set. Equal sets send once for each task."""
    ex.ready(docs.sparkSession)
    sent, mask = docs.sparkSession.sparkContext.broadcast(sketch), np.uint64(len(sketch) - 1)

    def run(batches):
        ex.release()
        seen: set[int] = set()
        for batch in batches:
            columns = [[], [], [], [], []]
            for members in shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), n):
                size = len(members)
                if not size or (node := node_of(members)) in seen:
                    continue
                seen.add(node)
                if size <= boundary and (found := subsets_of(members, percent)):
                    gram, common = zip(*found, strict=True)
                    for c, v in zip(columns, (gram, [node] * len(gram), [size] * len(gram), [0] * len(gram), common), strict=True):
                        c.append(np.array(v, np.int64))
                if size > boundary or 100 * size >= percent * (boundary + 1):
                    reach = size - least_overlap(size, percent) + 1
                    rare = members[np.lexsort((members, sent.value[(members & mask).astype(np.int64)]))[:reach]]
                    for c, v in zip(columns, (rare.astype(np.int64), np.full(reach, node), np.full(reach, size), np.arange(reach), np.zeros(reach, np.int64)), strict=True):
                        c.append(v)
            if columns[0]:
                c = [np.concatenate(x) for x in columns]
                yield pa.record_batch([pa.array(c[0]), pa.array(c[1]), *(pa.array(x.astype(np.int32)) for x in c[2:])], names=["gram", "node", "n", "place", "common"])

    return docs.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(run, "gram long, node long, n int, place int, common int")


def _overlap(percent: int, a: str, b: str) -> str:
    """SQL: shingles that sets of these sizes must share."""
    return f"ceil({percent} * ({a} + {b}) / {100 + percent}.0D)"


def members_of(docs: DataFrame, nodes: DataFrame, facts: DataFrame, n: int, blocks: int) -> DataFrame:
    """(node, members) of the named nodes, from the text of the first document of each."""
    wanted = facts.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(None).cast("string").alias("text"))

    def answer(_, own):
        ask = set(ex.documents_of([p for _, p in own.get(1, [])])[0].tolist())
        ids, texts = ex.documents_of([p for _, p in own.get(0, [])]) if ask else ([], [])
        sets = [s for s in shingle_sets([t for i, t in zip(ids, texts, strict=True) if int(i) in ask], n) if len(s)]
        return pa.record_batch([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])

    return ex.by_key(ex.packed_documents(docs, blocks).unionByName(ex.packed_documents(wanted, blocks, 1)), answer, "node long, members binary")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes that link, by their whole sets."""
    ex.ready(pairs.sparkSession)

    def run(batches):
        ex.release()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("a")), "u")
    return one.join(sets.select(F.col("node").alias("v"), F.col("members").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _fits(percent: int) -> str:
    """SQL: sizes and places of two members of a list allow a link whose first common shingle is this one."""
    need = _overlap(percent, "n", "other_n")
    return f"100 * least(n, other_n) >= {percent} * greatest(n, other_n) and 1 + least(n - 1 - place, other_n - 1 - other_place) >= {need}"


def linked_nodes(docs: DataFrame, facts: DataFrame, sketch: np.ndarray, n: int, percent: int, boundary: int, ids_link: bool = True) -> DataFrame:
    """(id, component) of the nodes that link with others: the least node each can reach."""
    blocks = ex.n_blocks(docs)
    rows = signatures(docs, n, percent, boundary, sketch)
    order = Window.partitionBy("gram", "common").orderBy("place", "n", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lists = rows.withColumn("first", F.first(F.struct(F.col("node"), F.col("n"), F.col("place"))).over(order))
    lists = ex.written(lists.filter("first.node <> node").select("gram", "common", "node", "n", "place", F.col("first.node").alias("other"), F.col("first.n").alias("other_n"), F.col("first.place").alias("other_place")))
    pair = [F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")]
    # light sets: the subset in common says it all, and what links within a list links with its smallest set
    light = lists.filter("common > 0").filter(f"common >= {_overlap(percent, 'n', 'other_n')}").select(*pair).distinct()
    heavy = lists.filter("common = 0").drop("common")
    pairs = ex.written(heavy.filter(_fits(percent)).select(*pair).distinct())
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    links = compared(pairs, members_of(docs, nodes, facts, n, blocks), percent).unionByName(light)
    if ids_link:
        again = facts.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("last")).filter("u <> last").select("doc_id", "u")
        links = links.unionByName(facts.join(again, "doc_id").select("u", F.col("node").alias("v")).filter("u <> v"))
    label = ex.written(components(links))
    # members of one list that are still apart
    every = heavy.select("gram", "node", "n", "place").unionByName(heavy.select("gram", F.col("other").alias("node"), F.col("other_n").alias("n"), F.col("other_place").alias("place"))).distinct()
    apart = heavy.join(label.select(F.col("id").alias("node"), F.col("component").alias("c")), "node", "left").join(label.select(F.col("id").alias("other"), F.col("component").alias("d")), "other", "left").filter("coalesce(c, node) <> coalesce(d, other)").select("gram").distinct()
    mine = every.join(apart, "gram", "left_semi").join(label.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    theirs = mine.select("gram", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("place").alias("other_place"), F.col("component").alias("other_component"))
    rest = mine.join(theirs, "gram").filter("node < other and component <> other_component").filter(_fits(percent)).select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()
    rest = ex.written(rest.join(pairs, ["u", "v"], "left_anti"))
    if rest.take(1):
        nodes = rest.select(F.col("u").alias("node")).unionByName(rest.select(F.col("v").alias("node"))).distinct()
        more = compared(rest, members_of(docs, nodes, facts, n, blocks), percent)
        label = components(label.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))
    return label


def _labelled(docs: DataFrame, percent: int, shingle: int, sketch_bits: int, boundary: int | None, ids_link: bool) -> tuple[DataFrame, DataFrame]:
    """((doc_id, version, node, n) of each document, (node, centre) of each set that links)."""
    found = ex.written(facts_and_sketch(docs, shingle, sketch_bits))
    facts = found.filter("doc_id is not null").select("doc_id", "version", "node", "n")
    sketch = sketch_of(found.filter("slice is not null"), sketch_bits)
    label = linked_nodes(docs, facts, sketch, shingle, percent, boundary_of(facts, percent) if boundary is None else boundary, ids_link)
    return facts, label.select(F.col("id").alias("node"), F.col("component").alias("centre"))


def jaccard_join(docs: DataFrame, percent: int = 90, shingle: int = 3, sketch_bits: int = 22, boundary: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: documents link when 100 * intersection >= percent * union.

    ``boundary`` is found by cost unless given."""
    facts, label = _labelled(docs.select("doc_id", "text"), percent, shingle, sketch_bits, boundary, True)
    # nodes and components by the least document that has the set
    least = ex.written(facts.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")))
    linked = label.join(least, "node")
    first = linked.groupBy("centre").agg(F.min("least").alias("component"))
    own = least.join(linked.join(first, "centre").select("node", "component"), "node", "left").select("node", F.coalesce("component", "least").alias("component"))
    return facts.join(own, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, percent: int = 80, shingle: int = 5, sketch_bits: int = 22) -> DataFrame:
    """The rows of ``docs``, in all their columns, that stand for their group of near copies: the one with the least (doc_id, hash of its text).

    Groups are of texts, so rows that share a doc_id are only as alike as their texts are. Of exact repeats (same doc_id, same text with words) one
    row stays. Rows without doc_id, and texts without words, all stay."""
    facts, label = _labelled(docs.select("doc_id", "text"), percent, shingle, sketch_bits, None, False)
    facts = facts.filter("node is not null")
    row = F.struct("doc_id", "version")
    least = ex.written(facts.groupBy("node").agg(F.min(row).alias("least")))
    linked = label.join(least, "node")
    first = linked.groupBy("centre").agg(F.min("least").alias("first"))
    own = least.join(linked.join(first, "centre").select("node", "first"), "node", "left").select("node", F.coalesce("first", "least").alias("first"))
    rows = ex.written(facts.groupBy("doc_id", "version", "node").agg(F.count(F.lit(1)).alias("№rows")).join(own, "node").select(F.col("doc_id").alias("№id"), F.col("version").alias("№version"), (row != F.col("first")).alias("№gone"), "№rows"))
    key = [F.col("doc_id") == F.col("№id"), F.xxhash64("text") == F.col("№version")]
    stay = docs.join(rows.filter("`№gone`"), key, "left_anti")
    again = rows.filter("not `№gone` and `№rows` > 1").select("№id", "№version")
    once = stay.join(again, key, "left_semi").withColumn("№version", F.xxhash64("text")).dropDuplicates(["doc_id", "№version"]).select(docs.columns)
    return stay.join(again, key, "left_anti").unionByName(once) if again.take(1) else stay
