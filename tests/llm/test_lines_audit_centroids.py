"""Line de-duplication, filter audit and centroid clustering against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from riskframe.llm import audit, centroids, lines

DOCS = "doc_id long, text string, lang string, source string, hash binary, version string, keep int, part string, n long, digest string"
LABELS = "doc_id long, quality int, toxic int, part string, n int, good string"
VECTORS = "vec_id long, embedding array<double>, label int, x string, d string, cluster string"
RNG = random.Random(11)
SPACES = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", b"h", "v", 1, "p", 3, "d") for i, t, lang in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_lines(rows, least=10):
    first, out = {}, Counter()
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lowered(line.strip(SPACES))
            if i is not None and len(key) >= least:
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        kept, all_lines = [], (t or "").split("\n")
        for line in all_lines:
            key = lowered(line.strip(SPACES))
            if i is None or len(key) < least or first[key] == i:
                kept.append(line)
        out[i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


COMMON = "A line that very many documents hold"
LINES = [COMMON, COMMON.upper() + " \r", "\t" + COMMON, "short", "ünïcödé", "ÜNÏCÖDÉ lines ", "ünïcödé lines", "éééééééééé", "🙂" * 9, "🙂" * 10, "", " ", "\x1cnine chars", "nine chars"]


def texts(n):
    out = [(k, "\n".join(RNG.choice(LINES) if RNG.random() < 0.5 else f"a line of document {RNG.randrange(40)}" for _ in range(RNG.randrange(1, 30))), None) for k in range(n)]
    special = [(7, None, "en"), (8, "", "en"), (9, "\n", "en"), (10, "\n\n" + COMMON + "\n", "en"), (3, COMMON + "\nanother text of three", "en"), (3, out[3][1], "en"), (None, COMMON, "en"), (None, None, None), (-5, COMMON + "\n" + COMMON, "en"), (1 << 60, "\n".join(["long " + COMMON, COMMON] * 30_000), "en")]
    return out + special


@pytest.mark.parametrize("partitions", ["1", "8", "61"])
def test_lines(spark, partitions):
    rows = texts(300)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # the common line spreads over many ranges
    try:
        df = frame(spark, rows).repartition(4)
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_dedup(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_lines([(i, t) for i, t, _ in rows])


def test_common_line_fills_several_ranges(spark):
    rows = [(i, COMMON + f"\nown line of {i}", None) for i in range(4000)]
    entries = lines.line_hashes(frame(spark, rows), 10)
    parts = entries.repartitionByRange(16, *lines.ORDER).withColumn("range", F.spark_partition_id())
    hot = hashlib.sha256(lines.key_of(COMMON.encode())).digest()[:16]
    assert parts.filter(F.col("hash") == F.lit(hot)).select("range").distinct().count() >= 4
    got = {r.doc_id: r.n_dropped for r in lines.line_dedup(frame(spark, rows)).collect()}
    assert got == {i: int(i > 0) for i in range(4000)}


def test_line_bitmaps_and_texts(spark):
    df = frame(spark, [(1, COMMON + "\nx\n" + COMMON, None), (2, "y\n" + COMMON + "\nz", None), (3, None, None)])
    keep = {r.doc_id: r for r in lines.keep_bitmaps(df).collect()}
    assert set(keep) == {2} and lines.lost_of(keep[2].keep).tolist() == [1] and keep[2].n_dropped == 1
    out = {r.doc_id: r.text for r in lines.line_dedup(df, with_text=True).collect()}
    assert out == {1: COMMON + "\nx\n" + COMMON, 2: "y\nz", 3: None}
    assert lines.line_dedup(df.limit(0)).count() == 0
    for lost in ([0], [5], [7, 8], list(range(3000)), [0, 99_999]):
        assert lines.lost_of(lines._bitmap(np.array(lost))).tolist() == lost


def fails(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), smaller]


def brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in rows:
        parts[lang or ""].append((fails(t or "", i is not None and first[t or ""] < i), i in good, i in toxic))
    out, value = {}, Counter()
    for part, docs in parts.items():
        for order in itertools.permutations(range(5)):
            for step, f in enumerate(order, 1):
                here = [d for d in docs if d[0][f] and not any(d[0][j] for j in order[:step - 1])]
                value[part, f] += len(here)
                out[part, "".join("ABCDE"[j] for j in order), step] = [
                    sum(not any(d[0][j] for j in order[:step]) for d in docs), len(here), sum(d[0][f] and any(d[0][j] for j in order[:step - 1]) for d in docs),
                    sum(d[0][f] and sum(d[0]) == 1 for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
    return {(p, o, s): (*v, value[p, "ABCDE".index(o[s - 1])]) for (p, o, s), v in out.items()}


def test_audit(spark):
    vocabulary = ["ab", "Cd", "éf", "GHIJ", "a$b", "日本", "x\x1cy", *[f"w{k}" for k in range(120)]]
    rows = [(k, RNG.choice([" ", "\n", "\x0b"]).join(RNG.choice(vocabulary[:RNG.choice([3, 40, 127])]) for _ in range(RNG.choice([5, 99, 100, 130]))), RNG.choice(["en", "de", "de", None, ""])) for k in range(150)]
    rows += [(200 + k, rows[k % 7][1], "en") for k in range(60)] + [(5, rows[5][1], "de"), (5, rows[6][1], "fr"), (300, None, "en"), (301, "", "en"), (302, None, None), (None, rows[0][1], "en"), (None, None, "en"), (303, "Z " * 60_000, "fr")]
    labels = [(k, RNG.choice([0, 1, None]), RNG.choice([0, 1, None])) for k in range(0, 310, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = audit.filter_audit(frame(spark, rows), spark.createDataFrame([(*r, "p", 1, "g") for r in labels], LABELS)).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 600 * len({x or "" for _, _, x in rows})
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want


def test_audit_empty(spark):
    docs, labels = frame(spark, [(1, "a", "en"), (2, "A", None)]), spark.createDataFrame([], LABELS)
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    assert audit.filter_audit(docs, labels).count() == 1200


def test_shapley_equals_the_mean_over_orders():
    for _ in range(20):
        docs = [RNG.randrange(32) for _ in range(RNG.randrange(40))]
        game = [sum(m & s != 0 for m in docs) for s in range(32)]
        total = [0] * 5
        for order in itertools.permutations(range(5)):
            before = 0
            for f in order:
                total[f] += game[before | 1 << f] - game[before]
                before |= 1 << f
        assert [v * 120 for v in audit.shapley(game)] == total


def brute_cluster(rows, clusters, rounds):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(next(e for j, e in rows if j == i)).tobytes(), v) for i, v in kept if i is not None)
    centre = [v for *_, v in start[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centre))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            centre[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, k, d in last:
        inertia[k] += d
    fits = lambda v: v if v < 2 ** 63 else None
    return Counter((i, k, fits(d), fits(inertia[k]) if all(x[2] < 2 ** 63 for x in last if x[1] == k) else None, fits(sum(inertia.values())) if all(x[2] < 2 ** 63 for x in last) else None, hashlib.sha256(",".join(map(str, centre[k])).encode()).hexdigest()) for i, k, d in last)


def vectors(n, spread):
    centre = [[RNG.gauss(0, 1) for _ in range(64)] for _ in range(7)]
    out = [(k, [x + RNG.gauss(0, spread) for x in RNG.choice(centre)]) for k in range(n)]
    return out + [(n, out[0][1]), (n + 1, [0.0] * 64), (n + 2, None), (n + 3, []), (n + 4, [1.0] * 63), (n + 5, [None] + [1.0] * 63), (n + 6, [math.nan] * 64), (n + 7, [math.inf] * 64), (None, out[1][1]), (2, out[2][1]), (n + 8, [-1 / 64 - 1e-9] * 64)]


@pytest.mark.parametrize(("rows", "clusters"), [(vectors(200, 0.3), 16), (vectors(60, 0.01), 5), (vectors(3, 1), 16), ([(k, [float(k // 2 % 3)] * 64) for k in range(40)], 16), (vectors(30, 0.2) + [(99, [1e30] + [0.5] * 63), (98, [-4e17] * 64), (97, [1e300] * 64)], 16)])
def test_centroids(spark, rows, clusters):
    df = spark.createDataFrame([(i, e, 1, "x", "d", "c") for i, e in rows], VECTORS).repartition(3)
    got = centroids.cluster(df, clusters).collect()
    assert Counter(tuple(r) for r in got) == brute_cluster(rows, clusters, 3)
    assert centroids.cluster(df.limit(0)).count() == 0
    assert centroids.cluster(df.filter("embedding is null")).count() == 0


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 40, (16, 64))
    x = np.floor(centre[rng.integers(0, 16, 3000)] + rng.normal(0, 6, (3000, 64))).astype(np.int64)
    c = np.floor(centre).astype(np.int64)
    simplex = centroids.simplex_of(c, 6)
    d = simplex.distances(x)
    a, b = simplex.project(d), simplex.project(simplex.distances(c))
    true = np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2))
    low = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    mirrored = b * np.array([1] * (b.shape[1] - 1) + [-1])
    high = np.sqrt(((a[:, None] - mirrored[None]) ** 2).sum(axis=2))
    assert (low <= true + 1e-6 * true.max()).all() and (true <= high + 1e-6 * true.max()).all()
    own, distance, compared = centroids.nearest(x, d, simplex, c)
    assert (own == true.argmin(axis=1)).all() and (distance == ((x - c[own]) ** 2).sum(axis=1)).all()
    assert compared < 0.5 * 16 * len(x)


def test_equal_candidates_make_a_simplex_of_one_pivot():
    same = np.ones((4, 64), np.int64)
    simplex = centroids.simplex_of(same, 6)
    assert len(simplex.pivots) == 1
    assert centroids.nearest(same, simplex.distances(same), simplex, same)[0].tolist() == [0] * 4
