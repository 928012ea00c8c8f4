"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import math
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from harness import compare, duck
from pyspark.sql import functions as F
from riskframe.llm import bpe, components, compression, counts, decontaminate, embeddings, exchange, jaccard, langid, lm, quality, queries, substring, toxicity
from riskframe.llm import words as W
from tokenizers import Tokenizer

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, label int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(5)
VOCABULARY = ["ab", "cd", "éf", "Gh", "ij", "kl.", "mn", "op", "日", "x" * 40]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) + str(RNG.randrange(40)) for _ in range(n))


PASSAGE, BASE = prose(60), prose(300)
TEXTS = [
    None, "", " \n\t ", "one", "one two", "One TWO", "a b c", "A b c", "a " * 45, "a b " * 30, prose(9), prose(25), prose(25) + "\n" + PASSAGE, PASSAGE + " " + prose(80), prose(15) + "  " + PASSAGE + "\r\n" + prose(10),
    BASE, BASE, BASE + " tail", BASE.replace("ab", "zz", 2), prose(4000), "x" * 20_000, "é́ é <|endoftext|>foo<|endoftext|> bar <|startoftext|>", "\x1c a\x1cb \x85 c\xa0 d", "  lead and trail  ", "🙂🙂 " * 40, "12 34 !!", *[prose(RNG.randrange(8, 30)) for _ in range(6)],
]
SMALL_SETS = [" ".join(f"w{k}" for k in range(n + 2)) for n in (8, 9, 10, 11, 12, 19, 20, 21, 30)]


def rows(texts):
    return [(i, t, RNG.choice(["en", "de", None]), None, None if t is None else len(t), 0.5, 7, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(TEXTS), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_windows(texts, n=20):
    seen, out = set(), {}
    for i, t in texts:
        words, gone = WORD.findall(t or ""), set()
        for p in range(len(words) - n + 1):
            key = tuple(words[p:p + n])
            if key in seen:
                gone.update(range(p, p + n))
            seen.add(key)
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_words_and_hashes_do_not_depend_on_segments():
    texts = [b"a b" * 40_000, None, b"", b"\x0b", "é".encode() * 50_000 + b" end"]
    found = W.words_of(texts)
    want = [w for t in texts for w in (t or b"").split()]
    assert [found.data[s:e].tobytes() for s, e in zip(found.starts, found.ends, strict=True)] == want
    assert len(set(zip(want, found.hashes.tolist(), strict=True))) == len(set(want)) == len(set(found.hashes.tolist()))
    assert np.diff(found.first).tolist() == [len((t or b"").split()) for t in texts]


def thue_morse(n=10):
    """Words that any polynomial in an odd base modulo 2 ** 64 hashes alike."""
    out = "a"
    for _ in range(n):
        out += out.translate(str.maketrans("ab", "ba"))
    return out, out.translate(str.maketrans("ab", "ba"))


def test_hashes_of_structured_words(spark):
    a, b = thue_morse()
    assert len(set(W.words_of([f"{a} {b} {a[:64]} {b[:64]} {a[:16]} {b[:16]}".encode()]).hashes.tolist())) == 6
    rest = " ".join(f"w{k}" for k in range(19))
    df = spark.createDataFrame(rows([a, b, a + " " + rest, b + " " + rest]), DOCS)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(df).collect()} == {i: i for i in range(4)}
    assert sum(r.n_removed for r in substring.substring_dedup(df).collect()) == 0
    bench = spark.createDataFrame([(1, a + " " + rest)], "item_id long, text string")
    assert decontaminate.benchmark_leaks(spark.createDataFrame(rows([b]), DOCS), bench).count() == 0


def test_runs_of_words_are_hashed_by_themselves():
    base = W.mixed(np.arange(1, 60, dtype=np.uint64))
    for n in range(1, 25):
        whole = W.runs_hashed(base, n)
        assert len(set(whole.tolist())) == len(whole) == 60 - n and W.runs_hashed(base[7:7 + n], n)[0] == whole[7]


def test_substring(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(docs).collect()}
    assert got == brute_windows(list(enumerate(TEXTS)))
    assert got[16][1] == 300 and got[13][1] == 60


def test_substring_text_empty_repeats_and_no_ids(spark, empty):
    assert substring.substring_dedup(empty).count() == 0
    df = spark.createDataFrame([*rows([PASSAGE]), *rows([PASSAGE]), (None, PASSAGE, *[None] * 6)], DOCS)
    assert sorted(r.n_removed for r in substring.substring_dedup(df, with_text=True).collect()) == [0, 60]


def brute_groups(texts, percent=90):
    sets = {}
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p:p + 3]) for p in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sorted(sets), 2):
            common = len(sets[a] & sets[b])
            if group[a] != group[b] and sets[a] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((group[a], group[b]))
                group, changed = {i: low if g == high else g for i, g in group.items()}, True
    return {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize("boundary", [None, 0, 25])
def test_jaccard(spark, boundary):
    texts = TEXTS + SMALL_SETS + [BASE.replace("ij", f"q{k}", k % 9) for k in range(12)]
    df = spark.createDataFrame(rows(texts), DOCS).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df, boundary=boundary, sketch_bits=12).collect()}
    assert got == brute_groups(list(enumerate(texts)))


def test_jaccard_empty_and_repeats(spark, empty):
    assert jaccard.jaccard_join(empty).count() == 0
    df = spark.createDataFrame([*rows([BASE, "a b c"]), *rows([BASE, "a b c"]), (None, BASE, *[None] * 6)], DOCS)
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_join(df).collect()} == {(0, 0), (1, 1)}


def test_jaccard_of_documents_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (9, b), (12, c)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_join(df).collect()} == {(3, 3), (5, 3), (9, 3), (12, 12)}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    RNG.shuffle(links)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 130)}}


def test_components_of_an_id_between_two_centres(spark):
    one, two = (spark.createDataFrame([(3, v)], "u long, v long") for v in (1, 2))  # a partition each
    assert {(r.id, r.component) for r in components.components(one.union(two)).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_elias_fano():
    rng = np.random.default_rng(1)
    with tempfile.TemporaryDirectory() as folder:
        for n, top in ((0, 5), (1, 10), (1000, 2**63), (5000, 6000), (3000, 2**40)):
            v = np.sort(rng.integers(0, top, n).astype(np.uint64))
            e = lm.EliasFano(folder, "x", v)
            assert (e.value(np.arange(n)) == v).all()
            if n:
                q = np.concatenate([v, v + np.uint64(1), rng.integers(0, top, 500).astype(np.uint64)])
                assert (e.successor(q) == np.searchsorted(v, q)).all()


def test_language_model(spark, docs, empty):
    assert lm.score(empty).count() == 0
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(TEXTS))}
    words = {i: WORD.findall(t or "") for i, t in enumerate(TEXTS)}
    train = [w for i, w in words.items() if not held[i]]
    one, two = Counter(x for w in train for x in [*w, "\n"]), Counter(p for w in train for p in zip(["\0", *w], [*w, "\n"], strict=True))
    total, types = sum(one.values()), len(one)
    base = lambda x: (one[x] + 0.5) / (total + 0.5 * (types + 1))
    for r in lm.score(docs).collect():
        tokens = [*words[r.doc_id], "\n"]
        before = ["\0", *tokens[:-1]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(one[x] > 0 for x in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10(base(x)) for x in tokens), rel=1e-9)
        want = sum(math.log10((two[v, x] + 32 * base(x)) / ((one["\n"] if v == "\0" else one[v]) + 32)) for v, x in zip(before, tokens, strict=True))
        assert r.score == pytest.approx(want, rel=1e-3)


def test_language_model_query_lowers_and_scores_every_row(spark, tmp_path):
    # Base scores as the contract has them: A-Z lowered (no other letters), rows without an id or text, a table with held-out rows alone.
    given = [(i, t) for i, t in enumerate(["One TWO one", "one Two É é", None, "ONE K \x00 b", "x" * 70 + " " + "X" * 70, "two\x0btwo", *["Two b"] * 6])] + [(None, "One b"), (None, "One b"), (None, None), (3, "new")]
    held = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5 == 1
    for k, own in enumerate((given, [x for x in given if held(x[0])])):
        spark.createDataFrame(own, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        tokens = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for _, t in own]
        c = Counter(x for (i, _), w in zip(own, tokens, strict=True) if held(i) is False for x in w)
        n, v = sum(c.values()), len(c)
        want = Counter((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 9)) for (i, _), w in zip(own, tokens, strict=True))
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in queries.op2_lm_scores(spark, f"{tmp_path}/{k}").collect()) == want


@pytest.mark.parametrize(("operator", "label", "least"), [(toxicity.toxicity, "toxic", 0.97), (quality.quality, "quality", 0.95)])
def test_classifiers(spark, docs, empty, operator, label, least):
    full = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{full}/labels.parquet")
    got = operator(spark.read.parquet(f"{full}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    assert got >= least
    none = labels.limit(0)
    assert operator(empty, labels).count() == 0
    assert {r.score for r in operator(docs, none).collect()} == {0.5}
    for r in operator(docs, labels).collect():
        assert 0 <= r.score <= 1


def test_quality_dictionary_reads_whole_texts():
    rng = random.Random(11)
    noise = lambda n: "".join(f"{rng.getrandbits(48):x} " for _ in range(n))
    phrase = "this passage stands late in every long text of the sample"
    texts = [(noise(2400) + " ".join(f"{phrase} {noise(4)}" for _ in range(6))).encode() for _ in range(12)]
    assert all(t.find(phrase.encode()) > 64 * quality.WINDOW for t in texts)
    assert phrase.encode()[5:40] in quality.dictionary_of(texts)


def test_prefix_codes_and_windows():
    codes, first = compression.prefix_codes([b"Loser los loserly", None, b"12 loser"])
    assert first.tolist() == [0, 6, 6, 8]
    assert codes[:2].tolist() == codes[2:4].tolist() == codes[6:].tolist()
    text = prose(500).encode()
    assert b"".join(compression.windows_of(text, 100)) == text


def test_languages(spark, docs, empty):
    df = spark.read.parquet(f"{MORE}/documents.parquet")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert got >= 0.97
    assert langid.identify(empty).count() == 0
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    for i in (0, 1, 2, 24, 25):
        assert found[i] == ("und", 0)
    assert all(0 <= s <= 1 and p in ("en", "de", "und") for p, s in found.values())


def plain_bundle(text, dims):
    """Sum of the products of rolled letter vectors over a text's n-grams; None without a letter."""
    own = re.sub("\0+", "\0", "".join(chr(langid.symbols()[ord(c)]) for c in text))
    letters = np.array([[1 - 2 * int(W.mixed(np.uint64([s * dims + d + 1]))[0] >> np.uint64(63) == 0) for d in range(dims)] for s in range(langid.SYMBOLS)])
    own = [0, *map(ord, own), 0]
    grams = zip(own, own[1:], own[2:], strict=False)
    return sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in grams) if any(own) else None


@pytest.mark.parametrize("rows_held", [3, 256])
def test_language_bundles_are_sums_of_bound_letters(monkeypatch, rows_held):
    monkeypatch.setattr(langid, "ROWS", rows_held)
    monkeypatch.setattr(langid, "CHARS", 500)
    texts, vectors = [t[:700] for t in TEXTS if t is not None] + ["", "", " a  b ", "a", "é日本 ", "\t"], langid.gram_vectors(16)
    parts = [texts[p] for p in langid.portions(texts)]
    assert sum(parts, []) == texts and all(len(p) == 1 or len(p) <= 64 and sum(map(len, p)) <= 500 for p in parts)
    for part in [*parts, ["", " "], texts]:
        for text, bundle, lettered in zip(part, *langid.bundles_of(part, vectors), strict=True):
            want = plain_bundle(text, 16)
            assert lettered == (want is not None) and (want is None or np.array_equal(bundle, want))


def test_language_reads_a_gram_vector_once_for_many_texts(spark, docs, monkeypatch):
    read, tasks = [], []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return np.asarray(self)[at]

    mapped, made = type(docs).mapInArrow, langid.gram_vectors
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *more: tasks.append(f) or mapped(self, f, *more))
    df = spark.createDataFrame([(i, " ".join(RNG.sample(("the and of to", "der und die das")[i % 2].split(), 4)), "ed"[i % 2]) for i in range(200)], "doc_id long, text string, lang string")
    want = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, 64).collect()}
    monkeypatch.setattr(langid, "gram_vectors", lambda dims: made(dims).view(Counted))
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    exchange.release()
    try:
        out = list(tasks[-1](iter([pa.record_batch([pa.array(range(200)), pa.array([False] * 200), pa.array(texts)], names=["doc_id", "held_out", "text"])])))
    finally:
        exchange.release()
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out[0].to_pylist()} == want
    distinct = {g for t in texts for g in zip(f" {t} ", f" {t} "[1:], f" {t} "[2:], strict=False)}
    assert 0 < sum(read) <= 8 * len(distinct)


@pytest.fixture(scope="module")
def many(docs, spark):
    chars = "ab \n\t'.é1<|>　"
    extra = ["".join(RNG.choice(chars) for _ in range(RNG.randrange(3000))) for _ in range(40)]
    return TEXTS + extra + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_bpe_round_trip(spark, many, empty):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(path)
    assert bpe.encode_decode(empty, path).count() == 0
    for r in bpe.encode_decode(spark.createDataFrame(rows(many), DOCS).repartition(3), path, with_ids=True).collect():
        ids = plain.encode(many[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_chunks_are_defined_by_content_and_encoded_once():
    one = bpe.Encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    shared = prose(3000)
    one.batch([("first " + shared).encode(), ("another beginning " + shared).encode()])
    assert one.hits >= 0.9 * len(bpe.cuts(shared.encode()))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, many, empty, name):
    path = str(public_tokenizers.path(name))
    own = counts.Counter(path)
    assert counts.token_counts(empty, path).count() == 0
    for r in counts.token_counts(spark.createDataFrame(rows(many), DOCS), path, chunk=300).collect():
        want = own.whole(many[r.doc_id] or "")
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((many[r.doc_id] or "").encode()), want > 512)


def test_overlaps_widen_until_exact():
    own = counts.Counter(str(public_tokenizers.path("byte_bpe_50k.json")))
    for text in ("x" * 5000 + " " + "y" * 5000, "a " * 3000, prose(2000), "word\n\n  next" * 400):
        assert own.spliced(text, 256, 16) == own.whole(text)
    assert own.widened


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(1, 16)) + 0.12 * rng.normal(size=(150, 16))
    data = np.concatenate([near, rng.normal(size=(100, 16)), np.repeat(rng.normal(size=(1, 16)), 30, axis=0)])
    vectors = [(i, v.tolist(), i % 3 % 2) for i, v in enumerate(data)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, data[0].tolist(), None), (1005, data[0].tolist()[:8], 0), (1006, [], 0), (None, data[0].tolist(), 0)]
    schema = "vec_id long, embedding array<double>, label int"
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    label = np.array([i % 3 % 2 for i in range(len(data))])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(data), dtype=bool)
    group = np.arange(len(data))
    for _ in range(len(data)):
        least = np.array([min([group[i], *group[linked[i]]]) for i in range(len(data))])
        if (least == group).all():
            break
        group = least
    want = {i: (int(linked[i].sum()), int(group[i]), bool(group[i] == i)) for i in range(len(data))} | {i: (0, i, True) for i, *_ in odd if i is not None}
    df = spark.createDataFrame(vectors + vectors[:5] + odd, schema)
    for options in ({}, {"tile": 20, "per_cell": 10}, {"tile": 16, "per_cell": 1000}):
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, **options).collect()} == want
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_masks_hit_every_pattern():
    for gone in itertools.chain.from_iterable(itertools.combinations(range(13), k) for k in (0, 1, 2)):
        assert any(all(at + i not in gone for i, c in enumerate(mask) if c == "1") for mask in decontaminate.MASKS for at in range(13 - len(mask) + 1))


def test_whole_masks_hit_every_pattern():
    for n, percent in itertools.product(range(1, 13), (80, 60, 100)):
        free = n - -(-percent * n // 100)
        for gone in itertools.combinations(range(n), free):
            assert any(all(mask[i] == "0" for i in gone) for mask in decontaminate.whole_masks(n, percent)), (n, gone)
        assert all("1" in mask and len(mask) == n for mask in decontaminate.whole_masks(n, percent))


@pytest.mark.parametrize("size", [32 << 20, 0])
def test_short_items_with_substitutions(spark, size):
    items, texts, want = [(n, " ".join(f"s{n}x{k}" for k in range(n))) for n in range(1, 13)], [], set()
    for n, t in items:
        for count in range(n // 5 + 2):  # one more than 80 % allows is no leak
            for gone in itertools.combinations(range(n), count):
                if 5 * count <= n:
                    want.add((len(texts), n))
                texts.append("before " + " ".join("no" if k in gone else w for k, w in enumerate(t.split())) + " after")
    df, bench = spark.createDataFrame(rows(texts), DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    leaks = lambda **more: {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(df, bench, broadcast_bytes=size, **more).collect()}
    assert leaks(least_words=1) == want
    assert leaks() == {(d, n) for d, n in want if n >= 5}


def test_decontamination(spark, empty):
    items = [(i, " ".join(f"t{i}x{k}" for k in range(n))) for i, n in enumerate((40, 13, 9, 4, 300))] + [(9, None), (None, "a b"), (10, "")]
    w = [t.split() if t else [] for _, t in items]
    swapped = ["no" if k % 6 == 3 else x.upper() + "," for k, x in enumerate(w[0])]
    texts = [None, "", prose(50), prose(20) + " " + " ".join(w[0]) + " " + prose(20), " ".join(swapped), " ".join(w[0][:12]), "Z " + " ".join(w[0][5:18]), " ".join(w[1]), " ".join(w[2]), " ".join(w[3]), " ".join("no" if k % 3 == 0 else x for k, x in enumerate(w[0])), " ".join(w[4]) + " " + " ".join(w[4][100:150])]
    df, bench = spark.createDataFrame(rows(texts), DOCS), spark.createDataFrame(items, "item_id long, text string")
    for size in (32 << 20, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_leaks(df, bench, broadcast_bytes=size).collect()} == {(3, 0), (4, 0), (6, 0), (7, 1), (8, 2), (11, 4)}
        assert decontaminate.benchmark_leaks(empty, bench, broadcast_bytes=size).count() == 0
        assert decontaminate.benchmark_leaks(df, bench.limit(0), broadcast_bytes=size).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    ok, message = compare(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_return_every_document(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_pipeline_by_stage(spark, tmp_path):
    """Every stage against a plain version of it on what the stage before kept."""
    read = lambda df: {r.doc_id: r.asDict() for r in df.collect()}
    docs = queries.table(spark, MORE, "documents").withColumn("component_id", F.lit(1)).withColumn("text", F.when(F.col("doc_id") == 77, None).otherwise(F.col("text")))
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], MORE).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    assert all(k.columns == docs.columns for k in kept[:-1])
    zero, one, two, three, four, five = map(read, kept)
    toxic = {r.doc_id for r in queries.table(spark, MORE, "labels").filter("toxic = 1").collect()}
    # 51 toxic labels teach little; test_classifiers holds a larger table to more
    assert len(toxic & set(one)) <= 0.35 * len(toxic) and len(set(zero) - set(one) - toxic) <= 0.12 * len(zero)
    groups = brute_fast({i: r["text"] for i, r in one.items()})
    assert set(two) == {i for i, g in groups.items() if i == g}
    want = brute_windows(sorted((i, r["text"]) for i, r in two.items()))
    for i, r in three.items():
        if want[i][1]:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[i][2] and r["n_chars"] == len(r["text"])
        else:
            assert r == two[i]
    assert set(three) == set(two)
    leaks = {r.doc_id for r in decontaminate.benchmark_leaks(kept[3], queries.table(spark, MORE, "benchmark"), broadcast_bytes=0).collect()}
    assert set(four) == set(three) - leaks and all(four[i] == three[i] for i in four)
    plain = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    assert {i: r["ids"] for i, r in five.items()} == {i: plain.encode(r["text"] or "", add_special_tokens=False).ids for i, r in four.items()}


def test_pipeline_tells_rows_of_one_id_apart(spark):
    """Rows go for their text, not for their doc_id."""
    p, clean, other = prose(120), prose(120), prose(120)
    near = " ".join("changed" if k in (40, 80) else w for k, w in enumerate(p.split()))
    data = [(1, p), (5, near), (5, clean), (6, None), (6, other), (6, other), (7, ""), (None, p)]
    df = spark.createDataFrame([(i, t, *[None] * 6) for i, t in data], DOCS)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, df, SMALL).collect())
    assert got == Counter([(1, p), (5, clean), (6, None), (6, other), (7, ""), (None, p)])
    data = [(1, PASSAGE), (5, "x " + PASSAGE + " y"), (5, clean), (5, None), (8, other), (8, other)]
    df = spark.createDataFrame([(i, t, *[None] * 6) for i, t in data], DOCS)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.remove_passages(spark, df, SMALL).collect())
    assert got == Counter([(1, PASSAGE), (5, "x y"), (5, clean), (5, None), (8, other), (8, other)])


def brute_fast(texts, n=5, percent=80):
    """brute_groups by inverted lists, by the rule of the pipeline's stage."""
    lists, sets, group = defaultdict(list), {}, {}
    for i in sorted(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or ""))
        sets[i] = {tuple(w[p:p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        group[i] = i
        for j, common in Counter(j for g in sets[i] for j in lists[g]).items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
        for g in sets[i]:
            lists[g].append(i)
    return group


def test_pipeline_stages_take_empty_and_odd_tables(spark, empty):
    odd = spark.createDataFrame([*rows(TEXTS), *rows(TEXTS[:4]), (None, "no id", *[None] * 6)], DOCS)
    for df in (empty, odd):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SMALL)
            assert out.count() == 0 if df is empty else out.count() > 0
