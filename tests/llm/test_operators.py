"""The training-data operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolloutframe.llm import (
    chat,
    common,
    components,
    decontaminate,
    knn_tree,
    line_dedup,
    packing,
    quality,
    repair,
    sharding,
    simhash,
    substring_dedup,
)
from rolloutframe.llm.common import vocabulary
from rolloutframe.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, id int, row string, part string, k int, fp string, node int, line string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    """Nulls, blanks, very long texts, near and exact copies, shared lines and passages."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÜBER", "naïve", "x-y", "don't", "42"]
    out = [None, None, "", "", " ", "\n\n", "\t \x0b\x0c\r", "one", "two words", "A b c", "nul\x00l \x01 z"]
    passage = [" ".join(r.choices(words, k=30)) for _ in range(4)]
    lines = ["A shared LINE of twenty plus characters", "  a shared line of twenty plus characters\t", "short line", "ÉTÉ été " * 4]
    for i in range(60):
        own = " ".join(r.choices(words, k=r.randint(1, 80)))
        if i % 3 == 0:
            own += (" " if i % 2 else "\n") + r.choice(passage) + " " + own[:40]
        if i % 4 == 0:
            own += "\n" + r.choice(lines) + "\n" + r.choice(lines)
        out.append(own)
    out += [out[20], out[20], out[30], out[31].upper(), out[32] + " w1", " ".join(r.choices(words, k=30_000)), "a" * 50_000, "ab " * 20_000]
    return out


TEXTS = texts()


def table(spark, values, ids=None):
    ids = range(len(values)) if ids is None else ids
    rows = [(i, t, f"s{n % 3}" if n % 7 else None, "en" if n % 5 else None, None, 7, "r", "p", 1, "f", 2, "l") for n, (i, t) in enumerate(zip(ids, values, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v int, q int, leaf int")


def nearest_brute(rows, k=20):
    width = max({len(v) for _, v, *_ in rows if v}, key=lambda d: sum(len(v or ()) == d for _, v, *_ in rows), default=0)
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if v and len(v) == width and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for i, q in ok:
        if i % 20 == 0:
            near = sorted((-float(q @ x), j) for j, x in ok if j != i)[:k]
            out |= {(i, n, j, round(-s, 9)) for n, (s, j) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("n", [0, 5, 90])
def test_nearest_is_exact_within_one_leaf(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, r.integers(-3, 4, 4).astype(float).tolist(), 1, 2, 3, 4) for i in range(n)]
    rows += [(n + j, v, 1, 2, 3, 4) for j, v in enumerate([None, [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan")] * 4, [1.0], []])] if n else []
    rows += [(1000 + 20 * j, [1.0, 2.0, 1.0, 0.0], 1, 2, 3, 4) for j in range(40)] if n > 50 else []
    found = {(a, b, c, round(s, 9)) for a, b, c, s in map(tuple, knn_tree.digest(vectors(spark, rows)).collect())}
    assert found == nearest_brute(rows)


@pytest.mark.parametrize(("times", "others"), [(31, 80), (3, 0), (50, 4)])
def test_repeated_rows_are_rows_of_their_own(spark, times, others):
    """A query id repeated in full, and one that stands with two vectors: each row leaves out itself alone."""
    r = np.random.default_rng(times)
    rows = [(i + 1, r.integers(-9, 9, 5).astype(float).tolist(), 1, 2, 3, 4) for i in range(others)]
    rows += [(20, [9.0, 9.0, 1.0, 0.0, 1.0], 1, 2, 3, 4)] * times
    rows += [(40, [1.0, 0.0, 2.0, 3.0, 1.0], 1, 2, 3, 4), (40, [0.0, 5.0, -2.0, 3.0, 1.0], 1, 2, 3, 4)]
    found = sorted((a, b, c, round(s, 9)) for a, b, c, s in map(tuple, knn_tree.digest(vectors(spark, rows)).collect()))
    held = [(i, np.array(v)) for i, v, *_ in rows if any(v)]
    expected = []
    for at, (i, q) in enumerate(held):
        if i % 20 == 0:
            near = sorted((-float(q @ x), j) for n, (j, x) in enumerate(held) if n != at)[:20]
            expected += [(i, n, j, round(-s, 9) + 0.0) for n, (s, j) in enumerate(near, 1)]
    assert found == sorted(expected)


def test_vectors_with_many_equal_products(spark):
    """One-hot vectors: most products are 0, and no more rows than can count leave a block."""
    rows = [(i, [float(i % 50 == j) for j in range(50)], 1, 2, 3, 4) for i in range(400)]
    found = {(a, b, c, round(s, 9)) for a, b, c, s in map(tuple, knn_tree.digest(vectors(spark, rows)).collect())}
    for q in range(0, 400, 20):
        near = sorted((-float(q % 50 == i % 50), i) for i in range(400) if i != q)[:20]
        assert {(q, n, i, -s + 0.0) for n, (s, i) in enumerate(near, 1)} == {x for x in found if x[0] == q}


def test_recall(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 0, 0, 0, 0) for i, v in enumerate(x)]
    found = {(a, c) for a, _, c, _ in map(tuple, knn_tree.digest(vectors(spark, rows)).collect())}
    scores = x[::20].astype(float) @ x.T.astype(float)
    scores[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    true = {(20 * q, int(v)) for q, row in enumerate(np.argsort(-scores, axis=1)[:, :20]) for v in row}
    assert len(found) == 3000 and len(found & true) / len(true) >= 0.9


def test_copies_are_found_in_a_leaf_not_visited(spark):
    """Unit vectors filed under a wide cluster, whose tight neighbour has the larger product."""
    r = np.random.default_rng(0)
    side = r.normal(size=(60, 15))
    side *= np.sin(1.1) / np.linalg.norm(side, axis=1)[:, None]
    wide = np.column_stack([np.full(60, np.cos(1.1)), side])
    tight = np.column_stack([np.ones(60), r.normal(scale=0.01, size=(60, 15))])
    x = np.concatenate([wide, tight / np.linalg.norm(tight, axis=1)[:, None], np.repeat(wide[:1], 60, 0)]).astype(np.float32)
    rows = [(i + 1000, v.tolist(), 0, 0, 0, 0) for i, v in enumerate(x)]
    hot = [1000, *range(1120, 1180)]
    found = knn_tree.nearest(vectors(spark, rows), F.col("vec_id") >= 1060, target=0.001).where(F.col("query_id") >= 1120)
    copies = {(a, b) for a, b in found.select("query_id", "vec_id").collect()}
    assert copies == {(q, v) for q in hot[1:] for v in [h for h in hot if h != q][:20]}


def test_calibration_counts_copies_and_larger_vectors(spark):
    x = np.array([[1.0, 0.0], [3.0, 0.0], [0.5, 0.0], [-1.0, 0.0]], np.float32)
    rows = [(n, v.tobytes(), ids) for n, (v, ids) in enumerate(zip(x, ([1, 2, 3], [4], [5, 6], [7]), strict=True))]
    items = spark.createDataFrame(rows, "leaf long, v binary, ids array<long>")
    truth = {(r["leaf"], r["copy"], r["n"]) for r in knn_tree._truth(items, [x[0].tobytes()], 4, "<f4")}
    assert truth == {(1, False, 1), (0, True, 2), (2, False, 1)}
    tree = knn_tree.Tree([np.array([[2.0, 0.0], [1.0, 0.0], [0.0, 0.0]])], [[-1, -2, -3]], 3)
    found = [{"q": 0, "leaf": 0, "copy": False, "n": 1}, {"q": 1, "leaf": 2, "copy": False, "n": 1}]
    visits = [knn_tree._visits(tree, found, x[:2], np.array(n), np.array([1, 1]), 0.6) for n in ([1, 1], [1, 9], [9, 1])]
    assert visits == [(3, 1.0)] * 3 and knn_tree._visits(tree, found[:1], x[:1], np.array([1]), np.array([0]), 0.6) == (1, 1.0)


def test_large_leaves_are_split_level_by_level(spark):
    """A sample far too small for the table: leaves still end bounded, every vector filed once, recall as asked."""
    r = np.random.default_rng(5)
    centre = r.normal(size=(60, 12)) * 3
    x = (centre[r.integers(0, 60, 6000)] + r.normal(size=(6000, 12)) * r.uniform(0.2, 1.5, (6000, 1))).astype(np.float32)
    rows = [(i, v.tolist(), 0, 0, 0, 0) for i, v in enumerate(x)] + [(6000 + 20 * i, [1.0] * 12, 0, 0, 0, 0) for i in range(50)]
    report = {}
    found = knn_tree.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, sample_rows=150, leaf_rows=60, report=report)
    got = {(a, c) for a, _, c, _ in map(tuple, found.collect())}
    true = {(a, c) for a, _, c, _ in nearest_brute(rows)}
    assert report["largest"] <= 120 and report["leaves"] >= 50 and report["visits"] < report["leaves"] and 0.9 <= report["recall"] <= 1
    assert len(got) == len(true) and len({g for g in got if g[0] < 6000} & true) / len({t for t in true if t[0] < 6000}) >= 0.9


def test_graft():
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 5))
    tree = knn_tree.fit(x, leaf_rows=200)
    parts = tree.file(x)
    below = {leaf: knn_tree.fit(x[parts == leaf], leaf_rows=20) for leaf in range(tree.leaves)}
    below = {leaf: t for leaf, t in below.items() if t.centres}
    n = tree.leaves + sum(t.leaves - 1 for t in below.values())
    tree.graft(below)
    assert tree.leaves == n == len(set(tree.visit(x[0], n))) and set(tree.file(x)) <= set(range(n))
    for leaf, sub in below.items():
        assert np.array_equal(tree.file(x[parts == leaf]) == leaf, sub.file(x[parts == leaf]) == 0)


def test_groups_of_leaves():
    groups = knn_tree._groups({0: 3000, 1: 3000, 2: 10_000, 4: 5}, 5)
    assert groups.tolist() == [0, 1, 2, 2, 3] or groups.tolist() == [0, 1, 2, 3, 3]


# decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def marked_brute(values, items):
    out = []
    for i, text in enumerate(values):
        words, hit, names = words_of(text), set(), set()
        for item, body in items:
            own = words_of(body)
            n = min(13, len(own))
            for w in {tuple(own[a : a + n]) for a in range(max(1, len(own) - 12))} if own else ():
                for a in range(len(words) - n + 1):
                    if tuple(words[a : a + n]) == w:
                        hit |= set(range(a, a + n))
                        names.add(str(item))
        out.append((i, len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def test_decontamination(spark):
    values = [t for t in TEXTS if t is None or len(t) < 5000]
    items = [(1, values[14]), (2, values[17]), (10, "two WORDS"), (11, ""), (12, None), (13, "one"), (14, " ".join((values[20] or "").split()[3:25])), (1, values[14])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, values)
    expected = marked_brute(values, [x for x in items if x[1]])
    for part_bytes in (1 << 24, 200, 1000, 3000):
        found = decontaminate.mark_contaminated(docs, bench, part_bytes=part_bytes)
        assert sorted(map(tuple, found.collect())) == expected
    kept = decontaminate.mark_contaminated(docs, bench, keep_text=True)
    assert kept.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(str, kept.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert decontaminate.mark_contaminated(docs, bench.where("false")).where("contaminated OR n_items > 0").count() == 0


# substrings


def substrings_brute(values, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in values]
    first = {}
    for i, w in enumerate(words):
        for a in range(len(w) - width + 1):
            first.setdefault(tuple(w[a : a + width]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < i:
                gone |= set(range(a, a + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone))))
    return out


def test_substrings(docs, spark):
    assert sorted(map(tuple, substring_dedup.digest(docs).collect())) == substrings_brute(TEXTS)
    long = TEXTS[30] + " " + " ".join(f"v{i}" for i in range(20))
    odd = table(spark, [long, long, long, None], [None, 5, 5, None])
    assert sorted(r["n_removed"] for r in substring_dedup.digest(odd).collect()) == [0, 0, 0, 0]


@pytest.mark.parametrize("window", [1, 4, 9, 30])
def test_substring_levels(docs, window):
    """One level, two, and a loop of several."""
    assert len(substring_dedup.levels(window)) == {1: 1, 4: 1, 9: 2, 30: 3}[window]
    found = substring_dedup.dedup_substrings(docs, window=window).select("id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == substrings_brute(TEXTS, window)


def test_texts_are_dealt_once(spark, docs, tmp_path):
    """All three readers of the texts share one exchange, also where ids are null."""
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    found = substring_dedup.digest(spark.read.parquet(str(tmp_path / "d")))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2


def test_no_candidate_survives(spark):
    values = [" ".join(f"{c}{i}" for i in range(90)) for c in "abc"]
    found = substring_dedup.dedup_substrings(table(spark, values), window=50).collect()
    assert [r["n_removed"] for r in found] == [0, 0, 0]


def test_different_windows_around_a_hot_passage(spark):
    """Long windows that share a hot short key, some of them repeated, are dealt one by one and found alike."""
    r = random.Random(7)
    word = lambda: f"w{r.randrange(40)}"
    hot = " ".join(f"h{i}" for i in range(9))
    around = [" ".join(word() for _ in range(3)) + f" {hot} " + " ".join(word() for _ in range(3)) for _ in range(60)]
    values = [f"a{i} b{i} " + (r.choice(around) if i % 3 else f"{word()} {hot} {word()} {word()}") + f" {word()} c{i}" for i in range(600)]
    expected = substrings_brute(values)
    assert sum(x[2] > 0 for x in expected) > 200
    docs = table(spark, values).select(F.col("doc_id").alias("id"), "text").repartition("id").cache()
    hot = substring_dedup.hot_keys(docs, hot_share=20)
    assert 0 < len(hot) < 10
    spread = []
    for keys in ([], hot):
        found = substring_dedup.removed_windows(docs, hot=keys).select("id_", F.explode("starts").alias("x")).select("id_", "x.*").collect()
        spread.append({(i, at + j) for i, at, n in found for j in range(n)})
    assert spread[0] == spread[1] and len(spread[0]) > 200
    # the hot keys' windows are dealt to many keys
    live = docs.withColumn("keys", F.array(*[F.lit(k) for k in hot]))
    dealt = []
    for keys in ([], hot):
        emit = substring_dedup._long_level(13, 7, 1 << 20, np.array(keys, np.int64).view(np.uint64))
        dealt.append({r["k"] for r in live.mapInArrow(emit, substring_dedup.RUNS.format("bigint")).select("k").distinct().collect()})
    assert dealt[0] <= set(hot) and len(dealt[1]) > 10 * len(hot)
    found = substring_dedup.dedup_substrings(table(spark, values), hot_share=20).select("id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == expected


def test_hot_passages(spark):
    """A passage in most documents, over many slices and tasks, also under names as ids."""
    r = random.Random(6)
    hot, some = (" ".join(f"{c}{i}" for i in range(40)) for c in "hs")
    values = [" ".join(r.choices([f"w{i}" for i in range(300)], k=20)) + f" {hot} x{i % 5} " + (some if i % 9 == 4 else "") for i in range(900)]
    expected = substrings_brute(values)
    for size in (3000, 1 << 20):
        found = substring_dedup.dedup_substrings(table(spark, values), slice_bytes=size).select("id", "n_words", "n_removed", "kept_sha256")
        assert sorted(map(tuple, found.collect())) == expected
    named = table(spark, values).select(F.lpad(F.col("doc_id").cast("string"), 4, "0").alias("doc_id"), "text")
    assert [r[1:] for r in sorted(map(tuple, substring_dedup.digest(named).collect()))] == [x[1:] for x in expected]


# tokens


@pytest.fixture(scope="module")
def word_ids():
    tokenizer = Tokenizer.from_file(vocabulary(WORD_BPE))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_tokens_round_trip(docs, word_ids, spark):
    start, expected = 0, []
    for i, ids in enumerate(word_ids):
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, repair.digest(docs, vocabulary(WORD_BPE)).collect())) == expected


def test_small_shards(docs, word_ids, spark, tmp_path):
    repair.write_tokens(docs, str(tmp_path / "s"), vocabulary(WORD_BPE), shard_tokens=500)
    found = sorted(map(tuple, repair.read_tokens(spark, str(tmp_path / "s")).collect()))
    assert [(i, n, c) for i, _, n, c in found] == [(i, len(x), crc(x)) for i, x in enumerate(word_ids)]
    assert [s for _, s, *_ in found] == np.cumsum([0, *map(len, word_ids)])[:-1].tolist()
    assert spark.read.parquet(str(tmp_path / "s")).count() > 10


@pytest.mark.parametrize("seed", range(4))
def test_grammar(seed):
    r = np.random.default_rng(seed)
    tokens = r.integers(0, 6, 4000).astype(np.uint32)
    ends = np.unique(np.append(r.integers(0, 4000, 50), 3999))
    symbols, borders, rules, lengths = repair.compress(tokens, ends, 100)
    assert len(rules) and len(symbols) < len(tokens)
    assert (repair.expand(symbols, rules.astype(np.int64), lengths.astype(np.int64), 100) == tokens).all()
    first = np.append(0, borders)
    for d, (a, b) in enumerate(zip(np.append(0, ends[:-1] + 1), ends + 1, strict=True)):
        own, cut = symbols[first[d] : first[d + 1]], (b - a) // 3
        assert (repair.token_range(own, rules.astype(np.int64), lengths.astype(np.int64), 100, cut, b - a) == tokens[a + cut : b]).all()


def test_grammar_leaves_no_frequent_pair():
    r = np.random.default_rng(8)
    tokens = r.integers(0, 40, 30_000).astype(np.uint32)
    ends = np.unique(np.append(r.integers(0, 30_000, 90), 29_999))
    symbols, borders, rules, _ = repair.compress(tokens, ends, 100)
    inner = np.ones(len(symbols) - 1, bool)
    inner[borders[:-1] - 1] = False
    pairs = np.stack([symbols[:-1], symbols[1:]], 1)[inner]
    assert len(rules) and np.unique(pairs, axis=0, return_counts=True)[1].max() < repair.MIN_COUNT


def test_token_ranges(docs, word_ids, spark, tmp_path):
    """Any range of any document, without the rest of its shard."""
    path = str(tmp_path / "r")
    repair.write_tokens(docs, path, vocabulary(WORD_BPE), shard_tokens=2000)
    r = random.Random(1)
    asked = [(0, 0, 1), (2, 0, 9), (3, 5, 9)]
    for i in range(len(TEXTS)):
        a = r.randrange(len(word_ids[i]))
        asked += [(i, a, r.randint(a, len(word_ids[i]) + 3))]
    wanted = spark.createDataFrame([*asked, (10_000, 0, 1)], "id long, from_token int, to_token int")
    found = [(x["id"], x["from_token"], x["to_token"], x["tokens"]) for x in repair.read_ranges(spark, path, wanted).collect()]
    assert sorted(found) == sorted((i, a, b, word_ids[i][a:b]) for i, a, b in asked)


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_every_letter_before_punctuation(name):
    """A letter may normalize to one with a mark, which shares a pre-token with punctuation."""
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    values = [f"{c}. a{c},! x" for c in letters]
    r = random.Random(3)
    odd = [chr(c) for c in range(0x3100) if chr(c).isprintable()]
    values += ["".join(r.choice(odd) if r.random() < 0.6 else r.choice(" .,!?'|\n\ta") for _ in range(9)) for _ in range(20_000)]
    values += ["पेड़.", "İ.", "\u0958! x"]
    own = Encoder(vocabulary(name))
    wanted = Tokenizer.from_file(vocabulary(name)).encode_batch(values, add_special_tokens=False)
    assert [v for v, w in zip(values, wanted, strict=True) if np.frombuffer(own.encode(v), "<u4").tolist() != w.ids] == []


# fingerprints


def fingerprint_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_brute(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs):
    prints = [fingerprint_brute(t) for t in TEXTS]
    expected = [(i, format(p, "016x"), c) for i, (p, c) in enumerate(zip(prints, roots_brute(prints), strict=True))]
    assert sorted(map(tuple, simhash.digest(docs).collect())) == expected


def test_simhash_finds_every_distance(spark):
    r = random.Random(2)
    prints = [r.getrandbits(64) for _ in range(40)]
    lone = [r.getrandbits(64) for _ in range(30)]  # pairs that no third one is near
    prints += lone + [p ^ sum(1 << f for f in r.sample(range(64), n % 5)) for n, p in enumerate(lone)]
    for n in range(160):
        flips = r.sample(range(64), n % 5)
        prints.append(prints[r.randrange(40)] ^ sum(1 << f for f in flips))
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(simhash.with_partner(nodes))).collect()}
    brute = roots_brute(prints)
    assert len({brute[i] for i in range(len(prints))}) == len({found.get(p, p) for p in signed})
    assert all((brute[i] == brute[0]) == (found.get(p, p) == found.get(signed[0], signed[0])) for i, p in enumerate(signed))


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """A text without an id lies within 3 bits of two that do not meet; a component of such rows alone has no name."""
    prints = [(7, 0b0), (None, 0b111), (5, 0b111111), (None, 0b111), (None, 0xFF << 40), (None, 0xFE << 40), (9, -1), (9, 0b1)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("id", "fp"))
    rows = spark.createDataFrame(prints, "id long, fp long")
    found = sorted((r["fp"], r["id"] or 0, r["component_id"]) for r in simhash.near_duplicates(rows, "id", "fp").collect())
    assert found == sorted((fp, i or 0, None if fp >> 40 > 0 else 9 if fp == -1 else 5) for i, fp in prints)


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in components.components(edges).collect()} == {0}
    assert components.components(edges.where("false")).count() == 0


# shards


def test_sharding(docs):
    rows = sharding.digest(docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    shards = {}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert (by_id[i]["size"], by_id[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        shards.setdefault(by_id[i]["shard"], []).append(by_id[i])
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    assert set(shards) <= set(range(16)) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_shards_are_near_equal(spark):
    docs = table(spark, ["x" * (50 + i % 13) for i in range(4000)], [i // 3 for i in range(4000)])
    sums = sharding.digest(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    sizes = [r["n"] for r in sums]
    assert len(sizes) == 16 and max(sizes) <= 1.05 * min(sizes)


@pytest.mark.parametrize(("n", "shards"), [(3200, 16), (40_000, 37)])
def test_repeated_rows_are_shared_out(spark, n, shards):
    """Rows alike in every column, ids null: the law and gapless slots hold."""
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("s").alias("source"))
    found = sharding.kd_shards(docs, shards=shards).groupBy("shard").agg(F.sum("size").alias("b"), F.count("slot").alias("n"), F.max("slot").alias("m")).collect()
    sizes = [r["b"] for r in found]
    assert len(sizes) == shards and max(sizes) <= 1.05 * min(sizes) and all(r["m"] + 1 == r["n"] for r in found)


def test_hot_rows_among_others(spark):
    docs = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"),
    )
    sizes = [r["b"] for r in sharding.digest(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.05 * min(sizes)


def test_target_bytes(spark):
    docs = table(spark, ["x" * 99] * 200)
    assert sharding.kd_shards(docs, target_bytes=5000).select("shard").distinct().count() == 4


# lines


def lines_brute(values):
    holders = {}
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")] for t in values]
    for i, own in enumerate(keys):
        for key in own:
            holders.setdefault(key, set()).add(i)
    out = []
    for i, t in enumerate(values):
        lines = (t or "").split("\n")
        kept = [x for x, key in zip(lines, keys[i], strict=True) if len(key) < 20 or len(holders[key]) < 3 or max(holders[key]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def test_lines(docs):
    expected = lines_brute(TEXTS)
    assert any(x[2] for x in expected)
    assert sorted(map(tuple, line_dedup.digest(docs).collect())) == expected


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (7, 2), (9, 3)])
def test_line_runs_do_not_depend_on_batches(docs, batches, fanout):
    found = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert found.select(docs.columns).columns == docs.columns
    got = found.select("doc_id", "_n_lines", "_n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == lines_brute(TEXTS)


def test_lines_of_very_long_texts(spark):
    """A hundred thousand lines, of which some go: linear time, right result."""
    values = ["\n".join([f"line {k} of the text numbered {i}" if k % 3 else "a line that all the texts share" for k in range(100_000)]) for i in range(3)]
    assert sorted(map(tuple, line_dedup.digest(table(spark, values)).collect())) == lines_brute(values)


def test_line_runs_are_merged_without_moving_them(docs, spark):
    index = line_dedup.line_index(docs, "doc_id", "text").cache()
    runs = line_dedup.LineRuns(spark)
    for low in (40, 20, 10, 0):
        runs.add(index.where((F.col("id") >= low) & (F.col("id") < {40: 999, 20: 40, 10: 20, 0: 10}[low])).select("id", "h1", "h2").distinct())
    got = {(r["h1"], r["h2"]): (r["n_docs"], r["keep_id"]) for r in runs.merged().collect()}
    true = index.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n"), F.max("id").alias("k")).collect()
    # settled lines are not counted on: from three documents on the count only says so
    assert {k: (min(n, 3), i) for k, (n, i) in got.items()} == {(r["h1"], r["h2"]): (min(r["n"], 3), r["k"]) for r in true}
    both = runs._run(runs._write(runs.merged(), 0), 0).join(runs._run(runs._write(runs.merged(), 0), 1).hint("merge"), ["h1", "h2"])
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    runs.close()
    index.unpersist()


def test_lines_of_null_and_repeated_ids(spark):
    line = "the very same long line of text"
    found = line_dedup.digest(table(spark, [line] * 6, [None, None, 1, 1, 2, 3])).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in found) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 0)]


def test_lines_of_different_texts_under_one_id(spark):
    line = "the very same long line of text"
    values = [line + "\nown", "only here, at the same place\nown two", line, "x\n" + line, line]
    found = line_dedup.dedup_lines(table(spark, values, [1, 1, 2, 1, 3])).collect()
    assert sorted((r["doc_id"], r["text"], r["_n_dropped"]) for r in found) == [
        (1, "only here, at the same place\nown two", 0), (1, "own", 1), (1, "x", 1), (2, "", 1), (3, line, 0),
    ]
    # the repeats count as one document: two of them are too few
    few = line_dedup.dedup_lines(table(spark, values[:4], [1, 1, 1, 2])).collect()
    assert sum(r["_n_dropped"] for r in few) == 0


# quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2)) == 0
    scored = quality.digest(docs, labels.where(half)).join(labels.where(~half), "doc_id").toPandas()
    toxic = scored["p_toxic"] >= 0.5
    bad = scored["p_bad"] >= 0.5
    assert (toxic == (scored["toxic"] == 1)).mean() >= 0.97
    assert (bad == (scored["quality"] == 0)).mean() >= 0.99


def test_quality_of_odd_rows(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (3, None, 1), (5, 0, 1), (5, 1, 0), (999, 1, 1), (20, 1, 0), (21, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.digest(docs, none).where("keep").count() == len(TEXTS)
    out = quality.classify(docs, odd)
    assert out.count() == len(TEXTS) and out.columns[: len(docs.columns)] == docs.columns
    assert out.where("_p_bad IS NULL OR _p_toxic IS NULL OR _keep IS NULL").count() == 0
    assert quality.digest(empty, odd).count() == 0


def shrunk_brute(sites, base):
    """The rate of every (host, path): sums of expected marks, shrunk to the host's rate and that to the global one, each by its own weight."""
    expected = {s: [1 / (1 + np.exp(-(e + base))) for e in own] for s, own in sites.items()}
    hosts = {}
    for (host, _), own in expected.items():
        hosts.setdefault(host, []).extend(own)
    n = sum(map(len, hosts.values()))
    rate = min(1 - 1e-6, max(1e-6, sum(map(sum, hosts.values())) / n))
    noise = rate * (1 - rate)
    mean = {h: sum(own) / len(own) for h, own in hosts.items()}

    def weight(noise, spread, free):
        between = max(0.0, (spread - free * noise) / n)
        return min(1e4, max(20.0, noise / between - 1 if between else 1e4))

    above = weight(noise, sum(len(own) * (mean[h] - rate) ** 2 for h, own in hosts.items()), len(hosts) - 1)
    within = sum(len(own) * mean[h] * (1 - mean[h]) for h, own in hosts.items()) / n
    spread = sum(len(own) * (sum(own) / len(own) - mean[s[0]]) ** 2 for s, own in expected.items())
    below = weight(within, spread, len(expected) - len(hosts))
    host_rate = {h: (sum(own) + above * rate) / (len(own) + above) for h, own in hosts.items()}
    return {s: (sum(own) + below * host_rate[s[0]]) / (len(own) + below) for s, own in expected.items()}


def verdicts_brute(docs, labels):
    """id -> (chance of bad, chance of toxic, kept), from the model's evidence alone."""
    model = quality.train(docs, labels, "doc_id", "text")
    rows = quality.with_evidence(docs.select("doc_id", "source", "lang", "text"), model, "text").drop("text").collect()
    rates = {}
    for h, name in enumerate(quality.HEADS):
        sites = {}
        for r in rows:
            sites.setdefault((r["source"], r["lang"]), []).append(r[f"_{name}"])
        rates[name] = shrunk_brute(sites, model.base[h])
    out = {}
    for r in rows:
        sites = [rates[name][r["source"], r["lang"]] for name in quality.HEADS]
        chance = [1 / (1 + np.exp(-(r[f"_{name}"] + np.log(p / (1 - p))))) for name, p in zip(quality.HEADS, sites, strict=True)]
        out[r["doc_id"]] = (*chance, max(chance) < 0.5)
    return out


def test_posteriors_equal_brute_force(spark):
    """Shrunk rates, posteriors and verdicts of all rows, from the same evidence."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.withColumns({"source": F.when(F.col("doc_id") % 11 > 0, F.col("source")), "lang": F.when(F.col("doc_id") % 7 > 0, F.col("lang"))})
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    wanted = verdicts_brute(docs, labels)
    assert found.keys() == wanted.keys() and 0 < sum(keep for *_, keep in wanted.values()) < len(wanted)
    for i, (bad, toxic, keep) in wanted.items():
        assert (found[i]["_p_bad"], found[i]["_p_toxic"]) == (pytest.approx(bad, abs=1e-9), pytest.approx(toxic, abs=1e-9))
        assert found[i]["_keep"] == keep
    digest = {r["doc_id"]: r for r in quality.digest(docs, labels).collect()}
    assert {i: (round(r["_p_bad"], 6), r["_keep"]) for i, r in found.items()} == {i: (r["p_bad"], r["keep"]) for i, r in digest.items()}


def test_a_labelled_id_on_many_rows_is_one_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda border, index, shape, marks: seen.append(len(marks)))
    rows = [(i if i < 200 else 7, f"text {i % 3000} of {'good' if i % 2 else 'bad'} words") for i in range(12_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(7, 1, 0)] * 500, "doc_id long, quality int, toxic int")
    quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels, "doc_id", "text", sample_rows=200)
    assert seen == [200]


def test_paths_of_a_host_have_a_weight_of_their_own(spark):
    """Paths that differ much keep their rates, although the hosts are alike."""
    rows = [(f"h{h}", f"p{p}", 3.0 if p % 2 else -3.0, -9.0) for h in range(4) for p in range(6) for _ in range(60)]
    scored = spark.createDataFrame(rows, "_host string, _path string, _bad double, _toxic double")
    rates = {(r["_host"], r["_path"]): r["_bad_rate"] for r in quality.site_rates(scored, {"bad": 0.0, "toxic": 0.0}).collect()}
    assert all((rate > 0.8) if path in ("p1", "p3", "p5") else (rate < 0.2) for (_, path), rate in rates.items())


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", -2.0, -9.0)] * 500 + [("foul", "p", 2.0, -9.0)] * 200 + [("small", "p", 2.0, -9.0)] + [(None, None, 0.0, 0.0)]
    scored = spark.createDataFrame(rows, "_host string, _path string, _bad double, _toxic double")
    rates = {r["_host"]: r["_bad_rate"] for r in quality.site_rates(scored, {"bad": 0.0, "toxic": 0.0}).collect()}
    assert rates["big"] < rates["small"] < rates["foul"] and len(rates) == 4


# chats


def chats_brute(rows):
    talks = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            talks.setdefault(c, []).append((-(1 << 62) if turn is None else turn, role or "", text or ""))
    talks = {c: tuple(x[1:] for x in sorted(t)) for c, t in talks.items()}
    out = []
    for c, own in talks.items():
        same = [d for d, t in talks.items() if t == own]
        if c == min(same) and not any(len(t) > len(own) and t[: len(own)] == own for t in talks.values()):
            shown = "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in own)
            out.append((c, len(own), len(same), shown))
    return sorted(out)


def test_many_equal_turns_fill_runs_of_their_own(spark):
    """All rows of a conversation share one turn or have none: runs stay small, and the texts are whole."""
    rows = [("a", None, "user", f"said {i}") for i in range(900)] + [("b", 5, f"r{i % 7}", f"t {i}") for i in range(700)] + [("c", 1, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(4)
    placed = chat._placed(turns, "conv_id", "turn", "role", "text")
    runs = placed.groupBy("c", "run").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert tuple(runs) == (chat.RUN, 4 + 3 + 1)
    assert sorted(map(tuple, chat.format_chats(turns).collect())) == chats_brute(rows)


def test_chats(spark):
    r = random.Random(4)
    rows, talk = [], []
    for c in range(40):
        talk = talk[: r.randint(0, len(talk))] + [(r.choice(["user", "assistant", None]), r.choice(["hi", "yes", "<|im_end|>", "", None, "no"])) for _ in range(r.randint(0, 3))]
        rows += [(c, n, *t) for n, t in enumerate(talk)]
    rows += [(100, n, "user", f"t{n}") for n in range(700)] + [(101, n, "user", f"t{n}") for n in range(300)]
    rows += [(102, None, "user", "x"), (102, None, "user", "x"), (102, 5, "a", "y"), (102, 5, "b", "x"), (None, 1, "user", "lost"), (101, 0, "user", "t0")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit(1), "place": F.lit(2)})
    assert sorted(map(tuple, chat.format_chats(turns).collect())) == chats_brute(rows)
    runs = {}
    for r in chat.render_runs(turns).orderBy("conv_id", "run").collect():
        runs.setdefault(r["conv_id"], []).append(r["rendered"])
    assert sorted((c, "".join(parts)) for c, parts in runs.items()) == [(c, shown) for c, _, _, shown in chats_brute(rows)]
    assert len(runs[100]) == 3
    assert chat.format_chats(turns.where("false")).count() == 0


# packing


def check_packing(rows, ids_of, capacity=1024):
    """The contract's law; returns the number of sequences."""
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids_of)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        at = 0
        for n, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == crc(ids_of[d][at : at + r["length"]])
            at += r["length"]
        assert at == len(ids_of[d])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(docs):
    tokenizer = Tokenizer.from_file(vocabulary(BYTE_BPE))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}
    n = check_packing(packing.pack_documents(docs, vocabulary(BYTE_BPE)).collect(), ids)
    assert n <= -(-sum(map(len, ids.values())) // 1024) + 2


def test_many_lines_without_spaces(spark):
    """One word a line, thousands of them: no recursion, and a memo no larger than the text."""
    odd = ["\n".join(f"w{i}" for i in range(5000)), "\n".join("长文本没有空格" for _ in range(5000)), " a\nb\n\nc\n d\n\te\x1c\nf.\ng\n" * 700]
    tokenizer = Tokenizer.from_file(vocabulary(BYTE_BPE))
    own = Encoder(vocabulary(BYTE_BPE))
    for text in odd:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(map(len, own)) + sum(map(len, own.following)) <= sum(map(len, odd))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(odd)}
    check_packing(packing.pack_documents(table(spark, odd), vocabulary(BYTE_BPE)).collect(), ids)


def test_gaps_are_repacked(spark):
    r = np.random.default_rng(1)
    lengths = r.integers(1, 1025, 3000)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "row long, length long")
    places = packing.pack_pieces(rows, part_rows=100, rounds=3).collect()
    alone = packing.pack_pieces(rows, part_rows=100, rounds=0).collect()
    count = lambda found: len({r["sequence_id"] for r in found})
    assert len(places) == 3000 and packing.lower_bound(lengths) <= count(places) < count(alone)


def test_gaps_are_repacked_until_nothing_is_saved(spark):
    r = np.random.default_rng(1)
    lengths = r.integers(200, 500, 6000)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "row long, length long")
    places = packing.pack_pieces(rows, part_rows=20).collect()
    capped = packing.pack_pieces(rows, part_rows=20, rounds=3).collect()
    rooms = {}
    for p in places:
        rooms.setdefault(p["sequence_id"], []).append((p["offset"], int(lengths[p["row"]])))
    for own in rooms.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(own[-1]) <= 1024
    assert len(places) == 6000 and packing.lower_bound(lengths) <= len(rooms) < len({p["sequence_id"] for p in capped})


def test_bounds_hold():
    r = np.random.default_rng(0)
    for _ in range(20):
        lengths = r.integers(1, 1025, r.integers(1, 200))
        bins, offsets = packing.best_fit_decreasing(lengths)
        assert packing.lower_bound(lengths) <= bins.max() + 1
        assert np.bincount(bins, lengths).max() <= 1024
    assert packing.lower_bound(np.array([600] * 5)) == 5
    assert packing.lower_bound(np.array([], np.int64)) == 0


# all of them


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)


def test_benchmark_parts_are_bounded(spark):
    rows = [(i % 50, "w" * (i % 90)) for i in range(400)] + [(7, "long " * 300), (None, "x"), (8, None)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    parts = list(decontaminate._parts(bench, "item_id", "text", 700))
    assert all(len(p) == 1 or sum(len(r["t"]) for r in p) <= 700 for p in parts)
    assert sorted((r["i"], r["t"]) for p in parts for r in p) == sorted({(str(i), t) for i, t in rows if i is not None and t is not None})
    assert list(decontaminate._parts(bench.where("false"), "item_id", "text", 700)) == []


def test_empty_tables(empty, spark):
    bench = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    for found in (
        decontaminate.mark_contaminated(empty, bench), substring_dedup.digest(empty), repair.digest(empty, vocabulary(WORD_BPE)),
        simhash.digest(empty), sharding.digest(empty), line_dedup.digest(empty), packing.pack_documents(empty, vocabulary(BYTE_BPE)),
    ):
        assert found.count() == 0


def test_null_and_repeated_ids(spark):
    values = ["a b c d", None, "a b c d", "", "z " * 3000, "z " * 3000]
    odd = table(spark, values, [None, None, 1, 1, 2, 2])
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    for found in (
        decontaminate.mark_contaminated(odd, bench), substring_dedup.digest(odd), repair.digest(odd, vocabulary(WORD_BPE)),
        simhash.digest(odd), sharding.digest(odd), line_dedup.digest(odd), quality.digest(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")),
    ):
        assert sorted(r["doc_id"] or 0 for r in found.collect()) == [0, 0, 1, 1, 2, 2]
    packed = packing.pack_documents(odd, vocabulary(BYTE_BPE)).collect()
    assert sorted({(r["doc_id"] or 0) for r in packed}) == [0, 1, 2]


def test_columns_named_like_results(docs, spark):
    labels, bench = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, "never seen")], "item_id long, text string")
    odd = docs.withColumns({c: F.lit("z") for c in (*quality.ADDED, *line_dedup.ADDED, "n_words", "contaminated")})
    assert quality.classify(odd, labels).where("_keep").count() == len(TEXTS)
    assert line_dedup.dedup_lines(odd).agg(F.sum("_n_dropped")).first()[0] == sum(x[2] for x in lines_brute(TEXTS))
    assert decontaminate.mark_contaminated(odd, bench, keep_text=True).where("NOT contaminated").count() == len(TEXTS)
