"""Fill-in-the-middle, ranked search and archives against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from contextlib import contextmanager
from pathlib import Path

import duckdb
import numpy as np
import pytest

from rolloutframe.llm import fill_middle, queries, ranked_search, warc
from tests.llm.test_operators import LOWER, TEXTS, docs, empty, sha, table  # noqa: F401

SF = "/root/testdata/sf0.001"


def against_oracle(spark, name):
    """Rows of a query and of its SQL over the smallest tables, columns in one order."""
    frame = queries.queries()[name](spark, SF)
    engine = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "labels", "conversations"):
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = sorted(frame.columns)
    found = engine.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, frame.select(columns).collect()))), sorted(map(repr, found))


# fill-in-the-middle


def cut_brute(doc_id, text, fim=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text, text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < spm else "psm", len(p), len(m), out, text


CUT = [*TEXTS, "<P", "<\n<P>", "a<S>b", "x\r\ny\r\n", "a<\nb<\nc<\n", "é\n" * 9, "\U0001f600\n日本\n\n", "\n", "no feed", "l\n" * 40_000]


@pytest.mark.parametrize(("fim", "spm", "seed"), [(100, 50, 7), (40, 90, 11), (0, 0, 7), (100, 100, 7)])
def test_fill_in_middle_is_the_brute_force(spark, fim, spm, seed):
    ids = [None if i == 3 else i if i != 21 else 20 for i in range(len(CUT))]
    rows = table(spark, CUT, ids)
    found = fill_middle.fill_in_middle(
        rows, fim_percent=fim, spm_percent=spm, seed=seed,
        columns=("n", "form", "prefix_chars", "middle_chars", "output", "restored"),
    )
    expected = sorted(repr((i, *cut_brute(i, t, fim, spm, seed))) for i, t in zip(ids, CUT, strict=True))
    assert sorted(repr(tuple(r)) for r in found.collect()) == expected


def test_fill_in_middle_digest(spark, empty):
    found = {r["doc_id"]: r for r in fill_middle.digest(table(spark, CUT)).collect()}
    for i, t in enumerate(CUT):
        n, form, p, m, out, text = cut_brute(i, t)
        assert tuple(found[i])[1:] == (n, form, p, m, sha(out), sha(text))
    assert fill_middle.digest(empty).collect() == []
    assert {r["form"] for r in found.values()} == {"plain", "spm", "psm"}


def test_fill_in_middle_equals_its_sql(spark):
    found, expected = against_oracle(spark, "op11_fill_in_middle")
    assert found == expected


# ranked search

ITEM = "item_id long, text string, doc_id string, id int, item string, score int, rank int"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked_brute(docs, items, k=10):
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for i, t in items:
        if i is not None and t is not None:
            wanted.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in wanted.items():
        found = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms if t in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(map(repr, out))


def ranked_items(values):
    rows = [(i, t, "d", 1, "i", 2, 3) for i, t in values]
    return rows


ITEMS = [(1, "w1 w2 W3 w3 x-y été"), (2, None), (3, "nothing matches zzz"), (4, ""), (5, "the one two words"), (5, "w7 naïve"),
         (None, "w1"), (6, "w1"), (6, "w1"), (7, " ".join(f"w{i}" for i in range(60))), (8, "ab a 42 don't ÜBER")]


@pytest.mark.parametrize(("k", "part_bytes", "block_docs", "block_postings"), [(10, 1 << 20, 1 << 16, 1 << 22), (3, 20, 7, 50), (1, 1, 1, 1), (200, 64, 16, 200)])
def test_ranked_search_is_the_brute_force(spark, k, part_bytes, block_docs, block_postings):
    ids = [None if i in (3, 25) else i if i != 21 else 20 for i in range(len(TEXTS))]
    rows = table(spark, TEXTS, ids)
    items = spark.createDataFrame(ranked_items(ITEMS), ITEM)
    found = ranked_search.search(rows, items, k=k, part_bytes=part_bytes, block_docs=block_docs, block_postings=block_postings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.schema["item_id"].dataType.typeName() == "long"
    assert sorted(repr(tuple(r)) for r in found.collect()) == ranked_brute(zip(ids, TEXTS, strict=True), ITEMS, k)


def test_ranked_search_without_rows(spark, empty):
    items = spark.createDataFrame(ranked_items(ITEMS), ITEM)
    assert ranked_search.search(empty, items).collect() == []
    assert ranked_search.search(table(spark, [None, "", " - "]), items).collect() == []
    assert ranked_search.search(table(spark, TEXTS[:9]), items.limit(0)).collect() == []


def test_equal_scores_go_by_id(spark):
    """A third of all rows are copies: the ten least ids of them are found, in order."""
    values = ["rare word here"] * 90 + [f"other text {i}" for i in range(180)]
    items = spark.createDataFrame(ranked_items([(1, "rare here"), (2, "text")]), ITEM)
    found = [tuple(r) for r in ranked_search.search(table(spark, values, [5 * i for i in range(270)]), items, block_docs=13).collect()]
    assert [(r, d) for i, r, d, _ in sorted(found) if i == 1] == [(n + 1, 5 * n) for n in range(10)]
    assert len(found) == 20


def test_the_walk_stops_early_and_stays_exact():
    """One rare term decides: postings of the common terms are left unread."""
    r = np.random.default_rng(1)
    n = 4000
    sizes = np.full(n, 4)
    term = np.stack([np.zeros(n, int), np.ones(n, int), np.full(n, 2), np.full(n, 3)], 1)
    term[:30, 3] = 4
    tf = r.integers(1, 9, (n, 4))
    tf[:30, 3] = np.arange(1, 31)
    weight = np.array([30, 40, 50, 60, 90_000])
    length = r.integers(50, 150, n)
    block = ranked_search.Block(length, sizes, term.ravel(), tf.ravel(), weight, n, int(length.sum()))
    own = np.array([0, 1, 2, 4])
    docs, score, read = block.search(own, 10)
    m = 10 + 90 * length * n // int(length.sum())
    whole = np.zeros(n, np.int64)
    for j in range(4):
        gain = weight[term[:, j]] * ((1_000_000_000 * tf[:, j]) // (1000 * tf[:, j] + 8 * m))
        whole += np.where(term[:, j] != 3, gain, 0)
    assert read < 3 * n and (whole[docs] == score).all()
    best = np.argsort(-whole, kind="stable")[:10]
    assert set(best) <= set(docs.tolist())


def test_random_corpora_are_ranked_exactly():
    r = random.Random(2)
    for _ in range(30):
        n, v = r.randint(1, 300), r.randint(1, 30)
        rows = [sorted(r.sample(range(v), r.randint(0, v))) for _ in range(n)]
        sizes = np.array([len(x) for x in rows])
        term = np.array([t for x in rows for t in x], dtype=np.int64)
        tf = np.array([r.randint(1, 4) for _ in term], dtype=np.int64)
        length = np.array([r.randint(1, 60) for _ in rows])
        weight = np.array([r.choice([0, 5, 100, 4000]) for _ in range(v)])
        block = ranked_search.Block(length, sizes, term, tf, weight, n, int(length.sum()))
        own = np.array(sorted(r.sample(range(v), r.randint(1, v))))
        docs, score, _ = block.search(own, 5)
        m = 10 + 90 * length * n // int(length.sum())
        whole, at = [], 0
        for d, x in enumerate(rows):
            whole.append(sum(int(weight[t]) * int(1_000_000_000 * tf[at + j] // (1000 * tf[at + j] + 8 * m[d])) for j, t in enumerate(x) if t in own))
            at += len(x)
        edge = sorted(whole, reverse=True)[:5][-1]
        assert {d for d, s in enumerate(whole) if s >= max(1, edge)} <= set(docs.tolist())
        assert all(whole[d] == s for d, s in zip(docs, score, strict=True))


def test_ranked_search_equals_its_sql(spark):
    found, expected = against_oracle(spark, "op12_ranked_search")
    assert found == expected


# archives

PAGE = "page_id long, url string, html string, at long, file string, digest string, payload string, seq int"
RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
FORGED = RECORD.format(999, 5, "inner")
PAGES = [
    (1, "http://a/1", "plain"), (2, None, None), (3, "http://a/3\r\nX: y", ""), (None, "u", "no id"), (None, "u", "no id"),
    (4, "u", FORGED), (5, "u", FORGED * 40 + "tail"), (6, "u", "WARC/1.1"), (7, "u", "WARC/1.1\r\n"), (8, "u", "WARC/1.1\r\nWARC/1.1\r\n"),
    (9, "u", "x\r\n\r\n" + FORGED[:-2]), (10, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\nsmall"), (11, "u", "\r\n\r\n\r\n\r\n"),
    (12, "u", "é" * 500), (13, "u", "é" * 500), (14, "u", "é" * 499), (15, "u", "é" * 499), (None, "u", "é" * 500), (13, "v", "é" * 500),
    *[(20 + i, "u", "copy " * 400) for i in range(30)], *[(60 + i, "u", f"text {i} " * (i + 1) + "\x00\U0001f600日本") for i in range(40)],
    (200, "u", "long " * 60_000), (201, "u", ("long " * 999 + FORGED) * 20), (202, "u", "WARC/1.1\r\n" * 3000),
]


def archive_brute(pages, least=1000):
    groups = {}
    for i, _, html in pages:
        body = (html or "").encode()
        if len(body) >= least and i is not None:
            groups[body] = max(i, groups.get(body, i))
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        kept = groups.get(body)
        again = kept is not None and kept != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(map(repr, out))


def pages_table(spark, pages, parts=3):
    return spark.createDataFrame([(*p, 1, "f", "d", "p", 2) for p in pages], PAGE).repartition(parts)


@contextmanager
def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


DIGEST = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("split", ["20000", "128m"])
def test_archives_round_trip(spark, tmp_path, split):
    path = f"{tmp_path}/warc {split}"
    warc.write_warc(pages_table(spark, PAGES), path, date="2020-01-01T00:00:00Z")
    with small_splits(spark, split):
        found = warc.read_warc(spark, path, keep_payload=True).collect()
    assert sorted(repr(tuple(r[c] for c in DIGEST)) for r in found) == archive_brute(PAGES)
    assert all(r["intact"] for r in found)
    texts = {(r["page_id"], bytes(r["payload"])) for r in found if r["record_type"] == "response"}
    assert {(5, (FORGED * 40 + "tail").encode()), (202, b"WARC/1.1\r\n" * 3000), (2, b""), (49, b"copy " * 400)} <= texts


def test_chains_cross_tiny_splits(spark, tmp_path):
    few = [p for p in PAGES if len(p[2] or "") < 600][:16]
    warc.write_warc(pages_table(spark, few, 1), f"{tmp_path}/w")
    with small_splits(spark, "90"):
        found = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert sorted(repr(tuple(r[c] for c in DIGEST)) for r in found) == archive_brute(few)


def test_archive_digest(spark):
    assert sorted(repr(tuple(r)) for r in warc.digest(pages_table(spark, PAGES)).collect()) == archive_brute(PAGES)
    plain = [p for p in PAGES if "WARC" not in (p[2] or "")]
    assert sorted(repr(tuple(r)) for r in warc.digest(pages_table(spark, plain, 1)).collect()) == archive_brute(plain)
    assert warc.digest(pages_table(spark, [(None, None, None)]).limit(0)).collect() == []


def test_records_of_archives_are_valid_text(spark, tmp_path):
    warc.write_warc(pages_table(spark, [(7, "http://x/é", "<p>hé</p>")], 1), f"{tmp_path}/w", date="2020-01-01T00:00:00Z")
    (raw,) = [p.read_bytes() for p in Path(f"{tmp_path}/w").glob("part-*")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 10\r\n\r\n"
    body = "<p>hé</p>".encode()
    assert raw == (
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://x/é\r\n"
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\nContent-Type: application/http;msgtype=response\r\n"
        f"Content-Length: {len(http) + len(body)}\r\n\r\n"
    ).encode() + http + body + b"\r\n\r\n"


@pytest.mark.parametrize("split", ["300", "128m"])
def test_foreign_and_broken_archives(spark, tmp_path, split):
    """Bytes that are no text, other records, a lost tail, a file that begins elsewhere."""
    raw = bytes(range(256)) * 3 + FORGED.encode() + b"\xff\xfe"
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = b"WARC/1.1\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:page:1>\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(raw), raw)
    for name, content in (("a", info + data + info), ("b", info + data[:-30]), ("c", b"x" + info), ("d", b"")):
        (tmp_path / f"{name}.warc").write_bytes(content)
    with small_splits(spark, split):
        found = warc.read_warc(spark, str(tmp_path), keep_payload=True).collect()
    rows = sorted((r["file"][-6:-5], r["at"], r["record_type"], bytes(r["payload"])) for r in found)
    assert rows == [
        ("a", 0, "warcinfo", b"abc"), ("a", len(info), "resource", raw), ("a", len(info) + len(data), "warcinfo", b"abc"), ("b", 0, "warcinfo", b"abc"),
    ]


def test_archive_query_equals_its_sql(spark):
    found, expected = against_oracle(spark, "op13_warc")
    assert found == expected
