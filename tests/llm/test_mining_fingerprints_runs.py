"""Hard negatives, fingerprints and periodic runs against brute force: nulls, ties, repeats, empty and long texts, clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.llm import fingerprints, hardneg, periodic, substring_dedup
from stratavox.llm.common import words_of
from stratavox.llm.topk import quantised

VECTORS = "vec_id long, embedding array<double>, label long, own long, score long, part long"
DOCS = "doc_id long, text string, part int, end string, runs long, n_chars long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, -1, -1, -1) for i, v, label in rows], VECTORS)


def mined(df):
    return hardneg.mine(df.select("vec_id", "label", quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0)


def brute_mined(rows):
    rows = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, k == label, b) for b, (j, w, k) in enumerate(rows) if b != a and len(w) == len(v)]
        for p, j, _, _ in sorted(s for s in scores if s[2])[:5]:
            fits = sorted((n, m) for n, m, same, _ in scores if not same and 50 * -p <= 100 * -n <= 95 * -p)
            out += [(i, j, r, m, -p, -n) for r, (n, m) in enumerate(fits[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_hard_negatives_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(hardneg, "LEAST", block)
    monkeypatch.setattr(hardneg, "TOGETHER", 3)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).round(1).tolist(), int(rng.integers(0, 3)) if k % 3 else 0) for k in range(230)]
    rows += [(50, rows[50][1], 0), (50, rows[50][1], 0), (7, rows[7][1], 1), (300, [1.0, 2.0, 3.0], 0), (301, [1.0, 2.0, 2.5], 0), (302, [1.0, 1.0, 2.0], 4)]
    rows += [(350, None, 1), (400, [1.0, None, 1.0, 1.0], 1), (450, [float("nan")] * 4, 1), (500, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (550, [1.0] * 4, None), (600, [], 1), (650, [1.0] * 4, 77)]
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in mined(vectors(spark, rows)).collect())
    want = brute_mined(rows)
    assert got == want and len(want) > 40 and any(w[0] == 300 for w in want)


def test_hard_negatives_match_their_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    df = hardneg.op11_hard_negatives(spark, d)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(hardneg.SQL["op11_hard_negatives"]).fetchall())


def test_hard_negatives_beyond_64_bits_and_of_no_rows(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [1e30, 2.0], 0), (2, [8e29, 2.0], 1), (3, [6e29, 0.0], 1), (4, [4e29, 0.0], 1), (5, [8e29, 2.0], 1)]
    got = [tuple(r) for r in mined(vectors(spark, rows)).orderBy("rank").collect()]
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [(0, 1, 1, 2), (0, 1, 2, 5), (0, 1, 3, 3)] and all(g[4] is None and g[5] is None for g in got)
    assert mined(vectors(spark, [])).collect() == [] and mined(vectors(spark, [(1, [1.0], 0), (2, [1.0], 0)])).collect() == []
    for x in (0, 1, -1, 255, -256, 10**30, -(10**30)):
        assert hardneg.score_of(hardneg.place_of(x)) == x


def docs(spark, texts):
    return spark.createDataFrame([(i, t, -1, "x", -1, -1) for i, t in texts], DOCS)


def shingles(text):
    w = words_of(text, lower=True)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def prose(seed, n, vocabulary=900):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def test_likeness_estimates_the_similarity_of_shingles():
    errors = []
    for n in (8, 40, 200, 700, 3000):
        for seed in range(30):
            a, r = prose(seed, n).split(), random.Random(seed)
            b = list(a)
            for _ in range(max(1, n * seed // 300)):
                b[r.randrange(n)] = f"x{r.randrange(10**6)}"
            x, y = " ".join(a), " ".join(b)
            true = len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
            p = fingerprints.packed([x.encode(), y.encode()])
            errors.append((n, float(fingerprints.alike(p[:1], p[1:])[0]) - true))
    for n, limit in ((8, 0.3), (40, 0.12), (200, 0.07), (700, 0.04), (3000, 0.04)):
        mine = np.array([e for m, e in errors if m == n])
        assert np.sqrt((mine**2).mean()) < limit and abs(mine.mean()) < limit / 2, (n, mine)


def test_unlike_texts_and_short_ones():
    texts = [b"one", b"two", b"One", None, b"", b" \n", b"a b c d e", b"a b c d f"]
    p = fingerprints.packed(texts)
    like = lambda i, j: float(fingerprints.alike(p[i : i + 1], p[j : j + 1])[0])
    assert like(0, 2) == 1 == like(3, 4) == like(4, 5) and like(0, 3) == 0 and like(0, 1) < 0.15 and like(6, 7) < 0.15
    assert fingerprints.text_of(p)[3:6] == ["", "", ""] and len(fingerprints.text_of(p)[0]) == fingerprints.BINS * fingerprints.BITS // 4
    bins = fingerprints.bins_of([np.array([5], np.uint64)])
    assert (fingerprints.densified(bins) == bins.min()).all()


def test_neighbours_against_a_plain_loop(spark):
    texts = [(k, prose(k, 5 + 13 * k % 90)) for k in range(60)] + [(70, None), (71, ""), (72, "ß日本😀 " * 30), (73, "one"), (74, prose(74, 6000))]
    df = docs(spark, texts).repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.neighbours(df).collect()}
    assert len(got) == len(texts)
    order = sorted(dict(texts), reverse=True)
    text = {i: t or "" for i, t in texts}
    like = lambda a, b: float(fingerprints.alike(fingerprints.packed([a.encode()]), fingerprints.packed([b.encode()]))[0])
    for at, i in enumerate(order):
        after = text[order[(at + 1) % len(order)]]
        n = len(text[i])
        edited = text[i][: n - n // 3] + after[: n // 3]
        r = got[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.text_of(fingerprints.packed([text[i].encode()]))[0] and r["near_edited"] == like(text[i], edited) and r["near_next"] == like(text[i], after)
    row = df.where("doc_id IN (3, 74)").select(fingerprints.fingerprint(F.col("text")).alias("f")).collect()
    assert {x["f"] for x in row} == {got[3]["fingerprint"], got[74]["fingerprint"]}
    pair = spark.createDataFrame([(got[3]["fingerprint"], got[4]["fingerprint"]), ("", ""), (None, "")], "a string, b string")
    found = [x["l"] for x in pair.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("l")).collect()]
    assert found[0] == like(text[3], text[4]) and found[1] == 1 and found[2] is None


def test_neighbours_of_repeated_rows_null_ids_and_no_rows(spark):
    assert fingerprints.neighbours(docs(spark, [])).collect() == []
    only = fingerprints.neighbours(docs(spark, [(1, "abcdef")])).collect()
    assert only[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and only[0]["near_next"] == 1
    rows = fingerprints.neighbours(docs(spark, [(5, "abcdef")] * 300 + [(4, "uvwxyz"), (None, "123456"), (None, None)])).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = sorted((r["doc_id"] or 0, r["edited_sha256"]) for r in rows)
    assert len(found) == 303 and found.count((5, digest("abcdab"))) == 299 and found.count((5, digest("abcduv"))) == 1
    assert {d for i, d in found if i == 0} <= {digest(""), digest("1234ab"), digest("1234")} and len({d for i, d in found if i == 4} & {digest("uvwx12"), digest("uvwx")}) == 1


def brute_runs(w, ratio=4, least=6):
    """All runs, straight from the definition."""
    n, out = len(w), {}
    for q in range(1, n // ratio + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, ratio * q):
                out.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, size, q) for (s, size), q in out.items())


def brute_row(doc_id, raw):
    w = words_of(raw)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in runs), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    text = b" ".join(x for i, x in enumerate(w) if i not in gone)
    four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_the_definition(seed):
    r, texts = random.Random(seed), []
    for _ in range(60):
        w = []
        while len(w) < r.choice((0, 5, 30, 120, 400)):
            kind = r.random()
            unit = [r.randrange(r.choice((2, 3, 50))) for _ in range(r.randint(1, 9))]
            w += unit * r.randint(1, 7) + unit[: r.randrange(len(unit) + 1)] if kind < 0.6 else [r.randrange(3) for _ in range(r.randint(0, 9))]
        texts.append(w)
    word = {i: x for i, x in enumerate(np.random.default_rng(9).integers(1, 2**63, 100).astype(np.uint64))}
    made = periodic.runs_of([np.array([word[x] for x in w], np.uint64) for w in texts])
    for w, rows in zip(texts, made, strict=True):
        assert [tuple(x) for x in rows.tolist()] == brute_runs(w)


def test_runs_when_all_prefix_hashes_are_equal(monkeypatch):
    """Without any help of the hashes the comparison word by word alone decides."""
    x = np.array([1, 2, 1, 2, 1, 2, 1, 2, 9, 5, 5, 5, 5, 5, 5, 5], np.uint64)
    monkeypatch.setattr(periodic.Prefixes, "repeat", lambda self, at, p, size: np.ones(len(at), bool))
    found = periodic.repetitions(x, np.array([0]), np.array([len(x)]))
    assert {(0, 8, 2), (9, 16, 1)} >= {tuple(f) for f in found.tolist()} and len(found) > 0


def test_least_overlap():
    assert periodic.overlap() == 5 and periodic.overlap(4, 20) == 15 and all(max(6, 4 * q) - q >= 5 for q in range(1, 100))


def test_masking_loses_no_run():
    x = np.array([7, 7, 7, 7, 7, 7, 1, 2, 3, 4, 5, 6, 8, 9, 1, 2, 3, 4, 5, 11], np.uint64)
    held = periodic.surviving(x, np.zeros(len(x), np.int64), 5)
    assert held.tolist() == [True] * 6 + [True] * 5 + [False] * 3 + [True] * 5 + [False]


def test_runs_of_a_table(spark):
    texts = [(k, prose(k, 20 + 7 * k % 300, 5 + k)) for k in range(150)]
    texts += [(900, None), (901, ""), (902, " \n\t"), (903, "no"), (904, "no " * 5), (905, "no " * 6), (906, "la lo\tla lo la lo la\x0blo"), (None, "x y " * 4), (None, None), (907, "ß 日本 " * 9), (907, "ß 日本 " * 9), (908, "a a\xa0a a\xa0a a\xa0a a\xa0a a\xa0a a")]
    texts += [(909, "no " * 3000), (910, prose(1, 500) + " " + "Yes yes " * 2500), (911, (prose(2, 1200) + " ") * 4)]
    df = docs(spark, texts)
    made = periodic.digests(df.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInPandas(lambda bs: periodic.collapse_batches(b.assign(raw=[periodic.planted(None if i != i else i, r) for i, r in zip(b["doc_id"], b["raw"], strict=True)]) for b in bs), periodic.COLLAPSED))
    got = sorted((tuple(r) for r in made.collect()), key=str)
    assert got == sorted((brute_row(i, t) for i, t in texts), key=str)
    assert sum(g[1] > 0 for g in got) > 15 and periodic.collapse(docs(spark, [])).collect() == []
    plain = {r["doc_id"]: (r["n_words"], bytes(r["collapsed"])) for r in periodic.collapse(df.where("doc_id IN (905, 906)")).collect()}
    assert plain == {905: (6, b"no"), 906: (8, b"la lo")}
    with pytest.raises(ValueError):
        periodic.collapse(df, 3)


def test_query_of_runs_on_a_given_table(spark):
    d = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in periodic.op13_periodic_runs(spark, d).collect()), key=str)
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()), key=str)


def test_long_constant_text():
    x = np.full(60_000, 7, np.uint64)
    assert periodic.runs_of([x])[0].tolist() == [[0, 60_000, 1]]


def test_large_ids_beside_nulls_stay_exact(spark):
    big = (1 << 62) + 1
    df = docs(spark, [(big, "a b c d e f " * 30), (None, "x y"), (big + 2, "no " * 9)]).coalesce(1)
    for got in (periodic.collapse(df), fingerprints.neighbours(df), substring_dedup.report(df)):
        assert {r["doc_id"] for r in got.collect()} == {big, big + 2, None}
