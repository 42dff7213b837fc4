"""The numbered operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.llm import mixing, ngram_join, packing, quality_divergence, substring_dedup, token_counts, topk, toxicity, url_reputation, warc, wordtable
from stratavox.llm.common import words_of
from stratavox.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, token long, cid long"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts, sources=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, "en", (sources or ["a"])[k % len(sources or ["a"])], None, -1, -1, -1, -1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, changes, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "one"), (905, "One two three"), (906, "Ünïcode ßtraße 日本 😀"), (907, "no " * 3000)]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = list(ODD)
    for g in range(6):
        base = prose(g, 130)
        texts.append((10 * g, base))
        texts += [(10 * g + k, edited(base, k % 4, 100 * g + k)) for k in range(1, 8)]
    texts += [(200 + k, prose(3, 130)) for k in range(5)]
    passage = prose(77, 70)
    texts += [(300 + k, f"{prose(1000 + k, 60)}\n{passage} {prose(2000 + k, 80)}") for k in range(6)]
    texts += [(400 + k, prose(5000 + k, 30)) for k in range(10)]
    return docs(spark, texts, ["a", "b", None]), dict(texts)


def brute_sets(texts):
    out = {}
    for i, t in texts.items():
        w = words_of(t, lower=True)
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_ngram_join_is_exact(spark, corpus):
    df, texts = corpus
    sets = brute_sets(texts)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_groups(df).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    kept = {r["doc_id"] for r in ngram_join.keep_one(df).collect()}
    assert kept == {i for i in sets if want[i] == i}
    assert ngram_join.keep_one(df).columns == df.columns


def test_ngram_join_when_no_star_helps(spark, corpus, monkeypatch):
    """Without star rounds' help and with every list compared in full, the components are the same."""
    df, texts = corpus
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    a = {r["doc_id"]: r["component_id"] for r in ngram_join.join_groups(df).collect()}
    monkeypatch.undo()
    assert a == {r["doc_id"]: r["component_id"] for r in ngram_join.join_groups(df).collect()}


@pytest.mark.parametrize("operator", [ngram_join.join_groups, substring_dedup.report, mixing.mix, quality_divergence.judge])
def test_empty_tables(spark, operator):
    assert operator(docs(spark, [])).collect() == []


def test_repeated_rows_and_null_ids(spark):
    t = prose(1)
    df = docs(spark, [(5, t), (5, t), (None, t), (None, None), (7, prose(2))])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.join_groups(df).where(F.col("n_shingles") > 0).collect())
    assert [g[3] for g in got if g[1] in (5,)] == [5, 5]
    assert mixing.mix(df).count() == 5 and substring_dedup.report(df).count() == 5 and ngram_join.join_groups(df).count() == 5


def test_one_row_of_each_component_stays(spark):
    """Rows of one id with different texts, equal rows, copies without id, and empty texts."""
    t, u, v = prose(1), prose(2), prose(3)
    df = docs(spark, [(5, t), (5, t), (5, u), (4, edited(t, 1, 9)), (9, u), (None, u), (None, v), (None, v), (8, None), (8, ""), (None, " ")])
    kept = Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect())
    assert kept == Counter([(4, edited(t, 1, 9)), (5, u), (None, v), (8, None), (8, ""), (None, " ")])
    assert ngram_join.keep_one(docs(spark, [])).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert got == want


def tree_windows(h, least):
    """(low, c, high) of the subtrees of the Cartesian tree over h that span ``least``, cut to least - 1 on either side of c."""
    out, todo = set(), [(0, len(h))]
    while todo:
        a, b = todo.pop()
        if b - a >= least:
            c = a + int(np.argmin(h[a:b]))
            out.add((max(a, c - least + 1), c, min(b - 1, c + least - 1)))
            todo += [(a, c), (c + 1, b)]
    return out


def test_compact_windows_are_the_subtrees_of_the_cartesian_tree():
    rng = np.random.default_rng(0)
    for sizes in ([300], [46, 45, 47, 0, 500, 3], [5]):
        texts = [rng.permutation(10_000)[:n].astype(np.uint64) for n in sizes]
        h, starts = np.concatenate(texts), np.cumsum([0, *sizes])
        valid = np.concatenate([np.arange(n) <= n - 46 for n in sizes])
        value, low, c, high = substring_dedup.compact_windows(h, valid)
        want = {(s + x, s + y, s + z) for s, t in zip(starts, texts, strict=False) for x, y, z in tree_windows(t, 46)}
        assert set(zip(low.tolist(), c.tolist(), high.tolist(), strict=True)) == want and (h[c] == value).all()
    for h in (np.zeros(20_000, np.uint64), rng.integers(0, 9, 5000).astype(np.uint64)):  # every run lies in one window, which has its minimum
        value, low, c, high = substring_dedup.compact_windows(h, np.arange(len(h)) <= len(h) - 46)
        runs = [(a, v) for v, x, y in zip(value, low, high, strict=True) for a in range(x, y - 44)]
        assert [a for a, _ in sorted(runs)] == list(range(len(h) - 45)) and all(h[a : a + 46].min() == v for a, v in runs) and len(c) < len(h) / 10
        assert (c - low).max() <= 45 and (high - c).max() <= 45 and (c >= low).all() and (c <= high).all()


def test_run_hashes():
    x = np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64)
    h = substring_dedup.run_hashes(np.concatenate([x, x[:100], x[50:140]]))
    assert len(h) == 345 and (h[200:255] == h[:55]).all() and (h[300:345] == h[50:95]).all() and len(np.unique(h)) == 345 - 55 - 45
    assert len(substring_dedup.run_hashes(x[:45])) == 0


@pytest.mark.parametrize("seed", range(2))
def test_no_verbatim_passage_is_lost(spark, seed):
    """Brute force over all runs of 50 words, where 30 earlier documents share a line of 46 words that later passages hold."""
    r = random.Random(seed)
    word = lambda: f"q{r.randrange(10**5)}"
    some = lambda n: [word() for _ in range(n)]
    line, texts = some(46), []
    for _ in range(30):
        texts.append(some(r.randint(0, 90)) + line + some(r.randint(0, 90)))
    for _ in range(12):
        passage = some(10) + line + some(10)
        texts += [some(r.randint(0, 60)) + passage + some(r.randint(0, 60)) for _ in range(2)]
    for _ in range(20):
        passage = some(r.randint(50, 80))
        texts += [some(r.randint(0, 60)) + passage + some(r.randint(0, 60)) for _ in range(r.randint(1, 3))]
    texts += [["no"] * 80 + some(5), some(7) + ["no"] * 60, ["la", "lo"] * 40 + some(3), some(2) + ["lo", "la"] * 30]
    runs = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            runs.setdefault(tuple(t[p : p + 50]), set()).add((i, p))
    links, words = [], {i: set() for i in range(len(texts))}
    for places in runs.values():
        owners = {i for i, _ in places}
        if len(owners) > 1:
            links += [(min(owners), i) for i in owners]
            for i, p in places:
                words[i] |= set(range(p, p + 50))
    want = brute_components(range(len(texts)), links)
    df = docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    edges, _ = verbatim_of(df)
    assert brute_components(range(len(texts)), edges) == want
    _, spans = verbatim_of(df)
    got = {i: set() for i in words}
    for i, start, end in spans:
        got[i] |= set(range(start, end))
    assert all(words[i] <= got[i] for i in words) and sum(map(len, got.values())) <= sum(map(len, words.values())) + len(texts)
    report = {r["doc_id"]: r for r in substring_dedup.report(df).collect()}
    assert all(report[i]["repeated_words"] >= len(words[i]) for i in words)
    classes = brute_components(range(len(texts)), [(i, report[i]["class_id"]) for i in words])
    assert all(classes[i] == classes[want[i]] for i in words)


def verbatim_of(df):
    single = substring_dedup._raw(df)
    met = substring_dedup.written(substring_dedup.together(single.mapInPandas(substring_dedup._windows, substring_dedup.WINDOWS), "key"), "met")
    edges, spans = substring_dedup.verbatim(single, met, substring_dedup.written(substring_dedup.grouped(met), "groups"))
    return [(r["a"], r["b"]) for r in edges.collect()], [(r["doc_id"], r["start"], r["end"]) for r in spans.collect()]


def test_recall_of_near_passages(spark):
    """Passages of 50 to 90 words with a word changed, put in or left out every 45 to 50 words, in pairs and larger groups, half of
    them around a line of 22 words that 40 documents share. Of the links that brute force finds, 95 of 100 are found."""
    r = random.Random(7)
    word = lambda: f"q{r.randrange(10**6)}"
    some = lambda n: [word() for _ in range(n)]
    line = some(22)
    texts = [some(60) + line + some(60) for _ in range(40)]
    for k in range(150):
        n = r.randint(50, 90)
        passage = some(n) if k % 2 else (some(n)[: n // 2 - 12] + line + some(n))[:n]
        for copy in range(r.choice([2, 2, 2, 5])):
            w, at = list(passage), r.randint(20, 30)
            while copy and at < len(w):
                w[at : at + 1] = [[word()], [w[at], word()], []][r.randrange(3)]
                at += r.randint(45, 50)
            texts.append(some(r.randint(0, 50)) + w + some(r.randint(0, 50)))
    sets = [substring_dedup.batch_shingles([" ".join(t).encode()])[0].tolist() for t in texts]
    seeds = {}
    for i, s in enumerate(sets):
        for p in range(len(s) - 19):
            seeds.setdefault(tuple(s[p : p + 20]), set()).add(i)
    pairs = {(a, b) for owners in seeds.values() for a in owners for b in owners if a < b}
    assert len(pairs) > 150
    links = [(a, b) for a, b in pairs if brute_windows(sets[a], sets[b])]
    want = brute_components(range(len(texts)), links)
    got = {r["doc_id"]: r["class_id"] for r in substring_dedup.report(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 130 and sum(got[i] == got[want[i]] for i in linked) >= 0.95 * len(linked)
    assert all(want[i] == want[got[i]] for i in got)


def test_substring_dedup_finds_shared_passages(spark, corpus):
    df, texts = corpus
    got = {r["doc_id"]: r for r in substring_dedup.report(df).collect()}
    assert len(got) == len(texts)
    for k in range(6):
        assert got[300 + k]["class_id"] == 300 and got[300 + k]["repeated_words"] >= 66
    for i in [i for i, _ in ODD] + list(range(400, 410)):
        assert got[i]["class_id"] == i and got[i]["repeated_words"] == 0
    for g in range(6):
        assert {got[10 * g + k]["class_id"] for k in range(8) if k % 4 < 2} == {10 * g}  # none or one word changed
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.cut_repeats(df).collect()}
    assert cut[300] == texts[300] and cut[907] == texts[907] and cut[900] is None
    for k in range(1, 6):
        left = cut[300 + k].split()
        assert 130 <= len(left) <= 150 and left[:55] == texts[300 + k].split()[:55]
    assert cut[203] == ""


def test_long_texts_in_substring_dedup(spark):
    """A text of 60,000 words, of which a late part stands in another document."""
    long = prose(1, 60_000).split()
    got = {r["doc_id"]: r for r in substring_dedup.report(docs(spark, [(1, " ".join(long)), (2, " ".join([*prose(2, 30).split(), *long[55_000:55_100]])), (2, None)])).collect() if r["n_words"]}
    assert got[2]["class_id"] == 1 and 100 <= got[2]["repeated_words"] <= 101 and 100 <= got[1]["repeated_words"] <= 101


def test_substring_dedup_when_the_first_has_only_the_phrase(spark):
    """Every shingle of a passage stands alone in a document of smaller id, so no min-hash value's first window has the passage."""
    passage = prose(7, 60).split()
    rows = [(k, f"{prose(100 + k, 70)} {' '.join(passage[k : k + 5])} {prose(200 + k, 70)}") for k in range(56)]
    edited_one = passage[:30] + ["changed"] + passage[31:]
    whole = [(500 + k, f"{prose(300 + k, 60)} {' '.join(edited_one if k == 3 else passage)} {prose(400 + k, 60)}") for k in range(4)]
    got = {r["doc_id"]: r for r in substring_dedup.report(docs(spark, rows + whole)).collect()}
    assert all(got[i]["class_id"] == i and got[i]["repeated_words"] == 0 for i, _ in rows)
    assert all(got[i]["class_id"] == 500 and 60 <= got[i]["repeated_words"] <= 62 for i, _ in whole)


def brute_windows(x, y):
    """The shingles of x that some shingle of y equals, of all windows of 50 words of x that are similar to one of y."""
    known, out = set(y), set()
    sides = [frozenset(y[j : j + 46]) for j in range(len(y) - 45)]
    for i in range(len(x) - 45):
        mine = frozenset(x[i : i + 46])
        if any(10 * len(mine & s) >= 8 * len(mine | s) for s in sides):
            out |= {k for k in range(i, i + 46) if x[k] in known}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_passages_inside_loosely_matching_stretches(seed):
    """One word changed in 20 throughout, but for three stretches with one change, insertion or omission in the middle."""
    r = random.Random(seed)
    base = [f"v{r.randrange(10**6)}" for _ in range(420)]
    calm = [(60, 60 + r.randint(50, 70)), (190, 190 + r.randint(50, 70)), (330, 330 + r.randint(50, 70))]
    other = []
    for i, w in enumerate(base):
        inside = next(((a, b) for a, b in calm if a <= i < b), None)
        if inside and i == (inside[0] + inside[1]) // 2:
            other += [[f"x{i}"], [w, f"x{i}"], []][r.randrange(3)]
        elif not inside and r.random() < 0.08 or inside and i in (inside[0], inside[1] - 1):
            other.append(f"x{i}")
        else:
            other.append(w)
    x, y = (substring_dedup.batch_shingles([" ".join(w).encode()])[0] for w in (base, other))
    got = {k for a, b, _, _ in substring_dedup.passages(x, y, 0) for k in range(a, b)}
    want = brute_windows(x.tolist(), y.tolist())
    assert want and want == {k for k in got if x[k] in set(y.tolist())}


def test_without_keeps_what_is_between():
    assert substring_dedup.without("a b  c\nd e", [{"start": 1, "end": 3}]) == "a\nd e"
    assert substring_dedup.without("a b", [{"start": 0, "end": 9}]) == ""


def test_token_counts_match_the_tokenizer():
    from tokenizers import Tokenizer, models

    r = random.Random(5)
    special = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", -2.0) for b in range(256)]
    pieces = [("▁", -3.0), ("▁▁", -4.0)]
    seen = {p for p, _ in pieces}
    for _ in range(150):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
        p = ("▁" if r.random() < 0.4 else "") + p
        if p not in seen:
            seen.add(p)
            pieces.append((p, -float(r.randint(1, 4))))
    texts = ["", " ", "  a", "é\n\nb", "▁a"] + ["".join(r.choice("abc  é\n▁日") for _ in range(r.randint(0, 40))) for _ in range(500)]
    for bytes_too in (True, False):
        whole = Tokenizer(models.Unigram([*(special if bytes_too else special[:1]), *pieces], unk_id=0, byte_fallback=bytes_too))
        count = token_counts.Counter(pieces, bytes_too)
        for t in texts:
            want = len(whole.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
            assert count.text(t) == want, (t, bytes_too)


def test_token_counts_of_a_table(spark, tmp_path):
    """The query's column over its own vocabulary against the unigram tokenizer with the same pieces and scores, and from its file."""
    import public_tokenizers
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, whole = token_counts.vocabulary(path)
    assert whole and abs(sum(np.exp(s) for _, s in pieces) - 1) < 1e-9 and not any(p.startswith("<0x") for p, _ in pieces)
    least = min(s for _, s in pieces)
    tokenizer = Tokenizer(models.Unigram([("<unk>", least), *((f"<0x{b:02X}>", least) for b in range(256)), *pieces], unk_id=0, byte_fallback=True))
    r = random.Random(8)
    texts = [(i, t) for i, t in ODD] + [(i, " ".join("".join(r.choice("etaoinshrdluéß") for _ in range(r.randint(1, 12))) for _ in range(80))) for i in range(40)]
    texts += [(50, "The  quick brown fox,\n\njumps over; 12.5% of <s> and\tlazy dogs ☃"), (51, " ".join(r.choice(["house", "of", "cards"]) for _ in range(30_000))), (50, None), (None, "twice")]
    df = docs(spark, texts).withColumn("n_tokens", F.lit("clash"))
    want = Counter((i, len(tokenizer.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for i, t in texts)
    tokenizer.save(str(tmp_path / "unigram.json"))
    for file in (path, str(tmp_path / "unigram.json")):
        assert Counter(map(tuple, df.select("doc_id", token_counts.count_column(F.col("text"), file).alias("n")).collect())) == want
    assert docs(spark, []).select(token_counts.count_column(F.col("text"), path)).collect() == []
    with pytest.raises(ValueError, match="no unigram"):
        token_counts.vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_maximal_passages_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        scores = [r.choice([-2, -1, -0.5, 1, 2, 3]) for _ in range(r.randint(1, 14))]

        def best(lo, hi, scores=scores):
            if lo >= hi:
                return []
            top = max(((sum(scores[a:b]), -(b - a), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), key=lambda x: x[:3])
            if top[0] <= 0:
                return []
            a, b = -top[2], top[3]
            return [*best(lo, a, scores), (top[0], a, b), *best(b, hi, scores)]

        want = best(0, len(scores))
        got = toxicity.passages([(i, i + 1, s) for i, s in enumerate(scores)])
        assert sorted(x[0] for x in got) == sorted(x[0] for x in want)
        exact = np.array(scores) + np.array([r.random() / 1000 for _ in scores])  # no ties: places are certain
        want = best(0, len(exact), exact.tolist())
        assert [x[1:] for x in sorted(want, key=lambda x: x[1])] == [x[1:] for x in toxicity.all_passages(exact)]
        assert toxicity.best_passage(exact)[1:] == (max(want)[1:] if want else (0, 0))
    assert toxicity.best_passage(np.array([-1.0, 2, -2, 2, 1, -1, 1])) == (3.0, 3, 5) and toxicity.best_passage(np.zeros(3)) == (0.0, 0, 0)


def test_decay_is_the_root_of_the_score_equation():
    p1, p0 = np.array([0.2, 0.3, 0.5]), np.array([0.05, 0.35, 0.6])
    assert abs(toxicity.decay(np.log(p1 / p0), p0) - 1) < 1e-6  # exact log-odds
    assert abs(toxicity.decay(np.array([1.0, -1.0]), np.array([0.2, 0.8])) - np.log(4)) < 1e-6
    assert toxicity.decay(np.array([1.0]), np.array([1.0])) == toxicity.decay(np.zeros(0), np.zeros(0)) == 1.0


def test_toxicity_scores_against_a_plain_count(spark):
    """Weights, best passage and score of every text, from counts by hand."""
    r = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        w = [r.choice(WORDS[:60]) for _ in range(r.randint(5, 60))]
        if i % 4 == 0:
            at = r.randrange(len(w))
            w[at:at] = [r.choice(["Vile,", "nasty", "vileness"]) for _ in range(3)]
        else:
            w += ["gentle"] * 3
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    df, lab = docs(spark, rows + ODD), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(df, lab)
    mine = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    tokens = {i: [w.decode() for w in (t or "").encode().translate(toxicity.TOKENS).split()] for i, t in rows + ODD}
    t, d = [Counter(), Counter()], [Counter(), Counter()]
    for i, y in mine:
        t[y].update(f for w in tokens[i] for f in toxicity.features_of(w))
        d[y].update(f for w in set(tokens[i]) for f in toxicity.features_of(w))
    n, m = [sum(len(tokens[i]) for i, y in mine if y == k) for k in (0, 1)], [sum(y == k for _, y in mine) for k in (0, 1)]

    def odds(y, n, pseudo):
        prior = pseudo * sum(y) / sum(n)
        a, b = (np.log((y[k] + prior) / max(n[k] + pseudo - y[k] - prior, 1.0)) for k in (1, 0))
        return a - b, (a - b) / np.sqrt(1 / (y[1] + prior) + 1 / (y[0] + prior))

    want = {}
    for f in t[0] | t[1]:
        x, z = odds([t[0][f], t[1][f]], n, 1000.0)[0], odds([d[0][f], d[1][f]], m, 0.1 * sum(m))[1]
        if abs(z) >= 3 and x * z > 0:
            want[f] = x
    best = lambda w: max((want[f] for f in toxicity.features_of(w) if f in want), default=None)
    rest = [sum(best(w) is None for i, y in mine if y == k for w in tokens[i]) for k in (0, 1)]
    share = [(rest[k] + 1000.0 * sum(rest) / sum(n)) / (n[k] + 1000.0) for k in (0, 1)]
    other = min(np.log(share[1] / share[0]), -0.01)
    assert abs(model["scores"].other - other) < 1e-9
    assert model["scores"].weights.keys() == want.keys() and all(abs(model["scores"].weights[f] - want[f]) < 1e-9 for f in want)
    assert any(x < 0 for x in want.values()) and want["vile*"] > 0
    out = df.select("doc_id", toxicity.score_column(spark, F.col("text"), model).alias("t")).select("doc_id", "t.*").collect()
    for row in out:
        s = [other if best(w) is None else best(w) for w in tokens[row["doc_id"]]]
        top = max([(sum(s[a:b]), -b, a) for b in range(len(s) + 1) for a in range(b)] if len(s) < 100 else [(0.0, 0, 0)], default=(0.0, 0, 0))
        if top[0] > 1e-9:
            assert abs(sum(s[row["start"] : row["end"]]) - top[0]) < 1e-9 and row["end"] == -top[1]
        else:
            assert row["start"] is None and row["end"] is None and row["passages"] == 0


def test_toxicity_of_odd_tables(spark):
    rows = [(i, prose(i, 40) + (" vileword vileword" if i % 3 == 0 else "")) for i in range(90)]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    long = " ".join(prose(k, 20_000) for k in range(3)) + " vileword" * 30
    df = docs(spark, [*rows, (1, rows[1][1]), (None, rows[3][1]), (500, long), (501, None)])
    model = toxicity.learn(df, lab)
    got = df.select("doc_id", toxicity.score_column(spark, F.col("text"), model).alias("t")).select("doc_id", "t.*").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert len(got) == 94 and by[1][0] == by[1][1] and by[None] == by[3] and by[501][0][0] < 0.5
    assert by[500][0][0] >= 0.5 and by[500][0][2] == 60_000 and by[500][0][3] == 60_030
    assert toxicity.keep_clean(docs(spark, []), lab).collect() == []


def test_toxicity_learns_and_keeps_clean(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(WORDS) for _ in range(r.randint(20, 80))]
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["vileword", "Nastyterm,"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    df, lab = docs(spark, rows + ODD), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(df, lab)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", toxicity.score_column(spark, F.col("text"), model)["score"].alias("s")).collect()}
    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) > 40 and all((got[i] >= 0.5) == (i % 5 == 0) for i in out)
    assert all(0 <= got[i] < 0.5 for i, _ in ODD)
    assert {r["doc_id"] for r in toxicity.keep_clean(df, lab).collect()} == {i for i in got if got[i] < 0.5}
    none = toxicity.learn(df, lab.limit(0))
    assert df.select(toxicity.score_column(spark, F.col("text"), none)["score"].alias("s")).distinct().collect()[0]["s"] == 0.0


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 37 + 1)) for i in range(3000)]
    df = docs(spark, rows, ["a", "a", "a", "a", "a", "a", "b", "c", None])
    got = mixing.mix(df).collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    total = sum(r["size"] for r in got)
    assert abs(sum(t for _, t in by) - total) < 1e-6 * total
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 37
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect())) == sorted(map(tuple, got))
    times = Counter(r["doc_id"] for r in mixing.mixed_documents(df).collect())
    assert times == Counter({r["doc_id"]: r["times"] for r in got if r["times"]})


def test_mix_tells_rows_without_id_and_of_one_id_apart(spark):
    """Of 100 rows of 10 words each source's share comes within a document of its target."""
    rows = [(None if i < 100 else 7, f"w{i} " * 10) for i in range(200)]
    df = docs(spark, rows, ["a"] * 100 + ["b"] * 100)
    got = mixing.mix(df).collect()
    sums = Counter()
    for r in got:
        sums[r["target"]] += r["taken"]
    assert len(sums) == 2 and all(abs(t - s) <= 10 for t, s in sums.items())
    assert sum(r["times"] for r in got) == mixing.mixed_documents(df).count()


def test_packing_is_gapless_and_exact(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = dict(ODD + [(i, prose(i, random.Random(i).randint(1, 900))) for i in range(60)] + [(99, prose(99, 9000)), (98, "it's İ, x́ don't! a,b 12%")])
    pieces = packing.pack_documents(docs(spark, list(texts.items())), path, per_group=25).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096


def test_packing_of_repeated_rows_null_ids_and_no_rows(spark):
    import public_tokenizers

    path, t = public_tokenizers.path("word_bpe_49k.json"), prose(4, 700)
    rows = packing.pack_documents(docs(spark, [(5, t), (5, t), (None, t), (6, None), (7, "x")]), path).collect()
    whole = sum(p["length"] for p in rows if p["doc_id"] == 5)
    assert whole == 2 * next(p["doc_tokens"] for p in rows if p["doc_id"] == 5) == 2 * sum(p["length"] for p in rows if p["doc_id"] is None)
    assert sorted(p["doc_tokens"] for p in rows if p["doc_id"] in (6, 7)) == [1, 2]
    assert packing.pack_documents(docs(spark, []), path).collect() == []


def test_word_ids_are_the_tokenizer_s(monkeypatch):
    """Words of all kinds, with a table so small that it starts anew again and again, and with the short way switched off."""
    import public_tokenizers

    r = random.Random(3)
    letters = "abcXYZ éßÇñ日 \u0130\u00a0,.!?'-$%<|>1234\n"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))).encode() for _ in range(600)] + [None, b"", "don't THE'S <|endoftext|> a\u0301b".encode(), b"z" * 3000]
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    assert ids.direct
    for direct in (True, False):
        ids.direct = direct
        got = [x for k in range(0, len(texts), 50) for x in ids.texts(texts[k : k + 50])]
        for t, g in zip(texts, got, strict=True):
            assert np.frombuffer(g, "<u4").tolist() == [*ids.tokenizer.encode((t or b"").decode(), add_special_tokens=False).ids, 2], t
        ids.clear()


def test_first_fit_decreasing_against_a_plain_loop():
    r = random.Random(3)
    for _ in range(50):
        sizes, room = [r.randint(1, 50) for _ in range(r.randint(0, 60))], 50
        free, bins = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
            if k is None:
                k = len(free)
                free.append(room)
                bins.append([])
            free[k] -= sizes[i]
            bins[k].append(i)
        assert packing.first_fit_decreasing(sizes, room) == bins


def test_quality_base_figures(spark):
    texts = dict(ODD + [(1, "a b c d e f a b c d e f g"), (2, "x y\nx y\n \nx y"), (3, prose(1, 60)), (4, "spam spam spam spam spam spam spam " + prose(2, 20))])
    for r in quality_divergence.judge(docs(spark, list(texts.items()))).collect():
        w = words_of(texts[r["doc_id"]])
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = Counter(windows)
        covered = {j for i, x in enumerate(windows) if c[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in (texts[r["doc_id"]] or "").split("\n") if words_of(x)]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_divergence_finds_another_distribution(spark):
    rows = [(i, prose(i, 100)) for i in range(60)] + [(100, " ".join("#%$&*" for _ in range(100)) + " " + prose(1, 20))]
    got = {r["doc_id"]: r for r in quality_divergence.judge(docs(spark, rows)).collect()}
    assert got[100]["class_distance"] > 0.3 and not got[100]["kept"]
    assert all(got[i]["kept"] for i in range(60))


def test_url_rules_and_reputation(spark):
    urls = ["http://WWW.Example.com/en/a?x", "https://a.example.com/en/", "http://x.net/es/1", "http://x.net/de", "http://a.com", "no scheme", None, "http://notexample.com/en/", "x://h.org#f", "http://B.bad.org/q"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)] + [(100 + k, "http://b.bad.org/p", "h", "c") for k in range(60)] + [(200 + k, "http://ok.org/", "h", "c") for k in range(60)], "page_id long, url string, host string, n string")
    outcomes = spark.createDataFrame([(100 + k, 1.0) for k in range(60)] + [(200 + k, 0.0) for k in range(60)], "page_id long, bad double")
    got = {r["page_id"]: r for r in url_reputation.judge(pages, outcomes).collect()}
    assert [got[i]["host"] for i in range(10)] == ["www.example.com", "a.example.com", "x.net", "x.net", "a.com", "", "", "notexample.com", "h.org", "b.bad.org"]
    assert [got[i]["path"] for i in range(10)] == ["/en/a", "/en/", "/es/1", "/de", "", "", "", "/en/", "", "/q"]
    assert [got[i]["rule"] for i in range(10)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, "com/", None, None]
    assert [got[i]["verdict"] for i in range(10)] == ["allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
    assert got[200]["verdict"] == "allow"
    assert url_reputation.judge(pages.limit(0), outcomes).collect() == []
    assert {r["verdict"] for r in url_reputation.judge(pages, outcomes.limit(0)).where(F.col("rule").isNull()).collect()} == {"allow"}


def test_hosts_are_blocked_by_reputation_alone(spark):
    """One bad page blocks a host of a bad domain but none of a good one, where without the shrinkage both would be blocked alike."""
    hosts = {"many.bad.org": (40, 40), "few.bad.org": (1, 1), "mixed.bad.org": (20, 40), "few.good.com": (1, 1), "many.good.com": (0, 60), "none.bad.org": (0, 0)}
    pages, outcomes, n = [], [], 0
    for host, (bad, seen) in hosts.items():
        for k in range(seen or 1):
            pages.append((n, f"http://{host}/p{k}"))
            outcomes += [(n, 1.0 if k < bad else 0.0)] if seen else []
            n += 1
    df = url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad double"), {})
    got = {r["host"]: r for r in df.collect()}
    assert {h for h, r in got.items() if r["verdict"] == "block"} == {"many.bad.org", "few.bad.org"}
    assert got["few.good.com"]["host_rate"] < 0.6 < got["many.bad.org"]["host_lower"] < got["many.bad.org"]["host_rate"] < 1
    assert got["few.good.com"]["host_rate"] < got["few.bad.org"]["host_rate"] and got["none.bad.org"]["host_rate"] > 0.4 and all(2.0 <= r["host_strength"] <= 1000 for r in got.values())


def test_registered_domains(spark):
    hosts = {
        "a.b.example.com": ("example.com", "com"), "news.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "me.github.io": ("me.github.io", "github.io"), "10.0.0.7": ("10.0.0.7", "#"), "10.0.0.7:80": ("10.0.0.7", "#"),
        "[::1]:8080": ("[::1]", "#"), "www.example.com:443": ("example.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_reputation.domain_columns(df["host"])
    assert {r[0]: (r[1], r[2]) for r in df.select("host", domain, suffix).collect()} == hosts
    # The bad outcomes of one stranger under co.uk leave another one alone, while its own hosts follow it.
    rows = [(f"s{k}.bad.co.uk", 40, 39.0) for k in range(3)] + [("new.bad.co.uk", 0, 0.0)] + [(f"s{k}.good{k}.co.uk", 40, 0.0) for k in range(5)] + [("thin.other.co.uk", 1, 1.0)]
    out = {r["host"]: r for r in url_reputation.reputations(spark.createDataFrame(rows, "host string, n long, bad double")).collect()}
    assert out["s0.bad.co.uk"]["blocked"] and not out["s1.good1.co.uk"]["blocked"] and not out["thin.other.co.uk"]["blocked"]
    assert out["new.bad.co.uk"]["rate"] > 0.5 > out["s1.good1.co.uk"]["rate"]


def test_warc_round_trip(spark):
    big = "é<p>\r\n\r\n" * 20_000
    rows = [(1, "http://a/", "x"), (2, "http://b/\r\nEvil: 1", "x"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "y"), (7, "u", "y"), (None, "u", "x"), (None, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.new_path(spark, "warc")
    warc.write_archives(pages, path, segment=1000, records=7)
    records = warc.read_records(spark, path)
    assert records.where(F.col("kind") == "continuation").count() > 100
    got = warc.reassemble(records).collect()
    assert len(got) == len(rows) and all(r["complete"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert [by[i][0]["record_type"] for i in (1, 2, 3, 4, 5, 6)] == ["response", "revisit", "response", "revisit", "response", "revisit"]
    assert by[2][0]["refers_to"] == 1 and by[6][0]["payload_bytes"] == len(big.encode()) and bytes(by[5][0]["payload"]).decode() == big
    assert len(by[7]) == 2 and {r["record_type"] for r in by[7]} == {"response"}
    assert sorted(r["record_type"] for r in by[None]) == ["response", "revisit"]
    assert by[1][0]["payload_digest"] == warc.digest(b"x")


def test_warc_segments_that_do_not_fit():
    first = {"kind": "response", "segment": 1, "block": b"HTTP/1.1 200 OK\r\n\r\nab", "total": None, "page_id": 1, "digest": None}
    last = {"kind": "continuation", "segment": 2, "block": b"cd", "total": 23, "page_id": None, "digest": None}
    assert warc.join_segments([last, first])[0][-1] == b"abcd"
    assert warc.join_segments([first, last | {"total": 99}])[0][5] is False
    assert warc.join_segments([first, last | {"segment": 3}])[0][5] is False
    assert warc.join_segments([first])[0][5] is False
    for payload in (b"", b"x", b"y" * 20_001):
        assert warc.dechunked(warc.chunked(payload)) == payload
    assert warc.dechunked(b"5\r\nab") is None and warc.dechunked(b"zz\r\n") is None


def brute_top_k(rows, every=50):
    """(query_id, rank, vec_id, score) of every query row against all rows but its own."""
    ints = [(i, [int(np.floor(256 * x)) if abs(256 * x) < 2**53 else int(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, x) in enumerate(ints):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for k, (i, v) in enumerate(ints) if k != at and len(v) == len(x))
            out += [(q, k, i, -s if -(2**63) <= -s < 2**63 else None) for k, (s, i) in enumerate(scores[:5], 1)]
    return Counter(out)


def vectors_of(spark, rows):
    df = spark.createDataFrame([(i, v, -1, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, own long, place string, length double")
    return df.withColumn("v", topk.quantised(F.col("embedding")))


@pytest.mark.parametrize("block", [None, 40])
def test_top_k_is_exact(spark, monkeypatch, block):
    """Ties, repeated rows of queries and candidates, null, short and odd vectors, columns of clashing names; small blocks."""
    if block:
        monkeypatch.setattr(topk, "MOST", block)
        monkeypatch.setattr(topk, "QUERIES_IN_GROUP", 4)
        monkeypatch.setattr(topk, "SEEDS", 20)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 5])]) for i in range(500)]
    rows += [(i, None) for i in (700, 750)] + [(800, [1.0, None] * 4), (850, [float("nan")] * 8), (851, [0.0] * 8), (900, []), (852, [1.0, 2.0]), (900, [0.5, 0.5])] + [(950 + i, rows[3][1]) for i in range(6)] + [(None, rows[1][1])]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (100, rows[100][1]), (7, rows[3][1]), (7, rows[3][1])]
    got = topk.top_k(vectors_of(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert Counter(map(tuple, got)) == brute_top_k(rows)


def test_top_k_beyond_64_bits(spark):
    """Scores of large vectors are exact in order, and null where 64 bits do not hold them."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.choice([0, 7, 14, 100, 200])]) for i in range(200)] + [(300, [1e14, -3e14, 1.0, 2.0]), (300, [1e14, -3e14, 1.0, 2.0])]
    got = topk.top_k(vectors_of(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert Counter(map(tuple, got)) == brute_top_k(rows) and any(r["score"] is None for r in got)


def test_top_k_of_no_rows(spark):
    df = vectors_of(spark, [])
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).collect() == []
    assert topk.top_k(vectors_of(spark, [(1, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.top_k(vectors_of(spark, [(50, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []


def test_places_are_in_the_order_of_scores():
    scores = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 2**2000, -(2**2000), 10**18]
    assert sorted(scores, key=topk.place_of) == sorted(scores)


def test_substring_dedup_of_repeated_ids_keeps_unique_text(spark):
    """Spans of one text of an id are not cut out of another text of it, and a copy does not hide another text of its id."""
    p, c, unique, other = prose(1, 80), prose(2, 100), prose(3, 120), prose(4, 160)
    rows = [(1, f"{prose(5, 40)} {p}"), (5, p), (5, unique), (2, c), (6, c), (6, other), (6, other)]
    df = docs(spark, rows)
    cut = Counter((r["doc_id"], r["text"]) for r in substring_dedup.cut_repeats(df).collect())
    assert cut == Counter([rows[0], (5, ""), (5, unique), (2, c), (6, ""), (6, other), (6, other)])
    got = Counter((r["doc_id"], r["class_id"], r["repeated_words"]) for r in substring_dedup.report(df).collect())
    assert got == Counter([(1, 1, 80), (5, 1, 80), (5, 5, 0), (2, 2, 100), (6, 2, 100), (6, 6, 0), (6, 6, 0)])
    assert substring_dedup.cut_repeats(df).columns == df.columns
    # A passage that two texts of one id share is one that two documents have.
    both = docs(spark, [(7, f"{prose(6, 60)} {p}"), (7, f"{p} {prose(7, 60)}")])
    left = [len(r["text"].split()) for r in substring_dedup.cut_repeats(both).collect()]
    assert sorted(left) == [60, 140] and {(r["class_id"], r["repeated_words"]) for r in substring_dedup.report(both).collect()} == {(7, 80)}


def test_substring_dedup_of_rows_without_id(spark):
    """They come last and name no class, but take part."""
    p = prose(1, 80)
    texts = [(2, f"{prose(2, 30)} {p}"), (6, f"{prose(3, 40)} {p}"), (7, f"{p} {prose(4, 50)}"), (None, f"{prose(5, 60)} {p}"), (None, prose(6, 90))]
    df = docs(spark, texts)
    got = Counter((r["doc_id"], r["class_id"], r["repeated_words"]) for r in substring_dedup.report(df).collect())
    assert got == Counter([(2, 2, 80), (6, 2, 80), (7, 2, 80), (None, 2, 80), (None, None, 0)])
    cut = {(r["doc_id"], len(r["text"].split())) for r in substring_dedup.cut_repeats(df).collect()}
    assert cut == {(2, 110), (6, 40), (7, 50), (None, 60), (None, 90)}
    none = docs(spark, [(None, f"{prose(2, 30)} {p}"), (None, f"{p} {prose(3, 30)}")])
    assert {(r["class_id"], r["repeated_words"]) for r in substring_dedup.report(none).collect()} == {(None, 80)}
    assert sorted(len(r["text"].split()) for r in substring_dedup.cut_repeats(none).collect()) == [30, 110]


def test_word_table_grows():
    table = wordtable.WordTable()
    h = np.unique(np.random.default_rng(0).integers(1, 2**63, 5_000_000).astype(np.uint64))
    half = len(h) // 2
    assert (table.add(h[:half]) == np.arange(half)).all() and (table.find(h[half : half + 1000]) == -1).all()
    table.add(h[half:])
    assert table.size == len(h) > 4_500_000 and (table.find(h[::97]) == np.arange(len(h))[::97]).all() and 2 * table.size <= len(table.keys)


def test_scan_of_many_scattered_runs_is_linear():
    began = time.perf_counter()
    runs = [(k, k + 1, 1.0 if k % 2 == 0 else -1.5) for k in range(400_000)]
    assert len(toxicity.passages(runs)) == 200_000
    rising = [(k, k + 1, 2.0 if k % 2 == 0 else -1.0) for k in range(400_000)]
    assert toxicity.passages(rising) == [(200_001.0, 0, 399_999)]
    assert time.perf_counter() - began < 5


def test_every_pair_of_windows_of_a_group_may_link(spark):
    """Pairs of documents that share a passage of 52 words with one word changed in its midst; 24 documents of smaller id have the words
    before that one, 24 those behind it, so all the pair's groups have their pivots elsewhere. All links of windows of one group are
    found."""
    r = random.Random(3)
    some = lambda n: [f"q{r.randrange(10**6)}" for _ in range(n)]
    halves = [(some(26), some(25)) for _ in range(6)]
    texts = [some(40) + half + some(40) for both in halves for half in both for _ in range(24)]
    rivals = len(texts)
    texts += [some(30) + a + some(1) + b + some(30) for a, b in halves for _ in range(2)]
    df = docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    met = substring_dedup.written(substring_dedup.together(substring_dedup._raw(df).mapInPandas(substring_dedup._windows, substring_dedup.WINDOWS), "key"), "met")
    sets = [substring_dedup.batch_shingles([" ".join(t).encode()])[0].tolist() for t in texts]
    by_group = {}
    for g in substring_dedup.grouped(met).collect():
        by_group.setdefault(g["group"], []).append(g)
    links = set()
    for rows in by_group.values():
        for x in rows:
            for y in rows:
                low, high, d = max(x["low"], y["low"] + x["c"] - y["c"]), min(x["high"], y["high"] + x["c"] - y["c"]), x["c"] - y["c"]
                for i in range(max(low, x["c"] - 45), min(high - 45, x["c"]) + 1) if x["doc_id"] > y["doc_id"] else []:
                    p, q = set(sets[x["doc_id"]][i : i + 46]), set(sets[y["doc_id"]][i - d : i - d + 46])
                    if 5 * len(p & q) >= 4 * len(p | q):
                        links.add((x["doc_id"], y["doc_id"]))
    assert len(links) > 3
    got = {row["doc_id"]: row["class_id"] for row in substring_dedup.report(df).collect()}
    assert [(a, b) for a, b in links if got[a] != got[b]] == []
    assert all(got[i] == i for i in range(rivals))


def test_windows_around_a_common_line_do_not_all_meet(spark, monkeypatch):
    """Of 150 texts that share a line of 36 words and nothing else, two hold it in a passage with one word changed: these are linked, and
    the candidate pairs are fewer than with each text meeting each other (11,175)."""
    r = random.Random(5)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    line, around = some(36), (some(4), some(15))
    texts = [some(40) + line + some(40) for _ in range(148)]
    texts += [some(30) + around[0] + line + around[1][:7] + some(1) + around[1][8:] + some(30) for _ in range(2)]
    asked, verify = [], substring_dedup.verified
    monkeypatch.setattr(substring_dedup, "verified", lambda single, pairs: asked.append(pairs.count()) or verify(single, pairs))
    got = {row["doc_id"]: row["class_id"] for row in substring_dedup.report(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == {i: min(i, 148) for i in range(150)}
    assert sum(asked) < 30 * len(texts)


@pytest.mark.parametrize("words", [4, 10**6])
def test_windows_with_similar_runs_share_a_rare_shingle(words):
    """All pairs of windows of one text and edited ones that hold similar runs of 46 around their midst, for any order of codes."""
    r = np.random.default_rng(words)
    base = r.integers(0, words, 91)
    rows, order, ends = [], {}, []
    for _ in range(60):
        x = base.copy()
        for at in r.integers(0, 91, r.integers(0, 3)):
            x[at : at + r.integers(1, 6)] = r.integers(0, words, 1)
        x[45] = base[45]
        low, high = int(r.integers(0, 46)), int(r.integers(45, 91))
        if high - low >= 45:
            rows.append(np.where((np.arange(91) >= low) & (np.arange(91) <= high), x, -1))
            ends.append((low, high))
    codes = np.array(rows, np.int64)
    order = np.where(codes < 0, 1 << 62, (codes * 2654435761 % 1009 << 32) + codes)
    low, high = np.array(ends).T
    mark = substring_dedup.rare(codes, order, low, high)
    runs = [[set(x[i : i + 46].tolist()) for i in range(a, b - 44) if i <= 45 <= i + 45] for x, a, b in zip(codes, low, high, strict=True)]
    alike = 0
    for i in range(len(codes)):
        for j in range(i):
            if any(5 * len(p & q) >= 4 * len(p | q) for p in runs[i] for q in runs[j]):
                alike += 1
                assert set(codes[i][mark[i]].tolist()) & set(codes[j][mark[j]].tolist())
    assert alike > 50
