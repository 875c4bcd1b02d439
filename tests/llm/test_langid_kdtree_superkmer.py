from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from panelspark.llm import kdtree, langid, queries, superkmer
from panelspark.llm.common import table
from pyspark.sql import functions as F


def test_language_id_on_held_out_texts(spark, sf_dir):
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op1_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        letter = any(c.isalpha() for c in docs[r.doc_id].text or "")
        assert (r.lang_pred == "und") == (not letter)
        if r.held_out and letter:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert right >= 0.97 * total, (right, total)


def slow_slots(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + re.sub(" +", " ", letters.strip()) + " "
    mask = (1 << 64) - 1
    out = []
    for a, b, c in zip(padded, padded[1:], padded[2:]) if letters.strip() else ():
        h = (ord(a) * 0x9E3779B97F4A7C15 ^ ord(b) * 0xC2B2AE3D27D4EB4F ^ ord(c) * 0x165667B19E3779F9) & mask
        h ^= h >> 29
        h = h * 0xBF58476D1CE4E5B9 & mask
        out.append(h >> 49)
    return out


def test_trigrams_of_pieces_are_those_of_the_whole(monkeypatch):
    rng, whole = random.Random(2), langid.PIECE
    texts = ["", "a", "ab", " a ", "!!", "1a", "a1", "a" + "." * 50, "." * 50 + "a", "ÄbC ß.. x"] + ["".join(rng.choice("abc  .é1") for _ in range(rng.randrange(200))) for _ in range(60)]
    for piece in (1, 2, 3, 7, whole):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t in texts:
            slots, times = langid.trigrams(t)
            assert times is None and slots.tolist() == slow_slots(t), (piece, t)
    monkeypatch.setattr(langid, "PIECE", whole)
    slots, times = langid.trigrams("a" + "." * 3_000_000)
    assert times is None and slots.tolist() == slow_slots("a")
    long = "".join(rng.choice(["wort ", "und, ", "satz", " ... ", "É 1 "]) for _ in range(900_000))
    slots, times = langid.trigrams(long)
    assert len(long) > 3_000_000 and dict(zip(slots.tolist(), times.tolist())) == Counter(slow_slots(long))


def test_more_languages_than_full_columns(spark):
    rng = random.Random(4)
    names, rows = [f"l{i:02d}" for i in range(70)], []
    for name in names:
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(" ".join(rng.choice(words) for _ in range(60)), name) for _ in range(1 if name == "l69" else 3)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.learn(df)
    assert model.languages == names and model.p.shape == (langid.SLOTS // 2, 71)
    assert sum(langid.infer(model, t)[0] == lang for t, lang in rows) == len(rows)
    unlabelled = spark.createDataFrame([(1, "wort", None), (2, None, None), (3, "!!!", "x"), (4, "", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.accepted(unlabelled.withColumn("lang", F.lit(None).cast("string"))).collect()] == [1]


def test_trigrams_counts_and_mixture(spark):
    text = "Ab, cdé 12 ÜX abab"
    slots, times = langid.trigrams(text)
    assert times is None and slots.tolist() == slow_slots(text)
    long = "wort und satz " * 3000
    slots, times = langid.trigrams(long)
    assert dict(zip(slots.tolist(), times.tolist())) == Counter(slow_slots(long))
    rows = [("aa bb aa " * 30, "x"), ("cc dd cc " * 30, "y"), (None, "x"), ("zz", None), ("", "y"), ("aa bb aa " * 30, "x")]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = {(r.lang, r.slot): r.n for r in langid.counts(df).collect()}
    want = Counter((lang, s) for t, lang in rows if t and lang for s in slow_slots(t))
    assert got == want
    model = langid.learn(df)
    assert model.languages == ["x", "y"]
    for t in ("aa bb aa bb", "cc dd", "aa bb " * 40 + "cc dd " * 20, "aa cc dd " * 9, "qq"):
        slots = slow_slots(t)
        # the mixture of all columns by plain Python
        theta = [1 / 3] * 3
        for _ in range(4_000):
            new = [0.0] * 3
            for s in slots:
                d = sum(theta[j] * model.p[s, j] for j in range(3))
                for j in range(3):
                    new[j] += theta[j] * model.p[s, j] / d / len(slots)
            theta = new
        full, log, gap = langid.proportions(model.p[slots], None)
        best = sum(np.log(sum(theta[j] * model.p[s, j] for j in range(3))) for s in slots)
        assert gap <= langid.TOLERANCE and best - langid.TOLERANCE <= log <= best + 1e-6
    assert langid.infer(model, "aa bb " * 40 + "cc dd " * 20)[3] == ["x", "y"] and langid.infer(model, "aa bb " * 40)[3] == ["x"]
    assert 0.6 < langid.infer(model, "aa bb " * 40 + "cc dd " * 20)[1] < 0.72
    odd = spark.createDataFrame([(1, None, "x", "s", 5), (None, "12 !", None, None, 1), (1, "aa", "x", "s", 2), (1, "aa", "x", "s", 2)], "doc_id long, text string, lang string, score string, n int")
    out = langid.predict(odd, model)
    assert out.columns == ["doc_id", "text", "lang", "n", "lang_pred", "score", "other_share", "lang_set"]
    assert [r.lang_pred for r in out.collect()] == ["und", "und", "x", "x"]
    assert langid.identify(odd.limit(0)).count() == 0 and langid.accepted(odd.limit(0)).count() == 0
    assert [r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()] == ["und"] * 4


def slow_top(rows, k=5, every=50):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in fine]
    found = {}
    for q, v in fine:  # rows of one query id are ranked together
        if q % every == 0:
            found.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))
    return sorted((q, n + 1, i, -s) for q, all_of in found.items() for n, (s, i) in enumerate(sorted(all_of)[:k]))


def test_kdtree_against_all_pairs(spark, sf_dir, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    want = slow_top(rows)
    assert sorted(tuple(r) for r in queries.op2_kdtree_top_k(spark, sf_dir).collect()) == want
    for name, value in (("SHARD_ROWS", 100), ("QUERY_BLOCK", 3), ("LEAF_ROWS", 4), ("BOXES", 3), ("SPLIT_QUERIES", 2)):
        monkeypatch.setattr(kdtree, name, value)
    assert sorted(tuple(r) for r in queries.op2_kdtree_top_k(spark, sf_dir).collect()) == want


def test_kdtree_of_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(120)] + [(i, [rng.choice([-1.0, 0.0, 0.5, 3e3]) for _ in range(3)]) for i in range(120, 260)]
    rows += [(50, [-2.0, 7.0, 1e7]), (50, [1e7, -1e7, 1e7]), (701, [2.0e6, -1.0, 4.1e6])]
    rows += [(300, None), (350, [1.0, None, 2.0]), (400, [float("nan"), 0.0, 0.0]), (450, [float("inf"), 0.0, 1.0]), (500, []), (550, [1.0, 2.0]), (551, [3.0, 4.0]), (None, same), (600, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int")
    run = lambda: sorted(tuple(r) for r in kdtree.top_k(df.select("vec_id", kdtree.scaled(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0).collect())
    assert run() == slow_top(rows)
    for n in (10, 40):
        monkeypatch.setattr(kdtree, "SHARD_ROWS", n)
        monkeypatch.setattr(kdtree, "LEAF_ROWS", 3)
        assert run() == slow_top(rows)
    assert kdtree.top_k(df.limit(0).select("vec_id", kdtree.scaled(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0).count() == 0


def test_kdtree_of_wide_components_and_results(spark):
    rows = [(50, [4e9, -3.0]), (1, [3.0e4, 2.0e9]), (2, [-1e4, 1e3]), (3, [0.5, 0.25])]
    as_df = lambda rs: spark.createDataFrame(rs, "vec_id long, embedding array<double>").select("vec_id", kdtree.scaled(F.col("embedding")).alias("v"))
    run = lambda rs: sorted(tuple(r) for r in kdtree.top_k(as_df(rs), F.col("vec_id") % 50 == 0).collect())
    fine = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    best = sorted((-sum(a * b for a, b in zip(fine[50], fine[i])), i) for i in (1, 2, 3))
    assert run(rows) == [(50, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    with pytest.raises(Exception, match="64|too large|[Oo]verflow"):
        run([(50, [1e12, 1e12]), (1, [1e12, 1e12])])
    with pytest.raises(Exception, match="too large"):
        run([(50, [1e300, 1.0]), (1, [1.0, 1.0])])


def test_kdtree_returns_all_where_scores_are_very_low(spark):
    rows = [(50, [1.1796875e7]), (2, [-1.1796875e7]), (3, [1.0]), (4, [-1.1863283e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", kdtree.scaled(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in kdtree.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert [r[:3] for r in got] == [(50, 1, 3), (50, 2, 2), (50, 3, 4)]
    assert got[1][3] == -((256 * 11796875) ** 2) and got[2][3] < -(1 << 62)


def test_kdtree_sends_queries_only_where_a_box_may_serve(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 100
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.01]) for i in range(1200)]
    low = np.stack([np.floor(256 * np.array(v)) for _, v in rows if _ % 6 == 0]).astype(np.int64)
    tree = kdtree.Tree(np.arange(len(low)), low)
    q = low[:4]
    far = kdtree.best_of_boxes(-q, tree.low[:1], tree.high[:1])
    assert (far < (q * q).sum(1)[:, None]).all()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", kdtree.scaled(F.col("embedding")).alias("v"))
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for qi, v in fine:
        if qi % 50 == 0:
            want += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != qi)[:5])]
    assert sorted(tuple(r) for r in kdtree.top_k(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)


def slow_cut(rows, k=35):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in texts for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_against_all_windows(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    want = slow_cut(rows)
    assert sum(w[2] > 0 for w in want) > 5
    assert sorted((tuple(r) for r in queries.op3_substring_dedup(spark, sf_dir).collect()), key=str) == want
    monkeypatch.setattr(superkmer, "PIECE_WORDS", 700)
    monkeypatch.setattr(superkmer, "RUN_WINDOWS", 3)
    monkeypatch.setattr(superkmer, "HEAVY_IN_PIECE", 2)
    assert sorted((tuple(r) for r in queries.op3_substring_dedup(spark, sf_dir).collect()), key=str) == want


def test_substring_dedup_of_odd_rows(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}é" for i in range(12)]
    passage = " ".join(rng.choice(words) for _ in range(9))
    rows = [(i, " ".join([*(rng.choice(words) for _ in range(20)), passage, *(rng.choice(words) for _ in range(20))])) for i in range(30)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, rows[2][1]), (None, None), (None, "x"), (40, ""), (41, "a " * 500), (42, "b\x1cc " * 6), (43, " ".join(words[:5] * 9)), (2, "other words here now for it")]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, start int, text_key string")
    for k, m in ((5, 2), (7, 3), (5, 5), (1, 1)):
        for piece in (2_000_000, 90):
            monkeypatch.setattr(superkmer, "PIECE_WORDS", piece)
            monkeypatch.setattr(superkmer, "HEAVY_IN_PIECE", 2 if piece == 90 else 64)
            got = superkmer.remove_repeats(df, k, m).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
            assert sorted((tuple(r) for r in got), key=str) == slow_cut(rows, k), (k, m, piece)
    assert superkmer.remove_repeats(df.limit(0)).count() == 0


def test_equal_hashes_of_unequal_windows():
    ids = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 1, 2, 4, 9])
    at = np.arange(0, 11)
    for hashes in (np.zeros(11, np.uint64), np.array([i % 2 for i in range(11)], np.uint64)):
        twice, later = superkmer.repeated(ids, at, hashes, 3)
        seen, first = Counter(tuple(ids[i : i + 3]) for i in at), set()
        if not hashes.any():
            assert twice.tolist() == [seen[tuple(ids[i : i + 3])] > 1 for i in at]
            for i in at:
                assert later[i] == (tuple(ids[i : i + 3]) in first)
                first.add(tuple(ids[i : i + 3]))
    assert superkmer.rolled(np.arange(5, dtype=np.uint64), 7, superkmer._B1).size == 0
    h = np.arange(1, 60, dtype=np.uint64)
    b = int(superkmer._B1[0])
    for n in (1, 2, 3, 6, 35):
        want = [sum(int(h[i + j]) * pow(b, n - 1 - j, 1 << 64) for j in range(n)) % (1 << 64) for i in range(len(h) - n + 1)]
        assert superkmer.rolled(h, n, superkmer._B1).tolist() == want
        assert superkmer.sliding_min(h[::-1], n).tolist() == [min(h[::-1][i : i + n]) for i in range(len(h) - n + 1)]


def test_mixtures_of_languages_that_are_alike_end_soon():
    rng = np.random.default_rng(1)
    for apart in (0.02, 0.001):
        for n in (1000, 1_000_000):
            base = rng.random(n) + 0.1
            p = np.stack([base, base * (1 + apart * rng.standard_normal(n)).clip(0.1), np.full(n, 0.6)], 1)
            began = time.process_time()
            theta, log, gap = langid.proportions(p, None)
            assert time.process_time() - began < 5 and gap <= langid.TOLERANCE and abs(theta.sum() - 1) < 1e-9 and (theta >= 0).all()
            if n == 1000:  # plain EM, as far as it comes
                plain = np.full(3, 1 / 3)
                for _ in range(5000):
                    plain = plain * ((1 / (p @ plain)) @ p) / n
                assert log >= np.log(p @ plain).sum() - langid.TOLERANCE
    p = rng.random((3000, 80))
    p[:, 40:] = p[:, :40]  # equal columns
    times = rng.integers(1, 9, 3000)
    theta, _, gap = langid.proportions(p, times)
    assert gap <= langid.TOLERANCE and (theta >= 0).all()
