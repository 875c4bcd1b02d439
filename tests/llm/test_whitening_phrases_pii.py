from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from panelspark.llm import phrases, pii, queries, whitening
from panelspark.llm.common import table
from pyspark.sql import functions as F


def whiten(spark, rows, components=16, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, id string, n int")
    return whitening.whiten(df.select(F.col("vec_id").alias("id"), whitening.scaled(F.col("embedding")).alias("x")), components).collect()


def slow_whitened(vectors):
    """n, deviations, eigenvalues and axes (rows) by exact sums and one eigendecomposition."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = [list(v) for v in dict.fromkeys(map(tuple, x))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    rows = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    return n, deviations, e[::-1], axes.T[::-1], rows


def test_whitening_query_against_one_eigendecomposition(spark, sf_dir):
    given = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()
    n, deviations, e, axes, rows = slow_whitened([r.embedding for r in given])
    got = queries.op11_whitening(spark, sf_dir).collect()
    assert len(got) == 16 * len(given) and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    want = rows @ axes[:16].T / np.sqrt(e[:16])
    signs = np.sign([sum(by[g.vec_id, k + 1].whitened * want[i, k] for i, g in enumerate(given)) for k in range(16)])
    for i, g in enumerate(given):
        for k in range(16):
            r = by[g.vec_id, k + 1]
            assert r.deviation == deviations[i] and abs(r.whitened * signs[k] - want[i, k]) < 1e-6
            assert abs(r.explained - e[k] / e.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening_merges_lose_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (5000, 12)) + 1_000_000
    x[:, 3] = 2 * x[:, 2] - x[:, 1]
    whole = None
    for block in np.array_split(x, [1, 3, 700, 4000]):
        made = whitening.Summary.of(block)
        whole = made if whole is None else whole.merged(made)
    assert whole.n == 5000 and whole.sums == [int(s) for s in x.sum(0)]
    e = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    assert np.allclose(whole.sigma**2 / 5000, e, rtol=1e-10, atol=1e-8)
    assert len(whitening.Whitening(whole, 16).axes) == 11  # one direction has no spread


def test_whitening_odd_rows(spark):
    good = [(i, [math.sin(i), math.cos(3 * i), i % 5 / 7.0], "x", 1) for i in range(40)]
    odd = [(50, None, "x", 1), (51, [], "x", 1), (52, [1.0, None, 2.0], "x", 1), (53, [1.0, math.nan, 2.0], "x", 1), (54, [math.inf, 1.0, 2.0], "x", 1), (55, [1.0, 2.0], "x", 1), (56, [1e30, 0.0, 0.0], "x", 1)]
    again = [(None, good[3][1], "y", 2), (3, good[3][1], "y", 2)] * 30  # copies don't change the fit
    plain, got = whiten(spark, good), whiten(spark, good + odd + again)
    assert len(plain) == 120 and len(got) == 120 + 180 and {r.n for r in got} == {40}
    key = lambda r: (r.id is None, r.id or 0, r.component)
    first = {key(r): r for r in plain}
    assert all(abs(abs(r.whitened) - abs(first[False, 3, r.component].whitened)) < 1e-9 for r in got if r.id is None)
    assert whiten(spark, []) == [] and whiten(spark, [(1, [1.0, 2.0], "", 0)] * 9) == []
    assert len(whiten(spark, good, 2)) == 80


def test_whitening_of_wide_components(spark):
    rows = [(i, [float(2**50 * (i % 7)), float(i)], "", 0) for i in range(21)]
    n, deviations, e, axes, _ = slow_whitened([r[1] for r in rows])
    got = whiten(spark, rows)
    assert {r.component for r in got} == {1} and all(r.deviation == (deviations[r.id] if deviations[r.id] < 1 << 63 else None) for r in got)


def slow_phrases(rows, most=3, least=10, percent=50, limit=2000):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        many = {p: a for p, a in c.items() if " " in p and a >= least}
        for p, a in many.items():
            w = p.split(" ")
            cuts = [(10**6 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if not any(f" {p} " in f" {q} " and q != p and 100 * b >= percent * a for q, b in many.items()):
                found.append((-score, -a, p.encode(), c[" ".join(w[:k])], c[" ".join(w[k:])]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(1, t, lang, "x", 5, 7) for t, lang in rows], "doc_id long, text string, lang string, piece string, m int, rank int")
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


def test_phrases_against_all_counts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE_WORDS", 400)
    rows = [("New York City is big. New York\tCity! the old  new york; San José de la", "en"), ("a b a b a b a b c", None), (None, "en"), ("", None), (" \t\n.;", "fr"), ("Été É à la\x0bcarte, à la carte", "fr"), ("x y", "a b\nc")] * 12
    rows += [("a b " * 400, "und"), ("the new york city of " * 30, "en"), ("one two. " * 9, "de")]
    want = slow_phrases(rows)
    assert mined(spark, rows) == want and {r[0] for r in want} == {"en", "und", "fr", "a b\nc"}
    assert mined(spark, rows, most=4, least=5, percent=80, limit=3) == slow_phrases(rows, 4, 5, 80, 3)
    assert mined(spark, []) == []


def test_phrases_of_many_batches_and_buckets(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    want = slow_phrases([(r.text, r.lang) for r in docs.collect()])
    monkeypatch.setattr(phrases, "PIECE_WORDS", 5000)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 3000)
    got = [tuple(r) for r in queries.op12_collocations(spark, sf_dir).collect()]
    assert sorted(got) == want and len(want) > 100


def slow_base(text):
    """Spans of the base kinds by the plain patterns."""
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    d = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d(m)) <= 19 and luhn(d(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(d(m)) <= 15),
    ]
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return [s for _, _, s in sorted(found)]


ODD = [
    None, "", "plain words only", "a@b.c_d@e.f a@b.cc-x@d.e @x.y a@b a@b. a@b.c.", "é ü😀 mail: x.y+z@mail7.example.com😀 10.0.0.1", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 0000.0.0.255 1..2.3.4.5",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 41111111111111114111111111111111 5500 0000 0000 0004", "+1 (017) 555-7713 +49 30 1234567. +1234 +12345678901234567 ++1 212 555 0199 +1.2.3.4.5.6.7.8.9.0",
    "account GB82 WEST 1234 5698 7654 32 AND DE89370400440532013000 DE88370400440532013000 FR1420041010050500013M02606", "ssn 123-45-6789, code 123-45-6789 and filler filler filler filler filler 000-12-3456 social security 219-09-9999",
    "call (212) 555-0199 or (212) 555-0100 but +1 (212) 555-0199", "a" * 50000 + "@" + "b" * 50000 + "." + "c" * 10, "9" * 60000, "1 " * 30000, "x.1@m.co " * 700 + "10.1.1.1 ", "1." * 20000, "a@b" + ".c" * 20000, "+1" + "(" * 40000,
]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, s0 int")
    return {r.doc_id: r.spans for r in pii.find(df).collect()}


def test_personal_data_base_kinds_against_plain_patterns(spark, sf_dir):
    got = found(spark, ODD)
    base = {k.name for k in pii.KINDS if k.base}
    for i, text in enumerate(ODD):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in got[i] if s.kind in base] == slow_base(text), i
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for r in queries.op13_pii(spark, sf_dir).collect():
        want = slow_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in ("email:", "ip:", "card:", "phone:")]


def test_personal_data_checksums_and_context(spark):
    got = found(spark, ODD)
    of = lambda i, kind: [ODD[i][s.start : s.end] for s in got[i] if s.kind == kind]
    assert of(8, "iban") == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606"]
    assert of(9, "ssn") == ["123-45-6789", "219-09-9999"] and of(10, "local_phone") == ["(212) 555-0199"]
    score = {s.start: s.score for s in got[8] if s.kind == "iban"}
    assert max(score.values()) == 1.0 and min(score.values()) == pytest.approx(0.8)
    assert found(spark, ["my card 4111 1111 1111 1111"])[0][0].score == 1.0 and found(spark, ["4111 1111 1111 1111"])[0][0].score == pytest.approx(0.7)
    assert found(spark, []) == {}
