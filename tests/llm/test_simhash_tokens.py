from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from panelspark.llm import queries, simhash, tokens
from panelspark.llm.common import scratch, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DOCS = "doc_id long, text string, source string, fp int, component_id string"
ODD = [(5, "Alpha beta"), (4, "alpha\tbeta"), (None, "ALPHA beta"), (7, None), (6, ""), (6, " \n"), (None, None), (9, "one"), (9, "one"), (10, "x y z " * 20000), (8, "Éa b c d"), (3, "éa b c d")]


def slow_fingerprint(text: str | None, k: int = 3) -> int:
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(rows: list[tuple], bits: int = 2) -> list:
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, f"{f:016x}", least[find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def slow_shingles(text: str | None, k: int = 5) -> set[tuple]:
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def slow_kept(rows: list[tuple], similarity: float = 0.8) -> list:
    """Ids that keep_one leaves, by all pairs under both rules: two bits of 64, or a shared band, few bits and a true similarity."""
    fps = [slow_fingerprint(t) for _, t in rows]
    wide = [np.frombuffer(simhash.wide_fingerprint((t or "").encode(), lanes=12), "<u2") for _, t in rows]
    sets = [slow_shingles(t) for _, t in rows]
    limit = simhash.most_differing(256, similarity)

    def alike(i, j):
        a, b = wide[i], wide[j]
        if not (a == b).any() or int(np.bitwise_count(a[:16] ^ b[:16]).sum()) > limit:
            return False
        return (a == b).all() or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])

    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 or alike(i, j):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    return sorted(((None if none else d) for none, d in least.values()), key=str)


def test_wide_bits_are_majorities():
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z a b"
    w = text.encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(len(w) - 4)]
    mask, ones = (1 << 64) - 1, [0] * 512
    for x in h:
        for lane in range(8):
            y = x * int(simhash._ODD[lane]) & mask
            y ^= y >> 29
            y = y * int(simhash._ODD[8 + lane]) & mask
            y ^= y >> 32
            for b in range(64):
                ones[lane * 64 + b] += y >> b & 1
    got = np.unpackbits(np.frombuffer(simhash.wide_fingerprint(text.encode()), np.uint8), bitorder="little")
    assert got.tolist() == [int(2 * n > len(h)) for n in ones]
    assert simhash.wide_fingerprint(b"A b") == simhash.wide_fingerprint(b" a  b\n") and simhash.wide_fingerprint(None) == bytes(64)


def test_keep_one_finds_similar_texts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    rows, groups = [], 0
    for d in range(60):
        w = list(base)
        for at in rng.sample(range(200), 2):
            w[at] = rng.choice(words)  # two words of 200: a similarity of about 0.9
        rows.append((d, " ".join(w)))
    for d in range(100, 160):
        rows.append((d, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))))
        groups += 1
    df = spark.createDataFrame([(d, t, None, 1, "c") for d, t in rows], DOCS)
    kept = sorted((r.doc_id for r in simhash.keep_one(df).collect()), key=str)
    assert kept == slow_kept(rows) and sum(d < 100 for d in kept) == 1 and sum(d >= 100 for d in kept) == groups
    # large buckets go another way, to the same groups
    nodes = spark.createDataFrame([(d, simhash.wide_fingerprint(t.encode())) for d, t in rows], "node long, wide binary")
    for small in (3, 16, 1000):
        roots = {r.node: r.root for r in simhash.components(simhash.wide_links(nodes, small=small)).collect()}
        assert len({roots.get(d, d) for d in range(60)}) == 1 and not [d for d in roots if d >= 100]


def edited(base: list[str], cut: int, fresh: str) -> str:
    """base with its last `cut` words replaced: each takes one five-word shingle of the two sets' union away."""
    return " ".join(base[: len(base) - cut] + [f"{fresh}{i}" for i in range(cut)])


def test_only_true_similarity_links(spark):
    # 204 words: 200 shingles; c words replaced at the end leave (200 - c) / (200 + c)
    rows, expected = [], []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(204)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, edited(base, 18, f"x{g}n")), (10 * g + 2, edited(base, 24, f"y{g}n"))]
        expected += [10 * g, 10 * g + 2]  # 0.835 goes, 0.786 stays
    assert len(slow_shingles(rows[0][1]) & slow_shingles(rows[2][1])) * 10 < 8 * len(slow_shingles(rows[0][1]) | slow_shingles(rows[2][1]))
    df = spark.createDataFrame([(d, t, None, 1, "c") for d, t in rows], DOCS)
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert {d for d in kept if d % 10 != 1} == set(expected)  # nothing below the threshold goes
    assert sum(d % 10 == 1 for d in kept) <= 4  # what shares no band


def test_keep_one_leaves_no_similar_pair_out(spark):
    rng = random.Random(12)
    words, rows = [f"w{i}" for i in range(5000)], []
    for g in range(250):  # similarities from 0.79 up: many such pairs share no band of their wide fingerprints
        base = [rng.choice(words) for _ in range(rng.randrange(20, 140))]
        n = len(base) - 4
        rows += [(10 * g, " ".join(base)), (10 * g + 1, edited(base, max(1, round(n / 9 - rng.random())), f"x{g}n"))]
    line = [f"all{i}" for i in range(40)]  # one frequent passage in texts of all kinds
    rows += [(10000 + i, " ".join([*line, *rng.sample(words, rng.randrange(0, 14))])) for i in range(60)]
    sets, fps = {d: slow_shingles(t) for d, t in rows}, {d: slow_fingerprint(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sets:
        for e in sets:
            if d < e and (10 * len(sets[d] & sets[e]) >= 8 * len(sets[d] | sets[e]) or (fps[d] ^ fps[e]).bit_count() <= 2):
                parent[max(find(d), find(e))] = min(find(d), find(e))
    df = spark.createDataFrame([(d, t, None, 1, "c") for d, t in rows], DOCS)
    kept = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert kept == sorted(d for d in sets if find(d) == d) and sum(find(10 * g + 1) == 10 * g for g in range(250)) > 100


def test_prefix_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    texts = []
    for g in range(12):
        base = [rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(rng.randrange(1, 80))]
        texts += [" ".join(base), *(" ".join(base[: len(base) - rng.randrange(len(base))] + [f"x{i}"]) for i in range(rng.randrange(30)))]
    found = {simhash.shingle_set(t.encode()).tobytes() for t in texts}
    sets = [np.frombuffer(x, np.uint64) for x in sorted(found)]
    classes = simhash.shingle_classes(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"))
    rows = [(i, i % 5, len(h), simhash.prefix(h, classes, 0.8).tobytes()) for i, h in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, root long, size int, prefix binary")
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if i % 5 != j % 5 and 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))}
    for small, block in ((16, 256), (2, 3), (1, 1)):
        assert want and want <= {tuple(r) for r in simhash.prefix_pairs(df, 0.8, small, block).collect()}


def test_wide_bits_are_of_sets():
    line = "all rights reserved by the owner of this page "
    assert simhash.wide_fingerprint((line * 2).encode()) == simhash.wide_fingerprint((line * 300).encode())
    assert len(simhash.shingle_set((line * 300).encode())) == 9 and not len(simhash.shingle_set(b" \n")) and not len(simhash.shingle_set(None))
    assert simhash.shingle_set(b"One two").tolist() == [xxhash.xxh64_intdigest(b"one two", 42)]


def test_jaccard_at_its_bound(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 3, 4, 5]), (3, [1, 2, 3, 4, 6]), (4, []), (5, [])], "node long, shingles array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5), (1, 4)], "u long, v long")
    assert sorted(tuple(r) for r in simhash.similar(pairs, sets).collect()) == [(1, 2), (1, 3)]


def test_large_buckets_give_a_least_forest():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    lanes = np.repeat(centres, 50, 0)
    for i in range(len(lanes)):
        for b in rng.choice(256, rng.integers(0, 20), replace=False):
            lanes[i, b // 64] ^= np.uint64(1 << int(b % 64))
    nodes, limit = np.arange(1000, 1300), 24
    u, v = simhash.nearest_links(nodes, lanes, limit)
    bits = np.bitwise_count(lanes[:, None] ^ lanes[None]).sum(2, dtype=np.int64)
    assert (bits[u - 1000, v - 1000] <= limit).all()

    def forest(edges):
        parent, cost = list(range(300)), 0
        for c, i, j in sorted(edges):
            while parent[i] != i:
                i = parent[i]
            while parent[j] != j:
                j = parent[j]
            if i != j:
                parent[i], cost = j, cost + c
        roots = []
        for x in range(300):
            while parent[x] != x:
                x = parent[x]
            roots.append(x)
        return cost, {frozenset(i for i in range(300) if roots[i] == r) for r in set(roots)}

    every = [(int(bits[i, j]), i, j) for i in range(300) for j in range(i) if bits[i, j] <= limit]
    assert forest(every) == forest([(int(bits[a, b]), a, b) for a, b in zip(u - 1000, v - 1000)])
    assert len(u) == 300 - len(forest(every)[1])


def test_simhash_against_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted((tuple(r) for r in queries.op10_simhash(spark, sf_dir).collect()), key=str) == slow_components(docs)


def test_simhash_of_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, None, 1, "c") for d, t in ODD], DOCS)
    assert sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=str) == slow_components(ODD)
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == slow_kept(ODD)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_links_of_dense_and_chained_values(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base, base ^ 0b111, base ^ 0b111000}
    chain = rng.getrandbits(64)
    for _ in range(300):
        chain ^= 1 << rng.randrange(64) ^ 0
        values.add(chain)
    for _ in range(400):
        values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    values |= {rng.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    df = spark.createDataFrame([(simhash._signed(v), i) for i, v in enumerate(values)], "fp long, doc_id long")
    got = {r.fp: r.component_id for r in simhash.fp_components(df).collect()}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for i, v in enumerate(values):
        least.setdefault(find(v), i)
    assert got == {simhash._signed(v): least[find(v)] for v in values}


def test_token_files_against_whole_texts(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, sf_dir, "documents").collect())
    want, start = [], 0
    for d, text in docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op4_token_files(spark, sf_dir).collect()) == want


def test_token_files_of_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [None, "", "  ", "Don't éa b <|endoftext|>x<|startoftext|>", "İstanbul ΣΑΣ ſ ﬁ", "́x ‍ y", "wort " * 30000, "a\x0bb\x0cc\x1cd\x85e"]
    rows = [(None if i == 3 else i // 2, x, "s", 1, "c") for i, x in enumerate(texts)]
    docs, out = spark.createDataFrame(rows, DOCS), scratch(spark, "test")
    got = tokens.read_tokens(spark, out, tokens.write_tokens(docs, out, path, 2)).collect()
    want = sorted((r[0] is not None, r[0] or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows for ids in [[*t.encode(r[1] or "", add_special_tokens=False).ids, 2]])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    out = scratch(spark, "none")
    assert tokens.read_tokens(spark, out, tokens.write_tokens(docs.limit(0), out, path, 2)).count() == 0


def test_token_ids_with_a_small_cache_and_broken_bytes(monkeypatch):
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    t = Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "CACHE_STEMS", 300)
    letters = "abcdefghijklmnoéßñø"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ".", "...", "!?", ".,;:!?.,;:!?", "-x", "'s", "7"]) for _ in range(900)]
    encoder = tokens.Encoder(path, 2)
    for _ in range(4):
        texts = [" ".join(rng.choice(words).capitalize() for _ in range(rng.randrange(120))).encode() for _ in range(20)] + [b"", b"\xff\xfe bad \xc3 x"]
        got = encoder.encode(texts, 2)
        want = [[*t.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids, 2] for x in texts]
        assert [got.values[a:z].tolist() for a, z in zip(got.edges, got.edges[1:])] == want


def test_token_files_refuse_a_tokenizer_that_keeps_white_space(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, "c")], DOCS)
    with pytest.raises(ValueError, match="white space"):
        tokens.write_tokens(docs, scratch(spark, "refused"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def test_shared_shingles_are_told_from_rare_ones_in_full_counters(spark, monkeypatch):
    """200 shingles to a counter, as 6 GB of texts make: a passage of 60 texts stays out of their prefixes."""
    monkeypatch.setattr(simhash, "SLOTS", 1 << 12)
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = words(104)
    texts = [words(400) for _ in range(2000)] + [f"{passage} {words(300)}" for _ in range(60)]
    classes = simhash.shingle_classes(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"))
    common = simhash.shingle_set(passage.encode())
    met = [np.isin(simhash.prefix(simhash.shingle_set(t.encode()), classes, 0.8), common).mean() for t in texts[2000:]]
    assert np.mean(met) < 0.02  # a quarter of the text; by the bits of counts it was 0.088


def test_similar_texts_counts_as_similar_does(spark):
    rng = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    texts = {0: None, 1: b"", 2: b"One two", 3: b"one TWO"}
    for i in range(4, 24):
        w = base.copy()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(200)] = f"x{rng.randrange(1000)}"
        texts[i] = " ".join(w).encode()
    rows = spark.createDataFrame(list(texts.items()), "node long, text binary")
    pairs = spark.createDataFrame([(u, v) for u in texts for v in texts if u < v], "u long, v long")
    sets = spark.createDataFrame([(i, simhash.shingle_set(t).view(np.int64).tolist()) for i, t in texts.items()], "node long, shingles array<long>")
    got = sorted(tuple(r) for r in simhash.similar_texts(pairs, rows).collect())
    assert (2, 3) in got and 20 < len(got) < 200 and got == sorted(tuple(r) for r in simhash.similar(pairs, sets).collect())


def test_filters_leave_no_member_out_and_let_texts_of_groups_of_one_stay(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"))
    held = simhash.flagged(rows, F.col("h"), rows.where("h % 3 = 0").select("h"))
    assert held.count() == 3000 and held.where("h % 3 = 0 and not may").count() == 0 and held.where("h % 3 != 0 and may").count() < 10
    assert simhash.flagged(rows, F.col("h"), rows.limit(0)).where("may").count() == 0
    texts = [f"{i} " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[7], texts[9] + " more"])), "doc_id long, text string")
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    # the rows of groups of one come straight from where they lie: only one branch of the union has an exchange
    branches = kept._jdf.queryExecution().optimizedPlan().children()
    plans = [branches.apply(i).toString() for i in range(branches.size())]
    assert len(plans) == 2 and sum("Window" in p for p in plans) == 1
