from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from panelspark.llm import chat, mixing, queries, sharding
from panelspark.llm.common import table
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, `__size` int"
ODD = [
    (1, "a b c", "en", "s1", 5, "x", 1), (1, "a b c", "en", "s1", 5, "x", 1), (1, "other", None, None, 5, "y", 2),
    (None, None, None, None, None, None, None), (None, "a b c", "en", "s2", 5, None, None), (2, "", "fr", "s2", 0, "z", 3),
    (3, " \t\n", "de", "", 3, "z", 3), (4, "wort " * 5000, "de", "s1", 25000, "z", 3), (5, "é x y", "fr", "s3", 5, "q", 4),
]


def test_sharding_is_a_gapless_permutation(spark, sf_dir):
    rows = queries.op7_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(docs[r.doc_id]) + 16, zlib.crc32(docs[r.doc_id]))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    sizes = [len(slots[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(table(spark, sf_dir, "documents").repartition(5)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_places_agree_with_plain_python(spark):
    for n in (1, 2, 3, 7, 50, 101, 1000):
        rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("x")).collect()
        assert all(sharding.permuted_int(r.id, n) == r.x for r in rows)
        a, b = sharding.grid(n)
        assert sorted(sharding.permuted_int(i, n) for i in range(a * b)) == list(range(a * b))
        assert len({sharding.place(i, n, 4) for i in range(n)}) == n
    numbers, n = sharding.numbered(spark.range(500).select(F.col("id").alias("doc_id")), F.col("doc_id"), F.col("doc_id"))
    want = {r.doc_id: sharding.place(r["__row_number"], n, 40) for r in numbers.collect()}
    got = sharding.placed(spark.range(500).select(F.col("id").alias("doc_id")), F.col("doc_id"), F.col("doc_id"), 40)
    assert {r.doc_id: (r.shard, r.slot) for r in got.collect()} == want


def test_sharding_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    out = sharding.with_shards(docs, 4)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__size", "shard", "slot"]
    rows = out.collect()
    assert len(rows) == len(ODD) and sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(3 if s == 0 else 2)]
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def share_out(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        mass = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / mass > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / mass for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_reaches_targets(spark, sf_dir):
    rows = queries.op8_mixing(spark, sf_dir).collect()
    docs = table(spark, sf_dir, "documents").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    sums = Counter()
    for i, n in size.items():
        sums[source[i]] += n
    want = share_out(sums)
    for r in rows:
        assert (r["size"], r.source_size) == (size[r.doc_id], sums[source[r.doc_id]])
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * (1 + r.target)
        if r["size"]:
            assert r.taken % r["size"] == 0 and r.taken // r["size"] in (int(r.target / r.source_size), min(3, int(r.target / r.source_size) + 1))


def test_share_out_with_many_capped_sources(spark):
    for sizes in ({"a": 100, "b": 1, "c": 1, "d": 5, None: 1000}, {"x": 0, "y": 0}, {"q": 9}, {"a": 0, "b": 7, "c": 1000, "d": 3}):
        s = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(s).collect()}
        want = share_out(sizes)
        assert all(abs((got[k] or 0) - want[k]) < 1e-9 * (1 + want[k]) for k in sizes if sum(sizes.values())), (sizes, got, want)


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    sizes = mixing.mix_sizes(docs).collect()
    assert len(sizes) == len(ODD)
    assert mixing.mix(docs).columns == docs.columns
    taken = Counter((r.doc_id, r.text) for r in mixing.mix(docs).collect())
    assert sum(n * len((t or "").encode().split()) for (_, t), n in taken.items()) == sum(r.taken for r in sizes)
    assert taken == Counter((r.doc_id, r.text) for r in mixing.mix(docs.repartition(3)).collect())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_sizes(docs.limit(0)).count() == 0


def test_repeated_rows_draw_for_themselves(spark):
    rows = [(1, "w " * 10, "a")] * 200 + [(i, "w " * 10, "b") for i in range(900)] + [(None, None, "b")] * 5 + [(7, "w " * 10, None)] * 300
    df = spark.createDataFrame([(d, t, s, i) for i, (d, t, s) in enumerate(rows)], "doc_id long, text string, source string, other int")
    for docs in (df.repartition(7), df.coalesce(1)):
        sums, goal, size = Counter(), {}, {}
        for r, s in ((r, "a" if r.source_size == 2000 else "b" if r.source_size == 9000 else None) for r in mixing.mix_sizes(docs).collect()):
            sums[s] += r.taken
            goal[s], size[s] = r.target, r.source_size
        assert all(abs(sums[s] - goal[s]) < 0.12 * size[s] for s in goal), (sums, goal)
        taken = Counter((r.doc_id, r.source) for r in mixing.mix(docs).collect())
        assert {s: sum(10 * n for (d, x), n in taken.items() if x == s and d is not None) for s in sums} == sums
        assert max(Counter(r.other for r in mixing.mix(docs).collect()).values()) <= 3


def test_row_numbers_are_ranks_whatever_the_input_order(spark):
    rows = [(i % 7, "x") for i in range(100)] + [(3, "x")] * 150 + [(None, None)] * 9 + [(3, "y")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (df.repartition(6), df.coalesce(1)):
        numbers, n = sharding.numbered(docs, F.col("doc_id"), F.col("text"))
        got = sorted((r["__row_number"], r.doc_id, r.text) for r in numbers.collect())
        assert n == len(rows) and [g[0] for g in got] == list(range(n))
        assert [g[1:] for g in got] == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_chat_round_trip(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op9_chat(spark, sf_dir).collect()}
    convs = defaultdict(list)
    for r in table(spark, sf_dir, "conversations").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts_and_odd_turns(spark):
    text = lambda t: {"type": "text", "text": t, "ref": None, "units": None}
    turns = [
        (1, 0, "user", [text("see \\l<|end|>"), {"type": "image", "text": None, "ref": "a.png", "units": 256}, text(None), {"type": "audio", "text": None, "ref": "b.wav", "units": 4}]),
        (1, 1, "assistant", [text("[INST] \\e\\b naïve 🎈\n<|role|>x")]),
        (1, 1, "assistant", [text("[INST] \\e\\b naïve 🎈\n<|role|>x")]),
        (None, None, None, None), (None, 3, "ro\nle", []), (2, 0, "assistant", [text("")]),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.format_chats(df)
    rows = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(a["index"], a.type, a.ref, a.tokens) for a in rows[1].attachments] == [(0, "image", "a.png", 256), (1, "audio", "b.wav", 100)]
    assert [(t.role, t.text) for t in rows[1].turns] == [("user", "see \\l<|end|><|image:0|><|audio:1|>")] + [("assistant", "[INST] \\e\\b naïve 🎈\n<|role|>x")] * 2
    assert rows[1].loss == "[INST] \\e\\b naïve 🎈\n<|role|>x" * 2 and rows[1].formatted.count(chat.END) == 3
    assert [(t.role, t.text) for t in rows[None].turns] == [("", ""), ("ro\nle", "")] and rows[2].loss == ""
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_of_many_long_turns_and_attachments(spark):
    part = lambda kind, text=None, ref=None, units=None: {"type": kind, "text": text, "ref": ref, "units": units}
    turns = [(1, t, "assistant" if t % 2 else "user", [part("text", "wort [x] " * 200), part("document", ref=f"d{t}", units=t)]) for t in range(600)] + [(2, 0, "user", [part("text", "é" * 400_000)])]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    rows = {r.conv_id: r for r in chat.format_chats(df).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(a["index"], a.ref, a.tokens) for a in rows[1].attachments] == [(t, f"d{t}", 600 * t) for t in range(600)]
    assert [t.text for t in rows[1].turns] == ["wort [x] " * 200 + f"<|document:{t}|>" for t in range(600)]
    assert rows[1].loss == "".join("wort [x] " * 200 + f"<|document:{t}|>" for t in range(1, 600, 2)) and rows[2].turns[0].text == "é" * 400_000
