from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import regex
from panelspark.llm import decontam, langid, licenses, mixing, queries
from panelspark.llm.common import table
from test_simhash_tokens import slow_kept

UNITS = set(decontam.UNITS)


def slow_words(text):
    raw = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
    out, before = [], ""
    for i, w in enumerate(raw):
        core = regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w)
        if core:
            name = i > 0 and raw[i - 1][-1] not in ".!?" and regex.match(r"\p{Lu}", core)
            out.append((core, bool(name)))
    canonical = []
    for core, name in out:
        low = core.lower()
        if name:
            c = "<name>"
        elif re.match(decontam.NUMBER, core):
            c = "<num>"
        elif "0" <= core[0] <= "9" and re.match(decontam.QUANTITY, low):
            c = "<qty>"
        elif low in UNITS and re.match(decontam.NUMBER, before):
            c = "<unit>"
        else:
            c = low
        canonical.append((c, low))
        before = core if not name else ""
    return canonical


def slow_contaminated(docs, items, k=decontam.K, least=decontam.LEAST):
    typed, plain, total, short = defaultdict(list), defaultdict(list), {}, defaultdict(set)
    for item, text in items:
        c = slow_words(text)
        if len(c) < decontam.SHORTEST:
            short[" ".join(v for _, v in c)].add(item)
            continue
        size = min(k, len(c))
        total[item] = len(c) - size + 1
        for i in range(len(c) - size + 1):
            key, values = zip(*c[i : i + size])
            typed[key].append((item, i, values))
            plain[values].append((item, i, key))
    short.pop("", None)
    out = set()
    for doc, text in docs:
        c = slow_words(text)
        found = defaultdict(list)
        for size in {len(x) for x in typed}:
            for i in range(len(c) - size + 1):
                key, values = zip(*c[i : i + size])
                for item, j, theirs in typed.get(key, ()):
                    slots = {(t, a, b) for t, a, b in zip(key, theirs, values) if t.startswith("<")}
                    n_slots = sum(t in ("<num>", "<qty>", "<unit>", "<name>") for t in key)
                    if theirs == values or n_slots * 2 <= size:
                        found[item, i - j].append((j, theirs == values, slots))
                for item, j, theirs in plain.get(values, ()):
                    if theirs != key:
                        found[item, i - j].append((j, True, set()))
        hits = defaultdict(set)
        for (item, _), lines in found.items():
            slots = set().union(*(s for _, _, s in lines))
            fine = len(slots) == len({(t, a) for t, a, _ in slots})
            hits[item] |= {(j, literal) for j, literal, _ in lines if fine or literal}
        for item, js in hits.items():
            n = len({j for j, _ in js})
            if js and n / total[item] >= least:
                out.add((doc, item, n, total[item], not all(x for _, x in js)))
        for piece in re.split(r"[\n\r]+|(?<=[.!?])[ \t\x0b\x0c]+", text or ""):
            out |= {(doc, item, 1, 1, False) for item in short.get(" ".join(v for _, v in slow_words(piece)), ())}
    return out


def test_decontamination_against_plain_python(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = {(r.doc_id, r.item_id, r.n_found, r.n_windows, r.reparameterised) for r in queries.op5_decontamination(spark, sf_dir).collect()}
    assert got == slow_contaminated(docs, items) and got


def test_reparameterised_questions_and_odd_rows(spark, monkeypatch):
    item = "If Alice has 12 apples and gives 5 apples to Bob then how many apples does Alice have when each weighs 3 kg or 40cm of string?"
    items = [(1, item), (2, None), (3, ""), (4, "two words"), (5, "the small green frog jumps"), (None, "an item of no id that is about 17 ships and Carla and their long way"), (7, item)]
    docs = [
        (1, "so. " + item + " yes"),
        (2, "Well. if Carol has 99 apples and gives 7 apples to Dan then how many apples does Carol have when each weighs 8 kg or 41cm of string?"),
        (3, "Well. if Carol has 99 apples and gives 7 apples to Dan then how many apples does Eve have when each weighs 8 kg or 41cm of string?"),
        (4, None), (5, ""), (6, "...!? --- "), (None, "see. The small, green frog jumps!"), (8, "Alice Bob Carol Dan Eve Foo Bar Baz " * 50), (1, "other text of the same id"),
        (9, "an item of no id that is about 18 ships and Carla and their long way"), (9, "an item of no id that is about 18 ships and Carla and their long way"), (10, "x " * 30000 + "x. The small green frog jumps"), (11, "ab a--b c-d 'q' Foo "),
    ]
    d = spark.createDataFrame([(*r, "z", 1) for r in docs], "doc_id long, text string, item_id string, w int")
    b = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    run = lambda: decontam.contaminated(d, b).collect()
    got = {(r.doc_id, r.item_id, r.n_found, r.n_windows, r.reparameterised) for r in run()}
    assert got == slow_contaminated(docs, items)
    by = defaultdict(set)
    for r in run():
        by[r.doc_id].add(r.item_id)
    assert by == {1: {1, 7}, 2: {1, 7}, None: {5}, 9: {None}, 10: {5}}
    monkeypatch.setattr(decontam, "BLOCK_HASHES", 10)
    assert {(r.doc_id, r.item_id, r.n_found, r.n_windows, r.reparameterised) for r in run()} == got
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns and sorted((r.doc_id, (r.text or "")[:9]) for r in kept.collect()) == sorted((i, (t or "")[:9]) for i, t in docs if i not in (2, None, 9, 10) and not (t or "").startswith("so. "))
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0 and decontam.clean(d, b.limit(0)).count() == len(docs)


def test_verbatim_copies_in_other_capitals_are_found(spark):
    items = [(1, "Each morning a baker sells 40 loaves to Alice and keeps 3 kg of flour for the next day of work."), (2, "The small green frog jumps")]
    docs = [
        (1, "Intro. " + items[0][1].upper()), (2, "so " + items[0][1].title() + " End"), (3, "see " + items[0][1].lower()), (4, "we saw how The small green frog jumps over"), (5, "WE SAW THE SMALL GREEN FROG JUMPS"),
        (6, "EACH MORNING A BAKER OPENS THE SHOP AND NOTHING ELSE OF THE QUESTION IS HERE"), (7, "Intro. " + items[0][1]), (8, "the small green toad jumps"),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_found, r.n_windows, r.coverage, r.reparameterised) for r in decontam.contaminated(d, b).collect()}
    assert got == {(i, 1): (16, 16, 1.0, False) for i in (1, 2, 3, 7)} | {(i, 2): (1, 1, 1.0, False) for i in (4, 5)}
    assert sorted(r.doc_id for r in decontam.clean(d, b).collect()) == [6, 8]


def test_short_items_are_found_as_whole_lines_or_sentences(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "42"), (3, "two words"), (4, "Who wrote Hamlet?"), (5, "")]
    docs = [
        (1, "Intro here. WHO wrote Hamlet? More."), (2, "He asked who wrote hamlet in the end of it"), (3, "a\n 42.\nb"), (4, "there are 42 of them"), (5, "Two   words"), (6, None), (7, "x " * 50000 + "\ntwo words\n"),
        (1, "other two words here"),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_found, r.n_windows, r.reparameterised) for r in decontam.contaminated(d, b).collect()}
    assert got == slow_contaminated(docs, items) == {(1, 1, 1, 1, False), (1, 4, 1, 1, False), (3, 2, 1, 1, False), (5, 3, 1, 1, False), (7, 3, 1, 1, False)}
    assert sorted(r.doc_id for r in decontam.clean(d, b).collect()) == [1, 2, 4, 6]
    longer = spark.createDataFrame([*items, (9, "a question of eight words about something else entirely")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, longer).collect()} == {g[:2] for g in got}


def test_short_items_are_found_in_lines_of_any_length(spark):
    blanks = " " * 5000
    docs = spark.createDataFrame([(1, "blue whale song"), (2, blanks + "blue whale song"), (3, "first. blue" + blanks + "whale\tsong"), (4, "x" * 5000 + " blue whale song")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "Blue whale song")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(docs, items).collect()) == [1, 2, 3]


def test_two_values_of_an_item_may_take_the_same_new_one(spark):
    items = [(1, "A shop sells 3 apples and 5 pears on each day of the week to people who walk past Alice and see Bob.")]
    ask = "Intro. A shop sells {} apples and {} pears on each day of the week to people who walk past {} and see {}."
    docs = [(1, ask.format(4, 4, "Carol", "Dan")), (2, ask.format(4, 6, "Carol", "Carol")), (3, ask.format(4, 6, "Carol", "Dan")), (4, ask.format(3, 5, "Alice", "Bob"))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_found, r.n_windows, r.reparameterised) for r in decontam.contaminated(d, b).collect()}
    assert got == {(1, 18, 18, True), (2, 18, 18, True), (3, 18, 18, True), (4, 18, 18, False)}


def slow_scan(docs, templates=licenses.TEMPLATES, least=0.8):
    def words(t):
        return regex.findall(r"[\p{L}\p{N}]+", t)

    def score(a, b):
        return 2 * len(a & b) / (len(a) + len(b))

    lengths = {n: words(re.sub("[0-9]{3,}", "0", t.lower())) for n, t in templates.items()}
    known = {n: set(zip(w, w[1:])) for n, w in lengths.items()}
    out = []
    for doc, text in docs:
        t = re.sub("[0-9]{3,}", "0", (text or "").lower())
        t = regex.sub(r"[^\p{L}\p{N}\n]+", " ", t)
        paragraphs = re.split(r"\n[ \n]*\n", t)
        units = [("line", i, x) for i, x in enumerate(t.split("\n"))] + [("paragraph", i, x) for i, x in enumerate(paragraphs) if "\n" in x.strip(" \n")]
        units += [("text", 0, t)] if sum(bool(p.strip(" \n")) for p in paragraphs) > 1 else []
        found = set()
        for kind, i, x in units:
            w = words(x)
            pairs = set(zip(w, w[1:]))
            if not pairs:
                continue
            dice, name = max(((score(pairs, k), n) for n, k in known.items()), key=lambda s: (s[0], [-ord(c) for c in s[1]]))
            if dice >= least:
                out.append((doc, kind, i, name, round(dice, 9)))
                found.add(name)
        w = words(t)
        every = list(zip(w, w[1:]))
        for name in set(known) - found:
            n = len(lengths[name])
            if len(w) <= n or len(known[name] & set(every)) * 3 < 2 * len(known[name]):
                continue
            best = max(((score(set(every[i : i + n - 1]), known[name]), -i) for i in range(len(w) - n + 1) if every[i] in known[name]), default=(0, 0))
            if best[0] >= least:
                out.append((doc, "window", -best[1], name, round(best[0], 9)))
    return sorted(out, key=str)


def test_license_scan_against_plain_python(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    found = sorted(((r.doc_id, r.unit, r.number, r.license, round(r.dice, 9)) for r in queries.op6_licenses(spark, sf_dir).collect()), key=str)
    assert found == slow_scan(docs) and len(found) >= 3


def test_license_scan_of_odd_rows(spark):
    header = licenses.TEMPLATES["GPL-3.0-header"]
    docs = [
        (1, header), (2, "x\n\n" + header.replace(", ", ",\n") + "\n\nlong tail of the file\nand more"), (3, None), (4, ""), (5, "Licensed"), (None, "released UNDER the mit license"), (6, "Released under the MIT License.\n" * 3),
        (6, "Released under the MIT License.\n" * 3), (7, "word " * 40000), (8, "# This work is licensed under the GNU General Public License, version 2!"), (9, licenses.TEMPLATES["MIT-grant"].replace("without restriction", "freely")), (10, "\n\n \n"),
    ]
    df = spark.createDataFrame([(*r, 1, "u") for r in docs], "doc_id long, text string, number int, unit string")
    got = sorted(((r.doc_id, r.unit, r.number, r.license, round(r.dice, 9)) for r in licenses.scan(df).collect()), key=str)
    assert got == slow_scan(docs)
    assert {(d, k, n) for d, k, _, n, _ in got} >= {(1, "line", "GPL-3.0-header"), (2, "paragraph", "GPL-3.0-header"), (None, "line", "MIT"), (8, "line", "GPL-3.0"), (9, "line", "MIT-grant")}
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_texts_wrapped_edited_and_embedded(spark):
    mit, apache = licenses.TEXTS["MIT-text"], licenses.TEXTS["Apache-2.0-text"]
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    docs = [
        (1, "Copyright 2020 X\n\n" + wrap(mit, 9)), (2, "This project is released under the MIT License."), (3, "see below. " + mit.replace("\n", " ") + " and " + "more words of code " * 300),
        (4, wrap(apache, 12)), (5, "intro\n" + wrap(apache.replace("Contributor", "Author"), 11) + "\n\nint main() { return 0; }\n" * 40), (6, licenses.TEXTS["BSD-2-Clause-text"]), (7, licenses.TEXTS["BSD-3-Clause-text"].replace("THE COPYRIGHT HOLDERS", "ACME INC")),
        (8, licenses.TEXTS["ISC-text"].upper()), (9, "permission is granted to the copyright holder of this license without warranty of any kind"), (10, "word " * 30000 + licenses.NOTICES["GPL-3.0-header"] + " word" * 3000),
        (11, "the license of the software is not the license of the work " * 200),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = licenses.scan(df).collect()
    assert sorted(((r.doc_id, r.unit, r.number, r.license, round(r.dice, 9)) for r in rows), key=str) == slow_scan(docs)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.license)
    assert "MIT-text" in by[1] and by[2] == {"MIT"} and "MIT-text" in by[3] and "Apache-2.0-text" in by[4] and "Apache-2.0-text" in by[5]
    assert "BSD-2-Clause-text" in by[6] and "BSD-3-Clause-text" in by[7] and "ISC-text" in by[8] and not by[9] and "GPL-3.0-header" in by[10] and not by[11]


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mix", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, spark.createDataFrame(before, docs.schema), sf_dir)
        after = [tuple(r) for r in df.collect()]
        assert df.columns == (columns if name != "sharding" else [*columns, "shard", "slot"])
        if name == "language_id":
            model = langid.learn(docs.select("text", "lang"))
            want = [r for r in before if langid.infer(model, r[1])[0] != "und" and langid.infer(model, r[1])[2] <= 0.5]
            assert len(want) >= 0.95 * len(before)
        elif name == "simhash_near_dedup":
            least = set(slow_kept([(r[0], r[1]) for r in before]))
            want = [r for r in before if r[0] in least]
            assert len(want) < len(before)
        elif name == "benchmark_decontamination":
            bad = {d for d, *_ in slow_contaminated([(r[0], r[1]) for r in before], items)}
            want = [r for r in before if r[0] not in bad]
            assert len(want) < len(before)
        elif name == "source_mix":
            taken = {r.doc_id: r.taken for r in mixing.mix_sizes(spark.createDataFrame(before, docs.schema)).collect()}
            want = [r for r in before for n in [len((r[1] or "").encode().split())] for _ in range(taken[r[0]] // n if n else 0)]
            assert len(set(want)) < len(want)
        else:
            assert Counter(r[:-2] for r in after) == Counter(before)
            places = sorted(r[-2:] for r in after)
            sizes = Counter(s for s, _ in places)
            assert places == sorted((s, i) for s, n in sizes.items() for i in range(n)) and max(sizes.values()) - min(sizes.values()) <= 1
            continue
        assert Counter(after) == Counter(want), name
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == len(before)


def test_pipeline_of_odd_rows(spark, tmp_path):
    rows = [(1, "some english words here", "en", "a", 1), (1, "some english words here", "en", "a", 1), (None, None, None, None, None), (2, "", "en", "a", 0), (None, "some other english words", None, None, 3), (3, "!!! 123", "en", "b", 2), (4, "mot " * 9000, "fr", "b", 36000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, "/root/testdata/sf0.001", "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, None, 4}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/empty/documents.parquet")
    table(spark, "/root/testdata/sf0.001", "benchmark").limit(0).write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
