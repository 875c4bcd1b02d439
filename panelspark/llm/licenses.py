r"""Licence scans: Dice coefficient over word bigrams against licence templates.

A text is normalised (lower case, numbers of three digits and more to one 0, so that years
agree and versions don't, everything but letters and digits to a space) and compared in units: each line, each paragraph of several lines
(blank lines part paragraphs), and the text if it has several paragraphs. A unit
and a template score 2 |A & B| / (|A| + |B|) over their sets of word bigrams. A score
of t needs |A| between t / (2 - t) and (2 - t) / t times |B|, so each unit is
compared with the templates of fitting size alone.

A template that no unit of a text reaches, since it stands within a longer line or
paragraph, is sought in windows of its own number of words, over the whole text, that
start with one of its bigrams; its best window is returned.

A score of t also needs t / (2 - t) * |B| bigrams of the template to be there. So of any
|B| - that + 1 of them at least one is: a text without one of these (the longest of each
template) is left at once, and the others are scored in the same pass.

Templates are notices and whole texts; of licences too long to list (GPL, LGPL, MPL) the
notices and the first paragraph of the text are there.

Defined results: the best template of a unit counts, ties to the first name; of equal
windows the first; null and empty texts have no units; a unit of one word has no bigram;
repeated rows come back repeated; an empty table gives an empty result. Columns other than
doc_id and text are ignored. Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import let
from panelspark.llm.license_texts import NOTICES, TEXTS

LEAST = 0.8
TEMPLATES = NOTICES | TEXTS


def normal(text: Column) -> Column:
    """Lines of single-spaced words."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[0-9]{3,}", "0")
    return F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")


def unit_words(unit: Column) -> Column:
    return F.filter(F.split(unit, "[ \n]+"), lambda w: w != "")


def _pairs(words: Column, pair) -> Column:
    """pair(a, b) of each two words that follow each other."""
    joined = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), pair)
    return F.slice(joined, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def bigrams(words: Column) -> Column:
    """The set of word bigrams."""
    return F.array_distinct(_pairs(words, lambda a, b: F.concat(a, F.lit(" "), b)))


def bigram_hashes(words: Column) -> Column:
    """Of each word but the last the hash of its bigram."""
    return _pairs(words, lambda a, b: F.xxhash64(a, b))


def _hash(pair: str) -> int:
    """What xxhash64 gives for the two words of a bigram."""
    h = 42
    for w in pair.split(" "):
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (h >> 63 << 64)


def _template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", re.sub("[0-9]{3,}", "0", text.lower()))


@dataclass(frozen=True)
class Template:
    """A notice's words and bigrams, and the least and most bigrams of a unit that can reach the score; so many at least are its own."""

    name: str
    n_words: int
    pairs: tuple[str, ...]
    least: int
    most: int

    @property
    def signature(self) -> list[str]:
        """Bigrams of which a unit or window that reaches the score has one at least: the longest, as these are rare."""
        return sorted(self.pairs, key=lambda p: (-len(p), p))[: len(self.pairs) - self.least + 1]


def known_templates(templates: dict[str, str], least: float) -> list[Template]:
    """The templates by name, those without a bigram left out."""
    t = Fraction(least).limit_denominator(1000)
    low, high, out = t / (2 - t), (2 - t) / t, []
    for name in sorted(templates):
        w = _template_words(templates[name])
        pairs = tuple(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))
        if pairs:
            out.append(Template(name, len(w), pairs, int(-(-low * len(pairs) // 1)), int(high * len(pairs) // 1)))
    return out


def _strings(values: list[str]) -> Column:
    """A list of strings without commas, as one literal that is split once, when the plan is made."""
    return F.split(F.lit(",".join(values)), ",")


def _longs(values: list[int]) -> Column:
    return _strings([str(v) for v in values]).cast("array<bigint>")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, unit (line, paragraph, text or window), number (of the unit, or of the window's first word, from 0), license, dice: all that reach `least`."""
    known = known_templates(templates or TEMPLATES, least)
    struct = lambda k: F.struct(
        F.lit(k.name).alias("name"), _strings(list(k.pairs)).alias("pairs"), _longs([_hash(p) for p in k.pairs]).alias("hashes"), F.lit(k.n_words).alias("n_words"),
        F.lit(k.least).alias("least"), F.lit(k.most).alias("most"),
    )
    literal = F.array(*[struct(k) for k in known])
    signature = _longs(sorted({_hash(p) for k in known for p in k.signature}))

    numbered = lambda kind, values, keep: F.filter(F.transform(values, lambda u, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"), u.alias("value"))), keep)
    bare = lambda u: F.btrim(u, F.lit(" \n"))
    none = F.array().cast("array<struct<unit:string,number:int,value:string>>")

    def units(text: Column) -> Column:
        paragraphs = let(
            F.split(text, r"\n[ \n]*\n"),
            lambda ps: F.concat(
                numbered("paragraph", ps, lambda u: F.instr(bare(u["value"]), "\n") > 0),
                F.when(F.size(F.filter(ps, lambda p: bare(p) != "")) > 1, numbered("text", F.array(text), lambda u: F.lit(True))).otherwise(none),
            ),
        )
        return F.concat(numbered("line", F.split(text, "\n"), lambda u: bare(u["value"]) != ""), paragraphs)

    dice = lambda pairs, k: F.lit(2.0) * F.size(F.array_intersect(pairs, k["pairs"])) / (F.size(pairs) + F.size(k["pairs"]))
    nothing = F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("name"))

    def best(pairs: Column) -> Column:
        fitting = F.filter(literal, lambda k: (F.size(pairs) >= k["least"]) & (F.size(pairs) <= k["most"]))
        scored = F.transform(fitting, lambda k: F.struct(dice(pairs, k).alias("dice"), k["name"].alias("name")))
        return F.aggregate(scored, nothing, lambda a, s: F.when(s["dice"] > a["dice"], s).otherwise(a))  # templates come by name, so the first of equals stays

    def row(unit: Column, number: Column, name: Column, score: Column) -> Column:
        return F.struct(unit.alias("unit"), number.cast("int").alias("number"), name.alias("license"), score.alias("dice"))

    def scored_units(text: Column) -> Column:
        one = lambda u: let(
            let(unit_words(u["value"]), lambda w: F.when(F.size(w) > 1, let(bigrams(w), best)).otherwise(nothing)), lambda b: row(u["unit"], u["number"], b["name"], b["dice"])
        )
        return F.filter(F.transform(let(text, units), one), lambda u: u["dice"] >= least)

    def windows(w: Column, h: Column, found: Column) -> Column:
        """The best window of each template that `found` lacks. w: words; h: the hashes of their bigrams."""
        names = F.transform(found, lambda f: f["license"])
        there = F.filter(literal, lambda k: (F.size(w) > k["n_words"]) & (F.size(F.array_intersect(k["hashes"], h)) >= k["least"]) & ~F.array_contains(names, k["name"]))

        def best_window(k: Column) -> Column:
            hits = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.array_contains(k["hashes"], F.get(h, i - 1)) & (F.size(h) > 0))
            # a window that reaches the score has `least` hits at least
            dense = let(hits, lambda p: F.filter(p, lambda at, i: (F.get(p, i + k["least"] - 1) - at <= k["n_words"] - 2) & (at <= F.size(w) - k["n_words"] + 1)))
            scored = F.transform(dense, lambda at: F.struct(dice(bigrams(F.slice(w, at, k["n_words"])), k).alias("dice"), (-at).alias("before")))
            return let(F.array_max(scored), lambda b: row(F.lit("window"), -b["before"] - 1, k["name"], b["dice"]))

        return F.filter(F.transform(there, best_window), lambda u: F.coalesce(u["dice"] >= least, F.lit(False)))

    def found(t: Column) -> Column:
        of = lambda w, h: let(scored_units(t), lambda f: F.concat(f, windows(w, h, f)))
        nil = F.array().cast("array<struct<unit:string,number:int,license:string,dice:double>>")
        return let(unit_words(t), lambda w: let(bigram_hashes(w), lambda h: F.when(F.arrays_overlap(h, signature), of(w, h)).otherwise(nil)))

    return docs.select("doc_id", F.explode(let(normal(F.col("text")), found)).alias("u")).select("doc_id", "u.unit", "u.number", "u.license", "u.dice")
