"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Each kind has a pattern, a check of what it matched, a score to start from and words that speak for it.
Spans of a kind are its leftmost non-overlapping matches that pass the check; spans of
different kinds may overlap. Words count up to the next match of the same kind. Positions come from the lengths of what lies between
matches, added up in blocks, so time is linear in a text and its matches.

Base kinds (email, ip, card by Luhn's rule, phone) are found whatever their score. The others (iban by mod-97 and
its country's length, ssn by the ranges of its parts, local_phone) need LEAST: an iban has it
once its checksum holds, the two others only beside a word that names them.

Patterns are written without backtracking where a long run of characters would cost its square or the
regex engine's stack; they match what the plain form matches. \\G lets a match begin where the last one ended.

Defined results: a null or empty text has no spans; very long texts are looked at whole; rows are
independent, so repeated ones repeat their spans; an empty table stays empty; columns other than the id and the text
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import let

#: Score that a span of an added kind needs; what a checksum and a word nearby add.
LEAST, CONFIRMED, NEARBY = 0.5, 0.4, 0.3
#: Code points before and after a match in which words count.
BEFORE, AFTER = 40, 24
_CHUNK = 64
_SPAN = "array<struct<start:int,place:int,end:int,kind:string,score:double,confirmed:boolean>>"

# fixed values: the length of an IBAN by country
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TN24 TR26 UA29 VA22 VG24 XK20"
)
# fixed values: words beside personal data, in English, German, French and Spanish
WORDS = {
    "email": "e-?mail|mail|contact|write|kontakt|courriel|correo",
    "ip": "ip|host|server|login|address|adresse|dirección|serveur|servidor",
    "card": "card|credit|debit|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|telefon|téléphone|teléfono|móvil|portable|handy",
    "iban": "iban|account|bank|konto|compte|cuenta|banque|banco",
    "ssn": "ssn|social security|social insurance",
    "local_phone": "phone|tel|call|fax|mobile|telefon|téléphone|teléfono|móvil|portable|handy",
}


def iban_pattern() -> str:
    """One alternative for each length."""
    by_length: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        by_length.setdefault(int(entry[2:]), []).append(entry[:2])
    return r"\b(?:" + "|".join(f"(?:{'|'.join(codes)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, codes in sorted(by_length.items())) + r")\b"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    return F.call_function("luhn_check", digits(match))


def mod_97(match: Column) -> Column:
    """An IBAN's check: four characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    step = lambda r, c: let(value(c), lambda v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.aggregate(moved, F.lit(0), step) == 1


def octets(match: Column) -> Column:
    """Four parts of at most 255."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def issued(match: Column) -> Column:
    """Parts that a social security number can have."""
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


class Kind(NamedTuple):
    """check: of a match; before: of the text before it. needs: a quick test of the text. prior: the score of a bare match."""

    name: str
    pattern: str
    needs: Callable[[Column], Column]
    check: Callable[[Column], Column]
    prior: float
    confirms: bool = False
    before: Callable[[Column], Column] | None = None
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda m: F.lit(True), 0.7),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"), octets, 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike("[0-9][ -]?[0-9]"), lambda m: let(F.length(digits(m)), lambda n: (n >= 14) & (n <= 19)) & luhn(m), 0.3, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: let(F.length(digits(m)), lambda n: (n >= 10) & (n <= 15)), 0.6),
    Kind("iban", iban_pattern(), lambda t: t.rlike(r"\b[A-Z]{2}[0-9]{2}"), mod_97, 0.4, True, base=False),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), issued, 0.3, base=False),
    Kind("local_phone", r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b", lambda t: t.rlike(r"\([0-9]{3}\)"), lambda m: F.lit(True), 0.3, before=lambda b: ~b.rlike(r"[0-9+][ .-]?$"), base=False),
)


def running(values: Column) -> Column:
    """The running sums of an array, by blocks: an array that grows one by one would be copied each time."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("out"))
    sums = lambda a: F.aggregate(a, start, lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["out"], F.array(s["total"] + x)).alias("out")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda c: sums(F.slice(values, c * _CHUNK + 1, _CHUNK)))

    def placed(parts: Column) -> Column:
        ends = sums(F.transform(parts, lambda p: p["total"]))["out"]
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p["out"], lambda v: v + F.get(e, i) - p["total"]))))

    return F.when(F.size(values) > 0, let(blocks, placed)).otherwise(F.array().cast("array<int>"))


def spans_of(text: Column, kind: Kind, place: int) -> Column:
    """The spans of one kind: start, place (of the kind), end, kind, score, confirmed."""
    nothing = F.array().cast(_SPAN)

    def build(found: Column) -> Column:
        def positions(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

            def span(m: Column, i: Column, ends: Column) -> Column:
                left, right = F.get(gaps, i), F.get(gaps, i + 1)
                near = F.lower(F.concat(F.right(left, F.lit(BEFORE)), F.lit(" "), F.left(right, F.lit(AFTER)))).rlike(rf"(?:^|[^\p{{L}}])(?:{WORDS[kind.name]})(?:$|[^\p{{L}}])")
                passes = kind.check(m) if kind.before is None else kind.check(m) & kind.before(left)
                score = F.lit(kind.prior + (CONFIRMED if kind.confirms else 0.0)) + F.when(near, NEARBY).otherwise(0.0)
                end = F.get(ends, i)
                made = F.struct((end - F.length(m)).alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"), F.lit(kind.confirms).alias("confirmed"))
                return F.when(passes, made)

            made = let(running(steps), lambda ends: F.transform(found, lambda m, i: span(m, i, ends)))
            return F.filter(made, lambda s: s.isNotNull() if kind.base else s.isNotNull() & (s["score"] >= LEAST))

        return F.when(F.size(found) == 0, nothing).otherwise(let(F.split(text, kind.pattern, -1), positions)).cast(_SPAN)

    return F.when(kind.needs(text), let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), build)).otherwise(nothing)


def find(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, text and spans (start, place, end, kind, score, confirmed), by start and kind; code points, end exclusive."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[spans_of(F.col("text"), kind, i).alias(f"s{i}") for i, kind in enumerate(KINDS)])
    return rows.select("doc_id", "text", F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(KINDS))])).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
