r"""Benchmark decontamination by template canonicalisation.

Words (runs of anything but ASCII white space) lose the punctuation at their edges, and
words of nothing else vanish. What can vary between copies of a question becomes a
typed placeholder: numbers `<num>`, numbers with a unit attached `<qty>`, a unit word
after a number `<unit>`, and capitalised words that don't start a sentence `<name>`;
all other words are lower-cased. Windows of k canonical words of the benchmark are
hash-joined with those of the documents, and so are windows of k plain lower-cased
words: a copy in capitals or in Title Case, or one that starts inside a sentence, turns
words into `<name>` that the item doesn't have there. A window is found if either form
meets.

Windows of one document and item on one diagonal (document position less item
position) form an alignment. Its slots must map each of the item's values to one value
of the document, type by type; two values of the item may take the same new one. If
not, only the windows whose words agree literally count. So does a window of more than half placeholders. A document is contaminated by
an item if at least `least` of the item's windows are found.

Items of fewer than k words have one window of all their words. Items of fewer than
SHORTEST words can't be told from chance inside a sentence: they are found where a whole
line or sentence of the document is the item, in plain lower-cased words.

One pass over the documents hashes the windows of all sizes that items have, and keeps the
hits on hashes of the benchmark, which are broadcast BLOCK_HASHES at a time (one pass
for each such block; a benchmark of some ten thousand items has one). Only documents that
can reach `least` by their hits are read again and compared word by word.

Defined results: null and empty texts, documents or items, have no windows; rows of one
doc_id are told apart by their text and give a row each if it differs; wholly equal
rows give one; null ids are kept as null; empty tables give an empty result. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import SPACE, carried, let, text_key, written

K = 6
LEAST = 0.5
SHORTEST = 4
#: Hashes of the benchmark that are broadcast at a time, each of 8 bytes.
BLOCK_HASHES = 2_000_000
#: Contaminated documents are joined by broadcast up to so many.
BROADCAST_DOCS = 500_000
#: Stands before a word that is a name, within this module's expressions.
MARK = ""
UNITS = "km m cm mm mi mile miles ft foot feet inch inches kg g mg lb lbs oz ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years kmh mph dollar dollars euro euros cent cents percent degree degrees".split()
_EDGE = r"[^\p{L}\p{N}\x20\x09-\x0D" + MARK + "]"
_WORD_START, _WORD_END = r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D])"
NUMBER = r"^[0-9]+([.,:/-][0-9]+)*$"
QUANTITY = r"^[0-9]+([.,][0-9]+)*(" + "|".join(UNITS) + ")$"


def words(text: Column) -> Column:
    """The words of a text without the punctuation at their edges, names marked."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(""))
    # the look behind comes after a white-space character, so that it is tried at few places
    t = F.regexp_replace(t, r"([\x20\x09-\x0D](?<=[^.!?\x20\x09-\x0D][\x20\x09-\x0D])[\x20\x09-\x0D]*+[^\p{L}\p{N}\x20\x09-\x0D]*+)(?=\p{Lu})", "$1" + MARK)
    t = F.regexp_replace(t, f"{_WORD_START}{_EDGE}++|{_EDGE}++{_WORD_END}", "")
    return F.filter(F.split(t, SPACE), lambda w: (w != "") & (w != MARK))


def canonical(w: Column) -> Column:
    """Placeholders and lower-cased words for the array that `words` gives."""
    digit = lambda t: (t >= "0") & (t < ":")
    before = lambda i: F.coalesce(F.get(w, i - 1), F.lit(""))

    def one(t: Column, i: Column) -> Column:
        number = F.when(t.rlike(NUMBER), "<num>").when(F.lower(t).rlike(QUANTITY), "<qty>").otherwise(F.lower(t))
        unit = digit(before(i)) & before(i).rlike(NUMBER) & F.lower(t).isin(*UNITS)
        return F.when(t.startswith(MARK), "<name>").when(digit(t), number).when(unit, "<unit>").otherwise(F.lower(t))

    return F.transform(w, one)


def _values(w: Column) -> Column:
    return F.transform(w, lambda t: F.lower(F.replace(t, F.lit(MARK), F.lit(""))))


def _plain(w: Column, c: Column) -> Column:
    """What `_values` gives, given the canonical words: these are it but for placeholders, and no other word starts with <."""
    return F.zip_with(c, w, lambda x, t: F.when(x.startswith("<"), F.lower(F.replace(t, F.lit(MARK), F.lit("")))).otherwise(x))


def _window_hashes(w: Column, sizes: list[int]) -> Column:
    """Of each size an array with the hashes of all windows of that many words; null words never occur."""

    def joined(a: Column, b: Column, ahead: int) -> Column:
        """Hashes of a window each of a and the one `ahead` words later of b."""
        return F.zip_with(a, F.slice(b, ahead + 1, F.greatest(F.size(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    def build(parts: dict[int, Column], size: int) -> Column:
        """parts: windows of 1, 2, 4, ... words; a window of any size is a chain of these."""
        out, have = None, 0
        for p in sorted(parts, reverse=True):
            if size & p:
                out, have = (parts[p], p) if out is None else (joined(out, parts[p], have), have + p)
        return F.slice(out, F.lit(1), F.greatest(F.size(parts[1]) - (size - 1), F.lit(0)))

    def grown(parts: dict[int, Column]) -> Column:
        last = max(parts)
        if 2 * last > max(sizes):
            return F.array(*[build(parts, s) for s in sizes])
        return let(joined(parts[last], parts[last], last), lambda x: grown(parts | {2 * last: x}))

    return let(F.transform(w, lambda t: F.xxhash64(t)), lambda h: grown({1: h}))


def _read(rows: DataFrame, id_column: str, key: str, sizes: list[int] | None = None) -> DataFrame:
    """id, key (of the text), w (words), c (canonical words), v (plain lower-cased words) and, given sizes, `typed` and `plain` (hashes of windows, an array for each size).

    They come out of an explode of one struct: the optimizer doesn't copy what is
    computed there into each place that mentions it.
    """

    def found(w: Column) -> Column:
        def both(c: Column, v: Column) -> Column:
            typed = [_window_hashes(c, sizes).alias("typed"), F.when(c == v, F.array().cast("array<array<bigint>>")).otherwise(_window_hashes(v, sizes)).alias("plain")] if sizes else []
            return F.struct(w.alias("w"), c.alias("c"), v.alias("v"), *typed)

        return let(canonical(w), lambda c: let(_plain(w, c), lambda v: both(c, v)))

    one = F.explode(F.transform(F.array(words(F.col("text"))), found)).alias("t")
    return rows.select(id_column, text_key().alias(key), one).select(id_column, key, "t.*")


def item_windows(benchmark: DataFrame, k: int = K) -> DataFrame:
    """item_id, item (its row by id and text), n_windows, size, item_at, hashes (canonical and plain), item_words, item_values: one row per window."""
    sizes = list(range(SHORTEST, k + 1))
    items = _read(benchmark, "item_id", "item", sizes).distinct().where(F.size("c") >= SHORTEST)
    items = items.withColumn("size", F.least(F.size("c"), F.lit(k)))
    of = lambda c: F.get(F.col(c), F.col("size") - SHORTEST)
    at = items.select("item_id", "item", "w", "c", "v", "size", of("typed").alias("typed"), of("plain").alias("plain"), F.explode(F.sequence(F.lit(1), F.size("c") - F.col("size") + 1)).alias("item_at"))
    hashes = F.array_distinct(F.array_compact(F.array(*[F.get(F.col(c), F.col("item_at") - 1) for c in ("typed", "plain")])))
    cut = lambda c: F.slice(c, F.col("item_at"), F.col("size"))
    return at.select("item_id", "item", "size", "item_at", (F.size("c") - F.col("size") + 1).alias("n_windows"), hashes.alias("hashes"), cut("c").alias("item_words"), cut("v").alias("item_values"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _candidates(docs: DataFrame, windows: DataFrame, sizes: list[int], least: float) -> DataFrame:
    """doc_id and text_key of the documents that have enough of an item's hashes: all that are contaminated, and few others."""
    sought = windows.select("item_id", "item", "n_windows", F.explode("hashes").alias("hash")).groupBy("hash", "item_id", "item", "n_windows").agg(F.count("*").alias("times"))
    hashes = written(sought.select("hash").distinct(), "item-hashes")
    blocks = max(1, -(-hashes.count() // BLOCK_HASHES))
    each = _read(docs, "doc_id", "text_key", sizes).select("doc_id", "text_key", F.explode(F.flatten(F.concat("typed", "plain"))).alias("hash"))
    hits = [each.join(F.broadcast(hashes.where(F.pmod("hash", F.lit(blocks)) == b)), "hash", "left_semi") for b in range(blocks)]
    # only hits travel; a window may count twice here, in both forms or in two places, which lets more documents through and loses none
    met = _union(hits).groupBy("doc_id", "text_key", "hash").agg(F.lit(1).alias("hit")).join(sought, "hash")
    return met.groupBy("doc_id", "text_key", "item_id", "item", "n_windows").agg(F.sum("times").alias("n")).where(F.col("n") >= F.col("n_windows") * least).select("doc_id", "text_key").distinct()


def _short(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """doc_id, text_key, item_id of documents one of whose lines or sentences is a whole item of fewer than SHORTEST words; None if there is no such item."""
    items = _read(benchmark, "item_id", "item").where(F.size("v").between(1, SHORTEST - 1)).select("item_id", F.array_join("v", " ").alias("said")).distinct()
    items = written(items, "short-items")
    n = items.count()
    if not n:
        return None
    pieces = F.explode(F.split(F.col("text"), r"[\n\r]+|(?<=[.!?])[\x20\x09\x0B\x0C]+")).alias("text")
    said = docs.select("doc_id", text_key().alias("text_key"), pieces).select("doc_id", "text_key", F.array_join(_values(words(F.col("text"))), " ").alias("said"))
    items = F.broadcast(items) if n <= BROADCAST_DOCS else items
    return said.join(items, "said").select("doc_id", "text_key", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, least: float = LEAST) -> DataFrame:
    """doc_id, text_key, item_id, n_found, n_windows, coverage, reparameterised (some slot differs): one row per contaminated document and item."""
    windows = written(item_windows(benchmark, k), "item-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most k rows
    counts = (F.lit(1).cast("long").alias("n_found"), F.lit(1).alias("n_windows"), F.lit(1.0).alias("coverage"), F.lit(False).alias("reparameterised"))
    if (short := _short(docs, benchmark)) is not None:
        short = short.select("doc_id", "text_key", "item_id", *counts)
    if not sizes:
        if short is not None:
            return short
        return docs.select("doc_id", text_key().alias("text_key"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), *counts).limit(0)

    near = written(_candidates(docs, windows, sizes, least), "candidates")
    near = near.select(F.col("doc_id").alias("__near"), F.col("text_key").alias("__near_key"))
    near = F.broadcast(near) if near.count() <= BROADCAST_DOCS else near
    whole = docs.select("doc_id", "text", text_key().alias("__key"))
    whole = whole.join(near, whole["doc_id"].eqNullSafe(near["__near"]) & (whole["__key"] == near["__near_key"]), "left_semi").select("doc_id", "text")
    whole = _read(whole, "doc_id", "text_key", sizes)

    # their windows that meet an item's, word by word
    one = lambda form, typed: F.flatten(F.transform(form, lambda hs, i: F.transform(hs, lambda h, at: F.struct(h.alias("hash"), F.get(F.array(*map(F.lit, sizes)), i).alias("size"), (at + 1).alias("at"), F.lit(typed).alias("typed")))))
    each = whole.select("doc_id", "text_key", "c", "v", F.explode(F.concat(one("typed", True), one(F.when(F.size("plain") > 0, F.col("plain")).otherwise(F.col("typed")), False))).alias("d"))
    each = each.select("doc_id", "text_key", "d.hash", "d.size", "d.at", "d.typed", F.slice("c", F.col("d.at"), F.col("d.size")).alias("words"), F.slice("v", F.col("d.at"), F.col("d.size")).alias("values"))
    sought = windows.select("item_id", "item", "n_windows", "size", "item_at", "item_words", "item_values", F.explode("hashes").alias("hash"))
    met = each.join(sought, ["hash", "size"]).where(F.when(F.col("typed"), F.col("words") == F.col("item_words")).otherwise((F.col("values") == F.col("item_values")) & (F.col("words") != F.col("item_words"))))
    met = met.withColumns({"diagonal": F.col("at") - F.col("item_at"), "literal": F.col("item_values") == F.col("values")})
    slots = F.filter(F.arrays_zip(F.col("item_words").alias("kind"), F.col("item_values").alias("item"), F.col("values").alias("doc")), lambda s: s["kind"].isin("<num>", "<qty>", "<unit>", "<name>"))
    # windows that meet as plain words alone are literal: they say nothing of the slots
    met = met.withColumn("slots", F.when(F.col("typed"), slots).otherwise(F.slice(slots, 1, 0)))
    sure = F.col("literal") | (F.size("slots") * 2 <= F.size("item_words"))
    # equal rows fall together here; a group has at most two entries per window of the item
    lines = met.where(sure).groupBy("doc_id", "text_key", "item_id", "item", "n_windows", "diagonal").agg(
        F.collect_set(F.struct("item_at", "literal")).alias("found"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    one_value = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["item"]))))
    kept = F.filter("found", lambda f: F.col("one_value") | f["literal"])
    found = lines.withColumn("one_value", one_value).select("doc_id", "text_key", "item_id", "item", "n_windows", F.explode(kept).alias("f"))
    sums = found.groupBy("doc_id", "text_key", "item_id", "item", "n_windows").agg(F.size(F.collect_set("f.item_at")).cast("long").alias("n_found"), (~F.bool_and("f.literal")).alias("reparameterised"))
    share = (F.col("n_found") / F.col("n_windows")).alias("coverage")
    out = sums.select("doc_id", "text_key", "item_id", "n_found", "n_windows", share, "reparameterised").where(F.col("coverage") >= least)
    return out if short is None else out.union(short)


def clean(docs: DataFrame, benchmark: DataFrame, k: int = K, least: float = LEAST) -> DataFrame:
    """The rows of docs that no item contaminates."""
    bad = written(contaminated(docs, benchmark, k, least).select(F.col("doc_id").alias("__bad"), F.col("text_key").alias("__bad_key")).distinct(), "contaminated")
    rows = carried(docs, "doc_id").withColumn("__key", text_key("__row.text"))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_DOCS else bad
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["__bad"]) & (rows["__key"] == bad["__bad_key"]), "left_anti").select("__row.*")
