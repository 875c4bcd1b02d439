"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import chat, decontam, kdtree, langid, licenses, mixing, phrases, pii, sharding, simhash, superkmer, tokens, whitening
from panelspark.llm.common import scratch, table

SHARDS = 40
END_ID = 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", kdtree.scaled(F.col("embedding")).alias("v"))
    return kdtree.top_k(vectors, F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = superkmer.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch(spark, "tokens")
    manifest = tokens.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return tokens.read_tokens(spark, out, manifest)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


_UNITS = "[" + ", ".join(f"'{u}'" for u in decontam.UNITS) + "]"
_HOLDERS = "['<num>', '<qty>', '<unit>', '<name>']"


def _canonical_sql(name: str, table_name: str, id_column: str) -> str:
    """CTEs that end in `name`: id, text, c (canonical words), v (values)."""
    return rf"""{name}_raw AS (
  SELECT DISTINCT {id_column}, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS r FROM {table_name}),
{name}_words AS (
  SELECT {id_column}, text, list_filter(list_transform(range(1, len(r) + 1), lambda i: {{'c': regexp_replace(r[i], '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'),
         'n': i > 1 AND NOT regexp_matches(r[i - 1], '[.!?]$') AND regexp_matches(r[i], '^[^\p{{L}}\p{{N}}]*\p{{Lu}}')}}), lambda w: w.c <> '') AS w FROM {name}_raw),
{name} AS (
  SELECT {id_column}, text, list_transform(w, lambda x: lower(x.c)) AS v, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i].n THEN '<name>' WHEN regexp_matches(w[i].c, '{decontam.NUMBER}') THEN '<num>'
         WHEN regexp_matches(lower(w[i].c), '{decontam.QUANTITY}') THEN '<qty>' WHEN i > 1 AND NOT w[i - 1].n AND regexp_matches(w[i - 1].c, '{decontam.NUMBER}') AND list_contains({_UNITS}, lower(w[i].c)) THEN '<unit>' ELSE lower(w[i].c) END) AS c FROM {name}_words)"""


# items of fewer than SHORTEST words, found as whole lines or sentences, are left out: the benchmark has none
OP5_SQL = f"""
WITH {_canonical_sql('doc', 'documents', 'doc_id')}, {_canonical_sql('item', 'benchmark', 'item_id')},
iw AS (
  SELECT item_id, text AS item, n, len(c) - n + 1 AS n_windows, i AS item_at, c[i : i + n - 1] AS kinds, v[i : i + n - 1] AS item_values
  FROM (SELECT *, least({decontam.K}, len(c)) AS n FROM item WHERE len(c) >= {decontam.SHORTEST}), unnest(range(1, len(c) - n + 2)) AS u(i)),
dw AS (
  SELECT doc_id, text, n, i AS pos, c[i : i + n - 1] AS kinds, v[i : i + n - 1] AS doc_values FROM doc, (SELECT DISTINCT n FROM iw), unnest(range(1, len(c) - n + 2)) AS u(i)),
m AS (
  SELECT doc_id, dw.text, item_id, item, n_windows, item_at, pos - item_at AS diagonal, item_values = doc_values AS literal, len(list_filter(iw.kinds, lambda k: list_contains({_HOLDERS}, k))) AS n_slots, dw.n,
         list_filter(list_transform(range(1, dw.n + 1), lambda j: {{'k': iw.kinds[j], 'i': item_values[j], 'd': doc_values[j]}}), lambda s: list_contains({_HOLDERS}, s.k)) AS slots
  FROM dw JOIN iw ON dw.n = iw.n AND dw.kinds = iw.kinds
  UNION ALL
  SELECT doc_id, dw.text, item_id, item, n_windows, item_at, pos - item_at, true, 0, dw.n, [] FROM dw JOIN iw ON dw.n = iw.n AND doc_values = item_values AND dw.kinds <> iw.kinds),
l AS (
  SELECT doc_id, text, item_id, item, n_windows, diagonal, list(DISTINCT {{'a': item_at, 'literal': literal}}) AS found, list_distinct(flatten(list(slots))) AS slots FROM m WHERE literal OR n_slots * 2 <= n GROUP BY ALL),
o AS (
  SELECT *, len(slots) = len(list_distinct(list_transform(slots, lambda s: {{'k': s.k, 'i': s.i}}))) AS one FROM l),
f AS (
  SELECT doc_id, text, item_id, item, n_windows, unnest(list_filter(found, lambda x: one OR x.literal)) AS x FROM o),
s AS (
  SELECT doc_id, text, item_id, item, n_windows, count(DISTINCT x.a) AS n_found, NOT bool_and(x.literal) AS reparameterised FROM f GROUP BY ALL)
SELECT doc_id, item_id, n_found, n_windows, n_found / n_windows AS coverage, reparameterised FROM s WHERE n_found / n_windows >= {decontam.LEAST}
"""


def _licenses_sql() -> str:
    known = licenses.known_templates(licenses.TEMPLATES, licenses.LEAST)
    rows = ", ".join(f"('{k.name}', [{', '.join(repr(p) for p in k.pairs)}], {k.n_words}, {k.least}, {k.most})" for k in known)
    return rf"""
WITH k(license, pairs, n_words, low, high) AS (VALUES {rows}),
n AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_replace(regexp_replace(lower(coalesce(text, '')), '[0-9]{{3,}}', '0', 'g'), '[^\p{{L}}\p{{N}}
]+', ' ', 'g') AS t FROM documents),
p AS (
  SELECT *, string_split(t, chr(10)) AS l, string_split_regex(t, '
[ 
]*
') AS g FROM n),
u AS (
  SELECT doc_id, r, 'line' AS unit, i - 1 AS number, l[i] AS v FROM p, unnest(range(1, len(l) + 1)) AS x(i)
  UNION ALL SELECT doc_id, r, 'paragraph', i - 1, g[i] FROM p, unnest(range(1, len(g) + 1)) AS x(i) WHERE contains(trim(g[i], ' ' || chr(10)), chr(10))
  UNION ALL SELECT doc_id, r, 'text', 0, t FROM p WHERE len(list_filter(g, lambda x: trim(x, ' ' || chr(10)) <> '')) > 1),
w AS (
  SELECT doc_id, r, unit, number, list_filter(string_split_regex(v, '[ 
]+'), lambda x: x <> '') AS w FROM u),
b AS (
  SELECT doc_id, r, unit, number, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs FROM w WHERE len(w) > 1),
d AS (
  SELECT doc_id, r, unit, number, license, 2.0::DOUBLE * len(list_intersect(b.pairs, k.pairs)) / (len(b.pairs) + len(k.pairs)) AS dice FROM b JOIN k ON len(b.pairs) BETWEEN low AND high),
e AS (
  SELECT r, doc_id, unit, CAST(number AS INTEGER) AS number, license, dice FROM d WHERE dice >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY r, unit, number ORDER BY dice DESC, license) = 1),
t AS (
  SELECT doc_id, r, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS h FROM (
    SELECT doc_id, r, list_filter(string_split_regex(t, '[ 
]+'), lambda x: x <> '') AS w FROM n)),
c AS (
  SELECT t.*, k.*, list_filter(range(1, len(h) + 1), lambda i: list_contains(pairs, h[i])) AS hits FROM t JOIN k ON len(w) > n_words AND len(list_intersect(h, pairs)) >= low
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.r = t.r AND e.license = k.license)),
x AS (
  SELECT doc_id, r, license, hits[i] AS pos, pairs, list_distinct(h[hits[i] : hits[i] + n_words - 2]) AS mine FROM c, unnest(range(1, len(hits) + 1)) AS v(i)
  WHERE hits[i + low - 1] - hits[i] <= n_words - 2 AND hits[i] <= len(w) - n_words + 1),
y AS (
  SELECT *, 2.0::DOUBLE * len(list_intersect(mine, pairs)) / (len(mine) + len(pairs)) AS dice FROM x)
SELECT doc_id, unit, number, license, dice FROM e
UNION ALL
(SELECT doc_id, 'window', CAST(pos - 1 AS INTEGER), license, dice FROM y WHERE dice >= {licenses.LEAST} QUALIFY row_number() OVER (PARTITION BY r, license ORDER BY dice DESC, pos) = 1)
"""


OP6_SQL = _licenses_sql()


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size,
         CAST('0x' || substr(md5('11:' || name || ':' || CAST(row_number() OVER (PARTITION BY name) - 1 AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
  FROM (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':' || coalesce(source, 'null')) AS name FROM documents)),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS bound FROM s),
p AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS mass,
         coalesce(sum(bound) OVER o, 0) AS b0, coalesce(sum(weight) OVER o, 0) AS w0
  FROM w WINDOW o AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT *, bound::HUGEINT * (mass - w0) < (total - b0) * weight::HUGEINT AS capped FROM p),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN bound::DOUBLE
         ELSE (weight * (total - sum(CASE WHEN capped THEN bound ELSE 0 END) OVER ()))::DOUBLE / (mass - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ())::DOUBLE END AS target
  FROM c),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.u, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(chat.probe(spark))
    out = chat.format_chats(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    read, masked = chat.read_turns(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    back = out.select("conv_id", "formatted", read.alias("turns"), masked.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b')) + length(replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b'), chr(10), '\n')) + 8 + 1 + 7 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), whitening.scaled(F.col("embedding")).alias("x"))
    return whitening.whiten(vectors).withColumnRenamed("id", "vec_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{phrases.UPPER}', '{phrases.LOWER}'), '{phrases.CUT}')) AS piece FROM documents),
w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
o AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS v(size)),
g AS (
  SELECT lang, size, phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 10),
c AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE size > 1),
k AS (
  SELECT *, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 : size], ' ') AS rest FROM c, unnest(range(1, size)) AS u(cut)),
s AS (
  SELECT k.lang, k.size, k.phrase, a, cut, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM k JOIN g x ON x.lang = k.lang AND x.phrase = head JOIN g y ON y.lang = k.lang AND y.phrase = rest),
b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS longer FROM c WHERE size = 3),
t AS (
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= 50 * b.a)),
r AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM t)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, base = pii.find(table(spark, sf_dir, "documents")), [k.name for k in pii.KINDS if k.base]
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(pii.digest(of_base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def _pii_sql() -> str:
    """The plain patterns of the contract for the base kinds, those of pii.KINDS for the others."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        **{k.name: k.pattern for k in pii.KINDS if not k.base},
    }
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(right('00' || p, 3) AS INTEGER) > 255)) = 0",
        "card": "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN j % 2 = 1 THEN x[j] WHEN x[j] > 4 THEN 2 * x[j] - 9 ELSE 2 * x[j] END)) % 10 = 0",
        "phone": "length(d) BETWEEN 10 AND 15",
        "iban": "list_reduce(list_prepend(0, list_transform(string_split(replace(v[5:] || v[:4], ' ', ''), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda s, c: (s * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97) = 1",
        "ssn": "NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$')",
        "local_phone": "NOT regexp_matches(b, '[0-9+][ .-]?$')",
    }
    each = " UNION ALL ".join(f"SELECT r, doc_id, '{k}' AS kind, {i} AS place, regexp_extract_all(t, '{p}') AS f, string_split_regex(t, '{p}') AS g FROM d" for i, (k, p) in enumerate(patterns.items()))
    words = " ".join(f"WHEN '{k}' THEN regexp_matches(near, '(?:^|[^\\p{{L}}])(?:{w})(?:$|[^\\p{{L}}])')" for k, w in pii.WORDS.items())
    passes = " ".join(f"WHEN '{k}' THEN {c}" for k, c in checks.items())
    base = ", ".join(f"'{k.name}'" for k in pii.KINDS if k.base)
    join = "coalesce(string_agg(kind || ':' || start || ':' || (start + length(v)), ',' ORDER BY start, place){}, '')"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
e AS (
  SELECT r, kind, place, f[i] AS v, g[i] AS b, g[i + 1] AS a, CAST(list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM m, unnest(range(1, len(f) + 1)) AS u(i)),
x AS (
  SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d, list_transform(string_split(reverse(regexp_replace(v, '[^0-9]', '', 'g')), ''), lambda c: TRY_CAST(c AS INTEGER)) AS x, lower(right(b, {pii.BEFORE}) || ' ' || left(a, {pii.AFTER})) AS near FROM e),
k AS (
  SELECT r, kind, place, v, start FROM x
  WHERE CASE kind {passes} END AND (kind IN ({base}) OR kind = 'iban' OR CASE kind {words} END))
SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS if k.base)},
       sha256({join.format(f" FILTER (WHERE kind IN ({base}))")}) AS base_sha256, {join.format(" FILTER (WHERE kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN k USING (r) GROUP BY r, doc_id
"""


OP13_SQL = _pii_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_kdtree_top_k": op2_kdtree_top_k,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_files": op4_token_files,
    "op5_decontamination": op5_decontamination,
    "op6_licenses": op6_licenses,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_chat": op9_chat,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_pii": op13_pii,
}
ORACLE_SQL: dict[str, str] = {"op2_kdtree_top_k": OP2_SQL, "op5_decontamination": OP5_SQL, "op6_licenses": OP6_SQL, "op8_mixing": OP8_SQL, "op9_chat": OP9_SQL, "op12_collocations": OP12_SQL, "op13_pii": OP13_SQL}
