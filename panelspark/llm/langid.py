"""Language identification by multilingual mixture inference.

Learned: counts of hashed letter trigrams per language over every training row,
summed in Spark; smoothed, they give p(trigram | language). A document is taken as
a mixture: expectation-maximisation on its trigrams estimates the proportion of each
language and of one flat background component (text of no learned language). The
language set is selected by penalised likelihood: languages are ranked by their
proportion in the full mixture, and the set of the first k is chosen whose
log-likelihood less PENALTY * k * log(trigrams) / 2 is largest. The prediction is
the selected language of the largest proportion; score is that proportion among the
learned languages.

Trigrams run over the lower-cased letters of the whole text, every stretch of other
characters read as one space, with one space at either end; a long text is read in pieces
that carry that state on. Each language has SLOTS counts, or fewer where there are many
languages: all together MODEL_CELLS at most, which bounds what goes through the driver
and to the tasks, however large the corpus is.

EM stops where the likelihood is proven to be within TOLERANCE of the highest there is:
it is concave, so its gap is at most the number of trigrams times the largest relative
growth of a proportion. Where languages are alike, Newton steps take over from EM's. The search for the set ends where the full mixture's bound shows
that no larger set can win.

Defined results: a null text, one without a letter, or any text where nothing could be
learned gives `und` with score 0; rows of a null lang or text teach nothing; ties go
to the smaller name; repeated rows count again; bytes that are no UTF-8 are read as
U+FFFD; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from panelspark.llm.common import written

SLOTS = 1 << 15
#: Counts that a model holds at most: beyond 64 languages each has fewer slots.
MODEL_CELLS = 1 << 21
SMOOTHING = 0.5
PENALTY = 2.0
#: Log-likelihood (nats) that EM may lack when it stops.
TOLERANCE = 0.01
#: EM steps before Newton steps are tried, and how often one is halved.
PLAIN_STEPS, HALVINGS = 25, 6
UNDETERMINED = "und"
#: Code points of a text that are looked at in one piece, and languages whose counts a task holds at a time.
PIECE, HELD_LANGUAGES = 1 << 20, 64

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _slots(codes: np.ndarray) -> np.ndarray:
    """The trigram slots of consecutive code points."""
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(49)).astype(np.int32)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Trigram slots of lower-cased text, piece by piece; none where it has no letter."""
    carry, in_gap = np.array([32], np.uint64), True
    for a in range(0, len(text), PIECE):
        codes = np.frombuffer(text[a : a + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[codes]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] |= not in_gap
        now = np.concatenate([carry, np.where(is_letter, codes, np.uint32(32))[keep]])
        in_gap = not is_letter[-1]
        if len(now) > 2:
            yield _slots(now)
        carry = now[-2:]
    if len(carry) == 2 and not in_gap:
        yield _slots(np.append(carry, np.uint64(32)))


def decoded(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, whatever bytes they hold."""
    for t in column.cast(pa.binary()):
        raw = t.as_py()
        yield None if raw is None else raw.decode("utf-8", "replace")


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Slots of the whole text, and how often each occurs (None: once each as listed). No slots: no letter."""
    listed, counts = [], None
    for s in _pieces((text or "").lower()):
        listed.append(s)
        if sum(map(len, listed)) > SLOTS // 32:
            now = np.bincount(np.concatenate(listed), minlength=SLOTS)
            counts, listed = now if counts is None else counts + now, []
    if counts is None:
        return (np.concatenate(listed) if listed else np.empty(0, np.int32)), None
    if listed:
        counts = counts + np.bincount(np.concatenate(listed), minlength=SLOTS)
    which = np.nonzero(counts)[0].astype(np.int32)
    return which, counts[which]


@dataclass
class Model:
    languages: list[str]
    #: p(slot | language), one column per language and a last one for the background.
    p: np.ndarray

    def rows(self, slots: np.ndarray) -> np.ndarray:
        """p of these of SLOTS slots; a smaller model has 2, 4, ... of them in one."""
        return self.p[slots // (SLOTS // len(self.p))]


def counts(rows: DataFrame) -> DataFrame:
    """lang, slot, n: trigram counts of rows (text, lang), added up within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(SLOTS, np.int64))

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                slots = np.nonzero(c)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(c[slots])], ["lang", "slot", "n"])
            held.clear()

        for b in batches:
            for text, lang in zip(decoded(b.column(0)), b.column(1).to_pylist()):
                slots, times = trigrams(text)
                held[lang] += np.bincount(slots, times, SLOTS).astype(np.int64)
                if len(held) > HELD_LANGUAGES:
                    yield from out()
        yield from out()

    known = rows.where("text is not null and lang is not null").select("text", "lang")
    return known.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def learn(rows: DataFrame) -> Model:
    """A model from all rows (text, lang) whose lang and text are not null."""
    every = written(counts(rows), "trigrams")
    languages = sorted(r.lang for r in every.select("lang").distinct().collect())  # names alone; their counts follow as MODEL_CELLS rows at most
    size = SLOTS
    while size > 1 and size * len(languages) > MODEL_CELLS:
        size //= 2
    folded = every.groupBy("lang", F.floor(F.col("slot") / (SLOTS // size)).cast("int").alias("slot")).agg(F.sum("n").alias("n")) if size < SLOTS else every
    found = folded.toArrow()
    at = {x: i for i, x in enumerate(languages)}
    p = np.full((size, len(languages) + 1), SMOOTHING)
    p[found.column("slot").to_numpy(), [at[x] for x in found.column("lang").to_pylist()]] += found.column("n").to_numpy()
    p[:, -1] = 1
    return Model(languages, (p / p.sum(0)).astype(np.float64))


def _newton_step(p: np.ndarray, share: np.ndarray, theta: np.ndarray, growth: np.ndarray) -> np.ndarray:
    """Where the quadratic model of the mean log-likelihood, less the sum of proportions, is highest among proportions of 0 or more.

    share: weight of each row over all rows, divided by its density. Proportions that would turn negative are set to 0 and the others found anew.
    """
    free, fixed = (theta > 0) | (growth > 1), np.zeros(len(theta), bool)
    curvature = (p * (share / np.maximum(p @ theta, np.finfo(float).tiny))[:, None]).T @ p
    step = np.zeros(len(theta))
    while free.any():
        at = np.flatnonzero(free)
        slope = growth[at] - 1.0 - curvature[np.ix_(at, np.flatnonzero(fixed))] @ step[fixed]
        own = curvature[np.ix_(at, at)]
        step[at] = np.linalg.solve(own + np.eye(len(at)) * (1e-13 * own.trace()), slope)  # equal columns share what they get
        low = at[theta[at] + step[at] < 0]
        if not len(low):
            break
        step[low], free[low], fixed[low] = -theta[low], False, True
    after = np.maximum(theta + step, 0.0)
    return after / after.sum() if after.sum() > 0 else theta


def proportions(p: np.ndarray, times: np.ndarray | None, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float, float]:
    """Mixture proportions of the columns of p by EM, the log-likelihood they reach, and a bound on what it lacks.

    Where columns are alike EM creeps, so after PLAIN_STEPS each round also tries a Newton step, halved until it is better than EM's.
    """
    k = p.shape[1]
    theta, n, gap, rounds = np.full(k, 1.0 / k), float(len(p) if times is None else times.sum()), 0.0, 0
    total = lambda log: float(log.sum() if times is None else log @ times)
    while k > 1:
        weight = 1.0 / (p @ theta)
        share = (weight if times is None else weight * times) / n
        growth = share @ p
        gap = n * (growth.max() - 1.0)
        if gap <= tolerance:
            break
        plain, rounds = theta * growth, rounds + 1
        if rounds > PLAIN_STEPS:
            aim, reached = _newton_step(p, share, theta, growth), total(np.log(p @ plain))
            for _ in range(HALVINGS):
                with np.errstate(divide="ignore"):
                    if total(np.log(p @ aim)) > reached:
                        plain = aim
                        break
                aim = (aim + theta) / 2
        theta = plain
    return theta, total(np.log(p @ theta)), gap


def infer(model: Model, text: str | None) -> tuple[str, float, float, list[str]]:
    """Language, score, share of the background, and the selected languages with their order of proportion."""
    slots, times = trigrams(text)
    if not len(slots) or not model.languages:
        return UNDETERMINED, 0.0, 0.0, []
    p, last = model.rows(slots), len(model.languages)
    n = float(len(slots) if times is None else times.sum())
    full, log, gap = proportions(p, times)
    order = sorted(range(last), key=lambda i: (-full[i], i))
    cost = PENALTY * np.log(max(n, 2.0)) / 2
    chosen, value, most = None, -np.inf, log + gap
    for k in range(1, last + 1):
        if most - cost * k <= value:  # no larger set can do better: none has a higher likelihood than the best full mixture
            break
        columns = order[:k]
        theta, log, _ = proportions(p[:, [*columns, last]], times)
        if log - cost * k > value:
            chosen, value = (columns, theta), log - cost * k
    columns, theta = chosen
    share = theta[:-1]
    top = min(range(len(columns)), key=lambda i: (-share[i], columns[i]))
    known = float(share.sum())
    score = float(share[top]) / known if known > 0 else 0.0
    ranked = [model.languages[columns[i]] for i in sorted(range(len(columns)), key=lambda i: (-share[i], columns[i]))]
    return model.languages[columns[top]], min(1.0, max(0.0, score)), float(theta[-1]), ranked


def predict(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """rows with lang_pred, score, other_share (of the background) and lang_set, which replace columns of these names. Only `text` is read."""
    kept = [c for c in rows.columns if c.lower() not in ("lang_pred", "score", "other_share", "lang_set")]
    narrow = rows.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [infer(model, t) for t in decoded(b.column(at))]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*kept, "lang_pred", "score", "other_share", "lang_set"])

    schema = StructType(list(narrow.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()).add("other_share", DoubleType()).add("lang_set", ArrayType(StringType()))
    return narrow.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from the training: crc32 of its id as text leaves 1 when divided by 3. A null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, other_share and lang_set of every row, by a model of the rows that aren't held out."""
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).drop("text")


def accepted(docs: DataFrame, most_other: float = 0.5) -> DataFrame:
    """The rows of docs whose text is in a learned language: those that have a letter and fit the background to most_other at most.

    Where no row has a language to learn from, only rows without a letter go.
    """
    model = learn(docs.select("text", "lang"))

    def fits(text: str | None) -> bool:
        if not model.languages:
            return len(trigrams(text)[0]) > 0
        lang, _, other, _ = infer(model, text)
        return lang != UNDETERMINED and other <= most_other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([fits(t) for t in decoded(b.column(at))], pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
