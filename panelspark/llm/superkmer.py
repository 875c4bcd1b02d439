"""Substring dedup by super-k-mers: word windows that occur twice anywhere are removed.

A window is k consecutive words of one document. Its minimiser is the smallest hash
among its m-word grams; consecutive windows that share it travel as one packed string
(a super-k-mer: c windows in c + k - 1 words) to the minimiser's bucket, so equal
windows always meet. A bucket numbers its words exactly, sorts its windows by a hash
of those numbers, and compares the windows of one hash word by word. Windows found
more than once go back as spans (start, count) of their document, and the words that
they cover are dropped.

Before anything travels, a task sorts the windows of its own piece of the input in the
same way: those that repeat there are settled, and only the first of each goes on, so
copies and common passages cost one row per piece. Grams that are frequent over the
whole input (the HEAVY_GRAMS most frequent; a first pass counts those that are
frequent within some piece) are the last choice as minimisers, so that the
different surroundings of a common passage don't all meet in its bucket. That only
moves windows between buckets; results don't depend on it.

Defined results: a null text has no words; fewer than k words have no window; windows
may overlap and both copies go, within one document too; repeated rows repeat all
their windows; null and repeated doc_ids are told apart by a hash of the text; an
empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import partitions, text_key

#: Words of one piece of a task's input, looked at together.
PIECE_WORDS = 2_000_000
#: Windows of one packed string at most.
RUN_WINDOWS = 256
#: Buckets for each shuffle partition at least, and words of the input for each bucket at most: a bucket is
#: worked through in one worker's memory, and packed windows come to some three times the input.
BUCKETS_PER_PARTITION, BUCKET_WORDS = 8, 1_500_000
HEAVY_GRAMS = 1 << 16
HEAVY_IN_PIECE = 64

_U = np.uint64
# arrays of one value: products of arrays wrap silently
_B1, _B2, _MIX = (np.array([x], np.uint64) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))


class Numbers(dict):
    """Numbers for words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _MIX
    return x ^ (x >> _U(29))


def rolled(h: np.ndarray, n: int, base: np.ndarray) -> np.ndarray:
    """Of each position the polynomial hash of n values from there on, by doubling."""
    out, have, at, length, power = None, 0, h, 1, base
    while True:
        if n & length:
            if out is None:
                out, have = at, length
            else:
                size = len(h) - have - length + 1
                # what is there already, then the next `length` values
                out = out[: max(size, 0)] * power + at[have : have + max(size, 0)] if size > 0 else at[:0]
                have += length
        if 2 * length > n:
            return out
        size = len(at) - length
        at = at[:size] * power + at[length : length + size] if size > 0 else at[:0]
        power, length = power * power, 2 * length


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    length = 1
    while 2 * length <= n:
        x = np.minimum(x[:-length], x[length:]) if len(x) > length else x[:0]
        length *= 2
    rest = n - length
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]


def repeated(ids: np.ndarray, at: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows (starts `at`, with their hashes) occur more than once by their words, and which of these aren't the first of their kind."""
    twice, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    todo = np.arange(len(at))
    while len(todo) > 1:
        order = todo[np.argsort(hashes[todo], kind="stable")]
        h = hashes[order]
        new = np.r_[True, h[1:] != h[:-1]]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        same = np.nonzero(~new)[0]
        a, b, alike = at[order[same]], at[head[same]], np.ones(len(same), bool)
        for j in range(k):
            alike &= ids[a + j] == ids[b + j]
        equal = same[alike]
        twice[order[equal]] = twice[head[equal]] = later[order[equal]] = True
        todo = np.sort(order[same[~alike]])  # equal hashes of unequal words: once more among themselves
    return twice, later


def spans(where: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive positions of one group: index of the first, and length."""
    if not len(where):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.nonzero(np.r_[True, (where[1:] != where[:-1] + 1) | (group[1:] != group[:-1])])[0]
    return first, np.diff(np.r_[first, len(where)])


_META = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("count", "<i4"), ("valid", "<i4")])
_SENT = "bucket int, words int, size int, packed binary, meta_size int, meta binary"
_SPANS = "doc_id long, text_key long, start int, count int"


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _pieces(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int | None, int, list[bytes]]]]:
    """Documents of at least k words (doc_id, text_key, words) in pieces of about PIECE_WORDS."""
    piece, held = [], 0
    for b in batches:
        for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            words = (text.as_py() or b"").split()
            if len(words) < k:
                continue
            piece.append((doc, key, words))
            held += len(words)
            if held >= PIECE_WORDS:
                yield piece
                piece, held = [], 0
    if piece:
        yield piece


def _numbered(piece: list) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Word numbers, word hashes, the words, and where documents start."""
    numbers, words = Numbers(), [w for _, _, ws in piece for w in ws]
    ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    of = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
    return ids, of[ids], words, np.cumsum([0, *(len(ws) for _, _, ws in piece)])


def heavy_grams(rows: DataFrame, k: int, m: int) -> tuple[np.ndarray, int]:
    """Hashes of the most frequent m-word grams, ascending, at most HEAVY_GRAMS of them; and the words of documents that have windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, k):
            hashes = _numbered(piece)[1]
            grams = mixed(rolled(hashes, m, _B1))
            # small hashes alone become minimisers of many windows
            found, n = np.unique(grams[grams < _U(1 << 61)], return_counts=True)
            often = n >= HEAVY_IN_PIECE
            grams, counts = found[often].view(np.int64), n[often]
            # the row of the null gram counts words
            yield pa.RecordBatch.from_arrays([pa.array([*grams.tolist(), None], pa.int64()), pa.array([*counts.tolist(), len(hashes)], pa.int64())], ["gram", "n"])

    top = rows.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.isnull("gram").desc(), F.col("n").desc(), "gram").limit(HEAVY_GRAMS + 1).collect()
    words = sum(r.n for r in top if r.gram is None)
    return np.sort(np.array([r.gram for r in top if r.gram is not None], np.int64).view(np.uint64)), words


def _sent(piece: list, k: int, m: int, heavy: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The packed strings of one piece by bucket, and the spans of windows that are settled here (in rows without words)."""
    ids, hashes, words, starts = _numbered(piece)
    n = len(ids) - k + 1
    grams = mixed(rolled(hashes, m, _B1))
    if len(heavy):
        is_heavy = heavy[np.minimum(np.searchsorted(heavy, grams), len(heavy) - 1)] == grams
        grams = (grams >> _U(1)) | (is_heavy.astype(np.uint64) << _U(63))
    least = sliding_min(grams, k - m + 1)
    doc_of = np.repeat(np.arange(len(piece), dtype=np.int32), np.diff(starts))
    at = np.nonzero(doc_of[:n] == doc_of[k - 1 :])[0]
    twice, later = repeated(ids, at, rolled(hashes, k, _B2)[at], k)
    docs = np.array([d or 0 for d, _, _ in piece], np.int64)
    keys = np.array([x for _, x, _ in piece], np.int64)
    valid = np.array([d is not None for d, _, _ in piece], np.int32)

    def meta(first: np.ndarray, count: np.ndarray) -> np.ndarray:
        out, d = np.empty(len(first), _META), doc_of[first]
        out["doc"], out["key"], out["valid"], out["start"], out["count"] = docs[d], keys[d], valid[d], first - starts[d], count
        return out

    codec, rows = _codec(), []
    settled = at[twice]
    i, length = spans(settled, doc_of[settled])
    if len(i):
        raw, step = meta(settled[i], length).tobytes(), (1 << 20) // _META.itemsize * _META.itemsize
        for j, a in enumerate(range(0, len(raw), step)):
            part = raw[a : a + step]
            rows.append(((int(keys[0] & 0xFFFF) + j) % buckets, 0, 0, b"", len(part), codec.compress(part, asbytes=True)))
    go = at[~later]
    mini = least[go]
    if len(go):
        cut = np.r_[True, (go[1:] != go[:-1] + 1) | (doc_of[go[1:]] != doc_of[go[:-1]]) | (mini[1:] != mini[:-1])]
        first = np.nonzero(cut)[0]
        within = np.arange(len(go)) - np.repeat(first, np.diff(np.r_[first, len(go)]))
        first = np.nonzero(within % RUN_WINDOWS == 0)[0]
        count = np.diff(np.r_[first, len(go)])
        bucket = (mixed(mini[first]) % _U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        first, count, bucket = go[first[order]], count[order], bucket[order]
        info = meta(first, count)
        edges = np.nonzero(np.r_[True, bucket[1:] != bucket[:-1], True])[0]
        froms, tos = first.tolist(), (first + count + k - 1).tolist()
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
            text = b"\n".join([b" ".join(words[f:t]) for f, t in zip(froms[a:z], tos[a:z])])
            raw = info[a:z].tobytes()
            rows.append((int(bucket[a]), int((count[a:z] + k - 1).sum()), len(text), codec.compress(text, asbytes=True), len(raw), codec.compress(raw, asbytes=True)))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in _SENT.split(", ")])


def _span_batch(info: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(info["doc"], mask=info["valid"] == 0), pa.array(info["key"]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SPANS.split(", ")])


def _counted(texts: list[bytes], infos: list[np.ndarray], k: int) -> pa.RecordBatch:
    """The spans of repeated windows of one bucket."""
    info = np.concatenate(infos)
    numbers = Numbers()
    words = b"\n".join(texts).split()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    del words
    count = info["count"].astype(np.int64)
    offset = np.cumsum(np.r_[0, count + k - 1])[:-1]
    run = np.repeat(np.arange(len(info)), count)
    within = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = offset[run] + within
    hashes = rolled(mixed((ids.astype(np.uint64) + _U(1)) * _B1), k, _B2)[at]
    twice, _ = repeated(ids, at, hashes, k)
    hit = np.nonzero(twice)[0]
    i, length = spans(at[hit], run[hit])
    which = run[hit[i]]
    return _span_batch(info[which], info["start"][which] + within[hit[i]], length)


def repeated_windows(rows: DataFrame, k: int = 35, m: int = 3) -> DataFrame:
    """doc_id, text_key, start, count: runs of windows (numbers of their first words) that occur more than once. rows: doc_id, text_key, text (binary)."""
    n_parts = partitions(rows.sparkSession)
    heavy, n_words = heavy_grams(rows, k, m)
    buckets = max(n_parts * BUCKETS_PER_PARTITION, -(-n_words // BUCKET_WORDS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, k):
            yield _sent(piece, k, m, heavy, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, texts, infos = _codec(), None, [], []
        for b in batches:
            for bucket, n, size, packed, meta_size, meta in zip(*(c.to_pylist() for c in b.columns)):
                info = np.frombuffer(codec.decompress(meta, meta_size, asbytes=True), _META)
                if not n:
                    yield _span_batch(info, info["start"], info["count"])
                    continue
                if bucket != now and texts:
                    yield _counted(texts, infos, k)
                    texts, infos = [], []
                now = bucket
                texts.append(codec.decompress(packed, size, asbytes=True))
                infos.append(info)
        if texts:
            yield _counted(texts, infos, k)

    sent = rows.mapInArrow(send, _SENT)
    return sent.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, _SPANS)


def remove_repeats(docs: DataFrame, k: int = 35, m: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by single spaces; as binary) of every row."""
    rows = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    found = repeated_windows(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text_key", "text"), k, m)
    by_row = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "count")).alias("spans"))
    by_row = by_row.select(F.col("doc_id").alias("span_doc"), F.col("text_key").alias("span_key"), F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["count"]).alias("counts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts, counts in zip(b.column(1), b.column(2), b.column(3)):
                words, starts = (text.as_py() or b"").split(), starts.as_py()
                if starts:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, np.array(starts), 1)
                    np.add.at(edge, np.array(starts) + np.array(counts.as_py()) + k - 1, -1)
                    stays = (np.cumsum(edge[:-1]) == 0).tolist()
                    left = [w for w, s in zip(words, stays) if s]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    met = rows.join(by_row, rows["doc_id"].eqNullSafe(by_row["span_doc"]) & (rows["text_key"] == by_row["span_key"]), "left")
    return met.select("doc_id", "text", "starts", "counts").mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept binary")
