"""Token ids as flat binary files with 64-bit offsets.

Rows are dealt to partitions by ranges of doc_id, so that partition after partition
the documents ascend. Each task encodes its texts and writes three files: `.bin`, the
ids as unsigned little-endian integers of 2 or 4 bytes (as the vocabulary needs);
`.idx`, n + 1 offsets into it as unsigned 64-bit integers; and `.doc`, the doc_ids as
64-bit integers, then one byte each that is 0 for a null id. A file appears under
its name only when whole, so a task that is run again leaves the same file. The
token counts that tasks report are summed up to the partitions' bases: the offsets
of a document among all are base + offset.

The files go to `out`, which executors must share; any file system that
pyarrow.fs opens will do, and on a local or mounted one they are memory-mapped.

The distinct words between ASCII white space are encoded once per group of texts: the
tokenizer must be one that drops white space and has no rule that spans it, as this one
is; then a text's ids are its words' ids in order (checked against whole texts in the
tests; `write_tokens` refuses a tokenizer that fails on a probe text).

Defined results: a null or empty text has only the end id; bytes that are no UTF-8 are
read as U+FFFD, as Python's "replace" does; null doc_ids come first;
rows of one doc_id are ordered by their text hash; an empty table gives no files
and an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import partitions, text_key

#: Stems of words of which a worker keeps the ids.
CACHE_STEMS = 1_000_000
MANIFEST = "part int, n_docs long, n_tokens long, base long, width int"
_encoders: dict[tuple[str, int], Encoder] = {}


#: A text that a tokenizer must encode as it does its words one by one.
PROBE = "The  quick,\tbrown fox's\n\n42 jumps -- \u00c9t\u00e9 x.y (it's) don't!"


def vocabulary_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes that an id takes. An error if the tokenizer doesn't encode word by word."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    whole, *words = (e.ids for e in tokenizer.encode_batch([PROBE, *PROBE.split()], add_special_tokens=False))
    if whole != list(chain.from_iterable(words)):
        raise ValueError("the tokenizer's ids of a text are not those of its words: white space matters to it")
    return 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


class Encoder:
    """Texts to ids of one width, over the distinct words of many texts at once.

    Splitting, finding the distinct words and cutting each into a stem and the marks
    `.,;:!?` at its end are Arrow kernels. Stems of letters alone are encoded many at a
    time, as one text: each gives one piece to the tokenizer, whose last token carries
    the end-of-word suffix, which tells where its ids end. Where the count of such
    tokens is not that of the stems, and for all other words, each is encoded by
    itself. The ids of stems met before are kept, up to CACHE_STEMS of them. A text's ids
    are gathered from those of its words.
    """

    MARKS = b".,;:!?"

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kind = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.stems, self.stem_ids = pa.array([], pa.string()), Ragged.empty(self.kind)

    def each(self, words: pa.Array) -> Ragged:
        """Ids of words, each encoded by itself."""
        parts = []
        for a in range(0, len(words), 4096):
            found = self.tokenizer.encode_batch_fast(words[a : a + 4096].to_pylist(), add_special_tokens=False)
            parts.append(Ragged.of([e.ids for e in found], self.kind))
        return Ragged.chained(parts, self.kind)

    def _together(self, stems: pa.Array) -> Ragged:
        """Ids of distinct words of letters alone."""
        parts = []
        for a in range(0, len(stems), 20_000):
            some = stems[a : a + 20_000]
            found = self.tokenizer.encode_batch_fast([" ".join(some.to_pylist())], add_special_tokens=False)[0].ids
            ids = np.array(found, self.kind)
            edges = np.flatnonzero(self.ends[ids]) + 1
            fits = len(edges) == len(some) and edges[-1] == len(ids)
            parts.append(Ragged(ids, np.r_[0, edges]) if fits else self.each(some))
        return Ragged.chained(parts, self.kind)

    def _known(self, stems: pa.Array) -> Ragged:
        """Ids of distinct stems, those met before from the cache."""
        at = pc.index_in(stems, value_set=self.stems)
        new = stems.filter(pc.is_null(at))
        found = self._together(new)
        if len(self.stems) + len(new) > CACHE_STEMS:
            kept = self.stem_ids.take(at.drop_null().to_numpy())
            self.stems = stems.filter(pc.is_valid(at))
            self.stem_ids = kept
        self.stems = pa.concat_arrays([self.stems, new])
        self.stem_ids = Ragged.chained([self.stem_ids, found], self.kind)
        return self.stem_ids.take(pc.index_in(stems, value_set=self.stems).to_numpy())

    def _tails(self, words: pa.Array, length: np.ndarray) -> tuple[np.ndarray, Ragged]:
        """Which of the distinct tails each word has, being its last `length` (8 at most) bytes, and the ids of these tails; the first is empty."""
        bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        raw, code = np.frombuffer(words.buffers()[2], np.uint8), np.zeros(len(words), np.uint64)
        for i in range(int(length.max(initial=0))):
            has = length > i
            code[has] = code[has] << np.uint64(8) | raw[bounds[1:][has] - length[has] + i]
        kinds, which = np.unique(np.r_[np.uint64(0), code], return_inverse=True)
        tails = pa.array([int(c).to_bytes(8, "big").lstrip(b"\0").decode() for c in kinds])
        return which[1:], self.each(tails)

    def _words(self, words: pa.Array) -> Ragged:
        """Ids of distinct words."""
        stems = pc.ascii_lower(pc.ascii_rtrim(words, characters=self.MARKS.decode()))  # A-Z alone: the tokenizer lowers the rest
        length = (pc.binary_length(words).to_numpy() - pc.binary_length(stems).to_numpy()).astype(np.int32)
        plain = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) & (length <= 8)
        mask = pa.array(plain)
        distinct = stems.filter(mask).dictionary_encode()
        which, tails = self._tails(words.filter(mask), length[plain])
        glued = self._known(distinct.dictionary).take(distinct.indices.to_numpy()).glued(tails.take(which))
        rest = self.each(words.filter(pc.invert(mask)))
        order = np.empty(len(words), np.int64)
        order[plain], order[~plain] = np.arange(plain.sum()), plain.sum() + np.arange((~plain).sum())
        return Ragged.chained([glued, rest], self.kind).take(order)

    def encode(self, texts: list[bytes], end_id: int) -> Ragged:
        """Ids of each text, the end id included. Bytes that are no UTF-8 are read as U+FFFD."""
        try:
            column = pa.array(texts, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
        split = pc.ascii_split_whitespace(column)
        words = split.flatten().dictionary_encode()
        table = Ragged.chained([self._words(words.dictionary), Ragged.of([[end_id]], self.kind)], self.kind)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        order = np.insert(words.indices.to_numpy().astype(np.int64), bounds[1:], len(table) - 1)
        taken = table.take(order)
        return Ragged(taken.values, taken.edges[bounds + np.arange(len(bounds))])


@dataclass
class Ragged:
    """Rows of different lengths: row i is values[edges[i] : edges[i + 1]]."""

    values: np.ndarray
    edges: np.ndarray

    def __len__(self) -> int:
        return len(self.edges) - 1

    @classmethod
    def empty(cls, kind: np.dtype) -> Ragged:
        return cls(np.empty(0, kind), np.zeros(1, np.int64))

    @classmethod
    def of(cls, rows: list[list[int]], kind: np.dtype) -> Ragged:
        return cls(np.fromiter(chain.from_iterable(rows), kind), np.cumsum([0, *map(len, rows)]))

    @classmethod
    def chained(cls, parts: list[Ragged], kind: np.dtype) -> Ragged:
        """The rows of all parts, one after the other."""
        bases = np.cumsum([0, *(len(p.values) for p in parts)])
        values = np.concatenate([np.empty(0, kind), *(p.values for p in parts)])
        return cls(values, np.concatenate([[0], *(p.edges[1:] + b for p, b in zip(parts, bases))]).astype(np.int64))

    def take(self, which: np.ndarray) -> Ragged:
        """The rows of these numbers, in their order."""
        length = np.diff(self.edges)[which]
        edges = np.zeros(len(which) + 1, np.int64)
        np.cumsum(length, out=edges[1:])
        at = np.repeat(self.edges[which] - edges[:-1], length)
        at += np.arange(len(at))
        return Ragged(self.values[at], edges)

    def glued(self, other: Ragged) -> Ragged:
        """Row by row, those of self followed by those of other."""
        both = Ragged(np.concatenate([self.values, other.values]), np.concatenate([self.edges, other.edges[1:] + len(self.values)]))
        n = len(self)
        taken = both.take(np.stack([np.arange(n), np.arange(n) + n], 1).ravel())
        return Ragged(taken.values, taken.edges[::2])


def encoder(path: str, width: int) -> Encoder:
    """The worker's encoder: it outlives the task."""
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def _in_groups(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[tuple[list[int | None], list[bytes]]]:
    ids, texts, held = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        t = t.as_py() or b""
        ids.append(i)
        texts.append(t)
        held += len(t)
        if held >= most_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the files below out and returns their manifest, one row per partition that has documents."""
    spark, width = docs.sparkSession, vocabulary_width(tokenizer_path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path, width)
        store, top = fs.FileSystem.from_uri(out)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store.create_dir(top, recursive=True)
        offsets, names, valid, now = [0], [], [], 0
        temporary = f"{top}/.{part:06d}-{attempt}"
        with store.open_output_stream(f"{temporary}.bin") as f:
            for batch in batches:
                for ids, texts in _in_groups(batch):
                    tokens = words.encode(texts, end_id)
                    f.write(tokens.values.tobytes())
                    offsets.extend((tokens.edges[1:] + now).tolist())
                    now += len(tokens.values)
                    names.extend(i or 0 for i in ids)
                    valid.extend(i is not None for i in ids)
        if not names:
            store.delete_file(f"{temporary}.bin")
            return
        with store.open_output_stream(f"{temporary}.idx") as f:
            f.write(np.array(offsets, "<u8").tobytes())
        with store.open_output_stream(f"{temporary}.doc") as f:
            f.write(np.array(names, "<i8").tobytes() + np.array(valid, np.uint8).tobytes())
        for kind in ("idx", "doc", "bin"):
            store.move(f"{temporary}.{kind}", f"{top}/{part:06d}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([now], pa.int64())})

    order = [F.col("doc_id").asc_nulls_first(), F.col("key").asc()]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_key().alias("key"))
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    parts = dealt.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, n_docs long, n_tokens long").collect()  # one row per partition
    rows_, base = [], 0
    for r in sorted(parts):
        rows_.append((r.part, r.n_docs, r.n_tokens, base, width))
        base += r.n_tokens
    return spark.createDataFrame(rows_, MANIFEST)


def mapped(store: fs.FileSystem, path: str) -> pa.Buffer:
    """A file's bytes, memory-mapped where the file system is a local one."""
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with store.open_input_file(path) as f:
        return f.read_buffer()


def read_tokens(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(out)
        for b in batches:
            for r in b.to_pylist():
                name, n = f"{top}/{r['part']:06d}", r["n_docs"]
                ids = np.frombuffer(mapped(store, f"{name}.bin"), f"<u{r['width']}")
                offsets = np.frombuffer(mapped(store, f"{name}.idx"), "<u8").astype(np.int64)
                doc = mapped(store, f"{name}.doc")
                names, valid = np.frombuffer(doc, "<i8", n), np.frombuffer(doc, np.uint8, n, 8 * n)
                crc = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(offsets[:-1], offsets[1:])]
                columns = [pa.array(names, mask=valid == 0), pa.array(offsets[:-1] + r["base"]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(partitions(spark), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
