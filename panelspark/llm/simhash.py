"""SimHash near-duplicate groups, found with pivot distance tables.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of the
XXH64 values (seed 42) of its word shingles, repeats included. Fingerprints link
at `max_bits` differing bits or fewer, and a document's component is the
smallest doc_id that it reaches over links.

How pairs are found: equal fingerprints are merged first, so copies cost one row.
The table of each one's Hamming distances to the pivots, reference fingerprints that are
the same in every run, is computed once and goes with it. The 64 bits are cut into
blocks; two fingerprints within `max_bits` agree on all but `max_bits` blocks, so every
choice of that many blocks is a bucket key and no link is lost. A bucket is sorted by its
distance to the first pivot, so that only neighbours in that coordinate meet; the other
coordinates discard pairs whose largest difference exceeds `max_bits` (triangle
inequality), and survivors are verified bit by bit. A bucket returns a spanning
set of its links, never more of them than it has rows.

Defined results: a null or wordless text has fingerprint zero and links like any
other; fewer words than a shingle count as one shingle; repeated rows come back
repeated; null doc_ids never become a component's id unless nothing else is
reachable (then it is null); an empty table gives an empty result. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import carried, partitions, text_key, written

BITS = 64


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer."""
    w = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    n, digest = len(w) - words + 1, xxhash.xxh64_intdigest
    h = np.fromiter((digest(b" ".join(s), 42) for s in zip(*(w[i:] for i in range(words)))), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and the signed 64-bit `fp` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(max_bits: int, spare: int = 4) -> list[int]:
    """Masks of which at least one agrees wholly between any two values within max_bits: all choices of `spare` blocks of max_bits + spare."""
    blocks = max_bits + spare
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(each, spare)]


def pivots(n: int) -> list[int]:
    """n reference fingerprints, the same in every run."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), 0) for i in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def bucket_links(fps: np.ndarray, table: np.ndarray, max_bits: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links of one bucket. fps: distinct, unsigned, ascending by table[:, 0], the distance to the first pivot."""
    parent, near = np.arange(len(fps)), table[:, 0].astype(np.int16)
    for a in range(0, len(fps), block):
        z = min(a + block, len(fps))
        last = np.searchsorted(near, near[z - 1] + max_bits, side="right")
        for c in range(a, last, 4 * block):
            d = min(c + 4 * block, last)
            i, j = np.nonzero(np.abs(near[a:z, None] - near[None, c:d]) <= max_bits)
            i, j = i + a, j + c
            keep = i < j
            i, j = i[keep], j[keep]
            for p in range(1, table.shape[1]):
                keep = np.abs(table[i, p].astype(np.int16) - table[j, p]) <= max_bits
                i, j = i[keep], j[keep]
            keep = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
            i, j = parent[i[keep]], parent[j[keep]]
            for x, y in np.unique(np.stack([i[i != j], j[i != j]], 1), axis=0).tolist():
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
            parent = _roots(parent)
    moved = np.nonzero(parent != np.arange(len(fps)))[0]
    return fps[moved], fps[parent[moved]]


def pivot_table(values: DataFrame, n_pivots: int = 16) -> DataFrame:
    """fp and `distances`, one byte for each pivot, of the values in column fp."""
    refs = np.array(pivots(n_pivots), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = np.bitwise_count(b.column(0).to_numpy().view(np.uint64)[:, None] ^ refs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.tobytes() for t in table], pa.binary())], ["fp", "distances"])

    return values.select("fp").mapInArrow(run, "fp long, distances binary")


def links(values: DataFrame, max_bits: int = 2, n_pivots: int = 16) -> DataFrame:
    """Links `u`, `v` that span every component of the distinct values in column fp."""
    masks = block_masks(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            """Works through whole buckets."""
            which, key, fps, table = (np.concatenate(x) for x in zip(*parts))
            start = np.nonzero(np.r_[True, (which[1:] != which[:-1]) | (key[1:] != key[:-1])])[0]
            end, found = np.r_[start[1:], len(key)], []
            for a, z in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist()):
                order = np.argsort(table[a:z, 0], kind="stable")
                found.append(bucket_links(fps[a:z][order], table[a:z][order], max_bits))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).view(np.int64)) for k in (0, 1)], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            table = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            now = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64), table)
            which, key = now[:2]
            last = (which == which[-1]) & (key == key[-1])
            n = int(np.argmax(last))  # rows before the batch's last bucket
            if n or (held and (held[-1][0][-1], held[-1][1][-1]) != (which[0], key[0])):
                yield from out([*held, *([tuple(x[:n] for x in now)] if n else [])])
                held = []
            held.append(tuple(x[n:] for x in now))
        if held:
            yield from out(held)

    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = pivot_table(values, n_pivots).select("fp", "distances", keys.alias("k")).select("k.mask", "k.key", "fp", "distances")
    dealt = rows.repartition(partitions(values.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(run, "u long, v long")


#: Parts that the rows of one key are dealt to.
SALTS = 16


def with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with `least`, the smallest value among those of their key. A key of very many rows is spread over SALTS tasks."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "__salt").agg(F.min(value).alias("__least"))
    least = parts.groupBy(key).agg(F.min("__least").alias("least"))
    return salted.join(parts.select(key, "__salt").join(least, key), [key, "__salt"]).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """`node` and `root` (the smallest node reachable) of every node that has an edge u, v.

    Alternates the large-star and small-star steps, each a grouped minimum and a
    join, and writes the edges out after each round; the number of rounds grows with
    the logarithm of the longest path.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return with_least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = with_least(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "u", "v")
        hung = down.select(F.col("v").alias("u"), F.col("least").alias("v")).union(down.select("u", F.col("least").alias("v")))
        return hung.where("u != v").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    before = mark(now)
    while before[0]:
        now = written(small(large(now)), "stars")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fp_components(fps: DataFrame, max_bits: int = 2, n_pivots: int = 16, least: Column | None = None) -> DataFrame:
    """`fp` and `component_id`, the smallest doc_id (or value of `least`) of the component, for every distinct fp of a written table doc_id, fp."""
    least = F.col("doc_id") if least is None else least
    classes = written(fps.groupBy("fp").agg(F.min(least).alias("rep")), "classes")
    roots = components(links(classes, max_bits, n_pivots))
    # roots themselves are no node of the stars, so they stand for themselves
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    return with_least(rooted, "root", "rep").select("fp", F.col("least").alias("component_id"))


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 2, n_pivots: int = 16) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs."""
    fps = written(fingerprints(docs, words), "fingerprints")
    return fps.join(fp_components(fps, max_bits, n_pivots), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_ODD = np.array([xxhash.xxh64_intdigest(f"lane {i}".encode(), 0) | 1 for i in range(32)], np.uint64)


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """The XXH64 values of a text's distinct shingles, ascending; a text of fewer words is one shingle, a wordless one has none."""
    w = (text or b"").lower().split()
    n, digest = max(1, len(w) - words + 1) if w else 0, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(w[i : i + words]), 42) for i in range(n)), np.uint64, n))


def wide_bits(h: np.ndarray, lanes: int = 8) -> bytes:
    """A fingerprint of lanes * 64 bits of a set of hashes: each lane is a SimHash under another mixing of them."""
    ones = np.zeros(lanes * BITS, np.int64)
    for a in range(0, len(h), 1 << 13):
        x = h[a : a + (1 << 13), None] * _ODD[:lanes]
        x ^= x >> np.uint64(29)
        x *= _ODD[lanes : 2 * lanes]
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes()


def wide_fingerprint(text: bytes | None, words: int = 5, lanes: int = 8) -> bytes:
    """`wide_bits` of a text's distinct shingles."""
    return wide_bits(shingle_set(text, words), lanes)


def most_differing(bits: int, similarity: float, deviations: float = 2.5) -> int:
    """Bits that may differ at a Jaccard similarity: equal sets of it have cosine 2 s / (1 + s), and a bit differs with probability angle / pi; so many standard deviations are allowed on top."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def _near(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= limit


def nearest_links(nodes: np.ndarray, lanes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of fewest differing bits among the pairs of one large bucket that are within limit (Prim's algorithm, one row of distances at a time)."""
    at, row, other = 0, lanes[0], lanes[1:].copy()
    rest, bits, via = np.arange(1, len(nodes)), np.full(len(nodes) - 1, limit + 1), np.zeros(len(nodes) - 1, np.int64)
    u, v = [], []
    while len(rest):
        now = np.bitwise_count(other ^ row).sum(1, dtype=np.int64)
        closer = now < bits
        bits[closer], via[closer] = now[closer], at
        k = int(bits.argmin())
        at, row = int(rest[k]), other[k].copy()
        if bits[k] <= limit:
            u.append(int(via[k]))
            v.append(at)
        for c in (rest, bits, via, other):
            c[k] = c[-1]
        rest, bits, via, other = rest[:-1], bits[:-1], via[:-1], other[:-1]
    return nodes[u], nodes[v]


def wide_links(values: DataFrame, similarity: float = 0.8, band_bits: int = 16, sketch_lanes: int = 4, small: int = 16) -> DataFrame:
    """Candidate links `u`, `v` between rows node, wide (distinct) that share a band of band_bits and whose first sketch_lanes lanes differ in few enough bits.

    With 48 bands of 16 bits a pair of similarity 0.8 shares one with probability 0.97, one
    of 0.9 with probability 0.9999. A bucket of up to `small` rows gives all its candidates, a larger one
    the spanning forest of its nearest ones.
    """
    limit = most_differing(sketch_lanes * BITS, similarity)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            keys = raw.view(f"<u{band_bits // 8}").astype(np.int64)
            keys += np.arange(keys.shape[1], dtype=np.int64) << band_bits
            sketch = [x.tobytes() for x in raw[:, : 8 * sketch_lanes]]
            nodes = np.repeat(b.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes), pa.array([s for s in sketch for _ in range(keys.shape[1])], pa.binary())], ["key", "node", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            """Works through whole buckets."""
            k, x, m = (np.concatenate(c) for c in zip(*parts))
            n = len(k)
            start = np.nonzero(np.r_[True, k[1:] != k[:-1]])[0]
            size = np.diff(np.r_[start, n])
            of = np.repeat(size, size)
            u, v = [], []
            for shift in range(1, small):  # pairs of small buckets, all at once for each distance
                i = np.nonzero((k[:-shift] == k[shift:]) & (of[:-shift] <= small))[0] if n > shift else np.empty(0, np.int64)
                if not len(i):
                    break
                i = i[np.bitwise_count(m[i, 0] ^ m[i + shift, 0]) <= limit]
                i = i[_near(m[i], m[i + shift], limit)]
                u.append(x[i])
                v.append(x[i + shift])
            for a, many in zip(start[size > small].tolist(), size[size > small].tolist()):
                p, q = nearest_links(x[a : a + many], m[a : a + many], limit)
                u.append(p)
                v.append(q)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            now = (b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), "<u8").reshape(b.num_rows, -1))
            n = int(np.argmax(now[0] == now[0][-1]))  # rows before the batch's last bucket
            if n or (held and held[-1][0][-1] != now[0][0]):
                yield from out([*held, *([tuple(c[:n] for c in now)] if n else [])])
                held = []
            held.append(tuple(c[n:] for c in now))
        if held:
            yield from out(held)

    rows = values.select("node", "wide").mapInArrow(bands, "key long, node long, sketch binary")
    return rows.repartition(partitions(values.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The pairs u, v whose sets (node, shingles) have a Jaccard similarity of at least `similarity`, counted exactly."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("u", "v"))
    both = pairs.join(left, "u").join(right, "v")
    shared, total = F.size(F.array_intersect("of_u", "of_v")), F.size("of_u") + F.size("of_v")
    counted = both.select("u", "v", shared.alias("shared"), total.alias("total"))
    return counted.where(F.try_divide(F.col("shared"), F.col("total") - F.col("shared")) >= similarity).select("u", "v")


#: Bits of a hash that travel where rows meet by it.
TOKEN_BITS = 40
#: Counters of shingles; a shingle's is its hash modulo their number, a power of two.
SLOTS = 1 << 22


def shingle_classes(texts: DataFrame, words: int = 5) -> np.ndarray:
    """A byte for each of SLOTS: the logarithm to base 1.07 of the number of rows whose set has a shingle there (255 of a task's at most). The rows' column is text (binary).

    With the texts slots fill up by chance, by n +- sqrt(n) for each; classes as fine as that still tell a shingle of 2 sqrt(n) rows from one of a single row.
    """
    part = min(SLOTS, 1 << 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.uint32)
        for b in batches:
            for x in b.column(0):
                np.add.at(n, shingle_set(x.as_py(), words) & np.uint64(SLOTS - 1), 1)
        n = np.minimum(n, 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS // part), pa.int32()), pa.array([zlib.compress(n[a : a + part].tobytes(), 1) for a in range(0, SLOTS, part)], pa.binary())], ["part", "n"])

    def total(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, at = np.zeros(part, np.uint64), None
        for t in tables:
            at = t.column("part")[0]
            for x in t.column("n"):
                n += np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        bits = np.minimum(255, np.rint(np.log1p(n.astype(np.float64)) / math.log(1.07))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    rows = texts.select("text").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(total, "part int, bits binary").collect()  # SLOTS bytes
    out = np.zeros(SLOTS, np.uint8)
    for r in rows:
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["bits"], np.uint8)
    return out


def prefix(h: np.ndarray, classes: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest hashes of a set, by (class, hash): so many that two sets of that similarity have one of them in common."""
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    return h[np.argsort(classes[h & np.uint64(len(classes) - 1)], kind="stable")[:n]] if len(h) else h


def prefix_pairs(sets: DataFrame, similarity: float = 0.8, small: int = 16, block: int = 256) -> DataFrame:
    """Every pair `u`, `v` of rows node, root, size, prefix of unequal root whose sets can have a Jaccard similarity of at least `similarity`; some come more than once.

    Such sets have a hash of their prefixes in common. At the first in the common order what follows it in either set bounds
    the number they share, and their sizes differ little; these two bounds discard the other rows of its bucket. A bucket is
    sorted by size and worked through in blocks. What travels for each hash is its low TOKEN_BITS (two hashes that agree in them only
    make a candidate more), and the root as its difference from the node, zero for most rows.
    """
    names, low = ["token", "size", "at", "node", "root"], (1 << TOKEN_BITS) - 1

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x, "<i8") for x in b.column(3).to_pylist()]
            n = np.array([len(x) for x in found], np.int64)
            if n.sum():
                node, root = b.column(0).to_numpy(), b.column(1).to_numpy()
                each = lambda x: np.repeat(x, n)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(found) & low, each(b.column(2).to_numpy()), np.concatenate([np.arange(m, dtype=np.int32) for m in n]), each(node), each(node ^ root))], names)

    def fit(i: tuple, j: tuple) -> np.ndarray:
        least = np.ceil(similarity / (1 + similarity) * (i[1].astype(np.int64) + j[1]) - 1e-9)
        sizes = np.minimum(i[1], j[1]) >= np.ceil(similarity * np.maximum(i[1], j[1]) - 1e-9)
        return (i[4] != j[4]) & sizes & (np.minimum(i[1] - i[2], j[1] - j[2]) >= least)

    def pair(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            """Works through whole buckets."""
            c = tuple(np.concatenate(x) for x in zip(*parts))
            k = c[0]
            start = np.nonzero(np.r_[True, k[1:] != k[:-1]])[0]
            size = np.diff(np.r_[start, len(k)])
            for shift in range(1, small):
                i = np.nonzero((k[:-shift] == k[shift:]) & (np.repeat(size, size)[:-shift] <= small))[0] if len(k) > shift else np.empty(0, np.int64)
                if not len(i):
                    break
                i = i[fit(tuple(x[i] for x in c), tuple(x[i + shift] for x in c))]
                yield pair(c[3][i], c[3][i + shift])
            for a, many in zip(start[size > small].tolist(), size[size > small].tolist()):
                rows = tuple(x[a : a + many] for x in c)
                if (rows[4] == rows[4][0]).all():
                    continue
                for at in range(0, many, block):
                    one = tuple(x[at : at + block] for x in rows)
                    last = np.searchsorted(rows[1], one[1][-1] / similarity + 1, side="right")
                    for to in range(at, last, 16 * block):
                        more = tuple(x[to : min(to + 16 * block, last)] for x in rows)
                        i, j = np.nonzero(fit(tuple(x[:, None] for x in one), tuple(x[None, :] for x in more)))
                        later = i + at < j + to
                        yield pair(one[3][i[later]], more[3][j[later]])

        for b in batches:
            if not b.num_rows:
                continue
            now = tuple(b.column(i).to_numpy() for i in range(len(names)))
            now = (*now[:4], now[3] ^ now[4])
            n = int(np.argmax(now[0] == now[0][-1]))  # rows before the batch's last bucket
            if n or (held and held[-1][0][-1] != now[0][0]):
                yield from out([*held, *([tuple(c[:n] for c in now)] if n else [])])
                held = []
            held.append(tuple(c[n:] for c in now))
        if held:
            yield from out(held)

    rows = sets.select("node", "root", "size", "prefix").mapInArrow(tokens, "token long, size int, at int, node long, root long")
    return rows.repartition(partitions(sets.sparkSession), "token").sortWithinPartitions("token", "size").mapInArrow(run, "u long, v long")


def similar_texts(pairs: DataFrame, texts: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """The pairs u, v whose texts (node, text as binary) have shingle sets of a Jaccard similarity of at least `similarity`, counted exactly.

    Texts travel, which take a fraction of their sets' bytes, and the tasks make the sets; one of the two sides comes in runs of one node.
    """
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"of_{c}")) for c in ("u", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, of = None, shingle_set(None)
        for b in batches:
            u, v, fit = b.column(0).to_numpy(), b.column(1).to_numpy(), np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                if v[i] != node:
                    node, of = v[i], shingle_set(b.column(3)[i].as_py(), words)
                other = shingle_set(b.column(2)[i].as_py(), words)
                shared = len(np.intersect1d(of, other, assume_unique=True))
                total = len(of) + len(other) - shared
                fit[i] = total > 0 and shared / total >= similarity
            yield pa.RecordBatch.from_arrays([pa.array(u[fit]), pa.array(v[fit])], ["u", "v"])

    both = pairs.join(left, "u").join(right, "v").select("u", "v", "of_u", "of_v")
    return both.mapInArrow(run, "u long, v long")


#: Rows of a filter; each has 64 bits.
FILTER_ROWS = 1 << 18


def flagged(rows: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """rows with `may`, which is true for all rows whose key (a hash) is among the values of members' one column, and for few others.

    The filter has FILTER_ROWS * 64 bits whatever the tables' size, and goes to all tasks: what it
    keeps back needs no shuffle. An exact step follows for the rest.
    """
    slot, bit = (lambda c: c.bitwiseAND(F.lit(FILTER_ROWS - 1))), (lambda c: F.shiftright(c, 48).bitwiseAND(F.lit(63)).cast("int"))
    h = F.col(members.columns[0])
    words = members.select(slot(h).alias("__slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(h)).alias("__bits")).groupBy("__slot").agg(F.bit_or("__bits").alias("__bits"))
    held = rows.withColumn("__h", key).withColumn("__slot", slot(F.col("__h"))).join(F.broadcast(words), "__slot", "left")  # FILTER_ROWS at most
    return held.withColumn("may", F.coalesce(F.getbit("__bits", bit(F.col("__h"))) == 1, F.lit(False))).drop("__h", "__slot", "__bits")


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5, lanes: int = 12) -> DataFrame:
    """docs without all but one row of each near-duplicate group: the one of smallest doc_id (nulls last), then of smallest text hash.

    Documents are linked by `simhash_components`' rule (three words, repeats included, two bits), and where their
    sets of `words`-word shingles have a Jaccard similarity of at least `similarity`. First wide fingerprints
    propose such pairs, which joins most of them cheaply; then all pairs that aren't joined yet and have a hash of their prefixes in common
    are met, so that none is left out. The sets (of 64-bit hashes) decide. Both kinds of
    fingerprint are nodes of one graph, a document an edge between its two; nodes are 64-bit hashes.
    """
    keys = ["__id", "__null", "__key"]
    kind = "struct<last:boolean,id:" + docs.schema["doc_id"].dataType.simpleString() + ",key:bigint>"
    classes = shingle_classes(docs.select(F.col("text").cast("binary").alias("text")), words)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, wides, sizes, prefixes = np.zeros(b.num_rows, np.uint64), [], [], []
            for i, x in enumerate(b.column(1)):  # a text at a time
                text = x.as_py()
                h = shingle_set(text, words)
                fps[i] = fingerprint(text)
                wides.append(wide_bits(h, lanes))
                sizes.append(len(h))
                prefixes.append((prefix(h, classes, similarity) & np.uint64((1 << TOKEN_BITS) - 1)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array(wides, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary())], ["k", "fp", "wide", "size", "prefix"])

    rows = docs.select(F.struct(F.isnull("doc_id").alias("last"), F.col("doc_id").alias("id"), text_key().alias("key")).alias("k"), F.col("text").cast("binary").alias("text"))
    table = written(rows.mapInArrow(both, f"k {kind}, fp long, wide binary, size int, prefix binary"), "fingerprints", "zstd").withColumn("node", F.xxhash64("wide", F.lit(5)))
    nodes = written(table.groupBy("node").agg(F.min("k").alias("k"), F.count("*").alias("n")), "nodes")
    repeated = nodes.where("n > 1").select("node")
    whole = carried(docs, "doc_id").select("__row", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.isnull("doc_id").alias("__null"), text_key("__row.text").alias("__key"))
    hashed = F.xxhash64(*keys)

    def keyed(firsts: DataFrame, *more: str) -> DataFrame:
        return firsts.select(F.coalesce(F.col("k.id").cast("string"), F.lit("")).alias("__id"), F.col("k.last").alias("__null"), F.col("k.key").alias("__key"), *more)

    def alike(found: DataFrame) -> DataFrame:
        """The pairs whose sets are similar."""
        pairs = written(found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
        met = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        samples = written(keyed(nodes.join(met, "node", "left_semi"), "node"), "samples")
        near = flagged(whole, hashed, samples.select(hashed)).where("may")
        texts = near.select(*keys, F.col("__row.text").cast("binary").alias("text")).join(samples, keys).dropDuplicates(["node"]).select("node", "text")
        return similar_texts(pairs, texts, similarity, words)

    def rooted(nodes: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """nodes with their root; one that has none stands for itself."""
        named = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        return nodes.join(named, nodes[name] == named["__node"], "left").withColumn("root", F.coalesce("__root", name)).drop("__node", "__root")

    # texts of one narrow fingerprint, and of two that are close
    firsts = written(table.groupBy("fp").agg(F.min("node").alias("u"), F.max("node").alias("most")), "firsts")
    shared = firsts.where("u != most").select("fp", "u")
    same = flagged(table, F.xxhash64("fp"), shared.select(F.xxhash64("fp"))).where("may").select("fp", F.col("node").alias("v")).distinct().join(shared, "fp").select("u", "v")
    first = lambda c, to: firsts.select(F.col("fp").alias(c), F.col("u").alias(to))
    close = links(firsts).join(first("u", "__u"), "u").join(first("v", "__v"), "v").select(F.col("__u").alias("u"), F.col("__v").alias("v"))
    likely = wide_links(table.select("node", "wide").dropDuplicates(["node"]), similarity)
    roots = components(same.union(close).union(alike(likely)))
    # a node that is in no group yet and has one row goes on as it is
    ahead = flagged(table.select("node", "size", "prefix"), F.col("node"), roots.select("node").union(repeated))
    some = ahead.where("may").groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    sets = ahead.where("not may").select("node", F.col("node").alias("root"), "size", "prefix").union(rooted(some, roots, "node").select("node", "root", "size", "prefix"))
    rest = alike(prefix_pairs(sets, similarity))
    for c in ("u", "v"):
        rest = rooted(rest, roots, c).drop(c).withColumnRenamed("root", c)
    joined = components(rest)
    groups = written(rooted(roots.withColumnRenamed("root", "first"), joined, "first").select("node", "root").union(joined.select("node", "root")), "groups")
    # rows of groups of one row are kept and don't travel
    many = groups.select("node").union(groups.select("root")).union(repeated)
    best = rooted(flagged(nodes, F.col("node"), many).where("may"), groups, "node").groupBy("root").agg(F.min("k").alias("k"))
    gone = written(keyed(flagged(table, F.col("node"), many).where("may").select("k").distinct().join(best.select("k"), "k", "left_anti")), "gone")
    twice = flagged(table, F.col("node"), repeated).where("may").groupBy("k").count().where("count > 1")
    docs = flagged(whole, hashed, gone.select(hashed).union(keyed(twice).select(hashed)))
    left = docs.where("may").join(gone, keys, "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__key")))
    return docs.where("not may").select("__row.*").union(left.where("__n = 1").select("__row.*"))
