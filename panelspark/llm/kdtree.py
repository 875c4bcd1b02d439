"""Exact top-k search by inner product: KD-trees per shard, best-first.

Rows are dealt to shards by a hash of their id and place, so that no common id or vector
fills one. Each shard is a KD-tree of median splits (on the widest dimension, by position
in the order of values, so that equal vectors split too) whose nodes keep a tight
bounding box and their smallest id; it is packed into one row. The queries among a
shard's rows are searched there first, in blocks of QUERY_BLOCK; the kth best (score, id)
found is the bound that all other shards start from. Within a tree, nodes are visited in
the order of their upper bound (per dimension the larger of query times box side), and
the visit ends when the next node can't beat the current kth, ties by smaller id included.

Then blocks are held against the root boxes of the other shards, BOXES at a time, and
only those of their queries that a box may serve travel to its tree. A tree travels once
for each SPLIT_QUERIES of all queries, so that no task gets more of them than that. At
most k results per query and shard come back and are ranked.

Components are integers below 2**62 in size; products and sums are made in floats where
those are exact, in 64-bit integers where these suffice, and else in Python integers.
Defined results: rows whose vector is null, empty, or holds a null or non-finite
component take no part, as query or candidate; a component of 2**54 or more before
scaling is an error, and so is a result beyond 64 bits; vectors meet only those of equal
length; rows of null id are no queries and no candidates; a query excludes candidates of
its own id; if an id repeats, its rows are all candidates, and its queries are
ranked together; ties go to the smaller id; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import partitions, written

#: Rows of a shard at most, on average; small tables get two shards for each partition, of LEAST_ROWS at least.
SHARD_ROWS, LEAST_ROWS = 16384, 1024
QUERY_BLOCK = 256
LEAF_ROWS = 64
#: Root boxes that a block of queries is held against at a time, and queries that a copy of a tree serves.
BOXES, SPLIT_QUERIES = 1024, 1 << 17
LIMIT = float(1 << 62)


def scaled(vector: Column, times: int = 256) -> Column:
    """floor(times * x) of every component, as array<long>; null if the vector can take no part."""
    x = F.transform(vector, lambda v: v.cast("double") * times)
    fine = F.size(vector) > 0
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v) < LIMIT, F.floor(v).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for 64-bit integers")))
    return F.when(F.coalesce(fine & good, F.lit(False)), F.transform(x, whole))


def component_width(v: np.ndarray) -> str:
    """The integers that hold all components."""
    return "<i4" if int(np.abs(v).max(initial=0)) < 1 << 31 else "<i8"


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The numbers in which inner products of rows of a and b are exact."""
    largest = 2 * a.shape[1] * max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0)))
    return np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 63 else object


def best_of_boxes(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each query and box the largest inner product that a point of the box can have."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


class Tree:
    """Nodes in arrays; node i covers rows start[i]:end[i], its children are left[i] and left[i] + 1 (left < 0: a leaf)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.lexsort((ids,))
        ids, rows = ids[order], rows[order]
        place = np.arange(len(ids))
        todo, spans, left = [(0, 0, len(ids))], [(0, len(ids))], [-1]
        while todo:
            node, a, z = todo.pop()
            if z - a <= LEAF_ROWS:
                continue
            part = rows[place[a:z]]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            middle = (z - a) // 2
            place[a:z] = place[a:z][np.argsort(part[:, axis], kind="stable")]
            left[node] = len(spans)
            for lo, hi in ((a, a + middle), (a + middle, z)):
                todo.append((len(spans), lo, hi))
                spans.append((lo, hi))
                left.append(-1)
        self.ids, self.rows = ids[place], rows[place]
        self.start, self.end = np.array(spans, np.int32).T
        self.left = np.array(left, np.int32)
        self.low = np.stack([self.rows[a:z].min(0) for a, z in spans])
        self.high = np.stack([self.rows[a:z].max(0) for a, z in spans])
        self.least = np.array([self.ids[a:z].min() for a, z in spans])

    NAMES = ("ids", "least", "start", "end", "left", "rows", "low", "high")

    def packed(self) -> bytes:
        """Counts of rows and nodes and the width of components, then the arrays by name."""
        width = component_width(self.rows)
        kinds = ("<i8", "<i8", "<i4", "<i4", "<i4", width, width, width)
        head = np.array([len(self.ids), len(self.start), int(width[2])], "<i8").tobytes()
        return head + b"".join(np.ascontiguousarray(getattr(self, n), k).tobytes() for n, k in zip(self.NAMES, kinds))

    @classmethod
    def unpacked(cls, raw: bytes, dim: int) -> Tree:
        t = cls.__new__(cls)
        n_rows, n_nodes, width = np.frombuffer(raw, "<i8", 3).tolist()
        sizes = (n_rows, n_nodes, n_nodes, n_nodes, n_nodes, n_rows * dim, n_nodes * dim, n_nodes * dim)
        at = 24
        for n, k, size in zip(cls.NAMES, (8, 8, 4, 4, 4, width, width, width), sizes):
            x = np.frombuffer(raw, f"<i{k}", size, at)
            at += k * size
            setattr(t, n, x.reshape(-1, dim) if n in ("rows", "low", "high") else x)
        return t

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, bounds: np.ndarray, bound_ids: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """Position of query, id and score of the k best rows of each query that beat its bound (a score, and the id that a tie must be below)."""
        kind = exact_kind(queries, self.rows)
        q, rows = queries.astype(kind), self.rows.astype(kind)
        upper = best_of_boxes(q, self.low.astype(kind), self.high.astype(kind))
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        for n in range(len(q)):
            best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
            kth = (int(bounds[n]), -int(bound_ids[n]))
            ahead = [(-int(upper[n, 0]), int(self.least[0]), 0)]
            while ahead:
                bound, least, node = heapq.heappop(ahead)
                if (-bound, -least) < kth:
                    if -bound < kth[0]:
                        break
                    continue
                child = int(self.left[node])
                if child >= 0:
                    for c in (child, child + 1):
                        if (int(upper[n, c]), -int(self.least[c])) >= kth:
                            heapq.heappush(ahead, (-int(upper[n, c]), int(self.least[c]), c))
                    continue
                a, z = int(self.start[node]), int(self.end[node])
                scores, ids = rows[a:z] @ q[n], self.ids[a:z]
                for i in np.nonzero((scores >= kth[0]) & (ids != query_ids[n]))[0].tolist():
                    entry = (int(scores[i]), -int(ids[i]))
                    if entry < kth:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    if len(best) == k:
                        kth = max(kth, best[0])
            for score, minus in best:
                out[0].append(n)
                out[1].append(-minus)
                out[2].append(score)
        return out


_BUILT = "kind int, dim int, shard int, place int, tree binary, box binary, query_ids binary, queries binary, bounds binary, at binary, vec binary, score binary"
_ASKED = "kind int, dim int, shard int, split int, tree binary, query_ids binary, queries binary, bounds binary"
_FOUND = "query_id long, vec_id long, score long"
#: The bound of a query that has fewer than k hits: no score and id of 64 bits is worse.
NO_BOUND, NO_ID = -(1 << 63), (1 << 63) - 1
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in fields], [n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)}


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of equal (shard, dim) of sorted rows (shard, dim, id, is_query, vector): key, ids, flags, vectors."""
    key, ids, flags, vectors = None, [], [], []
    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        lists = b.column(4)
        flat, starts = lists.flatten().to_numpy(), np.cumsum(np.r_[0, np.diff(lists.offsets.to_numpy())])
        for i, (k, v, is_query) in enumerate(zip(keys, b.column(2).to_pylist(), b.column(3).to_pylist())):
            if k != key:
                if ids:
                    yield key, np.array(ids, np.int64), np.array(flags, bool), np.stack(vectors)
                key, ids, flags, vectors = k, [], [], []
            ids.append(v)
            flags.append(is_query)
            vectors.append(flat[starts[i] : starts[i + 1]])
    if ids:
        yield key, np.array(ids, np.int64), np.array(flags, bool), np.stack(vectors)


def _bounds(n: int, k: int, at: list[int], vec: list[int], score: list[int]) -> np.ndarray:
    """Of each of n queries the kth score and id, if it found k; rows of scores and ids."""
    bounds = np.array([[NO_BOUND] * n, [NO_ID] * n], "<i8")
    place, ids, scores = np.array(at, np.int64), np.array(vec, np.int64), np.array(score, np.int64)
    order, many = np.lexsort((ids, -scores, place)), np.bincount(place, minlength=n)
    full, last = many >= k, np.cumsum(many) - 1
    bounds[0, full], bounds[1, full] = scores[order][last[full]], ids[order][last[full]]
    return bounds


def _packed_queries(ids: np.ndarray, v: np.ndarray, bounds: np.ndarray) -> dict[str, bytes]:
    width = component_width(v)
    return {"query_ids": ids.astype("<i8").tobytes(), "queries": bytes([int(width[2])]) + v.astype(width).tobytes(), "bounds": bounds.astype("<i8").tobytes()}


def _unpacked_queries(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.frombuffer(r["queries"], f"<i{r['queries'][0]}", offset=1).reshape(-1, r["dim"])
    return np.frombuffer(r["query_ids"], "<i8"), v, np.frombuffer(r["bounds"], "<i8").reshape(2, -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. vectors: vec_id long, v array<long> without null (see `scaled`)."""
    spark, n_parts = vectors.sparkSession, partitions(vectors.sparkSession)
    rows = written(vectors.where("vec_id is not null and v is not null").select("vec_id", F.coalesce(is_query, F.lit(False)).alias("asks"), "v"), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards = max(1, -(-n // SHARD_ROWS), min(2 * n_parts, -(-n // LEAST_ROWS)))
    splits = max(1, -(-n_queries // SPLIT_QUERIES))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tree of each shard, and its own queries with what they find there."""
        for (shard, dim), ids, asks, v in _grouped(batches):
            tree, out = Tree(ids, v), []
            box = np.concatenate([[int(tree.least[0])], tree.low[0], tree.high[0]]).astype("<i8").tobytes()
            out.append({"kind": 0, "dim": dim, "shard": shard, "tree": tree.packed(), "box": box})
            ids, v = ids[asks], v[asks]
            for a in range(0, len(ids), QUERY_BLOCK):
                i, q = ids[a : a + QUERY_BLOCK], v[a : a + QUERY_BLOCK]
                found = tree.search(q, i, k, np.full(len(i), NO_BOUND), np.full(len(i), NO_ID))
                at, vec, score = (np.array(x, t).tobytes() for x, t in zip(found, ("<i4", "<i8", "<i8")))
                out.append({"kind": 1, "dim": dim, "shard": shard, "place": a // QUERY_BLOCK, **_packed_queries(i, q, _bounds(len(i), k, *found)), "at": at, "vec": vec, "score": score})
            yield _batch(_BUILT, out)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block and set of boxes, the queries that a box may serve."""
        for r in _rows(batches):
            (ids, v, bounds), out = _unpacked_queries(r), []
            boxes = np.stack([np.frombuffer(x["box"], "<i8") for x in r["boxes"]])
            least, low, high = boxes[:, 0], boxes[:, 1 : 1 + r["dim"]], boxes[:, 1 + r["dim"] :]
            kind = exact_kind(v, boxes[:, 1:])
            most = best_of_boxes(v.astype(kind), low.astype(kind), high.astype(kind))
            score = bounds[0].astype(kind)[:, None]
            serves = (most > score) | ((most == score) & (least[None, :] <= bounds[1][:, None]))
            for j, shard in enumerate(x["shard"] for x in r["boxes"]):
                some = np.flatnonzero(serves[:, j])
                if len(some) and shard != r["shard"]:
                    out.append({"kind": 1, "dim": r["dim"], "shard": shard, "split": (r["shard"] + r["place"]) % splits, **_packed_queries(ids[some], v[some], bounds[:, some])})
            if out:
                yield _batch(_ASKED, out)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the queries behind each tree find in it."""
        tree = None
        for r in _rows(batches):
            if r["kind"] == 0:
                tree = Tree.unpacked(r["tree"], r["dim"])
                continue
            ids, v, bounds = _unpacked_queries(r)
            at, vec, score = tree.search(v, ids, k, bounds[0], bounds[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(at, np.int64)]), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            ids = np.frombuffer(r["query_ids"], "<i8")[np.frombuffer(r["at"], "<i4")]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.frombuffer(r["vec"], "<i8")), pa.array(np.frombuffer(r["score"], "<i8"))], ["query_id", "vec_id", "score"])

    # the place of a row in the written table tells apart rows of one id, however many there are
    shard = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard")
    dealt = rows.select(shard, F.size("v").alias("dim"), "vec_id", "asks", "v").repartition(n_parts, "shard", "dim").sortWithinPartitions("shard", "dim")
    built = written(dealt.mapInArrow(build, _BUILT), "trees")
    blocks, trees = built.where("kind = 1"), built.where("kind = 0")
    sets = -(-shards // BOXES)
    boxes = trees.select("dim", F.floor(F.col("shard") / BOXES).cast("int").alias("set"), F.struct("shard", "box").alias("b")).groupBy("dim", "set").agg(F.collect_list("b").alias("boxes"))  # BOXES at most
    each = blocks.select("dim", "shard", "place", "query_ids", "queries", "bounds", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"))
    asked = each.join(boxes, ["dim", "set"]).drop("set").mapInArrow(route, _ASKED)
    copies = trees.select("kind", "dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), "tree", *[F.lit(None).cast("binary").alias(c) for c in ("query_ids", "queries", "bounds")])
    met = copies.union(asked).repartition(n_parts, "dim", "shard", "split").sortWithinPartitions("dim", "shard", "split", "kind")
    first = blocks.select("query_ids", "at", "vec", "score").mapInArrow(spread, _FOUND)
    found = first.union(met.mapInArrow(look, _FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
