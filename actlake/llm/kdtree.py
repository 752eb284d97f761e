"""Exact top-k search by inner product: KD-trees per shard.

Vectors are dealt to shards of bounded size. Each shard holds a KD-tree: median splits along the widest side, tight
bounding boxes. A query walks a tree best-first: the upper bound of its inner product with a box orders the boxes, and
boxes that cannot beat the k-th score known so far are never opened. The k-th score is propagated: each query first
searches one shard, and what it found there is its starting bound in all others.

Components are integers: floor(256 * x), x as double. Vectors that are null or hold null, NaN or infinite components
take no part, nor do rows without an id. Only vectors of equal length are compared. Ties go to the smaller id. Every
row is a candidate but those with the query's own id; a repeated row (same id and vector) is one query and several
candidates. A table without queries or candidates gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

SHARD_ROWS = 8192
BLOCK_QUERIES = 256
LEAF_ROWS = 128
EXACT = 2**53  # sums below are exact in double precision
LOWEST = -(2**63)


class KdTree:
    """KD-tree over integer vectors. Nodes are in arrays; node i's children are left[i] and left[i] + 1."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        spans, left, low, high = [(0, len(ids))], [], [], []
        node = 0
        while node < len(spans):
            start, stop = spans[node]
            part = vectors[order[start:stop]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            wide = high[-1] - low[-1]
            if stop - start > leaf_rows and wide.max() > 0:
                half = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(part[:, wide.argmax()], half, kind="introselect")]
                left.append(len(spans))
                spans += [(start, start + half), (start + half, stop)]
            else:
                # a leaf, by id: among equal scores the first is wanted
                order[start:stop] = np.sort(order[start:stop])
                left.append(-1)
            node += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.spans, self.left = spans, left
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of each query's inner product with any vector in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, k: int, least: int) -> list[tuple[int, int]]:
        """Up to k pairs (score, id), best first; none below ``least`` need be found."""
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            # a box whose bound equals the k-th score may hold a smaller id
            if -bound < (best[0][0] if len(best) == k else least):
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.left[node] + 1):
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            start, stop = self.spans[node]
            scores = self.vectors[start:stop] @ query
            floor = best[0][0] if len(best) == k else least
            for at in np.flatnonzero(scores >= floor).tolist() if floor > LOWEST else range(stop - start):
                item = (int(scores[at]), -int(self.ids[start + at]))
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(score, -minus) for score, minus in sorted(best, reverse=True)]


def _stored(top: int) -> str:
    """The smallest integer type that holds components up to ``top``."""
    return next(t for t in ("<i2", "<i4", "<i8") if top <= np.iinfo(t).max)


def _integers(blob: bytes, rows: int, stored: int, top: int) -> np.ndarray:
    """Packed vectors (of components up to ``stored``) as a type whose inner products with vectors up to ``top`` are exact."""
    array = np.frombuffer(blob, dtype=_stored(stored)).reshape(rows, -1).astype(np.int64)
    bound = array.shape[1] * top * top
    if bound >= 2**63:
        raise OverflowError("inner products of these vectors exceed 64 bits")
    return array.astype(np.float64) if bound < EXACT else array


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (dim, id, vector) gathered into blocks of about ``size``: dim, block, ids, vectors, top (largest component)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for dim, part in frame.groupby("dim"):
                for start in range(0, len(part), size):
                    piece = part.iloc[start : start + size].sort_values("id")
                    vectors = np.array(piece["vector"].tolist(), dtype=np.int64)
                    top = int(np.abs(vectors).max(initial=1))
                    packed = vectors.astype(_stored(top)).tobytes()
                    yield pd.DataFrame({"dim": [dim], "rows": [len(piece)], "ids": [piece["id"].to_numpy(np.int64).tobytes()], "vectors": [packed], "top": [top]})

    schema = "dim int, rows long, ids binary, vectors binary, top long"
    packed = written(rows.mapInPandas(pack, schema), name)
    # the packed rows are few (one for some thousand vectors): numbered from 0 by their first ids
    return packed.withColumn("block", F.xxhash64("dim", "ids", "vectors"))


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """For each row whose id is divisible by ``every``: its ``k`` best rows. query_id, rank (from 1), vec_id, score.

    Shards and blocks of queries are packed rows. Every block of queries meets every shard once, in one task each,
    with bounded memory.
    """
    component = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    usable = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & usable & (F.size(vector_col) > 0))
    rows = rows.select(F.size(vector_col).alias("dim"), F.col(id_col).cast("long").alias("id"), component.alias("vector"))
    # dealt by id: equal vectors, which may be many, are spread evenly
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("id") % every == 0).alias("asked")).head()
    shards = _packed(rows.repartition(-(-counts["rows"] // shard_rows) or 1, F.xxhash64("id")), shard_rows, "llm-knn-shards")
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "vector"])
    blocks = _packed(asked.repartition(-(-counts["asked"] // block_queries) or 1, F.xxhash64("id")), block_queries, "llm-knn-queries")

    names = shards.groupBy("dim").agg(F.array_sort(F.collect_list("block")).alias("shards"))
    of_block = blocks.join(names, "dim").withColumn("n", F.size("shards"))
    home = F.get("shards", F.pmod(F.col("block"), F.col("n")).cast("int"))
    query = of_block.select(F.col("dim"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("top").alias("q_top"), F.col("block").alias("q_block"), "shards", home.alias("home"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, built = None, None
        for frame in batches:
            for row in frame.itertuples(index=False):
                top = max(row.top, row.q_top)
                if built != row.block:
                    tree, built = KdTree(np.frombuffer(row.ids, np.int64), _integers(row.vectors, row.rows, row.top, top)), row.block
                queries, own = _integers(row.q_vectors, row.q_rows, row.q_top, top), np.frombuffer(row.q_ids, np.int64)
                bounds = tree.bounds(queries)
                least = np.frombuffer(row.least, np.int64) if row.least is not None else np.full(len(own), LOWEST)
                found = [(q, rank, vec, score) for q in range(len(own)) for rank, (score, vec) in enumerate(tree.search(queries[q], bounds[q], int(own[q]), k, int(least[q])))]
                at = np.array(found, dtype=np.int64).reshape(-1, 4)
                yield pd.DataFrame({"q_block": row.q_block, "place": at[:, 0], "query_id": own[at[:, 0]], "vec_id": at[:, 2], "score": at[:, 3]})

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("q_block", "place", "query_id", "vec_id", "score")])
    near = shards.select("dim", "block", "rows", "ids", "vectors", "top")

    def visit(pairs: DataFrame) -> DataFrame:
        # one task handles a shard's blocks together, so its tree is built once per batch of them
        return pairs.join(near, ["dim", "block"]).sortWithinPartitions("block").mapInPandas(search, schema)

    first = written(visit(query.withColumn("block", F.col("home")).withColumn("least", F.lit(None).cast("binary")).drop("shards", "home")), "llm-knn-first")
    # the k-th score of each query so far, packed in the order of its block
    kth = first.groupBy("q_block", "place").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(LOWEST)).alias("least"))

    def pack_bounds(frame: pd.DataFrame) -> pd.DataFrame:
        least = np.full(block_queries, LOWEST, dtype=np.int64)
        least[frame["place"].to_numpy()] = frame["least"].to_numpy()
        return pd.DataFrame({"q_block": frame["q_block"].iloc[:1], "least": [least.tobytes()]})

    packed = kth.groupBy("q_block").applyInPandas(pack_bounds, "q_block long, least binary")
    others = query.join(packed, "q_block", "left").withColumn("block", F.explode(F.array_except("shards", F.array("home")))).drop("shards", "home")
    best = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id")
    every_row = first.unionByName(visit(others))
    return every_row.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
