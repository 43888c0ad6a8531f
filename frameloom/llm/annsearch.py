"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector's residual from a centre is rotated at random and each coordinate is kept as one sign bit;
two scalars go with the bits: the residual's length and the code's inner product with the unit
residual. A query's rotated residual is quantised to four bits and its inner product with a code is
read off packed bits (and, then popcount, for each of the four bit planes). With the scalars this
estimates the inner product without bias, with an error bound. The k best estimates are scored on the
original vectors, in double precision; every other vector whose upper bound reaches the least of
those scores is reranked too, by one product of a query with all of them; only the k best of these, and those
within rounding of them, are summed in the defined order.

Candidates are dealt out once, to blocks of about BLOCK_BYTES, and stay there; the queries, a stated part of
the rows, come to each block. A block makes its codes once, takes the queries in Arrow batches and
yields k rows a query at most, from which the k nearest of all blocks are taken.

Defined results: a vector that is null, of another dimension than the most common one, all zeros or
with a null or non-finite component takes no part, as query or candidate; a null id neither. Rows that
repeat id and vector count once, however many they are; an id with several vectors is a candidate with
each and, where it asks, a query with each, of which no row of its own id is a candidate. Ties go to
the smaller id. An empty table, or one without queries, gives no rows. Columns other than id and
vector, of whatever names, don't matter; texts there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of vectors in a block of candidates, in double precision; and the rows that a smaller block is worth a task for.
BLOCK_BYTES, LEAST_ROWS = 32 << 20, 2048
#: Standard deviations that the error bound spans.
EPSILON = 2.5
_PLANES = 4
_CELLS = 1 << 18  # estimates that a task holds at once


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Codes of a block of vectors: bits packed in 64-bit words, residual lengths, and each code's inner
    product with its unit residual."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        rest = (vectors - centre) @ turn
        self.length = np.sqrt((rest * rest).sum(axis=1))
        ones = rest > 0
        dim = vectors.shape[1]
        self.fit = np.abs(rest).sum(axis=1) / np.maximum(self.length, 1e-300) / np.sqrt(dim)
        padded = np.zeros((len(vectors), -(-dim // 64) * 64), bool)
        padded[:, :dim] = ones
        self.bits = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        self.ones = ones.sum(axis=1)

    def estimate(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of queries with the block's vectors, and how far off they may be.

        With q' the rotated query and x the code (+-1 / sqrt d), <o, q> is near <x, q'> / <x, o>. The
        query's components are low + step * u with u in 0..15, so <x, q'> follows from popcounts.
        """
        dim = queries.shape[1]
        turned = queries @ turn
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**_PLANES - 1), 1e-300)
        u = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        padded = np.zeros((len(queries), self.bits.shape[1] * 64), np.uint8)
        padded[:, :dim] = u
        dots = np.zeros((len(queries), len(self.length)), np.uint16 if dim <= 4096 else np.uint32)
        for plane in range(_PLANES):
            words = np.packbits(padded >> plane & 1, axis=1, bitorder="little").view(np.uint64)
            for w in range(words.shape[1]):
                dots += np.bitwise_count(words[:, w, None] & self.bits[None, :, w]).astype(dots.dtype) << plane
        total = low * dim + step * u.sum(axis=1)  # the sum of the quantised query's components
        fit = np.where(self.length > 0, np.maximum(self.fit, 1e-12), 1.0)
        scale = (self.length / fit / np.sqrt(dim)).astype(np.float32)
        f = lambda v: np.asarray(v, np.float32)[:, None]
        guess = dots * f(2 * step)
        guess += f(2 * low) * self.ones.astype(np.float32)
        guess -= f(total)
        guess *= scale
        guess += f(queries @ centre)
        size = np.sqrt((turned * turned).sum(axis=1))
        spread = self.length * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(1, dim - 1))
        rounding = step / np.sqrt(12)  # the deviation of the quantised query's part
        off = f(epsilon * size) * spread.astype(np.float32)
        off += f(epsilon * rounding) * (self.length / fit).astype(np.float32)
        return guess, off


def exact_scores(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, summed from the first component to the last. Both
    matrices have a row per component, so that a component's values lie together."""
    out = np.empty(len(q))
    for at in range(0, len(q), 8192):
        own, other = q[at : at + 8192], c[at : at + 8192]
        total = np.zeros(len(own))
        for mine, theirs in zip(queries, vectors, strict=True):
            total += mine[own] * theirs[other]
        out[at : at + 8192] = total
    return out


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, codes: Codes, by_vector: np.ndarray, k: int, centre: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query positions, candidate positions and scores of each query's k nearest in the block, whose vectors
    ``by_vector`` has as columns."""
    by_query, rows = np.ascontiguousarray(queries.T), np.ascontiguousarray(by_vector.T)
    # far over what two orders of summing can differ by
    room = 1e-14 * queries.shape[1] * np.sqrt((queries**2).sum(axis=1) * (rows**2).sum(axis=1).max(initial=0))
    found = []
    step = max(1, _CELLS // max(1, len(ids)))
    for at in range(0, len(queries), step):
        own = slice(at, min(at + step, len(queries)))
        guess, off = codes.estimate(queries[own], centre, turn, epsilon)
        guess[query_ids[own][:, None] == ids[None]] = -np.inf
        least = np.full(len(guess), -np.inf)
        if len(ids) > k:  # the least score among the k best guesses: what the k-th nearest has at least
            best = np.argpartition(guess, len(ids) - k, axis=1)[:, len(ids) - k :]
            q, c = np.repeat(np.arange(len(best)), k), best.reshape(-1)
            score = np.where(np.isfinite(guess[q, c]), exact_scores(by_query, by_vector, q + at, c), -np.inf)
            least = score.reshape(len(best), k).min(axis=1)
        off += guess  # the upper bound; single precision is given a little room
        q, c = np.divmod(np.flatnonzero((off >= (least - 1e-5).astype(np.float32)[:, None]) & np.isfinite(guess)), len(ids))
        most = len(c) > guess.size // 8  # then one product of the matrices is cheaper than picking rows
        products = (queries[own] @ by_vector)[q, c] if most else None
        ends = np.searchsorted(q, np.arange(len(guess) + 1))
        some = []
        for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            near = products[s:e] if most else rows[c[s:e]] @ queries[at + i]
            if e - s > k:  # what is further from the k-th than any rounding isn't among the k nearest
                some.append(s + np.flatnonzero(near >= np.partition(near, e - s - k)[e - s - k] - room[at + i]))
            else:
                some.append(np.arange(s, e))
        some = np.concatenate(some)
        q, c = q[some], c[some]
        score = exact_scores(by_query, by_vector, q + at, c)
        good = score >= least[q]
        q, c, score = q[good] + at, c[good], score[good]
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        found.append((q[place < k], c[place < k], score[place < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def block_names(spark: SparkSession, blocks: int) -> list[int]:
    """A number for each block, such that a shuffle by it deals every block to a partition of its own."""
    n = spark.range(max(64, blocks * 32)).select(F.col("id").cast("int").alias("name"))
    rows = n.groupBy(F.pmod(F.hash("name"), F.lit(blocks)).alias("at")).agg(F.min("name").alias("name")).orderBy("at").collect()
    free = iter(range(-1, -blocks - 1, -1))  # a partition that no number came to: any number names a block
    held = {r["at"]: r["name"] for r in rows}
    return [held[b] if b in held else next(free) for b in range(blocks)]


class _Block:
    """A block's candidates, of those that repeat one each."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int, centre: np.ndarray, turn: np.ndarray):
        names = np.concatenate([np.stack([b.column(k).to_numpy() for k in (2, 3)], axis=1) for b in parts])
        one = np.unique(np.ascontiguousarray(names).view("i8,i8").reshape(-1), return_index=True)[1]
        vectors = np.concatenate([_matrix(b.column(4), dim) for b in parts])[one]
        self.ids, self.keys = names[one, 0], names[one, 1]
        self.codes, self.by_vector = Codes(vectors, centre, turn), np.ascontiguousarray(vectors.T)


def nearest(vectors: DataFrame, is_query: Column, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", epsilon: float = EPSILON, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest other rows by inner product."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    given = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = given.where(F.col("vector").isNotNull()).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None or not sizes.dim:
        return none
    dim = sizes.dim
    given = given.where(usable(F.col("vector"), dim)).withColumn("key", F.xxhash64("vector"))
    row = given.agg(F.count("*").alias("n"), F.max("asks").alias("asked"), *[F.avg(F.get("vector", k)).alias(f"c{k}") for k in range(dim)]).first()
    if not row.asked:
        return none
    centre, turn = np.array([row[f"c{k}"] for k in range(dim)]), rotation(dim)
    blocks = max(-(-row.n * dim * 8 // block_bytes), min(spark.sparkContext.defaultParallelism, -(-row.n // LEAST_ROWS)))
    # the partition's number spreads rows that repeat; it is the same when a task runs again
    names = F.array(*[F.lit(x) for x in block_names(spark, blocks)])
    own = F.get(names, F.pmod(F.xxhash64("vec_id", "key", F.spark_partition_id()), F.lit(blocks)).cast("int"))
    candidates = given.select(own.alias("block"), F.lit(0).alias("kind"), "vec_id", "key", "vector")
    queries = given.where("asks").dropDuplicates(["vec_id", "key"]).select(F.explode(names).alias("block"), F.lit(1).alias("kind"), "vec_id", "key", "vector")
    dealt = candidates.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None  # the block's number, its candidates while they come, and then all of it
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(number)]
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                if number[s] != at:
                    at, parts, block = number[s], [], None
                rows = batch.slice(s, e - s)
                if kind[s] == 0:
                    parts.append(rows)
                    continue
                if block is None and parts:
                    block, parts = _Block(parts, dim, centre, turn), []
                if block is not None:
                    ids, keys = rows.column(2).to_numpy(), rows.column(3).to_numpy()
                    q, c, score = search_block(ids, _matrix(rows.column(4), dim), block.ids, block.codes, block.by_vector, k, centre, turn, epsilon)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[q], keys[q], block.ids[c], block.keys[c], score)], names=["query_id", "query_key", "vec_id", "key", "score"])

    near = dealt.mapInArrow(search, "query_id long, query_key long, vec_id long, key long, score double").distinct()
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
