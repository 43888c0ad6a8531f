"""Near-duplicates by SimHash, linked through a Gray-order hierarchical index.

Distinct fingerprints are factored level by level into shared masked bit patterns. The upper nodes
are spread over the cluster: of three masks that split the 64 bits, two fingerprints with at most
two differing bits agree on one, so each link lies below at least one upper node. A node with
too many members is factored again by masks that split its free bits in three, for as long as
need be: no group grows beyond a bound and no link is lost. Within a node the members are
sorted by Gray rank and runs of them are factored into inner nodes, each with the bits its members
share; a search goes down from the top, adds up differences in bits that a node fixes and its parent
did not, and drops a whole run once they exceed the threshold.

Defined results: null and empty texts have fingerprint 0 and are linked with each other like any
others; a null id is never a representative while its component has another id; rows that repeat
have the same component; a very long text is read whole, in one task; columns other than id and text, of
whatever names and types, don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, buffer_of, cut, segment_sums, text_slices
from .components import components

#: Members of one node that a task searches at once; larger nodes are factored again.
GROUP_MEMBERS = 2048
#: After four factorings of 64 bits in three, 14 bits at most are free: 16384 members by definition.
LEVELS = 4
_RUN = 8  # children of an inner node
_PAIRS = 1 << 20  # pairs that a search holds at once


def shingle_hashes(texts: pa.Array, width: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every ``width``-word shingle of each text, repeats included, A-Z in lower case; text i has
    hashes ``starts[i]:starts[i + 1]``. Fewer words are one shingle, none give no hash."""
    joined = pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts))), " ")
    raw, offsets = buffer_of(joined)
    data = raw.tobytes()
    spaces = np.flatnonzero(raw == 32)
    lens = np.diff(offsets)
    n_words = np.searchsorted(spaces, offsets[1:]) - np.searchsorted(spaces, offsets[:-1]) + (lens > 0)
    first = np.concatenate([[0], np.cumsum(n_words)])
    begin, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    heads, tails = first[:-1][n_words > 0], first[1:][n_words > 0] - 1
    inner = np.ones(first[-1], bool)
    inner[heads] = False
    begin[heads], begin[inner] = offsets[:-1][lens > 0], spaces + 1
    inner = np.ones(first[-1], bool)
    inner[tails] = False
    end[tails], end[inner] = offsets[1:][lens > 0], spaces
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    starts = np.concatenate([[0], np.cumsum(n)])
    word = np.arange(starts[-1]) - np.repeat(starts[:-1], n) + np.repeat(first[:-1], n)
    last = np.minimum(word + width, np.repeat(first[1:], n)) - 1
    hash_of = xxhash.xxh64_intdigest
    found = [hash_of(data[s:e], seed) for s, e in zip(begin[word].tolist(), end[last].tolist(), strict=True)]
    return np.array(found, np.uint64), starts


def fingerprints_of(texts: pa.Array, width: int = 3, seed: int = 42) -> np.ndarray:
    """A bit is 1 if more than half of the text's shingle hashes have it."""
    return majority(*shingle_hashes(texts, width, seed))


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bits that more than half of ``hashes[starts[i]:starts[i + 1]]`` have, for every i."""
    many = len(starts) - 1
    out = np.zeros((many, 64), bool)
    half = np.diff(starts)
    at = 0
    while at < many:  # bits take 64 bytes a shingle: a few texts at a time
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 17), side="right")) - 1)
        if to == at + 1 and half[at] > 1 << 18:
            total = np.zeros(64, np.int64)
            for k in range(starts[at], starts[to], 1 << 17):
                total += np.unpackbits(hashes[k : min(k + (1 << 17), starts[to])].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[at] = 2 * total > half[at]
        else:
            bits = np.unpackbits(hashes[starts[at] : starts[to]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            some = np.flatnonzero(half[at:to]) + at
            if len(some):
                total = np.add.reduceat(bits, starts[some] - starts[at], axis=0, dtype=np.int32)
                out[some] = 2 * total > half[some, None]
        at = to
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of a bit pattern in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """The index over distinct fingerprints of one node. ``levels[0]`` are the members themselves."""

    def __init__(self, members: np.ndarray):
        self.members = members[np.argsort(gray_rank(members), kind="stable")]
        full = np.full(len(members), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.levels = [(self.members, full)]
        while len(self.levels[-1][0]) > 2 * _RUN:
            pattern, mask = self.levels[-1]
            heads = np.arange(0, len(pattern), _RUN)
            first = np.repeat(pattern[heads], np.diff(np.append(heads, len(pattern))))
            shared = np.bitwise_and.reduceat(~(pattern ^ first) & mask, heads)
            self.levels.append((pattern[heads] & shared, shared))

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions a < b in ``members`` with at most ``most`` differing bits."""
        top = self.levels[-1][0]
        step = max(1, _PAIRS // max(1, len(top)) // 4)
        for at in range(0, len(self.members), step):
            some = np.arange(at, min(at + step, len(self.members)))
            yield from self._down(np.repeat(some, len(top)), np.tile(np.arange(len(top)), len(some)), np.zeros(len(some) * len(top), np.uint8), np.zeros(len(top), np.uint64), None, len(self.levels) - 1, most)

    def _down(self, query, node, so_far, above_mask, parent, level, most):
        pattern, mask = self.levels[level]
        fixed_above = above_mask[node] if parent is None else above_mask[parent]
        differ = so_far + np.bitwise_count((self.members[query] ^ pattern[node]) & mask[node] & ~fixed_above)
        near = differ <= most
        last = np.minimum((node.astype(np.int64) + 1) * _RUN**level, len(self.members)) - 1
        near &= last > query  # each pair once: from its lesser position
        query, node, differ = query[near], node[near], differ[near]
        if level == 0:
            if len(query):
                yield query, node
            return
        below = len(self.levels[level - 1][0])
        step = max(1, _PAIRS // _RUN)
        for at in range(0, len(query), step):
            q, p, d = (np.repeat(v[at : at + step], _RUN) for v in (query, node, differ))
            child = p * _RUN + np.tile(np.arange(_RUN), len(p) // _RUN)
            ok = child < below
            yield from self._down(q[ok], child[ok], d[ok], mask, p[ok], level - 1, most)


def stars(members: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for the members linked to another, each under one member of its linked set: the same
    sets as all links make, in fewer edges than members."""
    index = GrayIndex(members)
    root = np.arange(len(members))
    for a, b in index.links(most):
        join(root, a, b)
    own = np.flatnonzero(root != np.arange(len(root)))
    return index.members[own], index.members[root[own]]


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put the ends of each link under one root."""
    while len(a):  # the lesser roots win until both ends of each link have one root
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]


def wide_stars(words: np.ndarray, most: int, most_half: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) as places, as ``stars`` has them, of one node's fingerprints of several words: linked are those
    that differ in ``most`` bits at most; of pairs that differ in over ``most_half`` bits of the first half of the words the
    rest isn't read, and they count as unlinked.

    A radius this wide drops no run of a node, so all members are compared; first, each with the next ones in Gray
    order. The largest set that comes of it needs no pairs within: many near copies take linear time.
    """
    order = np.argsort(gray_rank(words[:, 0]), kind="stable")
    words, half = words[order], words.shape[1] // 2
    root = np.arange(len(words))
    for k in range(1, min(_RUN, len(words) - 1) + 1):
        near = np.flatnonzero(np.bitwise_count(words[k:] ^ words[:-k]).sum(axis=1, dtype=np.int64) <= most)
        join(root, near, near + k)
    top, many = np.unique(root, return_counts=True)
    top = top[many.argmax()]
    seq = np.concatenate([np.flatnonzero(root != top), np.flatnonzero(root == top)])
    rest, columns = int((root != top).sum()), [np.ascontiguousarray(words[seq, w]) for w in range(words.shape[1])]
    at = 0
    while at < rest:  # each pair once: with the places that follow
        to = min(rest, at + max(1, (1 << 16) // (len(seq) - at)))
        apart = np.bitwise_count(columns[0][at:to, None] ^ columns[0][None, at:])
        for c in columns[1:half]:
            apart += np.bitwise_count(c[at:to, None] ^ c[None, at:])
        a, b = np.nonzero(apart <= most_half)
        a, b = seq[a[a < b] + at], seq[b[a < b] + at]
        new = root[a] != root[b]
        a, b = a[new], b[new]
        near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= most
        join(root, a[near], b[near])
        at = to
    own = np.flatnonzero(root != np.arange(len(root)))
    return order[own], order[root[own]]


def _splits(bits: list[int], parts: int) -> list[int]:
    """Masks that split the given bit positions into even parts."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _child_masks(mask: int, most: int) -> list[int]:
    return [mask | part for part in _splits([b for b in range(64) if not mask >> b & 1], most + 1)]


def links(fingerprints: DataFrame, most: int = 2) -> DataFrame:
    """Edges u, v between distinct fingerprints (long column ``fp``) that connect just what links of at
    most ``most`` differing bits connect."""
    edges, masks = None, [0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
            at = at - at[0]
            found = [stars(flat[s:e], most) for s, e in zip(at[:-1], at[1:], strict=True)]
            if found:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    rows = fingerprints.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(LEVELS):
        below = {m: _child_masks(m, most) for m in masks}
        masks = [c for m in masks for c in below[m]]
        child = F.lit(None).cast("array<bigint>")
        for m, children in below.items():
            child = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(c)) for c in children])).otherwise(child)
        keyed = rows.select("fp", F.explode(child).alias("mask")).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        counts = cut(keyed.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where("n > 1"))
        last = level == LEVELS - 1
        large = counts.where(F.lit(not last) & (F.col("n") > GROUP_MEMBERS)).select("mask", "pattern")
        some_large = not large.isEmpty()
        small = counts.where(F.lit(last) | (F.col("n") <= GROUP_MEMBERS)).select("mask", "pattern")
        cold = keyed.join(large, ["mask", "pattern"], "left_anti") if some_large else keyed
        groups = cold.join(small, ["mask", "pattern"], "left_semi").groupBy("mask", "pattern").agg(F.collect_list("fp").alias("fps"))
        part = groups.select("fps").mapInArrow(search, "u long, v long")
        edges = part if edges is None else edges.unionByName(part)
        if not some_large:
            break
        rows = cut(keyed.join(large, ["mask", "pattern"], "left_semi").select("fp", "mask").distinct())
    return edges


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long), one row per row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "_text", 1 << 21):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints_of(texts, width).view(np.int64))], names=["doc_id", "fp"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return given.mapInArrow(count, "doc_id long, fp long")


def _classes(prints: DataFrame, most: int) -> DataFrame:
    """fp, root (a fingerprint that names the component) and component_id of each distinct fingerprint."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), most)).withColumnRenamed("u", "fp")
    named = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach), one row per row of ``docs``.

    Only ids and fingerprints are shuffled, 16 bytes a document; copies count once from then on.
    """
    prints = cut(fingerprints(docs, doc_id=doc_id, text=text, width=width))
    return prints.join(_classes(prints, most).drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """``docs`` without those whose component has a smaller id: one document of each group stays."""
    prints = cut(fingerprints(docs, doc_id=doc_id, text=text, width=width))
    classes = cut(_classes(prints, most))
    return keep_classes(docs, prints, classes, lambda texts: fingerprints_of(texts, width).view(np.int64), doc_id=doc_id, text=text)


def keep_classes(docs: DataFrame, prints: DataFrame, classes: DataFrame, fp_of: Callable[[pa.Array], np.ndarray], *, doc_id: str, text: str) -> DataFrame:
    """One row of each class, one with the smallest id; ``fp_of`` gives the fp of texts as in ``prints``.

    Where that id stands on one row only, the id tells the row. Rows without an id and rows whose id repeats are
    told by their text's fp: of the rows of a class that have its smallest id (null if no row has one) one stays.
    """
    repeated = cut(prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(doc_id)))
    gone = prints.join(classes, "fp").where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id))
    any_repeated = not repeated.isEmpty()
    gone = cut((gone.unionByName(repeated) if any_repeated else gone).distinct())
    out = beside(docs.where(docs[doc_id].isNotNull()), gone, doc_id, "left_anti").select(*[docs[c] for c in docs.columns])
    loose = []
    if any_repeated:
        loose.append(docs.join(repeated, doc_id, "left_semi").select(*[docs[c] for c in docs.columns]))
    if not prints.where("doc_id IS NULL").isEmpty():
        loose.append(docs.where(docs[doc_id].isNull()))
    at, of = docs.columns.index(doc_id), f"c{docs.columns.index(text)}"
    for rows in loose:
        packed = rows.toDF(*[f"c{k}" for k in range(len(docs.columns))])
        schema = T.StructType([*packed.schema.fields, T.StructField("fp", T.LongType())])

        def add(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = tuple(schema.names)) -> Iterator[pa.RecordBatch]:
            for part, texts in text_slices(batches, of, 1 << 21):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp_of(texts))], names=names)

        own = packed.mapInArrow(add, schema).join(classes, "fp").where(F.col(f"c{at}").cast("long").eqNullSafe(F.col("component_id")))
        one = own.groupBy("root").agg(F.min_by(F.struct(*packed.columns), F.coalesce(F.col(of), F.lit(""))).alias("row"))
        out = out.unionByName(one.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)]))
    return out
