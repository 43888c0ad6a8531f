"""Near-duplicates by the Jaccard similarity of five-word shingle sets, found through the Gray-order index of SimHash.

A text's set holds 64-bit hashes of its five-word shingles (A-Z in lower case; fewer words are one
shingle). Two texts are near copies if their sets have a similarity of 0.8 or more. A set's fingerprint has 256 bits, each
what more than half of its hashes have. Fingerprints of a pair at 0.8 differ in 14 to 15 % of the bits, and in 19 % where
four of five shingles are shared (the worst case: two bits of 64 would lose nearly all). So the radius is 78 bits (4.7
deviations beyond 19 %; unrelated ones differ in 128, 6 deviations away), and the index has more upper nodes than
the pigeonhole's: masks of so many bits that unrelated members of a node are about NODE, and so many masks that a
pair at 19 % shares no node with a chance of MISS (far less at 15 %). Members of a node within the radius are put under
one root; what these links join is a candidate group, whose members are compared by their whole sets, in integers.

Equal sets count once. A set goes to its group's task once, whatever the number of its links. Members of a group are
compared in a search that leaves out those already reached. A group of more than GROUP sets is dealt to several
tasks; sets that then lie outside the group's largest component are held against all members of other
components: no link between candidates is lost.

Defined results: texts without words, null ones too, have the empty set and are copies of each other; a
null id is never a representative while its component has another id; of rows that repeat, or share an
id, one of each class stays; a very long text is read whole; other columns, of whatever names and
types, don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, coded, cut, give_back, text_slices, words_of
from .components import components
from .simhash import join, keep_classes, majority, wide_stars

WIDTH = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Words of a fingerprint; the most bits in which near copies differ, in all and in the first half of the words.
WORDS, RADIUS, RADIUS_HALF = 4, 78, 46
#: The share of bits in which near copies differ at worst, and the chance that such a pair shares no node.
FLIP, MISS = 0.19, 1e-5
#: Unrelated members of a node, about.
NODE = 1024
#: Sets of a candidate group that a task compares.
GROUP = 2048
#: Members under one mask that a task reads, and edges, about.
PART, EDGES = 200_000, 1 << 18
#: Bits and wide places in which near copies agree.
AGREE, AGREE_WIDE = WORDS * 32 - RADIUS_HALF, WORDS * 64 - RADIUS
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MEMBERS = 1 << 17  # members of all nodes that a task packs at once
_NAMES = [f"w{k}" for k in range(WORDS)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text: text i has ``starts[i]:starts[i + 1]``."""
    flat, first = words_of(pc.ascii_lower(texts))
    codes, distinct = coded(flat)
    words = np.array([xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()], np.uint64)[codes]
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    starts = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    begin, end = np.arange(starts[-1]) - starts[text] + first[text], first[text + 1]
    value = np.zeros(len(text), np.uint64)
    for k in range(width):
        inside = begin + k < end
        value[inside] = _mix(value[inside] * _M2 + words[begin[inside] + k] + np.uint64(k + 1))
    value = value[np.lexsort((value, text))]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(n)))]).astype(np.int64)


def set_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    data = values.tobytes()
    return np.array([xxhash.xxh64_intdigest(data[s:e], 7) for s, e in zip((starts[:-1] * 8).tolist(), (starts[1:] * 8).tolist(), strict=True)], np.uint64)


def prints(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fingerprint of each set, a row of WORDS words. Empty sets have zeros."""
    return np.stack([majority(_mix(values * _M2 + np.uint64(k + 1)), starts) for k in range(WORDS)], axis=1)


def masks_of(n: int) -> np.ndarray:
    """The upper nodes' masks in an index of n fingerprints, a row of WORDS words each. Every bit is used about equally often."""
    bits = max(0, round(math.log2(max(1, n) / NODE)))
    many = math.ceil(-math.log(MISS) / (1 - FLIP) ** bits) if bits else 1
    rng, out = np.random.default_rng(11), np.zeros((many, WORDS * 64), bool)
    deal = 64 * WORDS // max(1, bits)  # masks that one order of the bits gives
    for k in range(many):
        order = rng.permutation(WORDS * 64) if k % deal == 0 else order
        out[k, order[k % deal * bits : (k % deal + 1) * bits]] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def nodes_of(words: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The node of each fingerprint (row) under each mask (column), as a hash of the mask's number and the masked bits."""
    out = np.repeat(np.arange(1, len(masks) + 1, dtype=np.uint64)[None], len(words), axis=0)
    for w in range(WORDS):
        out = _mix(out * _M2 + (words[:, w, None] & masks[None, :, w]))
    return out


def signatures(values: np.ndarray, starts: np.ndarray, n: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set its nodes in an index of n, the first half of its fingerprint, and all its bits, one in a place."""
    words = prints(values, starts)
    return nodes_of(words, masks_of(n)), np.ascontiguousarray(words[:, : WORDS // 2]), np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")


def _keys(texts: pa.Array) -> np.ndarray:
    return set_keys(*shingle_sets(texts)).view(np.int64)


def prints_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the set's hash), n (its size) and the words of its fingerprint, one row per row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "_text", 1 << 21):
            values, starts = shingle_sets(texts)
            columns = [part.column(0), set_keys(values, starts).view(np.int64), np.diff(starts), *prints(values, starts).view(np.int64).T]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names=["doc_id", "fp", "n", *_NAMES])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return given.mapInArrow(count, f"doc_id long, fp long, n long, {', '.join(f'{w} long' for w in _NAMES)}")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first ``keys`` columns (longs), which lie together, however many batches they take."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        heads = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        for s, e in zip([0, *heads.tolist()], [*heads.tolist(), batch.num_rows], strict=True):
            if held and (names[s] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = names[s]
    if held:
        yield pa.Table.from_batches(held)


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["u", "v"])


def _by_run(edges_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], keys: int) -> Callable:
    """A function of batches that yields the edges that ``edges_of`` makes of each run, some at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, many = [], 0
        for rows in _runs(batches, keys):
            made = edges_of(rows)
            if len(made[0]):
                found.append(made)
                many += len(made[0])
            if many > 1 << 18:
                yield _edges(found)
                found, many = [], 0
        if found:
            yield _edges(found)
        give_back()

    return search


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect just what these do, each member's to the least one of its set."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(names))
    join(root, at[: len(u)], at[len(u) :])
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _thinned(edges: DataFrame) -> DataFrame:
    """The edges as a forest for every EDGES of them."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
        if parts:
            yield _edges([forest(*np.concatenate(parts, axis=1))])

    edges = cut(edges)
    return edges.repartition(max(1, -(-edges.count() // EDGES))).mapInArrow(thin, "u long, v long")


def candidates(distinct: DataFrame, n: int) -> DataFrame:
    """Edges u, v between sets (rows fp and the words of their fingerprint; n of them) that connect what links within the
    radius connect. Members go to tasks that have some nodes of one mask each, 40 bytes a member and mask."""
    masks = masks_of(n)
    parts = max(1, -(-n // PART))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, _MEMBERS // len(masks))
            for at in range(0, batch.num_rows, step):
                data = np.stack([c.to_numpy() for c in batch.slice(at, step).columns], axis=1).view(np.uint64)
                nodes = nodes_of(np.ascontiguousarray(data[:, 1:]), masks)
                task = (np.arange(len(masks)) * parts + (nodes % np.uint64(parts)).astype(np.int64)).reshape(-1)
                order = np.argsort(task, kind="stable")
                task, packed = task[order], data[order // len(masks)]
                heads = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1])
                ends = np.append(heads, len(task)).astype(np.int32) * np.int32((WORDS + 1) * 8)
                values = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([pa.array(task[heads]), values], names=["task", "members"])
                del data, nodes, task, order, packed, values
            give_back()

    def links(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint64).reshape(-1, WORDS + 1)
        mask = rows.column(0)[0].as_py() // parts
        node = nodes_of(data[:, 1:], masks[mask : mask + 1])[:, 0]
        data = data[np.argsort(node, kind="stable")]
        node.sort()
        heads = np.flatnonzero(np.diff(node, prepend=~node[:1]))
        found = [np.zeros((2, 0), np.int64)]
        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(node)], strict=True):
            if e - s > 1:
                own, root = wide_stars(data[s:e, 1:], RADIUS, RADIUS_HALF)
                found.append(np.stack([data[s + own, 0], data[s + root, 0]]).view(np.int64))
        return tuple(np.concatenate(found, axis=1))

    dealt = distinct.select("fp", *_NAMES).mapInArrow(deal, "task long, members binary")
    dealt = dealt.repartition("task").sortWithinPartitions("task")
    return _thinned(dealt.mapInArrow(_by_run(links, 1), "u long, v long"))


def alike(own: np.ndarray, values: np.ndarray, starts: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Those of the sets ``some`` that have the least similarity to the set ``own``."""
    size = starts[some + 1] - starts[some]
    fits = LEAST[1] * np.minimum(size, len(own)) >= LEAST[0] * np.maximum(size, len(own))
    some, size = some[fits], size[fits]
    if not len(some):
        return some
    ends = np.cumsum(size)
    theirs = values[np.arange(ends[-1]) + np.repeat(starts[some] - ends + size, size)]
    hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
    shared = np.add.reduceat(hit, ends - size, dtype=np.int64)
    return some[shared * sum(LEAST) >= LEAST[0] * (size + len(own))]


def joined(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) as places of sets that have the least similarity to another, or are reached over such links."""
    root = np.arange(len(starts) - 1)
    todo = root.copy()
    while len(todo) > 1:
        top, todo = todo[0], todo[1:]
        reached = [top]
        while reached and len(todo):
            p = reached.pop()
            near = alike(values[starts[p] : starts[p + 1]], values, starts, todo)
            root[near] = top
            reached += near.tolist()
            todo = np.setdiff1d(todo, near, assume_unique=True)
    own = np.flatnonzero(root != np.arange(len(root)))
    return own, root[own]


def joined_across(values: np.ndarray, starts: np.ndarray, label: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places) between sets that ask and others of another label that join all labels such links can join."""
    names, at = np.unique(label, return_inverse=True)
    root, found = np.arange(len(names)), [np.zeros((2, 0), np.int64)]
    for p in np.flatnonzero(asks).tolist():
        now = root[at]
        near = alike(values[starts[p] : starts[p + 1]], values, starts, np.flatnonzero(now != now[p]))
        near = near[np.unique(now[near], return_index=True)[1]]  # one link for each label
        if len(near):
            found.append(np.stack([np.full(len(near), p), near]))
            join(root, np.full(len(near), at[p]), at[near])
    return tuple(np.concatenate(found, axis=1))


def _lists(rows: pa.Table, column: int) -> tuple[np.ndarray, np.ndarray]:
    lists = rows.column(column).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy().view(np.uint64), at - at[0]


def _group_links(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    fp = rows.column(2).to_numpy()
    own, root = joined(*_lists(rows, 3))
    return fp[own], fp[root]


def _cross_links(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    fp, label, asks = (rows.column(k).to_numpy() for k in (3, 4, 5))
    a, b = joined_across(*_lists(rows, 6), label, asks == 1)
    return fp[a], fp[b]


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``wanted`` (fp, id and more, one row per fp) with each fp's set, from the rows that have these ids only."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, "_text", 1 << 21):
            values, starts = shingle_sets(texts)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(values, starts).view(np.int64)), lists], names=["fp", "set"])

    given = docs.select(F.col(doc_id).cast("long").alias("least"), F.col(text).alias("_text"))
    rows = beside(given, wanted.select("least").where("least IS NOT NULL").distinct(), "least", "left_semi")
    if not wanted.where("least IS NULL").isEmpty():
        rows = rows.unionByName(given.where("least IS NULL"))
    made = rows.select("_text").mapInArrow(make, "fp long, set array<long>")
    return beside(made, wanted.drop("least"), "fp", "inner").dropDuplicates(["fp"])


def _across(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Links between members (root, fp, tasks, set) of one group and different components, but for those within the group's
    largest component. The sets outside it, by the GROUP, meet the group's sets, by the GROUP, in a task each."""
    roots = components(edges).withColumnRenamed("u", "fp").withColumnRenamed("root", "own")
    rooted = cut(members.drop("set").join(roots, "fp", "left").withColumn("own", F.coalesce("own", "fp")))
    most = rooted.groupBy("root", "own").count().groupBy("root").agg(F.max_by("own", F.struct("count", "own")).alias("most"), F.sum("count").alias("n"), F.max("count").alias("_n"))
    most = most.select("root", "most", F.ceil((F.col("n") - F.col("_n")) / F.lit(GROUP)).alias("asking"))
    rooted = cut(rooted.join(most, "root").where("asking > 0")).join(members.select("fp", "set"), "fp")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("long")
    asking = rooted.where("own <> most").select("root", own("asking").alias("i"), every("tasks").alias("j"), "fp", "own", F.lit(1).cast("long").alias("asks"), "set")
    others = rooted.select("root", every("asking").alias("i"), own("tasks").alias("j"), "fp", "own", F.lit(0).cast("long").alias("asks"), "set")
    tasks = asking.unionByName(others).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return tasks.mapInArrow(_by_run(_cross_links, 3), "u long, v long")


def classes_of(prints: DataFrame, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """fp, root (an fp that names the component) and component_id of each distinct set."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", *_NAMES)]))
    filled = distinct.where("n > 0")
    roots = components(candidates(filled, filled.count())).withColumnRenamed("u", "fp")
    groups = cut(roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()))
    many = groups.groupBy("root").agg(F.ceil(F.count("*") / F.lit(GROUP)).alias("tasks"))
    wanted = cut(groups.join(many, "root").join(distinct.select("fp", "least"), "fp").select("fp", "least", "root", "tasks"))
    large = not wanted.where("tasks > 1").isEmpty()
    sets = _sets(docs, wanted, doc_id, text)
    sets = cut(sets) if large else sets
    tasks = sets.select("root", F.pmod(F.xxhash64("fp"), F.col("tasks")).cast("long").alias("task"), "fp", "set")
    tasks = tasks.repartition("root", "task").sortWithinPartitions("root", "task")
    edges = cut(tasks.mapInArrow(_by_run(_group_links, 2), "u long, v long"))
    if large:
        edges = cut(edges.unionByName(_thinned(_across(sets.where("tasks > 1"), edges))))
    roots = components(edges).withColumnRenamed("u", "fp")
    named = distinct.select("fp", "least").join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id."""
    prints = cut(prints_of(docs, doc_id=doc_id, text=text))
    classes = cut(classes_of(prints, docs, doc_id=doc_id, text=text))
    return keep_classes(docs, prints.select("doc_id", "fp"), classes, _keys, doc_id=doc_id, text=text)
