"""Token ids in binary files, packed by Simple-8b word-aligned coding.

A 64-bit word has a selector in its upper four bits, which says how many ids it holds and in how many
bits each, the first in the lowest bits. Selector 0 is an escape: the word holds a place in the
file's list of wide ids, those of over 60 bits. Ids are packed in blocks of BLOCK; no word spans
two blocks, and the file lists where each block's words begin, so that any block, or all words
of a file at once, can be decoded without a loop over ids.

A file (little-endian) has: MAGIC, five 64-bit counts (documents, ids, words, wide ids, BLOCK), per
document its id (64 bits), whether it has one (a byte) and its number of ids (64 bits), per block and
for the end the number of words before it (64 bits), the words, the wide ids.

Files hold documents in ascending order of id, null first, those of one id by a hash of the text;
the files of a corpus follow one another by task and number, which their names carry. A null text is the
empty text: its document has the end id alone. An empty table has no files and decodes to an empty
table. Rows that repeat are written as often as they come; a very long text is encoded whole, in one
task; columns other than id and text, of whatever names, don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import letters, vocabulary
from .common import cut, shared_folder, text_slices
from .pieces import SUFFIX, Splitter, TextEncoder

MAGIC = b"S8BIDS01"
BLOCK = 1024
#: Ids in a word and bits of each, by selector; 0 is the escape, 15 isn't used.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
_MOST = int(COUNTS.max())
#: Ids after which a task begins a new file: what it holds in memory.
FILE_IDS = 16_000_000


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """How many bits each value has. Values below 2**16, as most ids are, are looked up."""
    high = values >> np.uint64(16)
    if not high.any():
        return _LENGTH_OF[values]
    out, own = _LENGTH_OF[values & np.uint64(0xFFFF)], np.flatnonzero(high)
    out.reshape(-1)[own] = 16 + _bit_lengths(high.reshape(-1)[own])
    return out


_LENGTH_OF = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the number of words before each block and the wide ids. All blocks are packed side by side:
    each step takes the next word of every block, the one that holds most ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    wide_row = BLOCK + _MOST  # zeros after a block: its last word may hold fewer ids than it could
    values = np.zeros((blocks, wide_row), np.uint64)
    values[: n // BLOCK, :BLOCK] = ids[: n // BLOCK * BLOCK].reshape(-1, BLOCK)
    if n % BLOCK:
        values[-1, : n % BLOCK] = ids[n // BLOCK * BLOCK :]
    values = values.reshape(-1)
    length = _bit_lengths(values)
    # a selector that fits means that all with fewer, wider places fit: so the ones that fit are counted
    selector = np.full(len(values), 14, np.uint8)
    most, span = length, 1
    for s in range(13, 0, -1):
        count = int(COUNTS[s])
        while span < count:
            step = min(span, count - span)
            most = np.maximum(most[: len(most) - step], most[step:])
            span += step
        selector[: len(most)] -= most <= BITS[s]
    wide = np.zeros(0, np.uint64)
    if (length > 60).any():
        wide = values[length > 60]
        selector[length > 60] = 0
    jump = COUNTS[selector]
    starts = np.zeros(len(values), bool)
    at = np.arange(blocks) * wide_row
    end = at + np.minimum(n - np.arange(blocks) * BLOCK, BLOCK)
    while len(at):
        starts[at] = True
        at = at + jump[at]
        more = at < end
        if not more.all():
            at, end = at[more], end[more]
    begin = np.flatnonzero(starts)
    chosen = selector[begin]
    words = np.zeros(len(begin), np.uint64)
    for s in range(1, 15):
        own = np.flatnonzero(chosen == s)
        if len(own):
            place, word = begin[own], np.full(len(own), s << 60, np.uint64)
            for k in range(int(COUNTS[s])):
                word |= values[place + k] << np.uint64(k * int(BITS[s]))
            words[own] = word
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, np.searchsorted(begin, np.arange(blocks + 1) * wide_row).astype(np.int64), wide


def unpack(words: np.ndarray, offsets: np.ndarray, wide: np.ndarray, n: int) -> np.ndarray:
    """The ids of all blocks, or of those that ``offsets`` names; ``n`` is how many ids they hold."""
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    count = COUNTS[chosen]
    total = np.concatenate([[0], np.cumsum(count)])
    per_block = np.diff(offsets)
    begin = total[offsets[:-1]]
    at = total[:-1] + np.repeat(np.arange(len(per_block)) * BLOCK - begin, per_block)
    out = np.zeros(n, np.uint64)
    last = np.zeros(len(words), bool)
    last[offsets[1:][per_block > 0] - 1] = True  # only a block's last word may hold fewer ids than it could
    for s in range(1, 15):
        every = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for own, some in ((every[~last[every]], False), (every[last[every]], True)):
            if not len(own):
                continue
            word, place = words[own], at[own]
            valid = np.minimum((place // BLOCK + 1) * BLOCK, n) - place if some else None
            for k in range(int(COUNTS[s])):
                ids = (word >> np.uint64(k * int(BITS[s]))) & mask
                if some:
                    out[place[valid > k] + k] = ids[valid > k]
                else:
                    out[place + k] = ids
    own = np.flatnonzero(chosen == 0)
    out[at[own]] = wide[words[own].astype(np.int64)]
    return out


def to_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, wide = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(words), len(wide), BLOCK], "<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8"), known, np.asarray(counts, "<i8"), offsets.astype("<i8"), words.astype("<u8"), wide.astype("<u8")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of packed token ids")
    docs, n, n_words, n_wide, block = np.frombuffer(data, "<u8", 5, 8).astype(int).tolist()
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    at, out = 48, []
    for kind, k in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", -(-n // BLOCK) + 1), ("<u8", n_words), ("<u8", n_wide)):
        out.append(np.frombuffer(data, kind, k, at))
        at += k * np.dtype(kind).itemsize
    doc, known, counts, offsets, words, wide = out
    return [d if k else None for d, k in zip(doc.tolist(), known.tolist(), strict=True)], counts, unpack(words, offsets, wide, n)


def library_words(content: str) -> Callable[[list[str]], list[bytes]]:
    """The tokenizers library's model over lists of distinct words: their ids as bytes."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_str(content)
    whole.no_truncation()
    whole.no_padding()
    model = Tokenizer(whole.model)
    model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    vocab = whole.get_vocab(with_added_tokens=True)
    is_end = np.zeros(max(vocab.values()) + 1, bool)
    is_end[[i for s, i in vocab.items() if s.endswith(SUFFIX)]] = True

    def encode(words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), 50_000):
            some = list(map(letters, words[k : k + 50_000]))
            lines = [" ".join(some[j : j + 1000]) for j in range(0, len(some), 1000)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in model.encode_batch_fast(lines, add_special_tokens=False)])
            ends = 4 * (np.flatnonzero(is_end[ids]) + 1)
            if len(ends) != len(some):
                raise ValueError("words and their ends differ")
            data, begin = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(data[begin:end])
                begin = end
        return out

    return encode


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(content: str) -> TextEncoder:
    """The worker's encoder for a vocabulary, made once per process."""
    name = hashlib.sha1(content.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = TextEncoder(Splitter(content), library_words(content))
    return _ENCODERS[name]


def _with_ends(texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, each with the end id after it, and how many each has."""
    counts = pc.binary_length(texts).to_numpy().astype(np.int64) // 4
    ends = np.cumsum(counts)
    out = np.full(int(ends[-1]) + len(counts), end_id, np.uint32)
    inner = np.ones(len(out), bool)
    inner[ends + np.arange(len(ends))] = False
    _, _, data = texts.buffers()
    out[inner] = np.frombuffer(data, "<u4")[: int(ends[-1])] if ends[-1] else []
    return out, counts + 1


def write(docs: DataFrame, path: str, folder: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Encode and write all documents under ``folder`` (a URI that all executors reach); returns the
    manifest: file (its name), docs and ids, one row per file, and the files stand when it is returned.

    Documents are dealt out by ranges of ids; each task sorts its range and writes whole files
    under names that a repeated attempt makes again, moved into place when complete.
    """
    content = vocabulary(docs.sparkSession, path)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    # rows of one id are told apart by their text, so that even a hot id is dealt out
    keyed = given.withColumn("_tie", F.xxhash64("_text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, attempt = _encoder(content.value), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        held, done = [], []

        def flush() -> None:
            doc_ids = [d for h in held for d in h[0]]
            name = f"part-{part:010d}-{len(done):06d}.s8b"  # wide enough for any task and all that it could write
            ids = np.concatenate([h[2] for h in held])
            with store.open_output_stream(f"{base}/.{name}.{attempt}") as out:
                out.write(to_bytes(doc_ids, np.concatenate([h[1] for h in held]), ids))
            store.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            done.append((name, len(doc_ids), len(ids)))
            held.clear()

        for rows, texts in text_slices(batches, "_text", 1 << 23):
            ids, counts = _with_ends(own(texts), end_id)
            held.append((rows.column(0).to_pylist(), counts, ids))
            if sum(len(h[2]) for h in held) >= FILE_IDS:
                flush()
        if held:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["file", "docs", "ids"])

    return cut(keyed.mapInArrow(run, "file string, docs long, ids long"))


def read(spark: SparkSession, folder: str, manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Documents of the manifest's files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    and, if asked for, ids (binary, little-endian 32-bit).

    Only the manifest is put in order, a row per file of millions of ids; files are read in parallel.
    """
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ids")
    files = manifest.select("file", before.alias("_before")).repartition(max(1, min(manifest.count(), 20_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}") as f:
                    doc_ids, counts, ids = from_bytes(f.read())
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                raw, at = memoryview(ids).cast("B") if len(ids) else memoryview(b""), (4 * np.concatenate([[0], ends])).tolist()
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
                for k in range(0, len(doc_ids), 10_000):
                    cells = [pa.array(doc_ids[k : k + 10_000], pa.int64()), pa.array(ends[k : k + 10_000] - counts[k : k + 10_000] + first), pa.array(counts[k : k + 10_000]), pa.array(crc[k : k + 10_000], pa.int64())]
                    if with_ids:
                        cells.append(pa.array([bytes(raw[s:e]) for s, e in zip(at[k : k + 10_000], at[k + 1 : k + 10_001], strict=False)], pa.binary()))
                    yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cells)])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def write_and_read(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the files (into a new shared folder unless one is given) and read them back."""
    folder = folder or shared_folder(docs.sparkSession, "token-ids")
    return read(docs.sparkSession, folder, write(docs, path, folder, doc_id=doc_id, text=text, end_id=end_id))
