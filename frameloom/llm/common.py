"""What the operators share: shared folders, checkpoints, Arrow batches of text and word dictionaries."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it

#: The separators of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, which the session must name: a folder of one machine won't do. Only a
    local session, which has one machine, may leave it out."""
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's URI under the shared checkpoint folder. It need not exist yet."""
    base = checkpoint_dir(spark)
    if "://" not in base and base.startswith("file:"):
        base = "file://" + base[len("file:") :]
    return f"{base}/{what}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate result through Spark's own file system, whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: lineage ends there and a lost executor costs nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a narrow table up to which it is broadcast (they are counted first); a larger one is joined by a shuffle.
SMALL = 1_000_000


def beside(rows: DataFrame, narrow: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined with a narrow table of counted size, which spares the rows a shuffle where it is SMALL."""
    return rows.join(F.broadcast(narrow) if narrow.count() <= SMALL else narrow, key, how)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name`` with as many underscores before it as make it unlike all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def numbered(df: DataFrame, keep: list[str], value: str) -> DataFrame:
    """Columns ``keep`` and ``value`` under names of their place, c0 and so on, which clash with none."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate([*keep, value])])


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(m)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and an executor's memory holds all of them."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def value_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int, max_rows: int = 10_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of about ``max_bytes`` of a string or binary column and ``max_rows`` at most (one row at least),
    with that column. However long a value is, it stays whole."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        done, n, part = 0, batch.num_rows, None
        while done < n:
            base = ends[done - 1] if done else 0
            to = min(done + max_rows, max(done + 1, int(np.searchsorted(ends, base + max_bytes, side="right"))))
            part = batch.slice(done, to - done)
            yield part, part.column(at)
            done = to
        del batch, part
        give_back()


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int, max_rows: int = 10_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The same with the texts as an unsliced array in which null is the empty text."""
    for part, values in value_slices(batches, column, max_bytes, max_rows):
        yield part, pa.concat_arrays([pc.fill_null(values, "").cast(pa.string())])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another (maximal runs without the SPACES), and where each
    text's words begin: text i has words ``starts[i]:starts[i + 1]``."""
    lists = pc.ascii_split_whitespace(texts)
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    filled = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(filled, min_count=0).as_py():  # a space at either end of a text leaves an empty string
        keep = filled.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        flat = flat.filter(filled)
    return flat, starts


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words as numbers, and the distinct words in that numbering."""
    if len(flat) == 0:
        return np.zeros(0, np.int32), pa.array([], pa.string())
    found = flat.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an unsliced string array, and each text's offsets in them."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int32)[: len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over ``values[starts[i]:starts[i + 1]]``; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]
