"""Chat formatting: logged snapshots are collapsed to maximal conversations, which are then rendered.

A conversation that another one begins with is a snapshot of it. Each turn has a 128-bit hash of its
place, role and text; the hash of a prefix is the sum of its turns' hashes in four lanes, a rolling
hash that needs no order within a block of turns. A conversation stays if no longer one has its hash
as that of a prefix (an anti-join), and of equal ones the smallest id stays. All this is done on
hashes; texts are moved once, to be rendered.

Defined results: a turn without a conversation id is a conversation of its own, with id null; a null
turn number, role or text is a value like any other, unequal to the empty string; rows that repeat
count once; turns with one number are ordered by role and text, and a prefix has all or none of them.
Of over CROWD different turns with one number, each goes to one of several pieces by its hash. Very long
texts are rendered whole. Empty tables give empty results; other columns, of whatever names, don't
matter. Rendering escapes nothing; null texts render as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turn numbers in a block: what is ordered or rendered in one go, however long a conversation is.
BLOCK = 256
#: Different turns of one number in a piece, about.
CROWD = 1024
_LANES = ("a", "b", "c", "d")
_SUMS = ("n", *_LANES)


def _given(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """key (what tells conversations apart), part (the block), turn, role, text and the turn's four 32-bit hashes,
    whose sums can't overflow a long below 2**31 turns."""
    named = df.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    given = [F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("="), "role"), F.lit("-")), F.coalesce(F.concat(F.lit("="), "text"), F.lit("-"))]
    hashed = named.withColumns({"low": F.xxhash64(*given), "high": F.xxhash64(F.lit(1), *given)})
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.concat(F.lit("t"), F.hex("low"), F.lit("-"), F.hex("high")))
    part, mask = F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK), F.lit(0xFFFFFFFF)
    lanes = (F.col("low").bitwiseAND(mask), F.shiftrightunsigned("low", 32), F.col("high").bitwiseAND(mask), F.shiftrightunsigned("high", 32))
    return hashed.select(key.alias("key"), part.alias("part"), "turn", "role", "text", *[c.alias(n) for c, n in zip(lanes, _LANES, strict=True)])


def _conv_id(key: Column) -> Column:
    return F.when(key.startswith("c"), F.substr(key, F.lit(2)).cast("long"))


def _steps(given: DataFrame) -> DataFrame:
    """A row per conversation and turn number: how many turns it has and the sums of their hashes. Texts aren't moved;
    rows that repeat are made one in part before the shuffle."""
    own = given.select("key", "part", "turn", *_LANES).distinct()
    return own.groupBy("key", "part", "turn").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in _LANES])


def maximal(steps: DataFrame) -> DataFrame:
    """key, n_turns and copies (equal conversations) of those that stay.

    Sums per conversation and per block are made in part before they are shuffled. Running sums go
    over blocks first and over the turns of a block then, so no task orders more of a
    conversation than its blocks. Prefixes are made distinct before the anti-join: a first turn that
    many conversations share is one row there.
    """
    total = lambda df, *keys: df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = total(steps, "key", "part").select("key", "part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}0") for c in _SUMS])
    within = Window.partitionBy("key", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = steps.select("key", "part", *[F.sum(c).over(within).alias(c) for c in _SUMS])
    prefixes = rolling.join(before, ["key", "part"]).select("key", *[(F.col(c) + F.col(f"{c}0")).alias(c) for c in _SUMS])
    whole = cut(total(steps, "key"))
    first = F.min(F.struct(_conv_id(F.col("key")).isNull().alias("none"), _conv_id(F.col("key")).alias("conv"), "key"))
    ids = whole.groupBy(*_SUMS).agg(first.alias("first"), F.count("*").alias("copies"))
    proper = prefixes.join(whole.select("key", F.col("n").alias("total")), "key").where("n < total").select(*_SUMS).distinct()
    return ids.join(proper, list(_SUMS), "left_anti").select("first.key", F.col("n").alias("n_turns"), "copies")


def collapse_and_render(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, part, piece, n_turns (of the conversation), copies and chat: the part's turns in order, each as
    <|role|>, its text and <|end|> on lines of their own. A conversation of over BLOCK turns has several parts; a
    part has one piece unless turns crowd under one number.

    Texts go to the blocks they are rendered in, repeated rows made one before, and there meet the
    conversations that stay: one shuffle of texts.
    """
    given = _given(df, conv_id, turn, role, text)
    steps = cut(_steps(given))
    kept = maximal(steps)
    crowded = steps.where(F.col("n") > CROWD).select("key", F.col("turn").alias("crowd_turn"), F.ceil(F.col("n") / CROWD).alias("pieces"))
    parts, rows = steps.groupBy("key", "part").agg(F.max(F.ceil(F.col("n") / CROWD)).alias("pieces")), given.withColumn("piece", F.lit(0).cast("long"))
    if not crowded.isEmpty():
        at = F.pmod(F.col("a"), F.coalesce("pieces", F.lit(1)))
        rows = given.join(crowded.withColumnRenamed("key", "crowd_key"), (F.col("key") == F.col("crowd_key")) & F.col("turn").eqNullSafe(F.col("crowd_turn")), "left").withColumn("piece", at)
    line = F.struct("turn", "role", "text")
    grouped = rows.groupBy("key", "part", "piece").agg(F.sort_array(F.collect_set(line)).alias("rows"))
    wanted = kept.join(parts, "key").select("key", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "n_turns", "copies")
    written = F.transform("rows", lambda r: F.concat(F.lit("<|"), F.coalesce(r["role"], F.lit("")), F.lit("|>\n"), F.coalesce(r["text"], F.lit("")), F.lit("\n<|end|>\n")))
    return grouped.join(wanted, ["key", "part", "piece"]).select(_conv_id(F.col("key")).alias("conv_id"), "part", "piece", "n_turns", "copies", F.array_join(written, "").alias("chat"))
