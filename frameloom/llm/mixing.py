"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic. Cell token weights are raked until
their marginals meet the targets; a cell's documents are then sampled with probability
proportional to raked over actual tokens, calibrated so that the expected tokens are the wanted share.

A round of raking is a grouped sum and a look-up for each dimension, and calibration is a few sums. Up to
DRIVER_CELLS cells, which are counted first, these steps run on arrays on the driver; with more the
same steps run on a table, a grouped sum and an equi-join for each dimension, and only single numbers
come to the driver.

Defined results: null dimensions are a value of their own; a null or empty text has 0 tokens and is
sampled with its cell's probability (1 where the cell has no tokens at all); a very long text counts
whole; rows with a null id are drawn by their text; rows that repeat an id share its fate; an empty
table gives an empty result; columns other than those used stay as they are, whatever their names.
Targets name shares for values; a value that is not named weighs 0, a named value that no document
has is left out and the other shares are scaled up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, free_name

#: What stands for a null dimension.
NONE = "(none)"
#: Cells up to which they are raked on the driver and broadcast to the documents; more are a table throughout and are dealt out with the documents, each in so many copies, among which a cell's documents are spread.
DRIVER_CELLS, COPIES = 200_000, 64
#: Rounds without progress after which raking ends.
STALLED = 3
#: Names that a dimension can't have.
_TAKEN = ("doc_id", "docs", "tokens", "raked", "prob", "weight", "draw", "sampled")


def token_count(text: Column) -> Column:
    """Words of the whole text, as its token measure."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACES), lambda w: w != "")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by form: licence notices, tables, marked-up text, else prose by length."""
    n = F.length(text)
    return (
        F.when(text.isNull(), F.lit(NONE))
        .when(text.contains("icense"), F.lit("licence"))
        .when(F.regexp_count(text, F.lit(r"\|")) * 40 > n, F.lit("table"))
        .when(F.regexp_count(text, F.lit("[#*$%&!]")) * 20 > n, F.lit("marked"))
        .when(n < 600, F.lit("short"))
        .when(n < 3000, F.lit("medium"))
        .otherwise(F.lit("long"))
    )


@dataclass(frozen=True)
class Raked:
    """One row per cell: the dimensions, docs, tokens, raked (tokens) and prob; and how many cells there are."""

    cells: DataFrame
    dims: tuple[str, ...]
    n: int


def _settled(apart: list[float], close: float) -> bool:
    """Whether raking ends after rounds whose factors differed by ``apart``: they are as good as equal, or for STALLED
    rounds, as with targets that no weights meet, they haven't come a hundredth nearer to each other."""
    last = apart[-STALLED - 1 :]
    return apart[-1] < close or (len(last) > STALLED and all(b > 0.99 * a for a, b in zip(last[:-1], last[1:], strict=True)))


def rake_arrays(tokens: np.ndarray, codes: Sequence[np.ndarray], shares: Sequence[np.ndarray], *, rounds: int = 500, close: float = 1e-10) -> np.ndarray:
    """Weights as near to ``tokens`` as raking gives, whose marginals are in proportion to ``shares`` (by code).

    A dimension's step multiplies the cells of each value by one factor. Steps are taken without scaling to the
    total, which later steps would undo; it is done once, at the end.
    """
    w, apart = tokens.astype(float), []
    for _ in range(rounds):
        factors = []
        for code, share in zip(codes, shares, strict=True):
            held = np.bincount(code, weights=w, minlength=len(share))
            factors.append(np.divide(share, held, out=np.zeros_like(held), where=(held > 0) & (share > 0))[code])
            w = w * factors[-1]
        some = w > 0
        if not some.any():
            return w
        apart.append(max(f[some].max() / f[some].min() - 1 for f in factors))
        if _settled(apart, close):
            break
    return w * (tokens.sum() / w.sum())


def calibrate_arrays(tokens: np.ndarray, raked: np.ndarray, keep: float | None) -> float | None:
    """``calibration`` on arrays."""
    own = raked > 0
    t, r = tokens[own].astype(float), raked[own]
    if not len(t):
        return None
    if keep is None:
        return 1 / (r / t).max()
    wanted = keep * float(tokens.sum())
    if wanted >= t.sum():
        return float("inf")
    c, capped = 0.0, -1
    while True:
        over = c * (r / t) > 1
        if over.sum() == capped or not r[~over].sum():
            return c
        c, capped = (wanted - t[over].sum()) / r[~over].sum(), over.sum()


def _shares(cells: DataFrame, dim: str, target: Mapping[str, float] | float) -> DataFrame:
    """dim and share: as named, or proportional to a power of the tokens (below 1, small values gain)."""
    if isinstance(target, Mapping):
        return cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in target.items()], "value string, share double").withColumnRenamed("value", dim)
    power = F.pow(F.sum("tokens").cast("double") / F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 1)), F.lit(float(target)))
    return cut(cells.groupBy(dim).agg(F.when(F.sum("tokens") > 0, power).otherwise(0.0).alias("share")))


def rake(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping[str, float] | float], *, rounds: int = 500, close: float = 1e-10) -> DataFrame:
    """``cells`` with raked: the steps of ``rake_arrays`` on a table of any number of cells."""
    shares = [_shares(cells, d, targets[d]) for d in dims]
    now = cells.withColumn("raked", F.col("tokens").cast("double"))
    factors = [f"factor{k}" for k in range(len(dims))]
    apart: list[float] = []
    for _ in range(rounds):
        now = now.drop(*factors)
        for dim, share, name in zip(dims, shares, factors, strict=True):
            sums = now.groupBy(dim).agg(F.sum("raked").alias("held")).join(share, dim, "left")
            factor = F.when((F.col("held") > 0) & (F.col("share") > 0), F.col("share") / F.col("held")).otherwise(0.0)
            now = now.join(sums.select(dim, factor.alias(name)), dim).withColumn("raked", F.col("raked") * F.col(name))
        now = cut(now)
        row = now.where("raked > 0").agg(*[(F.max(n) / F.min(n) - 1).alias(n) for n in factors], F.sum("raked").alias("total")).first()
        if row.total is None:
            break
        apart.append(max(row[n] for n in factors))
        if _settled(apart, close):
            break
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    return now.drop(*factors).withColumn("raked", F.col("raked") * F.lit(float(total) / (row.total or 1.0)))


def calibration(raked: DataFrame, keep: float | None) -> float | None:
    """The c for which min(1, c * raked / tokens) keeps ``keep`` of all tokens on average, or, where the cells with
    a weight hold fewer, keeps all of theirs (infinity); without ``keep``, the largest c that caps nothing. None without a weight.

    Each step solves for c with the cells that the last c caps; c only grows, and the cells are finite, so it ends.
    """
    ratio = F.col("raked") / F.col("tokens")
    own = raked.where("raked > 0")
    row = own.agg(F.max(ratio).alias("most"), F.sum("tokens").alias("held")).first()
    if row.most is None:
        return None
    if keep is None:
        return 1 / row.most
    wanted = keep * float(raked.agg(F.sum("tokens")).first()[0])
    if wanted >= row.held:
        return float("inf")
    c, capped = 0.0, -1
    while True:
        over = F.lit(c) * ratio > 1
        row = own.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("raked"))).alias("rest")).first()
        if row.n == capped or not row.rest:
            return c
        c, capped = (wanted - row.full) / row.rest, row.n


def measure(docs: DataFrame, dims: Mapping[str, Column], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the dimensions, tokens and a uniform draw per row: a narrow table of the documents."""
    if set(dims) & set(_TAKEN):
        raise ValueError(f"dimensions can't have the names {sorted(set(dims) & set(_TAKEN))}")
    columns = [_value(c).alias(name) for name, c in dims.items()]
    return docs.select(F.col(doc_id).alias("doc_id"), *columns, token_count(F.col(text)).alias("tokens"), _draw(doc_id, text).alias("draw"))


def _value(dim: Column) -> Column:
    return F.coalesce(dim.cast("string"), F.lit(NONE))


def _draw(doc_id: str, text: str) -> Column:
    """A number from 0 to 1 that depends on the id alone, or on the text of a row without one."""
    drawn = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.col(text), F.lit("")), F.lit("draw"))
    return F.shiftrightunsigned(drawn, 11) / float(1 << 53)


def fit(measured: DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping[str, float] | float], *, keep: float | None = None, rounds: int = 500, close: float = 1e-10) -> Raked:
    """Rake the cells. A target is shares by value, or a power that tempers the marginal.

    Cells are pre-aggregated before the shuffle; a hot source is as many partial rows as tasks.
    """
    cells = cut(measured.groupBy(*dims).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")))
    n = cells.count()
    if not n:
        return Raked(cells.withColumns({"raked": F.lit(0.0), "prob": F.lit(1.0)}), tuple(dims), 0)
    if n <= DRIVER_CELLS:
        got = cells.toPandas()
        tokens, codes, shares = got["tokens"].to_numpy(), [], []
        for dim in dims:
            code, values = pd.factorize(got[dim])
            held = np.bincount(code, weights=tokens, minlength=len(values)) / max(1, tokens.sum())
            target = targets[dim]
            codes.append(code)
            shares.append(np.array([target.get(v, 0.0) for v in values]) if isinstance(target, Mapping) else np.where(held > 0, held ** float(target), 0.0))
        got["raked"] = rake_arrays(tokens, codes, shares, rounds=rounds, close=close)
        c = calibrate_arrays(tokens, got["raked"].to_numpy(), keep)
        raked = cells.sparkSession.createDataFrame(got.to_records(index=False).tolist(), cells.schema.add("raked", "double"))
    else:
        raked = rake(cells, dims, targets, rounds=rounds, close=close)
        c = calibration(raked, keep)
    ratio = F.col("raked") / F.col("tokens")
    prob = F.lit(0.0) if c is None else F.when(F.col("raked") > 0, F.least(F.lit(1.0), F.lit(c) * ratio)).otherwise(0.0)
    weighed = raked.withColumn("prob", F.when(F.col("tokens") > 0, prob).otherwise(1.0))
    return Raked(weighed if n <= DRIVER_CELLS else cut(weighed), tuple(dims), n)


def _joined(rows: DataFrame, cells: DataFrame, keys: list[str], n: int, draw: str) -> DataFrame:
    """Rows with their cells' columns: the cells are broadcast, or with many of them each goes to COPIES places,
    among which ``draw`` spreads its rows, so that a hot cell is no hot key."""
    if n <= DRIVER_CELLS:
        return rows.join(F.broadcast(cells), keys)
    place = free_name([*rows.columns, *cells.columns], "place")
    spread = cells.withColumn(place, F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return rows.withColumn(place, F.floor(F.col(draw) * COPIES).cast("int")).join(spread, [*keys, place]).drop(place)


def draw(measured: DataFrame, raked: Raked) -> DataFrame:
    """``measured`` with weight (raked over actual tokens), prob and sampled."""
    weight = F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(0.0)
    cells = raked.cells.select(*raked.dims, weight.alias("weight"), "prob")
    return _joined(measured, cells, list(raked.dims), raked.n, "draw").withColumn("sampled", F.col("draw") < F.col("prob"))


def mix(docs: DataFrame, dims: Mapping[str, Column], targets: Mapping[str, Mapping[str, float] | float], *, keep: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled rows of ``docs`` with all their columns. The text isn't shuffled where the cells are broadcast."""
    raked = fit(measure(docs, dims, doc_id=doc_id, text=text), list(dims), targets, keep=keep)
    own = {d: free_name(docs.columns, f"dim{k}") for k, d in enumerate(dims)}
    prob, drawn = free_name(docs.columns, "prob"), free_name(docs.columns, "draw")
    cells = raked.cells.select(*[F.col(d).alias(n) for d, n in own.items()], F.col("prob").alias(prob))
    rows = docs.withColumns({own[d]: _value(c) for d, c in dims.items()} | {drawn: _draw(doc_id, text)})
    return _joined(rows, cells, list(own.values()), raked.n, drawn).where(F.col(drawn) < F.col(prob)).select(*[docs[c] for c in docs.columns])
