"""Language identification with error-correcting output codes.

Each learned language gets a codeword. For each bit a binary classifier over hashed byte n-grams
is fitted; a text's language is the codeword nearest to the classifiers' margins, where nearness is
a logistic loss whose terms are weighted by how well a bit separates that language on the
training rows. A text whose two nearest codewords are about equally near is flagged.

Defined results: a null text, an empty one and one without a letter get ``und``, score 0 and
``ambiguous`` false; with no training row at all every text gets ``und``; with one learned
language every other text gets that one. Rows are judged one by one, so repeated rows, ties and other columns, of
whatever names, don't matter; ids may be null; a very long text is read whole, in one task; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, cut, numbered, text_slices

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class CodedModel:
    """``codes`` is languages x bits of -1 and 1; ``trust`` has the same shape and rows that sum to 1."""

    langs: tuple[str, ...]
    codes: np.ndarray
    trust: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    ambiguous_below: float = 0.2

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the likelihood, and whether the next is as near."""
        loss = np.logaddexp(0, -self.codes[None] * margins[:, None, :])  # texts x languages x bits
        near = -(self.trust[None] * loss).sum(axis=2) * self.codes.shape[1]
        share = np.exp(near - near.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        if share.shape[1] == 1:
            return best, share[:, 0], np.zeros(len(best), bool)
        top = np.sort(share, axis=1)
        return best, top[:, -1], top[:, -1] - top[:, -2] < self.ambiguous_below


def _folding() -> np.ndarray:
    """Bytes as the n-grams see them: ASCII other than letters is a space."""
    to = np.arange(256, dtype=np.uint32)
    ascii_ = np.arange(128)
    to[ascii_[~((ascii_ >= 97) & (ascii_ <= 122))]] = 32
    return to


_FOLDED = _folding()


def ngram_features(texts: pa.Array, buckets: int) -> np.ndarray:
    """Square roots of the shares of hashed byte 2-grams and 3-grams of each whole text, in lower case.

    Runs of spaces count as one. The first half of the buckets holds 3-grams, the second 2-grams.
    """
    raw, offsets = buffer_of(pc.utf8_lower(texts))
    n, half = len(texts), buckets // 2
    out = np.zeros((n, buckets), np.float32)
    if len(raw) < 2:
        return out
    b = _FOLDED[raw]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    pair = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    two = (doc[:-1] == doc[1:]) & ~((b[:-1] == 32) & (b[1:] == 32))
    three = two[:-1] & two[1:]
    h2 = ((pair ^ (pair >> 15)) * np.uint32(0x2C1B3C6D) >> 8) % half
    triple = (pair[:-1] ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    h3 = ((triple ^ (triple >> 15)) * np.uint32(0x2C1B3C6D) >> 8) % half
    counts = np.bincount(doc[:-2][three] * buckets + h3[three], minlength=n * buckets)
    counts += np.bincount(doc[:-1][two] * buckets + half + h2[two], minlength=n * buckets)
    out = counts.reshape(n, buckets).astype(np.float32)
    for part in (out[:, :half], out[:, half:]):
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1)
    return np.sqrt(out)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of ``n`` languages: all non-trivial two-way splits up to five languages, else the best
    of 64 random codes by the least distance between rows."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [[1 if (m >> k) & 1 else -1 for k in range(n - 1)] + [1] for m in range(2 ** (n - 1) - 1)]
        return np.array(splits, float).T
    bits, rng, best, least = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1.0
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(apart, np.inf)
        if apart.min() > least:
            best, least = code, apart.min()
    return best


def _fit_bits(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, rounds: int = 160) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers of all bits at once by accelerated gradient descent. Rows of ``x`` have norm sqrt(2) at most."""
    mean = x.mean(axis=0)
    xc = x - mean
    step = 4.0 / max(1e-6, 2 * float(weight.max()) * len(x))
    w = z = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = zb = np.zeros(y.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        f = xc @ z + zb
        g = -y * weight[:, None] / (1 + np.exp(np.clip(y * f, -30, 30)))
        w2, b2 = z - step * (xc.T @ g + l2 * z), zb - step * g.sum(axis=0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = np.float32((t - 1) / t2)
        z, zb, w, b, t = w2 + k * (w2 - w), b2 + k * (b2 - b), w2.astype(np.float32), b2.astype(np.float32), t2
        z, zb = z.astype(np.float32), zb.astype(np.float32)
    return w, b - mean @ w


def fit(x: np.ndarray, langs: list[str], ambiguous_below: float = 0.2) -> CodedModel:
    """A model from features and their languages, each language weighing the same."""
    known = tuple(sorted(set(langs)))
    at = np.searchsorted(np.array(known), langs) if known else np.zeros(0, int)
    codes = codewords(len(known))
    if len(known) < 2:
        bits = codes.shape[1]
        return CodedModel(known, codes, np.ones((len(known), bits)), np.zeros((x.shape[1], bits), np.float32), np.ones(bits, np.float32), ambiguous_below)
    y = codes[at].astype(np.float32)
    share = 1 / np.bincount(at, minlength=len(known)) / len(known)
    w, b = _fit_bits(x.astype(np.float32), y, share[at].astype(np.float32))
    right = (y * (x @ w + b) > 0).astype(float)
    per_lang = np.array([right[at == k].mean(axis=0) for k in range(len(known))])
    trust = np.maximum(per_lang - 0.5, 1e-3)
    return CodedModel(known, codes, trust / trust.sum(axis=1, keepdims=True), w, b, ambiguous_below)


def train(df: DataFrame, text: str, lang: str, doc_id: str, *, sample_rows: int = 4000, buckets: int = 4096, ambiguous_below: float = 0.2) -> CodedModel:
    """Fit on about ``sample_rows`` rows of ``df`` (twice as many at most), spread evenly over the languages.

    A row is drawn if a hash of its id falls below its language's share, so a hot language is
    counted in part before the shuffle and never ranked in one place. The sample is chosen from ids
    and languages alone; only the chosen rows' texts are read. It is the operator's only bound,
    and the only thing that reaches the driver.
    """
    ids = df.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang")).where("_id IS NOT NULL AND _lang IS NOT NULL")
    counts = cut(ids.groupBy("_lang").agg(F.count("*").alias("_n")))
    each = max(1, sample_rows // max(1, counts.count()))
    draw = F.shiftrightunsigned(F.xxhash64("_id"), 11) / float(1 << 53)
    chosen = ids.join(counts, "_lang").where(draw * F.col("_n") < each).select("_id").distinct().limit(2 * sample_rows)
    rows = df.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).where("_lang IS NOT NULL")
    rows = rows.join(F.broadcast(chosen), "_id").select("_lang", "_text")  # at most 2 * sample_rows ids

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "_text", 1 << 19, 200):
            x = ngram_features(texts, buckets)
            at = [np.flatnonzero(r).astype(np.uint16) for r in x]
            cells = [(a.tobytes(), r[a].tobytes()) for a, r in zip(at, x, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["lang", "at", "value"])

    # ids that repeat could bring more rows than ids
    drawn = rows.mapInArrow(features, "lang string, at binary, value binary").limit(2 * sample_rows).collect()
    got = sorted((r.lang, bytes(r.at), bytes(r.value)) for r in drawn if len(r.at))
    x = np.zeros((len(got), buckets), np.float32)
    for row, (_, at, value) in zip(x, got, strict=True):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    return fit(x, [r[0] for r in got], ambiguous_below)


def identify(df: DataFrame, model: CodedModel, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (the text may be one) with lang_pred, score (0 to 1) and ambiguous, which replace kept
    columns of their names; a row per row."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "ambiguous")]
    out = numbered(df, keep, text)
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    names = np.array([*model.langs, UNDETERMINED], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, f"c{len(keep)}", 1 << 19, 200):
            lettered = np.array([_LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            if model.langs:
                best, score, vague = model.decode(ngram_features(texts, len(model.weights)) @ model.weights + model.bias)
            else:
                lettered[:], best, score, vague = False, np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            best = np.where(lettered, best, len(model.langs))
            columns = [part.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(vague & lettered)], names=[*keep, "lang_pred", "score", "ambiguous"])

    return out.mapInArrow(judge, schema)
