"""Whole texts to token ids by way of distinct pieces and words, for vocabularies that drop white space.

Texts are cut at ASCII white space into pieces; distinct pieces are split into words, distinct words are
encoded, and ids are gathered back: words to pieces, pieces to texts. All of it but the encoding of
words that a worker hasn't seen lately is Arrow's vectorised work.

Splitting equals the tokenizers library for every code point. Pieces of plain characters go through
one lower-casing and one pattern for all pieces at once; a character is plain if it stands in a block
without combining marks and the library's own normaliser and splitter give, on probes with it, what
that path gives. Every other piece, and every piece with a special token's text, goes through the
library's normaliser and splitter.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import coded, words_of

#: The pre-tokenising pattern that this kind of vocabulary is made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
#: Blocks where no character composes with the one before it: Latin, Greek, Cyrillic, Armenian letters and punctuation.
_BLOCKS = ((0x00, 0x300), (0x370, 0x483), (0x48A, 0x590), (0x1E00, 0x1F00), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C1))
#: Words whose ids a worker keeps, the ones used last.
KEPT_WORDS = 400_000


def grouped(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """Binary values joined in runs: run i is ``values[starts[i]:starts[i + 1]]``. No byte is copied."""
    if len(values) == 0:
        return pa.array([b""] * (len(starts) - 1), pa.binary())
    _, ends, data = values.buffers()
    offsets = np.frombuffer(ends, np.int32)[values.offset :][starts]
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), data if data is not None else pa.py_buffer(b"")])


def _merged(first: np.ndarray, a: pa.Array, a_starts: np.ndarray, b: pa.Array, b_starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Runs of a, where ``first`` says so, and of b in one order."""
    at, count = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    at[first], count[first] = a_starts[:-1], np.diff(a_starts)
    at[~first], count[~first] = b_starts[:-1] + len(a), np.diff(b_starts)
    ends = np.concatenate([[0], np.cumsum(count)])
    return pa.concat_arrays([a, b]).take(pa.array(np.repeat(at - ends[:-1], count) + np.arange(ends[-1]))), ends


class Splitter:
    """Pieces without ASCII white space as words; a special token's text is a word of its own."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        parts = [p["type"] for p in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != SUFFIX or model["continuing_subword_prefix"] or model["dropout"] or model["ignore_merges"] or parts != ["NFC", "Replace", "Lowercase"] or split["pattern"]["Regex"] != PATTERN or spec["decoder"] is not None:
            raise ValueError("not a vocabulary of the kind that this encoder reads")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings")
        whole = Tokenizer.from_str(content)
        self._normalise, self._split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._odd = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in self._plain_ranges()) + "]"
        if self._specials:
            self._odd += "|" + "|".join(map(regex.escape, self.special))

    def _plain_ranges(self) -> list[tuple[int, int]]:
        spaces = set(range(9, 14)) | {32}
        chars = [c for a, b in _BLOCKS for c in range(a, b) if c not in spaces]
        probes = [p for c in map(chr, chars) for p in (c, f"a{c}", f"!{c}", f"1{c}", f"'{c}", c + c)]
        words, starts = self._plain_words(pa.array(probes, pa.string()))
        words = words.to_pylist()
        same = [words[s:e] == self.library_words(p) for p, s, e in zip(probes, starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        plain = [c for k, c in enumerate(chars) if all(same[6 * k : 6 * k + 6])]
        out: list[tuple[int, int]] = []
        for c in plain:
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
        return out

    def library_words(self, piece: str) -> list[str]:
        """The library's words of one piece, normalised."""
        out: list[str] = []
        for k, part in enumerate(self._specials.split(piece) if self._specials else [piece]):
            if k % 2:
                out.append(part)
            elif part:
                plain = self._normalise(part)
                out += [plain[s:e] for _, (s, e) in self._split(plain)]
        return out

    def _plain_words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of one run of letters are a word; the others are cut by the pattern."""
        low = pc.utf8_lower(pieces)
        one = pc.match_substring_regex(low, r"^\p{L}+$")
        marked = pc.replace_substring_regex(low.filter(pc.invert(one)), f"({PATTERN})", r"\1 ")
        cut, starts = words_of(pa.concat_arrays([marked]))
        whole = low.filter(one)
        return _merged(one.to_numpy(zero_copy_only=False), whole, np.arange(len(whole) + 1), cut, starts)

    def words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces' words one after another, and where each piece's words begin."""
        odd = pc.match_substring_regex(pieces, self._odd)
        plain, starts = self._plain_words(pieces.filter(pc.invert(odd)))
        if len(starts) > len(pieces):
            return plain, starts
        own = list(map(self.library_words, pieces.filter(odd).to_pylist()))
        ends = np.concatenate([[0], np.cumsum([len(w) for w in own])])
        return _merged(odd.to_numpy(zero_copy_only=False), pa.array([x for w in own for x in w], pa.string()), ends, plain, starts)


class TextEncoder:
    """Texts to ids. ``encode`` gives the ids (little-endian, 32 bits) of each of a list of distinct words."""

    def __init__(self, splitter: Splitter, encode: Callable[[list[str]], list[bytes]], keep: int = KEPT_WORDS):
        self.splitter, self._encode, self._keep = splitter, encode, keep
        self._words, self._ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def _fresh(self, words: list[str]) -> pa.Array:
        special = self.splitter.special
        own = [w for w in words if w not in special]
        ids = iter(self._encode(own))
        return pa.array(list(ids) if len(own) == len(words) else [special[w].to_bytes(4, "little") if w in special else next(ids) for w in words], pa.binary())

    def word_ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words. The words of this call are kept, then earlier ones as far as there is room."""
        at = pc.index_in(words, value_set=self._words)
        new, held = words.filter(at.is_null()), len(self._words)
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        unused = np.ones(held, bool)
        unused[place[place >= 0]] = False
        place[place < 0] = held + np.arange(len(new))
        ids = pa.concat_arrays([self._ids, self._fresh(new.to_pylist())]).take(pa.array(place))
        rest = pa.array(np.flatnonzero(unused)[: max(0, self._keep - len(words))])
        self._words, self._ids = pa.concat_arrays([words, self._words.take(rest)]), pa.concat_arrays([ids, self._ids.take(rest)])
        return ids

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The texts' ids as a binary array; ``texts`` is unsliced and has no nulls."""
        flat, starts = words_of(texts)
        codes, pieces = coded(flat)
        del flat
        words, ends = self.splitter.words(pieces)
        of_word, distinct = coded(words)
        by_piece = grouped(self.word_ids(distinct).take(pa.array(of_word)), ends)
        return grouped(by_piece.take(pa.array(codes)), starts)
