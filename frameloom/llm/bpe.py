"""Byte-pair encoding of whole texts by a trie of distinct words, and decoding from ids.

The last token of a word's prefix depends on that prefix alone, and the tokens before it are the
encoding of what precedes it. So distinct words are put in order, which walks their trie depth
first, and each trie node gets one state: its last token. A node's token is the one suffix that is a
token and whose boundary with the state at its begin survives all merges; whether a boundary does is
read off the merge trees of the two tokens. Words with a common prefix share the states of its nodes.

The vocabulary file is the tokenizers library's JSON with byte-level BPE, an end-of-word suffix, the
normaliser NFC, white space to a space, lower case, and a pattern that drops white space. A file
of another kind is refused. Texts are split as in ``pieces``.

Defined results: a null text is the empty text, which has no tokens and decodes to the empty string;
rows are encoded one by one, so repeated rows, ties and other columns, of whatever names, don't matter;
a very long text is encoded whole, in one task; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, text_slices, value_slices
from .pieces import SUFFIX, Splitter, TextEncoder

#: Pairs of tokens whose boundary a worker remembers, and the automaton's moves.
_KEPT_PAIRS, _KEPT_MOVES = 200_000, 300_000
#: Bytes of text that are encoded together: the more, the more often a word is shared.
_SLICE = 1 << 22
#: The automaton's letter for a word's end, above all byte letters; the mark of a word's last letter.
_END, _FINAL = 511, 512


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it is
    printable Latin-1, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_LETTER_OF = dict(enumerate(byte_letters()))


def letters(word: str) -> str:
    """A word's bytes as letters."""
    return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_LETTER_OF)


class TrieEncoder:
    """One worker's encoder. ``encode_words`` encodes distinct words together."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        splitter = Splitter(content)
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.token = {i: s for s, i in vocab.items()} | {i: s for s, i in splitter.special.items()}
        # tokens are numbered by the order of their making, base letters before all merges
        made = {a + b: k for k, (a, b) in enumerate(merges)}
        base = [s for s in vocab if s not in made]
        number = {s: k for k, s in enumerate(base)} | {s: len(base) + k for s, k in made.items()}
        if len(made) != len(merges):
            raise ValueError("a token has two merges")
        self.n_base = len(base)
        self.packed = [vocab[s].to_bytes(4, "little") for s in sorted(number, key=number.get)]
        self.halves = [(-1, -1)] * self.n_base + [(number[a], number[b]) for a, b in merges]
        self.joined = {number[a] << 32 | number[b]: self.n_base + k for k, (a, b) in enumerate(merges)}
        self.text = sorted(number, key=number.get)
        self.pairs: list[dict[int, bool]] = [{} for _ in self.text]
        self.n_pairs = 0
        reachable = [True] * self.n_base
        for k in range(self.n_base, len(self.halves)):
            a, b = self.halves[k]
            if a >= k or b >= k:
                raise ValueError("a merge comes before its parts")
            reachable.append(reachable[a] and reachable[b] and self._survives(a, b, k))
        self._automaton([n for n in range(len(self.text)) if reachable[n]])
        self.encode_texts = TextEncoder(splitter, self.encode_list)
        known = np.full(max(self.token) + 1, -1, np.int64)
        known[list(self.token)] = np.arange(len(self.token))
        self._place, self._strings = known, pa.array(list(self.token.values()), pa.string())

    def _automaton(self, tokens: list[int]) -> None:
        """States for all prefixes of tokens, the suffix as one letter of its own. ``out`` is a state's
        longest suffix that is a token, ``shorter`` the next one after a token: so a node tries only
        suffixes that are tokens."""
        self.size = [len(s) - len(SUFFIX) if s.endswith(SUFFIX) else len(s) for s in self.text]
        self.step, fail, self.out, at = {}, [0], [-1], {}
        step, out = self.step, self.out
        for n in tokens:
            s, state = self.text[n], 0
            own = [ord(c) for c in s[: self.size[n]]] + [_END] * (len(s) > self.size[n])
            for c in own:
                key = state << 9 | c
                if key not in step:
                    step[key] = len(fail)
                    fail.append(0)
                    out.append(-1)
                state = step[key]
            out[state], at[n] = n, state
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in step.items():
            below.setdefault(key >> 9, []).append((key & 511, to))
        wave = [to for _, to in below.get(0, [])]
        for state in wave:  # breadth first: the list grows as it is read
            for c, to in below.get(state, []):
                back = fail[state]
                while back and back << 9 | c not in step:
                    back = fail[back]
                fail[to] = step.get(back << 9 | c, 0)
                if out[to] < 0:
                    out[to] = out[fail[to]]
                wave.append(to)
        self.fail = fail
        self.shorter = [out[fail[at[n]]] if n in at else -1 for n in range(len(self.text))]

    def _step(self, state: int, c: int) -> int:
        """The automaton's move; it is remembered, so that each is searched for once."""
        to, back = None, state
        while (to := self.step.get(back << 9 | c)) is None and back:
            back = self.fail[back]
        if len(self.step) < _KEPT_MOVES:
            self.step[state << 9 | c] = to or 0
        return to or 0

    def _survives(self, a: int, b: int, whole: int = -1) -> bool:
        """Whether the boundary of a and b outlives all merges on its two sides; ``whole`` may join them in the end.

        Merges happen in the order of their numbers, of equal ones the left one first. So the pieces at
        the boundary grow along a's right and b's left spine, and a merge across it comes first if its
        number is less than that of the next piece on the left, and not above that on the right.
        """
        halves, joined = self.halves, self.joined
        right, left = [a], [b]
        while halves[right[-1]][1] >= 0:
            right.append(halves[right[-1]][1])
        while halves[left[-1]][0] >= 0:
            left.append(halves[left[-1]][0])
        none = len(halves) + 1
        i, j = len(right) - 1, len(left) - 1
        while True:
            next_a, next_b = right[i - 1] if i else none, left[j - 1] if j else none
            across = joined.get(right[i] << 32 | left[j], none)
            if across < next_a and across <= next_b:
                return not i and not j and across == whole
            if not i and not j:
                return True
            if next_a <= next_b:
                i -= 1
            else:
                j -= 1

    def _apart(self, a: int, b: int) -> bool:
        """``_survives``, remembered; ``pairs`` holds what is known of each b."""
        if self.n_pairs >= _KEPT_PAIRS:
            self.n_pairs = 0
            for known in self.pairs:
                known.clear()
        self.n_pairs += 1
        known = self.pairs[b][a] = self._survives(a, b)
        return known

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Token numbers of each distinct word, given as letters, in the order of the words."""
        last, where, before = [-1], [0], ""  # at each depth of the path: the last token, the automaton's state
        step, out, shorter, size = self.step, self.out, self.shorter, self.size
        pairs = self.pairs
        for word in sorted(words):
            n, depth = len(word), 0
            most = min(n - 1, len(last) - 1)
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del last[depth + 1 :], where[depth + 1 :]
            path = list(map(ord, word[depth:]))
            path.append(_END)
            path[-2:] = [path[-2] | _FINAL]
            state = where[depth]
            for end, c in enumerate(path, depth + 1):
                if c >= _FINAL:  # a word's last letter and its end are one symbol
                    c -= _FINAL
                    middle = step.get(state << 9 | c)
                    state = self._step(state, c) if middle is None else middle
                    c = _END
                to = step.get(state << 9 | c)
                state = self._step(state, c) if to is None else to
                t = out[state]
                while begin := end - size[t]:
                    a = last[begin]
                    apart = pairs[t].get(a)
                    if apart or (apart is None and self._apart(a, t)):
                        break
                    t = shorter[t]
                last.append(t)
                where.append(state)
            tokens, end = [], n
            while end:
                t = last[end]
                tokens.append(t)
                end -= size[t]
            tokens.reverse()
            last.pop(), where.pop()  # the end isn't a prefix of other words
            before = word
            yield word, tokens

    def encode_list(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as bytes."""
        packed, found = self.packed, {}
        gc.disable()  # nothing here is cyclic, and each pass of the collector reads all that is kept
        try:
            for word, tokens in self.encode_words(spelt := list(map(letters, words))):
                found[word] = b"".join([packed[t] for t in tokens])
        finally:
            gc.enable()
        return [found[w] for w in spelt]

    def decode_texts(self, ids: pa.Array) -> pa.Array:
        """The texts of binary arrays of ids: their tokens with a space between, as the library joins them where a
        vocabulary names no decoder, special tokens included. Null is no ids; unknown ids are left out."""
        own = pc.fill_null(ids, b"")
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(own).to_numpy().astype(np.int64))]) // 4
        flat = np.frombuffer(b"".join(own.to_pylist()), "<u4").astype(np.int64)
        place = np.where(flat < len(self._place), self._place[np.minimum(flat, len(self._place) - 1)], -1)
        if (known := place >= 0).all():
            kept = ends
        else:
            kept = np.concatenate([[0], np.cumsum(known)])[ends]
            place = place[known]
        lists = pa.LargeListArray.from_arrays(pa.array(kept), self._strings.take(pa.array(place)))
        return pc.binary_join(lists, " ")


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(content: str) -> TrieEncoder:
    """The worker's encoder for a vocabulary, made once per process."""
    name = hashlib.sha1(content.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = TrieEncoder(content)
        gc.freeze()
    return _ENCODERS[name]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's content, broadcast: a file of a few MB, refused above 64 MB."""
    if os.path.getsize(path) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: list[str], decoded: bool = False) -> DataFrame:
    """Columns ``keep`` with ids (binary, little-endian 32-bit) and, if asked for, decoded: the text that those ids give.
    Both replace kept columns of their names."""
    keep = [c for c in keep if c not in ("ids", "decoded")]
    content = vocabulary(docs.sparkSession, path)
    given = numbered(docs, keep, text)
    schema = docs.select(*keep).schema.add("ids", "binary")
    if decoded:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(content.value)
        for part, texts in text_slices(batches, f"c{len(keep)}", _SLICE):
            ids = own.encode_texts(texts)
            columns = [*[part.column(k) for k in range(len(keep))], ids, *([own.decode_texts(ids)] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", keep: list[str]) -> DataFrame:
    """Columns ``keep`` with decoded: the text of the binary column ``ids``."""
    keep = [c for c in keep if c != "decoded"]
    content = vocabulary(encoded.sparkSession, path)
    schema = encoded.select(*keep).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(content.value)
        for part, _ in value_slices(batches, f"c{len(keep)}", _SLICE):
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], own.decode_texts(part.column(len(keep)))], names=schema.names)

    return numbered(encoded, keep, ids).mapInArrow(run, schema)

