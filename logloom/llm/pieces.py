"""Operator 1: SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines, whose states and arcs are made when they are first asked for and then kept
    N   normaliser: subsequential; a state is the input that may still become a longer rule, an arc takes a character and
        puts out what is certain. Rules are the model's, longest match first; the marker is a space.
    L   lexicon: one path of characters a piece, joined as a trie, with the piece's id as its output
    B   byte fallback: for each character that no piece covers an arc whose output is the path of its bytes' pieces
The input is composed with N; then each word of the result, a line of states, with the closure of L and B: states are
positions, arcs are the pieces that L or B accept there. The tropical shortest path is taken over (position, last arc); with
weights 0 and infinity it is searched in depth, longest arcs first.

Weights
    unigram models  an arc weighs minus its score, whatever precedes it
    BPE models      an arc weighs 0 if merging its text behind the last arc's text gives those two pieces, else
                    infinity. A sequence is what the merges give for a text exactly if every neighbouring pair is
                    (the first merge across a boundary would also be made in that pair alone), so one path of finite
                    weight exists and it is the library's encoding.

Words are independent: no piece has the marker behind another character (checked at compile time), so no path crosses
there. Encodings of words are kept in a table of bounded size.

Defined results: a null text is the empty text and has no ids; very long texts and words take time in proportion to
their length; repeated rows give the same ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, slices, small_batches, table, texts

MARK = "▁"
#: Words, and parts of words, of a generation whose encodings are kept in each worker.
KEPT_WORDS, KEPT_PARTS = 200_000, 150_000
KEPT_PAIRS = 300_000
#: Arcs of the normaliser that are kept.
KEPT_ARCS = 200_000
#: Longer words are not kept.
KEPT_CHARS = 200
SCHEMA = "doc_id long, n_tokens int, n_byte_tokens int, ids array<int>, round_trip boolean"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class RuleTrie:
    """The normaliser's compiled rules: a double-array trie over bytes, and the replacements it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, text: str) -> tuple[int, str]:
        """Characters of the longest rule that the text starts with (0 if none), and what replaces them."""
        data = text.encode("utf-8", "replace")
        size, value = self._longest(data, 0)
        return len(data[:size].decode("utf-8", "ignore")), self.texts[value : self.texts.index(0, value)].decode() if size else ""

    def may_grow(self, text: str) -> bool:
        """Whether some rule starts with the text."""
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for byte in text.encode("utf-8", "replace"):
            node ^= byte
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                return False
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        return True

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        unit = self.units[0]
        node, found = (unit >> 10) << ((unit & 0x200) >> 6), (0, 0)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return found


class Normaliser:
    """N. arcs: by state (pending input) and character, the output and the next state."""

    def __init__(self, rules: RuleTrie):
        self.rules, self.arcs = rules, {}

    def arc(self, pending: str, char: str) -> tuple[str, str]:
        known = self.arcs.get((pending, char))
        if known is None:
            known = self._settled(pending + char, last=False)
            if len(self.arcs) < KEPT_ARCS:
                self.arcs[pending, char] = known
        return known

    def _settled(self, text: str, last: bool) -> tuple[str, str]:
        """The output of what no further input changes, and the rest."""
        out = []
        while text and (last or not self.rules.may_grow(text)):
            size, new = self.rules.longest(text)
            out.append(new if size else text[0])
            text = text[size or 1 :]
        return "".join(out), text

    def apply(self, text: str) -> str:
        """The composition of a text with the machine."""
        if not self.rules.units:
            return text
        out, state = [], ""
        for char in text:
            new, state = self.arc(state, char)
            out.append(new)
        return "".join(out) + self._settled(state, last=True)[0]


class Fallback:
    """B. The path of a character: its bytes' pieces, or the unknown piece."""

    def __init__(self, bytes_: dict[int, int], unknown: int):
        self.bytes, self.unknown = bytes_, unknown

    def path(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.unknown]


class Transducer:
    """encode() and decode() for a SentencePiece model file of the BPE or unigram kind."""

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                parts = dict(_fields(value))
                pieces.append((parts[1].decode(), struct.unpack("<f", parts.get(2, bytes(4)))[0], parts.get(3, 1)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, 1)
        if self.kind not in (1, 2):
            raise ValueError("the model is neither unigram nor BPE")
        if any(kind == 4 for _, _, kind in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.normaliser = Normaliser(RuleTrie(normaliser.get(2, b"")))
        self.prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == 1}
        self.score = {text: score for text, score, kind in pieces if kind == 1}
        self.inside = {text[k : k + 2] for text in self.ids for k in range(len(text) - 1)}
        self.longest = max(map(len, self.ids))
        self.breaks = any("\n" in text for text in self.ids)
        # L: by character the next state and the number of the arc that ends there, or -1
        self.lexicon: dict[str, tuple[dict, int]] = {}
        for text, i in self.ids.items():
            node = self.lexicon
            for char in text[:-1]:
                node = node.setdefault(char, ({}, -1))[0]
            node[text[-1]] = node.get(text[-1], ({}, -1))[0], i
        self.arcs, self.arc_ids, self.strange = [text for text, _, _ in pieces], [[i] for i in range(len(pieces))], {}
        if any(MARK in text.lstrip(MARK) for text in self.ids):
            raise ValueError("a piece has white space behind another character")
        self.unknown = next(i for i, x in enumerate(pieces) if x[2] == 2)
        self.byte = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == 6}
        self.fallback = Fallback(self.byte, self.unknown)
        self.is_byte = np.array([kind == 6 for _, _, kind in pieces])
        self.unknown_score = min(self.score.values()) - 10
        self.out = [b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else bytes([int(text[3:5], 16)]) if kind == 6 else text.replace(MARK, " ").encode() for text, _, kind in pieces]
        self.fits: dict[int, bool] = {}
        self.histories: dict[str, tuple[list[float], list[str], list[str]] | None] = {}
        self.words, self.parts = _Words(self), _Parts(self)

    def normal(self, text: str) -> str:
        """The normalised text, with spaces still as spaces and without the prefix."""
        text = self.normaliser.apply(text).replace(MARK, " ")
        return re.sub(" +", " ", text).strip(" ") if self.squeeze else text

    def history(self, text: str) -> tuple[list[float], list[str], list[str]] | None:
        """The merges of a piece's own characters, in order: their scores (last: minus infinity), and the leftmost and
        rightmost part before each. None if they don't end in the piece."""
        found = self.histories.get(text, 0)
        if found != 0:
            return found
        parts, scores, left, right = list(text), [], [text[0]], [text[-1]]
        while len(parts) > 1:
            joint = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(joint)
            if best == -np.inf:
                break
            k = joint.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            scores.append(best)
            left.append(parts[0])
            right.append(parts[-1])
        self.histories[text] = found = (scores + [-np.inf], left, right) if len(parts) == 1 else None
        return found

    def follows(self, last: str, arc: str) -> bool:
        """Whether merging both texts together gives the two pieces. The best merge comes first, leftmost among equals;
        so each piece's own merges come in their own order, until one across the boundary is better than both."""
        one, two = self.history(last), self.history(arc)
        if one is None or two is None:
            return False
        get, (s1, _, ends), (s2, heads, _) = self.score.get, one, two
        i = j = 0
        while True:
            across = get(ends[i] + heads[j], -np.inf)
            if across > s1[i] and across >= s2[j]:
                return False
            if s1[i] >= s2[j]:
                if s1[i] == -np.inf:
                    return True
                i += 1
            else:
                j += 1

    def arc(self, text: str) -> int:
        """The number of the arc with this text: a piece's id, or one behind them all for a character without pieces."""
        known = self.ids.get(text)
        if known is None and (known := self.strange.get(text)) is None:
            known = self.strange[text] = len(self.arcs)
            self.arcs.append(text)
            self.arc_ids.append(self.fallback.path(text))
            self.lexicon[text] = self.lexicon.get(text, ({}, -1))[0], known
        return known

    def path(self, word: str) -> list[int]:
        """The arcs of the shortest path through the word's lattice."""
        lexicon = self.lexicon
        for char in set(word):
            if char not in lexicon or lexicon[char][1] < 0:
                self.arc(char)
        return self._free_path(word) if self.kind == 2 else self._least_path(word)

    def _ahead(self, word: str, s: int) -> list[tuple[int, int]]:
        """The arcs from a position, shortest first, with their ends."""
        node, out, e = self.lexicon, [], s
        for char in word[s : s + self.longest]:
            hit = node.get(char)
            if hit is None:
                break
            e += 1
            node, arc = hit
            if arc >= 0:
                out.append((arc, e))
        return out

    def _free_path(self, word: str) -> list[int]:
        """Of weights 0 and infinity: the path without an infinite one, searched in depth, longest arcs first. A position and
        last arc from which it does not go on are not tried again."""
        n, fits, arcs, ahead = len(word), self.fits, self.arcs, self._ahead
        if len(fits) >= KEPT_PAIRS:
            fits.clear()
        path, before, left, tried = [], -1, [ahead(word, 0)], set()
        while left:
            todo = left[-1]
            if not todo:
                left.pop()
                if path:
                    path.pop()
                    before = path[-1] if path else -1
                continue
            arc, e = todo.pop()
            if (arc, e) in tried:
                continue
            pair = before << 32 | arc
            fit = fits.get(pair)
            if fit is None:
                fit = fits[pair] = self.follows(arcs[before], arcs[arc]) if path else self.history(arcs[arc]) is not None
            if not fit:
                continue
            path.append(arc)
            if e == n:
                return path
            tried.add((arc, e))
            before = arc
            left.append(ahead(word, e))
        raise ValueError(f"no path through {word!r}")

    def _least_path(self, word: str) -> list[int]:
        """Of any weights: by the least weight to each position."""
        n = len(word)
        last, came, cost = [-1] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        for s in range(n):
            if last[s] < 0 and s:
                continue
            for arc, e in self._ahead(word, s):
                weight = cost[s] - self.score.get(self.arcs[arc], self.unknown_score)
                if last[e] < 0 or weight < cost[e]:
                    last[e], came[e], cost[e] = arc, s, weight
        out, e = [], n
        while e:
            out.append(last[e])
            e = came[e]
        return out[::-1]

    def word_ids(self, word: str) -> bytes:
        """Ids of a word with its marker. It is cut where no piece spans two neighbours; its parts are kept as well."""
        parts, start = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.inside:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        return b"".join(map(self.parts.__getitem__, parts))

    def part_ids(self, part: str) -> bytes:
        out: list[int] = []
        for arc in self.path(part):
            out += self.arc_ids[arc]
        return struct.pack(f"<{len(out)}i", *out)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers, as the library's encode gives them."""
        return self.encode_normal(self.normal(text))

    def encode_normal(self, text: str) -> bytes:
        """encode_bytes of a text that is normalised already."""
        if not text:
            return b""
        if self.byte:
            return self._joined(text)
        # unknown characters in a row are one unknown piece
        ids = np.frombuffer(self._joined(text), "<i4")
        again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[np.concatenate([[True], ~again])].tobytes()

    def _joined(self, text: str) -> bytes:
        words = self.words
        if not self.prefix or text[0] == " " or "  " in text:
            return b"".join([words[" " + w] for w in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", (MARK if self.prefix else "") + text.replace(" ", MARK))])
        if "\n" in text and not self.breaks:  # no piece has a line break: nothing crosses it
            text = text.replace("\n", " \n")
        return b"".join(map(words.__getitem__, text.split(" ")))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the prefix is taken off, and bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Words(Kept):
    """Ids by word. A key has the marker before it unless it starts with a line break or, as a whole normalised piece
    of text, with a space."""

    def __init__(self, transducer: Transducer):
        super().__init__(KEPT_WORDS)
        self.of = transducer

    def __missing__(self, word: str) -> bytes:
        ids = self.again(word)
        if ids is not None:
            return ids
        of = self.of
        if word[:1] == " ":
            ids = of.word_ids(word[1:])
        elif word[:1] == "\n" and not of.breaks:
            ids = of.word_ids(word)
        else:
            ids = of.word_ids(MARK + word)
        if len(word) <= KEPT_CHARS:
            self.add(word, ids)
        return ids


class _Parts(Kept):
    """Ids by part of a word."""

    def __init__(self, transducer: Transducer):
        super().__init__(KEPT_PARTS)
        self.of = transducer

    def __missing__(self, part: str) -> bytes:
        ids = self.again(part)
        if ids is None:
            ids = self.of.part_ids(part)
            if len(part) <= KEPT_CHARS:
                self.add(part, ids)
        return ids


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        with open(path, "rb") as f:
            _compiled[path] = Transducer(f.read())
    return _compiled[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens (ids from byte fallback), ids, and round_trip: whether the decoder gives back
    the normalised text. `path` is the model file, at the same place on every machine."""
    small_batches(docs.sparkSession)
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in slices(batches):
            parts, back = [], []
            for text in batch.column("text").to_pylist():
                text = machine.normal(text)
                parts.append(ids := machine.encode_normal(text))
                back.append(machine.decode(np.frombuffer(ids, "<i4").tolist()) == text)
            ends = np.cumsum([0, *(len(x) // 4 for x in parts)])
            ids = np.frombuffer(b"".join(parts), "<i4")
            of_bytes = np.concatenate([[0], np.cumsum(machine.is_byte[ids])])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(ends), pa.int32()),
                    pa.array(of_bytes[ends[1:]] - of_bytes[ends[:-1]], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(back, pa.bool_()),
                ],
                ["doc_id", "n_tokens", "n_byte_tokens", "ids", "round_trip"],
            )

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of its ids; null ids are no ids."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            out = [machine.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
