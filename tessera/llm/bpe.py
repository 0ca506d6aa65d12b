"""BPE encoding and decoding with a minimal acyclic transducer for frequent words.

Words are counted over the whole corpus; the most frequent ones, `LEXICON` at most, are encoded once and compiled into a minimal
acyclic automaton, whose equal suffixes share states and whose arcs carry parts of an index, so that the sum along a
word's path is its place in the table of id lists (minimal perfect hashing). The automaton and that table are one
file of flat arrays in the shared folder, which workers map into memory and search where it lies: all distinct words of a block
of texts walk through it together, one letter a step. Words that it doesn't hold are merged exactly, pair by pair in the
order of the vocabulary's merges.

Texts are cut at spaces, tabs and line breaks, where words always end; what the vocabulary's own rules make of a cut piece
(normal form, lower case, its pattern) is done once for each distinct piece of a block that the worker doesn't still know from
earlier ones. Texts of ASCII alone are lowered before they are cut. Special tokens are
found in the raw text, as the library finds them. Pieces with control characters or letters beyond the Latin ones go to the
library itself, where two Unicode tables might differ.

Defined results: null and empty texts have no ids and decode to the empty text. Everything is row by row, so repeated rows
and any ids are fine. Decoding joins the tokens of the ids by a space, as the library does for files without a decoder.
Long texts are coded in parts that end at white space, long words by a queue of pairs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, opened, text_blocks, with_text, work_path, written

#: Words of the lexicon at most; its file has a few bytes for each letter that isn't shared.
LEXICON = 150_000
#: Words without a place in the lexicon whose merged ids a worker keeps (about 150 bytes each); a full store is emptied.
MERGED = 100_000
#: Pieces whose ids a worker keeps from block to block (about 150 bytes each), and signs of such a piece; of a full store those of the block stay.
PIECES = 300_000
SHORT = 64
#: Bytes of text that are coded together, and signs of a part of a longer one.
BLOCK = 4 << 20
#: Letters from which a word's pairs are kept in a queue.
LONG = 200
#: Words of one step of counting, after which counts go out.
COUNTED = 400_000

_PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-ɏ]*")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Automaton:
    """A minimal acyclic automaton over bytes, from sorted distinct words, in four flat arrays.

    An arc's code is its state << 8 | its letter; arcs lie in the order of their codes, each with a target and the number of
    words that come before those through the arc. A word's index is the sum of its arcs' numbers, plus one for every state
    on its way, but the last, at which a shorter word ends.
    """

    def __init__(self, code, target, before, final):
        self.code, self.target, self.before, self.final = code, target, before, final

    @classmethod
    def of(cls, words: Iterable[bytes]) -> Automaton:
        """Built word by word: states behind the common prefix are closed, and replaced by an equal one if there is one."""
        known: dict[tuple, int] = {}
        closed: list[tuple[bool, tuple]] = []

        def close(state: list) -> int:
            shape = (state[0], tuple(state[1]))
            if shape not in known:
                known[shape] = len(closed)
                closed.append(shape)
            return known[shape]

        path: list[list] = [[False, []]]
        last = b""
        for word in words:
            same = len(os.path.commonprefix([last, word]))
            while len(path) > same + 1:
                done = close(path.pop())
                path[-1][1][-1] = (path[-1][1][-1][0], done)
            for b in word[same:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = close(path.pop())
            path[-1][1][-1] = (path[-1][1][-1][0], done)
        root = close(path[0])
        below = [0] * len(closed)
        for s, (final, arcs) in enumerate(closed):  # targets are closed before their sources
            below[s] = final + sum(below[t] for _, t in arcs)
        order = [root, *(s for s in range(len(closed)) if s != root)]
        number = {s: n for n, s in enumerate(order)}
        code, target, before = [], [], []
        for s in order:
            seen = 0
            for b, t in closed[s][1]:
                code.append(number[s] << 8 | b)
                target.append(number[t])
                before.append(seen)
                seen += below[t]
        return cls(np.array(code, np.int64), np.array(target, np.int32), np.array(before, np.int32), np.array([closed[s][0] for s in order], np.uint8))

    def indices(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in sorted order, or -1; all words take a step at a time, by binary search among the arcs."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1)
        if not len(self.code):
            out[(length == 0) & bool(self.final[0])] = 0
            return out
        data = np.frombuffer(b"".join(words), np.uint8)
        left, place = np.arange(len(words)), np.concatenate(([0], np.cumsum(length)[:-1])) if len(words) else length
        state, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(left):
            ends = length[left] == depth
            if ends.any():
                done = ends & (self.final[state] == 1)
                out[left[done]] = at[done]
                left, state, at = left[~ends], state[~ends], at[~ends]
            want = state << 8 | data[place[left] + depth]
            arc = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
            on = self.code[arc] == want
            left, arc, state, at = left[on], arc[on], state[on], at[on]
            at = at + self.before[arc] + self.final[state]
            state = self.target[arc].astype(np.int64)
            depth += 1
        return out

    def index(self, word: bytes) -> int:
        return int(self.indices([word])[0])


class Lexicon:
    """An automaton and the ids of its words, as one file."""

    def __init__(self, automaton: Automaton, start: np.ndarray, ids: np.ndarray):
        self.automaton, self.start, self.ids = automaton, start, ids

    @classmethod
    def of(cls, encoded: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(encoded)
        start = np.concatenate(([0], np.cumsum([len(encoded[w]) for w in words]))).astype(np.int32)
        return cls(Automaton.of(words), start, np.array([i for w in words for i in encoded[w]], "<u4"))

    def to_bytes(self) -> bytes:
        a = self.automaton
        parts = [x.tobytes() for x in (a.code, a.target, a.before, self.start, self.ids, a.final)]
        return struct.pack("<6q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The file's arrays as views: of mapped memory, or of its bytes where the shared folder isn't one that can be mapped."""
        if "://" in path and not path.startswith("file:"):
            view = memoryview(opened(path).readall())
        else:
            with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
                view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        at, arrays = 48, []
        for size, kind in zip(struct.unpack("<6q", view[:48]), ("<i8", "<i4", "<i4", "<i4", "<u4", "u1"), strict=True):
            arrays.append(np.frombuffer(view[at : at + size], kind))
            at += size
        code, target, before, start, ids, final = arrays
        return cls(Automaton(code, target, before, final), start, ids)

    def get(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word, None where the lexicon doesn't hold it."""
        at = self.automaton.indices(words)
        here = np.maximum(at, 0)
        raw = memoryview(self.ids).cast("B") if len(self.ids) else memoryview(b"")
        low, high = (self.start[here] * 4).tolist(), (self.start[np.minimum(here + 1, len(self.start) - 1)] * 4).tolist()
        return [bytes(raw[a:b]) if n >= 0 else None for n, a, b in zip(at.tolist(), low, high, strict=True)]


class Vocabulary:
    """A tokenizers file with word-end BPE: its ids, merges, special tokens and pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.end = path, model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pair_ranks = {self.ids[a] << 20 | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged_ids = [self.ids[a + b] for a, b in pairs]
        self.none = len(pairs)
        letters = byte_letters()
        self.byte_ids = [self.ids[c] for c in letters]
        self.end_ids = [self.ids[c + self.end] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.tokens = {i: t for t, i in (*self.ids.items(), *self.special.items())}

    def words(self, piece: str) -> list[str]:
        """The words that the vocabulary's rules find in a plain piece without white space.

        The normal form leaves plain pieces as they are: they have composed Latin letters only. A stop or comma behind letters
        is a word of its own.
        """
        lower = piece.lower()
        if lower.isalpha():
            return [lower]
        return [lower[:-1], lower[-1]] if lower[-1] in ".," and lower[:-1].isalpha() else self.pattern.findall(lower)

    def merge(self, word: bytes) -> bytes:
        """Exact merging: the pair of the lowest rank, leftmost first, until no pair is left."""
        ids = [self.byte_ids[b] for b in word]
        ids[-1] = self.end_ids[word[-1]]
        get, none = self.pair_ranks.get, self.none
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        if len(ids) > LONG:
            return self._merge_long(ids, ranks)
        while ranks:
            low = min(ranks)
            if low == none:
                break
            at = ranks.index(low)
            new = ids[at] = self.merged_ids[low]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | new, none)
            if at < len(ranks):
                ranks[at] = get(new << 20 | ids[at + 1], none)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge_long(self, ids: list[int], ranks: list[int]) -> bytes:
        """The same for long words: neighbours are linked and pairs wait in a queue by (rank, place); outdated ones are passed over."""
        get, none, n = self.pair_ranks.get, self.none, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks.append(none)
        queue = [(r, i) for i, r in enumerate(ranks) if r != none]
        heapq.heapify(queue)
        while queue:
            low, at = heapq.heappop(queue)
            if ranks[at] != low:
                continue
            gone = after[at]
            new = ids[at] = self.merged_ids[low]
            ids[gone], ranks[gone] = -1, none
            after[at] = nxt = after[gone]
            ranks[at] = none
            if nxt >= 0:
                before[nxt] = at
                ranks[at] = get(new << 20 | ids[nxt], none)
                if ranks[at] != none:
                    heapq.heappush(queue, (ranks[at], at))
            prev = before[at]
            if prev >= 0:
                ranks[prev] = get(ids[prev] << 20 | new, none)
                if ranks[prev] != none:
                    heapq.heappush(queue, (ranks[prev], prev))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


class Coder:
    """Encodes and decodes texts; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.v, self.lexicon = vocabulary, lexicon
        self.merged: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.full = None
        self.special = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.tokens = [vocabulary.tokens.get(i, "") for i in range(max(vocabulary.tokens) + 1)]

    def _library(self, piece: str) -> bytes:
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.v.path)
            self.full.no_truncation()
            self.full.no_padding()
        return np.array(self.full.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _merge(self, word: bytes) -> bytes:
        got = self.merged.get(word)
        if got is None:
            if len(self.merged) >= MERGED:
                self.merged.clear()
            got = self.v.merge(word)
            if len(word) <= 64:
                self.merged[word] = got
        return got

    def _cut(self, text: str) -> list[str]:
        """Pieces of a text; special tokens are pieces of their own. Texts of ASCII alone are lowered first, unless that makes a special token."""
        if self.special and self.special.search(text):
            return [p for n, part in enumerate(self.special.split(text)) for p in ([part] if n % 2 else self._plain_cut(part))]
        lower = text.lower() if text.isascii() else text
        return self._plain_cut(text if self.special and self.special.search(lower) else lower)

    @staticmethod
    def _plain_cut(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _table(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct pieces: their words go through the transducer together."""
        out: dict[str, bytes] = {"": b""}
        single: dict[str, str] = {}
        several: dict[str, list[str]] = {}
        special, plain = self.v.special, _PLAIN.fullmatch
        for p in pieces:
            if not p:
                continue
            if p in special:
                out[p] = struct.pack("<I", special[p])
            elif not plain(p):
                out[p] = self._library(p)
            elif (lower := p.lower()).isalpha():
                single[p] = lower
            else:
                several[p] = self.v.words(p)
        words: dict[str, bytes | None] = dict.fromkeys(single.values())
        words.update(dict.fromkeys(chain.from_iterable(several.values())))
        listed = [w.encode() for w in words]
        if self.lexicon and words:
            words.update(zip(words, self.lexicon.get(listed), strict=True))
        for (w, ids), word in zip(words.items(), listed, strict=True):
            if ids is None:
                words[w] = self._merge(word)
        out.update(zip(single, map(words.__getitem__, single.values()), strict=True))
        out.update((p, b"".join(map(words.__getitem__, found))) for p, found in several.items())
        return out

    def _block(self, texts: Iterable[str]) -> list[bytes]:
        cut = list(map(self._cut, texts))
        known, distinct = self.pieces, set().union(*cut)
        if len(known) > PIECES:  # what this block has stays
            known = self.pieces = {p: known[p] for p in distinct.intersection(known)}
        new = self._table(distinct.difference(known))
        known.update(new)
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        for p in new:
            if len(p) > SHORT:
                del known[p]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: those of a block at once, longer ones in parts."""
        if all(len(t) <= BLOCK for t in texts):
            return self._block(texts)
        return [b"".join(self._block([part])[0] for part in parts(t)) for t in texts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_parts(self, ids: bytes) -> Iterator[str]:
        """The tokens of the ids, joined by spaces, in parts to be joined; ids that the vocabulary hasn't are left out."""
        tokens, top = self.tokens, len(self.tokens)
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= top:
            numbers = numbers[numbers < top]
        begun = False
        for at in range(0, len(numbers), BLOCK // 4):
            out = list(map(tokens.__getitem__, numbers[at : at + BLOCK // 4].tolist()))
            out = out if all(out) else list(filter(None, out))
            if out:
                yield (" " if begun else "") + " ".join(out)
                begun = True

    def decode(self, ids: bytes) -> str:
        return "".join(self.decode_parts(ids))


def parts(text: str) -> Iterator[str]:
    """A long text in parts of about BLOCK signs that end before a space or line break, if there is one."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:
            found = re.compile("[ \n]").search(text, end)
            end = found.start() if found else n
        yield text[at:end]
        at = end


_CODERS: dict[tuple, Coder] = {}


def coder(vocabulary: str, lexicon: str | None) -> Coder:
    """One for each worker process and lexicon file."""
    key = (vocabulary, lexicon)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(Vocabulary(vocabulary), Lexicon.mapped(lexicon) if lexicon else None)
    return _CODERS[key]


def word_counts(docs: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """(word, n): how often the vocabulary's rules find each word in all texts. Counts are summed in each task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(vocabulary)
        pieces: Counter = Counter()

        def flush():
            words: Counter = Counter()
            for piece, n in pieces.items():
                if piece and _PLAIN.fullmatch(piece):
                    for w in v.words(piece):
                        words[w] += n
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words], pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column("text"):
                t = t.as_py()
                pieces.update((t.lower() if t.isascii() else t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
                if len(pieces) >= COUNTED:
                    yield flush()
        yield flush()

    rows = with_text(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text"))).select("text")
    return map_arrow(rows, work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, *, size: int = LEXICON, text: str = "text") -> str:
    """Writes the lexicon of the most frequent words of all texts to the shared folder and gives its path.

    It holds all words that occur often enough for at most `size` of them to do so; how often that is comes from a histogram of
    counts (up to 16 steps for each doubling), so no task sorts words or sends more than its share of the chosen.
    """
    counts = written(word_counts(docs, vocabulary, text=text), "words")
    step = F.floor(F.log2("n") * 16)
    least, held = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        if held + r["words"] > size:
            break
        least, held = r["step"], held + r["words"]
    v = Vocabulary(vocabulary)
    chosen = [] if least is None else [bytes(r[0]) for r in counts.where(step >= least).select("word").toLocalIterator()]
    path = work_path(docs.sparkSession, "lexicon")
    with opened(path, "w") as f:
        f.write(Lexicon.of({w: np.frombuffer(v.merge(w), "<u4").tolist() for w in chosen}).to_bytes())
    return path


def encode(docs: DataFrame, vocabulary: str, lexicon: str | None, *, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and, with digests, ids_sha256 and decoded_sha256, else ids (little-endian uint32) and decoded."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shape = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary, lexicon)
        for batch in batches:
            for first, end, _, _ in text_blocks(batch.column("text"), BLOCK):
                coded = c.encode_all(batch.column("text").slice(first, end - first).to_pylist())
                n, a, b = [], [], []
                for ids in coded:
                    n.append(len(ids) // 4)
                    if digests:
                        digest = hashlib.sha256()
                        for part in c.decode_parts(ids):
                            digest.update(part.encode())
                        a.append(hashlib.sha256(ids).hexdigest())
                        b.append(digest.hexdigest())
                    else:
                        a.append(ids)
                        b.append(c.decode(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(n, pa.int64()), pa.array(a, pa.string() if digests else pa.binary()), pa.array(b, pa.string())], names)

    return map_arrow(with_text(docs, doc_id, text), work, f"doc_id {kind}, n_tokens long, {shape}")


def round_trip(docs: DataFrame, vocabulary: str, *, size: int = LEXICON, digests: bool = False) -> DataFrame:
    """A lexicon from all texts, then ids and decoded text of each row."""
    return encode(docs, vocabulary, build_lexicon(docs, vocabulary, size=size), digests=digests)
