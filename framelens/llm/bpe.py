"""Byte-level BPE as a tree reduction: halves are encoded alone and joined by re-encoding windows at their border."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents_of, ship_package

#: Characters of a leaf of the text tree, bytes of a leaf of a word's tree, ids of a leaf of the decoding tree.
TEXT_LEAF = 2048
WORD_LEAF = 32
DECODE_LEAF = 1 << 18
#: Words that a Python worker remembers: up to twice as many.
REMEMBERED = 250_000
#: Bytes of text and of answers that a task holds at a time (a longer text alone).
HELD = 2 << 20
#: How far the fixed pattern of the vocabularies looks: a match depends on so many characters beyond its end, and on so
#: many from its start (the longest of its fixed endings, such as 'll).
REACH = (1, 3)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pieces(dict):
    """A match of the pattern to its packed 32-bit ids. Words that come again move from the old half to this one."""

    def __init__(self, codec: "Codec"):
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.codec.word(piece.encode()), "<i4").tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, reach: tuple[int, int] = REACH):
        self.ranks, self.find, (self.beyond, self.least) = ranks, regex.compile(pattern).findall, reach
        self.packed = Pieces(self)
        self.token = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.token[rank] = word
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.size = np.array([len(x) for x in self.token])
        self.start = np.cumsum(self.size) - self.size
        self.fits: dict[tuple[int, int], bool] = {}

    # A word: bytes of one match of the pattern.

    def merge(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until no pair is a token."""
        n = len(word)
        parts = [word[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or self.ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := self.ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [self.ranks[p] for p in parts if p is not None]

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are side by side. A run of tokens whose neighbours all do so is the encoding
        of its bytes, which is what lets a window stop growing."""
        if (a, b) not in self.fits:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            self.fits[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return self.fits[a, b]

    def join_words(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation: re-encode a window at the border, grown until both its edges are stable."""
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(self.token[t] for t in left[len(left) - i:] + right[:j]))
            fine_left = i == len(left) or self.stable(left[len(left) - i - 1], window[0])
            fine_right = j == len(right) or self.stable(window[-1], right[j])
            if fine_left and fine_right:
                return left[:len(left) - i] + window + right[j:]
            i, j = i * (1 if fine_left else 2), j * (1 if fine_right else 2)

    def tree(self, word: bytes) -> list[int]:
        if len(word) <= WORD_LEAF:
            return self.merge(word)
        half = len(word) // 2
        return self.join_words(self.tree(word[:half]), self.tree(word[half:]))

    def word(self, word: bytes) -> list[int]:
        rank = self.ranks.get(word)
        return [rank] if rank is not None else self.tree(word)

    # A text: matches of the pattern.

    def join_texts(self, left: list[str], right: list[str]) -> list[str]:
        """Matches over the concatenation. A match depends on what follows its start: at most on ``beyond`` characters past
        its end and on ``least`` from its start. So the last matches of ``left`` that this reaches are matched again, on
        into ``right``, until a match starts where one of ``right`` starts: from there on nothing changes."""
        if not left or not right:
            return left or right
        tail, beyond = [], 0
        while left and (beyond < self.beyond or beyond + len(left[-1]) < self.least):
            beyond += len(left[-1])
            tail.append(left.pop())
        window, taken, grow = "".join(reversed(tail)), 0, 4
        starts = {len(window): 0}
        while True:
            more = right[taken:taken + grow]
            at = len(window)
            window += "".join(more)
            for k, piece in enumerate(more):
                starts[at] = taken + k
                at += len(piece)
            taken, grow = taken + len(more), grow * 2
            found = self.find(window)
            if taken == len(right):
                left += found
                return left
            at = 0
            for k, piece in enumerate(found):
                if at in starts and (not k or at + self.beyond <= len(window) and at - len(found[k - 1]) + self.least <= len(window)):
                    left += found[:k]
                    left += right[starts[at]:]
                    return left
                at += len(piece)

    def pieces(self, text: str) -> list[str]:
        if len(text) <= TEXT_LEAF:
            return self.find(text)
        half = len(text) // 2
        return self.join_texts(self.pieces(text[:half]), self.pieces(text[half:]))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.packed.__getitem__, self.pieces(text))), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, concatenated up the tree."""
        if len(ids) > DECODE_LEAF:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        size = self.size[ids]
        end = np.cumsum(size)
        place = np.repeat(self.start[ids] - end + size, size)
        return self.flat[place + np.arange(len(place))].tobytes()


#: Kept from task to task of a Python worker.
_CODECS: dict[str, Codec] = {}


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, reach: tuple[int, int] = REACH) -> DataFrame:
    """doc_id, ids array<int>, decoded binary, exact boolean for every row of ``docs`` (doc_id, text): the byte-level BPE
    ids of the whole text by the ranks in ``ranks_path``, each match of ``pattern`` separately and no special tokens, the
    bytes that these ids decode to, and whether they are the text's. ``reach``: how far ``pattern`` looks (see REACH);
    another pattern than the vocabularies' own needs its own.

    Null and empty texts have no ids and no bytes. Texts of any length are encoded whole; repeated rows stay; null
    doc_ids are kept; extra columns are left out; an empty table gives an empty one. The ranks (a fixed file of about a
    megabyte) are read once by the driver and broadcast. No shuffle.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    key = hashlib.sha256(repr((sorted(ranks.value.items()), pattern, reach)).encode()).hexdigest()

    def run(batches):
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(ranks.value, pattern, reach)
        codec = _CODECS[key]
        names = ["doc_id", "ids", "decoded", "exact"]

        def packed(doc, held, decoded, exact):
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
            flat = pa.array(np.concatenate(held) if held else np.zeros(0, np.int32), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), flat), pa.array(decoded, pa.binary()), pa.array(exact)], names=names)

        for batch in batches:
            doc, held, decoded, exact, size = [], [], [], [], 0
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ids = codec.encode(text)
                doc.append(i)
                held.append(ids)
                decoded.append(codec.decode(ids))
                exact.append(decoded[-1] == text.encode())
                size += 4 * len(ids) + len(decoded[-1])
                if size > HELD:
                    yield packed(doc, held, decoded, exact)
                    doc, held, decoded, exact, size = [], [], [], [], 0
            if doc:
                yield packed(doc, held, decoded, exact)

    return documents_of(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary, exact boolean")
