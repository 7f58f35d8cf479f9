"""Byte-level BPE as a tree reduction.

A text is cut by the tokenizer's pattern; every piece is a tree of halves. Halves
are encoded on their own and joined: the last tokens of the left and the first of
the right are encoded anew as one window, and the window grows until its outer
tokens come out as they were. A sequence is the encoding of its bytes exactly if
each two neighbours are the encoding of theirs, so tokens outside such a window
cannot change. Decoding concatenates up the same kind of tree.

Null texts are empty ones: no tokens; null ids and repeated rows are kept, each row is
encoded on its own, an empty table gives no rows, further columns are ignored. A text of
any length is encoded whole, in time proportional to it. The ranks travel to the executors once per
job; each Python worker remembers the pieces it met, up to a fixed number: the answers of the last so many
pieces and of as many before them, in tokens that the vocabulary holds anyway.
"""

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import texts
from tickwatch.session import ship_package

# Longest piece that is merged plainly; of these texts' bytes 30 % are in longer ones and go through the tree.
LEAF = 8
# Pieces remembered twice over (the newest so many, and so many before them), and half as many short ones.
REMEMBERED = 200_000
# The rank of what is no token.
_NONE = 1 << 60
_BATCH_BYTES = 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, remembered: int = REMEMBERED):
        self.ranks, self.leaf, self.remembered = ranks, max(leaf, 1), remembered
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.own = {token: token for token in ranks}
        # A full cache becomes the old one and that goes; what is met again moves to the new one.
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_before: dict[str, tuple[int, ...]] = {}
        self.short: dict[bytes, list[bytes]] = {}
        self.short_before: dict[bytes, list[bytes]] = {}

    def _merge(self, piece: bytes) -> list[bytes]:
        """The plain algorithm, for short pieces: merge the pair of lowest rank until none is left.

        Halves and windows come up again and again, so short ones are remembered.
        """
        parts = self.short.get(piece)
        if parts is None:
            parts = self.short_before.get(piece)
            if parts is None:
                parts = self._merged(piece)
                if len(piece) > self.leaf:
                    return parts
                parts = [self.own[part] for part in parts]
            if len(self.short) >= max(1, self.remembered // 2):
                self.short, self.short_before = {}, self.short
            self.short[piece] = parts
        return parts

    def _merged(self, piece: bytes) -> list[bytes]:
        rank = self.ranks.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        costs = [rank(piece[i:i + 2], _NONE) for i in range(len(piece) - 1)]
        while costs:
            best = min(costs)
            if best == _NONE:
                break
            at = costs.index(best)
            parts[at] += parts.pop(at + 1)
            del costs[at]
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], _NONE)
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], _NONE)
        return parts

    def _encode(self, piece: bytes) -> list[bytes]:
        if len(piece) <= self.leaf:
            return self._merge(piece)
        half = len(piece) // 2
        return self._join(self._encode(piece[:half]), self._encode(piece[half:]))

    def _join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._merge(b"".join(left[len(left) - i:] + right[:j]))
            # An end of the whole piece is stable in any case.
            left_holds = i == len(left) or window[0] == left[-i]
            right_holds = j == len(right) or window[-1] == right[j - 1]
            if left_holds and right_holds:
                return left[:len(left) - i] + window + right[j:]
            i, j = i if left_holds else 2 * i, j if right_holds else 2 * j

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.known_before.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                whole = self.ranks.get(raw)
                ids = (whole,) if whole is not None else tuple([self.ranks[t] for t in self._encode(raw)])
            if len(piece) <= 64:
                if len(self.known) >= self.remembered:
                    self.known, self.known_before = {}, self.known
                self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, piece_ids = self.known.get, self.piece_ids
        for piece in self.pattern.findall(text):
            out += known(piece) or piece_ids(piece)
        return out

    def decode(self, ids) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_encoders: dict[tuple, TreeBpe] = {}


def _encoder(key: tuple, ranks: dict[bytes, int]) -> TreeBpe:
    """One encoder per worker process and vocabulary, so that later tasks know the pieces of earlier ones."""
    if key not in _encoders:
        _encoders[key] = TreeBpe(ranks, key[0])
    return _encoders[key]


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary, from the ids) for every row of docs."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary: tens of thousands of entries
    key = (pattern, len(ranks), hash(frozenset(list(ranks.items())[:64])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(key, shared.value)
        for batch in batches:
            start = 0
            sizes = batch.column("text").cast(pa.large_binary())
            lengths = np.diff(np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset:sizes.offset + len(sizes) + 1])
            total = np.concatenate([[0], np.cumsum(lengths)])
            while start < len(batch):
                # Whole texts, a few MB of them at a time.
                end = max(start + 1, int(np.searchsorted(total, total[start] + _BATCH_BYTES, "right")) - 1)
                part = batch.slice(start, end - start)
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.array([bpe.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])
                start = end

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
