"""Byte-level BPE, encoded by merges from a segment tree, and decoded.

A segment tree over the byte positions of a piece of text holds, at the start of every live token, the
rank of the pair that it makes with the next one. Its root is the leftmost pair of least rank; a
merge changes the entries of the merged token and its live neighbours, each in logarithmic time. So
a piece of any length, such as a run of a million letters, takes n log n steps.

The trees of many short pieces are kept side by side as the rows of a matrix, and all of them take
one merge at a time. Pieces repeat: a worker keeps their ids, in a cache of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.arrow import sliced


@dataclass(frozen=True)
class Bpe:
    """Parameters.

    pattern: cuts a text into pieces, which must cover it; it may look ahead, by `reach` characters
    at most, and not behind. window: characters that are cut at a time. together: pieces encoded
    at a time. cached: pieces whose ids a worker keeps. short: bytes of a piece whose tree is a row of
    a matrix, and which is kept.
    """

    pattern: str
    reach: int = 8
    window: int = 1 << 20
    together: int = 200_000
    cached: int = 1 << 18
    short: int = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ids."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


# Above the rank of every pair.
_NO_RANK = 1 << 32


class Vocabulary:
    """The tokens of a rank file: an id is a rank. Every single byte must be one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.tokens = {rank: raw for raw, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # Every way to make a token of two, by the ids of the two.
        pairs = [
            (ranks[raw[:cut]] << 32 | ranks[raw[cut:]], rank)
            for raw, rank in ranks.items()
            for cut in range(1, len(raw))
            if raw[:cut] in ranks and raw[cut:] in ranks
        ]
        table = np.array(sorted(pairs) or [(-1, -1)], dtype=np.int64)
        self.pair_keys, self.pair_ranks = table[:, 0].copy(), table[:, 1].copy()

    def pair(self, left: np.ndarray, right: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
        """Tree entries of the pairs: rank and place in one number, so that the least is the leftmost."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at] * width + places, _NO_RANK * width)


def merge_together(raws: list[bytes], words: Vocabulary) -> Iterator[bytes]:
    """The ids of pieces of two bytes or more: one tree a row, one merge in every row at a time."""
    sizes = np.array([len(r) for r in raws])
    m, width = len(raws), 1 << int(sizes.max() - 1).bit_length()
    none = _NO_RANK * width
    inside = np.arange(width) < sizes[:, None]
    tokens = np.full((m, width), -1, dtype=np.int64)
    tokens[inside] = words.bytes[np.frombuffer(b"".join(raws), dtype=np.uint8)]
    # One place more, for what lies behind the end.
    following = np.tile(np.arange(1, width + 2), (m, 1))
    before = np.tile(np.arange(-1, width), (m, 1))
    tree = np.full((m, 2 * width), none, dtype=np.int64)
    row, place = np.nonzero(inside[:, 1:])
    tree[row, width + place] = words.pair(tokens[row, place], tokens[row, place + 1], place, width)
    for at in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1], out=tree[:, at])
    rows = np.arange(m)
    while True:
        rows = rows[tree[rows, 1] != none]
        if not len(rows):
            break
        rank, place = np.divmod(tree[rows, 1], width)
        gone = following[rows, place]
        end = following[rows, gone]
        tokens[rows, place] = rank
        tokens[rows, gone] = -1
        following[rows, place] = end
        before[rows, end] = place
        last, first = end >= sizes[rows], before[rows, place] < 0
        ahead = np.where(last, none, words.pair(rank, tokens[rows, np.where(last, place, end)], place, width))
        earlier = np.where(first, place, before[rows, place])
        behind = np.where(first, ahead, words.pair(tokens[rows, earlier], rank, earlier, width))
        for leaf, entry in ((gone, none), (place, ahead), (earlier, behind)):
            tree[rows, width + leaf] = entry
            at = (width + leaf) >> 1
            for _ in range(width.bit_length() - 1):
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
                at >>= 1
    alive = tokens >= 0
    ids = tokens[alive].astype("<i4").tobytes()
    ends = np.cumsum(4 * alive.sum(axis=1)).tolist()
    return (ids[start:end] for start, end in zip([0, *ends], ends, strict=False))


class PairTree:
    """The ranks of the pairs of neighbouring tokens of one piece; tokens are known by their first byte."""

    def __init__(self, piece: bytes, words: Vocabulary):
        self.piece, self.ranks, self.longest = piece, words.ranks, words.longest
        n = self.n = len(piece)
        self.none = _NO_RANK * n
        self.next = list(range(1, n + 1))
        self.before = list(range(-1, n - 1))
        self.tree = [self.none] * n + [self._entry(i, i + 2) for i in range(n - 1)] + [self.none]
        for at in range(n - 1, 0, -1):
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def _entry(self, start: int, end: int) -> int:
        if end - start > self.longest:
            return self.none
        rank = self.ranks.get(self.piece[start:end])
        return self.none if rank is None else rank * self.n + start

    def _put(self, place: int, entry: int) -> None:
        tree, at = self.tree, self.n + place
        tree[at] = entry
        at >>= 1
        while at:
            least = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == least:
                return
            tree[at] = least
            at >>= 1

    def merge_all(self) -> list[int]:
        """The ids that are left when no pair is a token any more."""
        n, following = self.n, self.next
        while n > 1 and self.tree[1] != self.none:
            place = self.tree[1] % n
            gone = following[place]
            end = following[place] = following[gone]
            self._put(gone, self.none)
            if end < n:
                self.before[end] = place
                self._put(place, self._entry(place, following[end]))
            else:
                self._put(place, self.none)
            if place:
                earlier = self.before[place]
                self._put(earlier, self._entry(earlier, end))
        ids, place = [], 0
        while place < n:
            ids.append(self.ranks[self.piece[place : following[place]]])
            place = following[place]
        return ids


class Encoder(dict):
    """The ids of pieces as little-endian bytes, and of whole texts."""

    def __init__(self, words: Vocabulary, how: Bpe):
        super().__init__()
        self.words, self.how = words, how
        self.cut = regex.compile(how.pattern).findall

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.words.ranks.get(raw)
        ids = [whole] if whole is not None else PairTree(raw, self.words).merge_all()
        return np.array(ids, dtype="<i4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Keep the ids of new pieces, unless they are long. A piece that is a token is not merged."""
        if len(self) + len(pieces) > self.how.cached:
            self.clear()
        ranks, groups = self.words.ranks, [([], []) for _ in range(self.how.short.bit_length() + 1)]
        for piece in pieces:
            raw = piece.encode()
            if raw in ranks:
                self[piece] = self[piece]
            elif len(raw) <= self.how.short:
                names, raws = groups[(len(raw) - 1).bit_length()]
                names.append(piece)
                raws.append(raw)
        for names, raws in groups:
            if raws:
                self.update(zip(names, merge_together(raws, self.words), strict=True))

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a window at a time. What ends near a window's end is cut again."""
        at, size = 0, self.how.window
        while at < len(text):
            end = at + size
            found = self.cut(text, at, end)
            if end < len(text):
                stop = sum(map(len, found))
                while found and stop > size - self.how.reach:
                    stop -= len(found.pop())
                if not found:
                    size *= 2
                    continue
                at += stop
                size = self.how.window
            else:
                at = end
            yield found

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of every text."""
        made: list[list[bytes]] = []
        held: list[tuple[list[bytes], list[str]]] = []

        def work_off() -> None:
            pieces = set().union(*(part for _, part in held))
            new = pieces.difference(self)
            # Learning clears what is there once it is too much.
            self.learn(new if len(self) + len(new) <= self.how.cached else pieces)
            for own, part in held:
                own.append(b"".join(map(self.__getitem__, part)))
            held.clear()

        count = 0
        for text in texts:
            made.append([])
            for part in self.pieces(text):
                held.append((made[-1], part))
                count += len(part)
                if count >= self.how.together:
                    work_off()
                    count = 0
        work_off()
        return [b"".join(own) for own in made]


# A worker keeps its encoder, with the pieces that it knows, from task to task.
_encoder: list[Encoder] = []


def _own_encoder(words: Vocabulary, how: Bpe) -> Encoder:
    if not _encoder or _encoder[0].how != how or _encoder[0].words is not words:
        _encoder[:] = [Encoder(words, how)]
    return _encoder[0]


def encode_batches(shared, how: Bpe):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _own_encoder(shared.value, how)
        for batch in sliced(batches, "text"):
            made = encoder.encode(t or "" for t in batch.column("text").to_pylist())
            ends = np.cumsum([0, *(len(m) // 4 for m in made)], dtype=np.int32)
            ids = pa.array(np.frombuffer(b"".join(made), dtype="<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), ids)], ["doc_id", "ids"]
            )

    return encode


def decode_batches(shared):
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.tokens.__getitem__
        for batch in batches:
            lists = batch.column("ids")
            made = [b"".join(map(token, ids.values.tolist())) if ids.is_valid else None for ids in lists]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "decoded"]
            )

    return decode


def shared_vocabulary(spark: SparkSession, path: str):
    """The vocabulary of a rank file, read here and sent to the workers; its size is that of the file."""
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(path)))


def encode_texts(docs: DataFrame, shared, how: Bpe) -> DataFrame:
    """doc_id and `ids` (array of int) of every row of `docs` (doc_id, text).

    `shared` is a `shared_vocabulary`. The ids are those of plain text: strings of special tokens are
    text like any other. A null or empty text has no ids. Null ids and repeated rows are encoded as
    they come, an empty table gives no rows, other columns are not read. No row moves; a very long
    text is cut a window at a time.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode_batches(shared, how), "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, shared) -> DataFrame:
    """Add the bytes `decoded` of the tokens in `ids` (doc_id, ids); null for a null array, empty for
    an empty one. An id that is no token raises.
    """
    return encoded.select("doc_id", "ids").mapInArrow(
        decode_batches(shared), "doc_id bigint, ids array<int>, decoded binary"
    )


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = shared_vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = decode_ids(encode_texts(docs, shared, Bpe(public_tokenizers.PATTERN)), shared)
    return made.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
