"""Packing of tokenised documents into windows of fixed capacity.

Documents are tokenised and cut inside the task that reads them. Full windows stand alone;
the remainders of a bounded group of documents are shared out by Karmarkar-Karp multiway
differencing: the two partial partitions with the largest imbalance are merged, the fullest
windows of one with the emptiest of the other, until one partition is left. If a window of it
exceeds the capacity, the group is shared out again over one window more.

Nothing is shuffled and no group grows with the input: a task holds the pieces of one group.
A task that runs again gives the same pieces, since ids come from the partition and its rows.
"""

from __future__ import annotations

import heapq
import os
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.arrow import as_bytes, sliced

# Words whose ids a worker remembers. Only time depends on it.
REMEMBERED = 800_000

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


@dataclass(frozen=True)
class Packing:
    """Parameters of a packing.

    capacity: tokens of a window. end_id: the id put behind every document.
    windows: windows that a group should fill. longest_piece: remainders are cut to pieces
    of at most this many tokens, as the differencing balances many small pieces better.
    slack: share of a group's windows left free for imbalance.
    """

    capacity: int = 2048
    end_id: int = 1
    windows: int = 96
    longest_piece: int = 256
    slack: float = 0.005


def karmarkar_karp(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of every size, by multiway differencing.

    A partial partition is its `k` sums in falling order, less the smallest. Ties go to the
    partition that was made first, so that the result is fixed.
    """
    if k == 1 or not len(sizes):
        return np.zeros(len(sizes), dtype=np.int64)
    n = len(sizes)
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, size in enumerate(sizes):
        own = np.zeros(k, dtype=np.int64)
        own[0] = size
        sums[i] = own
        heap.append((-int(size), i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        sums[node] = both
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[0]), node))
    place = {2 * n - 2: np.arange(k)}
    for step in range(n - 2, -1, -1):
        a, b, order = merges[step]
        bins = place.pop(n + step)
        first = np.empty(k, dtype=np.int64)
        first[order] = bins
        place[a], place[b] = first, first[::-1]
    return np.array([place[i][0] for i in range(n)], dtype=np.int64)


def share_out(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Near-equal windows for sizes of at most `capacity`: the window of each, and how many.

    Starts at the fewest windows that could hold all, and takes one more as long as the
    fullest exceeds the capacity.
    """
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        bins = karmarkar_karp(sizes, k)
        if np.bincount(bins, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return bins, k
        k += 1


class WordIds:
    """Token ids of texts, remembered by word.

    Exact for tokenizers that never join across white space (it is dropped, or split off, before
    the merges): the ids of a text are those of its words in order. Words are cut at ASCII white
    space only; what lies between is left to the tokenizer.
    """

    _PLAIN = re.compile(rb"([a-z]+)([.,]?)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        # For words of a-z only the merges count: without the rules before them it is faster.
        self._merges = Tokenizer.from_file(path)
        self._merges.normalizer = normalizers.Sequence([])
        self._merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        tried = [b"ab", b"Tokens", b"tokens", b"pneumonoultramicroscopic", b".", b",", b"ab.", b"ab,"]
        ids = dict(zip(tried, self._encode(tried), strict=True))
        plain = [w for w in tried if w.isalpha() and w.islower()]
        self._marks = {m: ids[m][0] for m in (b".", b",")}
        self._shares = (
            ids[b"Tokens"] == ids[b"tokens"]
            and all(ids[b"ab" + m] == [*ids[b"ab"], i] for m, i in self._marks.items())
            and [ids[w] for w in plain] == self._encode_plain(plain)
        )
        self.clear()

    def clear(self) -> None:
        waiting: list[bytes] = []

        class Places(dict):
            def __missing__(self, word: bytes) -> int:
                place = self[word] = len(self)
                waiting.append(word)
                return place

        self._waiting, self._places = waiting, Places()
        self._pool, self._used = np.empty(1 << 16, dtype=np.uint32), 0
        self._starts = np.zeros(1 << 14, dtype=np.int64)
        self._sizes = np.zeros(1 << 14, dtype=np.int32)
        self._known = 0

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        blocks = [[w.decode() for w in words[i : i + 256]] for i in range(0, len(words), 256)]
        found = self._tokenizer.encode_batch(blocks, is_pretokenized=True, add_special_tokens=False)
        for b, block in enumerate(found):
            if None in block.word_ids:  # special tokens belong to no word
                alone = self._tokenizer.encode_batch_fast(blocks[b], add_special_tokens=False)
                out[b * 256 : b * 256 + len(alone)] = [one.ids for one in alone]
                continue
            for i, word in zip(block.ids, block.word_ids, strict=True):
                out[b * 256 + word].append(i)
        return out

    def _encode_plain(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        blocks = [[w.decode() for w in words[i : i + 256]] for i in range(0, len(words), 256)]
        found = self._merges.encode_batch(blocks, is_pretokenized=True, add_special_tokens=False)
        for b, block in enumerate(found):
            for i, word in zip(block.ids, block.word_ids, strict=True):
                out[b * 256 + word].append(i)
        return out

    def _append(self, flat: np.ndarray) -> int:
        """Put ids into the pool; where they start."""
        start, end = self._used, self._used + len(flat)
        if end > len(self._pool):
            self._pool = np.resize(self._pool, max(end, 2 * len(self._pool)))
        self._pool[start:end] = flat
        self._used = end
        return start

    def _learn(self) -> None:
        """Give ids to the words met since the last call.

        Where the tokenizer lower-cases and splits off marks, a plain ASCII word with a stop or
        comma behind it has the ids of the word in lower case, and that of the mark.
        """
        plain, other, same, marked = [], [], [], []
        done = 0
        while done < len(self._waiting):  # stems that are new join the queue
            word, place = self._waiting[done], self._known + done
            done += 1
            found = self._PLAIN.fullmatch(word.lower()) if self._shares else None
            if found is None:
                other.append((place, word))
            elif found[2]:
                marked.append((place, self._places[found[1]], self._marks[found[2]]))
            elif found[1] != word:
                same.append((place, self._places[found[1]]))
            else:
                plain.append((place, word))
        self._known += done
        self._waiting.clear()
        if self._known > len(self._starts):
            room = max(self._known, 2 * len(self._starts))
            self._starts, self._sizes = np.resize(self._starts, room), np.resize(self._sizes, room)
        for group, encode in ((plain, self._encode_plain), (other, self._encode)):
            for i in range(0, len(group), 4096):
                block = group[i : i + 4096]
                ids = encode([w for _, w in block])
                at, sizes = [p for p, _ in block], np.fromiter(map(len, ids), np.int64, len(ids))
                start = self._append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))
                self._starts[at], self._sizes[at] = start + np.cumsum(sizes) - sizes, sizes
        if same:
            at, stem = np.array(same).T
            self._starts[at], self._sizes[at] = self._starts[stem], self._sizes[stem]
        if marked:
            at, stem, mark = np.array(marked).T
            sizes = self._sizes[stem].astype(np.int64) + 1
            ends = np.cumsum(sizes)
            flat = self._gather(self._starts[stem], sizes)  # one too many each: the mark's place
            flat[ends - 1] = mark
            self._starts[at], self._sizes[at] = self._append(flat) + ends - sizes, sizes

    def _gather(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        before = np.cumsum(sizes) - sizes
        at = np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
        return self._pool[np.minimum(at, len(self._pool) - 1)]

    def __call__(self, texts: list[bytes | None], end_id: int) -> list[np.ndarray]:
        """The ids of every text with `end_id` behind them; a missing text counts as empty."""
        if len(self._places) > REMEMBERED:
            self.clear()
        at = self._places.__getitem__
        places = []
        for text in texts:
            words = text.split() if text else []
            places.append(np.fromiter(map(at, words), np.int32, len(words)))
        self._learn()
        out = []
        for place in places:
            ids = self._gather(self._starts[place], self._sizes[place].astype(np.int64))
            out.append(np.append(ids, np.uint32(end_id)))
        return out


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker for `path`; kept between tasks, so its memory is too."""
    kept = sys.__dict__.setdefault("_lexspan_word_ids", {})
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


class _Packer:
    """Pieces of one task, group by group."""

    def __init__(self, how: Packing, first_id: int):
        self.how, self.next_id = how, first_id
        self.rows: list[tuple] = []
        self.out: list[tuple] = []
        self.held = 0
        self.target = max(1, int(how.windows * how.capacity * (1 - how.slack)))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at, room = len(ids), 0, self.how.capacity
        while n - at >= room:
            self._emit(doc_id, at, ids[at : at + room], n, self.next_id, 0)
            self.next_id += 1
            at += room
        while at < n:
            size = min(n - at, self.how.longest_piece, self.target - self.held)
            self.rows.append((doc_id, at, ids[at : at + size], n))
            self.held += size
            at += size
            if self.held == self.target:
                self.close()

    def _emit(self, doc_id, start, ids, n, sequence_id, offset) -> None:
        self.out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, sequence_id, offset))

    def close(self) -> None:
        """Share out the pieces held; pieces of one document that meet again become one."""
        if not self.rows:
            return
        sizes = np.array([len(r[2]) for r in self.rows], dtype=np.int64)
        bins, k = share_out(sizes, self.how.capacity)
        offsets = [0] * k
        last: dict[int, tuple] = {}
        for row, window in zip(self.rows, bins.tolist(), strict=True):
            doc_id, start, ids, n = row
            before = last.get(window)
            if before is not None and before[5] is row[2].base and before[1] + len(before[2]) == start:
                last[window] = (doc_id, before[1], ids.base[before[1] : start + len(ids)], n, before[4], ids.base)
            else:
                if before is not None:
                    self._emit(*before[:4], self.next_id + window, before[4])
                last[window] = (doc_id, start, ids, n, offsets[window], ids.base)
            offsets[window] += len(ids)
        for window, row in last.items():
            self._emit(*row[:4], self.next_id + window, row[4])
        self.next_id += k
        self.rows, self.held = [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[] for _ in _ARROW]
        self.out = []
        arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, _ARROW, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def pack_batches(
    tokenizer_path: str, how: Packing
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(how, TaskContext.get().partitionId() << 33)
        encode = word_ids(tokenizer_path)
        for batch in sliced(batches, "text"):
            ids = encode(as_bytes(batch.column("text")), how.end_id)
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                packer.add(doc_id, own)
            yield packer.take()
        packer.close()
        yield packer.take()

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, how: Packing | None = None) -> DataFrame:
    """Pieces of all documents and their place in the windows.

    `docs` needs `doc_id` and `text`; other columns, whatever their names, are not read. A null
    or empty text is the end id alone. Null ids and repeated rows are packed as they come, each
    row for itself. An empty table gives no rows. The ids of a piece are little-endian unsigned
    32-bit numbers in `ids`; `start` counts the ids of its document before it, `offset` those of
    its window.

    `tokenizer_path` names the vocabulary file on every machine. It must belong to a tokenizer that
    drops or splits off white space (see `WordIds`).
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack_batches(tokenizer_path, how or Packing()), SCHEMA)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
