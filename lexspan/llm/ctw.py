"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary choices, from its highest bit down; every node of that decision tree has a
context tree over the bytes before it. At every context two counts give a Krichevsky-Trofimov
estimate, and the estimates of all depths are mixed with the weights of context-tree weighting:
the probability of a context's data is half that of its own estimate, half the product over its
children. Learnt counts are fixed; a text is then scored by the mixture along its contexts.

The query's tree is whole: every context of the training text is split off, however rare. It is not held in
one place. The runs of bytes are sorted by their contexts, the nearest byte first, so that the contexts under
another lie together; a task folds a chunk of them, and only the contexts at the borders of chunks, which
others may share, are put together in the driver. What comes of it is a table of log probabilities by run.
Frequent runs are looked up in the tasks, others by a join.

A tree may also be asked for that is cut: a context is split by the byte before it wherever the longer context
occurs often enough; the other bytes share one child, which is not split. Often enough is a share of a small
corpus; of a larger one, the count asked for grows with the square root of its size, or with a given power.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.arrow import as_bytes, held_out, sliced
from lexspan.session import pin, shuffle_partitions

END = 0xFF  # no byte of UTF-8; stands before and behind every text


@dataclass(frozen=True)
class ContextTree:
    """Parameters.

    depth: longest context in bytes, at most 7. whole: every context that occurs is split off; `contexts`,
    `grows_from` and `power` have no say then. known: of a whole tree, at most so many of the most frequent
    runs of bytes are looked up in the tasks, others by a join; results are the same. contexts: a context is split off if it holds at least
    one part in `contexts` of all training bytes. grows_from: of more training bytes than these, it
    need only hold that part of the geometric mean of both numbers. power: if given, a context is split off
    if it holds at least one part in `contexts` of this power of all training bytes, however many they are;
    `grows_from` has no say then. frequent: words with at least one part in
    `frequent` of all training tokens are looked up in the tasks, others by a join; results are
    the same. folds, fold: rows whose CRC-32 falls into `fold` are held out of the training.
    """

    depth: int = 5
    contexts: int = 1 << 17
    grows_from: int = 100_000_000
    power: float | None = None
    whole: bool = False
    known: int = 1 << 21
    frequent: int = 1 << 16
    folds: int = 10
    fold: int = 0


def _codes(texts: list[bytes | None], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts between runs of `depth` end bytes; where each begins; its size + 1."""
    gap = bytes([END]) * depth
    texts = [(t or b"").lower() for t in texts]
    raw = np.frombuffer(gap + gap.join([*texts, b""]), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = depth + np.cumsum(sizes + depth) - (sizes + depth)
    return raw, first, sizes + 1


def _scored(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all bytes to score: those of the texts and one end byte each."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))


class _Merged:
    """Counts by key, kept sorted and small: equal keys are added up as they come."""

    LIMIT = 3_000_000

    def __init__(self):
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray, each: int = 1) -> None:
        new, counts = np.unique(keys, return_counts=True)
        counts = counts * each
        every = np.concatenate([self.keys, new])
        amounts = np.concatenate([self.counts, counts])
        order = np.argsort(every, kind="stable")
        every, amounts = every[order], amounts[order]
        heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.keys, self.counts = every[heads], np.add.reduceat(amounts, heads) if len(heads) else amounts

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(self.keys.view(np.int64)), pa.array(self.counts)], names=["gram", "n"]
        )
        self.__init__()
        return batch


def _grams(raw: np.ndarray, how: ContextTree) -> np.ndarray:
    """The runs of depth + 1 bytes from every place on, as numbers.

    Of a whole tree, the last byte comes behind its context, and that is turned: its nearest byte is first.
    """
    keys = np.zeros(len(raw) - how.depth, dtype=np.uint64)
    for j in [*reversed(range(how.depth)), how.depth] if how.whole else range(how.depth + 1):
        keys = (keys << np.uint64(8)) | raw[j : j + len(keys)]
    return keys


def count_grams(how: ContextTree):
    """Counts of all runs of depth + 1 bytes of the training rows, as numbers, one row a task and run.

    Of a whole tree, runs of the rows held out come, too, and count nothing.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged()
        for batch in sliced(batches, "text"):
            out = held_out(batch.column("doc_id").to_pylist(), how.folds, how.fold)
            every = as_bytes(batch.column("text"))
            for each in (1, 0) if how.whole else (1,):
                texts = [t for t, o in zip(every, out, strict=True) if o != bool(each)]
                if not texts:
                    continue
                raw, first, sizes = _codes(texts, how.depth)
                merged.add(_grams(raw, how)[_scored(first, sizes) - how.depth], each)
            if len(merged.keys) > merged.LIMIT:
                yield merged.take()
        yield merged.take()

    return count


def count_words(how: ContextTree):
    """Counts of the tokens of the training rows; the end token is the empty word."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def take() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), type=pa.binary()), pa.array(list(seen.values()), type=pa.int64())],
                names=["word", "n"],
            )
            seen.clear()
            return batch

        for batch in sliced(batches, "text"):
            out = held_out(batch.column("doc_id").to_pylist(), how.folds, how.fold)
            texts = [t or b"" for t, o in zip(as_bytes(batch.column("text")), out, strict=True) if not o]
            seen.update(b"\n".join(texts).lower().split())
            if texts:
                seen[b""] += len(texts)
            if len(seen) > 1_000_000:
                yield take()
        yield take()

    return count


@dataclass
class Model:
    """The tree in tables: `child[c, byte]` is the context that the byte before leads to from context
    c (0 if there is none; context 0 is the empty one), `log10[c, byte]` the mixture's log
    probability of a byte for texts whose deepest context is c."""

    depth: int
    child: np.ndarray
    log10: np.ndarray

    def __getstate__(self) -> tuple:
        # Every context but one is the child of one other: sent to the tasks without the zeros.
        at = np.flatnonzero(self.child)
        return self.depth, at, self.child.ravel()[at], self.log10

    def __setstate__(self, state: tuple) -> None:
        self.depth, at, there, self.log10 = state
        self.child = np.zeros(self.log10.shape, dtype=np.int32)
        self.child.ravel()[at] = there

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """log10 probability of every text and its end."""
        raw, first, sizes = _codes(texts, max(self.depth, 1))
        at = _scored(first, sizes)
        context = np.zeros(len(at), dtype=np.int32)
        open_ = np.ones(len(at), dtype=bool)
        child = self.child.ravel()
        for d in range(1, self.depth + 1):
            deeper = child[context.astype(np.int64) * 256 + raw[at - d]]
            open_ &= deeper > 0
            context = np.where(open_, deeper, context)
        bits = self.log10.ravel()[context.astype(np.int64) * 256 + raw[at]].astype(np.float64)
        return np.add.reduceat(bits, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones.

    Gamma(a+1/2) Gamma(b+1/2) / (pi Gamma(a+b+1)), by Stirling's series; small numbers from a table.
    """
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1.0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    # Shifted up by 8, three terms of the series are exact to double precision.
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 nodes of the byte's decision tree (heap order, node 1 the root, node
    0 unused) for rows of 256 byte counts."""
    sums = np.zeros((len(counts), 512))
    sums[:, 256:] = counts
    for node in range(255, 0, -1):
        sums[:, node] = sums[:, 2 * node] + sums[:, 2 * node + 1]
    return sums[:, 0:512:2][:, :256], sums[:, 1:512:2][:, :256]


class Level:
    """The contexts of one depth with the counts of the bytes behind them.

    Contexts are ordered from the nearest byte outwards, so those that share a shorter one lie together.
    """

    CHUNK = 2048

    def __init__(self, counts: dict[bytes, tuple[list[int], list[int]]]):
        self.names = sorted(counts, key=lambda c: c[::-1])
        self.starts = np.cumsum([0, *(len(counts[c][0]) for c in self.names)])
        self.bytes = np.array([x for c in self.names for x in counts[c][0]], dtype=np.int64)
        self.counts = np.array([x for c in self.names for x in counts[c][1]], dtype=np.float64)
        self.parents = np.zeros(len(self.names), dtype=np.int64)

    def __len__(self) -> int:
        return len(self.names)

    def under(self, shorter: Level) -> None:
        index = {c: i for i, c in enumerate(shorter.names)}
        self.parents = np.array([index[c[1:]] for c in self.names], dtype=np.int64)

    def dense(self, low: int, high: int) -> np.ndarray:
        start, end = self.starts[low], self.starts[high]
        out = np.zeros((high - low, 256))
        row = np.repeat(np.arange(high - low), np.diff(self.starts[low : high + 1]))
        out[row, self.bytes[start:end]] = self.counts[start:end]
        return out

    def chunks(self) -> Iterator[tuple[int, int]]:
        for low in range(0, len(self), self.CHUNK):
            yield low, min(low + self.CHUNK, len(self))


def _split(level: Level, longer: Level | None, low: int, high: int) -> tuple[np.ndarray, np.ndarray, slice]:
    """For contexts from `low` to `high`: their counts, those that no longer context holds, and where
    the longer ones lie."""
    counts = level.dense(low, high)
    left = counts.copy()
    if longer is None:
        return counts, left, slice(0, 0)
    start, end = np.searchsorted(longer.parents, [low, high])
    np.subtract.at(left, longer.parents[start:end] - low, longer.dense(start, end))
    return counts, left, slice(int(start), int(end))


def build_model(levels: list[Level]) -> Model:
    """Weight the tree of the contexts that are split off, by depth; the first is the empty one.

    Bottom up, log P_w = log(½ P_kt + ½ Π P_w of the children), one of which holds what no child has;
    top down, the mixture at a context is its own estimate and that of its child by their weights.
    """
    depth = len(levels) - 1
    for shorter, level in zip(levels, levels[1:], strict=False):
        level.under(shorter)
    longer = [*levels[1:], None]
    weights: list[np.ndarray] = [np.zeros(0)] * (depth + 1)
    below = np.zeros((0, 256))
    for d in range(depth, -1, -1):
        mixed = np.zeros((len(levels[d]), 256))
        weights[d] = np.zeros((len(levels[d]), 256), dtype=np.float32)
        for low, high in levels[d].chunks():
            counts, left, inner = _split(levels[d], longer[d], low, high)
            own = _log_kt(*_bit_counts(counts))
            leaf = np.ones(high - low, dtype=bool)
            product = _log_kt(*_bit_counts(left))
            if inner.stop > inner.start:
                parents = longer[d].parents[inner] - low
                leaf[parents] = False
                np.add.at(product, parents, below[inner])
            both = np.logaddexp(own, product) - math.log(2)
            mixed[low:high] = np.where(leaf[:, None], own, both)
            weights[d][low:high] = np.where(leaf[:, None], 1.0, np.exp(own - math.log(2) - both))
        below = mixed

    def ones_of(rows: np.ndarray) -> np.ndarray:
        zeros, ones = _bit_counts(rows)
        return (ones + 0.5) / (zeros + ones + 1.0)

    first = np.cumsum([0, *map(len, levels)])
    child = np.zeros((first[-1], 256), dtype=np.int32)
    log10 = np.zeros((first[-1], 256), dtype=np.float32)
    above, carried = np.zeros((1, 256), dtype=np.float32), np.ones((1, 256), dtype=np.float32)
    for d, level in enumerate(levels):
        if d:
            here = np.array([c[0] for c in level.names], dtype=np.int64)
            child[first[d - 1] + level.parents, here] = first[d] + np.arange(len(level))
        # The mixture so far and the weight left, to hand on to the longer contexts.
        mixture = np.zeros((len(level), 256), dtype=np.float32)
        left_over = np.zeros((len(level), 256), dtype=np.float32)
        for low, high in level.chunks():
            counts, left, _ = _split(level, longer[d], low, high)
            up, weight = level.parents[low:high], weights[d][low:high]
            mixture[low:high] = above[up] + carried[up] * weight * ones_of(counts)
            left_over[low:high] = carried[up] * (1 - weight)
            # A text that goes no deeper than this meets the child that holds the rest.
            p = np.clip(mixture[low:high] + left_over[low:high] * ones_of(left), 1e-7, 1 - 1e-7).astype(np.float64)
            logs = np.zeros((high - low, 512))
            for node in range(1, 256):
                logs[:, 2 * node] = logs[:, node] + np.log10(1 - p[:, node])
                logs[:, 2 * node + 1] = logs[:, node] + np.log10(p[:, node])
            log10[first[d] + low : first[d] + high] = logs[:, 256:]
        above, carried = mixture, left_over
    return Model(depth, child, log10)


def gather_levels(grams: DataFrame, how: ContextTree) -> list[Level]:
    """The contexts that occur often enough, by depth.

    `grams` has `gram` (depth + 1 bytes as a number) and `n`. At each depth at most `contexts` come to
    the driver, times the root of total / `grows_from` in a larger corpus, with 256 counts each; with a power, at most
    `contexts` times total to the rest of it, total ** (1 - power).
    """
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return [Level({b"": ([], [])})]
    steps = [F.struct(F.lit(d).alias("d"), F.lit(8 * (d + 1)).alias("bits")) for d in range(how.depth + 1)]
    tail = F.col("gram").bitwiseAND(F.expr("shiftleft(1L, s.bits) - 1L"))
    counted = (
        grams.select("gram", "n", F.explode(F.array(*steps)).alias("s"))
        .groupBy(F.col("s.d").alias("d"), F.shiftright(tail, 8).alias("context"), tail.bitwiseAND(255).alias("byte"))
        .agg(F.sum("n").alias("n"))
    )
    contexts = counted.groupBy("d", "context").agg(
        F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("byte", "n"))).alias("bytes")
    )
    if how.power is None:
        base = min(total, math.isqrt(total * how.grows_from))
    else:
        base = math.ceil(total**how.power)
    kept = contexts.filter((F.col("d") == 0) | (F.col("all") * how.contexts >= base)).select(
        "d", "context", "bytes.byte", "bytes.n"
    )
    levels: list[dict[bytes, tuple[list[int], list[int]]]] = [{} for _ in range(how.depth + 1)]
    for row in kept.toLocalIterator():
        levels[row.d][row.context.to_bytes(how.depth + 1, "big")[how.depth + 1 - row.d :]] = row.byte, row.n
    return [Level(x) for d, x in enumerate(levels) if not d or x]


@dataclass
class Tier:
    """Contexts of one depth with the bytes behind them: `keys` are the context, its nearest byte first, and the
    byte behind it, in order; `n` counts them. `up`: their places in the tier of the next shorter contexts.
    `more`: for each of a byte's eight nodes, what is known of the logs of longer contexts besides those of
    the next tier, at one key of the node. `shared`: the context may have more keys elsewhere."""

    keys: np.ndarray
    n: np.ndarray
    up: np.ndarray | None = None
    more: np.ndarray | None = None
    shared: np.ndarray | None = None


_SMALL = np.arange(1 << 16, dtype=np.float64)
_HALVES, _WHOLES = _log_gamma(_SMALL + 0.5), _log_gamma(_SMALL + 1.0)


def _looked_up(counts: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(counts, len(table) - 1).astype(np.int64)]
    large = np.flatnonzero(counts >= len(table))
    out[large] = _log_gamma(counts[large] + more)
    return out


def _key_at(keys: np.ndarray, deep: int, depth: int) -> np.ndarray:
    """Keys of contexts of `depth` bytes from those of `deep` ones."""
    if depth == deep:
        return keys
    context = keys >> np.uint64(8 * (deep - depth) + 8) if depth else np.zeros_like(keys)
    return (context << np.uint64(8)) | (keys & np.uint64(255))


def fold(tiers: list[Tier]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]]:
    """For each of the eight bits of a byte, and by depth for every key: a and c, by which the mixture's probability
    of the key's bit is a + c times that of the longer contexts alone; and the logs of the longer contexts that
    were put together, at the first key of every node.

    Bottom up, log P_w = log(½ P_kt + ½ Π P_w of the children); top down, a mixture is its own estimate and that of
    its child by their weights. Contexts that are shared hand on nothing and begin anew: they are for others to fold.
    """
    depth = len(tiers) - 1
    for bit in range(8):
        own_share, rest, below = [np.zeros(0)] * len(tiers), [np.zeros(0)] * len(tiers), [np.zeros(0)] * len(tiers)
        logs, heads_below = np.zeros(0), np.zeros(0, dtype=np.int64)
        for d in range(depth, -1, -1):
            t = tiers[d]
            prefix = t.keys >> np.uint64(8 - bit)
            heads = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            node = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(prefix))))
            one = (t.keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
            every, ones = np.add.reduceat(t.n, heads), np.add.reduceat(np.where(one, t.n, 0.0), heads)
            zeros = every - ones
            own = _looked_up(zeros, _HALVES, 0.5) + _looked_up(ones, _HALVES, 0.5)
            own -= _looked_up(every, _WHOLES, 1.0) + math.log(math.pi)
            product, weight = np.zeros(len(heads)), np.ones(len(heads))
            if d < depth:
                at = node[tiers[d + 1].up[heads_below]]
                product += np.bincount(at, weights=logs, minlength=len(heads))
            below[d] = np.zeros(len(t.keys))
            below[d][heads] = product
            if t.more is not None:
                product += np.add.reduceat(t.more[:, bit], heads)
            logs = own
            if d < depth:
                logs = np.logaddexp(own, product) - math.log(2)
                weight = np.exp(own - math.log(2) - logs)
            if t.shared is not None:
                logs = np.where(t.shared[heads], 0.0, logs)
            heads_below = heads
            estimate = (np.where(one, ones[node], zeros[node]) + 0.5) / (every[node] + 1.0)
            own_share[d], rest[d] = weight[node] * estimate, 1.0 - weight[node]
        for d, t in enumerate(tiers):
            if d:
                own_share[d] = own_share[d - 1][t.up] + rest[d - 1][t.up] * own_share[d]
                rest[d] = rest[d - 1][t.up] * rest[d]
            if t.shared is not None:
                own_share[d] = np.where(t.shared, 0.0, own_share[d])
                rest[d] = np.where(t.shared, 1.0, rest[d])
        yield own_share, rest, below


_FOLDED = "d int, gram bigint, n bigint, q binary"


def _folded_batch(d: np.ndarray, keys: np.ndarray, n: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    width = q.shape[1] * q.itemsize
    ends = np.arange(0, (len(q) + 1) * width, width, dtype=np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(q))])
    columns = [pa.array(d, pa.int32()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), raw]
    return pa.RecordBatch.from_arrays(columns, names=["d", "gram", "n", "q"])


def _vectors(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), 8)


def _fold_chunk(keys: np.ndarray, n: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """Runs that follow each other: with each the depth of its longest shared context, and for every bit the
    probability by the longer ones. Keys of shared contexts have a depth of -1 - d and the logs of longer ones."""
    ends = np.array([keys[0], keys[-1]])
    order = np.argsort(keys, kind="stable")  # keys with a sign come in another order
    tiers = [Tier(keys[order], n[order].astype(np.float64))]
    for d in range(depth - 1, -1, -1):
        shorter, tiers[0].up = np.unique(_key_at(tiers[0].keys, d + 1, d), return_inverse=True)
        tiers.insert(0, Tier(shorter, np.bincount(tiers[0].up, weights=tiers[0].n, minlength=len(shorter))))
    for d, t in enumerate(tiers):
        t.shared = np.isin(t.keys >> np.uint64(8), _key_at(ends, depth, d) >> np.uint64(8))
    at = [np.flatnonzero(t.shared) for t in tiers]
    alone = np.empty((len(keys), 8), dtype=np.float32)
    logs = [np.empty((len(x), 8)) for x in at]
    for bit, (own_share, _, below) in enumerate(fold(tiers)):
        alone[:, bit] = own_share[depth]
        for d, x in enumerate(at):
            logs[d][:, bit] = below[d][x]
    place, longest = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int32)
    for d in range(depth, 0, -1):
        longest = np.maximum(longest, np.where(tiers[d].shared[place], d, 0))
        place = tiers[d].up[place]
    for low in range(0, len(keys), 1 << 16):
        part = slice(low, low + (1 << 16))
        yield _folded_batch(longest[part], tiers[depth].keys[part], tiers[depth].n[part], alone[part])
    for d, (t, x) in enumerate(zip(tiers, at, strict=True)):
        yield _folded_batch(np.full(len(x), -1 - d), t.keys[x], t.n[x], logs[d])


def fold_grams(how: ContextTree, most: int = 1 << 19):
    """Fold counts of runs that come in order, at most so many at a time."""

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("gram", "n"))
            yield from _fold_chunk(keys.view(np.uint64), n, how.depth)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == most:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return folded


def shared_contexts(rows: pa.Table, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By depth, for the keys of contexts that chunks share: a and c of `fold`, eight each."""
    d, keys = -1 - rows.column("d").to_numpy(), rows.column("gram").to_numpy().view(np.uint64)
    n, logs = rows.column("n").to_numpy().astype(np.float64), _vectors(rows.column("q"), np.float64)
    tiers: list[Tier] = []
    for k in range(depth + 1):
        at = np.flatnonzero(d == k)
        own, place = np.unique(keys[at], return_inverse=True)
        more = np.stack([np.bincount(place, weights=logs[at, bit], minlength=len(own)) for bit in range(8)], axis=1)
        up = np.searchsorted(tiers[-1].keys, _key_at(own, k, k - 1)) if k else None
        tiers.append(Tier(own, np.bincount(place, weights=n[at], minlength=len(own)), up, more))
    if not len(tiers[0].keys):
        return []
    made = [(t.keys, np.empty((len(t.keys), 8)), np.empty((len(t.keys), 8))) for t in tiers]
    for bit, (own_share, rest, _) in enumerate(fold(tiers)):
        for k, (_, a, c) in enumerate(made):
            a[:, bit], c[:, bit] = own_share[k], rest[k]
    return made


def finish(shared, how: ContextTree):
    """The log10 probability of the last byte of every run."""

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, longest = batch.column("gram").to_numpy().view(np.uint64), batch.column("d").to_numpy()
            p = _vectors(batch.column("q"), np.float32).astype(np.float64)
            for d in np.unique(longest):
                own, a, c = shared.value[d]
                at = np.flatnonzero(longest == d)
                place = np.searchsorted(own, _key_at(keys[at], how.depth, int(d)))
                p[at] = a[place] + c[place] * p[at]
            logs = pa.array(np.log10(p).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("n"), logs], names=["gram", "n", "log"])

    return finished


class Known:
    """Log probabilities of runs in a hash table with open addresses; of two for a place, the later one gets it."""

    NONE = np.uint64(0xFE << 56)  # no text has this byte
    BLOCK = 1 << 16

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.bits = max(4, (3 * len(keys) // 2).bit_length())
        self.keys, self.logs = np.full(1 << self.bits, self.NONE), np.zeros(1 << self.bits, dtype=np.float32)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] == self.NONE)
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.logs[at[mine]] = logs[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logs, 0 if not there; and which are not there."""
        at = self._first(keys)
        there, logs = self.keys.take(at), self.logs.take(at)
        missing = []
        left = np.flatnonzero(there != keys)
        logs[left] = 0
        there, at = there[left], at[left]
        while len(left):
            gone = there == self.NONE
            missing.append(left[gone])
            left, at = left[~gone], (at[~gone] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            found = there == keys[left]
            logs[left[found]] = self.logs[at[found]]
            left, at, there = left[~found], at[~found], there[~found]
        return logs, np.sort(np.concatenate(missing)) if missing else left

    def scores(self, texts: list[bytes | None], how: ContextTree) -> tuple[np.ndarray, pa.Array]:
        """log10 probability of every text and its end, but for the runs that are not there; and those runs."""
        raw, first, sizes = _codes(texts, how.depth)
        logs, gone, runs = [], [], []
        # Blocks that stay in the cache; runs that end between texts are looked up, too, and left out.
        for low in range(0, max(len(raw) - how.depth, 0), self.BLOCK):
            keys = _grams(raw[low : low + self.BLOCK + how.depth], how)
            found, missing = self.look_up(keys)
            logs.append(found)
            gone.append(missing + low)
            runs.append(keys[missing])
        starts = first - how.depth
        missing, unknown = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (gone, runs))
        rows = np.searchsorted(starts, missing, side="right") - 1
        within = np.flatnonzero(missing < (starts + sizes)[rows]) if len(texts) else missing
        order = within[np.lexsort((unknown[within], rows[within]))]
        rows, unknown = rows[order], unknown[order]
        heads = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (unknown[1:] != unknown[:-1])])[: len(rows)])
        listed = pa.StructArray.from_arrays(
            [pa.array(unknown[heads].view(np.int64)), pa.array(np.diff(np.append(heads, len(rows))), pa.int32())], names=["gram", "k"]
        )
        ends = np.searchsorted(rows[heads], np.arange(len(texts) + 1)).astype(np.int32)
        edges = np.stack([starts, starts + sizes], axis=1).ravel()
        sums = np.add.reduceat(np.concatenate([*logs, [0.0]]), edges)[::2] if len(sizes) else np.zeros(0)
        return sums, pa.ListArray.from_arrays(pa.array(ends), listed)


def whole_tree(grams: DataFrame, how: ContextTree) -> tuple[Known, DataFrame]:
    """Log probabilities of all runs: a table of at most `known` frequent ones; gram and log of all others.

    `grams` has every `gram` once and `n`, 0 if it is only to be scored. Eager.
    """
    parts = shuffle_partitions(grams.sparkSession)
    in_order = grams.repartitionByRange(parts, "gram").sortWithinPartitions("gram")
    folded = pin(in_order.mapInArrow(fold_grams(how), _FOLDED), "folded")
    shared = folded.sparkSession.sparkContext.broadcast(shared_contexts(folded.where("d < 0").toArrow(), how.depth))
    runs = folded.where("d >= 0")
    step = F.floor(F.log2("n") * 8)
    least = None
    for row in runs.where("n > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        if (taken := (taken if least else 0) + row.c) > how.known:
            break
        least = row.n
    frequent = F.lit(False) if least is None else F.col("n") >= least

    def logs(some: DataFrame) -> DataFrame:
        return some.mapInArrow(finish(shared, how), "gram bigint, n bigint, log double")

    known = logs(runs.where(frequent)).toArrow().sort_by("n")
    table = Known(known.column("gram").to_numpy().view(np.uint64), known.column("log").to_numpy())
    return table, logs(runs.where(~frequent)).drop("n")


# One rule for corpora of every size: no context is too rare. Asked for a cut tree, a context needs 17
# occurrences in 2 MB, 1,800 in 800 MB.
TREE = ContextTree(contexts=7 << 10, power=0.8, whole=True)

_SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_frequent bigint, base double, score double, "
    "n_bytes bigint, rare array<struct<word:binary,k:int>>, unknown array<struct<gram:bigint,k:int>>"
)


def score_batches(model, frequent, how: ContextTree, total: int, kinds: int):
    """Scores of every row; words that are not frequent and runs that are not known are passed on, to be looked up."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Model | Known = model.value
        scale = total + 0.1 * (kinds + 1)
        common: dict[bytes, float] = {w: math.log10((n + 0.1) / scale) for w, n in frequent.value.items()}
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int32())]))
        unknown_type = pa.list_(pa.struct([("gram", pa.int64()), ("k", pa.int32())]))
        for batch in sliced(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            texts = as_bytes(batch.column("text"))
            tokens, known, base, rare, times, ends = [], [], [], [], [], [0]
            for text in texts:
                words = (text or b"").lower().split()
                words.append(b"")
                logs = [common.get(w) for w in words]
                there = [x for x in logs if x is not None]
                tokens.append(len(words))
                known.append(len(there))
                base.append(math.fsum(there))
                others = Counter(w for w, x in zip(words, logs, strict=True) if x is None)
                rare.extend(others)
                times.extend(others.values())
                ends.append(len(rare))
            listed = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], names=["word", "k"])
            if how.whole:
                scores, unknown = tree.scores(texts, how)
            else:
                scores, unknown = tree.scores(texts), pa.nulls(len(texts), unknown_type)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, type=pa.int64()),
                    pa.array(held_out(ids, how.folds, how.fold)),
                    pa.array(tokens, type=pa.int64()),
                    pa.array(known, type=pa.int64()),
                    pa.array(base, type=pa.float64()),
                    pa.array(scores),
                    pa.array([len(t or b"") for t in texts], type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed).cast(rare_type),
                    unknown.cast(unknown_type),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_frequent", "base", "score", "n_bytes", "rare", "unknown"],
            )

    return score


def score_texts(docs: DataFrame, how: ContextTree | None = None) -> DataFrame:
    """Scores of every row of `docs` (doc_id, text) under models of its training rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (a smoothed word model),
    score (log10 probability of the text and its end, A-Z lower-cased, by context-tree weighting) and
    bits_per_byte (its code length, without the end for the count). A null text is empty; rows are
    scored each for itself, repeated or not; a row without id is never held out. Without training
    rows every binary choice is even. Other columns are not read.
    """
    how = how or ContextTree()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = docs.mapInArrow(count_grams(how), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    words = pin(
        docs.mapInArrow(count_words(how), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # At most `frequent` words can have that share; long ones stay behind, to bound their size.
    common = words.filter((F.col("n") * how.frequent >= total) & (F.length("word") <= 64))
    frequent = spark.sparkContext.broadcast({bytes(r.word): r.n for r in common.toLocalIterator()})
    if how.whole:
        tree, others = whole_tree(grams, how)
    else:
        tree, others = build_model(gather_levels(pin(grams, "grams"), how)), None
    model = spark.sparkContext.broadcast(tree)
    scored = docs.mapInArrow(score_batches(model, frequent, how, total, kinds), _SCORED)
    scored = pin(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    scale = total + 0.1 * (kinds + 1)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    found = (
        rare.join(words, "word", "left")
        .withColumn("c", F.coalesce("n", F.lit(0)))
        .groupBy("row")
        .agg(
            F.sum(F.col("k") * F.log10((F.col("c") + 0.1) / F.lit(scale))).alias("rest"),
            F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"),
        )
    )
    score = F.col("score")
    if others is not None:
        unknown = scored.select("row", F.explode("unknown").alias("u")).select("row", "u.gram", "u.k")
        logs = unknown.join(others, "gram").groupBy("row").agg(F.sum(F.col("k") * F.col("log")).alias("log"))
        found = found.join(logs, "row", "full")
        score = score + F.coalesce("log", F.lit(0.0))
    return scored.drop("rare", "unknown").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), TREE)
