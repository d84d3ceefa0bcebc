"""Near-duplicates by b-bit MinHash.

Every document becomes the minima of 256 permutations of its shingles. Bands of minima give the
candidates; of the minima themselves two low bits are kept, packed into bit planes, and bit counts
of a pair, corrected for chance agreement, estimate its similarity. What may be similar enough is
confirmed on the full shingle sets.

Copies are one document until the end. Every member of a bucket is first compared with one hub, the
smallest member of the largest component of the buckets it shares, so that a large group of near
copies costs about one comparison per member. What is then still in different components is compared
in blocks: members outside the largest component of a bucket, some hundreds in one task, against all
members. First by bit counts, which tells the clusters of components that may be linked; then, within
each cluster, by full shingle sets. A task gives out only what joins two components, never a row for
every pair, and no link between components is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.arrow import as_bytes, sliced
from lexspan.llm.components import components
from lexspan.llm.joins import salted_join
from lexspan.session import pin

MINIMA = 256
WORDS_PER_PLANE = MINIMA // 64
SALTS = 16


@dataclass(frozen=True)
class NearDup:
    """Parameters.

    shingle: words of a shingle. percent: least Jaccard similarity of a link, in percent.
    miss: largest probability that a pair at that similarity shares no band; the rows of a band
    follow from it. sigmas: standard errors of the estimate that a candidate may fall short by.
    hub_rounds: rounds of one comparison per member before all that is left apart is compared.
    broadcast_ids: most ids of documents to confirm that are sent to the scan. block: members that
    a task holds to compare others with; by full sets, at most half as many, and of block_bytes of text.
    """

    shingle: int = 5
    percent: int = 80
    miss: float = 1e-5
    sigmas: float = 4.5
    hub_rounds: int = 2
    broadcast_ids: int = 1_000_000
    block: int = 512
    block_bytes: int = 8 << 20

    @property
    def rows(self) -> int:
        """The longest bands, cut from all minima, that miss few enough."""
        s = self.percent / 100
        fits = [r for r in range(1, 17) if (1 - s**r) ** (MINIMA // r) <= self.miss]
        return max(fits, default=1)

    @property
    def bands(self) -> int:
        return MINIMA // self.rows

    @property
    def least_estimate(self) -> float:
        s = self.percent / 100
        match = s + (1 - s) / 4
        return s - self.sigmas * math.sqrt(match * (1 - match) / MINIMA) / 0.75


def _random(seed: int, size: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, size, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """64-bit hashes of the word shingles of texts: words without ASCII white space, A-Z lower-cased."""

    def __init__(self, width: int):
        self.width = width
        self._letters = _random(1, 256)
        self._space = np.zeros(256, dtype=bool)
        self._space[[0x20, *range(0x09, 0x0E)]] = True
        self._powers = self._power_table(64)

    @staticmethod
    def _power_table(size: int) -> np.ndarray:
        return np.multiply.accumulate(np.full(size, 0xD1342543DE82EF95, dtype=np.uint64))

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where the words of each text end among them."""
        raw = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
        inside = ~self._space[raw]
        before = np.concatenate([[False], inside[:-1]])
        starts = np.flatnonzero(inside & ~before)
        edges = np.cumsum([len(t) + 1 for t in texts])
        if not len(starts):
            return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
        letters = raw[inside]
        first = np.cumsum(inside)[starts] - 1  # of each word among all letters
        place = np.arange(len(letters)) - np.repeat(first, np.diff([*first, len(letters)]))
        longest = int(place.max()) + 1
        if longest > len(self._powers):
            self._powers = self._power_table(2 * longest)
        hashes = np.add.reduceat(self._letters[letters] * self._powers[place], first)
        return _mixed(hashes), np.searchsorted(starts, edges)

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The sorted distinct shingles of every text; one of all words if there are fewer."""
        words, ends = self._words([t or b"" for t in texts])
        step = np.uint64(0xA0761D6478BD642F)
        n = max(len(words) - self.width + 1, 0)
        rolled = np.full(n, self.width, dtype=np.uint64)
        for j in range(self.width):
            rolled = rolled * step + words[j : j + n]
        rolled = _mixed(rolled)
        out, start = [], 0
        for end in ends.tolist():
            if end - start >= self.width:
                out.append(np.unique(rolled[start : end - self.width + 1]))
            elif end > start:
                whole = np.uint64(end - start)
                for w in words[start:end]:
                    whole = np.multiply(whole, step) + w
                out.append(_mixed(np.array([whole])))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            start = end
        return out


_SKETCH = "doc_id bigint, fp binary, n_shingles bigint, planes array<bigint>, bands array<bigint>"


def sketch_batches(how: NearDup):
    rows, bands = how.rows, how.bands

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(how.shingle)
        factors = (_random(2, MINIMA) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        weights = _random(3, rows) | np.uint64(1)
        salt = _random(4, bands)
        for batch in sliced(batches, "text"):
            texts = as_bytes(batch.column("text"))
            prints = [hashlib.blake2b(b" ".join((t or b"").lower().split()), digest_size=16).digest() for t in texts]
            sets = shingles(texts)
            minima = np.zeros((len(texts), MINIMA), dtype=np.uint32)
            done: dict[bytes, int] = {}
            for i, own in enumerate(sets):
                if prints[i] in done:
                    minima[i] = minima[done[prints[i]]]
                elif len(own):
                    done[prints[i]] = i
                    high = (own >> np.uint64(32)).astype(np.uint32)
                    least = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
                    for at in range(0, len(high), 2048):
                        block = np.multiply.outer(factors, high[at : at + 2048])
                        np.minimum(least, block.min(axis=1), out=least)
                    minima[i] = least
            planes = np.concatenate(
                [np.packbits((minima >> b) & 1, axis=1, bitorder="little").view("<i8") for b in (np.uint32(0), np.uint32(1))],
                axis=1,
            )
            keys = minima[:, : rows * bands].reshape(len(texts), bands, rows).astype(np.uint64)
            keys = _mixed(_mixed((keys * weights).sum(axis=2, dtype=np.uint64)) + salt).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(prints, type=pa.binary()),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    _lists(planes),
                    _lists(keys),
                ],
                names=["doc_id", "fp", "n_shingles", "planes", "bands"],
            )

    return sketch


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the bit planes of two sketches: the share of equal pairs of low bits, less
    what agrees by chance."""
    differing = sum(
        F.bit_count(
            a[k].bitwiseXOR(b[k]).bitwiseOR(a[k + WORDS_PER_PLANE].bitwiseXOR(b[k + WORDS_PER_PLANE]))
        )
        for k in range(WORDS_PER_PLANE)
    )
    return (1 - differing / F.lit(MINIMA) - 0.25) / 0.75


def confirm_batches(how: NearDup):
    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(how.shingle)
        for batch in sliced(batches, "text_b"):
            hubs = batch.column("a").to_pylist()
            firsts = list({a: i for i, a in enumerate(hubs)}.values())
            texts_a = batch.column("text_a").take(pa.array(firsts))
            own = dict(zip((hubs[i] for i in firsts), shingles(as_bytes(texts_a)), strict=True))
            linked = []
            for a, y in zip(hubs, shingles(as_bytes(batch.column("text_b"))), strict=True):
                x = own[a]
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(bool(both) and 100 * both >= how.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return confirm


def _asked_texts(docs: DataFrame, pairs: DataFrame, how: NearDup) -> DataFrame:
    """id and text of the documents in `pairs`. Few ids go to the scan; for many, the texts move."""
    asked = pin(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id"), "asked")
    small = asked.count() <= how.broadcast_ids
    found = docs.join(F.broadcast(asked) if small else asked, "doc_id", "left_semi")
    return pin(found.select(F.col("doc_id").alias("id"), "text"), "texts")


def _confirmed(docs: DataFrame, pairs: DataFrame, how: NearDup) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    texts = _asked_texts(docs, pairs, how)
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    whole = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    found = whole.select("a", "b", "text_a", "text_b").mapInArrow(confirm_batches(how), "a bigint, b bigint")
    return pin(found, "links")


def _with_components(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return shared.withColumn("component", F.col("id"))
    return shared.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _mixed_buckets(placed: DataFrame, step: int) -> DataFrame:
    """key, largest (component) and hub (a member of it, another one in each step) of the buckets with
    several components."""
    turn = F.lit(0).cast("bigint") if step == 0 else F.xxhash64("id", F.lit(step))
    groups = placed.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(turn.alias("turn"), F.col("id"))).alias("first")
    )
    top = F.max(F.struct(F.col("n"), F.col("component"), F.col("first.id").alias("hub")))
    return (
        groups.groupBy("key")
        .agg(top.alias("top"), F.count(F.lit(1)).alias("kinds"))
        .filter("kinds > 1")
        .select("key", F.col("top.component").alias("largest"), F.col("top.hub").alias("hub"))
    )


def _to_hubs(met: DataFrame, planes: DataFrame, how: NearDup) -> DataFrame:
    """One pair at most for every member: with the hub, of another component, that it shares most
    buckets with."""
    often = met.filter("component != largest").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = often.groupBy("id").agg(F.max(F.struct(F.col("n"), (-F.col("hub")).alias("least"))).alias("top"))
    pairs = best.select(F.least("id", -F.col("top.least")).alias("a"), F.greatest("id", -F.col("top.least")).alias("b"))
    return (
        pairs.distinct()
        .join(planes.select(F.col("id").alias("b"), F.col("planes").alias("y")), "b")
        .join(planes.select(F.col("id").alias("a"), F.col("planes").alias("x")), "a")
        .filter(estimate(F.col("x"), F.col("y")) >= how.least_estimate)
        .select("a", "b")
    )


class Block:
    """Members outside the largest component, which others are compared with.

    Components that meet in the block are merged as they go, so that the links found are a forest.
    """

    def __init__(self, ids: np.ndarray, components: np.ndarray):
        self.ids, self.components = ids, components
        self.roots = components.copy()
        self.parent: dict[int, int] = {}

    def _root(self, component: int) -> int:
        while component in self.parent:
            component = self.parent[component]
        return component

    def open(self, other: int, component: int, outside: bool) -> np.ndarray:
        """The members that another one has still to be compared with. Two members outside the largest
        component meet twice; one of the two is enough."""
        apart = self.roots != self._root(component)
        return apart & (other < self.ids) if outside else apart

    def join(self, component: int, hits: np.ndarray) -> list[tuple[int, int]]:
        """Links of a component with those of the members hit, one for each two that are still apart."""
        own, out = self._root(component), []
        for at in np.flatnonzero(hits).tolist():
            root = int(self.roots[at])
            if root != own:
                out.append((component, int(self.components[at])))
                self.parent[root] = own
                self.roots[self.roots == root] = own
        return out


class SketchBlock(Block):
    """Compares by the bit planes of sketches and the sizes of the sets."""

    def __init__(self, rows: pa.Table, how: NearDup):
        super().__init__(rows.column("id").to_numpy(), rows.column("component").to_numpy().copy())
        self.how = how
        self.planes, self.sizes = self._loaded(rows)

    @staticmethod
    def _loaded(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        planes = rows.column("planes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return planes.view(np.uint64).reshape(rows.num_rows, -1), rows.column("n_shingles").to_numpy()

    def links(self, rows: pa.Table) -> Iterator[tuple[int, int]]:
        planes, sizes = self._loaded(rows)
        ids, components, outside = (rows.column(c).to_numpy() for c in ("id", "component", "outside"))
        step = max(1, (1 << 20) // len(self.ids))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            differing = np.zeros((len(self.ids), len(ids[part])), dtype=np.int64)
            for k in range(WORDS_PER_PLANE):
                low, high = (self.planes[:, j, None] ^ planes[None, part, j] for j in (k, k + WORDS_PER_PLANE))
                differing += np.bitwise_count(low | high)
            small = np.minimum(self.sizes[:, None], sizes[None, part])
            large = np.maximum(self.sizes[:, None], sizes[None, part])
            alike = (1 - differing / MINIMA - 0.25) / 0.75 >= self.how.least_estimate
            alike &= 100 * small >= self.how.percent * large
            for i in np.flatnonzero(alike.any(axis=0)).tolist():
                other = at + i
                wanted = self.open(int(ids[other]), int(components[other]), bool(outside[other]))
                yield from self.join(int(components[other]), alike[:, i] & wanted)


class SetBlock(Block):
    """Compares by full shingle sets, through one sorted list of the shingles of all members."""

    def __init__(self, rows: pa.Table, how: NearDup):
        super().__init__(rows.column("id").to_numpy(), rows.column("component").to_numpy().copy())
        self.how, self.shingles = how, Shingles(how.shingle)
        sets = self.shingles(as_bytes(rows.column("text").combine_chunks()))
        self.sizes = np.array([len(s) for s in sets])
        every, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.every, self.owners = every[order], owners[order]

    def _common(self, own: np.ndarray) -> np.ndarray:
        """How many shingles each member has in common with a set."""
        first = np.searchsorted(self.every, own, "left")
        count = np.searchsorted(self.every, own, "right") - first
        found = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.owners[found], minlength=len(self.ids))

    def links(self, rows: pa.Table) -> Iterator[tuple[int, int]]:
        names = ("id", "component", "outside")
        for batch in sliced(rows.to_batches(), "text"):
            ids, components, outside = (batch.column(c).to_pylist() for c in names)
            sets: list[np.ndarray] | None = None
            for i, other in enumerate(ids):
                wanted = self.open(other, components[i], outside[i])
                if wanted.any():
                    if sets is None:
                        sets = self.shingles(as_bytes(batch.column("text")))
                    both = self._common(sets[i])
                    hits = 100 * both >= self.how.percent * (self.sizes + len(sets[i]) - both)
                    yield from self.join(components[i], wanted & hits & (both > 0))


def block_batches(kind: type[SketchBlock] | type[SetBlock], how: NearDup):
    """Links (a, b) between the components of rows that come by group and block, members to hold first."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            groups, blocks, held_rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "block", "held"))
            change = np.flatnonzero((groups[1:] != groups[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(groups)], strict=True):
                if hi == lo:
                    continue
                if key != (groups[lo], blocks[lo]):
                    key, held, block = (groups[lo], blocks[lo]), [], None
                cut = lo + int(held_rows[lo:hi].sum())
                if cut > lo:
                    held.append(batch.slice(lo, cut - lo))
                if cut < hi and held:  # a block may hold nobody
                    if block is None:
                        block = kind(pa.Table.from_batches(held), how)
                    out += block.links(pa.Table.from_batches([batch.slice(cut, hi - cut)]))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare


def _in_blocks(members: DataFrame, kind: type[SketchBlock] | type[SetBlock], blocks: Column, how: NearDup) -> DataFrame:
    """Links (a, b) between components of a group's members (grp, id, component, largest, and what is
    compared). `blocks` tells from the members outside the largest component how many hold them.

    A member outside is held by one block; every member goes to all blocks of its group.
    """
    members = members.withColumn("outside", F.col("component") != F.col("largest")).drop("largest")
    needed = members.filter("outside").groupBy("grp").agg(blocks.cast("int").alias("blocks"))
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    sized = pin(salted_join(salted, needed, ["grp"], SALTS, "inner").drop("_salt"), "members")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = sized.filter("outside").withColumn("block", own).withColumn("held", F.lit(True))
    others = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = held.unionByName(others.withColumn("held", F.lit(False))).drop("blocks")
    by_block = both.repartition("grp", "block").sortWithinPartitions("grp", "block", F.desc("held"))
    return by_block.mapInArrow(block_batches(kind, how), "a bigint, b bigint")


def _across(docs: DataFrame, met: DataFrame, sketches: DataFrame, how: NearDup) -> DataFrame:
    """Links between members of a bucket that are in different components, if their sets are similar
    enough; between any two components, enough of them to join what belongs together."""
    apart = met.select(F.col("key").alias("grp"), "id", "component", "largest").join(sketches, "id")
    count = F.ceil(F.count(F.lit(1)) / how.block)
    possible = pin(_in_blocks(apart, SketchBlock, count, how).distinct(), "possible")
    clusters = components(possible).select(F.col("id").alias("component"), F.col("component").alias("grp"))
    # Every member of a bucket whose component may be linked with another one.
    members = pin(met.select("id", "component").distinct().join(clusters, "component"), "clusters")
    top = F.max(F.struct("n", "component"))["component"].alias("largest")
    largest = members.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(top)
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    members = pin(salted_join(salted, largest, ["grp"], SALTS, "inner").drop("_salt"), "members")
    texts = _asked_texts(docs, members.select(F.col("id").alias("a"), F.col("id").alias("b")), how)
    count = F.greatest(
        F.ceil(2 * F.count(F.lit(1)) / how.block), F.ceil(F.sum(F.octet_length("text")) / how.block_bytes)
    )
    return pin(_in_blocks(members.join(texts, "id"), SetBlock, count, how).distinct(), "links")


def near_duplicates(docs: DataFrame, how: NearDup | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text).

    Null texts and texts without words have no shingles and no links. `component_id` is the least
    doc_id that a document reaches, itself included, and kept tells whether it is the document's
    own. Rows of one text are linked, repeated rows among them; a row without id takes the component
    of its copies, and is kept if there is none. Other columns are not read.
    """
    how = how or NearDup()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = pin(docs.mapInArrow(sketch_batches(how), _SKETCH), "sketches")
    distinct = pin(
        sketches.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("fp")
        .agg(
            F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("n_shingles", "planes", "bands")]
        ),
        "distinct",
    )
    members = distinct.select("id", F.explode("bands").alias("key"))
    keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    salted = members.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    shared = pin(salted_join(salted, keys, ["key"], SALTS, "inner"), "shared")
    planes = distinct.select("id", "planes")

    labels = links = tried = None
    for step in range(how.hub_rounds + 1):
        placed = _with_components(shared, labels)
        met = pin(salted_join(placed, _mixed_buckets(placed, step), ["key"], SALTS, "inner"), "met")
        shared = met.select("id", "key", "_salt")  # components only grow: other buckets are done
        if step < how.hub_rounds:
            pairs = _to_hubs(met, planes, how)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = pin(pairs, "candidates")
            tried = pairs if tried is None else tried.unionByName(pairs)
            found = _confirmed(docs, pairs, how)
        else:
            found = _across(docs, met, distinct.select("id", "n_shingles", "planes"), how)
        links = found if links is None else links.unionByName(found)
        labels = components(links)

    named = distinct.select("fp", "id").join(labels, "id", "left")
    named = named.select("fp", F.coalesce("component", "id").alias("component"))
    rows = sketches.select("doc_id", "fp", "n_shingles").withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    )
    component = F.coalesce("component", "doc_id")
    return salted_join(rows, named, ["fp"], SALTS).select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, NearDup(shingle=3, percent=85))
