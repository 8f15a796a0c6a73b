"""N-gram Jaccard join: pivots, cells of the documents round them, and triangle-inequality windows.

Jaccard distance is a metric, so a pivot's distances bound those between documents. But most pairs of
documents share nothing and stand at distance 1 from each other and from any pivot, where the
inequality says nothing. So a pivot's cell has only documents that can be linked by way of a rare
shingle that the pivot has, and a document at the boundary of several pivots goes to the cell of each.

1. A table of counters, of a fixed size, gets the document frequencies of all shingles (``frequencies``).
2. Each document's shingles are put in the order (counter, hash). Two sets with a similarity of t share
   one of their first n - ceil(t * n) + 1, the rarest (``signatures``). Sets that are equal are one node.
3. The pivot of a shingle is the least node that has it; a node belongs to the cells of all pivots of its
   shingles, so two that can be linked meet in one (``cells_of``). Cells that another one contains go.
4. Each cell is joined by Voronoi cells within it, whose boundary documents are replicated by windows,
   recursively (``RegionJoin``); a cell too large for one task is cut into chunks by its pivots, and pairs
   of chunks that the windows leave open are joined one by one (``_chunked``).
5. Components over the links give the result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bit_filter, cut, free_names, has_bit, small, tidy
from tessera.llm.graph import components
from tessera.llm.textkit import Words, mix, ngram_hashes, slices, text_buffers

COUNTERS = 1 << 25
CHUNK = 1 << 16
#: Documents of a large cell that one task measures against its pivots.
PIECE = 500
FILTER_BITS = 1 << 26


class Sets:
    """The distinct shingles of the rows of a slice: values, row by row in order of hash, and the rows' starts."""

    def __init__(self, words: Words, n: int):
        hashes = words.hashes(lower=True)
        values, first = ngram_hashes(hashes, words.row, n)
        row = words.row[first]
        short = np.flatnonzero((words.counts > 0) & (words.counts < n))
        if len(short):  # fewer words than n: the whole sequence is one shingle
            start = np.searchsorted(words.row, short)
            more = np.array([int(mix(np.array([_sequence(hashes[s : s + c])], dtype=np.uint64))[0]) for s, c in zip(start, words.counts[short], strict=True)], dtype=np.uint64)
            values, row = np.concatenate([values, more]), np.concatenate([row, short])
        order = np.lexsort((values, row))
        values, row = values[order], row[order]
        if len(values):
            new = np.append(True, (values[1:] != values[:-1]) | (row[1:] != row[:-1]))
            values, row = values[new], row[new]
        self.values, self.row = values, row
        self.size = np.bincount(row, minlength=words.rows)
        self.start = np.cumsum(self.size) - self.size

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that the set decides, as two signed 64-bit numbers for each row."""
        out = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.values ^ np.uint64(salt)), dtype=np.uint64)])
            out.append(mix(total[self.start + self.size] - total[self.start] + self.size.astype(np.uint64)).view(np.int64))
        return out[0], out[1]


def _sequence(hashes: np.ndarray) -> int:
    value = len(hashes)
    for h in hashes.tolist():
        value = (value * 0x9E3779B97F4A7C15 + h) & (1 << 64) - 1
    return value


def _encoded(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: up to 31 as they are, from there eight steps for each doubling, so that 2**32 and less are told apart."""
    return np.where(n < 32, n, np.minimum(32 + 8 * (np.log2(np.maximum(n, 32)) - 5), 255)).astype(np.uint8)


def frequencies(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """COUNTERS document frequencies of all shingles, ``_encoded``, each counter that of all shingles with its hash.

    What is shuffled is a packed byte for each counter and task, what the driver gets 32 MB, whatever the
    corpus. A task counts to 255; the sums of tasks have no bound, so counters never fill up.
    """

    @tidy
    def count(batches):
        total = np.zeros(COUNTERS, dtype=np.uint8)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in slices(offsets):
                at, times = np.unique(_counter(Sets(Words(data, offsets, i, j), n).values), return_counts=True)
                total[at] = np.minimum(total[at] + times, 255)
        for k in range(0, COUNTERS, CHUNK):
            if total[k : k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(total[k : k + CHUNK], 1)], pa.binary())], names=["k", "n"])

    @tidy
    def add(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
                if k in have:
                    have[k] += part
                else:
                    have[k] = part.astype(np.uint32)
        for k, n_ in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_encoded(n_).tobytes()], pa.binary())], names=["k", "n"])

    parts = docs.select(text_col).mapInArrow(count, "k int, n binary").repartition("k").mapInArrow(add, "k int, n binary")
    out = np.zeros(COUNTERS, dtype=np.uint8)
    for k, raw in parts.toLocalIterator():
        out[k : k + CHUNK] = np.frombuffer(raw, dtype=np.uint8)
    return out


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n shingles must be looked at so that a partner of that similarity shares one."""
    return n - (percent * n + 99) // 100 + 1


def index_size(n: Column, percent: int) -> Column:
    """The same for partners of at least that size: the shorter set of a pair need not offer more of its prefix."""
    return n - F.ceil(2 * percent * n / F.lit(100 + percent) - 1e-9) + 1


def signatures(docs: DataFrame, counters, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """id, size, k1, k2 (digest of the set) and the prefix of each document.

    A set that the task has had, and a row without an id, come without a prefix.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches):
        table = counters.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                sets = Sets(Words(data, offsets, i, j), n)
                k1, k2 = sets.digests()
                fresh = known[i:j] & (sets.size > 0)
                for r, pair in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                    if fresh[r]:
                        fresh[r] = pair not in seen
                        seen.add(pair)
                if len(seen) > 500_000:
                    seen.clear()
                order = np.lexsort((sets.values, table[_counter(sets.values)], sets.row))
                take = np.where(fresh & (sets.size * (100 - percent) >= percent), prefix_size(sets.size, percent), 0)  # smaller sets have only equal partners
                place = np.arange(len(sets.values)) - sets.start[sets.row]
                some = sets.values[order][place < take[sets.row]].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sets.size.astype(np.int64)), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(ends), pa.array(some))],
                    names=["id", "size", "k1", "k2", "prefix"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, size long, k1 long, k2 long, prefix array<long>")


def with_partners(members: DataFrame, percent: int) -> DataFrame:
    """members (k1, size, hub, ...) less those that no other of their cell is near enough in size to be linked with.

    Sizes of two linked sets differ by a factor of 100 / percent at most, so they lie in one step of a
    scale with that factor or in neighbouring ones; counts of the steps of each cell say who is alone.
    """
    step = F.floor(F.log(F.col("size")) / (math.log(100 / percent) * (1 + 1e-9)))
    placed = members.withColumn("step", step)
    counts = placed.groupBy("hub", "step").agg(F.count(F.lit(1)).alias("n"))
    near = counts.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))).groupBy("hub", "step").agg(F.sum("n").alias("n")).where("n > 1")
    return placed.join(near.select("hub", "step"), ["hub", "step"], "left_semi").select(*members.columns)


def cells_of(sized: DataFrame, percent: int) -> DataFrame:
    """k1, hub: the cells that each node belongs to, named by their pivot; cells of one node are not there.

    The pivot of a shingle is the least node that has it in its index prefix. If all nodes of a cell have
    one least cell, that one contains it, and it is left out.
    """
    seen = sized.select("k1", "size", F.posexplode("prefix").alias("at", "sig"))
    hubs = seen.where(F.col("at") < index_size(F.col("size"), percent)).groupBy("sig").agg(F.min("k1").alias("hub"))
    stars = cut(seen.select("k1", "sig").join(hubs, "sig").where("k1 != hub").select("k1", "hub").distinct(), "stars")
    every = stars.union(stars.select(F.col("hub").alias("k1"), "hub").distinct())
    least = every.groupBy("k1").agg(F.min("hub").alias("least"), F.collect_list("hub").alias("hubs"))  # no more hubs than the prefix has shingles
    dealt = cut(least.select("k1", "least", F.explode("hubs").alias("hub")), "dealt")
    within = dealt.groupBy("hub").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low = high and low != hub").select("hub")
    return dealt.select("k1", "hub").join(within, "hub", "left_anti")


class RegionJoin:
    """The links of one cell, as a forest: pivots, Voronoi cells, windows, and exact counts.

    Only connections matter, so pairs that are connected already are passed over. ``opened`` counts the
    Voronoi cells; those of LEAF documents and fewer are compared one by one.
    """

    LEAF, PIVOTS = 3, 6

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.radius = percent, 1 - percent / 100 + 1e-12
        self.size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.token = np.unique(flat, return_inverse=True)[1].astype(np.int32) if len(flat) else np.zeros(0, np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.mark = np.zeros(int(self.token.max()) + 1 if len(flat) else 1, dtype=bool)
        self.root = np.arange(len(sets))
        self.opened = 0

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """Shingles that x shares with each of the others."""
        mine = self.token[self.start[x] : self.start[x] + self.size[x]]
        self.mark[mine] = True
        n = self.size[others]
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(first - self.start[others], n)
        out = np.add.reduceat(self.mark[self.token[at]].astype(np.int32), first)
        self.mark[mine] = False
        return out

    def distances(self, x: int, others: np.ndarray) -> np.ndarray:
        """Distances from x; what is linked with x is joined to it."""
        both = self.shared(x, others)
        union = self.size[x] + self.size[others] - both
        for r in np.unique(self.root[others[100 * both >= self.percent * union]]):
            a, b = sorted((int(r), int(self.root[x])))
            if a != b:
                self.root[self.root == b] = a
        return 1 - both / union

    def run(self) -> np.ndarray:
        """The root of each document."""
        every = np.arange(len(self.size))
        if len(every) > 1:
            self._cell(every, np.ones(len(every), dtype=bool), np.zeros((len(every), 0)), 0)
        return self.root

    def _cell(self, docs: np.ndarray, native: np.ndarray, known: np.ndarray, depth: int) -> None:
        """Join the native documents of a cell with all of its documents; known: distances to pivots so far."""
        if not native.any() or len(docs) < 2 or (self.root[docs] == self.root[docs[0]]).all():
            return
        if len(docs) <= self.LEAF or depth > 12:
            return self._leaf(docs, native, known)
        pivots: list[int] = []
        near = np.zeros((len(docs), 0))
        far = np.full(len(docs), np.inf)
        while len(pivots) < self.PIVOTS:
            pivot = int(np.flatnonzero(native)[0]) if not pivots else int(np.argmax(far))  # the one farthest from all
            if pivots and far[pivot] <= self.radius:
                break
            pivots.append(pivot)
            d = self.distances(int(docs[pivot]), docs)
            near = np.column_stack([near, d])
            far = np.minimum(far, d)
            if (self.root[docs] == self.root[docs[0]]).all():
                return
        home = near.argmin(axis=1)
        known = np.column_stack([known, near])
        for k in range(len(pivots)):
            inside = home == k
            reach = near[:, k] <= far + 2 * self.radius  # x may link into cell k only so
            radius = near[inside & native, k].max(initial=-1.0)
            keep = inside | (reach & (near[:, k] <= radius + self.radius))
            self.opened += 1
            if keep.sum() > 0.8 * len(docs):
                self._leaf(docs[keep], (native & inside)[keep], known[keep])
            else:
                self._cell(docs[keep], (native & inside)[keep], known[keep], depth + 1)

    def _leaf(self, docs: np.ndarray, native: np.ndarray, known: np.ndarray) -> None:
        """Each native document with all that may link with it and is not connected with it yet."""
        size = self.size[docs]
        for x in np.flatnonzero(native):
            open_ = self.root[docs] != self.root[docs[x]]
            if not open_.any():
                continue
            open_ &= (100 * np.minimum(size, size[x]) >= self.percent * np.maximum(size, size[x]))
            if known.shape[1] and open_.any():
                at = np.flatnonzero(open_)
                open_[at] = (np.abs(known[at] - known[x]) <= self.radius).all(axis=1)
            if open_.any():
                self.compare(int(docs[x]), docs[open_])

    def compare(self, x: int, others: np.ndarray) -> None:
        """What is done with a native document and all that may link with it."""
        self.distances(x, others)


class LinkCount(RegionJoin):
    """The documents that each one is linked with, counted with their weights; no pair is passed over.

    Roots stay as they are; documents of one root are not counted for each other. Nor are two that meet in
    a cell of a lesser name than ``cell`` too (``hubs``: the cells of each), so a pair counts once.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, weight: np.ndarray, cell: int, hubs: list[list[int]]):
        super().__init__(sets, percent)
        self.weight, self.links = weight, np.zeros(len(sets), np.int64)
        self.before: list[list[int]] = [[h for h in some if h < cell] for some in hubs]
        self.has: dict[int, np.ndarray] = {}
        for x, some in enumerate(self.before):
            for h in some:
                self.has.setdefault(h, np.zeros(len(sets), dtype=bool))[x] = True

    def distances(self, x: int, others: np.ndarray) -> np.ndarray:
        both = self.shared(x, others)
        return 1 - both / (self.size[x] + self.size[others] - both)

    def compare(self, x: int, others: np.ndarray) -> None:
        for h in self.before[x]:
            others = others[~self.has[h][others]]
        if len(others):
            both = self.shared(x, others)
            linked = 100 * both >= self.percent * (self.size[x] + self.size[others] - both)
            self.links[x] += self.weight[others[linked]].sum()


def sets_of(texts: pa.Array | pa.ChunkedArray, n: int) -> list[np.ndarray]:
    """The set of each text."""
    data, offsets = text_buffers(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    out: list[np.ndarray] = []
    for i, j in slices(offsets):
        sets = Sets(Words(data, offsets, i, j), n)
        out += [sets.values[a : a + m] for a, m in zip(sets.start.tolist(), sets.size.tolist(), strict=True)]
    return out


def _links(table: pa.Table, n: int, percent: int) -> pa.Table:
    """The forest of a cell, or of a pair of chunks whose documents come with what they are known to be connected with."""
    keys = table.column("key").to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    order = [k for i, k in enumerate(order) if not i or keys[k] != keys[order[i - 1]]]
    join = RegionJoin(sets_of(table.column("text").take(pa.array(order)), n), percent)
    if "root" in table.column_names:
        roots, known = table.column("root").to_pylist(), {}
        for i, k in enumerate(order):
            join.root[i] = known.setdefault(roots[k], i)
    root = join.run()
    out = [(keys[order[i]], keys[order[r]]) for i, r in enumerate(root.tolist()) if i != r]
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


def _counts(table: pa.Table, n: int, percent: int) -> pa.Table:
    """key and links, the weights of what it is linked with in a cell, or between the two chunks of a pair."""
    keys = table.column("key").to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    order = [k for i, k in enumerate(order) if not i or keys[k] != keys[order[i - 1]]]
    taken = table.take(pa.array(order))
    join = LinkCount(sets_of(taken.column("text"), n), percent, taken.column("copies").to_numpy(), taken.column("region")[0].as_py(), taken.column("hubs").to_pylist())
    if "chunk" in table.column_names:
        sides = np.unique(taken.column("chunk").to_numpy(), return_inverse=True)[1]
        if sides.any():
            join.root = sides
    join.run()
    return pa.table({"key": taken.column("key").combine_chunks(), "links": pa.array(join.links)})


def _texts_of(docs: DataFrame, chosen, id_col: str, text_col: str, n: int) -> DataFrame:
    """k1, key and text of the documents that the filter ``chosen`` has, and few others.

    Texts and not sets go on: packed, they are a third of their shingles' hashes.
    """

    @tidy
    def run(batches):
        bits = chosen.value
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(has_bit(bits, _place_of(h))))
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                sets = Sets(Words(data, offsets, i, j), n)
                k1, k2 = sets.digests()
                rows = np.flatnonzero(has_bit(bits, _place_of(ids[i:j], k1)) & (sets.size > 0))
                if len(rows):
                    keys = [_key(a, b) for a, b in zip(k1[rows].tolist(), k2[rows].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(k1[rows]), pa.array(keys, pa.binary()), batch.column(1).take(pa.array(rows + i))], names=["k1", "key", "text"])

    return docs.select(F.xxhash64(id_col).alias("h"), text_col).where(F.col(id_col).isNotNull()).mapInArrow(run, "k1 long, key binary, text string")


def _key(k1: int, k2: int) -> bytes:
    return (k1 & (1 << 64) - 1).to_bytes(8, "big") + (k2 & (1 << 64) - 1).to_bytes(8, "big")


def _place_of(h: np.ndarray, k1: np.ndarray | None = None) -> np.ndarray:
    """The bit of an id's hash, or of it and a set."""
    both = h.view(np.uint64) if k1 is None else h.view(np.uint64) ^ mix(k1.view(np.uint64))
    return (both & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter(members: DataFrame) -> np.ndarray:
    """FILTER_BITS bits with those of all members (h, k1) set, and those of h alone; a fixed 8 MB."""

    @tidy
    def run(batches):
        for batch in batches:
            h, k1 = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_place_of(h), _place_of(h, k1)]))], names=["at"])

    return bit_filter(members.select("h", "k1").mapInArrow(run, "at long"), FILTER_BITS)


def _chunked(big: DataFrame, n: int, percent: int, limit: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells too large for one task: links with pivots, and what remains as pairs of chunks.

    big: region (the cell), m (documents of the cell), key, text, hubs. Every document is measured against
    up to 17 pivots of its cell, piece by piece of at most PIECE documents. Links with pivots give connected
    parts. A chunk holds documents of one nearest pivot and part; chunks of one part need no comparison,
    nor do those whose distances to some pivot lie further apart than a link can be. The rest is compared
    pair of chunks by pair of chunks. With ``every``, chunks of one part are compared too.
    """
    radius = 1 - percent / 100 + 1e-12
    pieces = F.ceil(F.col("m") / F.lit(PIECE)).cast("long")
    few = F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("key"), F.greatest((F.col("m") / 64).cast("long"), F.lit(1))) == 0, F.col("key")))), 1, 16)
    ranked = big.groupBy("region").agg(few.alias("few"), F.min("key").alias("least"), F.max("m").alias("m"))
    pivots = ranked.select("region", F.explode(F.array_union(F.array("least"), "few")).alias("key")).join(big, ["region", "key"])
    pivots = cut(pivots.select("region", "m", "key", "text"), "pivots").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    pieced = big.withColumn("piece", F.pmod(F.xxhash64("key"), pieces))

    def measure(table: pa.Table, near: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        near = near.sort_by("key")
        others, names = sets_of(near.column("text"), n), near.column("key").to_pylist()
        cells, far, linked = [], [], []
        for mine in sets_of(table.column("text"), n):
            d, hit = [], None
            for name, other in zip(names, others, strict=True):
                both = int(np.isin(mine, other, assume_unique=True).sum())
                union = len(mine) + len(other) - both
                d.append(1 - both / union)
                if hit is None and 100 * both >= percent * union:
                    hit = name
            cells.append(int(np.argmin(d)))
            far.append(d)
            linked.append(hit)
        columns = [table.column(c) for c in ("region", "key", "text")]
        return pa.table([*columns, pa.array(cells, pa.int32()), pa.array(far, pa.list_(pa.float64())), pa.array(linked, pa.binary())], names=["region", "key", "text", "cell", "d", "pivot"])

    empty = pa.table({"region": pa.array([], pa.int64()), "key": pa.array([], pa.binary()), "text": pa.array([], pa.string()), "cell": pa.array([], pa.int32()), "d": pa.array([], pa.list_(pa.float64())), "pivot": pa.array([], pa.binary())})
    measured = pieced.select("region", "piece", "key", "text").groupBy("region", "piece").cogroup(pivots.groupBy("region", "piece")).applyInArrow(measure, "region long, key binary, text string, cell int, d array<double>, pivot binary")
    measured = cut(measured, "measured")
    stars = measured.where("pivot is not null and pivot != key").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    parts = components(stars)
    placed = measured.join(parts.withColumnRenamed("node", "key"), "key", "left").select("region", "key", "text", "cell", "d", F.coalesce("component", "key").alias("root"))
    # documents of one large part stand together, the rest of a cell in mixed chunks
    sizes = placed.groupBy("region", "cell", "root").agg(F.count(F.lit(1)).alias("n"))
    placed = placed.join(sizes, ["region", "cell", "root"]).withColumn("group", F.when(F.col("n") * 4 >= limit, F.col("root")))
    groups = placed.groupBy("region", "cell", "group").agg(F.count(F.lit(1)).alias("m"))
    placed = placed.join(groups.select(F.col("region").alias("_r"), F.col("cell").alias("_c"), F.col("group").alias("_g"), "m"), (F.col("region") == F.col("_r")) & (F.col("cell") == F.col("_c")) & F.col("group").eqNullSafe(F.col("_g")))
    piece = F.pmod(F.xxhash64("key"), F.ceil(F.col("m") * 2 / F.lit(limit)).cast("long"))
    placed = placed.select("region", "key", "text", "d", "root", "group", F.xxhash64("region", "cell", "group", piece).alias("chunk"))
    placed = cut(placed, "placed")
    spread = placed.select("region", "chunk", "group", F.posexplode("d").alias("p", "x")).groupBy("region", "chunk", "group", "p").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    spread = cut(spread.groupBy("region", "chunk", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "low", "high"))), lambda s: F.struct(s["low"], s["high"])).alias("w")), "spread")
    left, right = spread.select("region", F.col("chunk").alias("ca"), F.col("group").alias("ga"), F.col("w").alias("wa")), spread.select("region", F.col("chunk").alias("cb"), F.col("group").alias("gb"), F.col("w").alias("wb"))
    apart = F.exists(F.zip_with("wa", "wb", lambda x, y: (x["low"] > y["high"] + radius) | (y["low"] > x["high"] + radius)), lambda t: t)
    connected = F.lit(False) if every else F.col("ga").isNotNull() & F.col("ga").eqNullSafe(F.col("gb"))
    open_ = left.join(right, "region").where((F.col("ca") <= F.col("cb")) & ~connected & ~apart).select(F.xxhash64("ca", "cb").alias("pair"), "ca", "cb")
    each = open_.select("pair", F.explode(F.array_distinct(F.array("ca", "cb"))).alias("chunk"))
    pairs = placed.select("region", "chunk", "key", "text", "root").join(each, "chunk").select("pair", "region", "key", "text", "root", "chunk")
    return stars, pairs.join(big.select("region", "key", "hubs"), ["region", "key"]) if every else pairs.select("pair", "key", "text", "root")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, region_limit: int = 1_000, region_tokens: int = 2_000_000, links: bool = False) -> DataFrame:
    """Documents linked by the Jaccard similarity of their sets of n-word shingles, and what they reach.

    Words are lower-cased (A-Z). A link is 100 * intersection >= percent * union. Returns id_col,
    n_shingles and component_id, the smallest id reachable by links. Pairs that are connected already are
    passed over, unless ``links`` asks for n_links too: the number of other rows that a row is linked
    with, rows with its own set among them. That measures every pair that may be linked, so the work
    grows with the square of a group of near copies. A document of fewer than n words has its whole sequence as its one shingle. Documents
    without words (null and empty texts too) have none and are linked with nothing, and so is a row
    with a null id (component_id null). Rows that share an id but not a text are nodes of their own.
    A cell of over ``region_limit`` sets or ``region_tokens`` shingles goes through ``_chunked``.
    """
    found = _groups(docs, id_col, text_col, n, percent, region_limit, region_tokens, links)
    alone = (F.col("n_shingles") == 0) | F.col("id").isNull()
    return found.select(F.col("id").alias(id_col), "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *([F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links")] if links else []))


def _groups(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, region_limit: int = 1_000, region_tokens: int = 2_000_000, count: bool = False) -> DataFrame:
    """Per row: id, n_shingles, k1, k2 (its set), and component with component_id, null for rows linked with nothing by rule; with ``count``, n_links."""
    spark = docs.sparkSession
    counters = spark.sparkContext.broadcast(frequencies(docs, text_col, n))
    sized = cut(signatures(docs, counters, id_col, text_col, n, percent), "signatures")
    counters.unpersist()
    nodes = cut(sized.where("size > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.max("size").alias("size")), "sets")
    members = nodes.select(F.xxhash64("least").alias("h"), "k1", "size").join(cells_of(sized, percent), "k1")
    members = cut(with_partners(members, percent) if percent < 100 else members, "members")
    chosen = spark.sparkContext.broadcast(_filter(members.select("h", "k1").distinct()))
    extent = members.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("t"))
    extent = extent.where("m > 1").withColumn("big", (F.col("m") > region_limit) | (F.col("t") > region_tokens))
    placed = members.select("k1", "hub").distinct().join(small(extent, "extent"), "hub")
    of = small(placed.groupBy("k1").agg(F.collect_list(F.struct(F.col("hub").alias("region"), "m", "big")).alias("in_cells")), "cells")
    texts = _texts_of(docs, chosen, id_col, text_col, n).join(of, "k1").select("key", "text", F.col("in_cells.region").alias("hubs"), F.inline("in_cells"))
    has_big = not placed.where("big").isEmpty()
    edge = "a binary, b binary"
    if has_big:
        texts = cut(texts, "candidates")
    key = F.concat(F.unhex(F.lpad(F.hex("k1"), 16, "0")), F.unhex(F.lpad(F.hex("k2"), 16, "0")))
    if count:
        copies = cut(sized.where("size > 0 and id is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).select(key.alias("key"), "copies"), "copies")
        tally = "key binary, links long"
        counted = texts.where("not big").select("region", "key", "text", "hubs").join(copies, "key").groupBy("region").applyInArrow(lambda t: _counts(t, n, percent), tally)
    links = texts.where("not big").select("region", "key", "text").groupBy("region").applyInArrow(lambda t: _links(t, n, percent), edge)
    if has_big:
        big = cut(texts.where("big").select("region", "m", "key", "text", "hubs").dropDuplicates(["region", "key"]), "big")
        pivot_links, pairs = _chunked(big, n, percent, region_limit, count)
        links = links.union(pivot_links.select("a", "b")).union(pairs.select("pair", "key", "text", "root").groupBy("pair").applyInArrow(lambda t: _links(t, n, percent), edge))
        if count:
            counted = counted.union(pairs.join(copies, "key").groupBy("pair").applyInArrow(lambda t: _counts(t, n, percent), tally))
    parts = components(links)
    linked = nodes.select(key.alias("node"), "least").join(parts, "node")
    least = small(linked.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    linked = linked.join(least, "component").select(F.col("node").alias("key"), "component", "component_id")
    known = nodes.select("k1", "k2", "least", key.alias("key")).join(linked, "key", "left")
    known = known.select("k1", "k2", "key", F.coalesce("component", "key").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    if count:
        sums = counted.groupBy("key").agg(F.sum("links").alias("links"))
        each = copies.join(sums, "key", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        known = known.join(each, "key")
    return sized.select("id", F.col("size").alias("n_shingles"), "k1", "k2").join(known.drop("key"), ["k1", "k2"], "left")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, less all but one document of each linked group.

    The one of the smallest id stays; of several rows with that id, one of those with the least set. A
    row without words or without an id stays. Rows that may go are found by a bit filter of fixed size,
    so the texts of the others are not shuffled.
    """
    rows = cut(_groups(docs, id_col, text_col, n, percent).where("id is not null and n_shingles > 0").select("id", "k1", "k2", "component"), "groups")
    chosen = rows.groupBy("component").agg(F.min(F.struct("id", "k1", "k2")).alias("c")).select("c.*", F.lit(1).alias("c"))
    marked = rows.join(chosen, ["id", "k1", "k2"], "left")
    counted = marked.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count("c").alias("staying"))
    touched = cut(counted.where("rows > 1 or staying = 0").select("id"), "touched")
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(touched.select(place(F.col("id")).alias("at")), FILTER_BITS))

    at = docs.columns.index(text_col)
    set1, set2, words, mark, o_id, o1, o2 = free_names(docs.columns, "set1", "set2", "words", "place", "other", "other1", "other2")
    names = [*docs.columns, set1, set2, words]

    def flagged(batch) -> np.ndarray:
        """Which rows may go; the last column has their places."""
        return has_bit(bits.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))

    @tidy
    def stay(batches):
        for batch in batches:
            yield batch.filter(pa.array(~flagged(batch))).select(docs_columns)

    @tidy
    def digest(batches):
        for batch in batches:
            batch = batch.filter(pa.array(flagged(batch)))
            data, offsets = text_buffers(batch.column(at))
            for i, j in slices(offsets):
                sets = Sets(Words(data, offsets, i, j), n)
                k1, k2 = sets.digests()
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-1], pa.array(k1), pa.array(k2), pa.array(sets.size.astype(np.int64))], names=names)

    docs_columns = list(range(len(docs.columns)))
    # rows without an id never go: their place is that of no row
    placed = docs.select("*", F.when(F.col(id_col).isNull(), F.lit(-1).cast("long")).otherwise(place(F.col(id_col))).alias(mark))
    known = placed.where(F.col(mark) >= 0)
    sure = known.mapInArrow(stay, docs.schema).union(placed.where(F.col(mark) < 0).select(*docs.columns))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in names[-3:])])
    rest = known.mapInArrow(digest, schema)
    staying = chosen.select(F.col("id").alias(o_id), F.col("k1").alias(o1), F.col("k2").alias(o2))
    same = (F.col(id_col) == F.col(o_id)) & (F.col(set1) == F.col(o1)) & (F.col(set2) == F.col(o2))
    empty = rest.where(F.col(words) == 0).select(*docs.columns)
    judged = rest.where(F.col(words) > 0).join(staying, same, "left_semi").dropDuplicates([id_col, set1, set2]).select(*docs.columns)
    return sure.union(empty).union(judged)
