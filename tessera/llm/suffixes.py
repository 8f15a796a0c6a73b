"""Suffix-array dedup: bytes that a string of ``length`` bytes covers which also starts elsewhere.

Two equal strings of 200 bytes have the same least K-gram (by hash, leftmost of equals), at the same
offset: their anchor. So each text is cut into runs of string starts with one anchor, about one run for
70 bytes, and only runs whose anchor's K-gram stands at two places or more can hold repeats.

1. ``anchors``: K-gram hashes by prefix polynomial hashes, sliding minima by doubling.
2. Anchors at two places or more are found by an aggregation; a bit filter of fixed size keeps them.
3. What stands round such an anchor goes to the task of its K-gram, where the suffixes that start in its
   run are sorted: a mergesort whose comparisons take the common extension of two suffixes by binary
   search over prefix hashes. Neighbours that agree over 200 bytes are checked byte by byte.
4. An anchor at over HOT places is split first: equal contexts become one, and what stays too large is cut
   by longer grams, until each group is small enough for the same sort (``_hot_repeats``).
5. Repeated starts become spans of their text. Texts are judged once, however many copies there are; a
   text with a copy goes as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bit_filter, cut, has_bit, small, tidy
from tessera.llm.textkit import mix, powers, prefix_hashes, slices, span_hash, text_buffers

_BASE = 0x9E3779B97F4A7C15 | 1
K = 64
ANCHOR_BITS = 1 << 27
TEXT_BITS = 1 << 26
HOT_BITS = 1 << 24
#: Places of one anchor that go to one task as they are; an anchor at more is split by longer grams before.
HOT = 1_000
PIECE = 4_000
#: Ranges of distances into which a group that is too large is split.
PARTS = 2
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For each run of string starts with one anchor: row, first and last start, anchor's place and hash."""
    none = np.zeros(0, np.int64)
    w, n = length - k + 1, len(data) - k + 1
    rows = np.flatnonzero(np.diff(offsets) >= length)
    if not len(rows):
        return none, none, none, none, np.zeros(0, np.uint64)
    prefix = prefix_hashes(data)
    at = np.arange(n)
    grams = span_hash(prefix, at, at + k)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    least = (grams & ~mask) | at.astype(np.uint64)
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    count = offsets[rows + 1] - length + 1 - offsets[rows]
    row = np.repeat(rows, count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - offsets[rows], count)
    owner = (least[start] & mask).astype(np.int64)
    new = np.append(True, (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[first], start[first], start[last], owner[first], grams[owner[first]]


class Suffixes:
    """Suffixes of one buffer, compared over ``limit`` bytes by hashes of their prefixes."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data, self.limit = data, limit
        self.prefix = prefix_hashes(data)
        self.power = powers(_BASE, len(data))
        self.steps = [1 << b for b in range(limit.bit_length() - 1, -1, -1)]

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n bytes from i and from j have one hash."""
        return (self.prefix[i + n] - self.prefix[i]) * self.power[j] == (self.prefix[j + n] - self.prefix[j]) * self.power[i]

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from i and j agree, at most ``most``: binary search."""
        out = np.zeros(len(i), dtype=np.int64)
        for step in self.steps:
            trial = out + step
            ok = trial <= most
            at = np.flatnonzero(ok)
            hit = at[self.same(i[at], j[at], trial[at])]
            out[hit] = trial[hit]
        return out

    def extension_back(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes before i and j agree, at most ``most``."""
        out = np.zeros(len(i), dtype=np.int64)
        for step in self.steps:
            trial = out + step
            at = np.flatnonzero(trial <= most)
            n = trial[at]
            hit = at[self.same(i[at] - n, j[at] - n, n)]
            out[hit] = trial[hit]
        return out

    def before(self, i: np.ndarray, j: np.ndarray, equal: bool) -> np.ndarray:
        """Whether the suffix at i comes before that at j; ``equal`` for two that agree over the limit."""
        limit = np.full(len(i), self.limit)
        n = self.extension(i, j, limit)
        same = n == self.limit
        at = np.minimum(n, self.limit - 1)
        return np.where(same, equal, self.data[i + at] < self.data[j + at])

    def sort(self, start: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes of each segment (segments stand together); all runs of a width merge at once."""
        n = len(start)
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        base, many = np.repeat(first, size), np.repeat(size, size)
        order, width = np.arange(n), 1
        while n and width < size.max():
            at = np.flatnonzero(many > width)
            local = at - base[at]
            run = local // width
            block = base[at] + (run // 2) * 2 * width
            left = run % 2 == 0
            other = np.where(left, block + width, block)
            end = np.minimum(other + width, base[at] + many[at])
            low, high = np.zeros(len(at), np.int64), np.maximum(end - other, 0)
            mine = start[order[at]]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                theirs = start[order[other[open_] + middle]]
                # a left item goes before its equals on the right, a right one after those on the left
                is_left = left[open_]
                less = np.empty(len(open_), dtype=bool)
                less[is_left] = self.before(theirs[is_left], mine[open_][is_left], False)
                less[~is_left] = self.before(theirs[~is_left], mine[open_][~is_left], True)
                low[open_[less]] = middle[less] + 1
                high[open_[~less]] = middle[~less]
                open_ = open_[low[open_] < high[open_]]
            merged = order.copy()
            merged[block + local % width + low] = order[at]
            order, width = merged, 2 * width
        return order

    def equal_bytes(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n bytes from i and from j are the same, byte by byte."""
        ends = np.cumsum(n)
        offset = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)
        differ = self.data[np.repeat(i, n) + offset] != self.data[np.repeat(j, n) + offset]
        total = np.concatenate([[0], np.cumsum(differ)])
        return total[ends] == total[ends - n]


def repeated_starts(group: np.ndarray, context: list[bytes], before: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For contexts sorted by group: the ranges of offsets at which strings start that the group has twice.

    ``before`` is the place of the anchor in each context. Contexts of one group are at different places.
    Equal contexts are repeats of each other as a whole; one of them stands for all against the others.
    """
    first: dict[tuple[int, int, bytes], int] = {}
    same = [first.setdefault(x, k) for k, x in enumerate(zip(group.tolist(), before.tolist(), context, strict=True))]
    twice = np.bincount(same, minlength=len(context)) > 1
    kept = np.array(list(first.values()), dtype=np.int64)
    found = dict(zip(kept.tolist(), _starts(group[kept], [context[k] for k in kept], before[kept], length), strict=True))
    return [[(0, len(context[k]) - length)] if twice[r] else found[k] for k, r in enumerate(same)]


def _starts(group: np.ndarray, context: list[bytes], before: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """The same for contexts that are all different within a group."""
    size = np.fromiter(map(len, context), dtype=np.int64, count=len(context))
    at = np.cumsum(size) - size
    suffixes = Suffixes(np.frombuffer(b"".join(context), dtype=np.uint8), length)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    many = np.diff(np.append(first, len(group)))
    out: list[list[tuple[int, int]]] = [[] for _ in context]
    # two contexts: their common extension both ways says all
    i = first[many == 2]
    j = i + 1
    p, q = at[i] + before[i], at[j] + before[j]
    back = suffixes.extension_back(p, q, np.minimum(before[i], before[j]))
    ahead = suffixes.extension(p, q, np.minimum(np.minimum(size[i] - before[i], size[j] - before[j]), length))
    hit = np.flatnonzero(back + ahead >= length)
    sure = suffixes.equal_bytes(p[hit] - back[hit], q[hit] - back[hit], back[hit] + ahead[hit])
    for h, ok in zip(hit.tolist(), sure.tolist(), strict=True):
        if not ok:  # a collision: extend byte by byte
            a, b = context[i[h]], context[j[h]]
            x, y, l_, r_ = int(before[i[h]]), int(before[j[h]]), 0, 0
            while l_ < min(x, y) and a[x - l_ - 1] == b[y - l_ - 1]:
                l_ += 1
            while r_ < min(len(a) - x, len(b) - y, length) and a[x + r_] == b[y + r_]:
                r_ += 1
            if l_ + r_ < length:
                continue
        else:
            l_, r_ = int(back[h]), int(ahead[h])
        for c in (i[h], j[h]):
            out[c].append((int(before[c]) - l_, int(before[c]) - (length - r_)))
    # more: sort the suffixes at each distance from the anchor
    rest = np.repeat(many > 2, many)
    index = np.flatnonzero(rest)
    if len(index):
        starts = size[index] - length + 1
        which = np.repeat(index, starts)
        offset = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        number = np.repeat(np.arange(len(first)), many)[which]
        distance = before[which] - offset
        order = np.lexsort((which, distance, number))
        which, offset = which[order], offset[order]
        segment = number[order] * (2 * length + 2) + distance[order]
        place = at[which] + offset
        ranked = suffixes.sort(place, segment)
        x, y = ranked[:-1], ranked[1:]
        pair = np.flatnonzero(segment[x] == segment[y])
        x, y = x[pair], y[pair]
        agree = suffixes.same(place[x], place[y], np.full(len(x), length))
        x, y = x[agree], y[agree]
        x, y = np.minimum(x, y), np.maximum(x, y)
        # neighbours that agree, in runs of one pair of contexts: checked byte by byte
        by_pair = np.lexsort((offset[x], which[y], which[x]))
        x, y = x[by_pair], y[by_pair]
        if len(x):
            new = np.append(True, (which[x[1:]] != which[x[:-1]]) | (which[y[1:]] != which[y[:-1]]) | (offset[x[1:]] != offset[x[:-1]] + 1))
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(x)) - 1
            n = offset[x[end]] - offset[x[begin]] + length
            sure = suffixes.equal_bytes(place[x[begin]], place[y[begin]], n)
            repeated = np.zeros(len(which), dtype=bool)
            run = np.cumsum(new) - 1
            good = sure[run]
            for k in np.flatnonzero(~good).tolist():  # a collision in the run: string by string
                a, b = int(place[x[k]]), int(place[y[k]])
                good[k] = bool((suffixes.data[a : a + length] == suffixes.data[b : b + length]).all())
            repeated[x[good]] = True
            repeated[y[good]] = True
            found = np.flatnonzero(repeated)
            found = found[np.lexsort((offset[found], which[found]))]
            c, o = which[found], offset[found]
            new = np.append(True, (c[1:] != c[:-1]) | (o[1:] != o[:-1] + 1))[: len(c)]
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(c))[: len(begin)] - 1
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                out[c[b]].append((int(o[b]), int(o[e])))
    return out


def _place(key: pa.Array) -> np.ndarray:
    """128-bit keys as pairs of 64-bit numbers."""
    return np.frombuffer(b"".join(key.to_pylist()), dtype="<u8").reshape(-1, 2)


def _runs(batches, length: int, k: int):
    """Slice by slice: keys and bytes of the texts in column 1, and runs; a text that the task has had is passed over."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for r, key in enumerate(batch.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                fresh.append(r)
        if len(seen) > 1_000_000:
            seen.clear()
        batch = batch.take(pa.array(fresh, pa.int64())) if len(fresh) < batch.num_rows else batch
        data, offsets = text_buffers(batch.column(1))
        keys = _place(batch.column(0))
        for i, j in slices(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            row, low, high, anchor, gram = anchors(part, at, length, k)
            if len(row):
                where = mix(keys[i + row, 0] ^ mix(keys[i + row, 1] ^ (anchor - at[row]).astype(np.uint64)))
                yield batch.column(0).slice(i, j - i), part, at, row, low, high, anchor, gram, where


def _shared(texts: DataFrame, length: int, k: int) -> DataFrame:
    """gram, n: the anchors at two places or more; copies of a text are one place."""

    @tidy
    def run(batches):
        for _, _, _, _, _, _, _, gram, where in _runs(batches, length, k):
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(where.view(np.int64))], names=["gram", "at"])

    found = texts.select("key", "text").mapInArrow(run, "gram long, at long")
    return found.groupBy("gram").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("gram", "n")


def _contexts(texts: DataFrame, chosen, hot, length: int, k: int, of_hot: bool) -> DataFrame:
    """What stands round each anchor that the filter ``chosen`` has, of those that ``hot`` has or of the others."""

    @tidy
    def run(batches):
        for key, part, at, row, low, high, anchor, gram, _ in _runs(batches, length, k):
            use = has_bit(chosen.value, (gram & np.uint64(ANCHOR_BITS - 1)).astype(np.int64))
            use &= has_bit(hot.value, (gram & np.uint64(HOT_BITS - 1)).astype(np.int64)) == of_hot
            rows = np.flatnonzero(use)
            if not len(rows):
                continue
            raw = part.tobytes()
            context = [raw[a : b + length] for a, b in zip(low[rows].tolist(), high[rows].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[rows].view(np.int64)), key.take(pa.array(row[rows])), pa.array(low[rows] - at[row[rows]]), pa.array((anchor - low)[rows].astype(np.int32)), pa.array(context, pa.binary())],
                names=["gram", "key", "low", "before", "context"],
            )

    return texts.select("key", "text").mapInArrow(run, "gram long, key binary, low long, before int, context binary")


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """key, first, last: ranges of string starts that repeat. Each partition comes in order of gram."""

    def solve(tables: list[pa.Table]):
        table = pa.concat_tables(tables).combine_chunks()
        gram = table.column("gram").to_numpy()
        key, low = table.column("key").to_pylist(), table.column("low").to_pylist()
        # one row for each place: copies of a text from several tasks say the same
        order = sorted(range(len(key)), key=lambda r: (gram[r], key[r], low[r]))
        order = np.array([r for n, r in enumerate(order) if not n or (gram[r], key[r], low[r]) != (gram[order[n - 1]], key[order[n - 1]], low[order[n - 1]])])
        _, inverse, counts = np.unique(gram[order], return_inverse=True, return_counts=True)
        order = order[counts[inverse] > 1]
        if not len(order):
            return None
        context = table.column("context").take(pa.array(order)).to_pylist()
        before = table.column("before").to_numpy()[order].astype(np.int64)
        found = repeated_starts(gram[order], context, before, length)
        rows = [(key[r], low[r] + a, low[r] + b) for r, spans in zip(order.tolist(), found, strict=True) for a, b in spans]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.int64())], names=["key", "first", "last"])

    @tidy
    def run(batches):
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            # all but the last group are complete
            cut_at = int(np.searchsorted(gram, gram[-1], side="left")) if rows + batch.num_rows >= PIECE else 0
            if cut_at or (held and rows >= PIECE and held[-1].column("gram")[-1].as_py() != gram[0]):
                head, batch = batch.slice(0, cut_at), batch.slice(cut_at)
                if (out := solve([*held, pa.Table.from_batches([head])])) is not None:
                    yield out
                held, rows = [], 0
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if held and (out := solve(held)) is not None:
            yield out

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "key binary, first long, last long")


def _hot_repeats(contexts: DataFrame, length: int, k: int, limit: int) -> DataFrame:
    """key, first, last as ``_repeats``, for anchors at too many places for one task.

    Equal contexts of a group are one row, whose strings all repeat if it stands for two or more. A group
    that still has over ``limit`` rows is split: the distances of strings from the anchor are cut into PARTS
    ranges, and equal strings of a range share the bytes that all strings of it cover; so a group is made
    for each range and those bytes, and each context goes on with what the range's strings cover. With one
    distance left, rows are strings, and equal ones are one row. Groups of ``limit`` rows and fewer are
    sorted. What is found goes back by the digest of a row to those that it stands for.
    """
    digest = F.unhex(F.sha2(F.concat_ws(":", "grp", "before", F.hex("context")), 256))
    places = cut(contexts.select(F.col("gram").alias("grp"), "key", "low", "before", "context").withColumn("cid", digest), "hot")
    rows = places.select("grp", "before", "context", F.lit(1).cast("long").alias("n"), F.lit(0).alias("a"), F.lit(length - k).alias("b"))
    found: list[DataFrame] = []
    ups: list[DataFrame] = []
    while True:
        one = cut(rows.groupBy("grp", "a", "b", "before", "context").agg(F.sum("n").alias("n")).withColumn("cid", digest), "one")
        sizes = one.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("b") - F.col("a")).alias("wide")).where("m > 1 and wide > 0")
        sizes = small(sizes.select("grp", (F.col("m") > limit).alias("large")), "sizes")
        whole = one.where("n > 1").select("cid", F.lit(0).cast("long").alias("first"), (F.octet_length("context") - length).cast("long").alias("last"))
        sized = one.join(sizes, "grp")
        sorted_ = sized.where("not large").select(F.col("grp").alias("gram"), F.col("cid").alias("key"), F.lit(0).cast("long").alias("low"), "before", "context")
        found.append(cut(whole.union(_repeats(sorted_, length).select(F.col("key").alias("cid"), "first", "last")), "found"))
        if sizes.where("large").isEmpty():
            break
        step = f"cast((b - a + {PARTS}) div {PARTS} as int)"
        part = F.explode(F.expr(f"transform(sequence(a, b, {step}), x -> struct(x as a, least(x + {step} - 1, b) as b))"))
        cut_up = sized.where("large").select("grp", "before", "context", "n", F.col("cid").alias("up"), part.alias("h"))
        # distances of the row's strings that lie in the part
        cut_up = cut_up.withColumn("low", F.greatest("h.a", F.col("before") - (F.octet_length("context") - length))).withColumn("high", F.least("h.b", "before")).where("low <= high")
        cut_up = cut_up.select(
            F.xxhash64("grp", "h.a", "h.b", F.expr(f"substring(context, before - h.a + 1, {length} - h.b + h.a)")).alias("grp"),
            F.col("h.a").alias("a"),
            F.col("h.b").alias("b"),
            F.expr(f"substring(context, before - high + 1, high - low + {length})").alias("context"),
            (F.col("before") - F.col("high")).cast("long").alias("shift"),
            F.col("high").cast("int").alias("before"),
            "n",
            "up",
        )
        rows = cut(cut_up.withColumn("cid", digest), "parts")
        ups.append(rows.select("cid", "up", "shift"))
    out = found.pop()
    while found:
        above = ups.pop().join(small(out.distinct(), "found"), "cid")
        out = found.pop().union(above.select(F.col("up").alias("cid"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last")))
    of = places.select("cid", "key", "low").join(small(out.distinct(), "found"), "cid")
    return of.select("key", (F.col("low") + F.col("first")).alias("first"), (F.col("low") + F.col("last")).alias("last"))


def _cover(ranges: list, length: int, size: int) -> list[tuple[int, int]]:
    """The union of [first, last + length) as maximal runs."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, min(b, size)) for a, b in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, k: int = K, hot: int = HOT, spans: bool = False) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; strings do not cross texts and are judged on the input, overlaps count, and
    "elsewhere" may be in the same text. Returns id_col, n_bytes, n_removed, n_spans (maximal removed
    runs) and kept_sha256, and with ``spans`` the runs themselves. A null text counts as empty (nothing
    removed, the hash of nothing). Null ids and repeated rows stay, a row each; a repeated text of
    ``length`` bytes or more is removed as a whole from every row. Other columns are not carried.
    """
    if not 0 < k < length:
        raise ValueError("k must be less than length")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    sized = cut(texts.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    copied = cut(sized.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "copied")
    long = texts.where(F.octet_length("text") >= length)
    shared = cut(_shared(long, length, k), "shared")
    many = spark.sparkContext.broadcast(bit_filter(shared.where(F.col("n") > hot).select(F.expr(f"gram & {HOT_BITS - 1}L").alias("at")), HOT_BITS))
    chosen = spark.sparkContext.broadcast(bit_filter(shared.select(F.expr(f"gram & {ANCHOR_BITS - 1}L").alias("at")), ANCHOR_BITS))
    ranges = _repeats(_contexts(long, chosen, many, length, k, False), length)
    if many.value.any():
        ranges = ranges.union(_hot_repeats(_contexts(long, chosen, many, length, k, True), length, k, hot))
    ranges = ranges.join(copied, "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = cut(ranges, "ranges")

    @tidy
    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((_place(batch.column(0))[:, 0] & np.uint64(TEXT_BITS - 1)).astype(np.int64))], names=["at"])

    touched = spark.sparkContext.broadcast(bit_filter(ranges.select("key").mapInArrow(places, "at long"), TEXT_BITS))

    @tidy
    def only(batches):
        for batch in batches:
            yield batch.filter(pa.array(has_bit(touched.value, (_place(batch.column(0))[:, 0] & np.uint64(TEXT_BITS - 1)).astype(np.int64))))

    @tidy
    def remove(batches):
        for batch in batches:
            rows = []
            for raw, found in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                raw = raw.as_py()
                runs = _cover([(x["first"], x["last"]) for x in found.as_py()], length, len(raw))
                kept, end = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(raw[end:a])
                    end = b
                kept.update(raw[end:])
                rows.append((sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "end": b} for a, b in runs]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["key", "removed", "runs", "kept", "spans"],
            )

    affected = long.select("key", "text").mapInArrow(only, "key binary, text string").join(ranges, "key").select("key", "text", "ranges")
    done = affected.mapInArrow(remove, "key binary, removed long, runs long, kept string, spans array<struct<start:long,end:long>>")
    whole = F.col("whole").isNotNull()
    out = sized.join(copied.withColumn("whole", F.lit(True)), "key", "left").join(done, "key", "left")
    columns = [
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    ]
    if spans:
        one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        columns.append(F.when(whole, one).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"))
    return out.select(*columns)
