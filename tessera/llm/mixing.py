"""Mixing sources to target weights: repetition rates per source, whole copies and one Bernoulli copy.

A document's further copy has the probability of its rate's fraction, but draws are tied so that a
source's words come to its target. Documents of nearly one size are a stratum, of which those of the
least hashes get the copy, as many as the stratum is due. What a stratum, the largest sizes first, gets
too much or too little by rounding, all smaller documents make good by a lower or higher probability; as
much is made good either way, so the probability of each document stays what it was on the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import FEW, cut, free_names

#: Documents of a stratum that are ranked together; a larger stratum is cut by hash first.
RANKED = 1000
WORD = r"[^\x20\x09-\x0D]+"


def uniform(*parts: Column, seed: str) -> Column:
    """A double in [0, 1) that only seed and parts decide: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sized: DataFrame, weights: tuple[float, ...], total: float, cap: float) -> DataFrame:
    """source, source_size and target of each source, from (source, size).

    The sources by code point, null last, have the weights in turn and share ``total`` times all
    sizes; none gets more than ``cap`` times its own, and what that leaves over goes to the others by
    weight again. That fixed point is a level: target = min(cap * size, weight * level), found from
    the sources in order of cap * size / weight. The windows run over one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(rank) - 1) % len(weights)
    weighted = sums.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn.cast("int") + 1)).withColumn("_cap", cap * F.col("source_size"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    level = weighted.select(
        "*",
        F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_left"),
        F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    ).withColumn("_level", (total * F.col("_all") - F.coalesce("_before", F.lit(0.0))) / F.col("_left"))
    capped = F.col("_cap") <= F.col("_w") * F.col("_level")
    # the first source that stays below its cap has the level that holds for all after it
    first = F.first(F.when(~capped, F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return level.withColumn("_first", first).select("source", "source_size", F.coalesce(F.col("_w") * F.col("_first"), F.col("_cap")).alias("target"))


def stratum(size: Column) -> Column:
    """A number that grows with size: sizes up to 63 have their own, larger ones share it with those of the same six leading bits."""
    bits = F.length(F.bin(size))
    return bits * 64 + F.call_function("shiftright", size, F.greatest(bits - 6, F.lit(0))).cast("int")


def _least(sized: DataFrame, due: DataFrame, hint) -> DataFrame:
    """source, g, u_last: the hash of the last document of a stratum that gets a further copy. due: source, g, n, k.

    Hashes are uniform, so a stratum is cut by them into pieces of about RANKED documents; counts say in
    which piece the k-th hash is, and only that piece is ranked, equal hashes as one.
    """
    due = due.where("k > 0").select(F.col("source").alias("_s"), F.col("g").alias("_g"), "k", F.ceil(F.col("n") / F.lit(RANKED)).cast("long").alias("pieces"))
    of = F.col("source").eqNullSafe(F.col("_s")) & (F.col("g") == F.col("_g"))
    pieced = sized.join(hint(due), of).select("source", "g", "u", "k", F.floor(F.col("u") * F.col("pieces")).alias("piece"))
    counts = pieced.groupBy("source", "g", "k", "piece").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("source", "g").orderBy("piece"))
    edge = counts.withColumn("upto", upto).where("upto >= k and upto - c < k")
    edge = edge.select(F.col("source").alias("_s"), F.col("g").alias("_g"), F.col("piece").alias("_p"), (F.col("k") - F.col("upto") + F.col("c")).alias("rank"))
    near = pieced.join(hint(edge), of & (F.col("piece") == F.col("_p"))).groupBy("source", "g", "u", "rank").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("source", "g").orderBy("u"))
    return near.withColumn("upto", upto).where("upto >= rank and upto - c < rank").select("source", "g", F.col("u").alias("u_last"))


def _step(a: Column, x: Column) -> Column:
    """One stratum: share is the probability of all documents from here on, rem their words."""
    mean, rem = x["s"].cast("double") / x["n"].cast("double"), a["rem"] - x["s"]
    due = a["share"] * x["n"]
    part = due - F.floor(due)
    k = F.floor(due) + (x["r"] < part).cast("long")
    # how far the rest can make good both what rounding up and what rounding down does
    able = F.least(F.lit(1.0), a["share"] * rem / ((1 - part) * mean), (1 - a["share"]) * rem / (part * mean))
    share = F.when((part > 0) & (rem > 0), F.least(F.greatest(a["share"] - able * ((k - due) * mean / rem), F.lit(0.0)), F.lit(1.0))).otherwise(a["share"])
    return F.struct(share.alias("share"), rem.alias("rem"), F.concat(a["out"], F.array(F.struct(x["g"].alias("g"), x["n"].alias("n"), k.alias("k")))).alias("out"))


def _rates(sized: DataFrame, weights: tuple[float, ...], total: float, cap: float, seed: str):
    """source, g, source_size, target, whole (copies of every document) and u_last (null for none), a row for each stratum; and the hint for joins with it.

    sized: source, size, g, u. A hash of the stratum decides how the number of its copies is rounded.
    """
    goal = targets(sized, weights, total, cap).select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"))
    strata = sized.groupBy("source", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    strata = strata.withColumn("r", uniform(F.col("source"), F.col("g"), seed=seed))
    rows = strata.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("g", "n", "s", "r")), asc=False).alias("strata"))  # under 64 for each bit of a size
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("_s")))
    start = F.struct(F.col("part").alias("share"), F.col("source_size").alias("rem"), F.array().cast("array<struct<g:int,n:bigint,k:bigint>>").alias("out"))
    dealt = cut(rows.select("source", "source_size", "target", "whole", F.inline(F.aggregate("strata", start, _step)["out"])), "strata")
    hint = F.broadcast if dealt.count() <= FEW else lambda df: df
    last = _least(sized, dealt, hint).select(F.col("source").alias("_s"), F.col("g").alias("_g"), "u_last")
    return dealt.join(hint(last), F.col("source").eqNullSafe(F.col("_s")) & (F.col("g") == F.col("_g")), "left").select("source", "g", "source_size", "target", "whole", "u_last"), hint


def words(text_col: str) -> Column:
    """The number of words of a text, 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """id, source, size, g (stratum) and u (hash) of each row, written once."""
    measured = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"))
    return cut(measured.select("*", stratum(F.col("size")).alias("g"), uniform(F.col("id"), F.col("source"), F.col("size"), seed=seed).alias("u")), "sizes")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document.

    Returns id_col, source, size (words), source_size, target and copies. A source's rate is
    target / source_size; a document goes in floor(rate) times, and once more with a probability of
    the rest, by a hash of seed, id, source and size, so reruns agree. The draws of a source are tied
    (see above): each has its own probability, and the words of a source miss its target by about what one
    of its smallest documents has, unless one document is as large as many of the others together. A null text has size 0; null is a source of its own; a
    source without words has target 0 and rate 0. Repeated rows are decided alike. An empty table gives
    no rows. If id_col is one of the other names, those get an underscore.
    """
    sized = _measured(docs, id_col, text_col, source_col, seed)
    goal, hint = _rates(sized, weights, total, cap, seed)
    joined = sized.join(hint(goal.withColumnsRenamed({"source": "_s", "g": "_g"})), F.col("source").eqNullSafe(F.col("_s")) & (F.col("g") == F.col("_g")))
    names = free_names([id_col], "source", "size", "source_size", "target", "copies")
    columns = ["source", "size", "source_size", "target", _copies(F.col("whole"), F.col("u"), F.col("u_last"))]
    return joined.select(F.col("id").alias(id_col), *((F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(columns, names, strict=True)))


def _copies(whole: Column, u: Column, u_last: Column) -> Column:
    return whole + F.coalesce((u <= u_last).cast("long"), F.lit(0).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs as often as ``plan`` says, with all its columns and no others, whatever their names.

    Nulls, ties, repeated rows and an empty table are as in ``plan``.
    """
    sized = _measured(docs, id_col, text_col, source_col, seed)
    size, g, u, copy, of, at, whole, last = free_names(docs.columns, "mix_size", "mix_g", "mix_u", "mix_copy", "mix_source", "mix_at", "mix_whole", "mix_last")
    goal, hint = _rates(sized, weights, total, cap, seed)
    goal = goal.select(F.col("source").alias(of), F.col("g").alias(at), F.col("whole").alias(whole), F.col("u_last").alias(last))
    with_size = docs.withColumn(size, words(text_col))
    keyed = with_size.withColumns({g: stratum(F.col(size)), u: uniform(F.col(id_col), F.col(source_col), F.col(size), seed=seed)})
    dealt = keyed.join(hint(goal), F.col(source_col).eqNullSafe(F.col(of)) & (F.col(g) == F.col(at)))
    return dealt.withColumn(copy, F.explode(F.array_repeat(F.lit(1), _copies(F.col(whole), F.col(u), F.col(last)).cast("int")))).select(*docs.columns)
