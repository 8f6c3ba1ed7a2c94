"""Mixing sources to target weights by entropy balancing.

Among all document rates w, the mix takes those closest in relative entropy to one copy of each document that meet
every source's token target. They are exponentially tilted, w = min(cap, exp(lambda_source * size / scale)); the
lambdas solve the convex dual, by Newton steps whose gradient and curvature are Spark aggregates over the (source,
size) histogram. Rates become whole copies by rounding the running sum of rates over sizes, and the last few words
to each target are made up by single copies, largest size first. Within a (source, size) class, copies go by the
order of a hash of the id.

Defined cases: null text has size 0; size 0 takes nothing; a null source is a source of its own, the last; repeated
rows count once each; an empty table gives an empty result; other columns are carried or ignored, never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, discard, staged, table

#: Rows of one (source, size) class that share a window when copies are dealt out.
CLASS_PART = 20_000


def source_targets(totals: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target from totals (source, source_size).

    Sources in code-point order, null last, weigh by `weights` in turn and share the sum of all sizes; a target
    stops at cap times its source's size and the excess goes to the others by weight until none is above. That is
    the water level at which sum(min(cap * size, level * weight)) is the total, found by running sums over the
    sources in the order in which they reach their caps. One row per source: the only windows without a key.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", cycle)
    ranked = ranked.withColumn("most", cap * F.col("source_size")).withColumn("reach", F.col("most") / F.col("weight"))
    order = W.orderBy("reach", "rank")
    ranked = ranked.withColumn("capped_before", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("weight_from", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    ranked = ranked.withColumn("total", F.sum("source_size").over(W.partitionBy()))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_from"))
    # levels fall short of the caps from some source on; that source's level is the water level
    level = F.min(F.when(F.col("reach") >= F.col("level"), F.struct("reach", "rank", "level"))).over(W.partitionBy())["level"]
    return ranked.withColumn("water", level).select("source", "source_size", F.coalesce(F.least("most", F.col("water") * F.col("weight")), "most").cast("double").alias("target"))


def solve_dual(classes: DataFrame, targets: DataFrame, cap: float, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """source, source_size, target, scale, lam: the dual's solution. classes: source, size, n (size > 0).

    Newton steps kept inside a bracket: where a step leaves it, the bracket is halved. Stops when the largest
    relative gap is below tolerance.
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    mean = classes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.max("size").alias("longest"), F.min("size").alias("shortest"))
    first = targets.join(mean.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # exp(lam * size / scale) is within cap for every size at lo..hi
    edge = F.lit(60.0) * F.col("scale") / F.col("shortest")
    dual = first.select("source", "source_size", "target", "scale", F.lit(0.0).alias("lam"), (-edge).alias("lo"), edge.alias("hi"), F.lit(1.0).alias("gap"))
    dual = staged(dual, "dual")
    for _ in range(steps):
        x = F.col("c.size") / F.col("d.scale")
        tilted = F.exp(F.least(F.col("d.lam") * x, F.lit(50.0)))
        rate = F.least(tilted, F.lit(cap))
        joined = classes.alias("c").join(dual.alias("d"), F.col("c.source").eqNullSafe(F.col("d.source")))
        mass = F.col("c.size") * F.col("c.n")
        sums = joined.groupBy(F.col("d.source").alias("s")).agg(F.sum(mass * rate).alias("got"), F.sum(F.when(tilted < cap, mass * x * tilted).otherwise(0.0)).alias("slope"))
        moved = dual.join(sums, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        over = F.col("got") > F.col("target")
        moved = moved.withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam")))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        step = F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        gap = F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        moved = moved.withColumn("lam", F.when(gap <= tolerance, F.col("lam")).otherwise(step)).withColumn("gap", gap)
        last, dual = dual, staged(moved.select("source", "source_size", "target", "scale", "lam", "lo", "hi", "gap"), "dual")
        discard(last)
        worst = dual.agg(F.max("gap")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return dual.select("source", "source_size", "target", "scale", "lam")


def round_rates(classes: DataFrame, dual: DataFrame, cap: float, rounds: int = 12) -> DataFrame:
    """source, size, n, copies (whole copies for the class), source_size, target.

    The running sum of n * rate in falling size is rounded; then `rounds` times, the gap to the target is filled,
    or an excess taken back, by single copies of the largest sizes that fit in it. Each round at least halves it.
    Windows are by source over distinct sizes, which the longest text bounds.
    """
    c = classes.alias("c").join(dual.alias("d"), F.col("c.source").eqNullSafe(F.col("d.source")))
    rate = F.least(F.exp(F.least(F.round(F.col("d.lam"), 9) * F.col("c.size") / F.col("d.scale"), F.lit(50.0))), F.lit(cap))
    c = c.select("c.source", "c.size", "c.n", "d.target", "d.source_size", F.round(rate * F.col("c.n"), 6).alias("want"))
    order = W.partitionBy("source").orderBy(F.col("size").desc())
    run = F.floor(F.sum("want").over(order.rowsBetween(W.unboundedPreceding, 0)) + 0.5)
    c = c.withColumn("run", run).withColumn("copies", F.col("run") - F.coalesce(F.lag("run").over(order), F.lit(0)))
    c = c.withColumn("copies", F.least(F.col("copies"), (cap * F.col("n")).cast("long")).cast("long")).drop("run", "want")
    everything = W.partitionBy("source")
    for _ in range(rounds):
        c = c.withColumn("gap", F.floor(F.col("target") + 0.5) - F.sum(F.col("copies") * F.col("size")).over(everything))
        room = F.when(F.col("size") > F.abs("gap"), 0).when(F.col("gap") > 0, (cap * F.col("n")).cast("long") - F.col("copies")).otherwise(F.col("copies"))
        c = c.withColumn("room", room)
        before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        c = c.withColumn("before", before)
        take = F.least(F.col("room"), F.greatest(F.lit(0), F.floor((F.abs("gap") - F.col("before")) / F.col("size")))).cast("long")
        c = c.withColumn("copies", (F.col("copies") + F.signum("gap").cast("int") * take).cast("long")).drop("gap", "room", "before")
    return c


def mix(docs: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # rows without an id are told apart by their texts, so that they do not meet in one task
    spot = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), spot.alias("spot"))
    rows = staged(rows, "mix-rows")
    classes = staged(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-classes")
    totals = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = staged(source_targets(totals, float(cap), weights), "mix-targets")
    full = classes.where("size > 0")
    dual = solve_dual(full, targets, float(cap))
    dealt = round_rates(full, dual, float(cap))

    # copies of a class over its rows: base each, and one more for as many as are left over, by hash order.
    # a large class is cut into parts by hash; each part gets its share of the rest by running counts
    dealt = staged(dealt.select("source", "size", "n", "copies"), "mix-dealt")
    spread = F.ceil(F.col("n") / CLASS_PART).cast("int")
    key = [F.col("r.source").eqNullSafe(F.col("k.source")), F.col("r.size") == F.col("k.size")]
    met = rows.alias("r").join(dealt.alias("k"), reduce(lambda a, b: a & b, key), "left")
    met = met.select("r.doc_id", "r.source", "r.size", "r.spot", F.coalesce("k.n", F.lit(1)).alias("n"), F.coalesce("k.copies", F.lit(0)).alias("all_copies"))
    met = met.withColumn("part", F.pmod("spot", spread).cast("int"))
    large = met.where(F.col("n") > CLASS_PART).groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("here"))
    upto = large.withColumn("upto", F.sum("here").over(W.partitionBy("source", "size").orderBy("part"))).select(F.col("source").alias("s2"), F.col("size").alias("z2"), F.col("part").alias("p2"), "upto", "here")
    met = met.join(upto, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("part") == F.col("p2")), "left").drop("s2", "z2", "p2")
    rest = F.col("all_copies") - F.floor(F.col("all_copies") / F.col("n")) * F.col("n")
    share = F.when(F.col("upto").isNull(), rest).otherwise(F.floor(rest * F.col("upto") / F.col("n")) - F.floor(rest * (F.col("upto") - F.col("here")) / F.col("n")))
    rank = F.row_number().over(W.partitionBy("source", "size", "part").orderBy("spot", "doc_id"))
    met = met.withColumn("copies", (F.floor(F.col("all_copies") / F.col("n")) + F.when(rank <= share, 1).otherwise(0)).cast("long"))
    met = met.select("doc_id", "source", "size", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    return met.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")


def take_copies(docs: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies; rows without a word stay once."""
    found = mix(docs, cap, weights)
    by_id = found.groupBy(F.col("doc_id").alias("_mix_id")).agg(F.max(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias("_mix_copies"))
    met = docs.join(by_id, docs["doc_id"].cast("long").eqNullSafe(by_id["_mix_id"]))
    return met.withColumn("_mix_copy", F.explode(F.expr("filter(sequence(0, int(_mix_copies)), x -> x > 0)"))).select(*[docs[c] for c in docs.columns])


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
