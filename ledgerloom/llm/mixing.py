"""Mixing sources to target weights: certain whole copies first, then Pareto order sampling (Rosén, 1997).

A document is expected to be taken level * weight times, at most `most`, where the source's level is such that the
expected words are the source's target. The whole part of that are certain copies. The fraction p is the probability of
one more: each document draws u from a hash of its id and is ranked by (u / (1-u)) / (p / (1-p)). The sample's size is
fixed in words: documents are taken in order of rank while they fit the words that are left, and one that doesn't fit is
passed over. What remains is less than any document that isn't taken; where the smallest of those misses the target by
less than the gap, it is taken too.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, staged

#: Bins of rank an octave. The densest holds a 6,000th or so of a source's documents.
BINS = 1024
#: Documents of a source that a round goes through one by one, unless one bin alone has more.
SPAN = 65_536
#: Weights count in steps of 1/STEPS, from one step to MOST_STEPS.
STEPS, MOST_STEPS = 16, 4096
FIRST, LAST = -(2**31), 2**31 - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_weight(size: Column) -> Column:
    """The number of binary digits of a document's words: inclusion grows with the logarithm of the length."""
    return F.length(F.bin(size)).cast("double")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with each of sums over the rows before, in this order. Ranges of the order are summed apart, so that no task
    has more than its range and a row a range."""
    dealt = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    parts = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(starts, F.col("_part") == F.col("_p"))
    return out.select(*rows.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in sums.items()])


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating; they share `share` times all sizes.
    A target stops at `most` times its source's size and the excess is shared again by weight until none is above. That
    fills the sources in order of size per weight: those up to the first whose cap is above the common level are full.
    Sums go by ranges of the order; the totals and the common level, a row each, are all that the driver sees.
    """
    by_name = [F.col("source").asc_nulls_last()]
    placed = running(sizes, by_name, {"place": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = staged(placed.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")).drop("place"), "mix-weights")
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    filled = running(ranked, [F.col("cap") / F.col("weight"), *by_name], {"caps": F.col("cap"), "weights": F.col("weight")})
    level = (F.lit(share) * F.lit(whole["size"]) - F.col("caps")) / (F.lit(whole["weight"]) - F.col("weights"))  # weights are positive
    leveled = staged(filled.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight")), "mix-levels")
    common = leveled.agg(F.max(F.when(~F.col("full"), F.col("level")))).first()[0]
    target = F.col("cap") if common is None else F.when(F.col("full"), F.col("cap")).otherwise(F.lit(common) * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number above 0 and below 1 from the id: 52 bits of an MD5 hash; a null id is hashed as an empty one."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def expectations(classes: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """(key, weight, source_size, target, sure, p) from the words of every (source, weight), and each source's target.

    The heaviest classes reach `most` first; the level of the others is the same water-filling as of targets, in windows
    over a source's classes, of which there are at most MOST_STEPS.
    """
    rows = classes.join(goals.withColumnRenamed("source", "key"), F.col("source").eqNullSafe(F.col("key")))
    heavier = Window.partitionBy("key").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    lighter = Window.partitionBy("key").orderBy(F.desc("weight")).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("target") - F.lit(most) * F.coalesce(F.sum("words").over(heavier), F.lit(0))) / F.nullif(F.sum(F.col("weight") * F.col("words")).over(lighter), F.lit(0.0))
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= most)
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy("key"))
    rows = rows.withColumn("common", common).withColumn("times", F.when(F.col("full") | F.col("common").isNull(), F.lit(most)).otherwise(F.col("common") * F.col("weight")))
    return rows.select("key", "weight", "words", "source_size", "target", F.floor("times").cast("long").alias("sure"), (F.col("times") - F.floor("times")).alias("p"))


@dataclass
class Sample:
    """goals: expectations; rules (key, rules): spans of bins that are taken whole, but for documents too large;
    picks: (key, rank, id, words, n, m): of m documents alike, n are taken."""

    goals: DataFrame
    rules: DataFrame
    picks: DataFrame
    seed: str


def ranked(rows: DataFrame, goals: DataFrame, seed: str) -> DataFrame:
    """rows (doc_id, source, size, weight and any others) with their goal, rank and bin, null without a fraction."""
    out = rows.join(goals.select("key", F.col("weight").alias("_w"), "source_size", "target", "sure", "p"), F.col("source").eqNullSafe(F.col("key")) & (F.col("weight") == F.col("_w")), "left").drop("key", "_w")
    u = draw(F.col("doc_id"), seed)
    rank = F.when((F.col("p") > 0) & (F.col("size") > 0), (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    return out.withColumn("rank", rank).withColumn("bin", F.floor(F.log2("rank") * BINS).cast("int"))


def one_by_one(table: pa.Table) -> pa.Table:
    """Documents of one source in order of rank, ids null last, alike ones together: how many of each fit."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["rank"], r["id"] is None, r["id"] or 0, r["words"]))
    names, left, out = ("key", "rank", "id", "words"), rows[0]["left"], []
    for r in rows:
        n = min(r["m"], left // r["words"])
        if n:
            left -= n * r["words"]
            out.append({k: r[k] for k in names} | {"n": n})
    return pa.Table.from_pylist(out, pa.schema([*map(table.schema.field, names), pa.field("n", pa.int64())]))


def sample(rows: DataFrame, goals: DataFrame, seed: str) -> Sample:
    """What is taken of rows (doc_id, source, size, weight).

    A round sums the words of every bin of rank, takes the bins that fit whole, and goes through the next documents one
    by one; then it goes on with the documents beyond that fit what is left. Since that is less than the first document
    passed over, a few rounds end it. Bins bound what one task sees, whatever share of the rows a source has.
    """
    docs = staged(ranked(rows, goals, seed).where("rank is not null").select(F.col("source").alias("key"), F.col("doc_id").alias("id"), F.col("size").alias("words"), "rank", "bin"), "mix-ranks")
    need = goals.groupBy("key").agg((F.round(F.first("target")) - F.sum(F.col("sure") * F.col("words"))).cast("long").alias("left"))
    state = staged(need.select("key", F.lit(FIRST).alias("after"), "left"), "mix-state")
    kind = dict(docs.dtypes)["key"]
    spark = docs.sparkSession
    rules, picks = [], []

    def beyond(of: DataFrame) -> DataFrame:
        return docs.join(of.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k"))).drop("_k").where((F.col("bin") > F.col("after")) & (F.col("words") <= F.col("left")))

    while True:
        bins = beyond(state.where("left > 0")).groupBy("key", "bin").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.first("left").alias("left"), F.first("after").alias("after"))
        upto = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("words").over(upto)).withColumn("whole", F.col("upto") <= F.col("left"))
        bins = bins.withColumn("seen", F.sum(F.when(~F.col("whole"), F.col("n"))).over(upto))
        near = ~F.col("whole") & ((F.col("seen") <= SPAN) | (F.col("seen") == F.col("n")))
        step = bins.groupBy("key").agg(F.first("after").alias("after"), F.first("left").alias("left"), F.max(F.when(F.col("whole"), F.col("bin"))).alias("whole"), F.coalesce(F.max(F.when(F.col("whole"), F.col("upto"))), F.lit(0)).alias("sum"), F.min(F.when(near, F.col("bin"))).alias("low"), F.max(F.when(near, F.col("bin"))).alias("high"))
        step = staged(step, "mix-step")
        if step.isEmpty():
            break
        rules.append(step.where("whole is not null").select("key", F.struct("after", F.col("whole").alias("upto"), "left").alias("rule")))
        some = beyond(step.select("key", "after", "left", "sum", "low", "high")).where("bin between low and high")
        some = some.groupBy("key", "rank", "id", "words", (F.col("left") - F.col("sum")).alias("left")).agg(F.count("*").alias("m"))
        taken = staged(some.groupBy("key").applyInArrow(one_by_one, f"key {kind}, rank double, id long, words long, n long"), "mix-picks")
        picks.append(taken)
        used = taken.groupBy("key").agg(F.sum(F.col("n") * F.col("words")).alias("used")).withColumnRenamed("key", "_k")
        done = step.select(F.col("key").alias("_s"), F.coalesce("high", F.lit(LAST)).alias("high"), "sum")
        moved = state.join(done, F.col("key").eqNullSafe(F.col("_s")), "left").join(used, F.col("key").eqNullSafe(F.col("_k")), "left")
        state = staged(moved.select("key", F.coalesce("high", F.lit(LAST)).alias("after"), (F.col("left") - F.coalesce("sum", F.lit(0)) - F.coalesce("used", F.lit(0))).alias("left")), "mix-state")

    def together(frames: list[DataFrame], schema: str) -> DataFrame:
        out = spark.createDataFrame([], schema)
        for x in frames:
            out = out.unionByName(x)
        return out

    by_key = together(rules, f"key {kind}, rule struct<after: int, upto: int, left: long>").groupBy("key").agg(F.collect_list("rule").alias("rules"))
    found = Sample(goals, staged(by_key, "mix-rules"), staged(with_counts(together(picks, f"key {kind}, rank double, id long, words long, n long"), docs), "mix-picks"), seed)
    # the smallest document that isn't taken, if it misses the gap by less than nothing would
    rest = flagged(docs, found).where("not ruled and coalesce(n < m, true)").join(state.where("left > 0").select(F.col("key").alias("_k"), "left"), F.col("key").eqNullSafe(F.col("_k")))
    least = rest.where("words < 2 * left").groupBy("key").agg(F.min(F.struct("words", "rank", F.col("id").isNull().alias("none"), "id")).alias("x"))
    last = staged(least.select("key", "x.rank", "x.id", "x.words", F.lit(1).cast("long").alias("n")), "mix-last")
    if not last.isEmpty():
        found.picks = staged(with_counts(found.picks.drop("m").unionByName(last), docs), "mix-picks")
    return found


def with_counts(picks: DataFrame, docs: DataFrame) -> DataFrame:
    """picks, summed, with m: how many documents are alike."""
    total = picks.groupBy("key", "rank", "id", "words").agg(F.sum("n").alias("n"))
    names = [F.col(c).alias(f"_{c}") for c in ("key", "rank", "id", "words")]
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("rank") == F.col("_rank")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("words") == F.col("_words"))
    return docs.select("key", "rank", "id", "words").join(total.select(*names, "n"), same).groupBy("key", "rank", "id", "words").agg(F.first("n").alias("n"), F.count("*").alias("m"))


def flagged(docs: DataFrame, found: Sample) -> DataFrame:
    """docs (key, id, words, rank, bin and any others) with ruled, n and m (null where not picked)."""
    out = docs.join(found.rules.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k")), "left").drop("_k")
    held = lambda r: (F.col("bin") > r["after"]) & (F.col("bin") <= r["upto"]) & (F.col("words") <= r["left"])
    out = out.withColumn("ruled", F.coalesce(F.exists("rules", held), F.lit(False))).drop("rules")
    picks = found.picks.select(*[F.col(c).alias(f"_{c}") for c in ("key", "rank", "id", "words")], "n", "m")
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("rank") == F.col("_rank")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("words") == F.col("_words"))
    return out.join(picks, same, "left").drop("_key", "_rank", "_id", "_words")


def copied(rows: DataFrame, found: Sample) -> DataFrame:
    """rows (doc_id, source, size, weight and any others) with source_size, target and copies.

    The sample's rules and picks are joined to the rows as they are scanned; the rows themselves stay where they are.
    Of documents alike some of which are taken (repeated ids), the first in the order of a written table are.
    """
    out = ranked(rows, found.goals, found.seed).withColumns({"key": F.col("source"), "id": F.col("doc_id"), "words": F.col("size")})
    out = flagged(out, found)
    split = found.picks.where("n < m")
    part = F.coalesce(F.col("n") < F.col("m"), F.lit(False))
    columns = [*rows.columns, F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target")]
    extra = lambda taken: F.when(F.col("words") > 0, F.col("sure") + F.when(taken, 1).otherwise(0)).otherwise(0).cast("long").alias("copies")
    if split.isEmpty():
        return out.select(*columns, extra(F.col("ruled") | F.col("n").isNotNull()))
    some = staged(out.where(part).withColumn("_row", F.monotonically_increasing_id()), "mix-alike").withColumn("_task", F.shiftright("_row", 33))
    alike = ["key", "rank", "id", "words"]
    counts = some.groupBy(*alike, "_task").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*alike).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in alike], F.col("_task").alias("_t"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*alike, "_task").orderBy("_row"))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("rank") == F.col("_rank")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("words") == F.col("_words")) & (F.col("_task") == F.col("_t"))
    some = some.withColumn("_place", place).join(counts, same)
    sure = out.where(~part).select(*columns, extra(F.col("ruled") | F.col("n").isNotNull()))
    return sure.unionByName(some.select(*columns, extra(F.col("_start") + F.col("_place") <= F.col("n"))))


def prepared(docs: DataFrame, doc_weight: str | Column | None) -> DataFrame:
    """docs with size (words) and weight, the latter in sixteenths."""
    rows = docs.withColumn("size", word_count(F.col("text").cast("string")))
    weight = F.lit(1.0) if doc_weight is None else F.coalesce((F.col(doc_weight) if isinstance(doc_weight, str) else doc_weight).cast("double"), F.lit(1.0))
    return rows.withColumn("weight", F.least(F.greatest(F.round(weight * STEPS), F.lit(1.0)), F.lit(float(MOST_STEPS))) / STEPS)


def planned(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: str) -> Sample:
    """The sample of rows (doc_id, source, size, weight)."""
    classes = staged(rows.groupBy("source", "weight").agg(F.sum("size").alias("words")), "mix-classes")
    by_source = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(by_source, weights, share, most)
    return sample(rows, staged(expectations(classes, goals, most), "mix-goals"), seed)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix-1:", doc_weight: str | Column | None = None) -> DataFrame:
    """Every row's doc_id, source, size (words), source_size, target, copies and taken (size times copies).

    A source's taken words fall short of its target by less than any document that remains, or exceed it by less than
    they would fall short. No document gets more than ceil(most) copies. doc_weight is a column of docs, or an
    expression that may use `size`, whose positive values make documents' inclusion unequal (null: 1; in sixteenths, 1/16
    to 256). Null and empty texts have no words and no copies; null sources are a source of their own. Repeated ids, and
    all null ids, draw alike, but are taken one by one, so that they meet the target as others do; reruns agree on how
    many of a source, id and size are taken. Other columns, whatever their names, are not read. An empty table gives an
    empty result.
    """
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", *([F.col(doc_weight).alias("_given")] if isinstance(doc_weight, str) else []))
    rows = staged(prepared(few, "_given" if isinstance(doc_weight, str) else doc_weight).select("doc_id", "source", "size", "weight"), "mix-sizes")
    out = copied(rows, planned(rows, weights, share, most, seed))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix-1:", doc_weight: Column | None = None) -> DataFrame:
    """docs, each row as often as mix() takes it. Texts aren't shuffled: the sample is planned on a table of sizes and
    joined to the rows where they are scanned. Null and repeated ids, and the rest, are as of mix()."""
    rows = prepared(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.struct(*docs.columns).alias("_all")), doc_weight)
    narrow = staged(rows.select("doc_id", "source", "size", "weight"), "mix-sizes")
    found = planned(narrow, weights, share, most, seed)
    taken = copied(rows.drop("text"), found).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_all.*")
