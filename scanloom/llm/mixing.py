"""Mixing sources to target weights by Pareto order sampling, with built-in functions only.

Each source has a target in words. Its documents are wanted in unequal numbers of copies, in proportion to a weight that
grows with the square root of their size, and ``most`` at most:

    e = min(most, level * weight),   the level being such that the sum of e * size over the source is its target.

A document gets floor(e) certain whole copies, and with the inclusion probability p = e - floor(e) one more. For that,
documents are ranked by their random odds over their inclusion odds,

    q = (u / (1 - u)) / (p / (1 - p)),   u uniform, from a hash of the id and the text,

and the first ones are taken. The sample's size is fixed in words: the ranking is cut where the words taken come nearest
to the target, so a source misses it by half a document at most. Rows that repeat id and text have one rank, and the cut
may fall among them. The level comes from a source's counts of documents by size. The cut is found without sorting a
source: a histogram of q over BUCKETS bins gives the bin that holds it, and only that bin's ranks are ordered. What
remains for each document is a comparison with its source's cut, so documents themselves never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scanloom.llm.common import free_name, materialise

#: Bins of a source's ranking: the ranks ordered in one task are a source's documents divided by this.
BUCKETS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column) -> Column:
    """52 bits of a hexadecimal hash, strictly between 0 and 1; the same on every run and in every engine."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _measured(docs: DataFrame, seed: str, id_col: str, source_col: str, text_col: str) -> list[Column]:
    """doc_id, source, size and u of a document."""
    key = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), uniform(F.md5(key)).alias("u")]


def weight_of(size: Column) -> Column:
    """16 times the square root of a size, in whole numbers: sums of it are exact, whatever their order."""
    return F.floor(F.sqrt(size.cast("double")) * 16.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: ``share`` times all words, dealt by weight to sources in the order of code points
    (null last; the weights repeat). A target stops at ``most`` times its source's size, and the excess is dealt again
    by weight to the others until none is above. ``sizes`` has one row per source: source, source_size.

    The targets are level * weight, or the ceiling where that is lower. With sources in the order of ceiling / weight
    the first k are at their ceiling, and k is the least for which the level of the others stays below the next one.
    A source without words gets 0.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = ranked.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    table = (
        sizes.withColumn("weight", weight)
        .withColumn("ceiling", F.col("source_size") * float(most))
        .withColumn("ratio", F.col("ceiling") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("all", F.sum("source_size").over(whole) * float(share))
        .withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
        .withColumn("first", F.when(F.col("level") <= F.col("ratio"), F.row_number().over(ranked)))
        .withColumn("level", F.min_by("level", "first").over(whole))
    )
    target = F.least(F.col("ceiling"), F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling")))
    return table.select("source", "source_size", target.alias("target"))


def source_levels(counts: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``targets`` with ``level``, from ``counts`` of documents: source, size, n. Null if every document is wanted ``most``
    times.

    With sizes in falling order the first k are at ``most``, and k is the least for which the next size isn't.
    """
    goes = W.partitionBy("source").orderBy(F.col("size").desc())
    before, after = goes.rowsBetween(W.unboundedPreceding, -1), goes.rowsBetween(0, W.unboundedFollowing)
    words = F.col("size") * F.col("n")
    rows = (
        counts.join(targets.select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("weight", weight_of(F.col("size")))
        .withColumn("full", F.coalesce(F.sum(words).over(before), F.lit(0)) * float(most))
        .withColumn("open", F.sum(words * F.col("weight")).over(after))
        .withColumn("level", F.when(F.col("open") > 0, (F.col("target") - F.col("full")) / F.col("open")))
        .filter(F.col("level") * F.col("weight") <= float(most))
    )
    first = rows.groupBy("of").agg(F.max_by("level", "size").alias("level"))
    return targets.join(first, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def _ranked(docs: DataFrame, plan: DataFrame, most: float) -> DataFrame:
    """Adds whole, q and bucket to doc_id, source, size, u and what ``plan`` has of the source."""
    joined = docs.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    times = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.coalesce(F.col("level") * weight_of(F.col("size")), F.lit(float(most))))).otherwise(0.0)
    p = F.col("times") - F.col("whole")
    q = (F.col("u") / (1.0 - F.col("u"))) / (p / (1.0 - p))
    return (
        joined.withColumn("times", times)
        .withColumn("whole", F.floor("times"))
        .withColumn("q", F.when(p > 0, q))
        .withColumn("bucket", F.floor(F.col("q") / (1.0 + F.col("q")) * float(BUCKETS)))
    )


def mix_plan(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target, level, and the cut of its ranking: cut_bucket, cut_q, cut_id, and of
    the cut_rows rows of that rank cut_take are taken. Without a cut_q, but a cut_bucket, none are taken.

    ``sizes`` has doc_id, source, size and u. The result has as many rows as there are sources.
    """
    counts = materialise(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = materialise(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    targets = materialise(source_targets(totals, weights, share, most), "targets")
    plan = materialise(source_levels(counts, targets, most), "levels")
    ranked = _ranked(sizes, plan, most)
    certain = ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain")).withColumnRenamed("source", "certain_source")
    bins = ranked.filter("q is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    bins = bins.join(certain, F.col("source").eqNullSafe(F.col("certain_source")))
    bins = bins.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("bucket"))).withColumn("rest", F.col("target") - F.col("certain"))
    # the bin in which the words taken pass what is wanted
    cut = bins.filter("upto > rest and upto - words <= rest").select(F.col("source").alias("cut_source"), F.col("bucket").alias("cut_bucket"), (F.col("upto") - F.col("words")).alias("base"), "rest")
    cut = materialise(cut, "cuts")
    at = ranked.join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("bucket") == F.col("cut_bucket")))
    at = at.groupBy("cut_source", "q", _name().alias("id"), "size").agg(F.count(F.lit(1)).alias("rows"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    row = W.partitionBy("cut_source").orderBy("q", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    left = F.col("rest") - (F.col("base") + F.sum(F.col("size") * F.col("rows")).over(row) - F.col("size") * F.col("rows"))
    at = at.withColumn("left", left).withColumn("take", F.floor(F.col("left") / F.col("size")))
    at = at.withColumn("take", F.col("take") + F.when(F.col("left") - F.col("take") * F.col("size") > F.col("size") / 2, 1).otherwise(0))
    at = at.withColumn("take", F.least(F.greatest("take", F.lit(0)), "rows"))
    last = at.filter("take > 0").groupBy("cut_source").agg(F.max(F.struct("q", "id", "size", "take", "rows")).alias("last"))
    last = last.select(F.col("cut_source").alias("last_source"), F.col("last.q").alias("cut_q"), F.col("last.id").alias("cut_id"), F.col("last.take").alias("cut_take"), F.col("last.rows").alias("cut_rows"))
    cuts = cut.select("cut_source", "cut_bucket").join(last, F.col("cut_source").eqNullSafe(F.col("last_source")), "left").drop("last_source")
    return materialise(plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "plan")


def _name() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _copies(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds copies. Without a cut, all that have a rank are taken."""
    at = F.coalesce((F.col("q") == F.col("cut_q")) & (_name() == F.col("cut_id")), F.lit(False))
    below = F.coalesce((F.col("q") < F.col("cut_q")) | ((F.col("q") == F.col("cut_q")) & (_name() < F.col("cut_id"))), F.lit(False))
    inside = F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & below)
    extra = F.col("q").isNotNull() & (inside | (at & (F.col("cut_take") == F.col("cut_rows"))))
    copies = lambda more: (F.col("whole") + F.when(more, 1).otherwise(0)).cast("bigint")
    if plan.filter("cut_take < cut_rows").isEmpty():
        return ranked.withColumn("copies", copies(extra))
    # the cut falls among rows that repeat an id and a text: they are counted by the tasks that hold them
    tied = at & (F.col("cut_take") < F.col("cut_rows"))
    some = materialise(ranked.filter(tied).withColumn("task", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "tied")
    tasks = some.groupBy("source", "task").agg(F.count(F.lit(1)).alias("n"))
    tasks = tasks.select(F.col("source").alias("of"), F.col("task").alias("in"), (F.sum("n").over(W.partitionBy("source").orderBy("task")) - F.col("n")).alias("before"))
    some = some.withColumn("nth", F.row_number().over(W.partitionBy("source", "task").orderBy("row"))).join(tasks, F.col("source").eqNullSafe(F.col("of")) & (F.col("task") == F.col("in")))
    some = some.withColumn("copies", copies(F.col("before") + F.col("nth") <= F.col("cut_take")))
    rest = ranked.filter(~tied).withColumn("copies", copies(extra))
    return rest.unionByName(some.select(*rest.columns))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    size counts words; null texts and texts without words have size 0 and take nothing. A null source is a source of its
    own, the last. ``most`` is a whole number of copies. Rows that repeat an id, but not the text, are different documents.
    Of rows that repeat both, so many get the additional copy as the target asks for. An empty table gives an empty result.
    Other columns of ``docs`` are ignored.
    """
    sizes = materialise(docs.select(*_measured(docs, seed, id_col, source_col, text_col)), "sizes")
    plan = mix_plan(sizes, weights, share, most)
    return _copies(_ranked(sizes, plan, most), plan).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that the mix takes at least once, with all their columns and ``copies``, how often each is to be read.

    Documents don't shuffle: each is held against its source's cut. Null and empty texts are never taken; a null source is
    a source of its own; repeated rows are as for ``mix_sources``; an empty table gives an empty result. If ``docs`` has a
    column ``copies``, the new one has underscores before its name.
    """
    measured = _measured(docs, seed, id_col, source_col, text_col)
    plan = mix_plan(materialise(docs.select(*measured), "sizes"), weights, share, most)
    name, row = free_name(docs, "copies"), "document"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *measured)
    return _copies(_ranked(rows, plan, most), plan).filter("copies > 0").select(f"{row}.*", F.col("copies").alias(name))
