"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the rest."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.staging import col, spare, stage
from lamina.operators.joins import fits_broadcast

#: Slots that each pass divides the order of one source's documents into; what leaves the tasks is at most
#: this many rows a source and pass.
SLOTS = 1 << 12
#: Passes after which slots are as narrow as a double tells apart.
DEEPEST = 4
#: Documents of one source that may be put in order in one task.
TASK_ROWS = 50_000
#: Copies of the table of sources that rows of a hot source are dealt over, where it is too large to broadcast.
SALTS = 64
#: Bits of the random number of a document.
RANDOM_BITS = 52


def words_in(text: Column) -> Column:
    """Number of words, runs of anything but ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_number(doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1 that depends on a document's id and text alone, so reruns agree."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, RANDOM_BITS // 4), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << RANDOM_BITS))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``number``, from 0 in code-point order of ``source``, null last.

    Sorted in ranges; only the size of each range is brought together.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranges = stage(sources.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "source-ranges")
    sizes = ranges.groupBy("part_").agg(F.count("*").alias("n_"))  # one row per range
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    return ranges.join(F.broadcast(before), "part_").withColumn("number", F.col("before_") + within).drop("part_", "before_")


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    All sizes together are shared out by weight, weights repeating along the sources in order.  A source gets
    at most ``most`` times its size; what others cannot take is shared again by weight until none
    is above.  The driver holds three sums.
    """
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = numbered(sources).withColumn("weight", F.get(cycle, F.pmod("number", F.lit(len(weights))).cast("int")))
    weighed = stage(weighed.withColumn("cap", F.col("source_size") * F.lit(int(most))), "source-weights")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    total = weighed.agg(F.sum(exact("source_size"))).first()[0] or Decimal(0)
    full, n, left, weight = F.lit(False), -1, total, None
    while True:
        sums = weighed.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, exact("cap")).otherwise(F.lit(0))).alias("taken"),
            F.sum(F.when(full, F.lit(0)).otherwise(exact("weight"))).alias("weight"),
        ).first()
        left, weight = total - (sums["taken"] or 0), sums["weight"] or Decimal(0)
        if sums["n"] == n or not weight:
            break
        n = sums["n"]
        # Exact numbers decide, so that neither rounding nor order does.
        full = F.col("cap").cast("decimal(19,0)") * F.lit(weight).cast("decimal(19,0)") < F.col("weight").cast("decimal(19,0)") * F.lit(left).cast("decimal(19,0)")
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(weight)) if weight else F.col("cap").cast("double")
    return weighed.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(share).alias("target"))


def with_sources(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with what ``sources`` holds on their source.

    The table of sources is broadcast if measured small.  Else it is repeated under ``SALTS`` numbers, and
    rows are dealt over them, so the rows of one source never meet in one task.
    """
    (key,) = spare(rows, "source_key")
    right = sources.withColumnRenamed("source", key)
    if fits_broadcast(sources):
        return rows.join(F.broadcast(right), F.col("source").eqNullSafe(F.col(key)), how).drop(key)
    salt, salted = spare(rows, "salt_", "salts_")
    right = right.withColumn(salted, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn(salt, F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    return left.join(right, (F.col(salt) == F.col(salted)) & F.col("source").eqNullSafe(F.col(key)), how).drop(key, salt, salted)


def _slot(ratio: Column, level: int) -> Column:
    """The slot of a ratio among ``SLOTS ** level``, in the order of ratios."""
    return F.floor(ratio / (1 + ratio) * F.lit(float(SLOTS) ** level)).cast("long")


def _crossing(rows: DataFrame, level: int) -> DataFrame:
    """(source, slot, base, n): the slot in which each source's need is reached, the words before it, its rows.

    ``rows`` have (source, need, base, ratio, size).  At most ``SLOTS`` rows of a source meet.
    """
    slots = rows.groupBy("source", "need", "base", _slot(F.col("ratio"), level).alias("slot")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    upto = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    reached = slots.withColumn("after", F.col("base") + F.sum("words").over(upto)).where("after > need")
    first = F.min_by(F.struct(F.col("slot"), (F.col("after") - F.col("words")).alias("base"), F.col("n")), F.col("slot"))
    return reached.groupBy("source").agg(first.alias("s")).select("source", "s.*")


def cuts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(source, cross, cut) where each source's sample ends, and the level of ``cross``.

    ``rows`` are stored and have (source, need, ratio, doc_id, size).  In the order of ratios, ties by id and size,
    documents are taken while that brings the words nearer to the need.  All slots before ``cross`` are taken, and
    in it the documents up to ``cut``.
    """
    held = rows.where("need > 0").withColumn("base", F.lit(0).cast("long"))
    level = 1
    while True:
        found = stage(_crossing(held, level), "crossing-slots")
        most = found.agg(F.max("n")).first()[0] or 0
        inside = with_sources(held.drop("base"), found.select("source", "slot", "base")).where(_slot(F.col("ratio"), level) == F.col("slot"))
        if most <= TASK_ROWS or level == DEEPEST:
            break
        held, level = stage(inside.drop("slot"), "crossing-rows"), level + 1
    place = F.struct("ratio", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "size")
    items = inside.groupBy("source", "need", "base", place.alias("place")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("base") + F.sum("words").over(upto)
    nearer = items.withColumn("after", after).where(F.col("after") * 2 - F.col("words") < F.col("need") * 2)
    last = nearer.groupBy("source").agg(F.max("place").alias("cut"))
    ends = found.select("source", F.col("slot").alias("cross")).join(last.withColumnRenamed("source", "source_key"), F.col("source").eqNullSafe(F.col("source_key")), "left")
    return stage(ends.select("source", "cross", "cut"), "sample-ends"), level


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one per row of ``docs``; ``taken`` is 0 to ``most`` times ``size``.

    Every document of a source is wanted target / source_size times: so many whole copies are certain, and the
    fraction is its chance of one more.  Documents are put in order of the odds of a random number over the odds
    of that chance, least first, and taken while that brings the source's words nearer to its target.  So a source
    misses its target by half a document at most (half of all rows that repeat the last one's id and text).

    Sizes are in words; null text is empty.  A null source is a source of its own, ordered last; null ids come last
    among equal ratios.  Rows that repeat id, source and text are taken together.  An empty table gives no rows; other
    columns are not read.
    """
    text = col(text_col)
    read = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        col(source_col).cast("string").alias("source"),
        words_in(text).alias("size"),
        random_number(col(id_col), text).alias("u"),
    )
    rows = stage(read, "document-sizes")
    sources = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    wanted = targets(sources, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = wanted.withColumn("copies", F.floor(rate)).withColumn("chance", rate - F.col("copies"))
    wanted = stage(wanted.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")), "source-targets")
    odds = lambda p: p / (1 - p)
    ratio = F.when(F.col("chance") > 0, odds(F.col("u")) / odds(F.col("chance")))
    sampled = with_sources(rows, wanted.where("chance > 0").select("source", "need", "chance"))
    ends, level = cuts(sampled.withColumn("ratio", ratio))
    all_of = wanted.join(ends.withColumnRenamed("source", "source_key"), F.col("source").eqNullSafe(F.col("source_key")), "left").drop("source_key")
    met = with_sources(rows, stage(all_of, "source-ends")).withColumn("ratio", ratio)
    place = F.struct("ratio", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "size")
    before = F.coalesce(_slot(F.col("ratio"), level) < F.col("cross"), F.lit(False))
    more = F.when(before | F.coalesce((_slot(F.col("ratio"), level) == F.col("cross")) & (place <= F.col("cut")), F.lit(False)), 1).otherwise(0)
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + more)).alias("taken"))
