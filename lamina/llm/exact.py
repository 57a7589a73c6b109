"""Exact deduplication: two-pass Bloom filtering, so that only possibly repeated rows are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.staging import col, doc_text, spare, stage

#: Bits of one filter block; the size Spark's bitmap functions work in.
BLOCK_BITS = 32768
BITS_PER_ROW = 16
#: 32768 blocks of 4 KB: at most 128 MB are sent to an executor.
MAX_BLOCKS = 1 << 15


def normalised(text: Column) -> Column:
    """Text in which each run of ASCII white space is one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _probe(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block and two bit positions of a key; all from one 64-bit hash of it."""
    h = F.xxhash64(key)
    return (
        F.pmod(F.shiftrightunsigned(h, 30), F.lit(blocks)).alias("block"),
        h.bitwiseAND(F.lit(BLOCK_BITS - 1)),
        F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)),
    )


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), position % 8)), F.lit(2)) == 1


def repeat_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """First pass: blocks (block, bitmap) of the bits that at least two rows set.

    ``keys`` has one column.  A bit is counted before it is set, so keys that occur once leave
    the filter empty but for collisions.
    """
    block, one, two = _probe(F.col(keys.columns[0]), blocks)
    bits = keys.select(block, F.explode(F.array(one, two)).alias("bit"))
    twice = bits.groupBy("block", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def blocks_for(rows: int, bits_per_row: int = BITS_PER_ROW, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, -(-rows * bits_per_row // BLOCK_BITS)))


def possibly_repeated(df: DataFrame, key: str, seen: DataFrame, blocks: int) -> DataFrame:
    """Second pass: ``df`` with a last, boolean column that is false only for keys that occur once.

    The filter has at most ``max_blocks`` blocks of 4 KB, so its broadcast has a fixed bound.
    Where a corpus outgrows it, more rows are called repeated and shuffled; results do not change.
    """
    block, bitmap, maybe = spare(df, "block_", "bitmap_", "maybe_repeated")
    where, one, two = _probe(col(key), blocks)
    sent = F.broadcast(seen.select(F.col("block").alias(block), F.col("bitmap").alias(bitmap)))
    found = F.coalesce(_bit(col(bitmap), one) & _bit(col(bitmap), two), F.lit(False))
    return df.withColumn(block, where).join(sent, block, "left").withColumn(maybe, found).drop(block, bitmap)


def _hashed(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, text_sha256) of every row, stored; the filter over it; its number of blocks."""
    hashed = stage(docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")), "text-hashes")
    blocks = blocks_for(hashed.count())
    return hashed, stage(repeat_filter(hashed.select("text_sha256"), blocks), "repeat-filter"), blocks


def _groups(candidates: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size) of texts that really occur more than once; stored, so that
    the joins on it stay plain exchanges that Spark can split for one very large group."""
    found = candidates.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return stage(found.where("group_size > 1"), "copy-groups")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per row of ``docs``.

    Texts are equal when they agree after white space runs become one space.  Null counts as the
    empty text.  The smallest doc_id of a group stays; null ids never do unless a group has no other,
    and then keep_id is null.  If the row that stays is itself repeated (same id, equal text),
    exactly one of the repeats is kept.  Other columns are not read; an empty table gives no rows.
    """
    hashed, seen, blocks = _hashed(doc_text(docs, id_col, text_col))
    flagged = possibly_repeated(hashed, "text_sha256", seen, blocks)
    alone = F.struct(F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    passed = flagged.where("not maybe_repeated").select("doc_id", "text_sha256", alone.alias("s")).select("doc_id", "s.*", "text_sha256")
    candidates = stage(flagged.where("maybe_repeated").select("doc_id", "text_sha256"), "copy-candidates")
    met = candidates.join(_groups(candidates), "text_sha256", "left")
    unique = met.where("group_size is null").select("doc_id", "text_sha256", alone.alias("s")).select("doc_id", "s.*", "text_sha256")
    grouped = met.where("group_size is not null").withColumn("first_", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    lost = grouped.where("not first_").withColumn("kept", F.lit(False))
    order = Window.partitionBy("text_sha256").orderBy("doc_id")
    first = grouped.where("first_").withColumn("kept", F.row_number().over(order) == 1)
    return passed.select(*columns).unionByName(unique.select(*columns)).unionByName(lost.select(*columns)).unionByName(first.select(*columns))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_copies`` does not keep; all columns are kept as they are.

    Rows that the filter clears are not shuffled.  Of the others, those that stay are chosen by a join
    on the text's hash.
    """
    _, seen, blocks = _hashed(doc_text(docs, id_col, text_col))
    (sha,) = spare(docs, "text_sha256")
    flagged = possibly_repeated(docs.withColumn(sha, F.sha2(normalised(col(text_col)), 256)), sha, seen, blocks)
    maybe = flagged.columns[-1]
    passed = flagged.where(~col(maybe)).select(*[col(c) for c in docs.columns])
    candidates = flagged.where(col(maybe)).drop(maybe)
    keys = candidates.select(col(id_col).cast("long").alias("doc_id"), col(sha).alias("text_sha256"))
    keep, size, key = spare(candidates, "keep_id", "group_size", "group_sha")
    groups = _groups(keys).select(F.col("text_sha256").alias(key), F.col("keep_id").alias(keep), F.col("group_size").alias(size))
    met = candidates.join(groups, col(sha) == col(key), "left")
    unique = met.where(col(size).isNull()).select(*[col(c) for c in docs.columns])
    first = met.where(col(size).isNotNull() & col(id_col).cast("long").eqNullSafe(col(keep))).dropDuplicates([sha])
    return passed.unionByName(unique).unionByName(first.select(*[col(c) for c in docs.columns]))
