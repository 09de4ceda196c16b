"""Exact deduplication in two Bloom passes, with built-in functions only.

Pass 1 fills a blocked Bloom filter with counters: a row's hash picks a word of 64 bits and two of the word's 16 fields of
four bits, and adds one to each. The filter has one to two words for each row. A task adds up its own rows before anything
travels, and what travels is words of the filter, never a row: a group of copies of any size is one word from each task. A
word stays if one of its fields counts two or more; in a word that more than 15 rows fell into, or that overflows, every
field does. Those words are the filter of hashes that may be repeated.

Pass 2 holds each row against that filter, which is broadcast. Rows that it rules out pass straight through as groups of
one. Only the others shuffle, and they are grouped by their full SHA-256, so that the result is exact whatever the filter
lets through. A filter of more than MAX_FLAGGED words, counted after pass 1, is cut into slices of hashes: rows are written
once by slice, without a shuffle, and each slice has its own pass 2.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import ascii_lower, free_name, join_groups, materialise

#: Words of the filter that are broadcast at most, 16 bytes each.
MAX_FLAGGED = 1 << 21
_LOW, _ALL = 0x1111111111111111, -1


@dataclass
class RepeatFilter:
    """Words of the counting filter with a field of two or more: slice, word, flags (bit 4k for field k)."""

    flagged: DataFrame
    n_words: int
    n_slices: int

    def slice_of(self, h: Column) -> Column:
        return F.pmod(_word(h, self.n_words), F.lit(self.n_slices)).cast("int")

    def split(self, rows: DataFrame, h: str) -> list[tuple[DataFrame, int]]:
        """``rows`` in slices. One slice is the rows as they are; several are written by slice."""
        if self.n_slices == 1:
            return [(rows, 0)]
        name = free_name(rows, "slice")
        written = materialise(rows.withColumn(name, self.slice_of(F.col(h))), "slices", partition_by=name)
        return [(written.filter(F.col(name) == k).drop(name), k) for k in range(self.n_slices)]

    def marked(self, rows: DataFrame, h: str, k: int, to: str) -> DataFrame:
        """Adds ``to``: whether the hash may be repeated. ``rows`` are those of slice k, and don't shuffle."""
        word, flags = free_name(rows, "bloom_word"), free_name(rows, "bloom_flags")
        own = self.flagged.filter(F.col("slice") == k).select(F.col("word").alias(word), F.col("flags").alias(flags))
        rows = rows.withColumn(word, _word(F.col(h), self.n_words)).join(F.broadcast(own), word, "left")
        both = reduce(lambda a, b: a & b, [F.call_function("shiftright", F.col(flags), f.cast("int")).bitwiseAND(F.lit(1)) == 1 for f in _fields(F.col(h))])
        return rows.withColumn(to, F.coalesce(both, F.lit(False))).drop(word, flags)


def _word(h: Column, n_words: int) -> Column:
    return h.bitwiseAND(F.lit(n_words - 1).cast("bigint"))


def _fields(h: Column) -> list[Column]:
    """Where the two fields of a hash begin in its word; its word comes from lower bits."""
    first = F.shiftright(h, 56).bitwiseAND(F.lit(15).cast("bigint"))
    other = (first + 1 + F.pmod(F.shiftright(h, 48), F.lit(15))) % 16
    return [first * 4, other * 4]


def repeat_filter(hashes: DataFrame) -> RepeatFilter:
    """Pass 1 over a table with one bigint column ``h``, which is read twice."""
    n, n_words = hashes.count(), 1024
    while n_words < n:
        n_words *= 2
    one = F.lit(1).cast("bigint")
    add = reduce(lambda a, b: a + b, [F.call_function("shiftleft", one, f.cast("int")) for f in _fields(F.col("h"))])
    words = hashes.select(_word(F.col("h"), n_words).alias("word"), add.alias("add")).groupBy("word").agg(F.try_sum("add").alias("sum"), F.count(F.lit(1)).alias("n"))
    twice = F.shiftright("sum", 1).bitwiseOR(F.shiftright("sum", 2)).bitwiseOR(F.shiftright("sum", 3)).bitwiseAND(F.lit(_LOW))
    flags = F.when((F.col("n") > 15) | F.col("sum").isNull(), F.lit(_ALL).cast("bigint")).otherwise(twice)
    flagged = materialise(words.select("word", flags.alias("flags")).filter("flags <> 0"), "flagged")
    n_flagged, n_slices = flagged.count(), 1
    while n_slices * MAX_FLAGGED < n_flagged:
        n_slices *= 2
    slice_ = F.pmod(F.col("word"), F.lit(n_slices)).cast("int")
    return RepeatFilter(flagged.select(slice_.alias("slice"), "word", "flags"), n_words, n_slices)


def text_sha256(text: Column) -> Column:
    """Hex SHA-256 of a text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


@dataclass
class Groups:
    """row, doc_id, sha, h for each row of the documents, their filter, and the groups of the rows that may be repeated."""

    digests: DataFrame
    seen: RepeatFilter
    alone: DataFrame
    rows: DataFrame
    groups: DataFrame


def _groups(docs: DataFrame, id_col: str, text_col: str) -> Groups:
    digests = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.unhex(text_sha256(F.col(text_col))).alias("sha"))
    digests = materialise(digests.withColumn("h", F.xxhash64("sha")), "digests")
    seen = repeat_filter(digests.select("h"))
    parts = [seen.marked(rows, "h", k, "maybe") for rows, k in seen.split(digests, "h")]
    alone = reduce(DataFrame.unionByName, [p.filter(~F.col("maybe")) for p in parts])
    rows = materialise(reduce(DataFrame.unionByName, [p.filter("maybe") for p in parts]).select("row", "doc_id", "sha"), "maybe")
    groups = rows.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    return Groups(digests, seen, alone, rows, materialise(groups, "groups"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts, the row with the
    largest doc_id stays; a null id is smaller than any other. Of rows that repeat that largest id with that same
    text, one stays. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    g = _groups(docs, id_col, text_col)
    out = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")]
    alone = g.alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    judged = join_groups(g.rows, g.groups, "sha", "group_size", g.rows.count())
    judged = judged.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "sha")
    return alone.select(*out).unionByName(judged.select(*out))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops, with the same columns.

    Texts that can't be repeated don't shuffle. Of rows that repeat both id and text, one stays. Null texts count as empty,
    a null id is smaller than any other, and an empty table gives an empty result.
    """
    g = _groups(docs, id_col, text_col)
    sha, h, maybe, win_sha, win_id = (free_name(docs, c) for c in ("sha", "h", "maybe", "win_sha", "win_id"))
    full = docs.withColumn(sha, F.unhex(text_sha256(F.col(text_col)))).withColumn(h, F.xxhash64(sha))
    parts = [g.seen.marked(rows, h, k, maybe) for rows, k in g.seen.split(full, h)]
    winners = g.groups.select(F.col("sha").alias(win_sha), F.col("last.doc_id").alias(win_id))
    alone = reduce(DataFrame.unionByName, [p.filter(~F.col(maybe)) for p in parts])
    some = reduce(DataFrame.unionByName, [p.filter(F.col(maybe)) for p in parts])
    kept = some.join(winners, (F.col(sha) == F.col(win_sha)) & F.col(id_col).eqNullSafe(F.col(win_id)), "left_semi").dropDuplicates([sha])
    return alone.unionByName(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
