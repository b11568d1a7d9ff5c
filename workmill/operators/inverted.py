"""A stored word index: posting lists in blocks of neighbouring documents.

Documents are numbered where they are; a block holds what one word has in one
range of `width` numbers, as offsets from the first of the range. So a block is
bounded however common its word is, and a word's list is many blocks. Blocks lie
in directories by the hash of their word, in each of them in the order of words
and ranges, so a search opens the directories of its words, skips row groups of
other words, and unpacks only blocks of ranges in which an alternative has all
of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workmill.functions.keys import assign_keys
from workmill.operators.search import STOP_WORDS, answer, parse, words
from workmill.session import cut
from workmill.sources import layout
from workmill.sources.parts import Parts

_CHARS = 1 << 26  # characters of text a directory of blocks stands for
_SHARE = 1 << 24  # characters of text a task takes apart at once
_MOST = 4096


class WordIndex:
    """The index of one set of documents under a folder."""

    def __init__(self, spark: SparkSession, path: str, key: str, width: int = 1024):
        self.spark, self.key, self.width = spark, key, width
        self.postings = Parts(spark, f"{path}/postings", "bucket")
        self.listed = Parts(spark, f"{path}/documents", "slot")

    def build(self, docs: DataFrame, title: Column, body: Column) -> None:
        """Write the index of `docs`, one row per document. Rows without a key or
        without words are listed, as a search for what is missing finds them."""
        texts = docs.select(self.key, title.alias("__title"), body.alias("__body"))
        numbered = assign_keys(texts, "doc", start=0)
        chars = numbered.agg(F.sum(F.length(F.concat_ws(" ", "__title", "__body")))).first()[0] or 0
        buckets = max(1, min(_MOST, chars // _CHARS + 1))
        self.listed.commit(numbered.select("doc", self.key, F.lit(0).alias("slot")), replaced=lambda name: True, layout=lambda df: df)
        # The documents of a range come together as texts, a bounded share of them to a task;
        # their words are then grouped where they are and never shuffled one by one.
        shares = max(self.spark.sparkContext.defaultParallelism, chars // _SHARE + 1)
        ranges = numbered.withColumn("first", F.col("doc") - F.col("doc") % self.width).repartition(shares, "first")
        split = ranges.select("doc", "first", words(F.col("__title")).alias("__a"), words(F.col("__body")).alias("__b"))
        rows = split.select("doc", "first", F.size("__a").alias("__len"), F.posexplode(F.concat("__a", "__b")).alias("pos", "token"))
        rows = rows.filter(~F.col("token").isin(*STOP_WORDS))
        # A place and, in the lowest bit, whether it lies in the body.
        place = (F.col("pos") * 2 + (F.col("pos") >= F.col("__len")).cast("int")).cast("bigint")
        # One number a pair while they are shuffled and sorted: a struct takes four times the bytes.
        packed = F.shiftleft(F.col("doc") - F.col("first"), 32).bitwiseOR(place)
        blocks = rows.groupBy("token", "first").agg(F.sort_array(F.collect_list(packed)).alias("packed"))
        # Written, as cutting them into ranges reads them twice.
        blocks = cut(blocks.withColumn("bucket", F.pmod(F.hash("token"), F.lit(buckets))))
        pairs = F.transform("packed", _unpacked)
        ready = layout.clustered(blocks, ["token", "first"], ["bucket"]).select(
            "token",
            "first",
            (F.col("first") + F.shiftright(F.col("packed")[0], 32)).alias("low"),
            (F.col("first") + F.shiftright(F.element_at("packed", -1), 32)).alias("high"),
            pairs.alias("pairs"),
            "bucket",
        )
        self.postings.commit(ready, replaced=lambda name: True, layout=lambda df: df, note={"buckets": buckets})
        for table in (self.postings, self.listed):
            table.prune(1)

    def documents(self) -> DataFrame:
        return self.listed.read().drop("slot")

    def blocks(self, vocabulary: list[str] | None = None) -> DataFrame:
        """Blocks of the given words, or all."""
        rows = self.postings.read()
        if vocabulary is None:
            return rows
        asked = self.spark.createDataFrame([(w,) for w in vocabulary], "w string")
        numbers = [r[0] for r in asked.select(F.pmod(F.hash("w"), F.lit(self.postings.note()["buckets"]))).distinct().collect()]
        return rows.filter(F.col("bucket").isin(numbers) & F.col("token").isin(vocabulary))

    def search(self, query: str) -> DataFrame:
        """Matching documents with rank, best first, as `search.search` has them."""
        alternatives = parse(query)
        vocabulary = sorted({w for a in alternatives for entry in (*a.needed, *a.barred) for _, w in entry})
        found = self.blocks(vocabulary)
        open_ended = any(not a.needed for a in alternatives)
        if alternatives and not open_ended:
            present = found.groupBy("first").agg(F.collect_set("token").alias("present"))  # at most the query's words
            able = F.lit(False)
            for a in alternatives:
                able = able | F.forall(F.lit([w for entry in a.needed for _, w in entry]), lambda w: F.array_contains("present", w))
            found = found.join(present.filter(able).select("first"), "first", "left_semi")
        rows = found.select("token", "first", F.inline("pairs"))
        body = F.col("place").bitwiseAND(F.lit(1)) == 1
        post = rows.select("token", (F.col("first") + F.col("doc")).alias("doc"), F.shiftright("place", 1).alias("pos"), F.when(body, "B").otherwise("A").alias("weight"))
        hits = answer(post, alternatives, "doc", self.documents().select("doc") if open_ended else None)
        return hits.join(self.documents(), "doc").select(self.key, "rank").orderBy(F.desc("rank"), F.asc(self.key))

    def counts(self) -> DataFrame:
        """(token, weight, word_count, doc_count) of every word, from the blocks as they are."""
        parts = []
        for weight, bit in (("A", 0), ("B", 1)):
            own = F.filter("pairs", _marked(bit))
            parts.append(F.struct(F.lit(weight).alias("weight"), F.size(own).alias("n"), F.size(F.array_distinct(F.transform(own, lambda p: p["doc"]))).alias("docs")))
        rows = self.blocks().select("token", F.inline(F.array(*parts))).filter("n > 0")
        return rows.groupBy("token", "weight").agg(F.sum("n").alias("word_count"), F.sum("docs").alias("doc_count"))


def _unpacked(pair: Column) -> Column:
    return F.struct(F.shiftright(pair, 32).cast("int").alias("doc"), pair.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("place"))


def _marked(bit: int):
    return lambda pair: pair["place"].bitwiseAND(F.lit(1)) == bit
