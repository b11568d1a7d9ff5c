"""Weighted text search: words, "phrases", or, and -not.

Words are lower-cased runs of letters and digits; there is no stemming, and
rank is our own sum of weights (title 1.0, body 0.4) over matching words, so it
orders results but is not numerically that of another engine. Stop words are
dropped but keep their place, so a phrase still spans them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.sources.layout import clustered

# The usual English stop words.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or because as until while of at by for with
    about against between into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now
    """.split()
)
WEIGHTS = {"A": 1.0, "B": 0.4}
_GAP = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Terms:
    """One alternative of a query: all of `needed`, none of `barred`.

    Each entry is a tuple of (offset, word): one word, or the words of a phrase
    at their distances.
    """

    needed: list[tuple] = field(default_factory=list)
    barred: list[tuple] = field(default_factory=list)


def parse(query: str) -> list[Terms]:
    """Split a short search box text into its alternatives."""
    alternatives = [Terms()]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            alternatives.append(Terms())
            continue
        places = enumerate(w for w in re.split(r"[\W_]+", (quoted or word).lower()) if w)
        entry = [(i, w) for i, w in places if w not in STOP_WORDS]
        if entry:
            first = entry[0][0]
            entry = tuple((i - first, w) for i, w in entry)
            side = alternatives[-1].barred if minus else alternatives[-1].needed
            side.append(entry)
    return [a for a in alternatives if a.needed or a.barred]


def words(text: Column) -> Column:
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP)
    return F.filter(split, lambda w: w != "")


def _spaced(text: Column) -> Column:
    """All words with one space before and after each, for containment tests."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _GAP, " "), F.lit(" "))


def _holds(doc: Column, entry: tuple) -> Column:
    """Does the spaced text hold this word or phrase?"""
    offsets = [i for i, _ in entry]
    if offsets == list(range(len(entry))):
        return doc.contains(" " + " ".join(w for _, w in entry) + " ")
    pattern, last = " ", 0
    for place, (i, w) in enumerate(entry):
        skipped = i - last - 1 if place else 0
        pattern += "[^ ]+ " * skipped + w + " "
        last = i
    return doc.rlike(pattern)


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def search(docs: DataFrame, query: str, key: str, title: Column, body: Column) -> DataFrame:
    """Matching documents with rank, best first, straight from the text.

    Everything is decided within a row: one scan, no shuffle but the final sort
    of the matches. Use an index for many queries over the same documents.
    """
    alternatives = parse(query)
    wanted = sorted({w for a in alternatives for entry in a.needed for _, w in entry})
    # A word can only be there if its letters are: a plain substring test
    # spares most documents the word splitting.
    letters = F.lower(F.concat_ws(" ", title, body))
    maybe = F.lit(False)
    for a in alternatives:
        maybe = maybe | _all([letters.contains(w) for entry in a.needed for _, w in entry])
    rows = docs.filter(maybe).select(key, _spaced(title).alias("__a"), _spaced(body).alias("__b"))
    rows = rows.withColumn("__doc", F.regexp_replace(F.concat("__a", "__b"), " +", " "))
    hit = F.lit(False)
    for a in alternatives:
        hit = hit | _all([_holds(F.col("__doc"), e) for e in a.needed] + [~_holds(F.col("__doc"), e) for e in a.barred])
    found = rows.filter(hit)

    def occurrences(part: str) -> Column:
        return F.size(F.filter(F.split(part, " "), lambda w: w.isin(*wanted))) if wanted else F.lit(0)

    rank = (occurrences("__a") * F.lit(10) + occurrences("__b") * F.lit(4)).cast("decimal(12,0)") / F.lit(10)
    return found.select(key, rank.cast("decimal(12,1)").alias("rank")).orderBy(F.desc("rank"), F.asc(key))


def build_index(docs: DataFrame, key: str, title: Column, body: Column, buckets: int = 64, also: Sequence[str] = ()) -> DataFrame:
    """(token, key, pos, weight, bucket): one row per word that is no stop word.

    Positions count through title then body. Write it with
    `write_index`, partitioned by `bucket`, so a query reads only the buckets
    of its words. The number of buckets travels with the column `token`, also
    through a written index.
    """
    split = docs.select(key, *also, words(title).alias("__a"), words(body).alias("__b"))
    rows = split.select(key, *also, F.size("__a").alias("__len"), F.posexplode(F.concat("__a", "__b")).alias("pos", "token"))
    weight = F.when(F.col("pos") < F.col("__len"), "A").otherwise("B")
    return rows.filter(~F.col("token").isin(*STOP_WORDS)).select(
        F.col("token").alias("token", metadata={"buckets": buckets}), key, *also, "pos", weight.alias("weight"), F.pmod(F.hash("token"), F.lit(buckets)).alias("bucket")
    )


def write_index(index: DataFrame, path: str) -> None:
    """Save the index by token bucket. Rows are cut into ranges of (bucket,
    token), as many as the shuffle's size asks for, so a common word fills
    several files and a rare one shares its file."""
    clustered(index, ["token"], ["bucket"]).write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_index(index: DataFrame, query: str, key: str, documents: DataFrame | None = None) -> DataFrame:
    """The same result as `search`, read from the index.

    An alternative of barred words only has no postings to start from; it needs
    `documents`, which has every key. An index that does not tell its number of
    buckets is read without pruning.
    """
    alternatives = parse(query)
    if documents is None and any(not a.needed for a in alternatives):
        raise ValueError("a search in the index needs a wanted word in each alternative, or the list of documents")
    vocabulary = sorted({w for a in alternatives for entry in (*a.needed, *a.barred) for _, w in entry})
    post = index.filter(F.col("token").isin(*vocabulary))
    buckets = index.schema["token"].metadata.get("buckets")
    if buckets:
        numbers = index.sparkSession.createDataFrame([(w,) for w in vocabulary], "w string")
        ids = [r[0] for r in numbers.select(F.pmod(F.hash("w"), F.lit(buckets))).distinct().collect()]
        post = post.filter(F.col("bucket").isin(*ids))
    everything = documents.select(key) if documents is not None and any(not a.needed for a in alternatives) else None
    return answer(post, alternatives, key, everything).orderBy(F.desc("rank"), F.asc(key))


def answer(post: DataFrame, alternatives: list[Terms], key: str, documents: DataFrame | None = None) -> DataFrame:
    """(key, rank) of the documents that meet an alternative, from the rows
    (token, key, pos, weight) of its words; with `documents` also those that
    have none of them."""
    wanted = sorted({w for a in alternatives for entry in a.needed for _, w in entry})
    points = F.when(F.col("weight") == "A", 10).otherwise(4)
    entries = list(dict.fromkeys(e for a in alternatives for e in (*a.needed, *a.barred)))
    flag = {e: f"__e{i}" for i, e in enumerate(entries)}
    # One aggregate per document answers every single word and the rank.
    rows = post.groupBy(key).agg(
        F.sum(F.when(F.col("token").isin(*wanted), points).otherwise(0)).alias("__points"),
        *[F.bool_or(F.col("token") == e[0][1]).alias(flag[e]) for e in entries if len(e) == 1],
    )
    for e in entries:
        if len(e) > 1:
            rows = rows.join(_phrase(post, e, key).withColumn(flag[e], F.lit(True)), key, "left")
    if documents is not None:
        rows = documents.join(rows, key, "left")

    def holds(e: tuple) -> Column:
        return F.coalesce(flag[e], F.lit(False))

    hit = F.lit(False)
    for a in alternatives:
        hit = hit | _all([holds(e) for e in a.needed] + [~holds(e) for e in a.barred])
    return rows.filter(hit).select(key, (F.coalesce("__points", F.lit(0)) / F.lit(10)).cast("decimal(12,1)").alias("rank"))


def _phrase(post: DataFrame, entry: tuple, key: str) -> DataFrame:
    """Documents where all words of a phrase stand at their distances: every
    posting votes for the place its phrase would start at."""
    starts = F.array(
        *[F.when(F.col("token") == w, F.struct(F.lit(i).alias("i"), (F.col("pos") - i).alias("start"))) for i, w in entry]
    )
    placed = post.select(key, F.inline(F.filter(starts, lambda s: s.isNotNull())))
    whole = placed.groupBy(key, "start").agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(entry))
    return whole.select(key).distinct()
