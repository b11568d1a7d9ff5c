"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workmill.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register `fn(read)` under its name; `read(table)` gives a whole table."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark)
            return fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op6_ngram_jaccard(read):
    """Near-duplicate components over four-word shingles at 0.85."""
    from workmill.llm.ngram_jaccard import near_duplicates

    return near_duplicates(read("documents"), width=4, percent=85)


@query()
def op10_sketch_dedup(read):
    """Words left after windows of 13 words that an earlier document has."""
    from workmill.llm.sketch_dedup import remove_repeats

    return remove_repeats(read("documents").select("doc_id", "text"), width=13, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op3_fm_decontamination(read):
    """Benchmark passages of ten words found in documents."""
    from workmill.llm.fm_decontamination import decontaminate

    found = decontaminate(read("documents"), read("benchmark"), width=10, texts=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op9_best_fit_packing(read):
    """All documents in sequences of 1024 tokens."""
    from workmill.llm.best_fit_packing import pack

    return pack(read("documents"), tokenizer_path(), capacity=1024, end=2)


@query()
def op1_warc_index_merge(read):
    """WARC records of all pages, read back and merged into one capture index."""
    from workmill.llm.warc_index import archive_and_index

    return archive_and_index(read("pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_OP4 = """
WITH parsed AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), fits AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM fits
"""  # the given pages hold no canonical link or redirect, so the method allows what no rule fits


@query(_OP4)
def op4_redirect_blocks(read):
    """Allow or block every page by rules and by its aliases."""
    from workmill.llm.redirect_blocks import judge

    pages = read("pages")
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query()
def op5_text_density(read):
    """Main text of every page."""
    from workmill.llm.text_density import extract

    return extract(read("pages"))


@query()
def op2_language_backoff(read):
    """Language of every document, learned from three of four ids."""
    from workmill.llm.language_backoff import fit, held_out, identify

    docs = read("documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query()
def op8_compression_toxicity(read):
    """Toxicity of every document, learned from four of five labelled ids."""
    from workmill.llm.compression_toxicity import classify, fit, held_out

    docs = read("documents").select("doc_id", "text")
    labels = read("labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = fit(docs, labels)
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query()
def op7_pruned_graph(read):
    """The 20 nearest of every vector whose id is divisible by 20."""
    from workmill.llm.pruned_graph import nearest

    table = read("embeddings")
    return nearest(table, table.where("vec_id % 20 = 0"), top=20)


@query()
def op11_kneser_ney(read):
    """Base rules and perplexity bands over all documents."""
    from workmill.llm.kneser_ney import judge

    found = judge(read("documents").select("doc_id", "text", "lang"), texts=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits_per_byte")


_WORDS = "filter(split(text, '[ \\t-\\r]+'), w -> w != '')"


def planted(docs: DataFrame) -> DataFrame:
    """The texts op12 is judged on: every tenth, by hash of the id, goes over into a repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    made = docs.withColumns({"_w": F.when(h % 10 == 0, F.expr(_WORDS)), "_g": F.floor(h / 10)}).withColumn("_n", F.size("_w").cast("long"))
    made = made.withColumn("_a", F.expr("if(_n > 0, _g % _n, null)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    word = "if(i >= _a, _w[cast(_a + (i - _a) % _p as int)], _w[cast(i as int)])"
    text = F.expr(f"array_join(transform(sequence(0L, _n - 1), i -> {word}), ' ')")
    return made.withColumn("text", F.when(F.col("_n") > 0, text).otherwise(F.col("text"))).drop("_w", "_g", "_n", "_a", "_p")


@query()
def op12_periodic_runs(read):
    """Periodic runs of words of every document, and the text without repeats."""
    from workmill.llm.periodic_runs import find_runs

    found = find_runs(planted(read("documents").select("doc_id", "text")), texts=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


_OP13 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), uses AS (SELECT item_id, term, count(*) AS uses FROM b GROUP BY item_id, term),
sizes AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM uses) GROUP BY doc_id, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sizes GROUP BY term, n_docs
), m AS (SELECT doc_id, 75 + (25 * len(ts) * n_docs) // n_terms AS m FROM d, sizes WHERE len(ts) > 0),
scores AS (
  SELECT item_id, doc_id, CAST(sum(uses * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM tf JOIN uses USING (term) JOIN weight USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


@query(_OP13)
def op13_term_scan(read):
    """The 20 best documents of every benchmark item."""
    from workmill.llm.term_scan import rank

    return rank(read("documents"), read("benchmark"), top=20)


def _pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


if importlib.util.find_spec("corpus_pipeline"):
    QUERIES["pipeline"] = _pipeline
