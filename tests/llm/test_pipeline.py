"""The pipeline's stages on a small corpus, and the registration of queries."""

import re

from test_llm_operators import contamination, corpus, jaccard_groups, removed

import __spark_entry__ as entry_module
import corpus_pipeline


def test_registered():
    names = entry_module.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_stages(spark, tmp_path):
    texts, shared = corpus(11, rows=60)
    rows = [(i, t, ("aa", None)[i % 7 == 0], "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(shared[2:30]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append({r.doc_id: r.text for r in docs.collect()})
    first = {i: t for i, t in enumerate(texts) if t and re.search(r"[^\W\d_]", t)}
    assert steps[0] == first
    ids = sorted(first)
    groups = jaccard_groups([first[i] for i in ids], 5, 80)
    second = {ids[k]: first[ids[k]] for k, (_, root) in groups.items() if root == k}
    assert steps[1] == second
    ids = sorted(second)
    gone = removed([second[i] for i in ids], 13)
    left = {ids[k]: n - m for k, (n, m, _) in gone.items() if not m or m < n}
    assert {i: len(t.split()) for i, t in steps[2].items()} == left
    ids = sorted(steps[2])
    hits = contamination([steps[2][i] for i in ids], items, 10)
    assert set(steps[3]) == {ids[k] for k, v in hits.items() if not v[1] or v[1] < v[0]}
    assert not any(v[1] for v in contamination(list(steps[3].values()), items, 10).values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(steps[3])


def test_near_duplicates_judges_each_text_of_an_id(spark, tmp_path):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (7, b), (7, b), (8, ""), (9, None), (None, a), (None, a), (None, "")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, a), (5, b), (8, ""), (9, None), (None, a), (None, a), (None, "")], key=str)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
