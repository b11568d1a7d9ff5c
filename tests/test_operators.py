"""Search, hierarchy, checks, governance and log questions."""

import random

import pytest
from pyspark.sql import functions as F

from workmill.operators import governance, opmetrics, quality
from workmill.operators.facts import keyed_history, task_history
from workmill.operators import hierarchy, inverted
from workmill.operators.hierarchy import descendants, forest, reachable
from workmill.session import cut
from workmill.operators.inverted import WordIndex
from workmill.operators.search import build_index, parse, search, search_index, write_index
from workmill.sources.projection import Inputs

from compare import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


# -- search ------------------------------------------------------------------------


def docs(spark):
    return spark.createDataFrame(
        [
            (1, "Urgent bug", "The login page fails. Urgent!"),
            (2, "Page layout", "bug of the page, not urgent"),
            (3, "Login", None),
            (4, None, "Bug, bug; BUG"),
            (5, "fails login", "page"),
        ],
        "id bigint, title string, body string",
    )


def find(spark, text):
    got = search(docs(spark), text, "id", F.col("title"), F.col("body")).collect()
    return [(r["id"], float(r["rank"])) for r in got]


def test_query_parts():
    assert [(a.needed, a.barred) for a in parse('a "red fox" -old or new')] == [
        ([((0, "red"), (1, "fox"))], [((0, "old"),)]),
        ([((0, "new"),)], []),
    ]
    assert parse("the of") == []
    assert parse('"bug of the page"')[0].needed == [((0, "bug"), (3, "page"))]


def test_search_rules(spark):
    assert find(spark, "urgent bug") == [(1, 2.4), (2, 0.8)]
    assert find(spark, "BUG") == [(4, 1.2), (1, 1.0), (2, 0.4)]
    # Words of a phrase may meet across the end of the title.
    assert find(spark, '"login page"') == [(5, 1.4), (1, 0.8)]
    # Any two words may stand for "of the": "bug The login page" fits too.
    assert [i for i, _ in find(spark, '"bug of the page"')] == [2, 1]
    assert find(spark, '"page bug"') == [] and [i for i, _ in find(spark, '"layout bug"')] == [2]
    assert [i for i, _ in find(spark, "bug -urgent")] == [4]
    assert sorted(i for i, _ in find(spark, "layout or fails")) == [1, 2, 5]
    assert find(spark, "nothing") == []


@pytest.mark.parametrize("text", ["urgent bug", "bug -urgent", '"login page"', '"bug of the page"', "layout or fails login", "page"])
def test_index_gives_the_same_result(spark, tmp_path, text):
    path = f"{tmp_path}/index"
    write_index(build_index(docs(spark), "id", F.col("title"), F.col("body"), buckets=8), path)
    got = search_index(spark.read.parquet(path), text, "id")
    assert [(r["id"], float(r["rank"])) for r in got.collect()] == find(spark, text)
    with pytest.raises(ValueError):
        search_index(spark.read.parquet(path), "-urgent", "id")
    index = WordIndex(spark, f"{tmp_path}/stored", "id", width=2)
    index.build(docs(spark), F.col("title"), F.col("body"))
    assert [(r["id"], float(r["rank"])) for r in index.search(text).collect()] == find(spark, text)
    without = find(spark, "-urgent or layout")
    assert [(r["id"], float(r["rank"])) for r in index.search("-urgent or layout").collect()] == without
    assert [(r["id"], float(r["rank"])) for r in search_index(spark.read.parquet(path), "-urgent or layout", "id", docs(spark)).collect()] == without


def test_stored_index_skips_directories_and_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "_CHARS", 20_000)
    # One word in all documents, one in every 500th, one in a few neighbours.
    rows = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") % 500 == 7, "seldom words").otherwise("some words").alias("t"), F.when(F.col("id").between(507, 510), "near text").otherwise("other text").alias("b"))
    index = WordIndex(spark, f"{tmp_path}/w", "id", width=100)
    index.build(rows, F.col("t"), F.col("b"))
    assert index.postings.note()["buckets"] > 3
    blocks = index.blocks().select("token", "first", "low", "high", F.size("pairs").alias("n")).collect()
    assert max(r["n"] for r in blocks) == 100 and sum(r["token"] == "words" for r in blocks) == 40
    assert all(r["first"] <= r["low"] <= r["high"] < r["first"] + 100 for r in blocks)
    found = index.search("seldom near words")
    assert [(r["id"], float(r["rank"])) for r in found.collect()] == [(507, 2.4)]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in text and "PushedFilters" in text
    few = index.blocks(["seldom", "near"])
    assert {f.split("bucket=")[1].split("/")[0] for f in (r[0] for r in few.select(F.input_file_name()).collect())} <= {str(r[0]) for r in few.select("bucket").distinct().collect()}
    counts = {(r["token"], r["weight"]): (r["word_count"], r["doc_count"]) for r in index.counts().collect()}
    assert counts == {("words", "A"): (4000, 4000), ("seldom", "A"): (8, 8), ("text", "B"): (4000, 4000), ("near", "B"): (4, 4)}  # "some" and "other" are stop words
    assert index.search("-words").count() == 0 and index.search("-near").count() == 3996
    index.build(rows.filter("id < 10"), F.col("t"), F.col("b"))
    assert index.search("words").count() == 10


def test_index_shuffles_texts_and_packed_blocks_but_no_words(spark, tmp_path, monkeypatch):
    seen = []

    def clustered(df, *more):
        seen.append(df)
        return real(df, *more)

    real = inverted.layout.clustered
    monkeypatch.setattr(inverted.layout, "clustered", clustered)
    written = []
    monkeypatch.setattr(inverted, "cut", lambda df: written.append(df) or cut(df), raising=False)
    rows = spark.range(0, 1000, 1, 4).select("id", F.lit("heading").alias("t"), F.concat(F.lit("word w"), F.col("id") % 7).alias("b"))
    index = WordIndex(spark, f"{tmp_path}/w", "id", width=100)
    index.build(rows, F.col("t"), F.col("b"))
    assert dict(seen[0].dtypes)["packed"] == "array<bigint>"
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(first") == 1 and "hashpartitioning(token" not in plan
    assert sum(r["n"] for r in index.blocks().select(F.size("pairs").alias("n")).collect()) == 3000
    assert index.search("w3").count() == 143


def test_search_does_not_shuffle(spark):
    x = Inputs(spark, SF)
    found = search(x["f_docs"], "license -released", "doc_id", F.col("title"), F.col("body"))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "rangepartitioning" in text


# -- hierarchy -------------------------------------------------------------------------


def test_cycle_stops_and_chain_is_followed(spark):
    chain = [(i, i - 1 if i else None) for i in range(12)]
    loop = [(100, 102), (101, 100), (102, 101)]
    nodes = spark.createDataFrame(chain + loop, "id int, parent int")
    tree = forest(nodes, "id", "parent")
    assert sorted((r["id"], r["depth"]) for r in tree.collect()) == [(i, i) for i in range(12)]
    around = descendants(nodes, nodes.filter("id = 100"), "id", "parent")
    assert sorted((r["id"], r["depth"]) for r in around.collect()) == [(100, 0), (101, 1), (102, 2)]
    near = descendants(nodes, nodes.filter("id = 3"), "id", "parent", max_depth=2)
    assert sorted(r["id"] for r in near.collect()) == [3, 4, 5]


def test_rounds_grow_with_the_logarithm_of_depth(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(hierarchy, "cut", lambda df: rounds.append(1) or cut(df))
    nodes = spark.range(1000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    tree = forest(nodes, "id", "parent")
    assert tree.agg(F.count("*"), F.max("depth"), F.sum("depth"), F.max("root_id")).first()[:] == (1000, 999, 999 * 500, 0)
    assert len(rounds) <= 14


def test_nested_roots_equal_a_walk(spark):
    rng = random.Random(3)
    for _ in range(3):
        parent = {i: rng.choice([None, *range(40)]) if rng.random() < 0.9 else 1000 for i in range(40)}  # cycles and missing parents
        roots = set(rng.sample(range(40), 9))
        expected = set()
        for i in range(40):
            at, depth, seen = i, 0, set()
            while at in parent and at not in seen:
                seen.add(at)
                if at in roots:
                    expected.add((at, i, depth))
                at, depth = parent[at], depth + 1
        nodes = spark.createDataFrame([(i, p, i % 3) for i, p in parent.items()], "id int, parent int, c int")
        found = descendants(nodes, nodes.filter(F.col("id").isin(list(roots))), "id", "parent", ["c"]).collect()
        assert sorted((r["root_id"], r["id"], r["depth"]) for r in found) == sorted(expected)
        assert all(r["c"] == r["id"] % 3 for r in found)
        below = reachable(nodes, spark.createDataFrame([(r,) for r in (*roots, 77)], "r int"), "id", "parent")
        assert sorted(r[0] for r in below.collect()) == sorted({i for _, i, _ in expected} | {77})


def test_reachable_lists_each_row_once(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (7, 9), (8, 7), (9, 8)], "id int, parent int")
    ids = spark.createDataFrame([(2,), (3,), (8,)], "id int")
    assert sorted(r["id"] for r in reachable(nodes, ids, "id", "parent").collect()) == [2, 3, 4, 7, 8, 9]


def test_one_parent_with_a_third_of_all_rows(spark):
    nodes = spark.range(1, 3001).select(
        "id", F.when(F.col("id") == 1, F.lit(None)).when(F.col("id") <= 1000, 1).otherwise(F.floor(F.col("id") / 3)).cast("bigint").alias("parent")
    )
    tree = forest(nodes, "id", "parent")
    assert tree.count() == 3000 and tree.filter("depth = 1").count() == 999


# -- checks -----------------------------------------------------------------------------


def test_null_passes_a_check(spark):
    df = spark.createDataFrame([(1, "todo"), (2, None), (3, "bad")], "id int, status string")
    rules = {"known": quality.in_vocabulary("status", ("todo",)), "present": quality.not_null("status")}
    got = {r["rule"]: r["violations"] for r in quality.violation_counts(df, rules).collect()}
    assert got == {"known": 1, "present": 1}
    assert sorted((r["id"], r["rule"]) for r in quality.violations(df, rules).collect()) == [(2, "present"), (3, "known")]


def test_null_keys_do_not_collide(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a")], "a int, b string")
    assert [r[:] for r in quality.duplicate_keys(df, ["a", "b"]).collect()] == [(2, "a", 2)]


def family(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return {
        "users": frame([("u1", None), ("u2", "u1"), ("u3", "u2")], "user_id string, created_by string"),
        "projects": frame([("p1", "u3")], "project_id string, created_by string"),
        "tasks": frame(
            [("t1", "u1", None, "u3"), ("t2", "u2", "t1", "u3"), ("t3", "u2", "t2", "u3")],
            "task_id string, assigned_to string, parent_task_id string, created_by string",
        ),
        "comments": frame([("c1", "t3", "u1", None), ("c2", "t1", "u3", "c1")], "comment_id string, task_id string, user_id string, parent_comment_id string"),
        "task_tags": frame([("t3", "x"), ("t1", "x")], "task_id string, tag_id string"),
    }


PKS = {"users": "user_id", "projects": "project_id", "tasks": "task_id", "comments": "comment_id"}


def test_delete_cascades_nulls_and_restricts(spark):
    tables = family(spark)
    ids = spark.createDataFrame([("u1",)], "user_id string")
    left = quality.delete_with_refs(tables, "users", ids, PKS)
    assert sorted((r[0], r[1]) for r in left["users"].collect()) == [("u2", None), ("u3", "u2")]
    assert {r["task_id"]: r["assigned_to"] for r in left["tasks"].collect()} == {"t1": None, "t2": "u2", "t3": "u2"}
    # c1 goes with its author, c2 with its parent comment.
    assert left["comments"].count() == 0
    with pytest.raises(quality.RestrictedDelete):
        quality.delete_with_refs(tables, "users", spark.createDataFrame([("u3",)], "user_id string"), PKS)
    gone = quality.delete_with_refs(tables, "tasks", spark.createDataFrame([("t2",)], "task_id string"), PKS)
    assert [r["task_id"] for r in gone["tasks"].collect()] == ["t1"]
    assert [r["task_id"] for r in gone["task_tags"].collect()] == ["t1"]


def test_delete_equals_a_walk_over_all_references(spark):
    rng = random.Random(6)
    ref = quality.Ref
    refs = [ref("a", "up", "a", "id", "cascade"), ref("b", "a1", "a", "id", "cascade"), ref("b", "a2", "a", "id", "cascade"), ref("b", "up", "b", "id", "cascade"),
            ref("c", "b1", "b", "id", "cascade"), ref("c", "a1", "a", "id", "set_null"), ref("c", "c1", "c", "id", "set_null"), ref("link", "b1", "b", "id", "cascade"), ref("link", "c1", "c", "id", "set_null")]
    pick = lambda n: rng.choice([None, *range(n)])
    rows = {
        "a": [(i, rng.choice([None, max(0, i - 1), pick(i + 1)])) for i in range(30)],
        "b": [(i, pick(40), pick(30), pick(i + 1)) for i in range(40)],
        "c": [(i, pick(40), pick(30), pick(40)) for i in range(40)],
        "link": [(pick(40), pick(40)) for _ in range(40)],
    }
    columns = {"a": ["id", "up"], "b": ["id", "a1", "a2", "up"], "c": ["id", "b1", "a1", "c1"], "link": ["b1", "c1"]}
    tables = {n: spark.createDataFrame(r, ", ".join(f"{c} int" for c in columns[n])) for n, r in rows.items()}
    gone = {("a", 3), ("a", 11)}
    while True:
        more = {(r.child, row[0]) for r in refs if r.action == "cascade" and r.child != "link" for row in rows[r.child] if (r.parent, row[columns[r.child].index(r.fk)]) in gone}
        if more <= gone:
            break
        gone |= more
    expected = {}
    for name, own in rows.items():
        kept = []
        for row in own:
            point = {r: (r.parent, row[columns[name].index(r.fk)]) in gone for r in refs if r.child == name}
            if (name, row[0]) in gone and name != "link" or any(hit for r, hit in point.items() if r.action == "cascade"):
                continue
            kept.append(tuple(None if any(hit and r.fk == c and r.action == "set_null" for r, hit in point.items()) else v for c, v in zip(columns[name], row, strict=True)))
        expected[name] = sorted(map(str, kept))
    left = quality.delete_with_refs(tables, "a", spark.createDataFrame([(3,), (11,)], "id int"), dict.fromkeys("abc", "id"), refs)
    assert {n: sorted(str(tuple(r)) for r in df.collect()) for n, df in left.items()} == expected
    assert {n: df.columns for n, df in left.items()} == columns


# -- governance ----------------------------------------------------------------------------


def test_scopes_partition_the_table(spark):
    tasks = Inputs(spark, SF)["f_tasks"]
    scope = governance.TenantScope()
    assert scope.get() is None
    with pytest.raises(governance.NoTenant):
        scope.apply("tasks", tasks)
    parts = None
    for org in range(5):
        scope.set(org)
        mine = scope.apply("tasks", tasks)
        assert scope.get() == org
        parts = mine if parts is None else parts.union(mine)
    assert rows_of(parts) == rows_of(tasks)
    assert scope.apply("tags", tasks).count() == 0
    # A warehouse table that carries the tenant is scoped as well.
    assert scope.apply("fact_tasks", tasks).count() == scope.apply("tasks", tasks).count()


def test_masked_view(spark):
    from workmill.functions.crypto import encrypt_cols

    key = bytes(range(32))
    users = spark.createDataFrame([("u", "o", "kim@x.org", "K", "L", "admin", "active", "h")], "user_id string, organization_id string, email string, first_name string, last_name string, role string, status string, password_hash string")
    shown = governance.secure_users(encrypt_cols(users, ["email"], key), key, mask=True)
    assert "password_hash" not in shown.columns and shown.first()["email"] == "k***@x.org"


# -- logs -------------------------------------------------------------------------------------


def test_a_group_with_a_third_of_all_rows_is_listed_in_parts(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit(2).alias("size"))
    groups = opmetrics.duplicate_groups(df, ["k"], "id", F.col("size"), list_length=100).collect()
    assert len(groups) > 1 and all(g["member_count"] == 1000 and g["total_size"] == 2000 for g in groups)
    assert max(len(g["members"]) for g in groups) < 200
    assert sorted(m for g in groups for m in g["members"]) == list(range(0, 3000, 3))


def test_waiting_requests_match_the_pairs(spark):
    locks = Inputs(spark, SF)["f_locks"]
    resource = ["locktype", "relation"]
    got = {r["request_id"]: (r["blocker_count"], r["blocking_pid"], r["pid"]) for r in opmetrics.waiting_requests(locks, "pid", resource, "granted").collect()}
    rows = locks.collect()
    held = {}
    for r in rows:
        if r["granted"]:
            held.setdefault((r["locktype"], r["relation"]), set()).add(r["pid"])
    want = {}
    for r in rows:
        others = held.get((r["locktype"], r["relation"]), set()) - {r["pid"]}
        if not r["granted"] and others:
            want[r["request_id"]] = others
    assert set(got) == set(want)
    assert all(n == len(want[i]) and b in want[i] for i, (n, b, _) in got.items())
    some = next(p for _, _, p in got.values())
    pairs = opmetrics.blockers_of(locks, some, "pid", resource, "granted").collect()
    assert {p["blocking_pid"] for p in pairs} == set().union(*[held.get((r["locktype"], r["relation"]), set()) for r in rows if r["pid"] == some and not r["granted"]]) - {some}


def test_history_gets_its_keys(spark):
    x = Inputs(spark, SF)
    new = x["f_tasks"].withColumn("status", F.when(F.col("task_id") == 3, "done").otherwise(F.col("status")))
    history = task_history(x["f_tasks"], new, "task_id", ["status"], "2000-01-01")
    keyed = keyed_history(history, x["f_tasks"].select("task_id", (F.col("task_id") + 1).alias("task_key")), x.dims.users, x.dims.time)
    got = keyed.collect()
    assert len(got) <= 1 and all(r["task_key"] == 4 and r["changed_date_key"] == 1827 for r in got)
