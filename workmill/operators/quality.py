"""Constraint checks and referential deletes as DataFrame operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.operators.hierarchy import reachable
from workmill.operators.lookup import lookup
from workmill.session import cut
from workmill.sources import schemas

# -- rules ------------------------------------------------------------------------
# A rule is a condition that must not be FALSE: NULL passes, as for CHECK.


def in_vocabulary(col: str, values: Sequence[str]) -> Column:
    return F.col(col).isin(*values)


def not_null(col: str) -> Column:
    return F.col(col).isNotNull()


def max_length(col: str, n: int) -> Column:
    return F.length(col) <= n


def fits_decimal(col: str, precision: int, scale: int) -> Column:
    return F.abs(F.col(col)) < F.lit(10 ** (precision - scale))


def ordered(start: str, end: str) -> Column:
    return F.col(end).isNull() | (F.col(end) >= F.col(start))


def declared_rules(table: str, columns: Sequence[str]) -> dict[str, Column]:
    """The declared constraints of a source table on the columns it has."""
    rules = {}
    for (owner, col), values in schemas.VOCABULARY.items():
        if owner == table and col in columns:
            rules[f"{col} known"] = in_vocabulary(col, values)
    for col in schemas.REQUIRED.get(table, ()):
        if col in columns:
            rules[f"{col} present"] = not_null(col)
    for col, n in schemas.LENGTHS.get(table, {}).items():
        if col in columns:
            rules[f"{col} length"] = max_length(col, n)
    for col, (precision, scale) in schemas.DECIMALS.get(table, {}).items():
        if col in columns:
            rules[f"{col} range"] = fits_decimal(col, precision, scale)
    if table == "time_logs":
        rules["end after start"] = ordered("start_time", "end_time")
    return rules


def table_report(table: str, df: DataFrame) -> DataFrame:
    """(rule, violations, row_count): declared constraints and unique keys.

    A unique key's violations are its key values held by more than one row.
    """
    out = violation_counts(df, declared_rules(table, df.columns))
    for keys in schemas.UNIQUE.get(table, ()):
        if set(keys) <= set(df.columns):
            repeated = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("violations"))
            total = df.agg(F.count(F.lit(1))).scalar()
            row = repeated.select(F.lit(f"unique {', '.join(keys)}").alias("rule"), "violations", total.alias("row_count"))
            out = out.unionByName(row)
    return out


def _broken(rule: Column) -> Column:
    return ~F.coalesce(rule, F.lit(True))


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations, row_count), all rules in one pass over the table."""
    names = list(rules)
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(_broken(rules[r])).alias(f"v{i}") for i, r in enumerate(names)]
    )
    rows = [
        F.struct(F.lit(r).alias("rule"), F.col(f"v{i}").alias("violations"), F.col("n").alias("row_count"))
        for i, r in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*rows)))


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, once per broken rule."""
    broken = F.filter(
        F.array(*[F.when(_broken(c), F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull()
    )
    return df.select("*", F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row; keys with a NULL do not collide."""
    present = df.dropna(subset=list(keys))
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    keys = parent.select(F.col(pk).alias("__pk"))
    return child.filter(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__pk"), "left_anti")


def orphan_counts(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Missing parent keys with their row counts.

    Child rows are counted per key before the join, so a key held by very many
    rows crosses the network once.
    """
    per_key = child.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("row_count"))
    return per_key.join(parent.select(F.col(pk).alias("__pk")), F.col(fk) == F.col("__pk"), "left_anti")


# -- report --------------------------------------------------------------------------


def check(name: str, counted: DataFrame, value: Column, recommended: str, passes: Column, otherwise: str = "FAIL") -> DataFrame:
    """One report row from a one-row frame."""
    return counted.select(
        F.lit(name).alias("setting_name"),
        value.cast("string").alias("current_value"),
        F.lit(recommended).alias("recommended_value"),
        F.when(passes, "PASS").otherwise(otherwise).alias("status"),
    )


def check_report(checks: Sequence[DataFrame]) -> DataFrame:
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


# -- referential delete -----------------------------------------------------------------


@dataclass(frozen=True)
class Ref:
    """`child.fk` refers to `parent.pk`; action is cascade, set_null or restrict."""

    child: str
    fk: str
    parent: str
    pk: str
    action: str


class RestrictedDelete(RuntimeError):
    pass


# The delete rules of the source model.
REFS = (
    Ref("users", "organization_id", "organizations", "organization_id", "cascade"),
    Ref("projects", "organization_id", "organizations", "organization_id", "cascade"),
    Ref("tasks", "organization_id", "organizations", "organization_id", "cascade"),
    Ref("users", "created_by", "users", "user_id", "set_null"),
    Ref("projects", "created_by", "users", "user_id", "restrict"),
    Ref("tasks", "project_id", "projects", "project_id", "set_null"),
    Ref("tasks", "created_by", "users", "user_id", "restrict"),
    Ref("tasks", "assigned_to", "users", "user_id", "set_null"),
    Ref("tasks", "parent_task_id", "tasks", "task_id", "cascade"),
    Ref("task_assignments", "user_id", "users", "user_id", "cascade"),
    Ref("task_assignments", "assigned_by", "users", "user_id", "restrict"),
    Ref("task_assignments", "task_id", "tasks", "task_id", "cascade"),
    Ref("comments", "user_id", "users", "user_id", "cascade"),
    Ref("comments", "task_id", "tasks", "task_id", "cascade"),
    Ref("comments", "parent_comment_id", "comments", "comment_id", "cascade"),
    Ref("attachments", "task_id", "tasks", "task_id", "cascade"),
    Ref("attachments", "uploaded_by", "users", "user_id", "cascade"),
    Ref("time_logs", "user_id", "users", "user_id", "cascade"),
    Ref("time_logs", "task_id", "tasks", "task_id", "cascade"),
    Ref("notifications", "user_id", "users", "user_id", "cascade"),
    Ref("audit_logs", "user_id", "users", "user_id", "set_null"),
    Ref("task_tags", "task_id", "tasks", "task_id", "cascade"),
    Ref("task_tags", "tag_id", "tags", "tag_id", "cascade"),
    Ref("user_sessions", "user_id", "users", "user_id", "cascade"),
)


def _as_text(c: str) -> Column:
    return F.col(c).cast("string")


def _pointers(df: DataFrame, refs: Sequence[Ref], *keep: Column) -> DataFrame:
    """(keep..., place, table, id): where each row's references point, one scan
    for all of them. `place` is the reference's place in `refs`."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(r.parent).alias("table"), _as_text(r.fk).alias("id")) for i, r in enumerate(refs)])
    return df.select(*keep, F.inline(F.filter(cells, lambda c: c["id"].isNotNull())))


def doomed_rows(tables: Mapping[str, DataFrame], table: str, ids: DataFrame, pks: Mapping[str, str], refs: Sequence[Ref]) -> DataFrame:
    """(table, id as text): every keyed row that goes when `ids` go from `table`.

    One fixed point over the cascade references of all tables: their edges are
    written once, and a round joins them with the rows found in the round
    before. References of a table to itself are followed to their end within a
    round, by pointer doubling, so long chains cost few rounds.
    """
    cascades = [r for r in refs if r.action == "cascade" and r.child in pks]
    edges = []
    for name in dict.fromkeys(r.child for r in cascades if r.child != r.parent):
        own = [r for r in cascades if r.child == name != r.parent]
        edges.append(_pointers(tables[name], own, F.lit(name).alias("child"), _as_text(pks[name]).alias("child_id")).drop("place"))
    edges = cut(reduce(DataFrame.union, edges)) if edges else None
    own_refs = [r for r in cascades if r.child == r.parent]

    def with_own(nodes: DataFrame) -> DataFrame:
        for r in own_refs:
            here = nodes.filter(F.col("table") == r.child).select("id")
            if not here.isEmpty():
                rows = tables[r.child].select(_as_text(r.pk).alias("id"), _as_text(r.fk).alias("above"))
                below = reachable(rows, here, "id", "above").select(F.lit(r.child).alias("table"), "id")
                nodes = nodes.union(below).distinct()
        return nodes

    start = ids.select(F.lit(table).alias("table"), _as_text(ids.columns[0]).alias("id")).distinct()
    found = fresh = cut(with_own(start))
    while edges is not None:
        step = edges.join(fresh, ["table", "id"]).select(F.col("child").alias("table"), F.col("child_id").alias("id")).distinct()
        fresh = cut(step.join(found, ["table", "id"], "left_anti"))
        if fresh.isEmpty():
            break
        if own_refs:
            fresh = cut(with_own(fresh).join(found, ["table", "id"], "left_anti"))
        found = found.union(fresh)
    return found


def delete_with_refs(
    tables: Mapping[str, DataFrame], table: str, ids: DataFrame, pks: Mapping[str, str], refs: Sequence[Ref] = REFS
) -> dict[str, DataFrame]:
    """The tables after deleting `ids` (one column, the key) from `table`.

    What goes is settled first (`doomed_rows`). Then each table is scanned once
    for references to rows that go, keeping only the keys of rows that have
    some, and joined once with those: doomed rows leave, references to be
    cleared get NULL, a restrict reference raises. A table without a key is
    joined once a reference.
    """
    refs = [r for r in refs if r.child in tables and r.parent in tables and r.fk in tables[r.child].columns]
    doomed = doomed_rows(tables, table, ids, pks, refs)
    touched = {r[0] for r in doomed.select("table").distinct().collect()}  # at most the tables
    out = {}
    for name, df in tables.items():
        own = [r for r in refs if r.child == name and r.parent in touched and not (r.parent == name and r.action == "cascade")]
        if name not in pks:
            out[name] = _unkeyed(name, df, own, doomed)
            continue
        if not own and name not in touched:
            out[name] = df
            continue
        key = _as_text(pks[name]).alias("__id")
        marks = doomed.filter(F.col("table") == name).select(F.col("id").alias("__id"), F.lit(-1).alias("place"))
        if own:
            marks = marks.union(_pointers(df, own, key).join(doomed, ["table", "id"]).select("__id", "place"))
        marks = cut(marks.groupBy("__id").agg(F.collect_set("place").alias("__places")))  # at most the references
        barred = [i for i, r in enumerate(own) if r.action == "restrict"]
        if barred:
            hit = marks.filter(F.arrays_overlap("__places", F.lit(barred))).first()
            if hit:
                r = next(own[i] for i in hit["__places"] if i in barred)
                raise RestrictedDelete(f"{name}.{r.fk} still refers to deleted rows of {r.parent}")
        left = df.withColumn("__key", key).join(marks, F.col("__key") == F.col("__id"), "left")
        leaves = [-1, *[i for i, r in enumerate(own) if r.action == "cascade"]]
        left = left.filter(F.col("__places").isNull() | ~F.arrays_overlap("__places", F.lit(leaves)))
        cleared = {r.fk: F.when(~F.coalesce(F.array_contains("__places", i), F.lit(False)), F.col(r.fk)) for i, r in enumerate(own) if r.action == "set_null"}
        out[name] = left.withColumns(cleared).select(*df.columns)
    return out


def _unkeyed(name: str, df: DataFrame, own: Sequence[Ref], doomed: DataFrame) -> DataFrame:
    """The same for a table whose rows have no key to mark them by."""
    left = df
    for r in own:
        hit = doomed.filter(F.col("table") == r.parent).select(F.col("id").alias("__hit"))
        points = _as_text(r.fk) == F.col("__hit")
        if r.action == "cascade":
            left = left.join(hit, points, "left_anti")
        elif r.action == "set_null":
            marked = lookup(left.withColumn("__text", _as_text(r.fk)), hit, "__text", "__hit", {"__mark": "__hit"})
            left = marked.withColumn(r.fk, F.when(F.col("__mark").isNull(), F.col(r.fk))).select(*df.columns)
        elif not df.join(hit, points, "left_semi").isEmpty():
            raise RestrictedDelete(f"{name}.{r.fk} still refers to deleted rows of {r.parent}")
    return left
