"""URL filter with redirect equivalence, in DataFrame operations only.

Rules judge a URL by host suffix and path prefix. URLs that redirect to each
other or name each other as canonical are aliases: connected components over
these edges carry a block to members without a rule of their own. An explicit
allow takes precedence: a member's own rule is never overridden, and a component
with an allowed member stays open.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmill.llm.components import components
from workmill.session import cut

_AFTER = "://([^/?#]*)([^?#]*)"
# Tags end before the next one begins, so that markup without an end is read once.
_LINK = r"(?i)<link\b[^<>]*>"
_META = r"(?i)<meta\b[^<>]*>"
# The word canonical in rel, in quotes also among others.
_WORD = r"(?:[^\"'>]*\s)?canonical(?:\s[^\"'>]*)?"
_CANONICAL = rf"(?i)\srel\s*=\s*(?:\"{_WORD}\"|'{_WORD}'|canonical(?=[\s/>]))"
_HREF = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?i)\shttp-equiv\s*=\s*[\"']?refresh\b"
_REFRESH_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def with_host_and_path(df: DataFrame, url: str) -> DataFrame:
    text = F.coalesce(F.col(url), F.lit(""))
    return df.withColumns({"host": _lower(F.regexp_extract(text, _AFTER, 1)), "path": F.regexp_extract(text, _AFTER, 2)})


def _node(url: Column) -> Column:
    """Two spellings of one address: fragment cut, scheme and host lower-cased."""
    bare = F.regexp_extract(url, "^([^#]*)", 1)
    head = F.regexp_extract(bare, "^([^?]*?://[^/?]*)", 1)
    return F.when(F.length(bare) > 0, F.concat(_lower(head), F.substr(bare, F.length(head) + 1)))


def _absolute(link: Column, base: Column) -> Column:
    """The address a link of page `base` leads to."""
    scheme, origin = F.regexp_extract(base, "^([^:]*:)//", 1), F.regexp_extract(base, "^([^/]*//[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([^/]*//[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    inside = F.when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(folder, link))
    return F.when(link == "", None).when(link.contains("://"), link).otherwise(inside)


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) of all canonical links and refresh redirects in the pages."""

    def target(tags: str, kind: str, inside: str) -> Column:
        found = F.filter(F.regexp_extract_all("html", F.lit(tags), F.lit(0)), lambda tag: tag.rlike(kind))
        return F.transform(found, lambda tag: F.regexp_extract(tag, inside, 1))

    found = [target(_LINK, _CANONICAL, _HREF), target(_META, _REFRESH, _REFRESH_URL)]
    link = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.explode(F.concat(*found)).alias("link"))
    return link.where("link != ''").select(_node(F.col("url")).alias("src"), _node(_absolute(F.col("link"), F.col("url"))).alias("dst"))


def _ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, own) of addresses that a rule fits; the longest wins.

    Every address meets the rules of its host's suffixes only, by an equal join.
    """
    rule = rules.select(_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict").where("rule_host IS NOT NULL AND rule_path IS NOT NULL")
    label = F.split("host", "[.]")
    suffix = F.transform(F.sequence(F.lit(1), F.size(label)), lambda k: F.array_join(F.slice(label, k, F.size(label)), "."))
    distinct = addresses.select("host", "path").where("host != ''").distinct()
    met = distinct.withColumn("rule_host", F.explode(suffix)).join(rule, "rule_host").where(F.startswith("path", "rule_path"))
    name = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(name).alias("length"), (F.col("verdict") == "allow").alias("allow"), name.alias("rule"), F.col("verdict").alias("own")))
    return met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.own")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict), one row per page.

    `rules` has host, path, verdict (allow or block); a rule fits its host and
    all subdomains where the path starts with the rule's, the longest wins, of
    equally long ones an allow. `redirects` (src, dst) adds edges to those found
    in the html. Pages without a rule: allow if their component has an explicitly
    allowed address, else block if it has a blocked one, else allow.

    Null url or one without `://`: host and path empty, no rule. Null html: no
    links. Repeated rows are judged alike. No rows: no rows.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_node(F.col("src")).alias("src"), _node(F.col("dst")).alias("dst")))
    member = components(edges.where("src IS NOT NULL AND dst IS NOT NULL"), "src", "dst")
    address = with_host_and_path(member, "node")
    own = address.join(_ruled(address, rules), ["host", "path"])
    decided = own.groupBy("label").agg(F.max(F.col("own") == "allow").alias("open")).select("label", F.when(F.col("open"), "allow").otherwise("block").alias("shared"))
    shared = cut(member.join(decided, "label").select("node", "shared"))
    base = with_host_and_path(pages.select("page_id", "url"), "url")
    out = base.join(_ruled(base, rules), ["host", "path"], "left").withColumn("node", _node(F.col("url"))).join(shared, "node", "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("own", "shared", F.lit("allow")).alias("verdict"))
