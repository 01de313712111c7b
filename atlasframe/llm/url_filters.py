"""URL filters with redirect equivalence, in DataFrame functions only.

Rules are host and path prefixes and the longest that fits decides. Pages that
no rule fits take the decision of their aliases: connected components over
redirects, canonical links and meta refreshes, found by distributed
large-star/small-star steps; an explicit allow anywhere among the aliases goes
before a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasframe.llm.shared import components, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and node of a url: the node is the url without fragment and with a
    lower-case host, by which pages that are the same document meet; null without ://."""
    rest = F.coalesce(_after(url.cast("string")), F.lit(""))
    host = _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    node = F.concat(host, F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.when(host != "", node)


def _target(href: Column) -> Column:
    """The node that a link of a page points to: absolute, //host/... and /path
    links; others are relative to the page's folder. Links elsewhere (mailto:
    and the like) and empty links give null."""
    href = F.regexp_extract(href, r"^\s*([^#\s]*)", 1)
    bare = F.regexp_replace(href, r"^(?i:https?:)?//", "")
    absolute = href.rlike(r"^(?i:https?:)?//")
    host = _lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    tail = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return (
        F.when((href == "") | F.col("host").isNull() | (F.col("host") == ""), None)
        .when(absolute, F.when(host != "", F.concat(host, tail)))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(href.startswith("/"), F.concat("host", href))
        .otherwise(F.concat("host", F.regexp_extract("path", r"^(.*/)?", 0), href))
    )


def page_links(rows: DataFrame, html_col: str = "html") -> DataFrame:
    """(node, target) of each canonical link and meta refresh of the pages."""
    html = F.col(html_col).cast("string")
    link = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    tags = rows.where("node is not null").select("node", "host", "path", link.alias("link"), meta.alias("meta")).where("link <> '' or meta <> ''")
    hrefs = F.array(F.regexp_extract("link", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.regexp_extract("meta", r"(?is)\burl\s*=\s*['\"]?([^\"'>]+)", 1))
    found = tags.select("node", "host", "path", F.explode(hrefs).alias("href"))
    return found.select("node", _target(F.col("href")).alias("target")).where("target is not null")


def rule_matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action): the longest rule that fits each distinct host
    and path; of rules of one length allow goes first, then the smaller text.
    rules: (rule 'host/path-prefix', action 'allow' or 'block'). Hosts meet rules
    by an equi-join on their domain suffixes."""
    labels = F.split("host", r"\.")
    keys = rows.where("host <> ''").select("host", "path").distinct()
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    held = rules.select("rule", "action", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("prefix"))
    fits = keys.withColumn("suffix", F.explode(suffix)).join(held, "suffix").where(F.col("path").startswith(F.col("prefix")))
    order = F.struct((-F.length("rule")).alias("l"), F.col("action").alias("a"), F.col("rule").alias("r"))
    return fits.groupBy("host", "path").agg(F.min(order).alias("best")).select("host", "path", F.col("best.r").alias("rule"), F.col("best.a").alias("action"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, component (the smallest
    node among its aliases, null for a url without host).

    verdict: the longest rule's; else 'allow' if any alias is allowed by a rule,
    'block' if any is blocked, else 'allow'. redirects: (from_url, to_url).
    Null urls and urls without :// have an empty host and path and are allowed.
    Repeated pages are judged each; other columns are ignored; an empty table
    gives an empty result.
    """
    host, path, node = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), node.alias("node"), F.col(html_col).cast("string").alias("html"))
    edges = page_links(rows)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_parts(F.col("from_url"))[2].alias("node"), url_parts(F.col("to_url"))[2].alias("target")))
    # Urls without a host meet no rule and no alias: they stay out of the joins, where they would be one key.
    lone = rows.where("node is null").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("component"))
    rows = rows.where("node is not null").drop("html")
    groups = components(edges.withColumnRenamed("node", "a").withColumnRenamed("target", "b"), "a", "b")
    rows = rows.join(rule_matches(rows, rules), ["host", "path"], "left")
    rows = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = table(rows.select("id", "host", "path", "rule", "action", "component"), "urls")
    said = rows.where("action is not null").groupBy("component").agg(F.min("action").alias("by_alias"))  # allow sorts before block
    rows = rows.join(said, "component", "left")
    rows = rows.select("id", "host", "path", "rule", F.coalesce("action", "by_alias", F.lit("allow")).alias("verdict"), "component")
    return rows.unionByName(lone).withColumnRenamed("id", id_col)


#: The rules of the registered query: fixed by its contract.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

ORACLE = r"""
with recursive u as (
  select page_id, url, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (
  select page_id, html,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as tail from u),
q as (select *, case when host <> '' then host || tail end as node from p),
rules(rule, action) as (values ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
fit as (
  select distinct q.host, q.path, rule, action,
    row_number() over (partition by q.host, q.path order by length(rule) desc, action, rule) as n
  from (select distinct host, path from q) q join rules
    on ('.' || q.host) like ('%.' || split_part(rule, '/', 1)) and starts_with(q.path, substr(rule, instr(rule, '/')))),
links as (
  select node, host, regexp_extract(regexp_extract(html, '<link[^>]*rel="canonical"[^>]*>'), 'href="([^"]+)', 1) as href from q),
e as (
  select node as a, case when href like '%://%' then regexp_replace(href, '^[^/]*//', '') else host || href end as b
  from links where href <> ''),
bi as (select a, b from e union select b, a from e),
reach(a, b) as (select a, a from bi union select r.a, x.b from reach r join bi x on r.b = x.a),
comp as (select a as node, min(b) as component from reach group by a),
j as (
  select q.page_id, q.host, q.path, f.rule, f.action, coalesce(c.component, q.node) as component
  from q left join fit f on f.host = q.host and f.path = q.path and f.n = 1 left join comp c on c.node = q.node),
said as (select component, min(action) as by_alias from j where action is not null group by component)
select page_id, host, path, rule, coalesce(action, by_alias, 'allow') as verdict
from j left join said on said.component = j.component
"""
