"""Operator 1, URL filters by redirect equivalence.

Rules name a host (and all its subdomains) and a path prefix; the longest fitting rule decides a
url. Redirects and canonical links make urls aliases of each other: connected components over
those edges carry a block to the aliases that no rule names, and an explicit allow anywhere in a
component takes precedence over a block that would reach it from an alias.

Defined cases: a null url, or one without ``://``, has host and path '', fits no rule and is nobody's
alias (pages that share such a string need not be the same page); canonical links and refresh targets
that are relative, or lack a scheme alone, are resolved against the page's url (RFC 3986; a ``base``
tag is not read); aliases agree but for fragments and the case of scheme and host; null html has no links; repeated rows are judged alike; the input's other
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import Scratch, connected_components

#: Beyond so many rules they are joined instead of being written into the plan.
MAX_INLINE_RULES = 500
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def match_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, ...) -> plus ``rule`` and ``ruled``, the longest fitting rule and its verdict.

    Of equally long ones an allow goes before a block, then the smaller text; so it is either way.
    Up to ``MAX_INLINE_RULES`` rules become one CASE expression (no shuffle). More are joined by
    host suffix, of which a host has as many as labels; AQE splits a hot suffix.
    """
    best = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    if len(best) <= MAX_INLINE_RULES:
        rule = verdict = None
        for action, text in best:
            host, path = split_rule(text)
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
            verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
        none = F.lit(None).cast("string")
        return df.withColumns({"rule": none if rule is None else rule, "ruled": none if verdict is None else verdict})
    spark = df.sparkSession
    table = spark.createDataFrame([(*split_rule(t), t, a) for a, t in best], "suffix string, prefix string, rule string, ruled string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = df.select("host", "path").distinct()
    hits = keys.withColumn("suffix", F.explode(suffixes)).join(table, "suffix").where(F.col("path").startswith(F.col("prefix")))
    order = F.struct(-F.length("rule"), F.when(F.col("ruled") == "allow", 0).otherwise(1), "rule")
    chosen = hits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "ruled"), order).alias("b")).select("host", "path", "b.*")
    return df.join(chosen, ["host", "path"], "left")


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) url pairs from canonical links and refresh redirects in the html."""
    html = F.col("html")
    tag = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(
        F.filter(tag, lambda t: t.rlike(r"(?is)^<link\b[^>]*\brel\s*=\s*[\"']?canonical\b")),
        lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1),
    )
    # inside the content the target may stand in quotes of the other kind
    refresh = F.transform(
        F.filter(tag, lambda t: t.rlike(r"(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b")),
        lambda t: F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1),
    )
    some = html.rlike(r"(?i)canonical|refresh")
    found = pages.where(some).select(F.trim("url").alias("src"), F.explode(F.concat(canonical, refresh)).alias("dst"))
    found = found.where("src LIKE '%://%' AND dst <> ''")
    return found.select("src", resolve(F.col("src"), F.col("dst")).alias("dst")).where("dst LIKE '%://%'")


def resolve(base: Column, target: Column) -> Column:
    """A link's target as a whole url; one of another scheme (``mailto:``) stays as it is."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path, query = path_of(base), F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    tail = F.substring(target, F.length(own) + 1, F.length(target))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("#"), F.concat(site, path, query))
        .when(target.startswith("?"), F.concat(site, path, target))
        .when(target.startswith("/"), F.concat(site, without_dots(own), tail))
        .otherwise(F.concat(site, without_dots(F.concat(folder, own)), tail))
    )


def without_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` steps, the latter with the step before them."""
    steps = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))

    def step(done, s):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    walked = F.aggregate(steps, F.array().cast("array<string>"), step)
    # a last step of dots names a folder
    folder = F.element_at(F.split(path, "/"), -1).isin(".", "..") & (F.size(walked) > 0)
    whole = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(folder, "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def node_key(url: Column) -> Column:
    """What aliases agree in: the url without its fragment, scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    site = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(site, _UP, _LOW), F.substring(bare, F.length(site) + 1, F.length(bare)))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """pages(page_id, url, html) [, redirects(src, dst)] -> (page_id, host, path, rule, verdict, alias_of).

    ``alias_of`` is the smallest url of a linked url's component, else null.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    pages = pages.select("page_id", "url", "html")
    own = match_rules(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst").where("src LIKE '%://%' AND dst LIKE '%://%'"))
    edges = scratch.keep(edges.select(node_key(F.col("src")).alias("src"), node_key(F.col("dst")).alias("dst")))
    nodes = connected_components(edges, scratch)
    judged = match_rules(nodes.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
    group = judged.groupBy("component").agg(
        F.max(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("allows"),
        F.max(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocks"),
    )
    spread = nodes.join(group, "component").select(
        F.col("node").alias("key"), F.col("component").alias("alias_of"),
        F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").alias("passed"),
    )
    return (
        own.withColumn("key", node_key(F.col("url"))).join(spread, "key", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", "passed", F.lit(default)).alias("verdict"), "alias_of")
    )


RULES = [
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"),
    ("block", "example.net/de/8"), ("block", "org/es/"),
]


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def path_aliases(pages: DataFrame) -> DataFrame:
    """(src, dst): each page's url and the smallest url of the same path but for a last ``/`` or ``.html``, as mirrors of one site have them."""
    url = F.col("url")
    mirrored = pages.where("url LIKE '%://%'").select("url", F.regexp_replace(path_of(url), r"(\.html|/)$", "").alias("p")).where("p <> ''")
    least = mirrored.groupBy("p").agg(F.min("url").alias("dst"))
    return mirrored.join(least, "p").select(F.col("url").alias("src"), "dst")


def url_mirrors(spark, sf_dir: str) -> DataFrame:
    """The filter with a redirect table made of all pages: verdicts pass between mirrors."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, RULES, path_aliases(pages)).select("page_id", "host", "path", "rule", "verdict")


_RULE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{t}'"
    for _, t in sorted(RULES, key=lambda r: -len(r[1])) for h, p in [split_rule(t)]
) + " END"

_PAGES_SQL = f"""
u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, url FROM pages
), s AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), h AS (
  SELECT page_id, coalesce(translate(h0, '{_UP}', '{_LOW}'), '') AS host, coalesce(path, '') AS path FROM s
), r AS (SELECT page_id, host, path, {_RULE_SQL} AS rule FROM h)
, j AS (
  SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled
  FROM r
)
"""
OP1_SQL = f"WITH {_PAGES_SQL} SELECT page_id, host, path, rule, coalesce(ruled, 'allow') AS verdict, CAST(NULL AS VARCHAR) AS alias_of FROM j"

#: Components by walking the links from each url to ever smaller ones.
MIRRORS_SQL = f"""
WITH RECURSIVE {_PAGES_SQL}, n AS (
  SELECT page_id, regexp_replace(url, '#.*$', '') AS node, regexp_replace(path, '(\\.html|/)$', '') AS p FROM j JOIN u USING (page_id) WHERE url LIKE '%://%'
), e AS (
  SELECT DISTINCT a.node AS src, b.node AS dst FROM n a JOIN (SELECT p, min(url) AS url FROM n JOIN u USING (page_id) WHERE p <> '' GROUP BY p) l USING (p)
  JOIN u ON u.url = l.url JOIN n b ON b.page_id = u.page_id
), walk AS (
  SELECT node, node AS seen FROM n
  UNION
  SELECT walk.node, CASE WHEN e.src = walk.seen THEN e.dst ELSE e.src END FROM walk JOIN e ON walk.seen IN (e.src, e.dst)
), c AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
g AS (
  SELECT component, bool_or(ruled = 'allow') AS allows, bool_or(ruled = 'block') AS blocks FROM c JOIN n USING (node) JOIN j USING (page_id) GROUP BY component
)
SELECT j.page_id, host, path, rule, coalesce(ruled, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN n USING (page_id) LEFT JOIN c USING (node) LEFT JOIN g USING (component)
"""
