"""URL filters with redirect equivalence.

Rules are (host, path prefix, verdict); a rule fits its host and all subdomains where the URL's path
starts with the rule's, and the longest rule wins. A URL's own rule always decides. URLs without a rule
are judged by their aliases: pages that redirect to each other, or name each other as canonical, form
connected components, found by distributed contraction. Every member, page or link end, is judged by the
host and path of its own address as written; a component with a blocked member is blocked, unless a rule
explicitly allows one of its members: explicit allow takes precedence. Everything else is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import connected_components, kept_columns, looked_up, prepare, quoted, written

#: (host, path, verdict), the rules that queries use.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A registry of rules is compiled into expressions, so it is bounded.
MOST_RULES = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_url(url: Column) -> Column:
    """The name under which addresses are one: host, path (an empty one is /) and query, without scheme and fragment; null without ://."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule like ``net/``, verdict) of the longest fitting rule; both null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are compiled into one expression")
    # the longest rule: most of its host and path together; of equal ones the longer host, then alphabetical
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, (h, p, v) in reversed(list(zip(fits, ordered, strict=True))):
        name, verdict = F.when(cond, h + p).otherwise(name), F.when(cond, v).otherwise(verdict)
    return name, verdict


#: Where pages state their canonical address or where they redirect to: fixed patterns; group 1 is the address.
LINK_PATTERNS = (
    r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<meta\b(?=[^>]*\bproperty\s*=\s*["']?og:url\b)[^>]*?\bcontent\s*=\s*["']?([^"'\s>]+)""",
)


def absolute(target: Column, base: Column) -> Column:
    """target resolved against the page's address: absolute, //host, /path or relative."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): redirect and canonical links of pages, as absolute addresses. Whole documents are read."""
    url = F.col(quoted(url_col))
    found = reduce(F.concat, [F.coalesce(F.regexp_extract_all(F.col(quoted(html_col)), F.lit(p), 1), F.array()) for p in LINK_PATTERNS])
    links = pages.select(url.alias("source"), F.explode(found).alias("__uf_to"))
    return links.select("source", absolute(F.col("__uf_to"), F.col("source")).alias("target"))


def filter_urls(pages: DataFrame, rules=RULES, links: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``links`` (source, target) adds redirects known from elsewhere, as from a crawl log. URLs that appear
    only as a link's end take part: their own rules count for the component, as do those of all pages
    in it. A null URL or one without :// has an empty host and path, no rule and no alias, and is
    allowed. Of rules of equal length the longer host, then the alphabetically first wins. Repeated rows
    are judged alike; input columns named like the results are replaced. An empty table gives no rows.
    """
    spark = prepare(pages.sparkSession)
    url = F.col(quoted(url_col))
    edges = links.select("source", "target") if links is not None else None
    if html_col is not None:
        own = alias_links(pages, url_col, html_col)
        edges = own if edges is None else edges.unionByName(own)
    if edges is None:
        edges = spark.createDataFrame([], "source string, target string")
    edges = edges.select("source", "target", normal_url(F.col("source")).alias("a"), normal_url(F.col("target")).alias("b"))
    edges = written(edges.where("a IS NOT NULL AND b IS NOT NULL").distinct(), "url-links")
    names = kept_columns(pages, {"host", "path", "rule", "verdict"})
    row = F.struct(*[F.col(quoted(c)).alias(c) for c in names]).alias("__uf_row") if names else F.struct(F.lit(1).alias("__uf_none")).alias("__uf_row")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = lambda df: df.withColumn("host", host_of(F.col("__uf_url"))).withColumn("path", path_of(F.col("__uf_url"))).withColumns({"rule": rule, "own": verdict})
    base = judged(pages.select(row, url.alias("__uf_url"))).withColumn("node", normal_url(F.col("__uf_url")))

    # addresses are numbered, so that no two share a node
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    ends = written(ends.withColumn("number", F.monotonically_increasing_id()), "url-nodes")
    numbered = edges.select("a", "b").distinct().join(ends.select(F.col("node").alias("a"), F.col("number").alias("x")), "a").join(ends.select(F.col("node").alias("b"), F.col("number").alias("y")), "b")
    labels = connected_components(numbered.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("number"), "label")
    # all that a component needs is two flags, so a hot address or component is summed before it is shuffled
    flags = [F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed")]
    said = judged(edges.select(F.col("source").alias("__uf_url"), F.col("a").alias("node")).union(edges.select("target", "b")))
    said = said.select("node", "own").unionByName(base.select("node", "own")).where("own IS NOT NULL").groupBy("node").agg(*flags)
    member = ends.join(labels, "number").join(said, "node", "left").select("node", "label", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("blocked", "allowed")])
    member = written(member, "url-members")
    component = member.groupBy("label").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed")).where("blocked AND NOT allowed").select("label")
    blocked = written(member.join(component, "label", "left_semi").select("node", F.lit(True).alias("__uf_blocked")), "url-blocked")
    out = looked_up(base, blocked, "node", 300)
    return out.select("__uf_row.*" if names else F.lit(None).alias("__uf_none"), "host", "path", "rule", F.coalesce("own", F.when(F.col("__uf_blocked"), "block"), F.lit("allow")).alias("verdict")).drop("__uf_none")
