"""URL filters: longest-prefix rules, carried to aliases along redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh
from .components import connected_components

Rule = tuple[str, str, str]  # verdict, host, path

#: Query parameters that only track the visitor; a url without them is its canonical form.
TRACKING = ("utm_[a-z]+", "ref", "gclid", "fbclid")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits.

    A rule fits its host and all subdomains if the path starts with its own. Length is
    that of host and path together; of equally long ones allow wins, then the smaller.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    rule = verdict = None
    for (v, h, p), fit in zip(order, fits, strict=True):
        rule = F.when(fit, h + p) if rule is None else rule.when(fit, h + p)
        verdict = F.when(fit, v) if verdict is None else verdict.when(fit, v)
    none = F.lit(None).cast("string")
    return (none if rule is None else rule), (none if verdict is None else verdict)


def canonical_form(url: Column) -> Column:
    """https, host in lower case, no fragment, no tracking parameters, no ? or & at the end, and an empty path for /."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    bare = F.regexp_replace(bare, r"(?<=[?&])(?:" + "|".join(TRACKING) + r")=[^&]*(?:&|$)", "")
    bare = F.regexp_replace(bare, r"[?&]+$", "")
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("https://"), url_host(url), F.when(rest != "/", rest).otherwise(""))).otherwise(url)


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved; .. at the top is dropped."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    parts = F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/", -1)
    return F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step), "/")


def resolved(target: Column, base: Column) -> Column:
    """An absolute url from a link target and the url of its page; null for an empty target, a fragment or a page without ://."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url_path(base), r"(?s)^(.*/)", 1)
    own, query = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(\?.*)$", 1)
    path = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(target.contains("://"), target))
        .when(site == "", F.lit(None))
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(own == "", F.concat(site, url_path(base), query))
        .otherwise(F.concat(site, without_dots(path), query))
    )


def _named_link(html: Column, tag: str, mark: str, value: str, base: Column) -> Column:
    """The url in the first <tag> that holds mark, resolved against its page's; null if there is none."""
    found = F.regexp_extract(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*{mark}[^>]*>", 0), value, 1)
    return resolved(F.replace(F.trim(found), F.lit("&amp;"), F.lit("&")), base)


def link_edges(pages: DataFrame, *, url: str = "url", html: str | None = "html") -> DataFrame:
    """(src, dst): url to its canonical form, to its rel=canonical link and to its meta-refresh target."""
    u = F.col(url)
    targets = [canonical_form(u)]
    if html and html in pages.columns:
        h = F.col(html)
        link = F.when(F.lower(h).contains("canonical"), _named_link(h, "link", r"rel\s*=\s*[\"']?canonical", r"(?is)href\s*=\s*[\"']?([^\"'\s>]+)", u))
        move = F.when(F.lower(h).contains("refresh"), _named_link(h, "meta", r"http-equiv\s*=\s*[\"']?refresh", r"(?is)url\s*=\s*[\"']?([^\"'\s>;]+)", u))
        targets += [canonical_form(link), canonical_form(move)]
    return (
        pages.select(u.alias("src"), F.explode(F.array_compact(F.array(*targets))).alias("dst"))
        .where("src is not null and src <> dst")
    )


def url_filter(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    redirects: DataFrame | None = None,
    url: str = "url",
    html: str | None = "html",
) -> DataFrame:
    """Every row and column of pages plus host, path, rule and verdict (allow or block).

    A page under a rule takes the rule's verdict. Of the others, those are blocked that
    reach a url blocked by a rule over redirect and canonical edges, unless a url that a
    rule allows is among the same aliases: an explicit allow outweighs any block that
    arrives by propagation. redirects: further (src, dst) urls, judged by the rules even
    where no page has them.

    Null urls and urls without :// have empty host and path, fit no rule, have no alias
    and are allowed. Repeated urls are judged alike. Columns of pages that clash with the
    new names keep theirs; the new ones then end in an underscore. An empty table gives
    an empty one. Only urls with an edge to another url enter the component rounds; a hot
    canonical url is a hot key of equi-joins and partial aggregations only.
    """
    host, path, rule, verdict = (fresh(pages, c) for c in ("host", "path", "rule", "verdict"))
    rows = pages.withColumn(host, url_host(F.col(url))).withColumn(path, url_path(F.col(url)))
    r, v = best_rule(F.col(host), F.col(path), rules)
    rows = rows.withColumn(rule, r).withColumn(verdict, v)

    edges = link_edges(pages, url=url, html=html)
    if redirects is not None:
        a, b = redirects.columns[:2]
        edges = edges.unionByName(redirects.select(F.col(a).alias("src"), F.col(b).alias("dst")))
    aliases = connected_components(edges)
    _, judged = best_rule(url_host(F.col("node")), url_path(F.col("node")), rules)
    blocked = (
        aliases.withColumn("judged", judged)
        .groupBy("component")
        .agg(F.max(F.col("judged") == "block").alias("b"), F.max(F.col("judged") == "allow").alias("a"))
        .where("b and not coalesce(a, false)")
        .select("component")
    )
    node = fresh(rows, "alias_node")
    hit = aliases.join(blocked, "component", "left_semi").select(F.col("node").alias(node))
    out = rows.join(hit, rows[url] == F.col(node), "left")
    decided = F.coalesce(F.col(verdict), F.when(F.col(node).isNotNull(), "block").otherwise("allow"))
    return out.withColumn(verdict, decided).drop(node)
