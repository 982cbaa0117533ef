"""URL filters with rules by host and path, and decisions shared by redirect-equivalent pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solarweave.operators.components import connected_components
from solarweave.storage import joined_back, stored

#: Fixed values of the query: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or holds no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of rule and verdict: the longest that fits the host or a parent of it, and the path's
    beginning; of two as long allow comes first. Null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def alias_key(host: Column, path: Column, query: Column, customs: bool = False) -> Column:
    """What names a page: host, path and query. With customs, pages that sites redirect to each other
    by custom are one: the host loses a leading www., the path slashes at its end."""
    if customs:
        host, path = F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")
    return F.concat(host, path, query)


def query_of(url: Column) -> Column:
    """The query of a url with its ?, up to # or the end; empty if it has none."""
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), F.lit(""))


def folded(path: Column) -> Column:
    """A path without its . and .. segments, as a browser resolves it."""
    steps = F.slice(F.split(path, "/", -1), 2, 1 << 20)
    step = lambda out, x: F.when(x == "..", F.regexp_replace(out, "/[^/]*$", "")).when(x == ".", out).otherwise(F.concat(out, F.lit("/"), x))
    return F.concat(F.aggregate(steps, F.lit(""), step), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))


def resolved(target: Column, base: Column) -> Column:
    """A link's target as a full url, from the url of the page or of its <base>.

    With a scheme it stays; // keeps the base's scheme, / its host, ? its path, # is the base
    itself; anything else starts in the folder of the base's path. Then . and .. are folded.
    """
    scheme, root = F.regexp_extract(base, r"^([^:/?#]+:)", 1), F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    page, rest = F.regexp_extract(base, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    path = F.regexp_extract(target, r"^([^?#]*)", 1)
    own = F.regexp_replace(F.substring(page, F.length(root) + 1, F.length(page)), "[^/]*$", "")
    full = (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("/"), F.concat(root, folded(path), rest))
        .when(target.startswith("?"), F.concat(page, target)).when(target.startswith("#"), F.concat(page, query_of(base)))
    )
    return full.otherwise(F.concat(root, folded(F.concat(F.when(own == "", F.lit("/")).otherwise(own), path)), rest))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or bare, with &amp; and the like read; empty if the tag lacks it."""
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    bare = F.trim(F.regexp_replace(found, "^[\"']|[\"']$", ""))
    for name_of, mark in (("&quot;", '"'), ("&#39;", "'"), ("&#x2F;", "/"), ("&#47;", "/"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name_of), F.lit(mark))
    return bare


def links(pages: DataFrame, url: str = "url", html: str = "html", customs: bool = False) -> DataFrame:
    """(a, b, host, path) for each canonical link and each refresh redirect in a page: from its key to its target's.

    Canonical is any <link> with that word among its rel; a refresh is a <meta> with http-equiv.
    Targets are resolved against the page's <base>, if it has one, and its url; other schemes than
    http and https are left out, as are pages without host.
    """
    u, body = F.col(f"`{url}`"), F.col(f"`{html}`")
    some = pages.filter(body.rlike("(?i)canonical|http-equiv")).select(u.alias("u"), F.regexp_extract(body, r"(?is)<base\b[^>]*>", 0).alias("base"), F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)).alias("tag"))
    canonical = F.when(F.concat(F.lit(" "), F.lower(_attribute(F.col("tag"), "rel")), F.lit(" ")).rlike(r"\scanonical\s"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.trim(F.regexp_replace(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*(.*)$", 1), "^[\"']|[\"']$", "")))
    host, path = parts(F.col("u"))
    base = _attribute(F.col("base"), "href")
    some = some.select("u", alias_key(host, path, query_of(F.col("u")), customs).alias("a"), F.when(base != "", resolved(base, F.col("u"))).otherwise(F.col("u")).alias("base"), F.coalesce(canonical, refresh).alias("to"), host.alias("h"))
    some = some.filter("to <> '' and h <> ''").withColumn("to", resolved(F.col("to"), F.col("base"))).filter(F.col("to").rlike("(?i)^https?://"))
    host, path = parts(F.col("to"))
    return some.select("a", alias_key(host, path, query_of(F.col("to")), customs).alias("b"), host.alias("host"), path.alias("path"))


def judged(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, customs: bool = False) -> DataFrame:
    """Each row's key, host, path, rule and verdict.

    A page that a rule fits has its verdict. Any other is blocked if a page or link target
    that redirects or canonical links connect with it, over any number of steps and in either
    direction, is blocked by a rule and none is allowed by one; else it is allowed. Pages
    without host connect with nothing and are allowed. Pages of one host, path and query are one
    in the graph, http or https; customs joins more (see alias_key). Null html has no links.
    Repeated rows come out repeated; an empty table gives an empty result.

    Only (key, flag) pairs are grouped, with map-side combining, and what is joined back has
    each key once and is written first, so a host or target that very many pages share is no
    hot spot.
    """
    u = F.col(f"`{url}`")
    host, path = parts(u)
    rows = pages.select(F.col(f"`{key}`").alias("k"), host.alias("host"), path.alias("path"), query_of(u).alias("query"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", F.when(F.col("host") != "", alias_key(F.col("host"), F.col("path"), F.col("query"), customs)))
    edges = stored(links(pages, url, html, customs).distinct(), "edges")
    labels = stored(connected_components(edges.select("a", "b")), "labels")
    targets = edges.select(F.col("b").alias("node"), rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict"))
    ruled = rows.select("node", F.col("r.verdict").alias("verdict")).union(targets).filter("verdict is not null and node is not null").distinct()
    ruled = ruled.join(labels, "node", "left").select(F.coalesce("component", "node").alias("group"), "verdict")
    blocking = ruled.groupBy("group").agg(F.max("verdict").alias("most"), F.min("verdict").alias("least")).filter("least = 'block' and most = 'block'").select("group", F.lit("block").alias("shared"))
    open_rows = joined_back(rows.filter("r is null").join(labels, "node", "left").withColumn("group", F.coalesce("component", "node")), blocking, "group", "left")
    done = rows.filter("r is not null").select("k", "host", "path", "r.rule", "r.verdict")
    left = open_rows.select("k", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("shared", F.lit("allow")).alias("verdict"))
    return done.union(left).withColumnRenamed("k", key)
