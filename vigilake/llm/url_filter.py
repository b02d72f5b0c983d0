"""URL filters with redirect equivalence (operator 6, native).

A url is split into host and path by plain string functions. Rules name a host suffix and a path prefix; the
longest rule that fits decides. Urls without a rule take the decision of their alias group: the connected
component over redirect edges (meta refresh) and canonical-link edges found in the pages, plus any edges
given. In a group, an explicit allow of any member goes before blocks of others; a url's own rule always stands. Urls that
differ in their fragments only are one url there. Tags are read in order, so what stands in comments, in scripts and other raw
text, or in another tag's quoted attributes is no tag.

Of rules of equal length that fit, the greatest by text (host and path together) and then by decision stands. Rules are
compiled into one conditional expression when there are few, and joined by host suffix otherwise, with the same results.

Defined results: a null url or one without "://" has an empty host and path, no rule, no aliases, and is allowed;
repeated rows each give a row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.components import connected_components
from vigilake.session import broadcast_if_small

#: Up to so many rules are one expression; more are joined.
COMPILED = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.substr(rest, F.length(host) + 1)


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """pages (host, path, row) with rule and decision (null without one). rules: (verdict, host, path prefix)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame) and len(rules) <= COMPILED:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for decision, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), (r[1] + r[2]).encode(), r[0])):
            fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
            rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
        return pages.withColumns({"rule": rule, "decision": verdict})
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "decision string, host string, path string")
    ranked = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "decision")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = pages.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    fit = hosts.join(broadcast_if_small(ranked), "suffix").where(F.col("path").startswith(F.col("prefix")))
    text = F.concat("suffix", "prefix")
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), text.alias("rule"), F.col("decision"))).alias("x"))
    best = best.select("host", "path", F.col("x.rule").alias("rule"), F.col("x.decision").alias("decision"))
    return pages.join(best, ["host", "path"], "left")


#: Characters that urls in attributes may have as references, with their names; & comes last, so that nothing is decoded twice.
REFERENCES = {'"': "quot", "'": "apos", "<": "lt", ">": "gt", **dict.fromkeys("/:?=;"), "&": "amp"}


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once and not repeated in the plan."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _attribute(tag: Column, name: str) -> Column:
    """The attribute's value, quoted or not, references decoded and outer blanks removed; empty without one."""
    value = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)", 1)
    value = F.regexp_replace(value, r"(?s)\A([\"'])(.*)\1\z", "$2")
    for c, named in REFERENCES.items():
        value = F.regexp_replace(value, rf"&(?:{f'{named}|' if named else ''}#0*{ord(c)}|#[xX]0*(?i:{ord(c):x}));", c)
    return F.regexp_replace(F.regexp_replace(value, r"\A\s+|\s+\z", ""), r"[\t\n\r]", "")


def resolve(url: Column, ref: Column) -> Column:
    """The url that ref names in a page at url; null if ref is empty, of a scheme without "://", or url has no "://"."""
    return _bound(url, lambda u: _bound(ref, lambda r: _resolved(u, r)))


def _resolved(url: Column, ref: Column) -> Column:
    part = lambda x, i: F.regexp_extract(x, r"(?s)\A([^:/?#]+:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?\z", i)
    origin, path = F.concat(part(url, 1), part(url, 2)), part(url, 3)
    own, tail = (F.regexp_extract(ref, r"(?s)\A([^?#]*)(.*)\z", i) for i in (1, 2))
    folder = F.regexp_extract(F.concat(path, F.when(path == "", "/").otherwise("")), r"(?s)\A(.*/)", 1)
    whole = F.concat(F.when(own.startswith("/"), "").otherwise(folder), own)
    # . and .. go, a last one leaves its slash
    steps = F.split(F.regexp_replace(whole, r"(?s)(/\.\.?)\z", "$1/"), "/")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
    kept = _bound(steps, lambda all_: F.aggregate(F.slice(all_, 2, F.size(all_)), F.array(F.lit("")), lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))))
    named = (
        F.when(ref.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), F.when(ref.rlike(r"\A[^:]+://"), ref))
        .when(ref.startswith("//"), F.concat(part(url, 1), ref))
        .when(ref.startswith("?"), F.concat(origin, path, ref))
        .when(ref.startswith("#"), F.concat(origin, path, part(url, 4), ref))
        .otherwise(F.concat(origin, F.array_join(kept, "/"), tail))
    )
    return F.when(url.contains("://") & (ref != ""), named)


#: Comments, elements whose content is text, and tags with their quoted attributes, each as a whole.
_ATTRIBUTES = r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>"
TOKENS = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style|title|textarea|xmp|iframe|noembed|noframes)(?=[\s/>]){_ATTRIBUTES}.*?(?:</\1(?=[\s/>])|\z)|</?[a-z]{_ATTRIBUTES}"


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) between a page's url and what its canonical links and meta refreshes name, resolved against its base or url."""
    held = F.filter(F.regexp_extract_all(F.col(html_col), F.lit(TOKENS), F.lit(0)), lambda t: t.rlike(r"(?is)\A<(?:(?:link|meta)[\s/].*(?:canonical|refresh)|base[\s/].*href)"))
    is_base = lambda t: t.rlike(r"(?i)\A<base")

    def named(t):
        canonical = t.rlike(r"(?i)\A<link") & F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")
        refresh = t.rlike(r"(?i)\A<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh")
        # a time, then the target with or without url= before it, in quotes of its own or not
        target = F.regexp_extract(_attribute(t, "content"), r"(?is)\A(?:[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?|.*?\burl\s*=\s*)(.*)\z", 1)
        bare = lambda x: F.when(x.rlike(r"\A[\"']"), F.regexp_extract(x, r"(?s)\A([\"'])(.*?)(?:\1|\z)", 2)).otherwise(x)
        return F.when(canonical, _attribute(t, "href")).when(refresh, _bound(target, bare))

    def resolved(tags):
        base = resolve(F.col(url_col), _attribute(F.coalesce(F.get(F.filter(tags, is_base), F.lit(0)), F.lit("")), "href"))
        return _bound(F.coalesce(base, F.col(url_col)), lambda at: F.transform(F.filter(tags, lambda t: ~is_base(t)), lambda t: without_fragment(resolve(at, named(t)))))

    # all inside one expression, which is not repeated as a filter on its result would repeat it
    targets = _bound(held, lambda tags: F.filter(resolved(tags), lambda b: b.isNotNull()))
    found = pages.where(F.col(html_col).rlike(r"(?i)canonical|http-equiv") & F.col(url_col).contains("://"))
    return found.select(without_fragment(F.col(url_col)).alias("a"), F.explode(targets).alias("b"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """id_col, host, path, rule, verdict, alias_of (the least url of the alias group, without fragment; null without aliases). redirects: more edges (a, b)."""
    host, path = host_and_path(F.col(url_col))
    own = with_rule(pages.select(F.col(id_col), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")), rules)
    edges = page_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        more = redirects.select(*(without_fragment(F.col(c)).alias(n) for c, n in zip(redirects.columns, "ab", strict=True)))
        edges = more if edges is None else edges.union(more)
    if edges is None:
        return own.select(id_col, "host", "path", "rule", F.coalesce("decision", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_of"))
    groups = connected_components(edges)
    # a group's decision also counts members that are no page themselves (the targets of links)
    host, path = host_and_path(F.col("node"))
    members = with_rule(groups.select("node", "component", host.alias("host"), path.alias("path")), rules)
    decided = members.groupBy("component").agg(F.min("decision").alias("group_decision"))  # "allow" is the lesser
    of_url = groups.join(decided, "component").select(F.col("node").alias("url"), F.col("component").alias("alias_of"), "group_decision")
    out = own.withColumn("url", without_fragment(F.col("url"))).join(of_url, "url", "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("decision", "group_decision", F.lit("allow")).alias("verdict"), "alias_of")
