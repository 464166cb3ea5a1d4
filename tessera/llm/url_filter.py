"""URL filters with redirect equivalence, in DataFrame functions only.

Rules allow or block a host with its subdomains, from a path on. The longest
rule that fits a URL gives its verdict. A URL that no rule fits takes part in
redirect equivalence: pages and the targets of their canonical links and meta
refresh redirects (and of further redirect edges, if given) are one component;
if any address of the component is allowed by a rule, its aliases are allowed;
else if any is blocked, they are blocked. Without either they are allowed.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Written, connected_components, read

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Rules up to this number are sent to all executors; more are joined by shuffling.
SMALL_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    front = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.locate("/", front)
    return F.coalesce(F.when(at > 0, F.substring(front, at, F.length(front))).otherwise(F.lit("")), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def judged(urls: DataFrame, rules: DataFrame, store: Written, *, rule_count: int | None = None) -> DataFrame:
    """urls (host, path, ...) with rule and rule_verdict of the longest rule that fits; null without one.

    Distinct (host, path) pairs are matched, so that a hot host costs as many rows
    as it has paths. Of rules equal in host and path, block wins.
    """
    n = rules.count() if rule_count is None else rule_count
    side = rules.groupBy(F.col("host").alias("__h"), F.col("path").alias("__p")).agg(F.max("verdict").alias("__v"))
    side = F.broadcast(side) if n <= SMALL_RULES else side
    keys = urls.select("host", "path").distinct()
    fits = keys.withColumn("__h", F.explode(suffixes(F.col("host")))).join(side, "__h").where(F.col("path").startswith(F.col("__p")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct((F.length("__h") + F.length("__p")).alias("n"), F.concat("__h", "__p").alias("rule"), F.col("__v").alias("verdict"))).alias("b"))
    # Written, as what is joined by component below: a join with plain exchanges on both sides can be split where a key is hot.
    best = store.write(best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("rule_verdict")))
    return urls.join(best, ["host", "path"], "left")


def link_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): a page's URL and the target of each canonical link or meta refresh in its HTML.

    HTML entities in targets are decoded. Relative targets are resolved against
    the page's URL, which needs a scheme and host for that; addresses are
    compared without fragments.
    """
    html = F.col(html_col)
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*+>)"), 1), lambda t: F.lower(t).rlike(r"\brel\s*=\s*[\"']?canonical\b"))
    canonical = F.transform(links, lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*+>)"), 1), lambda t: F.lower(t).rlike(r"http-equiv\s*=\s*[\"']?refresh"))
    refresh = F.transform(metas, lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    likely = F.lower(html).rlike(r"canonical|http-equiv")
    found = pages.where(likely).select(F.col(url_col).alias("url"), F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("to")).where("to <> '' and url is not null")
    # Step by step, and past a generator, so that the plan holds each long expression once.
    found = found.withColumn("to", _decoded(F.col("to")))
    found = found.withColumn("to", _resolved(F.col("to"), F.col("url")))
    edge = F.array(F.struct(address(F.col("url")).alias("u"), address(F.col("to")).alias("v")))
    return found.select(F.explode(F.filter(edge, lambda e: e["v"].isNotNull() & (e["u"] != e["v"]))).alias("e")).select("e.u", "e.v")


def _decoded(text: Column) -> Column:
    """Text with its HTML entities (those of HTML 4 by name, any by number) replaced, once."""
    entity = r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
    names = F.create_map(*(F.lit(x) for name, code in {**name2codepoint, "apos": 39}.items() for x in (f"&{name};", chr(code))))

    def plain(e):
        number = F.when(F.lower(e).startswith("&#x"), F.conv(F.regexp_extract(e, "([0-9A-Fa-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, "([0-9]+);", 1)).try_cast("int")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        known = F.when(e.startswith("&#"), F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(names, e))
        return F.coalesce(known, e)

    pieces = F.zip_with(F.split(text, entity, -1), F.regexp_extract_all(text, F.lit(f"({entity})"), 1), lambda a, e: F.concat(a, F.coalesce(plain(e), F.lit(""))))
    return F.when(F.instr(text, "&") > 0, F.array_join(pieces, "")).otherwise(text)


def _resolved(to: Column, url: Column) -> Column:
    """A link's target as a URL; null for other schemes, and where url cannot be a base."""
    base = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    path = F.regexp_extract(F.substring(url, F.length(base) + F.lit(1), F.length(url)), r"^([^?#]*)", 1)
    front = F.regexp_extract(to, r"^([^?#]*)", 1)
    rest = F.substring(to, F.length(front) + F.lit(1), F.length(to))
    whole = F.when(front == "", path).when(front.startswith("/"), front).otherwise(F.concat(F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1)), front))
    # Segments . and .. go.
    steps = F.slice(F.split(F.regexp_replace(whole, r"(^|/)(\.\.?)$", "$1$2/"), "/", -1), 2, F.length(whole) + F.lit(2))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    whole = F.when((front != "") & whole.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(whole)
    absolute = to.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*)?://")
    return F.when(absolute, to).when(to.startswith("#"), url).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (base == ""), F.lit(None)).when(to.startswith("//"), F.concat(F.substring_index(url, ":", 1), F.lit(":"), to)).otherwise(F.concat(base, whole, rest))


def address(url: Column) -> Column:
    """A URL as redirect equivalence compares it: scheme and host lower-cased, no fragment."""
    plain = F.substring_index(url, "#", 1)
    return F.when(F.instr(plain, "://") > 0, F.concat(F.translate(F.substring_index(plain, "://", 1), UPPER, LOWER), F.lit("://"), host_of(plain), F.substring(_rest(plain), F.length(host_of(plain)) + F.lit(1), F.length(plain)))).otherwise(plain)


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, component) of each row of pages.

    redirects: (u, v) URLs that lead from one to another, besides the links in
    html_col. component is null where a URL has no alias. A null URL, or one
    without ://, has an empty host and path; no rule fits it and it is allowed.
    Null HTML has no links. Repeated rows stay; other columns are ignored.
    """
    spark = pages.sparkSession
    store = Written(spark)
    rules = rules_frame(spark) if rules is None else rules
    n = rules.count()
    edges = None if html_col is None else link_edges(pages, url_col=url_col, html_col=html_col)
    if redirects is not None:
        more = redirects.select(address(F.col("u")).alias("u"), address(F.col("v")).alias("v"))
        edges = more if edges is None else edges.union(more)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = judged(rows, rules, store, rule_count=n)
    if edges is None:
        edges = spark.createDataFrame([], "u string, v string")
    # Written, so that the long expressions of links are evaluated once.
    edges = store.write(edges.where("u is not null and v is not null"))
    comps = store.write(connected_components(edges, store))
    named = judged(comps.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules, store, rule_count=n)
    # Explicit allow goes before block.
    decided = store.write(named.groupBy("component").agg(F.min("rule_verdict").alias("passed_on")))
    known = comps.join(decided, "component").select(F.col("node").alias("__node"), "component", "passed_on")
    out = own.join(known, address(F.col("url")) == F.col("__node"), "left").withColumn("verdict", F.coalesce("rule_verdict", "passed_on", F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "component")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))
