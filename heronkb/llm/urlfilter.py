"""URL filters: rules on host and path, and block decisions that reach redirect and canonical aliases.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
follows up to ``?``, ``#`` or the end; without ``://`` both are empty. A rule fits its host and all
subdomains if the path starts with the rule's path, and the longest fitting rule decides. Pages without
a rule get the decision of their aliases: URLs are joined in classes by canonical links and by redirects
(meta refresh), targets that were never crawled included, whose own rules count too, and with ``spellings`` (the default) by usual respellings (scheme, ``www.`` or
``m.``, fragment, tracking parameters, trailing slash). In a class with a blocked member the others are
blocked, unless a member is allowed by a rule; an own rule always stands.

Edge cases: a null URL, or one without ``://``, fits no rule, joins no class and is allowed; null html
has no links; repeated rows and ids stay; empty tables give no rows; other columns are ignored.

Scale: decisions are made once for each distinct URL. Rules are found by an equi-join on (host suffix,
path prefix of a length that some rule has), never by comparing all rules with all URLs. Classes come
from distributed connected components. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are sent to all tasks up to so many bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20

#: The contract's rules: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_URL = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def spelling(url: Column) -> Column:
    """One spelling for the URLs that usual redirects make equal; the URL itself without ``://``."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.rlike(r"^(?:utm_\w+|fbclid|gclid)(?:=|$)") & (x != "")), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))).otherwise(url)


def _absolute(target: Column, url: Column) -> Column:
    scheme = F.substring_index(url, "://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(url), r"^[^/?#]*", 0))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(site, target)).otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))


def alias_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst: the canonical links and the redirects that a page names."""
    u, h = F.col(url), F.col(html)
    named_by = lambda tag, part: F.transform(F.regexp_extract_all(h, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, part, 1))
    named = pages.where(h.isNotNull() & (F.instr(u, "://") > 0)).select(
        u.alias("src"),
        F.explode(F.concat(named_by(_LINK, _HREF), named_by(_META, _URL))).alias("target"),
    )
    target = F.replace(F.col("target"), F.lit("&amp;"), F.lit("&"))
    return named.where("target <> ''").select("src", _absolute(target, F.col("src")).alias("dst"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, host, path with the longest fitting rule and its verdict, else null. ``urls`` holds distinct URLs."""
    sizes = [r.n for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]  # lengths, not rules
    many = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()[0] > BROADCAST_BYTES
    keyed = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("verdict").alias("verdict"))  # of equal rules, allow
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sizes] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    tries = urls.where("host <> ''").select("url", F.explode(suffixes).alias("rule_host"), starts.alias("starts")).select("url", "rule_host", F.explode("starts").alias("rule_path"))
    hits = tries.join(keyed if many else F.broadcast(keyed), ["rule_host", "rule_path"])
    text = F.concat("rule_host", "rule_path")
    best = hits.groupBy("url").agg(F.max_by(F.struct(text.alias("rule"), "verdict"), F.struct(F.length(text), F.length("rule_host"))).alias("best"))
    return urls.join(best.select(F.col("url").alias("ruled"), "best.rule", F.col("best.verdict").alias("ruling")), F.col("url") == F.col("ruled"), "left").drop("ruled")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html", spellings: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each page row. ``edges`` (src, dst) add to those in the html."""
    spelt = spelling if spellings else lambda x: x
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    links = alias_edges(pages, url=url, html=html)
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst"))
    classes = connected_components(links.select(spelt(F.col("src")).alias("src"), spelt(F.col("dst")).alias("dst")))
    urls = rows.select("url").unionByName(links.select(F.col("dst").alias("url"))).distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = match_rules(urls, rules).withColumn("spelt", spelt(F.col("url")))
    known = ruled.join(classes, F.col("spelt") == F.col("node"), "left").withColumn("class", F.coalesce("component", "spelt"))
    spread = known.where("ruling is not null").groupBy("class").agg((F.max(F.col("ruling") == "block") & ~F.max(F.col("ruling") == "allow")).alias("blocked")).where("blocked").select(F.col("class").alias("blocked"))
    decided = known.join(spread, F.col("class") == F.col("blocked"), "left").select("url", "host", "path", "rule", F.coalesce("ruling", F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")).alias("verdict"))
    return rows.join(decided, "url").select("page_id", "host", "path", "rule", "verdict")


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns, under its rules."""
    rules = pages.sparkSession.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge(pages, rules)


def with_aliases(pages: DataFrame) -> DataFrame:
    """The pages, of which most also name another: by a canonical link, an absolute or relative redirect, or one never crawled.

    For the query that shows decisions which only aliases make; ``ALIAS_PAGES`` is the same in SQL.
    """
    to = lambda k: F.concat(F.lit("http://mirror"), (F.col("page_id") % k).cast("string"), F.lit(".example.org/es/"), (F.col("page_id") / 5).cast("bigint").cast("string"))
    kind = F.col("page_id") % 6
    tag = (
        F.when(kind == 0, F.concat(F.lit("<link rel='canonical' href='"), to(3), F.lit("'>")))
        .when(kind == 1, F.concat(F.lit('<META http-equiv="refresh" content="0; url=\''), to(3), F.lit("'\">")))
        .when(kind == 2, F.concat(F.lit('<link href="/moved/'), (F.col("page_id") / 6).cast("bigint").cast("string"), F.lit('" rel="canonical"><link rel=canonical href=next>')))
        .when(kind == 3, F.concat(F.lit("<meta http-equiv=refresh content='5;url=//alias.example.com/en/"), (F.col("page_id") % 9).cast("string"), F.lit("?a=1&amp;b=2'>")))
        .when(kind == 4, F.lit("<link rel='stylesheet' href='http://mirror1.example.org/es/1'>"))
        .otherwise(F.lit(""))
    )
    return pages.withColumn("html", F.concat(F.coalesce(F.col("html"), F.lit("")), tag))


def alias_digest(pages: DataFrame) -> DataFrame:
    """``digest`` over pages that name each other."""
    return digest(with_aliases(pages))


ALIAS_PAGES = r"""(SELECT page_id, url, coalesce(html, '') || CASE page_id % 6
  WHEN 0 THEN '<link rel=''canonical'' href=''http://mirror' || (page_id % 3) || '.example.org/es/' || (page_id // 5) || '''>'
  WHEN 1 THEN '<META http-equiv="refresh" content="0; url=''http://mirror' || (page_id % 3) || '.example.org/es/' || (page_id // 5) || '''">'
  WHEN 2 THEN '<link href="/moved/' || (page_id // 6) || '" rel="canonical"><link rel=canonical href=next>'
  WHEN 3 THEN '<meta http-equiv=refresh content=''5;url=//alias.example.com/en/' || (page_id % 9) || '?a=1&amp;b=2''>'
  WHEN 4 THEN '<link rel=''stylesheet'' href=''http://mirror1.example.org/es/1''>'
  ELSE '' END AS html FROM pages)"""


def sql(pages: str = "pages") -> str:
    """The same by SQL, with a recursive reach over aliases. For small tables."""
    quoted = lambda x: x.replace("'", "''")
    return rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (SELECT page_id, coalesce(url, '') AS url, html FROM {pages}),
rests AS (SELECT DISTINCT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM p),
sites AS (SELECT url, regexp_extract(rest, '^[^/?#]*', 0) AS site, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM rests),
q AS (SELECT page_id, url, html, site, path FROM p JOIN sites USING (url)),
named AS (SELECT url, substr(url, 1, strpos(url, '://') - 1) AS scheme, site, regexp_replace(path, '[^/]*$', '') AS folder, replace(unnest(list_concat(
    list_transform(regexp_extract_all(html, '{quoted(_LINK)}'), lambda x: regexp_extract(x, '{quoted(_HREF)}', 1)),
    list_transform(regexp_extract_all(html, '{quoted(_META)}'), lambda x: regexp_extract(x, '{quoted(_URL)}', 1)))), '&amp;', '&') AS t FROM q WHERE html IS NOT NULL AND strpos(url, '://') > 0),
links AS (SELECT url AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN scheme || '://' || site || t
            ELSE scheme || '://' || site || CASE WHEN folder = '' THEN '/' ELSE folder END || t END AS b FROM named WHERE t <> ''),
seen AS (SELECT b AS url FROM links UNION SELECT url FROM q),
parts AS (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM seen),
u AS (SELECT url, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM parts),
spelt AS (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '')
            || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_\w+|fbclid|gclid)(=|$)')), '&'), ''), '') ELSE url END AS s FROM u),
fits AS (SELECT u.url, r.host || r.path AS rule, r.verdict, length(r.host || r.path) AS n FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)),
best AS (SELECT url, max_by(rule, n) AS rule, max_by(verdict, n) AS ruling FROM fits GROUP BY url),
ends_ AS (SELECT x.s AS a, y.s AS b FROM links JOIN spelt x ON x.url = links.a JOIN spelt y ON y.url = links.b),
both_ways AS (SELECT a, b FROM ends_ UNION SELECT b, a FROM ends_),
reach(a, b) AS (SELECT DISTINCT s, s FROM spelt UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
class_of AS (SELECT spelt.url, c.class FROM spelt JOIN (SELECT a, min(b) AS class FROM reach GROUP BY a) c ON c.a = spelt.s),
flags AS (SELECT class, bool_or(ruling = 'block') AND NOT bool_or(ruling = 'allow') AS blocked FROM best JOIN class_of USING (url) GROUP BY class)
SELECT page_id, u.host, u.path, rule, coalesce(ruling, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM q JOIN u USING (url) JOIN class_of USING (url) LEFT JOIN best USING (url) LEFT JOIN flags USING (class)
"""
