"""URL filters with redirect equivalence (native).

Rules (host, path) fit a host and all its subdomains where the url's path starts with the rule's; the longest rule
wins. Urls that no rule fits get the method's verdict: redirect and canonical-link edges join urls to classes by
distributed connected components, and a class with a blocked url and no explicitly allowed one is blocked as a whole.

Cases: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; a null page text has
no links; relative links are resolved against the page's <base> or url, and those without a host (mailto: and such) are left
out; repeated pages each get a row; an empty table gives no
rows; without edges every class is a single url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, let

#: (rule, verdict); a rule is a host, then a path from its first slash.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what stands after the first "://" up to / ? # or the end; then up to ? # or the end."""
    rest = F.when(url.contains("://"), F.substring_index(url, "://", 1)).otherwise(None)
    tail = F.substr(url, F.length(rest) + 4)
    host = F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits. Ties go to allow."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[1] == "allow")):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def node(url: Column) -> Column:
    """The url as a node: host in lower case, path and query; neither scheme nor fragment. Null without a host."""
    host, _ = parts(url)
    tail = F.regexp_extract(F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, tail))


def decoded(c: Column) -> Column:
    """Character references of HTML that urls hold: the named ones of markup, and numbers."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))

    def put(text: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"([0-9A-Fa-f]+);", 1)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.when(valid, F.replace(text, ref, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise(text)

    refs = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)"), F.lit(1)))
    return F.replace(F.aggregate(refs, c, put), F.lit("&amp;"), F.lit("&"))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'\s>]+)", 1)


def links(html: Column) -> Column:
    """Targets of canonical links and of refresh redirects in a page; attributes stand in any order."""
    canonical = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), F.lit(1))
    refresh = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), F.lit(1))
    after = lambda t: F.regexp_extract(t, r"(?is)\bcontent\s*=.*?url\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = F.concat(F.transform(canonical, lambda t: decoded(_attribute(t, "href"))), F.transform(refresh, lambda t: decoded(after(t))))
    return F.when(html.rlike(r"(?i)rel\s*=\s*[\"']?canonical|http-equiv\s*=\s*[\"']?refresh"), found)


def base_of(url: Column, html: Column) -> Column:
    """What a page's relative links are resolved against: its <base>, else its own url."""
    href = decoded(_attribute(F.regexp_extract(html, r"(?is)(<base\b[^>]*\bhref\b[^>]*>)", 1), "href"))
    return F.when(html.rlike(r"(?i)<base\b"), F.coalesce(let(href, lambda t: resolve(url, t)), url)).otherwise(url)


def _without_dots(path: Column) -> Column:
    """A path from its first slash, with its . and .. segments worked out."""
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    segments = let(F.split(path, "/", -1), lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.array().cast("array<string>"), step))
    end = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return let(segments, lambda kept: F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, end).otherwise(F.lit(""))))


def resolve(base: Column, target: Column) -> Column:
    """An absolute url for a link, by the rules of RFC 3986; null for other schemes, and for a base without a host."""
    scheme = F.substring_index(base, "://", 1)
    host, path = parts(base)
    root = F.concat(scheme, F.lit("://"), host)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.substr(target, F.length(own) + 1)
    query = F.regexp_extract(F.substr(base, F.length(scheme) + 4), r"(?s)^[^/?#]*[^?#]*([^#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (host == ""), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, _without_dots(own), rest))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.startswith("#"), F.concat(root, path, query, target))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, own)), rest))
    )


def judge(pages: DataFrame, scratch: Scratch, redirects: DataFrame | None = None, rules=RULES, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page. redirects(source, target) adds edges between urls."""
    url = F.col(url_col)
    host, path = parts(url)
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    cols = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"), links(F.col(html_col)).alias("links"), F.col(html_col).alias("html"))
    found = cols.where("size(links) > 0").select("url", base_of(F.col("url"), F.col("html")).alias("base"), F.explode("links").alias("l")).select("url", let(F.col("base"), lambda b: resolve(b, F.col("l"))).alias("target"))
    if redirects is not None:
        found = found.union(redirects.select("source", "target"))
    ends = found.select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b")
    ends = scratch.save(ends.distinct(), "edges")
    judged = cols.select("page_id", "host", "path", "url", rule.alias("rule"), verdict.alias("said"))
    if ends.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"))
    classes = connected_components(ends, scratch)
    at = F.concat(F.lit("x://"), F.col("node"))
    h, p = parts(at)
    own = classes.select("node", "component", matched(h, p, rules)[1].alias("own"))
    said = own.groupBy("component").agg(
        F.max(F.coalesce(F.col("own") == "block", F.lit(False))).alias("block"), F.max(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("allow")
    )
    blocked = own.join(said.where("block and not allow"), "component").select(F.col("node").alias("blocked")).distinct()
    out = judged.join(blocked, node(F.col("url")) == F.col("blocked"), "left")
    method = F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark))


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, url,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages
), q AS (
  SELECT page_id, html, url,
    translate(regexp_extract(coalesce(tail, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(tail, ''), '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(tail, ''), '^[^/?#]*([^#]*)', 1) AS rest
  FROM p
), links AS (
  SELECT host || rest AS a, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag, host FROM q WHERE host <> ''
), targets AS (
  SELECT a, host, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM links
  UNION ALL
  SELECT host || rest, host, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*?url\s*=\s*["'']?([^"''\s>]+)', 1)) FROM q WHERE host <> ''
), ends AS (
  SELECT a, CASE WHEN contains(t, '://') THEN substr(t, strpos(t, '://') + 3) WHEN t[1:2] = '//' THEN t[3:] WHEN t[1:1] = '/' THEN host || t END AS t FROM targets
), edges AS (
  SELECT a, translate(regexp_extract(t, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '^[^/?#]*([^#]*)', 1) AS b
  FROM ends WHERE regexp_extract(t, '^([^/?#]*)', 1) <> ''
), reach AS (
  SELECT a AS s, a AS n FROM (SELECT a FROM edges UNION SELECT b FROM edges)
  UNION
  SELECT r.s, CASE WHEN r.n = e.a THEN e.b ELSE e.a END FROM reach r JOIN edges e ON r.n = e.a OR r.n = e.b
), hosts AS (
  SELECT page_id, host, path, host || rest AS key FROM q
  UNION ALL
  SELECT NULL, regexp_extract(n, '^([^/?#]*)', 1), regexp_extract(n, '^[^/?#]*([^?#]*)', 1), n FROM (SELECT DISTINCT n FROM reach)
), rules(rule, name, prefix, said) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
    ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), fits AS (
  SELECT h.page_id, h.key, h.host, h.path, r.rule, r.said, length(r.rule) AS n FROM hosts h JOIN rules r
    ON (h.host = r.name OR ends_with(h.host, '.' || r.name)) AND starts_with(h.path, r.prefix)
), best AS (
  SELECT host, path, max_by(rule, n) AS rule, max_by(said, n) AS said FROM fits GROUP BY host, path
), classes AS (
  SELECT r.s, bool_or(b.said = 'block') AND NOT coalesce(bool_or(b.said = 'allow'), false) AS blocked
  FROM reach r JOIN best b ON b.host = regexp_extract(r.n, '^([^/?#]*)', 1) AND b.path = regexp_extract(r.n, '^[^/?#]*([^?#]*)', 1) GROUP BY r.s
)
SELECT q.page_id, q.host, q.path, b.rule, coalesce(b.said, CASE WHEN c.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN best b ON b.host = q.host AND b.path = q.path LEFT JOIN classes c ON c.s = q.host || q.rest
"""
