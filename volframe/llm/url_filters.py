"""URL block and allow rules, spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import read

#: (verdict, host, path). A rule fits its host and all hosts below it, where the url's path starts with the rule's.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    """(rule_verdict, rule_host, rule_path, rule) of rules given as tuples; larger lists come as a table of this form."""
    rows = spark.createDataFrame(list(rules), "rule_verdict string, rule_host string, rule_path string")
    return rows.withColumn("rule", F.concat("rule_host", "rule_path"))


def match_rules(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, rule_verdict) of each row's longest fitting rule; rows that no rule fits are absent.

    urls has `key` (unique), host and path. A url meets a rule by equality of a host suffix and of a path prefix, as
    long as some path of that host's rules; so one host with very many rules costs a url one lookup a path length.
    Rules of the same length: the first in text order wins, allow before block.
    """
    best = rules.groupBy("rule_host", "rule_path", "rule").agg(F.min("rule_verdict").alias("rule_verdict"))
    lengths = best.groupBy("rule_host").agg(F.collect_set(F.char_length("rule_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select(key, "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    fits = F.filter("lengths", lambda n: n <= F.char_length("path"))
    tries = hosts.select(key, "path", "rule_host", F.explode(fits).alias("n")).select(key, "rule_host", F.expr("substring(path, 1, n)").alias("rule_path"))
    order = F.struct(-F.char_length("rule"), F.col("rule"))
    return tries.join(best, ["rule_host", "rule_path"]).groupBy(key).agg(F.min_by("rule", order).alias("rule"), F.min_by("rule_verdict", order).alias("rule_verdict"))


_DOTS = r"(^|/)\.\.?(/|$)"


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, with its . and .. segments worked off; there is nothing above the root."""
    segments = F.split(F.expr("substring(_path, 2)"), "/")
    folded = F.aggregate(segments, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(path.rlike(_DOTS), F.concat(F.lit("/"), F.array_join(ends, "/"))).otherwise(path)


def normal(df: DataFrame, url: str, name: str) -> DataFrame:
    """df with column `name`: the url as equal urls are written. Scheme and host in lower case, without the scheme's own port
    and without a fragment; an empty path is /, and . and .. are worked off. A url without a scheme stays as it is."""
    scheme = F.translate(F.regexp_extract(url, r"^([^:/?#]+)://", 1), UPPER, LOWER)
    split = df.withColumns({"_scheme": scheme, "_host": host_of(F.col(url)), "_path": path_of(F.col(url)), "_query": F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)})
    split = split.withColumn("_host", F.when(F.col("_scheme") == "http", F.regexp_replace("_host", ":80$", "")).when(F.col("_scheme") == "https", F.regexp_replace("_host", ":443$", "")).otherwise(F.col("_host")))
    split = split.withColumn("_path", F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path")))
    whole = F.concat("_scheme", F.lit("://"), "_host", _without_dots(F.col("_path")), "_query")
    return split.withColumn(name, F.when(F.col("_scheme") != "", whole).otherwise(F.col(url))).drop("_scheme", "_host", "_path", "_query")


def links(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and where each of its canonical links and refresh redirects points, both as normal() writes them.

    All tags of the page count. A target is taken as a browser takes it: absolute, without a scheme, from the root, with
    another query, or relative to the page, &amp; standing for &. Targets of other kinds (mailto: and the like), fragments of
    the page itself, and pages without url or html give no link.
    """
    tags = lambda kind, what: F.filter(F.regexp_extract_all("html", F.lit(rf"(?is)<{kind}\b[^>]*>"), F.lit(0)), lambda t: t.rlike(what))
    target = lambda found, name: F.transform(found, lambda t: F.regexp_extract(t, rf"(?is)\b{name}\s*=\s*[\"']?([^\"'\s>]+)", 1))
    canonical = target(tags("link", r"(?is)\brel\s*=\s*[\"']?canonical\b"), "href")
    refresh = target(tags("meta", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"), "url")
    scheme, root, folder = (F.regexp_extract("url", p, 1) for p in (r"^([^:/?#]+:)//", r"^([^:/?#]+://[^/?#]*)", r"^[^:/?#]+://[^/?#]*([^?#]*/)"))
    found = pages.where(F.col("url").contains("://") & F.col("html").isNotNull()).select("url", F.explode(F.concat(canonical, refresh)).alias("to"))
    found = found.withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    to = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, "to"))
        .when(F.col("to").startswith("/"), F.concat(root, "to"))
        .when(F.col("to").startswith("?"), F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), "to"))
        .when((F.col("to") == "") | F.col("to").startswith("#") | F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), "to"))
    )
    absolute = found.select("url", to.alias("to")).where("to IS NOT NULL")
    return normal(normal(absolute, "url", "a"), "to", "b").select("a", "b").where("a <> b")


def filter_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame, key: str = "page_id") -> DataFrame:
    """key, host, path, rule and verdict (allow or block) of every page.

    A url that a rule fits has the rule's verdict. Any other takes that of its equivalence class: the connected
    component of its url over edges (a, b), redirects and canonical links, between urls as normal() writes them. A class
    with an explicitly allowed url allows; else one with a blocked url blocks; else, and for urls without links, the
    verdict is allow. Urls in edges that are no page count too. Null keys, null urls and repeated rows are judged like
    any others.
    """
    own = normal(pages.select(key, "url"), "url", "_url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    classes = connected_components(edges, "a", "b").withColumnRenamed("node", "url")
    split = classes.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    known = match_rules(split, rules, "url")
    decided = (
        classes.join(known, "url")
        .groupBy("component")
        .agg(F.min("rule_verdict").alias("class_verdict"))  # allow sorts before block
    )
    aliases = classes.join(decided, "component").select(F.col("url").alias("_url"), "class_verdict")
    places = own.select("host", "path").distinct().withColumn("place", F.struct("host", "path"))
    matched = match_rules(places, rules, "place").select(F.col("place.host").alias("host"), F.col("place.path").alias("path"), "rule", "rule_verdict")
    return own.join(matched, ["host", "path"], "left").join(aliases, "_url", "left").select(key, "host", "path", "rule", F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict"))


def op4(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return filter_urls(pages, rule_table(spark), links(pages))


ORACLE = r"""
WITH RECURSIVE rules(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
tags AS (SELECT url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b')), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS t0
  FROM pages WHERE contains(url, '://') AND html IS NOT NULL),
raw AS (SELECT url, replace(t0, '&amp;', '&') AS t, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS root, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*/)', 1) AS dir FROM tags),
abs AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN t LIKE '//%' THEN regexp_extract(url, '^([^:/?#]+:)//', 1) || t WHEN t LIKE '/%' THEN root || t WHEN t LIKE '?%' THEN regexp_extract(url, '^([^?#]*)', 1) || t
    WHEN t = '' OR t LIKE '#%' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE root || CASE WHEN dir = '' THEN '/' ELSE dir END || t END AS t FROM raw),
parts AS (SELECT u, lower(regexp_extract(u, '^([^:/?#]+)://', 1)) AS scheme, translate(coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS query FROM (SELECT url AS u FROM pages WHERE url IS NOT NULL UNION SELECT t FROM abs WHERE t IS NOT NULL)),
segs AS (SELECT *, string_split(substring(path, 2), '/') AS sg FROM parts),
norm AS (SELECT u, CASE WHEN scheme = '' THEN u ELSE scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
    || CASE WHEN path = '' THEN '/' WHEN NOT regexp_matches(path, '(^|/)\.\.?(/|$)') THEN path
       ELSE '/' || array_to_string(list_concat(list_reduce(list_prepend([]::VARCHAR[], list_transform(sg, lambda x: [x])), lambda a, x: CASE WHEN x[1] = '..' THEN list_slice(a, 1, greatest(len(a) - 1, 0)) WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END),
         CASE WHEN sg[-1] IN ('.', '..') THEN [''] ELSE [] END), '/') END || query END AS n FROM segs),
edges AS (SELECT DISTINCT x.n AS a, y.n AS b FROM abs JOIN norm x ON x.u = abs.url JOIN norm y ON y.u = abs.t WHERE x.n <> y.n),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(x, y) AS (SELECT a, a FROM both_ways UNION SELECT x, b FROM reach JOIN both_ways ON y = a),
classes AS (SELECT x AS url, min(y) AS component FROM reach GROUP BY x),
places AS (SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM (SELECT url FROM pages UNION SELECT url FROM classes)),
judged AS (SELECT url, host, path, (SELECT min_by({'r': h || p, 'v': v}, {'n': -length(h || p), 'r': h || p, 'v': v}) FROM rules WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p)) AS best FROM places),
decided AS (SELECT component, min(best.v) AS v FROM classes JOIN judged USING (url) GROUP BY component)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, d.v, 'allow') AS verdict
FROM pages p JOIN judged j ON p.url IS NOT DISTINCT FROM j.url LEFT JOIN norm n ON n.u = p.url LEFT JOIN classes c ON c.url = n.n LEFT JOIN decided d USING (component)"""
