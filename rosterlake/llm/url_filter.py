"""URL filters with redirect equivalence.

Rules decide the urls that they fit. Redirects and canonical links make urls
aliases of each other; distributed connected components over those edges give
each url its group, and a block decision on one alias reaches the aliases that
no rule fits, unless an explicit allow stands in the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components

#: (host, path, action) of the production query.
RULES: tuple[tuple[str, str, str], ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Most rules in one expression; more are joined by host suffix.
INLINE_RULES = 200
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tags that name another url of a page, where they name it, and & as an entity.
_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF, _URL = (rf"(?is)\b{x}\s*=\s*[\"']?([^\"'\s>]*)" for x in ("href", "url"))
_AMP = "(?i)&(amp|#38|#x26);"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _SMALL), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _plain(path: Column) -> Column:
    """A path without . and .. segments; an empty one is /."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    folder = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path == "", "/").when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"), folder)).otherwise(path)


def _node(url: Column) -> Column:
    """What names a page: its url without scheme and fragment, host in lower case, path without dot segments; null where there is no host."""
    host, path = host_and_path(url)
    path = _plain(path)
    query = F.regexp_extract(F.substr(url, F.instr(url, "://") + F.lit(3)), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host != "", F.concat(host, path, F.coalesce(query, F.lit(""))))


def _target(base: Column, href: Column) -> Column:
    """href as an absolute url; base: the page's url."""
    host, path = host_and_path(base)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(F.trim(href) == "", F.lit(None).cast("string"))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(F.lit("http://"), host, href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^[#?]"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("http://"), host, folder, href))
    )


def page_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) urls of all canonical links and meta refreshes in the pages' HTML, & written as an entity read as such."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    links = F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(0))
    metas = F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(0))
    hrefs = F.concat(F.transform(links, lambda t: F.regexp_extract(t, _HREF, 1)), F.transform(metas, lambda t: F.regexp_extract(t, _URL, 1)))
    found = pages.select(F.col(url_col).alias("src"), F.explode(hrefs).alias("href")).filter("href <> ''")
    return found.select("src", _target(F.col("src"), F.regexp_replace("href", _AMP, "&")).alias("dst"))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    rules: (host, path, allow or block), as a short list or a DataFrame of
    host, path, action. A rule fits its host and subdomains where the path
    starts with its path; the longest wins, of equal ones the allowing one.
    redirects: (src, dst) urls besides the edges in the HTML. Without a rule
    of its own a page is blocked if its alias group holds a url that a rule
    blocks and none that a rule allows, pages or not; else allowed.

    A null url or one without `://` has empty host and path, fits no rule, has
    no aliases and is allowed; null HTML has no links; long ones are read whole.
    Urls are aliases where they differ in scheme, fragment, . and .. segments or
    an empty path only. Repeated rows stay; other columns are ignored, whatever
    their names. Ties cannot differ in the result. Empty table: no rows.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), _node(F.col(url_col)).alias("node"))
    if not isinstance(rules, DataFrame) and len(rules) > INLINE_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "host string, path string, action string")
    decided = _decided(rows, rules)
    edges = []
    if html_col is not None:
        edges.append(page_edges(pages, url_col=url_col, html_col=html_col))
    if redirects is not None:
        edges.append(redirects.select("src", "dst"))
    links = None
    for e in edges:
        e = e.select(_node(F.col("src")).alias("a"), _node(F.col("dst")).alias("b")).filter("a is not null and b is not null and a <> b")
        links = e if links is None else links.union(e)
    own = decided.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    if links is None:
        return own
    groups = components(links)
    if groups.isEmpty():
        return own
    # Rows without a key get one that meets nothing, so that they do not all go to one task.
    alone = F.concat(F.lit("\x01"), F.xxhash64("page_id", "host", "path").cast("string"))
    grouped = decided.withColumn("node", F.coalesce("node", alone)).join(groups, "node", "left").withColumn("root", F.coalesce("root", alone))
    ends = _decided(groups.select("root", F.regexp_extract("node", "^[^/]*", 0).alias("host"), F.regexp_extract("node", "^[^/]*([^?]*)", 1).alias("path")), rules)
    held = ends.filter("action is not null").groupBy("root").agg(F.max(F.col("action") == "block").alias("blocks"), F.max(F.col("action") == "allow").alias("allows"))
    told = F.when(F.coalesce("blocks", F.lit(False)) & ~F.coalesce("allows", F.lit(False)), "block").otherwise("allow")
    return grouped.join(held, "root", "left").select("page_id", "host", "path", "rule", F.coalesce("action", told).alias("verdict"))


def _decided(rows: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Rows of (host, path, ...) with the rule that fits and its action."""
    if isinstance(rules, DataFrame):
        return _joined_rules(rows, rules)
    rule = action = F.lit(None).cast("string")
    for h, p, a in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", r[0])):
        fits = _fits(F.col("host"), F.col("path"), F.lit(h), F.lit(p))
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(a)).otherwise(action)
    return rows.select("*", rule.alias("rule"), action.alias("action"))


def _joined_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules met by equality on host suffixes; each distinct (host, path) is looked up once, hot suffixes are split by salt."""
    salts = 32
    r = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "action").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    places = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    asked = places.select("host", "path", suffix.alias("r_host"), F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"))
    met = asked.join(r, ["r_host", "salt"]).filter(F.col("path").startswith(F.col("r_path")))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), (F.col("action") == "allow").alias("allow"), F.concat("r_host", "r_path").alias("rule"), "action")).alias("x"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "x.rule", "x.action")
    return rows.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").drop("b_host", "b_path")


def _sql() -> str:
    up = f"'{_UPPER}', '{_SMALL}'"
    rest = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), {up})"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({rest}, '^[^?#]*(\\?[^#]*)?', 1)"
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    f = lambda x, u: x.format(u=u)
    # One segment after another, as a walk over folders, with a slash kept at the end of a folder.
    walk = "list_reduce([[]::VARCHAR[]] || list_transform(string_split(path, '/')[2:], lambda x: [x]), lambda a, b: CASE WHEN b[1] = '..' THEN a[:greatest(len(a) - 1, 0)] WHEN b[1] = '.' THEN a ELSE a || b END)"
    node = f"CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' WHEN contains(path, '/.') THEN '/' || array_to_string({walk}, '/') || CASE WHEN regexp_matches(path, '/\\.\\.?$') THEN '/' ELSE '' END ELSE path END || query END"
    node = f"CASE WHEN host <> '' AND contains(path, '/.') AND len({walk}) = 0 THEN host || '/' || query ELSE {node} END"
    q = lambda x: x.replace("'", "''")
    return f"""
WITH RECURSIVE rules(r_host, r_path, action) AS (VALUES {rules}),
p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
n AS (SELECT page_id, html, {f(host, 'url')} AS host, {f(path, 'url')} AS path, {f(query, 'url')} AS query FROM p),
m AS (SELECT *, {node} AS node FROM n),
d AS (SELECT page_id, any_value(host) AS host, any_value(path) AS path, any_value(node) AS node, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
        arg_max(action, length(r_host || r_path)) AS action
      FROM m LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id),
t AS (SELECT host, path, node, unnest(regexp_extract_all(html, '{q(_CANONICAL)}')) AS tag FROM m
      UNION ALL SELECT host, path, node, unnest(regexp_extract_all(html, '{q(_REFRESH)}')) FROM m),
h AS (SELECT host, path, node, regexp_replace(CASE WHEN starts_with(tag, '<l') OR starts_with(tag, '<L') THEN regexp_extract(tag, '{q(_HREF)}', 1) ELSE regexp_extract(tag, '{q(_URL)}', 1) END, '{_AMP}', '&', 'g') AS href FROM t),
a AS (SELECT node AS src, CASE WHEN trim(href) = '' THEN NULL WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
        WHEN starts_with(href, '//') THEN 'http:' || href WHEN starts_with(href, '/') THEN 'http://' || host || href
        WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:|^[#?]') THEN NULL
        ELSE 'http://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || href END AS dst FROM h),
b AS (SELECT src, {f(host, 'dst')} AS host, {f(path, 'dst')} AS path, {f(query, 'dst')} AS query FROM a WHERE dst IS NOT NULL),
e AS (SELECT src AS x, {node} AS y FROM b),
l AS (SELECT x, y FROM e WHERE x IS NOT NULL AND y IS NOT NULL UNION SELECT y, x FROM e WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT x AS node, x AS other FROM l UNION SELECT r.node, l.y FROM r JOIN l ON r.other = l.x),
v AS (SELECT x, regexp_extract(x, '^[^/]*', 0) AS host, regexp_extract(x, '^[^/]*([^?]*)', 1) AS path FROM (SELECT DISTINCT x FROM l)),
u AS (SELECT x, arg_max(action, length(r_host || r_path)) AS action FROM v JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY x),
g AS (SELECT r.node, max(u.action = 'block') AS blocks, max(u.action = 'allow') AS allows FROM r JOIN u ON u.x = r.other GROUP BY r.node)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN coalesce(blocks, false) AND NOT coalesce(allows, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM d LEFT JOIN g ON d.node = g.node
"""


ORACLE_SQL = _sql()
