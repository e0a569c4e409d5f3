"""Aliases over a generated page graph against the SQL on a second engine and a plain search."""

from __future__ import annotations

import random

import duckdb

from rosterlake.llm import url_filter
from rosterlake.llm.url_filter import url_verdicts


def canonical(*hrefs: str) -> str:
    return "<html>" + "".join(f'<link href="{h}" rel=canonical>' for h in hrefs) + "</html>"


def refresh(href: str) -> str:
    return f'<meta http-equiv="refresh" content="3;url={href}">'


def graph() -> list[tuple[int, str | None, str | None]]:
    """Chains, a star, cycles, several links in one page, entities, dot segments, and pages without host or links."""
    rng = random.Random(2)
    rows: list[tuple[int, str | None, str | None]] = []
    add = lambda url, html: rows.append((len(rows), url, html))
    for k in range(30):  # a chain that ends at a blocked page
        add(f"http://c.org/{k}", canonical(f"/{k + 1}"))
    add("http://c.org/30", refresh("http://x.net/fr/end"))
    add("https://x.net/fr/end", None)
    for k in range(60):  # a star round one blocked page
        add(f"http://s{k}.org/", canonical("http://x.net/es/hub?a=1&amp;b=2"))
    add("http://x.net/es/hub?a=1&b=2", "")
    for k in range(5):  # a cycle with an allowed and a blocked page
        add(f"http://y{k}.org/p", refresh(f"http://y{(k + 1) % 5}.org/p"))
    add("http://y0.org/p", canonical("http://b.com/", "http://x.net/es/1"))
    add("http://b.com", None)
    add("http://x.net/es/1", None)
    add("http://d.org/a/b/c", canonical("../../t/./u/.."))  # /t/
    add("http://d.org/t/", canonical("//x.net/./fr/q/../z"))
    add("http://x.net/fr/z#part", "")
    add("http://e.org", canonical("http://x.net/es/2"))
    add("http://e.org/", None)
    add("http://f.org/..", canonical("http://x.net/es/3"))
    add("http://f.org", "")
    add(None, canonical("http://x.net/es/3"))
    add("no host", canonical("http://x.net/es/3"))
    add("http://long.org/", "<p>" + "x" * 200_000 + canonical("http://x.net/es/4"))
    for k in range(200):
        add(f"http://r{rng.randrange(40)}.org/{k}", canonical(f"http://r{rng.randrange(40)}.org/{rng.randrange(260)}") if rng.random() < 0.5 else "")
    add("http://r1.org/250", canonical("http://x.net/fr/1"))
    return rows


def test_aliases_equal_the_sql(spark):
    rows = graph()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    cursor = con.execute(url_filter.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, (dict(sorted(zip(names, r, strict=True))) for r in cursor.fetchall())))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_verdicts(df.selectExpr("*", "1 AS node", "'z' AS root", "2 AS action", "'q' AS host"))
    assert sorted(str(dict(sorted(r.asDict().items()))) for r in got.collect()) == want
    blocked = {r.page_id for r in got.filter("rule is null and verdict = 'block'").collect()}
    by_url = {u: k for k, u, _ in rows}
    assert {by_url[f"http://c.org/{k}"] for k in range(31)} <= blocked
    assert {by_url[f"http://s{k}.org/"] for k in range(60)} <= blocked
    assert {by_url[u] for u in ("http://d.org/a/b/c", "http://d.org/t/", "http://e.org", "http://e.org/", "http://f.org/..", "http://f.org", "http://long.org/")} <= blocked
    assert not {by_url[f"http://y{k}.org/p"] for k in range(5)} & blocked  # an allow stands in their group
    assert by_url[None] not in blocked and by_url["no host"] not in blocked


def test_components_of_a_large_star(spark):
    from rosterlake.llm.common import components

    hub = spark.range(50_000).selectExpr("id + 1 AS a", "0L AS b").union(spark.range(100).selectExpr("-id - 1 AS a", "id * 7 AS b"))
    got = components(hub)
    assert got.count() == 50_101 and {r.root for r in got.select("root").distinct().collect()} == {-100}
