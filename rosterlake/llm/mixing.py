"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's documents are to appear at a mean rate (target share of the output /
its number of documents). Each document draws its number of copies from a
Poisson distribution of that mean by inverting the cumulative distribution at a
uniform number that a seeded hash of its id gives: no state, no coordination,
the same on every run. Copies then go to places in a global order by hash.

At scale: one pass over the source column counts the sources; the rate table
is broadcast if it is small (checked), else joined with salted keys, so a
source with a third of all rows is no hot key; the only shuffle of texts is the
global one, dealt by a hash of (id, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Most rows of the rate table that are broadcast, and most numbers in them (about rate + 10 * sqrt(rate) + 30 a row, 8 bytes each).
BROADCAST_SOURCES, BROADCAST_NUMBERS = 10_000, 1 << 20
SALTS = 64


def _draw(*parts: Column) -> Column:
    """A whole number under 2**52 from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 1, 13), 16, 10).cast("long")


def _name(row_id: Column, text: Column) -> Column:
    """What a row draws by: its id, or where that is null its text."""
    return F.coalesce(row_id.cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def rates(docs: DataFrame, targets: DataFrame | None = None, *, source_col: str = "source", alpha: float = 0.5, scale: float = 1.0) -> DataFrame:
    """(source, n_docs, rate): the mean number of copies of each document of a source.

    targets: (source, weight), weights of any sum; sources that it lacks or
    gives no positive weight get rate 0. Without it a source of n documents
    weighs n ** alpha. The output has scale * all documents on average. A null
    source is a source like any other.
    """
    counted = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    if targets is None:
        weighed = counted.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha))))
    else:
        t = targets.groupBy(F.col("source").alias("t_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighed = counted.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").select("source", "n_docs", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    weighed = settle(weighed)
    total = weighed.agg(F.sum("weight").alias("w"), F.sum("n_docs").alias("n")).first()
    if not total.n or not total.w:
        return weighed.select("source", "n_docs", F.lit(0.0).alias("rate"))
    return weighed.select("source", "n_docs", (F.col("weight") / F.lit(float(total.w)) * F.lit(float(total.n)) * F.lit(float(scale)) / F.col("n_docs")).alias("rate"))


def poisson_mix(docs: DataFrame, targets: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", alpha: float = 0.5, scale: float = 1.0, seed: int = 7) -> DataFrame:
    """All columns of `docs` with copy (1, 2, ...) and shuffle_key, in the global order of shuffle_key within hash partitions.

    A document of rate r appears k times with the Poisson probability of k for
    mean r; k = 0 leaves it out, as the operator is meant to.

    A row of null id draws by its text; repeated rows (one id, or none and one
    text) draw the same number. A null source is a source of its own; null and
    empty texts of any length are copied like others; columns named like the
    operator's own (copy, shuffle_key) are replaced; other columns are kept.
    Empty table: no rows.
    """
    rated = rates(docs, targets, source_col=source_col, alpha=alpha, scale=scale)
    top = F.ceil(F.col("rate") + 10 * F.sqrt("rate") + 30).cast("int")
    chance = F.transform(F.sequence(F.lit(0), top), lambda k: F.exp(k * F.log("rate") - F.col("rate") - F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.log(F.greatest(i, F.lit(1)).cast("double")))))
    cdf = F.aggregate(chance, F.array(F.lit(0.0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + p)))
    table = settle(rated.filter("rate > 0").select(F.col("source").alias("__source"), F.slice(cdf, 2, top + 1).alias("__cdf")))
    rows = docs.drop("copy", "shuffle_key")
    match = rows[source_col].eqNullSafe(F.col("__source"))
    size = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("__cdf")), F.lit(0)).alias("numbers")).first()
    own = _name(F.col(id_col), F.col(text_col))
    if size.rows <= BROADCAST_SOURCES and size.numbers <= BROADCAST_NUMBERS:
        joined = rows.join(F.broadcast(table), match)
    else:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(own), F.lit(SALTS)))
        copies = table.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, salted[source_col].eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__salt2")))
    u = (_draw(F.lit(seed), own) + F.lit(0.5)) / F.lit(float(1 << 52))
    times = F.size(F.filter("__cdf", lambda c: c < u))
    drawn = joined.withColumn("__times", times).filter("__times > 0").select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("copy"))
    placed = drawn.withColumn("shuffle_key", _draw(F.lit(seed), own, F.col("copy")))
    return placed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS n, sum(sqrt(n)) AS w FROM c),
r AS (SELECT source, sqrt(c.n) / t.w * t.n / c.n AS rate FROM c, t),
p AS (SELECT source, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 30)::BIGINT + 1)) AS k, rate FROM r),
f AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
l AS (SELECT source, list(cdf) AS cdf FROM f GROUP BY source),
d AS (SELECT d.*, len(list_filter(l.cdf, lambda x: x < (('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)) AS times
  FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1))::INT AS copy FROM d)
SELECT *, ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, ''))) || '|' || copy), 1, 13))::BIGINT AS shuffle_key FROM e
"""
