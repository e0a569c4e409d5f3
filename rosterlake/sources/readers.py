"""Files in and out: tolerant JSON, XML nodes, job pages, spreadsheets as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web

JOB_POSTING = "struct<title:string,datePosted:string,validThrough:string,description:string,hiringOrganization:struct<name:string>>"


def read_cache(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON lines; unreadable files are skipped."""
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path).filter("trim(value) <> ''")
    x = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.select(x.alias("x"))
    return parsed.filter("x._bad is null").select("x.*").drop("_bad"), parsed.filter("x._bad is not null").select("x._bad")


def read_rules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A rule file: one JSON document with a list `rules`."""
    return spark.read.schema(f"rules array<{schema}>").option("multiLine", "true").json(path).select(F.explode("rules").alias("r")).select("r.*")


def unwrapped_items(payload: Column, item: str) -> Column:
    """The items of a JSON reply under items, candidates or data.items, the first that is there."""
    schema = f"struct<items:array<{item}>,candidates:array<{item}>,data:struct<items:array<{item}>>>"
    x = F.from_json(payload, schema)
    return F.coalesce(x["items"], x["candidates"], x["data"]["items"])


def xml_attributes(xml: Column, tag: str, attribute: str) -> Column:
    """An attribute's values over all elements of a tag, in order."""
    return F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(rf'<(?:\w+:)?{tag}\b[^>]*?\b{attribute}="([^"]*)"'), F.lit(1))


def job_posting(html: Column) -> Column:
    """A page's job posting: its JSON-LD first, else its title."""
    x = F.from_json(web.json_ld(html), JOB_POSTING)
    return F.struct(F.coalesce(x["title"], F.nullif(web.page_title(html), F.lit(""))).alias("title"), x["datePosted"].alias("posted"), x["validThrough"].alias("expires"), x["hiringOrganization"]["name"].alias("company"))


def write_table(rows: DataFrame, path: str) -> None:
    """Rows for a spreadsheet as CSV: lists joined by line ends, control characters out, no cell that a spreadsheet would run as a formula."""

    def cell(name: str, kind: str) -> Column:
        text = F.array_join(name, "\n") if kind.startswith("array") else F.col(name).cast("string")
        text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
        return (F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text) if kind == "string" or kind.startswith("array") else text).alias(name)

    rows.select(*(cell(n, k) for n, k in rows.dtypes)).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def backup(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def restore(store: DataFrame, saved: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(store, counts): saved rows of unknown keys are added; counts has added and skipped."""
    fresh = saved.join(store, key, "left_anti")
    known = saved.join(store, key, "left_semi")
    counts = fresh.agg(F.count("*").alias("added")).crossJoin(known.agg(F.count("*").alias("skipped")))  # one row each
    return store.unionByName(fresh, allowMissingColumns=True), counts
