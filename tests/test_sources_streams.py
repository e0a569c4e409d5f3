"""Sources, sinks and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rosterlake.sources import readers
from rosterlake.sources.rest import OffsetSource
from rosterlake.streaming import jobs as streams


def fetch_pages(offset: int, limit: int) -> list[dict]:
    return [{"id": k, "name": f"n{k}"} for k in range(offset, min(offset + limit, 57))]


def test_offset_source(spark):
    spark.dataSource.register(OffsetSource)
    read = spark.read.format("offset").schema("id int, name string").option("pages", "tests.test_sources_streams:fetch_pages").option("page_size", "10").option("key", "id")
    assert read.load().count() == 57
    ranged = read.option("total", "57").option("range", "20").load()
    assert ranged.rdd.getNumPartitions() == 3
    assert sorted(r.id for r in ranged.collect()) == list(range(57))


def test_json_cache(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\nnot json\n{"k": 2}\n')
    rows, bad = readers.read_cache(spark, str(tmp_path), "k int")
    assert sorted(r.k for r in rows.collect()) == [1, 2] and [r._bad for r in bad.collect()] == ["not json"]
    (tmp_path / "rules.txt").write_text(json.dumps({"rules": [{"country": "x"}, {"country": "y"}]}))
    assert readers.read_rules(spark, str(tmp_path / "rules.txt"), "struct<country:string>").count() == 2


def test_pages_and_payloads(spark):
    html = '<title>T</title><script type="application/ld+json">{"title":"Dev","hiringOrganization":{"name":"Acme"}}</script>'
    row = spark.range(1).select(readers.job_posting(F.lit(html)).alias("j"), readers.unwrapped_items(F.lit('{"data":{"items":[{"id":3}]}}'), "struct<id:int>").alias("i"), readers.xml_attributes(F.lit('<one:Page name="a"/><Page x="1" name="b"/>'), "Page", "name").alias("x")).first()
    assert (row.j.title, row.j.company, row.i[0].id, row.x) == ("Dev", "Acme", 3, ["a", "b"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=cmd", ["a", "b"])], "k int, t string, l array<string>")
    readers.write_table(rows, f"{tmp_path}/t")
    back = spark.read.option("header", "true").option("multiLine", "true").csv(f"{tmp_path}/t").first()
    assert (back.k, back.t, back.l) == ("1", "'=cmd", "a\nb")
    readers.backup(rows, f"{tmp_path}/b")
    saved = spark.read.schema(rows.schema).json(f"{tmp_path}/b")
    merged, counts = readers.restore(rows, saved.union(saved.withColumn("k", F.lit(2))), "k")
    assert merged.count() == 2 and tuple(counts.first()) == (1, 1)


def test_job_stream_keeps_state(spark, tmp_path):
    source = f"{tmp_path}/in"
    schema = "job long, at long, event string"
    spark.createDataFrame([(1, 1, "begin"), (1, 2, "progress"), (2, 1, "complete")], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    q = streams.job_states(stream).writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    spark.createDataFrame([(1, 3, "cancel"), (1, 4, "complete")], schema).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    got = {(r.job, r.state, r.attempts, r.refused) for r in spark.table("job_states").collect()}
    assert got == {(1, "running", 1, 0), (2, "", 0, 1), (1, "cancelled", 1, 0)}


def test_windows_drop_late_rows(spark, tmp_path):
    source = f"{tmp_path}/in"
    make = lambda rows: spark.createDataFrame(rows, "ts string, event_type string, user_id long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
    make([("2024-01-01 00:10:00", "a", 1), ("2024-01-01 00:20:00", "a", 1)])
    stream = spark.readStream.schema("ts timestamp, event_type string, user_id long").parquet(source)
    q = streams.event_rates(stream).writeStream.outputMode("append").format("memory").queryName("rates").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    make([("2024-01-01 03:00:00", "a", 1)])
    q.processAllAvailable()
    make([("2024-01-01 00:30:00", "a", 1), ("2024-01-01 05:00:00", "b", 1)])
    q.processAllAvailable()
    q.stop()
    assert {(r.event_type, r.n) for r in spark.table("rates").collect()} == {("a", 2), ("a", 1)}


def test_keyed_sink_is_idempotent(spark):
    kept = {}
    sink = streams.keyed_sink(lambda: kept.get("df"), lambda df: kept.update(df=spark.createDataFrame(df.collect(), df.schema)), ["k"], ["t"])
    a, b = spark.createDataFrame([(1, 1, "x")], "k int, t int, v string"), spark.createDataFrame([(1, 2, "y"), (2, 1, "z")], "k int, t int, v string")
    for batch in (a, b, b, a):
        sink(batch, 0)
    assert sorted(map(tuple, kept["df"].collect())) == [(1, 2, "y"), (2, 1, "z")]
