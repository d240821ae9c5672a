"""Readers, descriptions and option builders; no outside system is contacted."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.registry import from_properties
from millrace.scratch import new_path
from millrace.sources import connectors, describe, files


def test_lenient_csv(spark):
    path = new_path(spark, "csv")
    spark.createDataFrame([("# note",), ("1;a",), ("x;b",), ("3;'c;d'",)], "value string").coalesce(1).write.text(path)
    options = {"field_delimiter": ";", "quote": "'", "comment": "#"}
    rows = files.read_csv(spark, path, "n int, s string", lenient=True, **options)
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (3, "c;d")]
    with pytest.raises(Exception):
        files.read_csv(spark, path, "n int, s string", **options).collect()


def test_existing_path_is_kept(spark):
    path = new_path(spark, "csv")
    files.write_csv(spark.range(3), path)
    with pytest.raises(Exception):
        files.write_csv(spark.range(3), path)
    files.write_csv(spark.range(5), path, overwrite=True)
    assert spark.read.csv(path).count() == 5


def test_json_missing_field(spark):
    path = new_path(spark, "json")
    spark.createDataFrame([('{"a": 1}',)], "value string").write.text(path)
    assert files.read_json(spark, path, "a int, b int").first()["b"] is None
    with pytest.raises(Exception, match="missing"):
        files.read_json(spark, path, "a int, b int", True).collect()


def test_charset(spark, tmp_path):
    (tmp_path / "lines.txt").write_bytes("é,1\nü\"2\n".encode("latin-1"))
    got = files.read_lines(spark, str(tmp_path), "ISO-8859-1")
    assert sorted(r[0] for r in got.collect()) == ["é,1", 'ü"2']


def test_graph_csv(spark):
    path = new_path(spark, "edges")
    spark.createDataFrame([("1,2,0.5",), ("2,3,1.5",)], "value string").write.text(path)
    graph = files.read_graph_csv(spark, path)
    assert graph.edges.count() == 2 and graph.vertices.count() == 3


def test_insert_rules(spark):
    rows = spark.createDataFrame([(1, "a")], "x int, y string")
    assert describe.checked_insert(rows, [("p", "int"), ("q", "string")]).columns == ["p", "q"]
    for target in ([("p", "int")], [("p", "bigint"), ("q", "string")]):
        with pytest.raises(describe.SchemaMismatch):
            describe.checked_insert(rows, target)


def test_temporal_table(spark):
    rates = spark.createDataFrame([("e", 1, 1.0, "a"), ("e", 5, 2.0, "b"), ("y", 3, 9.0, "c")], "k string, since int, rate double, tie string")
    made = describe.TemporalTable(rates, "k", "since", "tie")
    assert sorted((r["k"], r["rate"]) for r in made.at(4).collect()) == [("e", 1.0), ("y", 9.0)]


def test_stream_table_description(spark):
    path = new_path(spark, "in")
    spark.createDataFrame([(1, 1000), (2, 2000)], "id int, ms bigint").write.json(path)
    schema = describe.Schema().field("id", "int").rowtime("ts", "bigint", "ms", "1 second").proctime("now")
    table = describe.connect(spark, path).with_format("json").with_schema(schema).in_upsert_mode()
    stream = table.stream_source()
    assert stream.isStreaming and stream.columns == ["id", "ts", "now"]
    assert table.source().agg(F.max("ts").cast("long")).first()[0] == 2


def test_kafka_options():
    made = connectors.kafka_source("h:1", ["a", "b"], "specific", {"a": {"0": 5}}, group="g")
    assert made["subscribe"] == "a,b" and made["startingOffsets"] == '{"a": {"0": 5}}' and made["kafka.group.id"] == "g"
    assert connectors.kafka_source("h:1", "a.*", "timestamp", timestamp_ms=7)["startingTimestamp"] == "7"
    for bad in ({"start": "never"}, {"start": "group"}, {"start": "specific"}, {"start": "timestamp"}):
        with pytest.raises(ValueError):
            connectors.kafka_source("h:1", ["a"], **bad)


def test_kafka_rows(spark):
    out = connectors.kafka_records(spark.range(1).withColumn("k", F.lit("x")), "k", F.col("id") % 3)
    assert tuple(out.first()) == ("x", '{"id":0,"k":"x"}', 0)
    records = spark.createDataFrame([(b'{"a": 1}',)], "value binary").withColumn("timestamp", F.current_timestamp())
    assert connectors.kafka_json(records, "a int").first()["a"] == 1


def test_parallel_read_ranges():
    assert connectors.between_predicates("id", 1, 10, 4) == ["id BETWEEN 1 AND 4", "id BETWEEN 5 AND 8", "id BETWEEN 9 AND 10"]
    assert connectors.parameter_predicates("a = ? AND b < ?", [("x'y", 3)]) == ["a = 'x''y' AND b < 3"]
    with pytest.raises(ValueError):
        connectors.between_predicates("id", 5, 1, 2)


def test_other_options():
    assert connectors.hbase_schema({"f": {"a": "int"}}) == "`rowkey` string, `f` struct<`a`: int>"
    assert connectors.kinesis_source("s", "r", "earliest")["initialPosition"] == "TRIM_HORIZON"
    with pytest.raises(ValueError):
        connectors.elasticsearch("h", "i", operation="upsert")


def test_edit_lines(spark):
    line = "[[Some title]] NM http://example.org/x * Some User * (-12) changed it"
    got = connectors.edit_events(spark.createDataFrame([(line,), ("noise",)], "value string")).collect()
    assert len(got) == 1 and (got[0]["title"], got[0]["user"], got[0]["byte_diff"], got[0]["is_new"], got[0]["is_bot"]) == ("Some title", "Some User", -12, True, False)


def test_function_from_properties():
    made = from_properties({"class": "datetime:timedelta", "constructor": [1, 2]})
    assert made.days == 1 and made.seconds == 2


def test_monitor_by_name(spark, tmp_path):
    from millrace.streaming import run

    (tmp_path / "a.log").write_text("x\n")
    (tmp_path / "b.tmp").write_text("y\n")
    stream = files.monitor(spark, str(tmp_path), "value string", glob="*.log")
    assert [r[0] for r in run.append_table(stream).collect()] == ["x"]


def test_hadoop_format(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    rows = files.read_hadoop(
        spark, str(tmp_path), "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.Text", "at bigint, line string")
    assert sorted(r["line"] for r in rows.collect()) == ["x", "y"]


def test_session_statements(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    spark.sql("CREATE OR REPLACE TEMP VIEW doubled AS SELECT id * 2 AS x FROM numbers")
    assert {"numbers", "doubled"} <= {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}
    assert [tuple(r)[:2] for r in spark.sql("DESCRIBE doubled").collect()] == [("x", "bigint")]
    assert "Physical Plan" in spark.sql("EXPLAIN SELECT * FROM doubled").first()[0]
    spark.sql("DROP VIEW doubled")
    assert files.read_catalog(spark, "numbers", ["id"], "id > 0").count() == 2
