"""Readers, validation, properties and catalogue."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from stepwise.functions import labels
from stepwise.operators import catalog
from stepwise.operators import events as ev
from stepwise.operators.funnel import funnel
from stepwise.sources import checks, readers

HEADER = "user_id,event_name,timestamp,event_properties,user_properties\n"


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(
        HEADER
        + 'u1,A,2024-01-01 10:00:00,"{""p"": ""x""}",\n'
        + "u2,B,2024-01-01T11:00:00.5,{},\n"
        + "u3,C,never,{},\n"
        + "too,short\n"
    )
    return str(path)


def test_csv(spark, csv_path):
    df = readers.read_events(spark, csv_path)
    rows = df.orderBy("user_id").collect()
    assert [r["user_id"] for r in rows] == ["u1", "u2", "u3"]
    assert df.select("user_id").count() == 3
    assert dict(df.dtypes)["timestamp"] == "timestamp_ntz"
    assert rows[0]["event_properties"] == '{"p": "x"}' and rows[2]["timestamp"] is None
    assert rows[1]["timestamp"].microsecond == 500_000


def test_parquet_and_order(spark, make, tmp_path):
    path = str(tmp_path / "events.parquet")
    make([("u", "A", 0), ("u", "B", 1)]).drop("ord").coalesce(1).write.parquet(path)
    df = readers.read_events(spark, path, with_order=True)
    assert [r["ord"] for r in df.orderBy("timestamp").collect()] == [0, 1]
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_events(spark, "events.xlsx")


def test_order_over_files(spark, make, tmp_path):
    """A user's first event lies in the first file, and the next in the second."""
    halves = [[("u", "A", 0), ("v", "B", 0)], [("u", "B", 1), ("v", "A", 1)]]
    for name, rows in zip("ab", halves, strict=True):
        for kind in ("parquet", "csv"):
            plain = make(rows).drop("ord").toPandas()
            folder = tmp_path / f"events.{kind}"
            folder.mkdir(exist_ok=True)
            if kind == "csv":
                plain.to_csv(folder / f"{name}.csv", index=False)
            else:
                plain.to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
    for kind in ("parquet", "csv"):
        df = readers.read_events(spark, str(tmp_path / f"events.{kind}"), with_order=True)
        names = [r["event_name"] for r in df.orderBy("ord").collect()]
        assert names == ["A", "B", "B", "A"]
        assert [r["users"] for r in funnel(df, ["A", "B"]).orderBy("step_idx").collect()] == [2, 1]


def test_default_funnel_on_csv(spark, csv_path):
    assert funnel(readers.read_events(spark, csv_path), ["A", "B"]).count() == 2


def test_canonical(spark):
    df = spark.createDataFrame([(1, "A", "2024-01-01 00:00:00", [1, 2])],
                               "user_id int, event_name string, timestamp string, tags array<int>")
    row = readers.canonical(df).first()
    assert (row["user_id"], row["tags"]) == ("1", "[1,2]")
    with pytest.raises(ValueError, match="event_name"):
        readers.canonical(df.drop("event_name"))


def test_validation(spark, make, csv_path):
    good = make([("u", "A", 0)])
    assert checks.validate_events(good) == (True, checks.VALID)
    assert not checks.validate_events(make([]))[0]
    assert "user_id" in checks.validate_schema(good.drop("user_id"))[1]
    raw = spark.read.option("header", True).csv(csv_path)
    assert checks.validate_events(raw) == (False, checks.BAD_TIMES)
    assert checks.quality_counts(raw).first()["bad_timestamps"] >= 1
    assert not checks.validate_schema(good.withColumn("timestamp", F.lit(1.5)))[0]


def test_warehouse_options():
    plain = readers.warehouse_options(host="h", query="SELECT 1", database="d")
    assert plain["url"] == "jdbc:clickhouse://h:8123/d" and plain["query"] == "SELECT 1"
    ranged = readers.warehouse_options(
        host="h", query="SELECT 1", partition_column="ts", lower_bound="2024-01-01",
        upper_bound="2025-01-01", num_partitions=64,
    )
    assert ranged["dbtable"] == "(SELECT 1) AS q" and ranged["numPartitions"] == "64"
    assert "query" not in ranged
    with pytest.raises(ValueError):
        readers.warehouse_options(host="h", query="SELECT 1", partition_column="ts")


def test_sink(make, tmp_path):
    with pytest.raises(ValueError):
        readers.write_result(make([]), str(tmp_path / "x"), "xlsx")


def test_properties(make):
    rows = [(f"u{i}", "A", 0, json.dumps({"a": i, "b": {"c": [1]}})) for i in range(9)]
    rows += [("u9", "A", 0, '{"rare": true}'), ("x", "A", 0, "{broken"), ("y", "B", 0, None)]
    rows += [(f"v{i}", "A", 0, "{}") for i in range(5)]
    events = make(rows)
    assert ev.common_properties(events, "event_properties") == ["a", "b"]
    wide = ev.preprocess(events, ["A"])
    assert {"event_properties_a", "event_properties_b"} <= set(wide.columns)
    first = wide.filter("user_id = 'u0'").first()
    assert (first["event_properties_a"], first["event_properties_b"]) == ("0", '{"c":[1]}')
    keys = [r["key"] for r in ev.property_inventory(events).collect()]
    assert keys == ["a", "b", "rare"]
    values = [r["value"] for r in ev.property_values(events, "a").collect()]
    assert values == [str(i) for i in range(9)]
    assert ev.filter_by_property(events, "event_properties", "a", "5").count() == 1


def test_labels(spark):
    names = [None, "", "  Exit page ", "x" * 31, "Sign Up", "cart view"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select(
        labels.destination_label("name"), labels.destination_category("name"),
        labels.event_category("name"),
    ).collect()
    assert [tuple(r)[:2] for r in got[:4]] == [
        ("Unknown Event", "other"), ("Unknown Event", "other"), ("Exit page", "exit"),
        ("x" * 27 + "...", "other"),
    ]
    assert [r[2] for r in got[4:]] == ["Authentication", "E-commerce"]


def test_catalogue(spark, make):
    rows = [(f"u{i % 4}", "view item", i) for i in range(90)]
    rows += [("u0", "sign up", 0)] * 7 + [("u1", "odd", 0)] * 3
    events = make(rows)
    dictionary = spark.createDataFrame(
        [("sign up", "Start", "first", "once"), ("unseen", "None", "never", "low")],
        "name string, category string, description string, frequency string",
    )
    meta = {r["name"]: r for r in catalog.event_metadata(events, dictionary).collect()}
    assert (meta["sign up"]["category"], meta["sign up"]["total_occurrences"]) == ("Start", 7)
    assert (meta["unseen"]["total_occurrences"], meta["unseen"]["event_percentage"]) == (0, 0)
    assert (meta["view item"]["category"], meta["view item"]["frequency"]) == ("Engagement", "high")
    assert meta["odd"]["frequency"] == "low"
    basic = catalog.basic_metadata(events)
    assert {r["name"]: r["frequency"] for r in basic.collect()}["odd"] == "medium"
    assert catalog.filter_catalogue(basic, "EVENT: S", [], ["medium"]).count() == 1
    assert catalog.overview(events).first()["users"] == 4
    nulls = {r["column_name"]: r["nulls"] for r in checks.profile(events).collect()}
    assert (nulls["user_id"], nulls["user_properties"]) == (0, 100)


def test_cluster_settings():
    from stepwise.session import cluster_settings

    assert cluster_settings(1, 8)["spark.sql.shuffle.partitions"] == "16"
    assert cluster_settings(100 << 40, 4000)["spark.sql.shuffle.partitions"] == "819200"
