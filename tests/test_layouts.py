"""JSON arrays in splits, tables by date, types of JSON fields, counts observed while writing."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import variants
from strandline.operators import filters
from strandline.plans import ingest
from strandline.sources import dated, jsonarray, sinks


# ---- JSON arrays ----

def odd_items(rng, n):
    texts = ["", "}", "{", "},{", '"', "\\", '\\"}', "]", "[", "a\n}b", "é𝄞", '{"x": "}"}', "\\\\"]
    return [{"i": i, "t": "".join(rng.choice(texts) for _ in range(rng.randint(0, 6))), "o": {"p": [{"q": rng.choice(texts)}, {}]}, "l": [1, {"}": "{"}]} for i in range(n)]


@pytest.mark.parametrize("split, indent", [(97, None), (1000, 2), (1 << 27, None)])
def test_items_in_any_splits(spark, tmp_path, split, indent):
    rng = random.Random(split)
    whole = {f"f{k}.json": odd_items(rng, n) for k, n in enumerate((60, 1, 0, 25))}
    for name, items in whole.items():
        (tmp_path / name).write_text(("﻿ \n" if name == "f0.json" else "") + json.dumps(items, indent=indent, ensure_ascii=bool(indent)) + ("\n" if indent else ""))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = jsonarray.array_items(spark, str(tmp_path))
        got = read.collect()
        tasks = jsonarray._pieces(spark, str(tmp_path / "f0.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])
    found = {}
    for r in got:
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.loads(r["item"]))
    assert {n: sorted(v, key=lambda x: x["i"]) for n, v in found.items()} == {n: v for n, v in whole.items() if v}
    assert tasks > 1 or split > 10_000


@pytest.mark.parametrize("text, message", [('{"a": 1}', "does not hold a JSON array"), ('[{"a": 1}, {"a": ', "ends inside an item"), ('[{"a": 1', "ends inside an item"), ('[{"a": "1', "ends inside an item"), ("", None), ("[]", None), ("[ ]\n", None)])
def test_what_is_no_array(spark, tmp_path, text, message):
    (tmp_path / "x.json").write_text(text)
    if message is None:
        assert jsonarray.array_items(spark, str(tmp_path / "x.json")).count() == 0
    else:
        with pytest.raises(Exception, match=message):
            jsonarray.array_items(spark, str(tmp_path / "x.json")).collect()


# ---- tables by date ----

def dated_rows(spark, n):
    rng = random.Random(5)
    rows = [(f"id{i:04d}", None if i % 9 == 0 else dt.datetime(2023, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 500)), i) for i in range(n)]
    return spark.createDataFrame(rows, "id string, date_published timestamp_ntz, v int")


def test_windows_and_pages_open_few_months(spark, tmp_path):
    path = str(tmp_path / "d")
    df = dated_rows(spark, 600)
    for batch in (df.where("v < 300"), df.where("v >= 200"), df.where("v < 50")):
        sinks.append_new(batch, path, ["id"], [F.asc("v")], ["month"], dated.by_date)
    stored = spark.read.parquet(path)
    assert stored.count() == 600
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2023-03-10", "2023-05-02"))
    got = dated.between(stored, lo, hi)
    want = df.where((F.col("date_published") >= lo) & (F.col("date_published") < hi))
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()) != []
    months = {f.split("month=")[1].split("/")[0] for f in got.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert months <= {"2023-03", "2023-04", "2023-05"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for limit, where in ((10, None), (80, None), (5, F.col("v") % 100 == 7), (1000, None), (3, F.lit(False))):
        page = dated.newest_page(stored, limit, where)
        rows = filters.newest(df if where is None else df.where(where)).limit(limit)
        assert [r["id"] for r in page.collect()] == [r["id"] for r in rows.collect()]
    first = dated.newest_page(stored, 10)._jdf.queryExecution().executedPlan().toString()
    assert "undated" in first and "2023-02" not in first                  # one folder is enough


# ---- types of JSON fields ----

def test_wrong_types_are_named(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": 1.5, "b": null}', '{"a": "1"}', '{"a": [1], "b": {"c": 1}}', '{"a": true, "b": "y"}', "no json", None, "[1]"]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "j string, batch int")
    got = {(r["field"], r["found"]): r["rows"] for r in variants.wrong_types(df, "j", {"a": ("number",), "b": ("string", "null")}).collect()}
    assert got == {("a", "string"): 1, ("a", "array"): 1, ("a", "boolean"): 1, ("a", "invalid"): 2, ("a", "missing"): 1,
                   ("b", "missing"): 2, ("b", "object"): 1, ("b", "invalid"): 2}
    schemas = {r["batch"]: r["schema"] for r in variants.merged_schema(df.limit(3), "j", ["batch"]).collect()}
    assert "a" in schemas[0] and set(schemas) == {0, 1}


# ---- observed counts ----

def test_counts_come_from_the_writing_pass(spark, tmp_path):
    stages = ["window"] * 3 + ["duplicate"] * 2 + ["rejected"] + ["stored"] * 4
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stages)], "position int, stage string")
    for _ in range(2):
        seen = ingest.write_observed(df, str(tmp_path / "o"))
    want = {r["step"]: r["rows"] for r in ingest.funnel_counts(df).collect()}
    assert {k: v for k, v in seen.items() if v} == want and seen["removed_invalid"] == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 10
