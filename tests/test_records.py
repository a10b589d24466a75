"""The data source of JSON records, and files written by tasks."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.sources import readers, records, writers

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=6)
OBJECTS = st.dictionaries(st.text(max_size=5), VALUES, max_size=4)


def chunked(text, size):
    return (text[i : i + size] for i in range(0, len(text), size))


@settings(max_examples=200, deadline=None)
@given(st.lists(OBJECTS, max_size=5), st.integers(1, 30), st.sampled_from(["array", "pretty", "lines", "padded"]))
def test_layouts_in_any_chunks(rows, size, layout):
    before, records.CHUNK = records.CHUNK, size
    try:
        text = {"array": json.dumps(rows), "pretty": json.dumps(rows, indent=2), "lines": "\n\n".join(map(json.dumps, rows)), "padded": f"﻿ \n {json.dumps(rows, indent=1)}\n "}[layout]
        assert list(records.records(chunked(text, size))) == [(r, None) for r in rows]
    finally:
        records.CHUNK = before


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []), (" \n ", []), ("[]", []), ("[", [(None, "")]), ('{\n "a": 1\n}', [({"a": 1}, None)]), ('{\n "a": \n', [(None, "{"), (None, ' "a": ')]), ('x\n{"a": 1}', [(None, "x"), ({"a": 1}, None)]), ("[1, 2", [(1, None), (2, None), (None, "")]),
        ('{"a": 1}\nx}\n[1]\n{"b": 2}', [({"a": 1}, None), (None, "x}"), (None, "[1]"), ({"b": 2}, None)]), ('{"a": broken}\n{"b": 2}', [(None, '{"a": broken}'), ({"b": 2}, None)]), ("plain text", [(None, "plain text")]), ('[{"a": 1}, {"a": x}, {"a": 2}]', [({"a": 1}, None), (None, '{"a": x}, {"a": 2}]')]),
    ],
)
def test_malformed_files(text, want):
    assert list(records.records(iter([text]))) == want


def test_values_by_type(spark):
    kind = StructType.fromDDL("a long, b string, c double, d array<int>, e map<string,boolean>, f struct<x:long>").fields
    fit = lambda i, x: records.fitted(x, kind[i].dataType)
    assert [fit(0, 5), fit(1, {"k": 1}), fit(2, 3), fit(3, [1, None]), fit(4, {"z": True}), fit(5, {"y": 1}), fit(1, None)] == [5, '{"k": 1}', 3.0, [1, None], {"z": True}, (None,), None]
    for i, x in ((0, "5"), (0, True), (0, 1 << 63), (2, "x"), (3, {}), (4, {"z": 1}), (3, [1 << 31])):
        with pytest.raises(ValueError):
            fit(i, x)


def test_files_of_a_folder(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"{i % 7}/f{i}.json", json.dumps([{"id": i * 10 + k, "v": "é" * rng.randrange(5)} for k in range(3)] + ([{"id": "no number"}] if i % 4 == 0 else []))) for i in range(40)]
    at = f"file://{tmp_path}/in"
    assert writers.files(spark.createDataFrame([*rows, ("_hidden/x.json", "[1]"), ("1/other.txt", "[2]"), ("1/empty.json", None)], "name string, text string"), at) == 43
    got = readers.json_arrays(spark, at, "id long, v string").collect()
    assert sorted(r["id"] for r in got) == sorted(i * 10 + k for i in range(40) for k in range(3))
    assert all(r["source_file"] == f"f{r['id'] // 10}.json" for r in got)
    bad = readers.malformed(spark, at, "id long, v string").collect()
    assert sorted(r["file_name"] for r in bad) == sorted(f"f{i}.json" for i in range(0, 40, 4)) and all("no number" in r["text"] for r in bad)
    assert readers.json_arrays(spark, f"{at}/3", "id long").count() == 18
    few = spark.read.format("json_records").schema("file_path string").option("glob", "f1*.json").load(at)
    assert few.select(F.countDistinct("file_path")).first()[0] == 11
    with pytest.raises(Exception, match="schema"):
        spark.read.format("json_records").load(at).collect()
