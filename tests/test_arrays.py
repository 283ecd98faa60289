"""JSON arrays read in ranges against the plain parser."""

import json
import random

import pyarrow as pa
import pytest

from tessera.sources import arrays
from tessera.sources.arrays import array_records, read_array


def value(r, depth=0):
    kind = r.randint(0, 7 if depth < 3 else 4)
    if kind < 3:
        return r.choice(["plain", "}, {", 'quo"ted', "back\\", 'both\\"},', "[{", "ışÖ😀", "", "line\nend", "}]", '",'])
    if kind < 5:
        return r.choice([None, True, 12, -1.5, 3e10])
    if kind < 6:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {r.choice(["a", "b}", 'c"', "d,"]) + str(i): value(r, depth + 1) for i in range(r.randint(0, 4))}


def ordered(df):
    return [json.loads(x["value"]) for x in df.orderBy("file", "block", "seq").collect()]


@pytest.mark.parametrize("seed,block", [(1, 350), (2, 500), (3, 40_000)])
@pytest.mark.parametrize("indent", [None, 1])
def test_ranges_against_the_plain_parser(spark, tmp_path, seed, block, indent):
    r = random.Random(seed)
    rows = [{"id": i, "v": value(r), "w": value(r)} for i in range(120)] + [{"id": 121, "v": "x" * 5000 + "},", "w": [{}, {"a": {}}]}]
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False, indent=indent) + ("\n" if indent else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        found = array_records(spark, str(tmp_path))
        assert ordered(found) == rows
        if block == 500:
            assert found.select("block").distinct().count() > 5
    finally:
        for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{k}")


def test_several_files_batches_and_schema(spark, tmp_path):
    data = {"a": [{"id": k, "t": "}, " * (k % 3)} for k in range(50)], "b": [], "c": [{"id": 7}], "d": [{"id": k, "t": None} for k in range(60, 90)]}
    for name, rows in data.items():
        (tmp_path / f"{name}.json").write_text(f" {json.dumps(rows)} ")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = read_array(spark, str(tmp_path), "id long, t string").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((x["id"], x["t"] or "") for x in got) == sorted((x["id"], x.get("t") or "") for rows in data.values() for x in rows)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "scalars.json").write_text('[1, "two, three", [4, 5], {"six": 7}, null]')
    assert ordered(array_records(spark, str(tmp_path / "e"))) == [1, "two, three", [4, 5], {"six": 7}, None]


def test_ranges_are_met_a_part_at_a_time(spark, tmp_path):
    assert b"".join(arrays._parts(b"ab" + b"\\" * 9 + b"cd", 2)) == b"ab" + b"\\" * 9 + b"cd" and b"\\c" in list(arrays._parts(b"ab" + b"\\" * 9 + b"cd", 2))[0]
    rows = [{"id": i, "t": "x" * 1000} for i in range(3000)] + [{"id": 3000, "t": '\\"},[' * 900_000}, {"id": 3001, "t": "last"}]
    text = json.dumps(rows, separators=(",", ":"))
    lines = [x.encode() for x in text.split("},")]
    batch = pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.binary()), "file": ["f"] * len(lines), "block": [0] * len(lines)})
    counted = list(arrays._count([batch]))
    assert len(counted) >= 5 and sum(c.column(2)[0].as_py() for c in counted) == 4 * 2 * 3002 - 2 * 3002
    (tmp_path / "a.json").write_text(text)
    assert ordered(array_records(spark, str(tmp_path))) == rows
