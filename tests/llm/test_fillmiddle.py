"""Fill-in-the-middle forms against slices of code points."""

import hashlib
import random

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.fillmiddle import fill_in_middle, restored

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


def plain(i, text, seed=1, plain_percent=10, spm_percent=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    r = [int(h[8 * j : 8 * j + 8], 16) for j in range(4)]
    n = len(text)
    a, b = sorted((r[0] % (n + 1), r[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or r[2] % 100 >= 100 - plain_percent:
        return (n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if r[3] % 100 < spm_percent:
        return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def check(spark, rows, **options):
    found = fill_in_middle(spark.createDataFrame(rows, SCHEMA), **options)
    found = found.withColumn("again", restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r["fim"]) == plain(r["doc_id"], r["text"], **options), r
        assert r["again"] == (r["text"] or "")
    return {r["fim"]["form"] for r in found}


def test_random_texts_with_delimiters_and_escapes(spark):
    r = random.Random(1)
    letters = ["a", "b", " ", "\n", "\r", "é", "ş", "😀", "\x01", "\x02", "d", "e", "<", ">", "P", "S", "M", "$", "\\", "\x00", "é", " "]
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 30)))) for i in range(600)]
    assert check(spark, rows) == {"plain", "psm", "spm"}
    assert check(spark, rows, seed=7, plain_percent=0, spm_percent=100) <= {"plain", "spm"}
    check(spark, rows[:50], plain_percent=100)


def test_odd_rows(spark):
    rows = [(None, None), (None, "a text without an id"), (1, ""), (2, "x"), (3, "x"), (3, "x"), (3, "another of that id"), (4, "a <P> b"), (5, "a<<S>"), (6, "<"), (-7, "<P"), (8, "<S" * 9)]
    rows += [(9, "lang 😀 " * 40_000), (10, "\x02e\x01d\x02" * 500)]
    check(spark, rows)


def test_empty_table_and_clashing_names(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, "some text", 2, 3, 4)], "doc_id long, text string, FIM int, _text int, `a.b` int")
    out = fill_in_middle(rows).collect()[0].asDict()
    assert list(out) == ["doc_id", "text", "_text", "a.b", "fim"] and out["_text"] == 3


def test_stays_in_sql(spark):
    plan = fill_in_middle(spark.createDataFrame([(1, "x")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
