import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm.linededup import bits, drop_shared_lines, keep_bitmaps

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    low = lambda i: (i is not None, i or 0)
    top = {k: max(v, key=low) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def spark_result(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, lines string")
    out = drop_shared_lines(df, **options)
    got = out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).collect()
    return sorted(map(tuple, got), key=str)


def test_brute_force(spark):
    r = random.Random(5)
    pool = ["Line number %d that is long enough to be counted here" % k for k in range(25)] + ["short"] * 5 + ["ÄÖ " * 20, "x" * 39, "X" * 40, "\tx" + "x" * 39 + " \r"]
    hot = "The one line that nearly every document of this corpus holds"
    rows = []
    for i in range(300):
        lines = [r.choice(pool) for _ in range(r.randint(0, 6))] + ([hot] * r.randint(1, 3) if r.random() < 0.7 else []) + [f"own line {i} {r.random()} of this document only"]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(1000, None), (1001, ""), (None, hot), (None, hot + "\n" + pool[0]), (7, hot), (7, hot), (1002, "\n".join([hot] * 20000))]
    assert spark_result(spark, rows) == brute(rows)
    assert spark_result(spark, rows, min_docs=1) == brute(rows, min_docs=1)
    assert spark_result(spark, rows, min_docs=2, min_chars=5) == brute(rows, min_docs=2, min_chars=5)


def test_one_hot_line_over_all_partitions(spark):
    hot = "exactly the same line in each of the many documents"
    rows = [(i, hot) for i in range(4000)]
    got = spark_result(spark, rows)
    assert sum(g[2] for g in got) == 3999 and [g[0] for g in got if g[2] == 0] == [3999]


def test_bitmaps_and_empty_table(spark):
    line = "a line of more than forty characters, shared by five"
    rows = [(i, f"own {i}\n{line}\n") for i in range(5)]
    maps = keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc").collect()
    assert [(m.doc, bits(m.bitmap, m.n_lines).tolist()) for m in maps] == [(i, [True, False, True]) for i in range(4)]
    assert drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_name_of_another_case(spark):
    from tessera.llm.linededup import drop_shared_lines

    line = "a line that is long enough to be a shared one"
    out = drop_shared_lines(spark.createDataFrame([(i, line, "x") for i in range(6)], "doc_id long, text string, LINES string"))
    assert out.columns == ["doc_id", "text", "lines"] and sum(r["lines"]["n_dropped"] for r in out.collect()) == 5
