"""What Python tasks make of a batch is made of a piece at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions.batches import PIECE_BYTES, pieces
from tessera.operators import chunking
from tessera.sources import corpora


def test_pieces():
    texts = ["x" * 30, None, "", "ü" * 40, "x" * 500, "x" * 20, "y" * 20]
    batch = pa.RecordBatch.from_pydict({"n": range(7), "t": texts}).slice(1)
    assert [p.column(0).to_pylist() for p in pieces(batch, 1, 100)] == [[1, 2, 3], [4], [5, 6]]
    lists = pa.array([["x" * 60, "x" * 60], [], None, ["y" * 90], ["z" * 5, None, "z" * 5]], pa.list_(pa.string()))
    assert [p.column(0).to_pylist() for p in pieces(pa.RecordBatch.from_arrays([lists], names=["l"]), 0, 100)] == [lists.to_pylist()[:1], lists.to_pylist()[1:]]
    assert not list(pieces(batch.slice(6), 1))


def test_pages_of_a_batch_are_read_a_piece_at_a_time(spark):
    pages = ["<p>" + chr(0x1F600) * 50_000 + "</p>", None, "<p>a</p> <p>b"] * 20
    made = list(corpora._mapped([pa.array(pages)], lambda h: "\n".join(corpora.html_nodes(h, False))))
    assert len(made) >= 4 and max(m.nbytes for m in made) <= PIECE_BYTES + 4096
    want = [chr(0x1F600) * 50_000, "", "a\n \nb"] * 20
    assert [x for m in made for x in m.to_pylist()] == want
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string").coalesce(1)
    assert [r["text"] for r in df.select("k", corpora.html_text(F.col("html")).alias("text")).orderBy("k").collect()] == [w.replace("\n \n", "\n") for w in want]


def test_columns_beside_chunks_stay_as_they_are(spark):
    """Through Arrow, whole numbers beside nulls are no floats; arrays come a piece at a time."""
    n = 2**53 + 1
    docs = spark.createDataFrame([(n, "one two. three four."), (None, "five six."), (n + 1, None)], "n long, text string").coalesce(1)
    rows = chunking.chunk_windows(docs.withColumn("text", F.repeat("text", 60))).groupBy("n").count().collect()
    assert {r["n"] for r in rows} == {n, None}
    sizes = chunking._fold(docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))), F.array(F.repeat(F.lit("ö "), 50_000)), lambda p: [p[0].strip()])
    assert sizes.groupBy("n").count().count() == 3 and sizes.filter(F.length("text") == 99_999).count() == 120
