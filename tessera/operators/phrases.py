"""Which texts hold which phrases: one pass of an automaton over each text, however many phrases there are.

Up to ``PART_PHRASES`` phrases (counted, and of bounded bytes) make one automaton, which every task builds from a broadcast; texts are not shuffled. More phrases are dealt
into parts of that size by a shuffle, texts into groups of bounded bytes, and each group meets each part in one task: no limit, and no task that holds all of either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Phrases and bytes of one automaton; bytes of the texts that meet it in one task.
PART_PHRASES, PART_BYTES, GROUP_BYTES = 100_000, 8 << 20, 32 << 20


def automaton(phrases: list[str]) -> Callable[[str], set[str]]:
    """Gives the phrases that a text holds; an empty phrase is in every text."""
    found = ahocorasick.Automaton()
    for p in phrases:
        if p:
            found.add_word(p, p)
    always = {""} & set(phrases)
    if not len(found):
        return lambda text: always
    found.make_automaton()
    return lambda text: always | {p for _, p in found.iter(text)}


def _scan(table: pa.Table | pa.RecordBatch, holds: Callable[[str], set[str]]) -> tuple[list[int], list[str]]:
    """Rows and phrases of all finds; the last column is the text that is scanned."""
    rows, phrases = [], []
    for i, text in enumerate(table.column(table.num_columns - 1)):
        value = text.as_py()
        if value is not None:
            found = holds(value)
            rows += [i] * len(found)
            phrases += found
    return rows, phrases


def find_phrases(texts: DataFrame, phrases: DataFrame, *, scanned: str = "text", lower: bool = True, into: str = "phrase") -> DataFrame:
    """Each row of texts once for every phrase (the one column of ``phrases``) that its column ``scanned``, in lower case, contains; the phrase as column ``into``.

    A null text holds nothing, a null phrase is nowhere, an empty one in every text; repeated phrases count once. lower=False: the text as it is.
    """
    spark = texts.sparkSession
    wanted = phrases.toDF("_p").filter("_p IS NOT NULL").distinct()
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_p")), F.lit(0)).alias("bytes")).first()
    fields = [StructField(f"c{i}", f.dataType, True) for i, f in enumerate(texts.schema.fields)]
    schema = StructType([*fields, StructField("_phrase", StringType())])
    column = F.col(f"`{scanned}`").cast("string")
    # columns by place, so that any names go through Arrow; the scanned text is the last one
    rows = texts.withColumn("_scanned", F.lower(column) if lower else column).filter("_scanned IS NOT NULL").toDF(*[f.name for f in fields], "_scanned")
    names = [*texts.columns, into]
    if size["n"] <= PART_PHRASES and size["bytes"] <= PART_BYTES:
        shared = spark.sparkContext.broadcast([r["_p"] for r in wanted.collect()])  # counted above

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            holds = automaton(shared.value)
            for batch in batches:
                at, found = _scan(batch, holds)
                kept = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(found, pa.string())], names=schema.names)

        return rows.mapInArrow(run, schema).toDF(*names)
    parts = max(-(-size["n"] // PART_PHRASES), -(-size["bytes"] // PART_BYTES))
    total = rows.agg(F.sum(F.octet_length("_scanned"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_group", (F.monotonically_increasing_id() % groups).cast("int")).withColumn("_part", every(parts))
    right = wanted.withColumn("_part", F.pmod(F.xxhash64("_p"), F.lit(parts)).cast("int")).withColumn("_group", every(groups))

    def meet(held: pa.Table, own: pa.Table) -> pa.Table:
        held = held.drop_columns(["_group", "_part"])
        at, found = _scan(held, automaton(own.column("_p").to_pylist()))
        kept = held.take(pa.array(at, pa.int64()))
        return pa.table([*[kept.column(i) for i in range(kept.num_columns - 1)], pa.array(found, pa.string())], schema=None, names=schema.names)

    met = left.groupBy("_group", "_part").cogroup(right.groupBy("_group", "_part"))
    return met.applyInArrow(meet, schema).toDF(*names)
