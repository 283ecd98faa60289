"""The n best documents of every query by BM25+, without a score for every pair that shares a term.

Postings are dealt by document into shards, with what each adds to a score; a shard is held by one task, whatever the number of documents. Every query has a
threshold from the start: of a term that n documents have, what the n-th largest contribution is at least (from counts by cells of contributions), for the term where this is most. In a shard, the query's terms are met from
the largest possible contribution down. While what the terms to come can add together reaches the threshold, their documents become candidates (but
those in blocks of postings whose largest contribution is too small); after that no new document does (MaxScore), and candidates leave as soon as what is left cannot lift
them. The threshold rises with the shard's own n-th best. So nothing that could be among the n best is left out, ties and rounding included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Bm25Config
from ..storage import if_small, written
from . import index
from .index import MAX_TERMS, corpus_stats, counted_documents, document_postings, query_terms, term_stats, top_n, wanted_postings

#: Postings of a shard, about; terms of all queries that are met at once in a shard; postings of a block.
SHARD_POSTINGS, QUERY_TERMS, BLOCK = 1 << 20, 1 << 20, 64
#: Cells of contributions between one whole number and the next.
CELLS = 128


class Lists:
    """The postings of a shard: for each term its documents (numbers, ascending), their contributions, and the largest of every block."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, parts: np.ndarray, n_docs: int) -> None:
        order = np.lexsort((docs, terms))
        terms, self.docs, self.parts, self.n_docs = terms[order], docs[order], parts[order], n_docs
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(terms))
        most = np.maximum.reduceat(self.parts, first) if len(first) else self.parts
        self.place = {t: (a, b, m) for t, a, b, m in zip(terms[first].tolist(), first.tolist(), ends.tolist(), most.tolist())}
        self.score, self.member = np.zeros(n_docs), np.zeros(n_docs, bool)

    def top(self, terms: np.ndarray, weights: np.ndarray, n: int, least: float, slack: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) of all documents that can be among the n best, and how many were scored at all. least: a score that n documents reach."""
        own = [(w, *self.place[t]) for t, w in zip(terms.tolist(), weights.tolist()) if t in self.place]
        bounds = np.array([w * most for w, _, _, most in own])
        order = np.argsort(-bounds, kind="stable")
        left = np.append(np.cumsum(bounds[order][::-1])[::-1], 0.0)  # what the terms from here on can add
        found = np.zeros(0, np.int64)
        scored = look = 0
        for i, k in enumerate(order.tolist()):
            w, a, b, _ = own[k]
            docs = self.docs[a:b]
            if left[i] >= least - slack:
                gains, known = w * self.parts[a:b], self.member[docs]
                high = np.maximum.reduceat(gains, np.arange(0, b - a, BLOCK)) + left[i + 1] >= least - slack
                fresh = ~known & np.repeat(high, BLOCK)[: b - a]
                self.member[docs[fresh]] = True
                found = np.concatenate([found, docs[fresh]])
                scored += int(fresh.sum())
                known |= fresh
                self.score[docs[known]] += gains[known]
            elif 8 * len(found) > b - a:
                known = self.member[docs]
                self.score[docs[known]] += w * self.parts[a:b][known]
            else:
                at = np.minimum(np.searchsorted(docs, found), b - a - 1)
                hit = docs[at] == found
                self.score[found[hit]] += w * self.parts[a + at[hit]]
            if len(found) >= n and i >= look:
                # the best so far, with all their terms: what n documents reach
                look = 2 * i + 1
                lead = found[np.argpartition(-self.score[found], n - 1)[:n]]
                least = max(least, float(self._whole(lead, [own[k] for k in order[i + 1 :].tolist()]).min()))
            out = self.score[found] + left[i + 1] < least - slack
            if out.any():
                gone, found = found[out], found[~out]
                self.score[gone], self.member[gone] = 0.0, False
            if not len(found) and left[i + 1] < least - slack:
                break
        scores = self.score[found].copy()
        self.score[found], self.member[found] = 0.0, False
        return found, scores, scored

    def _whole(self, docs: np.ndarray, rest: list[tuple[float, int, int, float]]) -> np.ndarray:
        """Scores of a few candidates with what the rest of the terms adds."""
        total = self.score[docs]
        for w, a, b, _ in rest:
            own = self.docs[a:b]
            at = np.minimum(np.searchsorted(own, docs), b - a - 1)
            total += np.where(own[at] == docs, w * self.parts[a + at], 0.0)
        return total


def _best(n: int, places: int, counter: Accumulator | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    slack = 2.0 * 10.0**-places

    def run(posts: pa.Table, queries: pa.Table) -> pa.Table:
        coded = posts.column("doc_id").combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        names = coded.dictionary.take(order)
        place = np.empty(len(names), np.int64)
        place[order.to_numpy()] = np.arange(len(names))
        lists = Lists(posts.column("number").to_numpy(), place[coded.indices.to_numpy()], posts.column("part").to_numpy(), len(names))
        numbers, weights = queries.column("numbers").to_pylist(), queries.column("weights").to_pylist()
        rows, docs, scores = [], [], []
        for i, (t, w, least) in enumerate(zip(numbers, weights, queries.column("least").to_pylist())):
            found, score, scored = lists.top(np.array(t), np.array(w), n, least, slack)
            if counter is not None:
                counter.add(scored)
            near = np.round(score, places)
            best = np.lexsort((found, -near))[:n]
            rows.append(np.full(len(best), i))
            docs.append(found[best])
            scores.append(score[best])
        own = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        all_docs = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        asked = queries.column("query_id").take(own)
        return pa.table({"query_id": asked, "doc_id": names.take(pa.array(all_docs)), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

    return run


def _thresholds(cells: DataFrame, n: int) -> DataFrame:
    """(number, nth): of each term, what n contributions reach: the lower end of the cell of the n-th largest, so nothing is sorted but counts. cells: number, cell, had."""
    above = F.sum("had").over(Window.partitionBy("number").orderBy(F.col("cell").desc()))
    return cells.withColumn("above", above).filter(F.col("above") >= n).groupBy("number").agg((F.max("cell") / CELLS).alias("nth"))


def _weighed(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, numbers, weights, least) of each query. terms: term, number, idf, nth."""
    asked = wanted.join(terms, "term").withColumn("weight", F.col("qtf") * F.col("idf"))
    return asked.groupBy("query_id").agg(
        F.collect_list("number").alias("numbers"), F.collect_list("weight").alias("weights"), F.coalesce(F.max(F.col("weight") * F.col("nth")), F.lit(0.0)).alias("least")
    )


def top_postings(
    posts: DataFrame, stats: DataFrame, wanted: DataFrame, n: int, *, places: int = 4, config: Bm25Config = Bm25Config(), counter: Accumulator | None = None
) -> DataFrame:
    """(query_id, doc_id, score, rank) of the n best documents of each query, scores rounded to so many places, ties to the smaller id.

    Documents without an id are no hits. posts: doc_id, term, tf, dl (written; read twice), of the wanted terms at least; wanted: query_id, term, qtf. counter: gets the number of scored pairs.
    """
    spark = posts.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    used = posts.join(if_small(wanted, MAX_TERMS)(wanted.select("term").distinct()), "term", "left_semi")
    terms = written(term_stats(used, stats).withColumn("number", F.monotonically_increasing_id()), "terms")
    hint = if_small(terms, MAX_TERMS)
    tf = F.col("tf")
    norm = config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl"))
    part = tf * (config.k1 + 1) / (tf + norm) + config.delta
    parts = posts.join(hint(terms.select("term", "number")), "term").crossJoin(F.broadcast(stats.select("avgdl"))).select("doc_id", "number", part.alias("part"))  # one row
    parts = parts.filter(F.col("doc_id").isNotNull())
    cells = parts.groupBy("number", F.floor(F.col("part") * CELLS).alias("cell")).agg(F.count("*").alias("had"))
    asked = _weighed(wanted, terms.join(_thresholds(cells, n), "number", "left"))
    size = posts.count()
    shards = max(1, -(-size // SHARD_POSTINGS), min(width, size // 4096))
    blocks = max(1, -(-wanted.count() // QUERY_TERMS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # queries are a stated set: a block of them goes to every shard, and a shard's postings to every block
    left = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    kinds = wanted.schema["query_id"].dataType.simpleString(), posts.schema["doc_id"].dataType.simpleString()
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    found = met.applyInArrow(_best(n, places, counter), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return top_n(found.withColumn("score", F.round("score", places)), n)


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Documents of about so many postings each; a document stays whole."""
    held, size = [], 0
    for batch in batches:
        ends, first = np.cumsum(batch.column("numbers").value_lengths().to_numpy(), dtype=np.int64), 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + limit - size, "right")))
            held.append(batch.slice(first, end - first))
            size, first = size + int(ends[end - 1]) - before, end
            if size >= limit or first < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _parts(docs: pa.Table | pa.RecordBatch, avgdl: float, config: Bm25Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, part) of all postings: what each adds to a score."""
    flat = [np.concatenate([c.flatten().to_numpy() for c in chunks] or [np.zeros(0, np.int32)]) for chunks in (_chunks(docs, "numbers"), _chunks(docs, "tfs"))]
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in _chunks(docs, "numbers")] or [np.zeros(0, np.int32)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    dl = np.concatenate([c.fill_null(0).to_numpy() for c in _chunks(docs, "dl")] or [np.zeros(0, np.int32)])  # no postings without a length
    tf = flat[1].astype(np.float64)
    norm = config.k1 * (1 - config.b + config.b * dl[row] / avgdl)
    return row, flat[0], tf * (config.k1 + 1) / (tf + norm) + config.delta


def _chunks(docs: pa.Table | pa.RecordBatch, name: str) -> list[pa.Array]:
    column = docs.column(name)
    return column.chunks if isinstance(column, pa.ChunkedArray) else [column]


def _cells(number: np.ndarray, part: np.ndarray, n: int) -> pa.RecordBatch:
    """(number, cell, had): of each term the cells of contributions down to the one with the n-th largest, and as cell -1 all below, which are no more than counted: n are above them already."""
    met, had = np.unique((number.astype(np.int64) << 32) + np.floor(part * CELLS).astype(np.int64), return_counts=True)
    term, cell, to = met >> 32, met & 0xFFFFFFFF, np.cumsum(had)
    last = np.searchsorted(term, term, "right") - 1
    low = to[last] - to >= n
    rest, first = np.unique(term[low], return_index=True)
    below = np.add.reduceat(had[low], first) if len(rest) else rest
    columns = (np.append(term[~low], rest), np.append(cell[~low], np.full(len(rest), -1)), np.append(had[~low], below))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c.astype(np.int64)) for c in columns[1:])], names=["number", "cell", "had"])


def top_counted(
    counted: DataFrame, terms: DataFrame, stats: DataFrame, wanted: DataFrame, n: int, *, places: int = 4, config: Bm25Config = Bm25Config(), counter: Accumulator | None = None
) -> DataFrame:
    """As ``top_postings`` over documents with their terms (``counted_documents``, each id once and none null): postings stay where their documents are, and queries come to them.

    wanted has ``QUERY_TERMS`` rows at most (counted by the caller).
    """
    spark = counted.sparkSession
    one = stats.first()  # one row
    avgdl, limit = one["avgdl"] or 1.0, SHARD_POSTINGS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _shards(batches, limit):
            _, number, part = _parts(docs, avgdl, config)
            yield _cells(number, part, n)

    cells = counted.select("dl", "numbers", "tfs").mapInArrow(count, "number int, cell long, had long")
    cells = written(cells.groupBy("number", "cell").agg(F.sum("had").alias("had")), "cells")  # read twice
    frequent = cells.groupBy("number").agg(F.sum("had").alias("df")).withColumn("idf", index.idf(F.lit(one["n"]), F.col("df")))
    asked = _weighed(wanted, terms.join(frequent, "number").join(_thresholds(cells, n), "number", "left"))
    shared = spark.sparkContext.broadcast(asked.toArrow())
    best = _best(n, places, counter)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _shards(batches, limit):
            row, number, part = _parts(docs, avgdl, config)
            posts = pa.table({"doc_id": docs.column("doc_id").take(pa.array(row)), "number": number.astype(np.int64), "part": part})
            yield from best(posts, shared.value).to_batches()

    kinds = wanted.schema["query_id"].dataType.simpleString(), counted.schema["doc_id"].dataType.simpleString()
    found = counted.mapInArrow(search, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return top_n(found.withColumn("score", F.round("score", places)), n)


def bm25_top(
    docs: DataFrame, queries: DataFrame, n: int, *, places: int = 4, config: Bm25Config = Bm25Config(), doc_id: str = "doc_id", query_id: str = "query_id", text_col: str = "text", counter: Accumulator | None = None
) -> DataFrame:
    """The n best documents of each query: ``index.bm25_scores`` and its best rows, without the scores of all others."""
    wanted = written(query_terms(queries, query_id, text_col), "wanted")
    terms = wanted.select("term").distinct()
    if wanted.limit(QUERY_TERMS + 1).count() > QUERY_TERMS or terms.limit(index.LOOKED_UP + 1).count() > index.LOOKED_UP:
        posts, stats = wanted_postings(docs, wanted, doc_id, text_col)
        return top_postings(posts, stats, wanted, n, places=places, config=config, counter=counter)
    counted, terms = counted_documents(docs, terms, doc_id, text_col)
    stats = written(corpus_stats(counted), "statistics")
    if counted.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        return top_postings(written(document_postings(counted, terms), "postings"), stats, wanted, n, places=places, config=config, counter=counter)
    return top_counted(counted, terms, stats, wanted, n, places=places, config=config, counter=counter)
