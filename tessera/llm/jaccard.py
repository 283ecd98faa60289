"""Similarity join on word shingles (Jaccard), with a count-vector R-tree.

A document's set is its distinct five-word shingles (64-bit hashes); equal sets are one node, known by a 64-bit digest. Shingles are
hashed into groups; the number of a node's shingles in each group is its count vector, a point. Larger sets have more groups (a power
of two, so that a finer vector folds into a coarser one). The overlap of two sets is at most the sum of the coordinate minima of their
points, and of a set and any point in a box of an R-tree at most the sum of the minima with the box's upper corner. That prunes boxes
and pairs; what is left is verified on the whole sets.

An R-tree over a whole corpus would have to be met by every document, so nodes are first dealt to blocks, without loss:

* Order. Every shingle of every node is counted once (how many nodes hold it). The common order of shingles is: those of one node, the
  others by how many nodes hold them, and last the shingles of frequent hash cells (which are not counted, so that no counter gets an
  unbounded group).
* Places. If x, at place i of a set of n, is the first shingle that it shares with another, they overlap in at most n - i. With the
  overlap that similarity needs of two sizes, that bounds the other's size by ``most``. A node is placed under x only while ``most``
  is a possible size. Texts that share passages only, and near misses whose own words come first, have no place at all.
* Blocks. Nodes with a place under x are a block. The smaller of two similar nodes has ``most`` of at least its own size (it is home);
  so a block needs a home, and others stay only where some home's size is within their bound and theirs within a home's.
* Stars. In each block every node is verified against the home with the least part of own shingles. Groups of near copies, however
  large, thus fall together in linear time.
* Trees. Blocks that still hold several components are met by R-tree: the nodes outside the block's largest component (strays) ask a
  tree of its nodes, and one of the strays. Blocks are cut into tiles, so only strays are sent more than once. A task verifies what its bounds leave and
  returns just the links that join two components, so that no group becomes a table of pairs.

Every pair is ruled out by a bound, verified, or within one component in the end, so the components are exact. A task's work for a
block is strays times nodes; strays that share nearly all of their first shingles and miss the limit by a shingle or two can't be told apart by any of
these bounds and are compared one by one, inside the task.

Defined results: texts without words (null, empty, blank) have an empty set and are linked with nothing; fewer than five words are
one shingle; a null id is the smallest id; rows with equal ids are in one component, whatever their texts; repeated rows are returned as often as they occur;
very long texts are read whole; other columns are not read, so their names cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, shingle_sets, shuffle_width

LEAST_GROUPS, MOST_GROUPS = 16, 1 << 14
#: Cells of the frequency sketch; a cell is frequent if this part of all documents (and so many) hit it.
CELLS = 1 << 22
FREQUENT_PART, FREQUENT_LEAST = 0.001, 50
#: Nodes and shingles of one tile of a block.
TILE, TILE_ITEMS = 1024, 1 << 20
LEAF, FAN = 16, 8
#: Shingles that a task holds before it deals them out, and nodes that it remembers as dealt.
FLUSH, REMEMBERED = 1 << 20, 1 << 18
#: Bits of a shingle that order and blocks use (others would only tell apart shingles that are not shared).
KEY_BITS = 48
_LATE = 255  # class of shingles of frequent cells; the others' class is eight times the binary logarithm of their count
_NO_ID = -(1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def count_vector(s: np.ndarray) -> np.ndarray:
    """Shingles per group, by the hash's leading bits."""
    bits = int(np.clip(len(s).bit_length(), LEAST_GROUPS.bit_length() - 1, MOST_GROUPS.bit_length() - 1))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)


def fold(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector if len(vector) == groups else vector.reshape(groups, -1).sum(axis=1)


def most_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Upper bound of two sets' overlap by their count vectors."""
    groups = min(len(a), len(b))
    return int(np.minimum(fold(a, groups), fold(b, groups)).sum())


def packed(vector: np.ndarray) -> bytes:
    """Half a byte a count where all fit, else four bytes."""
    if vector.max(initial=0) < 16:
        return b"\x00" + (vector[::2] << 4 | vector[1::2]).astype(np.uint8).tobytes()
    return b"\x04" + vector.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[0] == 4:
        return np.frombuffer(data, "<u4", offset=1).astype(np.int64)
    pairs = np.frombuffer(data, np.uint8, offset=1)
    return np.stack([pairs >> 4, pairs & 15], axis=1).ravel().astype(np.int64)


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of kind 0: (id, n, node), node null where the set is empty; of kind 1: (cell, hits) of the frequency sketch."""
    schema = "kind int, id long, n long, node long, cell int, hits long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, count = np.zeros(CELLS, np.uint32), 0
        for batch in batches:
            sizes, nodes = [], []
            for s in shingle_sets(batch.column(1)):
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                if len(s):
                    np.add.at(sketch, (s & np.uint64(CELLS - 1)).astype(np.int64), 1)
            n = batch.num_rows
            count += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names
            )
        # cells that are at least half as frequent here as it takes overall, and stand out from chance hits
        chance = float(sketch.sum(dtype=np.int64)) / CELLS
        cells = np.flatnonzero(sketch >= max(4, count * FREQUENT_PART / 2, chance + 6 * chance**0.5))
        n = len(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), *[pa.nulls(n, pa.int64()) for _ in range(3)], pa.array(cells.astype(np.int32)), pa.array(sketch[cells].astype(np.int64))], names=names
        )

    return materialise(_plain(docs, id_col, text_col).mapInArrow(run, schema), "jaccard-rows")


def frequent_cells(table: DataFrame, documents: int) -> np.ndarray:
    """Bitmap of frequent cells: CELLS bits, whatever the number of documents."""
    least = max(FREQUENT_LEAST, documents * FREQUENT_PART)
    hits = table.filter("kind = 1").groupBy("cell").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= least)
    found = np.zeros(CELLS, bool)
    found[[r[0] for r in hits.select("cell").collect()]] = True  # at most CELLS numbers
    return found


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(value, rows) of each run of the first column of a sorted partition."""
    held: list[pa.RecordBatch] = []
    value = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
        for a, b in zip(cuts, cuts[1:]):
            if held and first[a] != value:
                yield value, pa.Table.from_batches(held)
                held = []
            value = int(first[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield value, pa.Table.from_batches(held)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


#: A node (n shingles, ``counted`` of them sent to be counted, ``late`` of them of frequent cells, the first of these), or a chunk of shingles.
_DEALT = "bucket int, node long, n long, counted long, late long, first binary, nodes binary, keys binary, classes binary"
_NAMES = [c.split()[0] for c in _DEALT.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 4]


def _dealt(**columns: list | np.ndarray) -> pa.RecordBatch:
    n = len(columns["bucket"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _spread(nodes: np.ndarray, bits: int) -> np.ndarray:
    return (nodes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)


def places(docs: DataFrame, frequent: np.ndarray, text_col: str, percent: int) -> DataFrame:
    """(key, node, n, own, most): the shingles under which a node is placed, its number of own shingles, and the most that a partner can have there."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.packbits(frequent))
    width = shuffle_width(spark)
    bits = (4 * width - 1).bit_length()  # buckets of keys, and of nodes
    slots = max(16, bits + 2)
    low = KEY_BITS - slots

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes, once each, and their shingles in chunks by bucket: the number in each slot (leading bits), and the other bits."""
        often = np.unpackbits(shared.value, count=CELLS).astype(bool)
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        holders: list[tuple[int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            key = np.concatenate(keys)
            node = np.repeat(np.array([h[0] for h in holders], np.int64), [h[1] for h in holders])
            keys.clear()
            holders.clear()
            order = np.argsort(key)
            key, node = key[order], node[order]
            bucket = (key >> np.uint64(KEY_BITS - bits)).astype(np.int32)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(key))
            slot = (key >> np.uint64(low)).astype(np.int64)
            key = (key & np.uint64((1 << low) - 1)).astype(np.uint32)
            per = 1 << (slots - bits)
            for at in range(0, len(starts), 256):
                runs = list(zip(starts[at : at + 256].tolist(), ends[at : at + 256].tolist()))
                counts = [np.bincount(slot[a:b] & (per - 1), minlength=per).astype(np.uint32).tobytes() for a, b in runs]
                yield _dealt(bucket=bucket[starts[at : at + 256]], nodes=[node[a:b].tobytes() for a, b in runs], keys=[key[a:b].tobytes() for a, b in runs], classes=counts)

        size = 0
        for batch in batches:
            out: dict[str, list] = {c: [] for c in _NAMES[1:6]}
            for s in shingle_sets(batch.column(0)):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                late = often[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                key = s >> np.uint64(64 - KEY_BITS)
                counted = key[~late]
                if len(counted) > 1:
                    counted = counted[np.append(True, counted[1:] != counted[:-1])]
                key = key[late]
                for to, v in zip(out.values(), (node, len(s), len(counted), len(key), key[: prefix_length(len(s), percent)].tobytes())):
                    to.append(v)
                keys.append(counted)
                holders.append((node, len(counted)))
                size += len(counted)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
            if out["node"]:
                yield _dealt(bucket=_spread(np.array(out["node"], np.int64), bits), **out)
        yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles that several nodes hold, with the class of their number, in chunks by node; nodes pass."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key, node, kind = (np.concatenate(x) for x in zip(*held))
            held.clear()
            bucket = _spread(node, bits)
            order = np.argsort(bucket, kind="stable")
            key, node, kind, bucket = key[order], node[order], kind[order], bucket[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.zeros(0, np.int64)
            runs = list(zip(starts.tolist(), np.append(starts[1:], len(key)).tolist()))
            # six of a key's eight bytes are in use
            keys = [np.ascontiguousarray(key[a:b].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for a, b in runs]
            yield _dealt(bucket=bucket[starts], nodes=[node[a:b].tobytes() for a, b in runs], keys=keys, classes=[kind[a:b].tobytes() for a, b in runs])

        size = 0
        for bucket, rows in _groups(batches):
            plain = rows.filter(pc.is_valid(rows["node"]))
            yield from plain.to_batches()
            rows = rows.filter(pc.is_valid(rows["nodes"]))
            if not len(rows):
                continue
            per = 1 << (slots - bits)
            first = np.tile(np.arange(per, dtype=np.uint64), len(rows)) + np.uint64(bucket * per)
            key = np.repeat(first, _joined(rows["classes"], np.uint32)) << np.uint64(low) | _joined(rows["keys"], np.uint32)
            node = _joined(rows["nodes"], np.int64)
            order = np.argsort(key)
            key, node = key[order], node[order]
            again = np.zeros(len(key) + 1, bool)
            again[1:-1] = key[1:] == key[:-1]
            several = again[1:] | again[:-1]
            key, node = key[several], node[several]
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            holders = np.diff(np.append(starts, len(key)))
            kind = np.repeat(np.minimum(_LATE - 1, 8 * np.log2(np.maximum(holders, 1))).astype(np.uint8), holders)
            wanted = np.repeat(holders > 1, holders)
            held.append((key[wanted], node[wanted], kind[wanted]))
            size += int(wanted.sum())
            if size >= FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            plain = rows.filter(pc.is_valid(rows["node"]))
            if not len(plain):
                continue
            nodes, at = np.unique(plain["node"].to_numpy(), return_index=True)
            n, counted, late = (plain[c].to_numpy()[at] for c in ("n", "counted", "late"))
            chunks = rows.filter(pc.is_valid(rows["nodes"]))
            key = np.zeros((sum(len(x.as_buffer()) for x in chunks["keys"]) // 6, 8), np.uint8)
            key[:, :6] = _joined(chunks["keys"], np.uint8).reshape(-1, 6)
            key = key.view(np.uint64).ravel()
            who = np.searchsorted(nodes, _joined(chunks["nodes"], np.int64))
            kind = _joined(chunks["classes"], np.uint8)
            own = counted - np.bincount(who, minlength=len(nodes))
            possible = own < n - -(-percent * n // 100) + 1
            wanted = possible[who]
            key, who, kind = key[wanted] << np.uint64(1), who[wanted], kind[wanted]
            some = np.flatnonzero(possible & (late > 0))
            if len(some):
                firsts = [np.frombuffer(plain["first"][int(at[k])].as_buffer(), np.uint64) for k in some.tolist()]
                key = np.concatenate([key, np.concatenate(firsts) << np.uint64(1) | np.uint64(1)])
                who = np.concatenate([who, np.repeat(some, [len(x) for x in firsts])])
                kind = np.concatenate([kind, np.full(len(key) - len(kind), _LATE, np.uint8)])
            if not len(key):
                continue
            order = np.lexsort((key, kind, who))
            key, who = key[order], who[order]
            starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
            most = (100 + percent) * (n[who] - own[who] - rank) // percent - n[who]
            kept = most * 100 >= percent * n[who]
            key, who, most = key[kept], who[kept], most[kept]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nodes[who]), pa.array(n[who]), pa.array(own[who]), pa.array(most)], names=["key", "node", "n", "own", "most"])

    dealt = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(deal, _DEALT)
    counted = dealt.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(count, _DEALT)
    placed = counted.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(place, "key long, node long, n long, own long, most long")
    return materialise(placed, "jaccard-places")


def blocks(placed: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, most, hub): what can have a partner under its key; hub: the home with the least part of own shingles."""
    home = F.col("most") >= F.col("n")
    seen = placed.groupBy("key").agg(
        F.count("*").alias("m"),
        F.min(F.when(home, F.col("n"))).alias("least"),
        F.max(F.when(home, F.col("most"))).alias("greatest"),
        F.min(F.when(home, F.struct((F.col("own") / F.col("n")).alias("part"), "node", "n"))).alias("hub"),
    )
    seen = seen.filter("m > 1 AND least IS NOT NULL")
    both = placed.join(seen, "key").filter((F.col("most") >= F.col("least")) & (F.col("n") <= F.col("greatest")))
    return materialise(both.select("key", "node", "n", "most", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "jaccard-blocks")


def node_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, vector, items) of the wanted nodes, made from one document of each."""
    ids = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id")).join(wanted, "node", "left_semi").select("id").distinct()
    texts = _plain(docs, id_col, text_col).join(ids.hint("merge"), "id", "left_semi").select("text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, vectors, items = [], [], []
            for s in shingle_sets(batch.column(0)):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                vectors.append(packed(count_vector(s)))
                items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(vectors, pa.binary()), pa.array(items, pa.binary())], names=["node", "vector", "items"])

    sets = materialise(texts.mapInArrow(make, "node long, vector binary, items binary"), "jaccard-sets", codec="lz4")
    # only repeated ids make a set more than once
    if sets.groupBy("node").count().filter("count > 1").limit(1).count():
        sets = materialise(sets.dropDuplicates(["node"]), "jaccard-sets", codec="lz4")
    return sets


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for v, w, x, y in zip(*(batch.column(k) for k in range(2, 6))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                bound = most_overlap(unpacked(v.as_py()), unpacked(w.as_py()))
                keep.append(bound * (100 + percent) >= percent * (len(x) + len(y)) and similar(x, y, percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    # written, so that the join's own exchange of a hub with many pairs can be split
    left = materialise(sets.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "jaccard-hubs", codec="lz4").toDF("a", "v", "x")
    right = sets.toDF("b", "w", "y")
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select("a", "b", "v", "w", "x", "y").mapInArrow(check, "a long, b long")


class CountTree:
    """R-tree over count vectors, bulk-loaded by halving along the widest coordinate; boxes keep their upper corners."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        self.vectors, self.sizes = vectors, sizes
        leaves: list[np.ndarray] = []
        todo = [np.arange(len(sizes))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                leaves.append(own)
                continue
            spread = np.concatenate([vectors[own], sizes[own, None]], axis=1)
            widest = int((spread.max(axis=0) - spread.min(axis=0)).argmax())
            own = own[np.argsort(spread[:, widest], kind="stable")]
            todo += [own[len(own) // 2 :], own[: len(own) // 2]]
        #: Levels of boxes from the points up: the borders of each box's children, upper corner, least and greatest size.
        self.points = np.concatenate(leaves)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        borders = np.cumsum([0, *map(len, leaves)])
        upper, least, most = vectors[self.points], sizes[self.points], sizes[self.points]
        while True:
            starts = borders[:-1]
            upper, least, most = np.maximum.reduceat(upper, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((borders, upper, least, most))
            if len(starts) == 1:
                return
            borders = np.append(np.arange(0, len(starts), FAN), len(starts))

    def near(self, vector: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points that the bounds leave as possible partners, found by descent from the root."""
        # overlap >= percent / (100 + percent) * (size + other), other between percent of size and size over percent
        at = np.zeros(1, np.int64)
        for borders, upper, least, most in reversed(self.levels):
            possible = (most[at] * 100 >= percent * size) & (least[at] * percent <= 100 * size)
            at = at[possible]
            bound = np.minimum(upper[at], vector).sum(axis=1)
            other = np.maximum(least[at], -(-percent * size // 100))
            at = at[bound * (100 + percent) >= percent * (size + other)]
            if not len(at):
                return at
            at = np.concatenate([np.arange(borders[k], borders[k + 1]) for k in at.tolist()])
        at = self.points[at]
        bound = np.minimum(self.vectors[at], vector).sum(axis=1)
        return at[bound * (100 + percent) >= percent * (size + self.sizes[at])]


def tree_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of components that a block's R-trees and the verification of what they leave join.

    members: (key, node, n, most, component), blocks of several components.
    """
    spark = members.sparkSession
    width = shuffle_width(spark)
    per = members.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("items"))
    tiles = lambda m, items: F.greatest(F.lit(1), F.ceil(m / TILE), F.ceil(items / TILE_ITEMS)).cast("int")
    per = per.groupBy("key").agg(F.max(F.struct("m", "component", "items")).alias("main"), F.sum("m").alias("m"), F.sum("items").alias("items"))
    per = per.select("key", F.col("main.component").alias("main"), tiles(F.col("main.m"), F.col("main.items")).alias("mains"), tiles(F.col("m") - F.col("main.m"), F.col("items") - F.col("main.items")).alias("strays"))
    rows = members.join(per, "key").withColumn("stray", F.col("component") != F.col("main"))
    spot = F.xxhash64(F.lit(3), "node")
    rows = rows.withColumn("tile", F.when(F.col("stray"), F.pmod(spot, F.col("strays"))).otherwise(F.pmod(spot, F.col("mains"))).cast("int"))
    # a tile of strays meets the tiles of the main component (low, -1 - high) and each tile of strays (low, high)
    line = lambda n: F.sequence(F.lit(0), n - 1)
    to_mains = F.transform(line(F.col("mains")), lambda k: F.struct(F.col("tile").alias("low"), (-1 - k).alias("high")))
    to_strays = F.transform(line(F.col("strays")), lambda k: F.struct(F.least("tile", k).alias("low"), F.greatest("tile", k).alias("high")))
    from_mains = F.transform(line(F.col("strays")), lambda k: F.struct(k.alias("low"), (-1 - F.col("tile")).alias("high")))
    rows = rows.withColumn("to", F.explode(F.when(F.col("stray"), F.concat(to_mains, to_strays)).otherwise(from_mains)))
    rows = rows.select(F.xxhash64("key", "to.low", "to.high").alias("meeting"), "node", "n", "most", "component", "stray", "tile")
    rows = rows.join(sets.hint("merge"), "node").select("meeting", "node", "n", "most", "component", "stray", "tile", "vector", "items")

    def links(rows: pa.Table) -> Iterator[tuple[int, int]]:
        node, n, most, part, stray, tile = (rows[c].to_numpy() for c in ("node", "n", "most", "component", "stray", "tile"))
        names, label = np.unique(part, return_inverse=True)
        if len(names) < 2:
            return
        asks = np.flatnonzero(stray)
        others = np.flatnonzero(~stray) if not stray.all() else asks
        mixed = bool(stray.all() and tile.min() != tile.max())  # two tiles of strays: pairs within one are met elsewhere
        vectors = [unpacked(rows["vector"][k].as_py()) for k in range(len(node))]
        groups = min(len(v) for v in vectors)
        vectors = np.stack([fold(v, groups) for v in vectors]).astype(np.int32)
        sets = [np.frombuffer(rows["items"][k].as_buffer(), np.uint64) for k in range(len(node))]
        tree = CountTree(vectors[others], n[others])
        for i in asks.tolist():
            at = others[tree.near(vectors[i], int(n[i]), percent)]
            at = at[(n[at] <= most[i]) & (most[at] >= n[i])]
            if others is asks:
                at = at[at > i]
            if mixed:
                at = at[tile[at] != tile[i]]
            for j in at.tolist():
                if label[i] != label[j] and similar(sets[i], sets[j], percent):
                    yield int(names[label[i]]), int(names[label[j]])
                    # the two are one component from here on
                    names[label[i]] = names[label[j]] = min(names[label[i]], names[label[j]])
                    label[label == label[j]] = label[i]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            found = list(links(rows))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return rows.repartition(width, "meeting").sortWithinPartitions("meeting", "node").mapInArrow(meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge; component: its smallest reachable node.

    Each round a node and the node that its label names take the least label among the node's neighbours (map-side combined
    minima), then the label's label. Labels only fall, and rounds go on until none moves; since whole trees of labels are hooked at
    once, chains take rounds as the logarithm of their length, whatever the order of their ids.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "components-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component"))
    table = labels = materialise(labels, "components-labels")
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("component").alias("theirs"))
        around = both.join(known, "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        offers = labels.join(around.withColumnRenamed("a", "node"), "node").select(F.explode(F.array("node", "component")).alias("node"), "theirs")
        offers = offers.groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = labels.join(offers, "node", "left")
        step = step.select("node", F.least("component", "theirs").alias("next"), "component")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        new = step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("component"), F.col("component").alias("before"))
        new = materialise(new, "components-labels")
        moved = new.filter(F.col("component") != F.col("before")).limit(1).count()
        release(table)
        table, labels = new, new.select("node", "component")
        if not moved:
            release(both)
            labels._scratch_path = table._scratch_path
            return labels


def similar_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: components of Jaccard * 100 >= percent."""
    rows = document_sets(docs, id_col, text_col)
    own = rows.filter("kind = 0").select("id", "n", "node")
    placed = places(docs, frequent_cells(rows, own.count()), text_col, percent)
    block = blocks(placed, percent)
    release(placed)
    sets = node_sets(docs, own, block.select("node").distinct(), id_col, text_col)

    # stars: every node of a block and its hub
    sizes = (F.col("n") * 100 >= percent * F.col("hub_n")) & (F.col("hub_n") * 100 >= percent * F.col("n")) & (F.col("hub_n") <= F.col("most"))
    stars = block.filter((F.col("node") != F.col("hub")) & sizes).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    first = components(verified(stars, sets, percent))

    # trees: blocks that still span several components
    part = block.select("key", "node", "n", "most").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    part = materialise(part, "jaccard-part")
    spanning = part.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    members = materialise(part.join(spanning, "key", "left_semi"), "jaccard-spanning")
    joined = components(tree_links(members, sets, percent))
    last = joined.toDF("component", "final")
    both = first.join(last, "component", "left").select("node", F.coalesce("final", "component").alias("component"))
    alone = last.join(first, last["component"] == first["component"], "left_anti").toDF("node", "component")

    # documents: component by node, then one for all rows of an id
    found = own.join(both.union(alone), "node", "left").select("id", "n", F.coalesce("component", "node").alias("component"))
    found = materialise(found, "jaccard-found")
    release(rows, block, sets, first, part, members, joined)
    by_id = found.groupBy("id").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"), F.count("component").alias("k"))
    mixed = by_id.filter("m > 1 AND (x <> y OR m <> k)")
    if mixed.limit(1).count():
        merged = components(found.join(mixed.select("id", "x"), "id").filter("component <> x").select(F.col("x").alias("a"), F.col("component").alias("b")).distinct())
        same = found.join(mixed.select("id", "x"), "id", "left").withColumn("component", F.coalesce("component", "x")).drop("x")
        same = same.join(merged.toDF("component", "final"), "component", "left")
        found = materialise(same.select("id", "n", F.coalesce("final", "component").alias("component")), "jaccard-found")
    # written, so that the join's own exchange of a large component can be split
    least = materialise(found.filter("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least")), "jaccard-least")
    out = found.join(least, "component", "left").withColumn("least", F.coalesce("least", "id"))
    shown = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select(shown("id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("least").alias("component_id"))
