"""Best-fit packing of token pieces into sequences of a fixed length, improved by swaps.

1. ``token_pieces`` encodes the texts (Arrow batches, numpy) and cuts those that are too long; the table of pieces,
   token ids included, is written once.
2. Full pieces are sequences by themselves. The others are dealt at random to shards of about ``SHARD`` pieces (row
   numbers, not ids, so no document or source can make a shard large). Each shard is packed by best fit, longest
   first, then improved by local search: between underfull bins a piece moves, or one is exchanged for one, or two
   for one, whenever the sum of squared fills grows. Fuller bins grow, the emptiest lose pieces until they are empty.
3. What stays underfull in a shard is packed once more with that of other shards, by the same search, in shards of the same size.

Only (row, length) takes part in the packing: no text or token is shuffled for it.

Defined results: the file's added tokens have ids of their own wherever their literals stand; a null text is an empty text (it holds the end token alone); rows with equal ids are packed as rows of their own;
very long texts are cut into as many pieces as they need; pieces of equal length go in the order of their row numbers, and of bins that fit equally well
any may be taken (the result is one of the best found, the same in each run over the same rows); an empty table gives an empty table; further input columns, whatever their
names, are not returned.
"""

from __future__ import annotations

import json
import os
import re
from bisect import insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, span_hashes

#: Pieces of a shard, about. A shard leaves one or a few bins underfull.
SHARD = 20_000
#: Sweeps of the local search over the underfull bins, at most; it ends sooner when a sweep finds nothing.
SWEEPS = 8
#: Encoded pre-tokens that a Python worker keeps, at most.
CACHE = 1_000_000


class BatchEncoder:
    """Token ids of whole columns of text, as the byte-level BPE file at ``path`` gives them.

    The byte-level pre-tokeniser's pattern is followed by array operations over code points; each different pre-token
    is encoded once, and arrays put the ids together. Character classes come from the tokenizer's own pre-tokeniser,
    asked once for each code point that occurs. Where the file's ids are in the order of its merges, the single pre-tokens
    are merged by tiktoken with the ids as ranks, which gives the same ids in a fifth of the time (a test holds
    both against the tokenizer on whole texts); any other file's pre-tokens go through the tokenizer.

    ``encode`` takes all of a text for plain text; ``encode_all`` gives the file's added tokens their own ids, as the tokenizer does.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = self._ranked(path)
        self._find_added(path)
        self.kind = np.zeros(0x110000, np.uint8)  # 0 unknown, 1 letter, 2 number, 3 other, 4 white space
        self._reset()

    def _find_added(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            added = [t for t in json.load(f).get("added_tokens") or [] if t["content"]]
        self.added_ids = {t["content"]: t["id"] for t in added}
        # the longest of those that begin at a place
        literals = sorted(self.added_ids, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, literals)) + ")") if literals else None
        # tokens that take white space along, stand as whole words only or are looked for in two rounds: such texts go through the tokenizer
        odd = any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")) or len({bool(t.get("normalized")) for t in added}) > 1
        self.whole = Tokenizer.from_file(path) if odd else None

    def _ranked(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if any(b <= a for a, b in zip(merged[:-1], merged[1:])):
            return None
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        used = set(merged)
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if len(token) == 1 or i in used}
        return tiktoken.Encoding("pretokens", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.places = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, points: np.ndarray) -> None:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            # a surrogate or a lone mark behaves as its class does beside a letter, a number or a sign
            if len(split("a" + c)) == 1:
                self.kind[p] = 1
            elif len(split("1" + c)) == 1:
                self.kind[p] = 2
            elif len(split("!" + c)) == 1:
                self.kind[p] = 3
            else:
                self.kind[p] = 4

    def pretokens(self, text: str, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, and starts and ends of the pre-tokens; borders: where the texts begin and end."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if n == 0:
            return points, np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.kind[points]
        if not kind.all():
            self._learn(np.unique(points[kind == 0]))
            kind = self.kind[points]
        new = np.empty(n + 1, bool)  # a pre-token starts here
        new[0] = new[n] = True
        new[1:n] = kind[1:] != kind[:-1]
        edge = np.zeros(n + 1, bool)
        edge[borders] = True
        new |= edge
        blank = kind == 4
        # the last white space of a run stands alone before other signs of the same text; if it is U+0020, it joins them
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n])
        new[last] = True
        new[last[points[last] == 32] + 1] = False
        # 's 't 're 've 'm 'll 'd at the start of a pre-token
        quote = np.flatnonzero((points == 39) & new[:n] & np.append(new[1:n], True))
        quote = quote[(quote + 1 < n) & ~edge[np.minimum(quote + 1, n)]]
        if len(quote):
            one = points[quote + 1]
            two = points[np.minimum(quote + 2, n - 1)]
            whole2 = (quote + 2 < n) & ~edge[np.minimum(quote + 2, n)]
            short = np.isin(one, [115, 116, 109, 100])
            long = whole2 & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
            for at, size in ((quote[short], 1), (quote[long & ~short], 2)):
                for k in range(1, size + 1):
                    new[at + k] = False
                new[np.minimum(at + size + 1, n)] = True
        starts = np.flatnonzero(new[:n])
        return points, starts, np.append(starts[1:], n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the borders of the texts in them."""
        if len(self.keys) > CACHE:
            self._reset()
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        borders = np.concatenate([[0], np.cumsum(sizes)])
        text = "".join(texts)
        points, starts, ends = self.pretokens(text, borders)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        keys, first, inverse = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        missing = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(missing):
            a, b = starts[first[missing]].tolist(), ends[first[missing]].tolist()
            if self.ranked is not None:
                encode = self.ranked.encode_ordinary
                ids = [encode(text[x:y]) for x, y in zip(a, b)]
            else:
                ids = [e.ids for e in self.tokenizer.encode_batch([text[x:y] for x, y in zip(a, b)], add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            fresh = np.arange(len(self.lengths), len(self.lengths) + len(ids))
            self.places = np.concatenate([self.places, len(self.pool) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))])
            self.keys = np.insert(self.keys, at[missing], keys[missing])
            self.slots = np.insert(self.slots, at[missing], fresh)
            at = np.searchsorted(self.keys, keys)
        own = self.slots[at][inverse]
        lengths = self.lengths[own]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        place = np.arange(upto[-1]) - np.repeat(upto[:-1] - self.places[own], lengths)
        return self.pool[place], upto[np.searchsorted(starts, borders, "left")]


    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode``, with the file's added tokens by their own ids: what the tokenizer gives with add_special_tokens=False."""
        held = [i for i, t in enumerate(texts) if self.added.search(t)] if self.added else []
        if not held:
            return self.encode(texts)
        parts: list[str] = []  # texts between the added tokens
        first = np.zeros(len(texts) + 1, np.int64)  # of each text's parts
        after: list[int] = []  # the part that an added token follows
        ids: list[int] = []
        odd = set(held)
        for i, t in enumerate(texts):
            if i not in odd:
                parts.append(t)
            elif self.whole is not None:
                own = self.whole.encode(t, add_special_tokens=False).ids
                after += [len(parts)] * len(own)
                ids += own
                parts.append("")
            else:
                split = self.added.split(t)
                after += range(len(parts), len(parts) + len(split) // 2)
                ids += [self.added_ids[x] for x in split[1::2]]
                parts += split[::2]
            first[i + 1] = len(parts)
        flat, borders = self.encode(parts)
        before = np.searchsorted(np.array(after), first, "left")  # added tokens before each text
        return np.insert(flat, borders[np.array(after) + 1], np.array(ids, np.uint32)), borders[first] + before


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """One encoder a worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]


def text_groups(column: pa.Array, limit: int = 1 << 21) -> Iterator[list[str]]:
    """Texts of a column in lists of about ``limit`` characters; null is the empty text."""
    group, size = [], 0
    for t in column.to_pylist():
        t = t or ""
        if group and size + len(t) > limit:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def token_pieces(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, end_id: int = 2
) -> DataFrame:
    """(row, doc_id, piece, start, length, ids): ids as little-endian unsigned 32-bit numbers. Written once."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_all
        for batch in batches:
            row = 0
            for texts in text_groups(batch.column(1)):
                flat, borders = encode(texts)
                out: tuple[list, ...] = ([], [], [], [], [])
                for i in range(len(texts)):
                    ids = np.append(flat[borders[i] : borders[i + 1]], np.uint32(end_id)).astype("<u4")
                    total = len(ids)
                    head = total % limit or limit
                    cuts = [0, *range(head, total + 1, limit)] if total > limit else [0, total]
                    for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        for to, x in zip(out, (row + i, piece, a, b - a, ids[a:b].tobytes())):
                            to.append(x)
                rows = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )
                row += len(texts)

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = plain.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary")
    return materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")


def pack_bins(lengths: np.ndarray, limit: int = 1024, sweeps: int = SWEEPS) -> list[list[int]]:
    """Bins of item numbers: best fit, longest first, then swaps. All lengths are from 1 to limit."""
    order = np.argsort(-lengths, kind="stable").tolist()
    size = lengths.tolist()
    bins: list[list[int]] = []
    free: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(limit + 1)]
    open_sizes = 0  # bit f: some bin has f free
    for i in order:
        need = size[i]
        fits = open_sizes >> need << need
        if fits:
            f = (fits & -fits).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                open_sizes ^= 1 << f
            bins[b].append(i)
        else:
            f, b = limit, len(bins)
            bins.append([i])
            free.append(0)
        left = f - need
        free[b] = left
        if left:
            if not by_free[left]:
                open_sizes |= 1 << left
            by_free[left].append(b)
    _search(bins, free, size, limit, sweeps)
    return [b for b in bins if b]


def _search(bins: list[list[int]], free: list[int], size: list[int], limit: int, sweeps: int) -> None:
    """Moves and exchanges between underfull bins that raise the sum of squared fills; empties bins in place.

    An exchange that raises bin A's fill by d and lowers bin B's by d changes the sum of squares by
    2 d (fill A - fill B + d): it is taken if d is positive, fits A, and fill A + d is above fill B.
    """
    where: dict[int, list[tuple[int, int]]] = {}  # length: sorted (free of its bin, as it was listed; item)
    home: dict[int, int] = {}
    lengths_open = 0

    def list_item(i: int, b: int) -> None:
        nonlocal lengths_open
        home[i] = b
        held = where.setdefault(size[i], [])
        if not held:
            lengths_open |= 1 << size[i]
        insort(held, (free[b], i))

    def unlist(i: int, f: int) -> None:
        nonlocal lengths_open
        held = where[size[i]]
        held.remove((f, i))
        if not held:
            lengths_open ^= 1 << size[i]

    underfull = [b for b in range(len(bins)) if bins[b] and free[b]]
    for b in underfull:
        for i in bins[b]:
            list_item(i, b)

    def emptiest(length: int, a: int) -> int:
        """Item of this length in the emptiest bin but a, or -1."""
        for _, i in reversed(where.get(length, ())):
            if home[i] != a:
                return i
        return -1

    def lengths_below(top: int, least: int, tries: int) -> Iterator[int]:
        mask = lengths_open & ((1 << (top + 1)) - 1)
        for _ in range(tries):
            if not mask:
                return
            x = mask.bit_length() - 1
            if x < least:
                return
            yield x
            mask ^= 1 << x

    def rebuild(b: int, before: int, gone: list[int], come: list[int]) -> None:
        for i in bins[b]:
            unlist(i, before)
        bins[b] = [i for i in bins[b] if i not in gone] + come
        free[b] = limit - sum(size[i] for i in bins[b])

    def swap(a: int, out: list[int], b: int, back: list[int]) -> None:
        """out leaves a for b, back leaves b for a."""
        fa, fb = free[a], free[b]
        rebuild(a, fa, out, back)
        rebuild(b, fb, back, out)
        for x in (a, b):
            for i in bins[x]:
                list_item(i, x)

    def improve(a: int) -> bool:
        room = free[a]
        fill = limit - room
        best: tuple[int, list[int], int, list[int]] | None = None
        # move one, or exchange one of ours for a longer one
        for x in [None, *bins[a]]:
            own = size[x] if x is not None else 0
            for length in lengths_below(own + room, own + 1, 6):
                y = emptiest(length, a)
                gain = length - own
                if y >= 0 and fill + gain > limit - free[home[y]]:
                    if best is None or gain > best[0]:
                        best = (gain, [x] if x is not None else [], home[y], [y])
                    break
            if best and best[0] == room:
                break
        if best is None or best[0] < room:
            # two of theirs for one of ours (or for none), from one bin
            for x in [None, *bins[a]]:
                own = size[x] if x is not None else 0
                for length in lengths_below(own + room - 1, 1, 6):
                    y = emptiest(length, a)
                    if y < 0:
                        continue
                    b = home[y]
                    for z in bins[b]:
                        gain = length + size[z] - own
                        if z != y and 0 < gain <= room and fill + gain > limit - free[b] and (best is None or gain > best[0]):
                            best = (gain, [x] if x is not None else [], b, [y, z])
                if best and best[0] == room:
                    break
        if best is None or best[0] < room:
            # two of ours for one of theirs
            own_items = bins[a]
            for p in range(len(own_items)):
                for q in range(p):
                    own = size[own_items[p]] + size[own_items[q]]
                    for length in lengths_below(min(limit, own + room), own + 1, 3):
                        y = emptiest(length, a)
                        gain = length - own
                        if y >= 0 and fill + gain > limit - free[home[y]] and (best is None or gain > best[0]):
                            best = (gain, [own_items[p], own_items[q]], home[y], [y])
        if best is None:
            return False
        swap(a, best[1], best[2], best[3])
        return True

    for _ in range(sweeps):
        changed = False
        # the fullest first: they are nearest to being full
        for a in sorted((b for b in underfull if bins[b] and free[b]), key=lambda b: (free[b], b)):
            while bins[a] and free[a] and improve(a):
                changed = True
        for b in underfull:
            if bins[b] and not free[b]:
                for i in bins[b]:
                    if home.get(i) == b:
                        unlist(i, 0)
                        del home[i]
        underfull = [b for b in underfull if bins[b] and free[b]]
        if not changed or len(underfull) < 2:
            break


def _place(rows: DataFrame, limit: int, tag: int) -> DataFrame:
    """(row, length, shard) to (row, length, sequence_id, offset, fill)."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", kind="stable")
        row, length = part["row"].to_numpy(), part["length"].to_numpy()
        bins = pack_bins(length, limit)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(row))
        sizes = np.fromiter((len(b) for b in bins), np.int64, len(bins))
        which = np.repeat(np.arange(len(bins)), sizes)
        own = length[order]
        upto = np.cumsum(own) - own
        first = np.cumsum(sizes) - sizes
        offset = upto - np.repeat(upto[first], sizes)
        fill = np.add.reduceat(own, first)
        ids = (np.int64(key[0]) << np.int64(24)) + which + (np.int64(tag) << np.int64(56))
        return pd.DataFrame({"row": row[order], "length": own, "sequence_id": ids, "offset": offset, "fill": np.repeat(fill, sizes)})

    return rows.groupBy("shard").applyInPandas(run, "row long, length long, sequence_id long, offset long, fill long")


def place_pieces(pieces: DataFrame, limit: int = 1024) -> DataFrame:
    """(row, sequence_id, offset) of every piece of ``token_pieces``."""
    rows = pieces.select("row", "length")
    full = rows.filter(F.col("length") >= limit).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = rows.filter(F.col("length") < limit)

    def dealt(df: DataFrame, count: int, salt: int) -> DataFrame:
        shards = max(1, -(-count // SHARD))
        return df.withColumn("shard", F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(shards)))

    first = materialise(_place(dealt(part, part.count(), 1), limit, 1), "pack-first")
    # bins that miss more than a few tokens get a second search, together with those of other shards
    loose = first.filter(F.col("fill") < limit - limit // 64).select("row", "length")
    second = _place(dealt(loose, loose.count(), 2), limit, 2)
    kept = first.filter(F.col("fill") >= limit - limit // 64)
    return full.unionByName(kept.select("row", "sequence_id", "offset")).unionByName(second.select("row", "sequence_id", "offset"))


def pack_sequences(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, end_id: int = 2, keep_ids: bool = True
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids (if keep_ids) or ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, limit=limit, end_id=end_id)
    shown = pieces if keep_ids else pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return shown.join(place_pieces(pieces, limit), "row").drop("row")
