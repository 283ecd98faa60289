"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie of bytes. Greedy longest-match segmentation needs no second look at a byte: a node that cannot
go on pops the longest piece on its path and fails to the node that the rest of the path leads to. How many pieces are
popped on the way is computed with the failure link, once for each node, so that a word's length in pieces is a sum of
numbers read along its bytes: no piece is ever cut out or looked up.

Here all distinct words of an Arrow batch go through the automaton together, one byte position at a time (numpy), while
there are ``TOGETHER`` of them that long; the rest of the few longer ones is read byte by byte.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]``; a word with a stretch that no piece matches counts as one
unknown piece; null and empty texts have 0 words and 0 pieces; repeated rows are counted each; very long texts and words are
counted whole, in time linear in their length; there are no ties (the longest match is one); an empty table gives an empty table; further
columns are kept, whatever their names (an input column named like the output, in any case of letters, is replaced).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import as_chunks, but, by_place, span_hashes, word_spans, words_per_text

NONE = -1
#: Failure link of a node from which no piece can be popped: the word is unknown.
LOST = -2
#: Words that make a step of all of them together worth while.
TOGETHER = 48


class Automaton:
    """Trie over initial pieces (root 0) and continuing pieces (root 1), with failure links and popped counts."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]) -> None:
        edges: dict[int, int] = {}  # node * 256 + byte: child
        parent, byte, depth, root, final = [NONE, NONE], [0, 0], [0, 0], [0, 1], [False, False]
        for start, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = start
                for b in piece:
                    to = edges.get(at * 256 + b)
                    if to is None:
                        to = len(parent)
                        edges[at * 256 + b] = to
                        parent.append(at)
                        byte.append(b)
                        depth.append(depth[at] + 1)
                        root.append(start)
                        final.append(False)
                    at = to
                final[at] = final[at] or at > 1
        n = len(parent)
        fail, popped = [LOST] * n, [0] * n
        # breadth first: a link leads to a node that is not deeper, or to the root of continuing pieces
        for v in sorted(range(2, n), key=depth.__getitem__):
            if final[v]:
                fail[v], popped[v] = 1, 1
                continue
            u, count = fail[parent[v]], popped[parent[v]]
            while u != LOST and (u * 256 + byte[v]) not in edges:
                u, count = fail[u], count + popped[u]
            if u != LOST:
                fail[v], popped[v] = edges[u * 256 + byte[v]], count
        self.edges, self.links = edges, list(zip(fail, popped))
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.first = np.searchsorted(self.keys, np.arange(n + 1) * 256)
        # open addressing by node and byte would do as well; a table of 256 for the roots serves most first steps
        self.direct = np.full((2, 256), NONE, np.int64)
        for k, to in edges.items():
            if k < 512:
                self.direct[k // 256, k % 256] = to

    def _step(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """Children, or NONE."""
        out = np.full(len(nodes), NONE, np.int64)
        root = nodes < 2
        out[root] = self.direct[nodes[root], bytes_[root]]
        deep = np.flatnonzero(~root)
        if len(deep):
            keys = nodes[deep] * 256 + bytes_[deep]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[deep[hit]] = self.children[at[hit]]
        return out

    def _walk(self, data: bytes, node: int, total: int) -> tuple[int, int]:
        """Node and pieces popped after further bytes of one word; LOST for an unknown word."""
        child, links = self.edges.get, self.links
        for b in data:
            to = child(node << 8 | b)
            while to is None:
                back, popped = links[node]
                if back == LOST:
                    return LOST, 0
                node, total = back, total + popped
                to = child(node << 8 | b)
            node = to
        return node, total

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end] (1 for an unknown word)."""
        n = len(starts)
        node, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        live, lost = order, np.zeros(n, bool)
        alive_at = np.searchsorted(-lengths[order], -np.arange(1, (int(lengths.max()) if n else 0) + 1), "right")
        for position, count in enumerate(alive_at.tolist()):
            live = order[:count]
            todo = live[~lost[live]]
            if count < TOGETHER:
                for k in todo.tolist():
                    node[k], total[k] = self._walk(data[starts[k] + position : ends[k]].tobytes(), int(node[k]), int(total[k]))
                lost[todo] = node[todo] == LOST
                break
            sign = data[starts[todo] + position].astype(np.int64)
            while len(todo):
                to = self._step(node[todo], sign)
                ok = to >= 0
                node[todo[ok]] = to[ok]
                todo, sign = todo[~ok], sign[~ok]
                back = self.fail[node[todo]]
                lost[todo[back == LOST]] = True
                go = back != LOST
                todo, sign, back = todo[go], sign[go], back[go]
                total[todo] += self.popped[node[todo]]
                node[todo] = back
        # the end of the word: fail on until the root of continuing pieces is reached
        todo = np.flatnonzero(~lost & (lengths > 0))
        todo = todo[node[todo] != 1]
        while len(todo):
            back = self.fail[node[todo]]
            lost[todo[back == LOST]] = True
            go = back != LOST
            todo, back = todo[go], back[go]
            total[todo] += self.popped[node[todo]]
            node[todo] = back
            todo = todo[back != 1]
        return np.where(lost, 1, total)


@lru_cache(maxsize=4)
def byte_bpe_pieces(path: str) -> Automaton:
    """Automaton over the pieces of a byte-level vocabulary file.

    Tokens that begin with a space are initial pieces (without the space), the others are continuing pieces; every
    single byte may also begin a word, so that no word is unknown.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    tokens = [bytes(byte_of[c] for c in t) for t in vocab if all(c in byte_of for c in t)]
    initial = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1} | {bytes([b]) for b in range(256)}
    return Automaton(sorted(initial), sorted({t for t in tokens if t[:1] != b" "}))


@lru_cache(maxsize=4)
def wordpiece_pieces(tokens: tuple[str, ...], prefix: str = "##") -> Automaton:
    """Automaton over a word-piece vocabulary whose continuing pieces carry ``prefix``."""
    continuing = [t[len(prefix) :].encode() for t in tokens if t.startswith(prefix) and len(t) > len(prefix)]
    return Automaton([t.encode() for t in tokens if t and not t.startswith(prefix)], continuing)


def piece_counts(column: pa.Array, automaton: Automaton) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and pieces of every text, chunk by chunk."""
    for _, _, data, offsets in as_chunks(column):
        starts, ends = word_spans(data, offsets)
        borders = words_per_text(offsets, starts)
        if len(starts):
            _, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            pieces = automaton.counts(data, starts[first], ends[first])[inverse]
            upto = np.concatenate([[0], np.cumsum(pieces)])
        else:
            upto = np.zeros(1, np.int64)
        yield borders[1:] - borders[:-1], upto[borders[1:]] - upto[borders[:-1]]


def count_pieces(docs: DataFrame, vocabulary: str | tuple[str, ...], *, text_col: str = "text", words: str = "n_words", pieces: str = "n_pieces") -> DataFrame:
    """docs with two long columns: words and greedy word pieces of the text.

    vocabulary: path of a byte-level vocabulary file, or a tuple of word pieces with ``##`` before continuing ones.
    """
    kept = but(docs, words, pieces)
    at = docs.columns.index(text_col)
    schema = StructType([docs.schema[c] for c in kept]).add(words, "long").add(pieces, "long")
    places = [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = byte_bpe_pieces(vocabulary) if isinstance(vocabulary, str) else wordpiece_pieces(vocabulary)
        for batch in batches:
            found = list(piece_counts(batch.column(at), automaton))
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[*kept, words, pieces])

    return by_place(docs).mapInArrow(run, schema)
