"""Greedy longest-match piece counts by a linear automaton over a vocabulary trie.

Each state of the trie carries a failure link (the state reached once the longest pieces of
what was read so far are popped) and the number of pieces popped on the way, both computed once
for the vocabulary. A word is then counted in one pass over its symbols: follow the trie, and
where it ends, add the popped count and go on from the failure state. No piece is ever built.
Distinct words of a batch run through the automaton side by side in numpy.

A word is a maximal run of letters, digits or other visible characters after lower-casing; it is
read as its UTF-8 bytes and an end symbol, so pieces that only close a word stand apart.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of, worker_cache

END, SYMBOLS, END_MARK = 256, 257, "</w>"
#: Letters; single digits; runs of anything else that is not white space.
WORDS = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Distinct words a worker keeps the count of.
CACHE_WORDS = 400_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves,
    the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file, as symbols."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special, symbol = {t["content"] for t in data["added_tokens"]}, byte_symbols()
    pieces = []
    for piece in data["model"]["vocab"]:
        if piece not in special:
            closed = piece.endswith(END_MARK) and len(piece) > len(END_MARK)
            body = piece[: -len(END_MARK)] if closed else piece
            pieces.append((*(symbol[c] for c in body), *([END] if closed else [])))
    return pieces


class Automaton:
    def __init__(self, pieces: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        accepts = [False]
        for piece in pieces:
            state = 0
            for s in piece:
                if s not in children[state]:
                    children[state][s] = len(children)
                    children.append({})
                    accepts.append(False)
                state = children[state][s]
            accepts[state] = True
        n = len(children)
        fail, pops, order = [-1] * n, [0] * n, [0]
        for state in order:  # by depth: a failure state is always shallower
            for s, child in children[state].items():
                if accepts[child]:
                    fail[child], pops[child] = 0, 1
                else:
                    at, popped = fail[state], pops[state]
                    while at >= 0 and s not in children[at]:
                        popped += pops[at]
                        at = fail[at]
                    fail[child], pops[child] = (children[at][s], popped) if at >= 0 else (-1, 0)
                order.append(child)
        self.fail, self.pops = np.array(fail), np.array(pops)
        keys = np.array([state * SYMBOLS + s for state in range(n) for s in children[state]], np.int64)
        ends = np.array([c for kids in children for c in kids.values()], np.int64)
        at = np.argsort(keys)
        self.keys, self.next = np.append(keys[at], np.iinfo(np.int64).max), np.append(ends[at], -1)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word (with its end symbol); -1 where the vocabulary has no way on."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        lengths, starts = lengths[order], starts[order]
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k in range(int(lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-lengths, -k, "right"))  # words with k symbols or more
            symbol = np.full(live, END, np.int64)
            inside = int(np.searchsorted(-lengths, -k, "left"))
            symbol[:inside] = data[starts[:inside] + k]
            todo = np.flatnonzero(state[:live] >= 0)
            while len(todo):
                key = state[todo] * SYMBOLS + symbol[todo]
                at = np.searchsorted(self.keys, key)
                hit = self.keys[at] == key
                state[todo[hit]] = self.next[at[hit]]
                todo = todo[~hit]
                total[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
                todo = todo[state[todo] >= 0]
        # After the end symbol the rest is popped back to the root.
        while len(todo := np.flatnonzero(state > 0)):
            total[todo] += self.pops[state[todo]]
            state[todo] = self.fail[state[todo]]
        total[state < 0] = -1
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


def count_texts(path: str, texts: list[str]) -> tuple[list[int], list[int]]:
    """(words, pieces) of each text; a word the vocabulary cannot spell is one piece."""
    held = worker_cache("pieces")
    if path not in held:
        held[path] = Automaton(vocabulary(path)), {}
    automaton, known = held[path]
    if len(known) > CACHE_WORDS:
        known.clear()
    found = [WORDS.findall(t.lower()) for t in texts]
    fresh = [w for w in Counter(chain.from_iterable(found)) if w not in known]
    pieces = automaton.counts([w.encode("utf-8", "surrogatepass") for w in fresh])
    known.update(zip(fresh, np.where(pieces < 0, 1, pieces).tolist(), strict=True))
    return [len(f) for f in found], [sum(map(known.__getitem__, f)) for f in found]


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_pieces of every whole text.

    Null and empty texts have 0 of both; repeated rows are counted alike; an empty table gives no
    rows; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, pieces = count_texts(path, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], ["doc_id", "n_words", "n_pieces"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_words long, n_pieces long")
