"""Exact tokenizer ids with a bounded piece cache.

Pre-tokens repeat far more often than documents do, so each distinct one is encoded by the
tokenizers library's BPE model and then looked up. Texts whose characters all lie in PLAIN
(where this module's patterns split exactly as the tokenizer files' do) take that way; every
other text, and every text that holds one of the file's special strings, goes to the library
whole, so all ids are those of `Tokenizer.encode(text, add_special_tokens=False)`. A test
compares both ways.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from .common import worker_cache

#: Letters among the plain characters, and all plain characters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ–—‘’“”…]*")
#: Pre-token patterns of the two tokenizer files, over plain characters.
PIECES = {
    "byte_bpe_50k.json": re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"),
    "word_bpe_49k.json": re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+"),
}
FOLDED = {"word_bpe_49k.json"}
#: Bytes that a worker's cache may take, counted as PIECE_BYTES for each piece (two objects and a
#: dictionary slot) and its characters and ids. Pieces met first are the frequent ones; once the
#: cache is full, others are encoded where they occur, and when these become many it starts anew.
CACHE_BYTES, PIECE_BYTES, STALE = 56 << 20, 180, 4_000_000
#: Texts that the library encodes at once; its results take some 100 bytes a token.
LIBRARY_TEXTS = 16
#: Longer texts are cut before a single space and a letter, where every pattern above splits.
RUN = 1 << 20
CUT = re.compile(rf"(?<=\S)(?= [{LETTERS}])")


def shown_bytes() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves,
    the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


SHOWN = shown_bytes()


class Pieces(dict):
    """Piece -> its ids as little-endian u32 bytes; absent pieces are encoded by the model."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.tokenize, self.limit, self.size, self.missed = model.tokenize, limit, 0, 0

    def __missing__(self, piece: str) -> bytes:
        found = self.tokenize(piece if piece.isascii() and piece[0] != " " and piece.isalnum() else piece.encode().decode("latin-1").translate(SHOWN))
        ids = array("I", [t.id for t in found]).tobytes()
        if self.size < self.limit:
            self[piece] = ids
            self.size += PIECE_BYTES + len(piece) + len(ids)
            return ids
        self.missed += 1
        if self.missed > STALE:
            self.clear()
            self.size = self.missed = 0
        return ids


def runs(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > RUN and (found := CUT.search(text, at + RUN)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Encoder:
    """Ids of whole texts without added special tokens, as the library gives them."""

    def __init__(self, path: str, file: str, cache: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.pieces, self.fold = PIECES[file].findall, file in FOLDED
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.known = Pieces(self.tokenizer.model, cache)

    def library(self, texts: list[str]) -> list[list[int]]:
        out = []
        for k in range(0, len(texts), LIBRARY_TEXTS):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(texts[k : k + LIBRARY_TEXTS], add_special_tokens=False)]
        return out

    def encode_one(self, text: str) -> bytes:
        """The text's ids as little-endian u32."""
        if PLAIN.fullmatch(text) is None or self.special.search(text):
            return np.array(self.library([text])[0], "<u4").tobytes()
        find, known = self.pieces, self.known.__getitem__
        return b"".join([b"".join(map(known, find(r.lower() if self.fold else r))) for r in runs(text)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """An array of uint32 ids for each text."""
        return [np.frombuffer(self.encode_one(t), "<u4") for t in texts]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; the next operator's cache replaces it."""
    held = worker_cache("tokens")
    if path not in held:
        held[path] = Encoder(path, path.rsplit("/", 1)[-1])
    return held[path]


def file_path(file: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(file)
