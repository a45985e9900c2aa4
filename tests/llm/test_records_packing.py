import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewell.llm import packing, records, tokens
from tracewell.llm.common import shared_dir
from tracewell.llm.tokens import PIECES, Encoder, encoder, file_path

TEXTS = ["", " ", "\n\n", "it's 'quoted' don't I'LL we've", "x" * 3000, "<|endoftext|> hi", "a <|startoftext|>b", "ça “va” — 12345  \t x", "日本語 text ١٢٣", "İstanbul ǅ ﬁ", "a\x1cb\x85c\xa0d", "naïve é  \n ok", "A  b\n\n\nc "]


def plain_library(file, texts):
    lib = Tokenizer.from_file(file_path(file))
    return [lib.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("file", sorted(PIECES))
def test_cached_ids_equal_the_library(file, monkeypatch):
    monkeypatch.setattr(tokens, "STALE", 5)
    small = Encoder(file_path(file), file, cache=600)  # full after some pieces, and anew all the time
    want = plain_library(file, TEXTS)
    for _ in range(3):
        for e in (encoder(file_path(file)), small):
            assert [list(i) for i in e.encode(TEXTS)] == want
    assert len(small.known) < 6


@pytest.mark.parametrize("file", sorted(PIECES))
def test_long_texts_are_cut_where_pieces_part(file, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 7)
    texts = [f"{a}{b}{a}" for a in TEXTS for b in ("  two spaces, one 12 34 don't stop\n x ", "ab cd  ef - gh 'll i")]
    assert [list(i) for i in encoder(file_path(file)).encode(texts)] == plain_library(file, texts)


def expected(docs, file):
    """(id, ids with the end id) in ascending order of id."""
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, np.array([*x, 2], "<u4")) for (i, _), x in zip(rows, plain_library(file, [t for _, t in rows]), strict=True)]


def test_records_round_trip(spark, odd):
    folder = shared_dir(spark, "t")
    manifest = records.write_records(odd, folder, file_path("word_bpe_49k.json"), 2)
    got = sorted(map(tuple, records.read_records(spark, folder).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert [r[0] for r in got] == [i for i, _ in expected(odd, "word_bpe_49k.json")]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in expected(odd, "word_bpe_49k.json"))
    file = manifest.orderBy("shard").first()
    whole = list(records.scan(folder, file.file))
    order = np.arange(file.n_records)[::-1]
    assert [(a, b.tolist()) for a, b in records.scan(folder, file.file, order)] == [(a, b.tolist()) for a, b in whole[::-1]]


def test_damage_is_found():
    data = bytearray(records.frame(7, np.arange(5), False) + records.frame(None, np.array([70_000]), True))
    doc, ids, at = records.unframe(memoryview(data), 0)
    assert (doc, ids.tolist()) == (7, list(range(5)))
    assert records.unframe(memoryview(data), at)[:2][1].tolist() == [70_000]
    for k in (0, 9, 20):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            records.unframe(memoryview(bad), 0)


def test_empty_tables(spark, none):
    folder = shared_dir(spark, "t")
    records.write_records(none, folder, file_path("word_bpe_49k.json"), 2)
    assert records.read_records(spark, folder).count() == 0
    assert packing.pack(none, file_path("byte_bpe_50k.json"), 2).count() == 0


def test_packing_is_gapless_and_whole(odd):
    got = packing.pack(odd, file_path("byte_bpe_50k.json"), 2, capacity=64).toPandas()
    want = Counter()
    for doc_id, ids in expected(odd, "byte_bpe_50k.json"):
        start, stop, piece = 0, (len(ids) - 1) % 64 + 1, 0
        while start < len(ids):
            want[doc_id if doc_id is not None else -1, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start, stop, piece = stop, stop + 64, piece + 1
    seen = got.assign(doc_id=got.doc_id.fillna(-1).astype(int))
    assert Counter(map(tuple, seen[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 64


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_and_comes_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1024, rng.lognormal(5.5 + seed / 3, 1.0, 20_000).astype(int) + 1)
    histogram = Counter(lengths.tolist())
    planned = packing.plan(histogram, 1024)
    held = Counter()
    for filling, times in planned:
        assert sum(n * c for n, c in filling) <= 1024
        for n, c in filling:
            held[n] += c * times
    assert held == histogram
    assert sum(t for _, t in planned) <= 1.01 * -(-lengths.sum() // 1024) + 1


def test_plan_of_few_and_equal_pieces():
    assert sum(t for _, t in packing.plan({600: 5}, 1024)) == 5
    assert sum(t for _, t in packing.plan({512: 10_001}, 1024)) == 5001
    assert packing.plan({1024: 3}, 1024) == [(((1024, 1),), 3)]
    assert packing.plan({}, 1024) == []


@pytest.fixture(scope="module")
def histogram(spark):
    """Piece lengths of all documents of the larger table."""
    counts, enc = Counter(), encoder(file_path("byte_bpe_50k.json"))
    for (text,) in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").toLocalIterator():
        n = len(enc.encode_one(text or "")) // 4 + 1
        first = (n - 1) % 1024 + 1
        counts[first] += 1
        counts[1024] += (n - first) // 1024
    return counts


@pytest.mark.parametrize(("times", "share"), [(1, 0.8), (10, 0.85), (100, 0.85)])
def test_program_places_most_pieces_and_beats_best_fit(histogram, times, share):
    counts = {n: c * times for n, c in histogram.items()}
    short = {n: c for n, c in counts.items() if n < 1024}
    placed, left = packing.planned(counts, 1024)
    assert sum(left.values()) <= (1 - share) * sum(short.values())
    sequences = sum(t for _, t in placed) + sum(t for _, t in packing.best_fit(left, 1024))
    alone = sum(t for _, t in packing.best_fit(short, 1024)) + counts[1024]
    bound = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert bound <= sequences <= alone and sequences <= 1.0001 * bound + 1


def test_program_with_room_in_every_filling():
    placed, left = packing.planned({400: 1000, 500: 1000}, 1024)
    assert sum(left.values()) <= 400
    assert sum(t for _, t in packing.plan({400: 1000, 500: 1000}, 1024)) == 1000
