import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import language, media, mixing, piece_counts, quality, sharding, webp
from tracewell.llm.common import hadoop_path, shared_dir
from tracewell.llm.tokens import file_path

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


# -- quality

def test_quality_on_held_out_documents(docs, labels):
    got = quality.quality_report(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_of_odd_rows(spark, odd, none, docs, labels):
    model = quality.train(docs, labels)
    rows = quality.with_score(odd.select("doc_id", "text"), model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(odd, labels).columns == odd.columns
    few = spark.createDataFrame([(1, None, 1), (None, 1, 0), (99, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_report(odd, few).count() == odd.count()
    assert quality.quality_report(none, labels).count() == 0


def test_trees_traverse_as_grown():
    rng = np.random.default_rng(0)
    x = rng.random((500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = quality.grow(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    one = 1 / (1 + np.exp(-_walk(trees, x[0])))
    assert trees.score(x[:1])[0] == pytest.approx(one)


def _walk(t, x):
    total = t.base
    for f, c, v in zip(t.feature, t.cut, t.value, strict=True):
        k = 0
        for _ in range(quality.LEAVES_DEPTH):
            k = 2 * k + 1 + int(x[f[k]] > c[k])
        total += v[k - len(f)]
    return total


# -- language

def test_language_on_held_out_documents(docs):
    got = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95


def test_language_of_odd_rows(odd, none, docs):
    model = language.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[9][0] in model.names
    assert {r.lang_pred for r in language.language_report(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.language_report(none).count() == 0


def test_filter_returns_all_languages_of_a_gram():
    sets = {f"l{k:03d}": np.arange(k, k + 50) for k in range(70)}  # more languages than one word holds
    model = language.build(sets)
    for name, members in sets.items():
        hits = model.hits(members.astype(np.uint32))
        assert hits[model.names.index(name)] == pytest.approx(50)
    assert (model.false_rate < 0.01).all()


# -- piece counts

def test_automaton_counts_greedy_pieces():
    pieces = [(1,), (2,), (3,), (1, 2), (1, 2, 3), (2, 3, 3, 1), (3, 256), (256,), (3, 3)]
    automaton = piece_counts.Automaton(pieces)
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(1, 5, int(rng.integers(0, 12))).tolist()) for _ in range(400)]

    def greedy(word):
        s, at, n = (*word, 256), 0, 0
        while at < len(s):
            fit = max((len(p) for p in pieces if s[at : at + len(p)] == p), default=0)
            if not fit:
                return -1
            at, n = at + fit, n + 1
        return n

    assert automaton.counts(words).tolist() == [greedy(w) for w in words]
    assert automaton.counts([]).tolist() == []


def test_piece_counts_of_odd_rows(odd, none):
    path = file_path("word_bpe_49k.json")
    pieces = set(piece_counts.vocabulary(path))

    def count(text):
        found = piece_counts.WORDS.findall((text or "").lower())
        total = 0
        for w in found:
            s, at = (*w.encode(), 256), 0
            while at < len(s):
                at += next(k for k in range(min(len(s) - at, 40), 0, -1) if s[at : at + k] in pieces)
                total += 1
        return len(found), total

    short = odd.where("doc_id not in (6, 7) or doc_id is null")
    want = Counter((r.doc_id, *count(r.text)) for r in short.collect())
    assert Counter(map(tuple, piece_counts.piece_counts(short, path).collect())) == want
    assert piece_counts.piece_counts(none, path).count() == 0


# -- mixing

def test_targets_fill_up_to_the_cap():
    got = mixing.source_targets({"a": 100, "b": 10, None: 890})
    assert got == {"a": pytest.approx(242.5), "b": pytest.approx(30), None: pytest.approx(727.5)}  # weights 1, 2, 3; b is full
    assert mixing.source_targets({"a": 0, "b": 0}) == {"a": 0, "b": 0}


def test_flow_serves_overlapping_sources():
    supply = {("a",): 10, ("a", "b"): 10, ("b",): 2}
    flow = mixing.min_cost_flow(supply, {p: p for p in supply}, {"a": 12, "b": 10}, 3)
    served, passes = Counter(), Counter()
    for (p, k, s), words in flow.items():
        assert s in p
        served[s] += words
        passes[p, k] += words
    assert served == {"a": 12, "b": 10}
    assert sum(w for (_, k), w in passes.items() if k > 1) == 0 and all(w <= supply[p] for (p, _), w in passes.items())


def test_mix_report(docs, odd, none):
    for table in (docs, odd):
        rows = table.select("doc_id", "text", "source").collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        got = mixing.mix_report(table).collect()
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, size(r.text)) for r in rows)
        assert all(r.taken <= 3 * r["size"] for r in got)
        totals = defaultdict(int)
        for r in rows:
            totals[r.source] += size(r.text)
        want = mixing.source_targets(dict(totals))
        assert {(r.source_size, r.target) for r in got} == {(totals[s], want[s]) for s in want}
        assert got and sorted(map(str, got)) == sorted(map(str, mixing.mix_report(table).collect()))
    taken = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r.k - r.t) <= 0.005 * r.t for r in taken)
    assert mixing.mix_report(none).count() == 0


def test_mixed_documents_repeat(docs, odd, none):
    copies = {r.doc_id: r.taken // r["size"] for r in mixing.mix_report(docs).where("size > 0").collect()}
    out = mixing.mix_documents(docs)
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert out.columns == docs.columns and got == {i: n for i, n in copies.items() if n}
    assert mixing.mix_documents(odd).columns == odd.columns and mixing.mix_documents(none).count() == 0


# -- media

def test_media_round_trip(odd, none):
    stored = media.store(odd).collect()
    payloads = Counter(media.payload_of((r.text or "").encode()) for r in odd.collect())
    assert Counter(media.read_pixels(r.media).tobytes()[: r.payload_bytes] for r in stored) == payloads
    got = media.media_report(odd).collect()
    assert all(r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes) for r in got)
    assert Counter((r.payload_sha256, r.tail_crc32) for r in got) == Counter((__import__("hashlib").sha256(p).hexdigest(), zlib.crc32(p[-16:])) for p in payloads.elements())
    assert media.media_report(none).count() == 0


def pictures():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:70, :90]
    smooth = np.stack([x + 2 * y, x + 2 * y + rng.integers(0, 3, x.shape), 255 - x], 2).astype(np.uint8)
    grey = rng.integers(0, 256, (40, 33, 1)) + rng.integers(0, 4, (40, 33, 3))
    slope = rng.integers(0, 30, (50, 60, 1)) * np.array([3, 4, 1]) + rng.integers(0, 3, (50, 60, 3))
    few = rng.integers(0, 2, (9, 31, 1)) * np.array([200, 10, 3])
    return [smooth, grey.astype(np.uint8), slope.astype(np.uint8), few.astype(np.uint8), rng.integers(0, 256, (1, 1, 3)).astype(np.uint8), np.zeros((3, 1, 3), np.uint8), rng.integers(0, 256, (40, 64, 3)).astype(np.uint8), np.tile(rng.integers(0, 256, (1, 21, 3)), (30, 4, 1)).astype(np.uint8)]


PAYLOADS = [b"a" * 192, b" " * 192, bytes(range(256)) * 3, b"ab" * 96, np.random.default_rng(0).bytes(3 * 64 * 500), media.payload_of(b"so it goes on and on, and so on; " * 600), media.payload_of(b"".join(b"%d: line %d\n" % (k, k % 7) for k in range(3000)))]


@pytest.mark.parametrize("k", range(len(PAYLOADS) + len(pictures())))
def test_encoder_and_both_decoders_agree(monkeypatch, k):
    if k < len(PAYLOADS):
        data, want = media.store_payload(PAYLOADS[k]), np.frombuffer(PAYLOADS[k], np.uint8)
    else:
        want = pictures()[k - len(PAYLOADS)]
        data = webp.encode(want)
    fast = webp.decode(data)
    assert fast[:, :, 1:].tobytes() == want.tobytes() and (fast[:, :, 0] == 255).all()
    monkeypatch.setattr(webp, "BLOCK_BITS", 400)
    assert np.array_equal(fast, webp.decode(data))
    monkeypatch.setattr(webp, "GROUPS_AT_ONCE", 0)
    assert np.array_equal(fast, webp.decode(data))


def used(monkeypatch, encode):
    """What of the format the media that encode() gives use, by the decoder's own reading."""
    found = Counter()

    def spy(name, tell):
        real = getattr(webp, name)

        def told(*a):
            tell(*a)
            return real(*a)

        monkeypatch.setattr(webp, name, told)

    spy("_undo_predictor", lambda *a: found.update(predictor=1))
    spy("_undo_cross", lambda *a: found.update(cross=1))
    spy("_undo_palette", lambda *a: found.update(palette=1))
    spy("_one_group", lambda b, codes, w, n, cache: found.update(cache=cache > 0, back_references=bool(((codes[0].used >= 256) & (codes[0].used < 280)).any())))
    for data in encode():
        webp.decode(data)
    monkeypatch.undo()
    return {k for k, v in found.items() if v}


def test_stored_media_use_the_format(monkeypatch, docs):
    texts = [r.text for r in docs.select("text").collect()]
    assert used(monkeypatch, lambda: [media.store_payload(media.payload_of((t or "").encode())) for t in texts]) >= {"palette", "cache", "back_references"}
    assert used(monkeypatch, lambda: map(webp.encode, pictures())) == {"predictor", "cross", "palette", "cache", "back_references"}


class Stream(webp.Writer):
    """Writes streams with flat eight-bit codes, one symbol a code where `only` is given."""

    def code(self, alphabet, used=None, only=None):
        if only is not None:
            self.put(0b101 | only << 3, 11)
            return
        lengths = np.zeros(alphabet, np.uint8)
        lengths[used] = int(np.log2(len(used)))
        self.put(*webp._code_bits(lengths, alphabet))
        self.codes = webp.canonical(lengths), lengths

    def flat(self, pixels):
        """An entropy-coded image (argb rows of pixels) of literals, without a cache."""
        self.put(0, 1)
        self.body(pixels)

    def body(self, pixels):
        held = []
        for alphabet in (280, 256, 256, 256):
            self.code(alphabet, np.arange(256))
            held.append(self.codes)
        self.put(0b0001, 4)
        for a, r, g, b in np.asarray(pixels, np.uint8).reshape(-1, 4).tolist():
            for v, (codes, lengths) in zip((g, r, b, a), held, strict=True):
                self.put(int(codes[v]), int(lengths[v]))

    def file(self):
        body = bytes([webp.SIGNATURE]) + self.value.to_bytes((self.at + 7) // 8, "little")
        body_padded = body + b"\0" * (len(body) & 1)
        return b"RIFF" + (12 + len(body_padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body_padded


def start(w, h):
    s = Stream()
    s.put(w - 1, 14)
    s.put(h - 1, 14)
    s.put(0, 4)
    return s


def picture(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(np.uint8)


def test_subtract_green():
    p = picture(5, 6)
    sent = p.copy()
    sent[:, :, 1] -= p[:, :, 2]
    sent[:, :, 3] -= p[:, :, 2]
    s = start(6, 5)
    s.put(0b101, 3)  # transform, kind 2
    s.put(0, 1)
    s.put(0, 2)  # no cache, no meta codes
    s.body(sent)
    assert np.array_equal(webp.decode(s.file()), p)


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    """Forward prediction written out a pixel at a time, with plain integers."""
    h, w = 6, 7
    p = picture(h, w, mode).astype(int)
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    sent = np.zeros_like(p)
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = [255, 0, 0, 0] if x == 0 else p[0, x - 1]
            elif x == 0:
                guess = p[y - 1, 0]
            else:
                L, T, TL, TR = (list(map(int, v)) for v in (p[y, x - 1], p[y - 1, x], p[y - 1, x - 1], p[y - 1, x + 1] if x + 1 < w else p[y, 0]))
                if mode == 11:
                    e = [a + b - c for a, b, c in zip(L, T, TL, strict=True)]
                    guess = L if sum(abs(a - b) for a, b in zip(e, L, strict=True)) < sum(abs(a - b) for a, b in zip(e, T, strict=True)) else T
                else:
                    guess = {
                        0: [255, 0, 0, 0], 1: L, 2: T, 3: TR, 4: TL, 5: half(half(L, TR), T), 6: half(L, TL), 7: half(L, T), 8: half(TL, T), 9: half(T, TR),
                        10: half(half(L, TL), half(T, TR)), 12: [min(255, max(0, a + b - c)) for a, b, c in zip(L, T, TL, strict=True)],
                        13: [min(255, max(0, a + int((a - b) / 2))) for a, b in zip(half(L, T), TL, strict=True)],
                    }[mode]
            sent[y, x] = (p[y, x] - np.array(guess)) & 255
    s = start(w, h)
    s.put(0b001, 3)
    s.put(0, 3)  # blocks of 4
    s.flat([[255, 0, mode, 0]] * 4)
    s.put(0, 1)
    s.put(0, 2)
    s.body(sent)
    assert np.array_equal(webp.decode(s.file()), p.astype(np.uint8))


def test_cross_colour():
    p, factors = picture(4, 4, 3), (100, 200, 30)  # red to blue, green to blue, green to red
    signed = lambda v: v - 256 if v > 127 else v
    sent = p.astype(int)
    for y in range(4):
        for x in range(4):
            _, r, g, b = map(int, p[y, x])
            rb, gb, gr = map(signed, factors)
            sent[y, x, 1] = (r - (gr * signed(g) >> 5)) & 255
            sent[y, x, 3] = (b - (gb * signed(g) >> 5) - (rb * signed(r) >> 5)) & 255
    s = start(4, 4)
    s.put(0b011, 3)
    s.put(0, 3)
    s.flat([[255, *factors]])
    s.put(0, 1)
    s.put(0, 2)
    s.body(sent)
    assert np.array_equal(webp.decode(s.file()), p)


@pytest.mark.parametrize("colours", [2, 3, 16, 40])
def test_palette(colours):
    table = picture(1, colours, colours)[0]
    index = np.random.default_rng(1).integers(0, colours, (3, 11))
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each, per = 8 >> pack, 1 << pack
    width = -(-11 // per)
    packed = np.zeros((3, width, 4), np.uint8)
    packed[:, :, 0] = 255
    for x in range(11):
        packed[:, x // per, 2] |= (index[:, x] << each * (x % per)).astype(np.uint8)
    s = start(11, 3)
    s.put(0b111, 3)
    s.put(colours - 1, 8)
    s.flat(np.diff(table.astype(int), axis=0, prepend=0) & 255)
    s.put(0, 1)
    s.put(0, 2)
    s.body(packed)
    assert np.array_equal(webp.decode(s.file()), table[index])


def test_back_references_and_colour_cache():
    """Two literals, a copy of 6 from distance 2, one from the pixel above, and a cache hit."""
    s = start(4, 3)
    s.put(0, 1)
    s.put(0b1, 1)
    s.put(3, 4)  # cache of 8
    s.put(0, 1)
    pixels = [(255, 10, 20, 30), (255, 40, 50, 60)]
    slot = {p: (webp.CACHE_MULTIPLIER * int.from_bytes(bytes(p), "big") & 0xFFFFFFFF) >> 29 for p in pixels}
    assert slot[pixels[0]] != slot[pixels[1]]
    # lengths: 6 is prefix 4 with one extra bit (1), 3 is prefix 2
    used = [20, 50, 256 + 4, 256 + 2, 280 + slot[pixels[0]], 280 + slot[pixels[1]], 0, 1]
    s.code(288, np.array(sorted(used)))
    green = s.codes
    s.code(256, np.array([10, 40]))
    red = s.codes
    s.code(256, np.array([30, 60]))
    blue = s.codes
    s.code(256, only=255)
    near = {d: k for k, (x, y) in enumerate(webp.NEAR) if (d := x + 4 * y) in (2, 4) and k < 6}
    # distance codes: 4 above is code 1 (prefix 0); 2 to the left is code 6 (prefix 4, extra 1)
    assert webp.NEAR[0] == (0, 1) and webp.NEAR[5] == (2, 0) and near
    s.code(40, np.array([0, 4]))
    dist = s.codes

    def put(codes, v):
        s.put(int(codes[0][v]), int(codes[1][v]))

    for _, r, g, b in pixels:
        put(green, g)
        put(red, r)
        put(blue, b)
    put(green, 260)
    s.put(1, 1)
    put(dist, 4)
    s.put(1, 1)
    put(green, 258)
    put(dist, 0)
    put(green, 280 + slot[pixels[1]])
    a, b = pixels
    assert webp.decode(s.file()).reshape(12, 4).tolist() == [list(v) for v in (a, b, a, b, a, b, a, b, a, b, a, b)]


def test_damaged_media_raise():
    data = media.store_payload(b"some text".ljust(192))
    for bad in (b"", data[:30], b"RIFX" + data[4:], data[:20] + b"\0" + data[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
    assert len(webp.NEAR) == 120 and webp.NEAR[-1] == (8, 7)


# -- sharding

def test_compaction_keeps_rows_and_old_versions(spark, docs):
    store = sharding.ShardStore(spark, shared_dir(spark, "t"), target=1 << 20, fanout=3)
    seen = []
    for k in range(9):
        seen.append(store.append(docs.where(f"doc_id % 9 = {k}").coalesce(1)))
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, store.read().collect())) == want
    before, old = len(store.manifest()[1]), seen[-1]
    assert store.compact() > 0 and len(store.manifest()[1]) < before
    assert all(len(r) < 3 for r in store.runs(store.manifest()[1])) or not store.runs(store.manifest()[1])
    assert sorted(map(str, store.read().collect())) == want == sorted(map(str, store.read(old).collect()))
    assert store.vacuum() == 0 and store.vacuum(versions=100, spared=0) == 0
    assert store.vacuum(spared=0) > 0 and store.vacuum(spared=0) == 0
    assert sorted(map(str, store.read().collect())) == want


def test_manifests_are_changes_and_now_and_then_whole(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "CHECKPOINT", 3)
    store = sharding.ShardStore(spark, shared_dir(spark, "t"), fanout=3)
    for k in range(7):
        store.append(docs.where(f"doc_id % 7 = {k}").coalesce(1))
    assert [("shards" in store._load(v)) for v in range(1, 8)] == [False, False, True, False, False, True, False]
    assert all(store.read(v).count() == docs.where(f"doc_id % 7 < {v}").count() for v in (1, 3, 5, 7))
    store.compact()
    assert len(store.manifest()[1]) < 7 and store.read().count() == docs.count()


def test_commits_conflict_and_schemas_hold(spark, odd, none):
    store = sharding.ShardStore(spark, shared_dir(spark, "t"))
    with pytest.raises(ValueError):
        store.read()
    base = store.append(odd)
    schema, live = store.manifest(base)
    content = {"schema": schema.jsonValue(), "add": [], "remove": []}
    assert store._take(base + 1, content) and not store._take(base + 1, content)
    store._commit(schema, [], live)
    with pytest.raises(sharding.Conflict):  # merged by another writer in the meantime
        store._commit(schema, [], live)
    with pytest.raises(ValueError):
        store.append(odd.select("doc_id"))
    store.append(odd)
    store.append(none)
    assert store.read().count() == odd.count()


def test_dead_writers_block_nobody_and_files_in_flight_stay(spark, docs):
    store = sharding.ShardStore(spark, shared_dir(spark, "t"))
    store.append(docs)
    fs, draft = hadoop_path(spark, f"{store.root}/manifests/draft-of-a-dead-writer")
    fs.create(draft).close()
    in_flight = store._write(docs)  # written, not yet committed
    assert store.append(docs) == 2 and store.vacuum() == 0
    assert store._commit(docs.schema, in_flight) == 3
    assert store.read().count() == 3 * docs.count()


def test_shard_report(spark, docs, odd, none):
    assert sharding.shard_report(docs).count() == docs.count()
    some = docs.where("doc_id < 100").withColumn("text", F.upper("text"))  # a plan, not just files
    got = sharding.shard_report(some).collect()
    assert {r.doc_id: r.text_sha256 for r in got} == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in some.collect()}
    assert sharding.shard_report(odd, odd).count() == 2 * odd.count() and sharding.shard_report(none).count() == 0
    assert sharding.shard_report(odd.select("doc_id", "text")).where("lang is not null").isEmpty()
    assert sum(w.count() for w in sharding.file_waves(spark, f"{DATA}/documents.parquet")) == docs.count()
