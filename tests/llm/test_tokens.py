import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from deploom.llm import bpe_fst, packing, pfor
from deploom.llm.tokens import library_encoder


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def noise(n, seed=2, alphabet="abc é\n  \tde1 2　ü.,!'s<|>"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_encoding_is_the_library_s(name):
    tok, mine = library(name), library_encoder(P.path(name))
    for t in noise(1500) + ["<|endoftext|>", "Aİ ΣΣ é x́"]:
        assert np.frombuffer(mine(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_segments_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for high in (1, 300, 60000, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            ids[:: 17] = high - 1 if n else 0
            payload = pfor.encode_segment([5], [n], ids)
            assert (pfor.decode_blocks(payload) == ids).all()
            if n > 256:
                assert (pfor.decode_blocks(payload, 1, 2) == ids[128:256]).all()
    with pytest.raises(ValueError):
        pfor.read_index(b"nonsense")


def test_token_file(spark, docs, unique, none):
    tok = library("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in pfor.token_file(spark, unique, P.path("byte_bpe_50k.json")).collect()}
    at = 0
    for r in sorted(unique.select("doc_id", "text").collect(), key=lambda r: r["doc_id"]):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        o = got[r["doc_id"]]
        assert (o["start"], o["n_tokens"], o["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    rows = pfor.token_file(spark, docs, P.path("byte_bpe_50k.json")).collect()
    assert len(rows) == docs.count() and len({r["start"] for r in rows}) == len(rows)
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert pfor.token_file(spark, none, P.path("byte_bpe_50k.json")).count() == 0


def test_ids_at_the_ends_of_their_range(spark):
    rows = [(-(1 << 63), "low"), (None, "none"), ((1 << 63) - 1, "high"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in pfor.token_file(spark, docs, P.path("byte_bpe_50k.json")).orderBy("start").collect()]
    assert got == [None, None, -(1 << 63), (1 << 63) - 1]


def ranks():
    import tiktoken

    table = bpe_fst.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def test_transducer(monkeypatch):
    own, mine = ranks(), bpe_fst.RankTokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rnd = random.Random(3)
    pieces = [bytes(rnd.choice(b"etaoinshrdlu") for _ in range(rnd.randint(1, 30))) for _ in range(800)]
    for limit in (60_000, 50):  # with room for every state, and emptied again and again
        monkeypatch.setattr(bpe_fst, "STATE_LIMIT", limit)
        monkeypatch.setattr(bpe_fst, "PAIR_LIMIT", 10 * limit)
        mine.fst.reset()
        for p in pieces:
            assert mine.fst.encode(p) == own._encode_single_piece(p)
            assert len(mine.fst.states) <= limit + 2
    for t in noise(1000):
        ids = mine.encode(t)
        assert ids.tolist() == own.encode_ordinary(t) and "".join(mine.decode(ids)) == t


def test_every_character_is_of_tiktoken_s_kind():
    """Letters and numbers are those of tiktoken's tables, whatever the regex module knows: each code point before and behind letters."""
    own, mine = ranks(), bpe_fst.RankTokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    newer = bpe_fst.newer_characters()
    assert all(mine.encode(c + "'s a" + c + "1 " + c + c).tolist() == own.encode_ordinary(c + "'s a" + c + "1 " + c + c) for c in newer)
    points = [*range(0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x33500, 11), *range(0xE0000, 0xE0200)]
    for k in range(0, len(points), 50):
        text = " ".join(f"{chr(c)}'s a{chr(c)} 1{chr(c)}" for c in points[k : k + 50])
        assert mine.encode(text).tolist() == own.encode_ordinary(text), hex(points[k])


def test_utf8_machine():
    data = "aé€\U0001f600b".encode() + b"\xff\xe2\x82" + "z".encode()
    for cut in range(1, 5):
        m = bpe_fst.Utf8Machine()
        out = "".join(m.feed(data[k : k + cut]) for k in range(0, len(data), cut)) + m.feed(b"", last=True)
        assert out == data.decode("utf-8", "replace")


def test_round_trip(docs, none):
    own = ranks()
    got = bpe_fst.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        t = r["text"] or ""
        ids = own.encode_ordinary(t)
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got.collect())) == want
    assert bpe_fst.round_trip(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_best_fit():
    rng = random.Random(1)
    for bins in (4, 64):
        fit, used = packing.BestFit(100, bins), collections.defaultdict(int)
        for _ in range(3000):
            n = rng.randint(1, 100)
            number, offset = fit.add(n)
            assert offset == used[number]
            used[number] += n
            assert used[number] <= 100 and fit.open <= bins
    with pytest.raises(ValueError):
        fit.add(101)


def test_second_round_packs_what_stays_open(spark, monkeypatch):
    """Pieces of sequences open at the end of a packer are packed again: close to the least number, whatever the cut."""
    rnd = random.Random(4)
    lengths = [rnd.randint(1, 2048) for _ in range(6000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    for held in (200_000, 1500):
        monkeypatch.setattr(packing, "TASK_PIECES", held)
        rows = packing.pack_pieces(pieces).collect()
        assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            ends = [0, *(o + n for o, n in sorted(b))]
            assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 2048
        # first-fit decreasing over all pieces at once
        free = []
        for n in sorted(lengths, reverse=True):
            at = next((k for k, f in enumerate(free) if f >= n), None)
            if at is None:
                free.append(2048 - n)
            else:
                free[at] -= n
        assert len(bins) <= 1.05 * len(free)


def test_packing(docs, none):
    tok = library("word_bpe_49k.json")
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json")).collect()
    pieces = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[r["doc_id"], k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])] += 1
    assert pieces == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == 0
