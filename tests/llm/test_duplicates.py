import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from deploom.llm import bwt, simhash
from deploom.llm.components import components


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    u = Union(range(500))
    for a, b in edges:
        u.join(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    import xxhash

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, unique, none):
    rows = unique.select("doc_id", "text").collect()
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    u = Union(prints)
    for a in prints:
        for b in prints:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                u.join(a, b)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(unique).collect()}
    assert {i: (r["fp"] % 2**64, r["component_id"]) for i, r in got.items()} == {i: (p, u.find(i)) for i, p in prints.items()}
    assert simhash.near_duplicates(docs).count() == docs.count()
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted({u.find(i) for i in prints})
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0


def test_links_lose_nothing(spark, monkeypatch):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base[:30]:
        for _ in range(12):
            x = b
            for _ in range(rnd.randint(0, 6)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    monkeypatch.setattr(simhash, "TILE", 8)  # hot buckets are cut into tiles
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    u, v = Union(prints), Union(prints)
    for r in simhash.links(df).collect():
        assert bin((r["a"] ^ r["b"]) % 2**64).count("1") <= 64
        u.join(r["a"] % 2**64, r["b"] % 2**64)
    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 4:
                v.join(a, b)
    assert {p: u.find(p) for p in prints} == {p: v.find(p) for p in prints}


def test_block_plans_keep_every_pair():
    rnd = random.Random(1)
    for n in (10, 10**6, 10**9, 10**12):
        masks = simhash.block_plan(n)
        for _ in range(200):
            x = 0
            for _ in range(4):
                x |= 1 << rnd.randrange(64)
            assert any(m & x == 0 for m in masks)


def repeats(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by definition; rows in order."""
    seen, out = set(), []
    for i, text in rows:
        t = (text or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            w = t[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(t))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_passages(spark, docs, unique, none):
    rows = sorted(unique.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    got = sorted(map(tuple, bwt.digest(unique).collect()))
    assert got == repeats([(r["doc_id"], r["text"]) for r in rows]) and sum(r[2] for r in got) > 5000
    assert bwt.digest(docs).count() == docs.count() and bwt.digest(none).count() == 0
    cleaned = bwt.remove_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert cleaned.where("text is null").count() == docs.where("text is null").count()
    assert bwt.remove_repeats(none).count() == 0
    ends = bwt.digest(spark.createDataFrame([(-(1 << 63), "x"), (None, "y")], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in ends} == {None, -(1 << 63)}


def test_merged_transforms_are_the_transform_of_all():
    """The interleave of several groups against suffixes sorted directly; common prefixes counted byte by byte."""
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (60, 30)).astype(np.uint8)
    rows[20:30] = rows[5]
    rows[30:40, 8:] = rows[7, 8:]
    cuts = [0, 1, 13, 13, 35, 60]
    columns = [bwt.transforms(rows[a:b], np.zeros(b - a, np.int64)) for a, b in zip(cuts, cuts[1:])]
    group = np.searchsorted(cuts[1:], np.arange(60), side="right")
    assert (np.concatenate(columns, axis=1) == bwt.transforms(rows, group)).all()
    seen = 0
    for c, own, symbols, common in bwt.merged(columns):
        suffix = [bytes(r[c:]) for r in rows]
        assert own.tolist() == sorted(range(60), key=lambda i: (suffix[i], i)) and (rows[own, c] == symbols).all()
        for k in range(1, 60):
            a, b = suffix[own[k - 1]], suffix[own[k]]
            assert common[k] == next((n for n in range(len(a)) if a[n] != b[n]), len(a))
        seen += 1
    assert seen == 30


def test_merge_of_shards(monkeypatch):
    """Transforms of several shards against the definition: cold anchors, and hot ones that meet in parts first."""
    rnd = random.Random(2)
    motif = "".join(rnd.choice("ab ") for _ in range(260)).encode()
    texts = [bytes(rnd.choice(b"abc ") for _ in range(rnd.randint(0, 200))) + motif[rnd.randint(0, 90) : rnd.randint(150, 260)] + bytes(rnd.choice(b"abc ") for _ in range(60)) for _ in range(24)]
    for hot in (10**9, 2):
        shards = []
        for k in range(0, 24, 4):
            part = texts[k : k + 4]
            shards.append({"shard": k // 4, "doc_ids": np.arange(k, k + 4, dtype="<i8").tobytes(), "lengths": np.array([len(x) for x in part], "<i8").tobytes(), "data": bwt._zip(b"".join(part))})
        runs = [bwt.Runs(bwt._unzip(s["data"]), np.frombuffer(s["lengths"], "<i8")) for s in shards]
        keys, n = np.unique(np.concatenate([bwt._short(r.key, 3) for r in runs]), return_counts=True)
        covers, sent = {s["shard"]: [] for s in shards}, {}
        for s in shards:
            own = keys >> np.uint64(32)
            s["known"] = [{"bucket": b, "twice": (keys[(n >= 2) & (own == b)]).astype("<u4").tobytes(), "hot": (keys[(n >= hot) & (own == b)]).astype("<u4").tobytes()} for b in range(3)]
            for r in bwt._candidates(s, 3, 2).to_pylist():
                sent.setdefault((r["bucket"], r["part"]), []).append(r)
                if r["covers"]:
                    covers[r["shard"]].append(r["covers"])
        passed = {}

        def merge(rows, pass_on):
            records = [np.frombuffer(bwt._unzip(r["records"]), bwt.RECORD) for r in rows]
            got, windows = bwt.merge_records(records, [np.frombuffer(bwt._unzip(r["columns"]), np.uint8).reshape(-1, len(x)) for r, x in zip(rows, records)], pass_on)
            for shard, blob in got:
                covers[shard].append(blob)
            return windows

        for (_, part), rows in sent.items():
            if windows := merge(rows, part >= 0):
                for r in bwt._sent(bwt._windows(*windows, 3)).to_pylist():
                    passed.setdefault(r["bucket"], []).append(r)
        assert bool(passed) == (hot == 2)
        for rows in passed.values():
            merge(rows, False)
        want = repeats([(i, t.decode()) for i, t in enumerate(texts)])
        for s in shards:
            lengths = np.frombuffer(s["lengths"], "<i8")
            gone, at = bwt._removed(bwt._unzip(s["data"]), lengths, covers[s["shard"]]), 0
            for i, size in zip(np.frombuffer(s["doc_ids"], "<i8"), lengths):
                assert gone[at : at + size].sum() == want[i][2]
                at += size


def test_a_passage_and_a_line_in_every_document(spark, monkeypatch):
    """A long passage, and a line shorter than a window with other surroundings each time, both hot."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage, line = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(14))
    rows = [(i, " ".join([word() for _ in range(20)] + [passage if i % 3 else line] + [word() for _ in range(20)])) for i in range(90)]
    monkeypatch.setattr(bwt, "HOT", 5)
    monkeypatch.setattr(bwt, "SHARD_BYTES", 3000)
    got = sorted(map(tuple, bwt.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))
    assert got == repeats(rows)


def test_no_filter_column_is_lost(docs):
    assert simhash.representatives(docs.withColumn("extra", F.lit(1))).columns[-1] == "extra"
