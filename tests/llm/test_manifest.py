"""Merkle manifest, token alignment and document fingerprints against plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from deploom.llm import align, merkle, quartiles

A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return h("".join(shown))


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> Counter of result rows, one tree built whole."""
    by_lang = collections.defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(t, i):
        out = []
        for level in t[:-1]:
            k = i // 8 * 8
            out.append((level[k:i], level[i + 1 : k + 8]))
            i //= 8
        return out

    trees = {x: tree([v[2] for v in sorted(by_lang[x], key=lambda v: v[:3])]) for x in order}
    upper = tree([trees[x][-1][0] for x in order])
    out = collections.Counter()
    for j, x in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(by_lang[x], key=lambda v: v[:3])):
            way = path(trees[x], i) + path(upper, j)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in way:
                node = h(*left, node, *right)
            root = upper[-1][0]
            out[r[0], leaf, trees[x][-1][0], root, h(*[s for left, right in way for s in left + right]), node, node == root] += 1
    return out


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int, part int, size string, salt double, block string"


def manifest_rows(n, langs, seed=1):
    rnd = random.Random(seed)
    rows = [(i if rnd.random() < 0.9 else None, rnd.choice(["web", None, ""]), rnd.choice(langs), rnd.choice([1, None, 70]), rnd.choice([None, "", "Ab", "é Ü X", "lower", f"T{i}" * 9])) for i in range(n)]
    return rows + rows[:5] + [(None, None, None, None, None)] * 2


@pytest.mark.parametrize("n, langs, depth, top", [(700, ["en", "de", None, ""], 4, 4096), (700, ["en", "de", None, "ü"], 1, 4), (300, [f"l{i}" for i in range(150)], 1, 8), (300, [f"l{i}" for i in range(150)], 2, 1), (9, ["en"], 1, 1), (1, ["en"], 4, 4096)])
def test_manifest(spark, n, langs, depth, top):
    rows = manifest_rows(n, langs) if n > 1 else [(3, "s", "en", 1, "ABC")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y", 0.5, "z") for r in rows], MANIFEST).repartition(3)
    got = collections.Counter(tuple(r) for r in merkle.manifest(docs, depth, top).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == plain_manifest(rows)


def test_manifest_s_sql():
    import duckdb
    import pyarrow as pa

    rows = manifest_rows(400, [None, "ü", "", *[f"l{i}" for i in range(20)]])
    documents = pa.Table.from_pylist([dict(zip(merkle.FIELDS, r)) for r in rows], pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("text", pa.string())]))
    con = duckdb.connect()
    con.register("documents", documents)
    got = con.execute(merkle.oracle()).fetchall()
    assert collections.Counter(got) == plain_manifest(rows)


def test_manifest_of_nothing(none):
    assert merkle.manifest(none).count() == 0


def test_long_fields_are_told_apart():
    assert merkle.steps(1) == 0 and merkle.steps(8) == 1 and merkle.steps(9) == 2
    tree = merkle.levels([h(str(i)).encode() for i in range(70)])
    for leaf, proof in zip(tree[0], merkle.proofs(tree, [b""])):
        assert merkle.fold(leaf, merkle.unpack(proof)) == tree[-1][0]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from deploom.llm.tokens import byte_alphabet

    a, b = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    back = {c: k for k, c in enumerate(byte_alphabet())}
    every, counts = [], collections.Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        by_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        by_b = [bytes((int(p[3:5], 16),)) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(by_a) != raw or b"".join(by_b) != raw:
            every.append((doc_id, None))
            continue
        place = lambda t: list(zip(np.cumsum([0, *map(len, t[:-1])]).tolist(), np.cumsum([len(x) for x in t]).tolist()))
        pa, pb = place(by_a), place(by_b)
        links, j = [], 0
        for i, (s, e) in enumerate(pa):
            while pb[j][1] <= s:
                j += 1
            k = j
            while k < len(pb) and pb[k][0] < e:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        counts.update(links)
        groups, at_a, at_b = [], 0, 0
        for end in sorted({e for _, e in pa} & {e for _, e in pb}):
            to_a, to_b = next(i for i in range(at_a, len(pa)) if pa[i][1] == end) + 1, next(i for i in range(at_b, len(pb)) if pb[i][1] == end) + 1
            groups.append(",".join(map(str, ids_a[at_a:to_a])) + "|" + ",".join(map(str, ids_b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        every.append((doc_id, (len(ids_a), len(ids_b), groups, links)))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = collections.Counter()
    for doc_id, got in every:
        if got is None:
            out[doc_id, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            n_a, n_b, groups, links = got
            out[doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), h(";".join(groups))] += 1
    return out


ODD = ["▁x a▁b", "<s> </s> <unk> <|endoftext|> a<|endoftext|>b", "  lead", "trail ", "trail  ", "a \n b\t c", "\n", " ", "tab\tx\xa0 y　 z", "\x00 \x1c a\x1c b", "naïve ﬁ \U0001f600\U0001f600 中文字 𐍈", "<0x41> x", "don't  stop!!   ...", "word" * 400]


def test_alignment(spark, docs, none, monkeypatch):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rnd = random.Random(9)
    texts += [(100 + k, t) for k, t in enumerate(ODD)]
    texts += [(1000 + k, "".join(rnd.choice("abc é\n  \tde1 2　ü.,!'s<|>▁\x1c") for _ in range(rnd.randint(0, 40)))) for k in range(600)]
    want = plain_alignment(texts)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, pair string, n int").repartition(3)
    names = list(align.COLUMNS)
    assert collections.Counter(map(tuple, align.align(frame, A_FILE, B_FILE).select(names).collect())) == want
    for hot in (0, 50):  # most links are joined
        monkeypatch.setattr(align, "HOT_PAIRS", hot)
        assert collections.Counter(map(tuple, align.align(frame, A_FILE, B_FILE).select(names).collect())) == want
    monkeypatch.undo()
    assert align.align(none, A_FILE, B_FILE).count() == 0


def test_long_units_are_aligned_in_pieces(monkeypatch):
    both = align.Tokenizers(A_FILE, B_FILE)
    rnd = random.Random(2)
    text = "".join(rnd.choice("etaoin-é~") for _ in range(30_000)) + " short " + "x" * 9000
    whole = align.Units(both)
    seq = whole.texts([text])[0]
    assert max(map(len, [*whole.known, *whole.word])) <= align.LONG_UNIT  # long units are not kept
    monkeypatch.setattr(align, "LONG_TOKENS", 100)
    cut = align.Units(both)
    parts = cut.texts([text])[0]
    assert len(parts) > 50
    for units, got in ((whole, seq), (cut, parts)):
        pair, unit = units.links()
        sums = np.concatenate(units.sums)
        shown = ";".join(units.shown[k] for k in got)
        links = collections.Counter()
        for p, u in zip(pair.tolist(), unit.tolist()):
            links[p] += int((got == u).sum())
        if units is whole:
            first = shown, sums[got].sum(axis=0).tolist(), links
    assert first == (shown, sums[got].sum(axis=0).tolist(), links)


def test_units_are_dropped_when_full(spark, docs, monkeypatch):
    """Partial counts and rows are the same whether all units are kept or most are dropped again and again."""
    import pyarrow as pa
    import pyspark

    rows = [(i, r["text"] or "") for i, r in enumerate(docs.select("text").collect())] * 2
    texts = pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})
    keyed = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))

    def both():
        align._units.cache_clear()
        counts = collections.Counter()
        for b in align._count_pairs(A_FILE, B_FILE, [texts]):
            for pairs, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts.update(dict(zip(pairs, n)))
        counts = +counts
        pairs = np.array(sorted(counts)[::2], np.int64)  # every other pair is left out of the table

        class Hot:
            value = pairs, np.array([counts[p] for p in pairs.tolist()], np.int64), pairs % 3 == 0

        out = [r for b in align._align_rows(A_FILE, B_FILE, Hot, [keyed]) for r in b.to_pylist()]
        return counts, out, align._units(A_FILE, B_FILE)

    counts, out, units = both()
    assert counts and units.kept is None
    monkeypatch.setattr(align, "UNIT_BYTES", 20_000)
    monkeypatch.setattr(align, "MORE_BYTES", 3_000)
    monkeypatch.setattr(align, "TEXT_SLICE", 300)
    again, rows_again, units = both()
    assert again == counts and rows_again == out and units.kept is not None
    align._units.cache_clear()


def plain_fingerprint(text):
    raw = text.encode()
    count = [0] * quartiles.BUCKETS
    ends = b"\xff\xff" + raw + b"\xff\xff" if raw else b""
    m = 1 << 32
    for salt, (x, y, z) in enumerate(quartiles.TRIPLETS):
        for i in range(len(ends) - z):
            v = (ends[i + x] * 0x9E3779B1 + ends[i + y] * 0x85EBCA77 + ends[i + z] * 0xC2B2AE3D + salt * 0x27D4EB2F) % m
            v ^= v >> 15
            v = v * 0x2C1B3C6D % m
            v ^= v >> 12
            count[v % quartiles.BUCKETS] += 1
    s = sorted(count)
    q = [s[len(s) * k // 4 - 1] for k in (1, 2, 3)]
    code = [sum(c > x for x in q) for c in count]
    packed = bytes(code[i] << 6 | code[i + 1] << 4 | code[i + 2] << 2 | code[i + 3] for i in range(0, len(code), 4))
    return quartiles.length_code(len(raw)).to_bytes(2, "big").hex() + packed.hex()


def test_fingerprint_by_definition(monkeypatch):
    for t in ["", "a", "ab", "abc", "hello wörld " * 9, "x" * 3000]:
        assert quartiles.fingerprint(t.encode()) == plain_fingerprint(t)
    t = "".join(random.Random(3).choice("abcdefg é") for _ in range(5000))
    whole = quartiles.fingerprint(t.encode())
    monkeypatch.setattr(quartiles, "SLICE", 97)
    assert quartiles.fingerprint(t.encode()) == whole
    assert quartiles.likeness(whole, whole) == 1.0 and 0 <= quartiles.likeness(whole, quartiles.fingerprint(b"")) < 0.05
    assert quartiles.likeness(quartiles.fingerprint(b""), quartiles.fingerprint(b"")) == 1.0


def test_fingerprints(spark, docs, none):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = collections.Counter()
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        a, b, c = (plain_fingerprint(t) for t in (text, changed, following))
        want[doc_id, len(text), h(changed), a, b, quartiles.likeness(a, b), quartiles.likeness(a, c)] += 1
    got = quartiles.fingerprints(docs)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert collections.Counter(map(tuple, got.collect())) == want
    assert quartiles.fingerprints(none).count() == 0
    one = quartiles.fingerprints(spark.createDataFrame([(1, "Only one text here.")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_fingerprints_tell_edited_from_other_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quartiles.fingerprints(docs).where("n_chars >= 200").toPandas()
    assert (got["near_edited"] > got["near_next"]).mean() > 0.99
    assert got["near_edited"].quantile(0.02) > 0.6 and got["near_next"].median() < 0.55
