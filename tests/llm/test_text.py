import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from deploom.llm import license, pii, toxicity
from deploom.llm.license_rules import rules

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum((lambda x: x - 9 if x > 9 else x)(int(c) * (1 + i % 2)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end(), kind))
    return [(k, s, e) for s, n, e, k in sorted(out)]


def test_base_spans():
    rnd = random.Random(3)
    for _ in range(15000):
        t = "".join(rnd.choice("0123456789.-+ ()@ab%_") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(t) == base_spans(t), t
    zeros = "0" * 5000
    assert pii.base_spans(zeros + ".1.1.1 " + "1" * 5000 + ".1.1.1") == [("ip", 0, 5006)]


def test_personal_data(docs, none):
    rows = docs.select("doc_id", "text").collect()
    got = pii.digest(pii.find(docs)).collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], hashlib.sha256(",".join("%s:%d:%d" % s for s in base_spans(r["text"] or "")).encode()).hexdigest()) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["base_sha256"]) for r in got) == want
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = clean.where("doc_id = 18").first()["text"]
    assert text.startswith("mail [EMAIL] or x@y now [IP] and 999.1.1.1 card [CARD] tel [PHONE]")
    assert pii.find(none).count() == 0 and pii.sanitise(none).count() == 0


def counted(texts):
    """Terms beyond the thresholds, from their definition: over all documents, whole words only."""
    strip = lambda w: w.strip(pii._EDGES).lower()
    beside, held, with_entity = {}, {}, 0
    for text in texts.values():
        spans, words = base_spans(text), [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        inside = {i for i, (s, e) in enumerate(words) if any(s < b and a < e for _, a, b in spans)}
        with_entity += bool(spans)
        near = {i for i in range(len(words)) if i not in inside and any(abs(i - k) <= pii.CONTEXT for k in inside)}
        for t in {strip(text[words[i][0] : words[i][1]]) for i in near}:
            if len(t) > 1:
                beside[t] = beside.get(t, 0) + 1
        for t in {strip(w) for w in text.split()}:
            held[t] = held.get(t, 0) + 1
    bits = {t: np.log2(n / held[t] / (with_entity / len(texts))) for t, n in beside.items() if n >= pii.SUPPORT and n / held[t] >= pii.SHARE}
    return {t: "remove" if b >= pii.REMOVE else "general" for t, b in bits.items() if b >= pii.GENERALISE}


def test_terms_by_definition(spark):
    """Random corpora in which some words stand mostly beside addresses; removal, and each kind of generalisation."""
    rnd = random.Random(12)
    filler = [f"f{i}" for i in range(40)]
    for share in (3, 20):
        rows = []
        for i in range(200):
            words = [rnd.choice(filler) for _ in range(rnd.randint(8, 30))]
            if i % share == 0:
                words[4:4] = ["Person", "4711", "secretly", f"u{i}@host.example"]
            elif i % 7 == 0:
                words.append("secretly")
            rows.append((i, " ".join(words)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        terms = {r["term"]: r["action"] for r in pii.disclosing_terms(docs, pii.scan(docs)).collect()}
        assert terms == counted(dict(rows))
    assert terms["person"] == "remove"
    x = lambda word: F.struct(F.lit("general").alias("kind"), F.lit(0).cast("long").alias("s"), F.lit(len(word)).cast("long").alias("e"))
    got = [spark.range(1).select(F.lit(w).alias("text")).select(pii._placeholder(x(w)).alias("p")).first()["p"] for w in ("Person", "4711", "émile")]
    assert got == ["[NAME]", "[NUMBER]", "[WORD]"]


def test_disclosing_terms(spark):
    rnd = random.Random(1)
    fill = lambda: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(12))
    rows = [(i, f"{fill()} reach Codeword me{i}@mail.example {fill()}" if i < 6 else fill()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r["term"]: r["action"] for r in pii.disclosing_terms(docs, pii.scan(docs)).collect()}
    assert set(terms) == {"reach", "codeword"}
    found = pii.digest(pii.find(docs)).where("doc_id = 2").first()
    assert "email:" in found["spans"] and found["spans"].count("general:") + found["spans"].count("remove:") == 2
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert counted(dict(rows)) == terms
    assert "Codeword" not in clean[2] and "[EMAIL]" in clean[2] and clean[30] == rows[30][1]


def test_licences(docs, none):
    phrases = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
    got = {r["doc_id"]: r for r in license.scan(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        if r["doc_id"] is None:
            continue
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        hits = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        o = got[r["doc_id"]]
        assert (o["n_words"], o["n_base"], o["first_word"], o["last_word"]) == (len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None))
        assert o["base_labels"] == ",".join(sorted({x for _, x in hits})) and set(filter(None, o["base_labels"].split(","))) <= set(o["labels"].split(",")) and 0 <= o["score"] <= 1
    assert "cc-by-nc-4.0" in got[19]["labels"] and "cc-by-nc," not in got[19]["labels"]  # the longer, better rule suppresses the shorter
    assert got[20]["labels"] == "gpl,gpl-3-or-later,mit"
    assert license.scan(none).count() == 0 and len(rules()) > 200
    assert all(k in re.sub(r"\(\?:[^()]*\)\?", "", p) for _, _, _, k, p in rules())  # no rule is lost to its own keyword


def test_licence_sql(docs):
    import duckdb

    c = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()
    c.register("documents", frame)
    key = lambda r: tuple((x is None or x != x, 0 if x is None or x != x else x) for x in r)
    want = sorted(key(r) for r in c.execute(license.oracle()).fetchall())
    assert sorted(key(r) for r in license.scan(docs).collect()) == want


def test_rules_by_definition(spark):
    """Texts made of the rules' own words: labels and score against intervals found word by word."""
    rnd = random.Random(6)
    numbered = rules()
    plain = [p for *_, p in numbered if not set("(?.[") & set(p)]
    texts = [" ".join(rnd.choice(plain + ["some", "other words"]) for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = t.split()
        starts = {m.start(): k for k, m in enumerate(re.finditer(r"\S+", t))}
        ends = {m.end(): k for k, m in enumerate(re.finditer(r"\S+", t))}
        hits = []
        for n, label, tier, _, p in numbered:
            hits += [(tier, n, starts[m.start()], ends[m.end()], label) for m in re.finditer(rf"(?<!\S)(?:{p})(?!\S)", t)]
        better = lambda g, h: g[2] <= h[2] and g[3] >= h[3] and (g[0] < h[0] or g[0] == h[0] and (g[3] - g[2] > h[3] - h[2] or g[2:4] == h[2:4] and g[1] < h[1]))
        kept = [h for h in hits if not any(better(g, h) for g in hits)]
        base = [label for p, label in license.BASE if re.search(rf"(?<!\S)(?:{p})(?!\S)", t)]
        assert got[i]["labels"] == ",".join(sorted({h[4] for h in kept} | set(base))), t
        assert got[i]["score"] == len({k for h in kept for k in range(h[2], h[3] + 1)}) / len(words), t


def corpus(n=500, seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("bcdlmnrst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3))) for _ in range(400)]
    bad = ["grobian", "schuft", "lump", "tropf"]
    texts, labels = [], []
    for i in range(n):
        own = [rnd.choice(words) for _ in range(rnd.randint(5, 150))]
        y = int(rnd.random() < 0.25)
        for _ in range(3 * y):
            own.insert(rnd.randrange(len(own)), rnd.choice(bad))
        texts.append(" ".join(own))
        labels.append(y)
    return texts, labels


def test_gradients():
    model = toxicity.Model({"a": 1, "b": 2}, np.array([1.0, -1.0]))
    windows, labels = [["a", "xyz", "b"], ["b"], ["q", "a"]], np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.mean([np.log1p(np.exp(-x if y else x)) for x, y in zip(_logits(model, windows), labels)]))
    grads, params = model.gradients(windows, labels), model.named()
    rng = np.random.default_rng(0)
    for name, p in params.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if name == "word" and at[0] == 0:
                continue
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5, (name, at)


def _logits(model, windows):
    out = []
    for w in windows:
        x, _ = model.features(w, keep=True)
        mask = np.ones((len(w), 1))
        states = [g.forward((x[::way] @ g.p["x"] + g.p["b"])[:, None], mask)[0][::way] for g, way in zip(model.words, (1, -1))]
        out.append(model.pool(np.concatenate(states, axis=2), mask)[0][0])
    return out


def test_toxicity(spark, none):
    texts, labels = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9000, None, "x"), (9001, "", "x"), (9002, "w" * 3000, "x"), (None, "grobian schuft lump", "x")], "doc_id long, text string, score string")
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, table).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(500))
    held = [i for i in range(500) if got[i]["held_out"]]
    right = np.mean([got[i]["predicted"] == labels[i] for i in held])
    assert right >= 0.93 and all(0 <= r["score"] <= 1 for r in got.values()) and got[9000]["score"] == got[9001]["score"]
    kept = toxicity.clean(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got.values())
    assert toxicity.score(none, table).count() == 0
    assert toxicity.score(docs, table.limit(0)).count() == docs.count()


def test_windows_cover_everything():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        starts = toxicity.window_starts(n)
        assert set(range(n)) <= {k for s in starts for k in range(s, s + toxicity.WINDOW)}
    assert "".join(toxicity.pieces("ab " + "x" * 100)) == "ab" + "x" * 100


def test_hashes_agree(spark):
    assert spark.range(1).select(F.crc32(F.lit("12").cast("binary")).alias("c")).first()["c"] == zlib.crc32(b"12")


def test_long_text_of_notices(spark):
    """100,000 words that are nearly all notices: every block of the folds counts, and time does not grow with the square."""
    import time

    from deploom.llm import license

    piece = "All Rights Reserved. Licensed under CC BY-NC 4.0 cc by GNU General Public License, version 3 or any later version; The MIT License. Apache License, Version 2.0 "
    n = 3500
    docs = spark.createDataFrame([(1, piece), (2, piece * n)], "doc_id long, text string")
    began = time.time()
    one, many = sorted(license.scan(docs).collect(), key=lambda r: r["doc_id"])
    assert time.time() - began < 90
    assert many["n_words"] == n * one["n_words"] and many["n_base"] == n * one["n_base"] and abs(many["score"] - one["score"]) < 1e-9
    assert (many["labels"], many["base_labels"], many["first_word"]) == (one["labels"], one["base_labels"], one["first_word"])
    assert many["last_word"] == (n - 1) * one["n_words"] + one["last_word"]
