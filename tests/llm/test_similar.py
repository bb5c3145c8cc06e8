import random

import corpus_pipeline as C
from deploom.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts, bound=0.8):
    """(doc_id to smallest linked doc_id, linked pairs) by definition."""
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = []
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= bound * len(sets[a] | sets[b])):
                pairs.append((a, b))
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, pairs


def near_texts():
    """Families whose members have a few words changed, so that similarities lie on both sides of 0.8."""
    rnd = random.Random(9)
    out = {}
    for _ in range(40):
        base = [f"w{rnd.randrange(9000)}" for _ in range(rnd.randint(60, 260))]
        for k in range(4):
            copy = list(base)
            for _ in range(k * len(base) // 120):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randrange(9000)}"
            out[len(out)] = " ".join(copy)
    return out | {900: None, 901: "", 902: "A few", 903: "a  FEW"}


def test_stage_keeps_no_pair_of_similar_documents(spark, monkeypatch):
    texts = near_texts()
    want, pairs = brute(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for tile in (simhash.TILE_DOCUMENTS, 2):
        monkeypatch.setattr(simhash, "TILE_DOCUMENTS", tile)
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == want
    kept = {r["doc_id"] for r in C.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(want.values())
    narrow = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    caught = sum(narrow[a] == narrow[b] for a, b in pairs)
    print(f"pairs of 0.8 or more: {len(pairs)}, within 4 bits: {caught}")
    assert caught < len(pairs)


def test_rows_without_id_and_repeats(spark, docs, none):
    got = simhash.representatives(docs, simhash.SIMILAR)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and simhash.representatives(none, simhash.SIMILAR).count() == 0


def test_stage_links_by_fingerprints_and_pivots(spark, monkeypatch):
    """Links of fingerprints, found by pivots, are among the pairs that are verified; pivots discard before the bits are compared."""
    texts = near_texts()
    want, pairs = brute(texts)
    name = lambda t: simhash._set_prints([simhash.shingle_set(t.encode())])[0]
    near = [(a, b) for a, b in pairs if texts[a] and texts[b] and (name(texts[a]) ^ name(texts[b])).bit_count() <= simhash.RADIUS]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = []
    monkeypatch.setattr(simhash, "links", lambda distinct, f=simhash.links: found.append(f(distinct)) or found[0])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert found[0].count() > 20 and got == want
    assert len(near) > 20 and all(got[a] == got[b] for a, b in near)
    seen = []
    monkeypatch.setattr(simhash, "pivot_table", lambda n=simhash.PIVOTS, f=simhash.pivot_table: seen.append(n) or f(n))
    sets = [simhash.shingle_set(texts[k].encode()) for k in range(8)]
    simhash._similar_links(simhash.np.zeros(8, int), sets, simhash.SIMILAR, simhash.WIDE_RADIUS)
    assert seen == [simhash.PIVOTS]
