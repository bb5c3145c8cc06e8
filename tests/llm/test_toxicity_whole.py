import random
import zlib

import numpy as np
import pytest

from deploom.llm import toxicity


@pytest.fixture(scope="module")
def scorer():
    return toxicity.Scorer(toxicity.Model({"donaudampfschifffahrt": 1, "b": 2}, np.array([1.0, -1.0])))


def test_every_character_of_a_long_word_counts(scorer):
    for n in (17, 30, 40, 64, 65, 200):
        word = "abcdefgh" * 30
        one, other = word[: n - 1] + "k", word[: n - 1] + "q"
        a, b = scorer.score([f"say {one} now", f"say {other} now"])
        assert a != b, n
        assert all(len(toxicity.normal(p)) <= toxicity.PIECE for p in toxicity.pieces(f"say {one} now"))
        assert "".join(toxicity.pieces(one)) == one


def test_a_longest_word_changes_no_other(scorer):
    known = scorer.model.vocabulary
    words = toxicity.pieces("Donaudampfschifffahrt! b " + "x" * 65, known)
    assert words[0] == "donaudampfschifffahrt" and words[1] == "fahrt" and words[2] == "b"
    assert "".join(words[3:]) == "x" * 65
    assert toxicity.pieces("İ" * 12)[0] == ("İ" * 12).lower()[: toxicity.PIECE]


def test_a_passage_of_half_a_window_lies_whole_in_some_window():
    for n in (17, 32, 33, 49, 100, 500):
        starts = toxicity.window_starts(n)
        for begin in range(n - 16):
            assert any(s <= begin and begin + 17 <= s + toxicity.WINDOW for s in starts), (n, begin)


def slowly(model, words):
    """Logit of one window, written out step by step in double precision."""
    sig = lambda x: 1 / (1 + np.exp(-x))

    def run(gru, inputs):
        h, n, out = np.zeros(gru.h), gru.h, []
        for x in inputs:
            u, p = h @ gru.p["h"], x @ gru.p["x"] + gru.p["b"]
            z, r = sig(p[:n] + u[:n]), sig(p[n : 2 * n] + u[n : 2 * n])
            c = np.tanh(p[2 * n :] + r * u[2 * n :])
            h = (1 - z) * h + z * c
            out.append(h)
        return out

    inputs = []
    for w in words:
        letters = [model.char[ord(c) * 2654435761 % (1 << 32) >> 26] for c in w[: toxicity.PIECE]]  # of a known word; its rest follows as pieces
        ends = [(run(g, letters[::way]) or [np.zeros(g.h)])[-1] for g, way in zip(model.chars, (1, -1))]
        inputs.append(np.concatenate((model.word[model.vocabulary.get(w, 0)], *ends)))
    ahead, back = run(model.words[0], inputs), run(model.words[1], inputs[::-1])[::-1]
    states = [np.concatenate(x) for x in zip(ahead, back)]
    e = [np.tanh(s @ model.att["w"]) @ model.att["v"] for s in states]
    weight = np.exp(e) / np.exp(e).sum() if e else []
    pooled = sum((a * s for a, s in zip(weight, states)), np.zeros(2 * toxicity.HIDDEN))
    return pooled @ model.att["u"] + model.att["c"][0]


def test_scores_are_those_of_the_worst_window(scorer):
    """Scoring in groups, with tables and masks, against the network written out plainly."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 30)))
    texts = ["", "b", "B, b! donaudampfschifffahrt"] + [" ".join(word() for _ in range(rnd.randint(1, 120))) for _ in range(12)]
    want = []
    for t in texts:
        words = [toxicity.normal(p) for p in toxicity.pieces(t, scorer.model.vocabulary)]
        starts = range(0, max(1, len(words) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE)
        want.append(max(slowly(scorer.model, words[s : s + toxicity.WINDOW]) for s in starts))
    got = scorer.score(texts)
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(want))), atol=2e-5)


def test_one_text_per_labelled_document(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (2, "c"), (4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(9)] + [(2, 1)], "doc_id long, toxic int")
    texts, toxic = toxicity.training_sample(docs, labels)
    kept = [i for i in (1, 2, 4) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert texts == [{1: "", 2: "c", 4: "d"}[i] for i in kept] and toxic == [int(i == 2) for i in kept]
