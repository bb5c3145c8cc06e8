"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector (for the vocabulary learned in training) beside a character vector:
the last states of a small bidirectional recurrent network over its characters.  A window of
``WINDOW`` words runs through a bidirectional recurrent network; attention pools its states into one
vector and that into a logit.  Windows begin every ``STRIDE`` words, half a window, and cover the whole
text: a passage of up to 17 words lies whole in some window wherever it begins.  A document scores as
its worst window.

Training uses a sample of at most ``TRAIN_TOXIC`` + ``TRAIN_CLEAN`` labelled documents (the smallest
hashes), so its cost does not grow; scoring covers every window of every document.
"""

from __future__ import annotations

import zlib
from sys import intern

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, one_table_at_a_time, text_or_empty

WINDOW, STRIDE = 32, 16
THRESHOLD = 0.7
#: Bounds of the training sample, and how many windows a training document gives.
TRAIN_TOXIC, TRAIN_CLEAN, WINDOWS_A_DOC = 1500, 2500, 2
VOCABULARY = 20_000
WORD_DIM, CHAR_DIM, CHAR_HIDDEN, HIDDEN = 8, 6, 4, 8
#: Characters of a token that the character network sees; what a longer word has beyond them enters as further tokens.
PIECE = 16
ALPHABET = 64
#: Each of the two fits takes at least this many epochs and steps.
EPOCHS, STEPS, BATCH, RATE = 2, 80, 128, 0.01
#: Significance (log-likelihood ratio) that a word needs to enter the vocabulary.
EVIDENCE = 10.0
#: Logit from which a clean text's window is trained on again.
HARD = -3.0
#: Tokens that are scored together.
GROUP_TOKENS = 1 << 17
#: Word projections kept per worker.
CACHE_WORDS = 200_000

_EDGES = ".,;:!?\"'()[]{}|*%&#$<>=/\\-_+@"


def normal(token: str) -> str:
    return token.strip(_EDGES).lower()


def pieces(text: str, known=()) -> list[str]:
    """Tokens: words, the long ones in pieces so that no character is left out.

    A long word whose normal form is ``known`` stays whole (its own vector is looked up) and its
    further pieces follow; any other is cut into consecutive pieces of its normal form.
    """
    out = text.split()
    if max(map(len, out), default=0) > PIECE // 2:  # small letters may be longer: at most double
        out = [x for w in out for x in ((w,) if len(w) <= PIECE // 2 else _cut(w, known))]
    return out


def _cut(word: str, known) -> list[str]:
    n = normal(word)
    if len(n) <= PIECE:
        return [word]
    cut = [n[k : k + PIECE] for k in range(0, len(n), PIECE)]
    return [n, *cut[1:]] if n in known else cut


class _Every:
    """Knows every word."""

    def __contains__(self, word) -> bool:
        return True


def window_starts(n: int) -> np.ndarray:
    """First words of all windows of a text of n words; the last window reaches its end."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Gru:
    """One direction; sequences are (time, batch, features) with a mask (time, batch)."""

    def __init__(self, rng, size, hidden):
        self.h = hidden
        self.p = {"x": rng.normal(0, size**-0.5, (size, 3 * hidden)), "h": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), "b": np.zeros(3 * hidden)}

    def forward(self, proj, mask, keep=False):
        """proj: inputs times p["x"] plus p["b"]; returns states (time, batch, hidden)."""
        h, wh, n = np.zeros((proj.shape[1], self.h), proj.dtype), self.p["h"].astype(proj.dtype), self.h
        out, memo = np.empty((*proj.shape[:2], n), proj.dtype), []
        for t in range(len(proj)):
            u = h @ wh
            zr = _sigmoid(proj[t, :, : 2 * n] + u[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(proj[t, :, 2 * n :] + r * u[:, 2 * n :])
            m = mask[t][:, None]
            new = h + m * z * (c - h)
            if keep:
                memo.append((h, z, r, c, u[:, 2 * n :], m))
            h = out[t] = new
        return out, memo

    def backward(self, grad, memo):
        """grad: of the states; returns the gradients of proj and of p["h"]."""
        n, dh, dproj, dwh = self.h, 0.0, np.empty((len(memo), memo[0][0].shape[0], 3 * self.h)), np.zeros_like(self.p["h"])
        for t in range(len(memo) - 1, -1, -1):
            h, z, r, c, uc, m = memo[t]
            d = grad[t] + dh
            dc = d * m * z * (1 - c * c)
            dz = d * m * (c - h) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            du = np.concatenate((dz, dr, dc * r), axis=1)
            dproj[t] = np.concatenate((dz, dr, dc), axis=1)
            dwh += h.T @ du
            dh = d * (1 - m * z) + du @ self.p["h"].T
        return dproj, dwh


class Model:
    """Parameters, scoring, and training by Adam on the log loss of windows."""

    def __init__(self, vocabulary: dict[str, int], init: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary  # word -> row from 1; 0: any other word
        self.word = rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM))
        self.word[0] = 0
        self.word[1:, 0] = init
        self.char = rng.normal(0, 0.3, (ALPHABET, CHAR_DIM))
        self.chars = [Gru(rng, CHAR_DIM, CHAR_HIDDEN) for _ in range(2)]
        self.words = [Gru(rng, WORD_DIM + 2 * CHAR_HIDDEN, HIDDEN) for _ in range(2)]
        self.att = {"w": rng.normal(0, (2 * HIDDEN) ** -0.5, (2 * HIDDEN, HIDDEN)), "v": rng.normal(0, HIDDEN**-0.5, HIDDEN), "u": rng.normal(0, 0.3, 2 * HIDDEN), "c": np.array([-1.0])}

    @staticmethod
    def char_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(PIECE, words) character numbers and mask; the alphabet is folded."""
        code = np.array(words, dtype=f"U{PIECE}").view(np.uint32).reshape(len(words), PIECE)
        ids = (code.astype(np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32) >> np.uint64(26)).astype(np.int64)
        return ids.T, (code != 0).T.astype(np.float64)

    def features(self, words: list[str], keep=False):
        """(words, WORD_DIM + 2 CHAR_HIDDEN): word vectors beside character vectors."""
        rows = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        ids, mask = self.char_ids(words)
        ends, memos = [], []
        for gru, way in zip(self.chars, (1, -1)):
            x = self.char[ids[::way]]
            if keep:
                proj = x @ gru.p["x"] + gru.p["b"]
            else:  # scoring: one projection per character of the alphabet, single precision
                proj, mask = (self.char @ gru.p["x"] + gru.p["b"]).astype(np.float32)[ids[::way]], mask.astype(np.float32)
            states, memo = gru.forward(proj, mask[::way], keep)
            ends.append(states[-1])
            memos.append((x, memo))
        return np.concatenate((self.word[rows], *ends), axis=1), (rows, ids, memos)

    def pool(self, states, mask):
        """Attention over time: logits, and what backward needs."""
        a = self.att
        t = np.tanh(states @ a["w"].astype(states.dtype))
        e = np.where(mask > 0, t @ a["v"].astype(states.dtype), -1e9)
        w = np.exp(e - e.max(axis=0))
        w = np.where(mask > 0, w, 0)
        w = w / np.maximum(w.sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * states).sum(axis=0)
        return pooled @ a["u"].astype(states.dtype) + states.dtype.type(a["c"][0]), (t, w, pooled)

    def projections(self, words: list[str]) -> np.ndarray:
        """What the word network adds up per word, both directions side by side (float32)."""
        x, _ = self.features(words)
        return np.concatenate([x @ g.p["x"] + g.p["b"] for g in self.words], axis=1).astype(np.float32)

    def logits(self, proj, mask):
        """proj (time, windows, 6 HIDDEN) float32, mask (time, windows)."""
        n = 3 * HIDDEN
        ahead, _ = self.words[0].forward(proj[:, :, :n], mask)
        back, _ = self.words[1].forward(proj[::-1, :, n:], mask[::-1])
        return self.pool(np.concatenate((ahead, back[::-1]), axis=2), mask)[0]

    def fit(self, windows: list[list[str]], labels: np.ndarray, seed: int = 11) -> None:
        rng, state = np.random.default_rng(seed), {}
        params = self.named()
        step = 0
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(windows))))):
            order = rng.permutation(len(windows))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                grads = self.gradients([windows[i] for i in own], labels[own])
                step += 1
                for name, p in params.items():
                    g = grads[name]
                    m, v = state.setdefault(name, (np.zeros_like(p), np.zeros_like(p)))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    def named(self) -> dict[str, np.ndarray]:
        out = {"word": self.word, "char": self.char, **{"att_" + k: v for k, v in self.att.items()}}
        for name, grus in (("c", self.chars), ("w", self.words)):
            for i, g in enumerate(grus):
                out |= {f"{name}{i}{k}": v for k, v in g.p.items()}
        return out

    def gradients(self, windows, labels):
        unique = sorted({w for x in windows for w in x})
        at = {w: i for i, w in enumerate(unique)}
        T, B = WINDOW, len(windows)
        index, mask = np.zeros((T, B), np.int64), np.zeros((T, B))
        for b, x in enumerate(windows):
            index[: len(x), b] = [at[w] for w in x]
            mask[: len(x), b] = 1
        feats, (rows, ids, memos) = self.features(unique or [""], keep=True)
        x = feats[index]
        outs, kept = [], []
        for gru, way in zip(self.words, (1, -1)):
            s, memo = gru.forward(x[::way] @ gru.p["x"] + gru.p["b"], mask[::way], True)
            outs.append(s[::way])
            kept.append(memo)
        states = np.concatenate(outs, axis=2)
        logit, (t, w, pooled) = self.pool(states, mask)
        g = {k: np.zeros_like(v) for k, v in self.named().items()}
        d = (_sigmoid(logit) - labels) / B
        g["att_u"] += pooled.T @ d
        g["att_c"] += d.sum()
        dp = d[:, None] * self.att["u"]
        dw = (states * dp).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        dt = de[:, :, None] * self.att["v"] * (1 - t * t)
        g["att_v"] += (t * de[:, :, None]).sum(axis=(0, 1))
        g["att_w"] += np.einsum("tbi,tbj->ij", states, dt)
        ds = w[:, :, None] * dp + dt @ self.att["w"].T
        dx = np.zeros_like(x)
        for i, way in ((0, 1), (1, -1)):
            gru = self.words[i]
            dproj, dwh = gru.backward(ds[:, :, i * HIDDEN : (i + 1) * HIDDEN][::way], kept[i])
            g[f"w{i}h"] += dwh
            g[f"w{i}b"] += dproj.sum(axis=(0, 1))
            g[f"w{i}x"] += np.einsum("tbi,tbj->ij", x[::way], dproj)
            dx += (dproj @ gru.p["x"].T)[::way]
        df = np.zeros_like(feats)
        np.add.at(df, index.ravel(), (dx * mask[:, :, None]).reshape(-1, dx.shape[2]))
        np.add.at(g["word"], rows, df[:, :WORD_DIM])
        g["word"][0] = 0
        for i, way in ((0, 1), (1, -1)):
            gru, (cx, memo) = self.chars[i], memos[i]
            ends = np.zeros((PIECE, len(feats), CHAR_HIDDEN))
            ends[-1] = df[:, WORD_DIM + i * CHAR_HIDDEN : WORD_DIM + (i + 1) * CHAR_HIDDEN]
            dproj, dwh = gru.backward(ends, memo)
            g[f"c{i}h"] += dwh
            g[f"c{i}b"] += dproj.sum(axis=(0, 1))
            g[f"c{i}x"] += np.einsum("tbi,tbj->ij", cx, dproj)
            np.add.at(g["char"], ids[::way].ravel(), (dproj @ gru.p["x"].T).reshape(-1, CHAR_DIM))
        return g


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit on whole labelled texts.

    Word weights (smoothed log odds of document counts) start the word vectors and choose the
    windows: of a toxic text its most telling one, of a clean text its most and least suspicious.
    """
    docs = [[intern(normal(w)) for w in pieces(t, _Every())] for t in texts]  # one string per distinct token
    fresh = _without_copies(docs)
    docs, texts, labels = ([x[i] for i in fresh] for x in (docs, texts, labels))
    counts: dict[str, list[int]] = {}
    for words, label in zip(docs, labels):
        for w in set(words):
            counts.setdefault(w, [0, 0])[label] += 1
    n1, n0 = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    found = [w for w in counts if sum(counts[w]) >= 2]
    a, b = (np.array([counts[w][k] for w in found], float) for k in (0, 1))
    share = n1 / (n0 + n1)
    evidence = 2 * (b * np.log(np.maximum(b, 1e-9) / ((a + b) * share)) + a * np.log(np.maximum(a, 1e-9) / ((a + b) * (1 - share))))
    weight = np.log((b + 0.5) / (n1 + 1)) - np.log((a + 0.5) / (n0 + 1))
    order = sorted(np.flatnonzero(evidence >= EVIDENCE), key=lambda i: (-evidence[i], found[i]))[:VOCABULARY]
    odds = {found[i]: float(weight[i]) for i in order}
    model = Model({w: i + 1 for i, w in enumerate(odds)}, np.clip(list(odds.values()), -3, 6))
    del docs, counts
    docs = [[intern(normal(w)) for w in pieces(t, odds)] for t in texts]
    rng = np.random.default_rng(5)
    windows, target = [], []
    for words, label in zip(docs, labels):
        starts = window_starts(len(words))
        worth = np.array([odds.get(w, 0.0) for w in words] + [0.0])
        gain = np.array([worth[s : s + WINDOW].max(initial=0) + 0.1 * worth[s : s + WINDOW].clip(0).sum() for s in starts])
        if label:
            chosen = np.argsort(-gain, kind="stable")[:1]
        else:
            chosen = np.unique(np.concatenate((np.argsort(-gain, kind="stable")[:1], rng.integers(0, len(starts), WINDOWS_A_DOC - 1))))
        for s in starts[chosen]:
            windows.append(words[s : s + WINDOW])
            target.append(label)
    if not 0 < sum(target) < len(target):
        return model
    model.fit(windows, np.array(target, float))
    # once more, with the windows of clean texts that still look worst
    test = Scorer(model)
    for words, label in zip(docs, labels):
        if not label:
            starts = window_starts(len(words))
            score = test.windows(words, starts)
            worst = np.argsort(-score, kind="stable")[:2]
            for s in starts[worst[score[worst] > HARD]]:
                windows.append(words[s : s + WINDOW])
                target.append(0)
    model.fit(windows, np.array(target, float))
    return model


def _without_copies(docs: list[list[str]]) -> list[int]:
    """Places of documents that share neither of two minimal five-word hashes with an earlier one: copies would pose as evidence."""
    seen, out = set(), []
    for i, words in enumerate(docs):
        hashes = {zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4))}
        keys = (0, min(hashes)), (1, min(h * 2654435761 % (1 << 32) for h in hashes))
        if not seen.intersection(keys):
            out.append(i)
        seen.update(keys)
    return out


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Labelled documents with crc32(doc_id) mod 3 other than 1, at most ``TRAIN_TOXIC`` and ``TRAIN_CLEAN``, by smallest hash.

    Of several rows of one doc_id the smallest text is taken, of several labels the larger.
    """
    own = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = own.where("toxic = 1").orderBy(*order).limit(TRAIN_TOXIC).unionByName(own.where("toxic = 0").orderBy(*order).limit(TRAIN_CLEAN))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


class Scorer:
    """Scores batches of texts with a table of word projections."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 6 * HIDDEN), np.float32)

    def learn(self, tokens) -> None:
        """Add the projections of tokens not in the table yet."""
        missing = list(set(tokens).difference(self.row))
        if len(self.row) + len(missing) > CACHE_WORDS:
            self.reset()
            missing = list(set(tokens))
        if not missing:
            return
        normals = [normal(w) for w in missing]
        names = sorted(set(normals))
        at = {w: k for k, w in enumerate(names)}
        values = np.concatenate([self.model.projections(names[k : k + 4096]) for k in range(0, len(names), 4096)])
        first = len(self.row)
        if len(self.table) < first + len(missing):
            more = max(1 << 15, first + len(missing) - len(self.table))
            self.table = np.concatenate((self.table, np.zeros((more, 6 * HIDDEN), np.float32)))
        self.table[first : first + len(missing)] = values[[at[w] for w in normals]]
        self.row.update(zip(missing, range(first, first + len(missing))))

    def score(self, texts: list[str]) -> np.ndarray:
        """Worst window of each text; texts go in groups of about ``GROUP_TOKENS``."""
        out, k = np.empty(len(texts)), 0
        while k < len(texts):
            words, counts, begin = [], [], k
            while k < len(texts) and (not counts or len(words) < GROUP_TOKENS):
                own = pieces(texts[k], self.model.vocabulary)
                words += own
                counts.append(len(own))
                k += 1
            out[begin:k] = self.worst(words, counts)
        return _sigmoid(out)

    def windows(self, words: list[str], starts: np.ndarray) -> np.ndarray:
        """Logits of the windows of one text."""
        self.learn(words)
        flat = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        at = starts + np.arange(WINDOW)[:, None]
        proj = self.table[flat[np.minimum(at, len(flat) - 1)]] if len(flat) else np.zeros((*at.shape, 6 * HIDDEN), np.float32)
        return self.model.logits(proj, (at < len(flat)).astype(np.float32))

    def worst(self, words: list[str], counts: list[int], windows_at_once: int = 2048) -> np.ndarray:
        self.learn(words)
        flat = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        starts = [window_starts(n) for n in counts]
        per = [len(s) for s in starts]
        ends = np.cumsum(counts)
        s = np.concatenate(starts) + np.repeat(ends - counts, per)
        e, doc = np.repeat(ends, per), np.repeat(np.arange(len(counts)), per)
        out = np.full(len(counts), -np.inf)
        for k in range(0, len(s), windows_at_once):
            at = s[k : k + windows_at_once] + np.arange(WINDOW)[:, None]
            mask = (at < e[k : k + windows_at_once]).astype(np.float32)
            proj = self.table[flat[np.minimum(at, len(flat) - 1)]] if len(flat) else np.zeros((*at.shape, 6 * HIDDEN), np.float32)
            np.maximum.at(out, doc[k : k + windows_at_once], self.model.logits(proj, mask))
        return out


_SCORERS: dict[bytes, Scorer] = {}


def scorer(blob: bytes) -> Scorer:
    """The worker's scorer for a pickled model; kept between tasks."""
    import hashlib
    import pickle

    one_table_at_a_time("toxicity", _SCORERS.clear)
    key = hashlib.sha256(blob).digest()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(pickle.loads(blob))
    return _SCORERS[key]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts get the score of an empty window; repeated rows a row each; null doc_ids stay
    null (and are held out of nothing); an empty table gives no rows; without labels of both kinds the
    network stays as it began.  Columns other than doc_id and text are not read.
    """
    import pickle

    blob = pickle.dumps(train(*training_sample(docs, labels)), protocol=5)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())

    def run(b):
        return {"doc_id": b.column(0), "score": scorer(blob).score(b.column(1).to_pylist())}

    got = map_batches(rows, run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, whose text scores below ``THRESHOLD``; no shuffle.

    Null texts score as empty ones and stay null; rows without a doc_id and repeated rows are judged like
    any other; an empty table gives no rows; other columns pass as they are, whatever their names.
    """
    import pickle

    from .common import ship

    ship(docs.sparkSession)
    blob = pickle.dumps(train(*training_sample(docs, labels)), protocol=5)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(scorer(blob).score(texts) < THRESHOLD))

    # Arrow functions name their input's columns unquoted
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
