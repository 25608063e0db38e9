"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is a hashed word vector beside the mean of its hashed character 3- and 4-grams (with ends marked). A
text is read in windows of WINDOW words that overlap by half; each goes through a GRU in both directions, attention
pools the states, a logistic unit scores the window, and the text's score is that of its worst window.

Training: labels.toxic of rows whose crc32(doc_id) mod 5 is not 0, at most SAMPLE rows of each class with at most
SAMPLE_CHARS characters, in the order of md5(doc_id). A label holds for a text, not for a window, so each epoch takes
the window that the net (at first: the log odds of the n-grams) scores highest in each toxic text, and that one with
some others in each clean text. The last step shifts the bias so that 0.5 separates the training texts best.

Scale: only the bounded sample reaches the driver, and the net (some hundred kB) goes to the tasks; scoring is one
pass without a shuffle, each task holding one batch cut by bytes and windows in pieces.

Cases: null and empty texts have one window without words, whose score is that of the bias; null doc_id gives held_out
false; repeated rows score equally; without labels of both classes every score is the share of toxic labels, halved;
columns beyond doc_id and text are no inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.common import WORD, materialize, slices

WINDOW, STEP = 32, 16
WORD_BUCKETS, GRAM_BUCKETS = 1 << 13, 1 << 15
WORD_DIM, GRAM_DIM, HIDDEN = 6, 12, 8
SAMPLE, SAMPLE_CHARS, EPOCHS = 1500, 2000, 7
PIECE = 8192
_STRIP = ".,:;!?|$#%&*\"'()[]<>-_"


def held_out(doc_id: object) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


class Words:
    """Inputs of distinct words: word bucket, and n-gram buckets laid end to end with their bounds."""

    def __init__(self, words: list[str]):
        clean = [w.strip(_STRIP) or w for w in words]
        data = [f"\x02{w}\x03".encode("utf-8", "replace") for w in clean]
        self.word = np.fromiter((zlib.crc32(d) for d in data), np.int64, len(data)) % WORD_BUCKETS
        flat = np.frombuffer(b"".join(data) + b"\0\0\0", "u1").astype(np.uint32)
        n = np.fromiter(map(len, data), np.int64, len(data))
        end = np.cumsum(n)
        # at each byte a 3-gram and a 4-gram begin; those that leave the word are dropped
        left = np.repeat(end, n) - np.arange(len(flat) - 3)
        g3 = (flat[:-3] * 961 + flat[1:-2] * 31 + flat[2:-1]) * np.uint32(2654435761)
        g4 = ((flat[:-3] * 29791 + flat[1:-2] * 961 + flat[2:-1] * 31 + flat[3:]) ^ np.uint32(0x5BD1E995)) * np.uint32(2654435761)
        both = np.stack([g3, g4], 1) >> np.uint32(32 - GRAM_BUCKETS.bit_length() + 1)
        ok = np.stack([left >= 3, left >= 4], 1)
        self.grams = both[ok].astype(np.int64)
        count = np.maximum(n - 2, 0) + np.maximum(n - 3, 0)
        self.bounds = np.concatenate([[0], np.cumsum(count)])

    def mean(self, table: np.ndarray) -> np.ndarray:
        got = np.add.reduceat(table[self.grams], np.minimum(self.bounds[:-1], max(0, len(self.grams) - 1)), 0) if len(self.grams) else np.zeros((len(self.word), table.shape[1]), "f4")
        n = np.diff(self.bounds)[:, None]
        return np.where(n > 0, got / np.maximum(n, 1), 0).astype("f4")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Net:
    """Parameters by name; forward for windows given as rows of distinct-word numbers (-1: no word), backward for training."""

    def __init__(self, seed: int = 7):
        r, d, h = np.random.default_rng(seed), WORD_DIM + GRAM_DIM, HIDDEN
        g = lambda *s, k=0.3: r.normal(0, k, s).astype("f4")
        self.p = {"word": g(WORD_BUCKETS, WORD_DIM, k=0.05), "gram": g(GRAM_BUCKETS, GRAM_DIM, k=0.05), "att": g(2 * h), "out": g(2 * h), "bias": np.zeros(1, "f4")}
        for side in "lr":
            self.p |= {f"{side}x": g(d, 3 * h), f"{side}h": g(h, 3 * h), f"{side}b": np.zeros(3 * h, "f4")}

    def inputs(self, words: Words) -> np.ndarray:
        return np.concatenate([self.p["word"][words.word], words.mean(self.p["gram"])], 1)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input side of the gates of both directions, with a last row for no word."""
        return tuple(np.concatenate([x @ self.p[f"{s}x"] + self.p[f"{s}b"], np.zeros((1, 3 * HIDDEN), "f4")]) for s in "lr")

    def run(self, gates: np.ndarray, rows: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """(windows, steps, HIDDEN) states; places without a word pass the state on."""
        n, t, k, u = *rows.shape, HIDDEN, self.p[f"{side}h"]
        out, h = np.empty((n, t, k), "f4"), np.zeros((n, k), "f4")
        for j in range(t) if side == "l" else range(t - 1, -1, -1):
            a, b = gates[rows[:, j]], h @ u
            zr = sigmoid(a[:, : 2 * k] + b[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(a[:, 2 * k :] + r * b[:, 2 * k :])
            live = (rows[:, j] >= 0)[:, None]
            new = np.where(live, h + z * (c - h), h)
            if keep is not None:
                keep.append((j, h, z, r, c, b[:, 2 * k :], live))
            out[:, j] = h = new
        return out

    def forward(self, gates: tuple[np.ndarray, np.ndarray], rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of the windows."""
        k = {"l": [], "r": []} if keep is not None else {"l": None, "r": None}
        s = np.concatenate([self.run(gates[i], rows, side, k[side]) for i, side in enumerate("lr")], 2)
        e = np.where(rows >= 0, s @ self.p["att"], np.float32(-30))
        e = np.exp(e - e.max(1, keepdims=True))
        w = e / e.sum(1, keepdims=True)
        pooled = np.einsum("ntk,nt->nk", s, w)
        if keep is not None:
            keep |= {"steps": k, "s": s, "w": w, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"]

    def gradients(self, words: Words, rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of windows, labels y in 0..1."""
        p, k, x = self.p, HIDDEN, self.inputs(words)
        keep: dict = {}
        gates = self.project(x)
        d = ((sigmoid(self.forward(gates, rows, keep)) - y) / len(y)).astype("f4")
        s, w = keep["s"], keep["w"]
        g = {"out": keep["pooled"].T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * p["out"]
        dw = np.einsum("ntk,nk->nt", s, dp)
        de = np.where(rows >= 0, w * (dw - (w * dw).sum(1, keepdims=True)), 0)
        g["att"] = np.einsum("ntk,nt->k", s, de)
        ds = w[..., None] * dp[:, None] + de[..., None] * p["att"]
        dx = np.zeros_like(x)
        for i, side in enumerate("lr"):
            u, dg = p[f"{side}h"], np.zeros_like(gates[i])
            gu, dh = np.zeros_like(u), np.zeros((len(rows), k), "f4")
            for j, h, z, r, c, bc, live in reversed(keep["steps"][side]):
                dh = dh + ds[:, j, i * k : (i + 1) * k]
                dn = np.where(live, dh, 0)
                dc = dn * z * (1 - c * c)
                dz = dn * (c - h) * z * (1 - z)
                dr = dc * bc * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                db = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(dg, rows[:, j], da)
                gu += h.T @ db
                dh = np.where(live, dn * (1 - z), dh) + db @ u.T
            dg = dg[:-1]
            g |= {f"{side}h": gu, f"{side}b": dg.sum(0), f"{side}x": x.T @ dg}
            dx += dg @ p[f"{side}x"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], words.word, dx[:, :WORD_DIM])
        n = np.diff(words.bounds)
        g["gram"] = np.zeros_like(p["gram"])
        np.add.at(g["gram"], words.grams, np.repeat(dx[:, WORD_DIM:] / np.maximum(n, 1)[:, None], n, 0))
        return g

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
        """Logits of all windows, the windows' bounds by text, their rows, the distinct words."""
        names, rows, bounds = windows(texts)
        words = Words(names)
        gates = self.project(self.inputs(words))
        got = [self.forward(gates, rows[a : a + PIECE]) for a in range(0, len(rows), PIECE)]
        return np.concatenate(got) if got else np.zeros(0, "f4"), bounds, rows, words

    def scores(self, texts: list[str]) -> np.ndarray:
        z, bounds, _, _ = self.logits(texts)
        return sigmoid(np.maximum.reduceat(z, bounds[:-1]).astype("f8")) if len(texts) else np.zeros(0)


def windows(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words; (windows, WINDOW) word numbers, -1 beyond a text; where each text's windows begin, with the end."""
    find, number, seqs = re.compile(WORD).findall, {}, []
    for text in texts:
        words = find(text.lower())
        for w in words:
            if w not in number:
                number[w] = len(number)
        seqs.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    n = np.array([len(s) for s in seqs], np.int64)
    count = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
    bounds = np.concatenate([[0], np.cumsum(count)])
    begin = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate([*seqs, np.zeros(1, np.int64)])
    text = np.repeat(np.arange(len(seqs)), count)
    at = ((np.arange(int(bounds[-1])) - bounds[text]) * STEP)[:, None] + np.arange(WINDOW)
    inside = at < n[text][:, None]
    rows = np.where(inside, flat[np.minimum(at + begin[text][:, None], len(flat) - 1)], -1)
    return [*number], rows, bounds


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Net:
    """The net for labelled texts; the same texts in the same order give the same net."""
    net, y = Net(seed), np.array(labels)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) / 2 if len(y) else 0.0
        net.p["out"][:] = 0
        net.p["bias"][:] = np.log((share + 1e-4) / (1 - share + 1e-4))
        return net
    none = 1 + len(texts) // 50  # texts without words are clean
    texts, y = [*texts, *[""] * none], np.concatenate([y, np.zeros(none, y.dtype)])
    r = np.random.default_rng(seed)
    names, rows, bounds = windows(texts)
    words, text = Words(names), np.repeat(np.arange(len(texts)), np.diff(bounds))
    # log odds that a text with a feature is toxic, for buckets with three toxic texts or more
    for key, owner, bucket, size in (("word", np.arange(len(names)), words.word, WORD_BUCKETS), ("gram", np.repeat(np.arange(len(names)), np.diff(words.bounds)), words.grams, GRAM_BUCKETS)):
        of_word = [np.zeros(0, np.int64)] * len(names)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for part in np.split(np.arange(len(owner)), cuts):
            if len(part):
                of_word[owner[part[0]]] = bucket[part]
        pos, neg = np.zeros(size), np.zeros(size)
        for i in range(len(texts)):
            used = np.unique(rows[bounds[i] : bounds[i + 1]])
            used = used[used >= 0]
            b = np.unique(np.concatenate([of_word[w] for w in used])) if len(used) else np.zeros(0, np.int64)
            (pos if y[i] else neg)[b] += 1
        odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
        net.p[key][:, 0] = np.where(pos >= 3, np.clip(odds, 0, 6), 0) / 3
    first = words.mean(net.p["gram"])[:, 0] + net.p["word"][words.word, 0]
    guess = np.where(rows >= 0, np.append(first, 0)[rows], -1e3).max(1)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            gates = net.project(net.inputs(words))
            guess = np.concatenate([net.forward(gates, rows[a : a + PIECE]) for a in range(0, len(rows), PIECE)])
        worst = np.array([bounds[i] + int(guess[bounds[i] : bounds[i + 1]].argmax()) for i in range(len(texts))])
        other = r.integers(0, len(rows), len(texts))
        picked = np.concatenate([worst, other[y[text[other]] == 0]])
        target = np.concatenate([y, np.zeros(len(picked) - len(y), int)])
        order = r.permutation(len(picked))
        for a in range(0, len(order), 96):
            part = order[a : a + 96]
            used, inverse = np.unique(rows[picked[part]], return_inverse=True)
            shift = int(used[0] == -1)
            local = inverse.reshape(len(part), WINDOW) - shift
            g = net.gradients(Words([names[w] for w in used[shift:]]), local, target[part].astype("f4"))
            step += 1
            for k, x in net.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                x -= (0.012 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype("f4")
    z, bounds, _, _ = net.logits(texts)
    top = np.maximum.reduceat(z, bounds[:-1])
    order = np.argsort(top)
    wrong = np.concatenate([[(1 - y).sum()], (1 - y).sum() + np.cumsum(np.where(y[order] == 0, -1, 1))])
    best = np.flatnonzero(wrong == wrong.min())
    best = int(best[len(best) // 2])  # texts below this rank are clean
    low, high = top[order[max(0, best - 1)]], top[order[min(len(order) - 1, best)]]
    net.p["bias"] -= np.float32((low + high) / 2)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """At most `sample` texts of each class, none of them held out, in the order of md5(doc_id)."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known.withColumn("h", F.md5(F.col("doc_id").cast("string"))))
    short = docs.where(F.length("text") <= chars).select("doc_id", F.col("text").cast("string").alias("text"))
    got = []
    for c in (0, 1):
        mine = known.where(F.col("toxic") == c)
        n = mine.count()
        # the first of the order lie below a digest that some times the sample lies below, so tasks send few rows
        for part in (8 * sample / n if n > 8 * sample else 1.0, 1.0):
            rows = mine if part >= 1 else mine.where(F.col("h") < f"{int(part * 16**8):08x}")
            first = rows.join(short, "doc_id").orderBy("h", "text").select("h", "text", "toxic").limit(sample).collect()
            if len(first) == sample or part >= 1:
                got += first
                break
    got.sort(key=lambda r: (r["h"], r["text"]))
    return [r["text"] for r in got], [r["toxic"] for r in got]


def score(docs: DataFrame, net: Net) -> DataFrame:
    """docs with score (double) and predicted (int); columns of these names are replaced."""
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = net.scores([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("i4"))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def scored(docs: DataFrame, labels: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """docs with held_out, score and predicted, by a net fitted to the labels of `texts` (default: docs)."""
    found = score(docs, fit(*training_rows(docs if texts is None else texts, labels)))
    return found.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
