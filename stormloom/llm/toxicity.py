"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding, if it is a frequent one, and as the mean embedding of its character n-grams. The
network scores windows of words; all overlapping windows of a text are scored, and the largest score is calibrated into
the document's. As a label covers a whole document, training takes the window of a toxic document that scores highest
at the time; of other documents, the highest-scoring windows of those that score highest, and any windows.
"""

from __future__ import annotations

import string
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_table, worker_state
from .tokens import slices

#: Words in a window, and from one window to the next.
WINDOW, STRIDE = 32, 16
#: Labelled documents of each class that training uses at most, drawn by a hash of their ids among those of at most
#: MAX_BYTES; two tenths of them calibrate.
TRAIN_ROWS = 2000
MAX_BYTES = 40_000
STEPS, BATCH = 360, 64
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 8, 12, 8, 8
MAX_WORDS, MIN_DOCS, CHAR_BUCKETS = 4096, 4, 8192
#: Lengths, in characters, of the starts and ends of a word that are its character inputs.
HEADS, TAILS = (3, 4, 5, 6, 7), (3, 4, 5)
#: Words whose inputs a worker remembers, and windows it scores at once.
REMEMBERED, BLOCK = 200_000, 2048
SEED = 11

Params = dict[str, np.ndarray]


def clean(word: str) -> str:
    return word.lower().strip(string.punctuation)


def gram_buckets(words: list[str]) -> np.ndarray:
    """The bucket of each word's starts and ends of each length in HEADS and TAILS, its bounds marked; 0 where it is
    shorter."""
    marked = [f"^{w}$" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    out = np.zeros((len(words), len(HEADS) + len(TAILS)), np.int64)
    for lengths, first, text in ((HEADS, 0, [w[: max(HEADS)].ljust(max(HEADS)) for w in marked]), (TAILS, len(HEADS), [w[: -max(TAILS) - 1 : -1].ljust(max(TAILS)) for w in marked])):
        points = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
        h = np.full(len(words), 2166136261 + first, np.uint32)
        for k in range(max(lengths)):
            h = (h ^ points[:, k]) * np.uint32(16777619)
            if k + 1 in lengths:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
                mixed ^= mixed >> np.uint32(13)
                out[:, first + lengths.index(k + 1)] = np.where(size > k, 1 + mixed % np.uint32(CHAR_BUCKETS - 1), 0)
    return out


def windows_of(n: int) -> np.ndarray:
    """The first word of each window over n words."""
    return np.arange(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_params(vocabulary: int, rng: np.random.Generator) -> Params:
    def draw(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    size = WORD_SIZE + CHAR_SIZE
    p = {"word": rng.normal(0, 0.05, (vocabulary + 1, WORD_SIZE)).astype(np.float32), "char": rng.normal(0, 0.1, (CHAR_BUCKETS, CHAR_SIZE)).astype(np.float32)}
    for d in "fb":
        p |= {f"W{d}": draw(size, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"A": draw(2 * HIDDEN, ATTENTION), "v": draw(ATTENTION), "o": draw(2 * HIDDEN), "b": np.zeros(1, np.float32)}


def inputs(p: Params, word_ids: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Input vector of each word. Bucket 0 stands for no n-gram and stays zero."""
    return np.hstack([p["word"][word_ids], 0.4 * p["char"][grams].sum(1)])


def forward(p: Params, pf: np.ndarray, pb: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. pf, pb: projected inputs (words, 3 * HIDDEN) of each direction, by (step, window); mask alike."""
    steps, n = mask.shape
    kind = p["o"].dtype
    states = np.zeros((steps, n, 2 * HIDDEN), kind)
    memo: dict[str, list] = {"f": [None] * steps, "b": [None] * steps}
    for d, x, order in (("f", pf, range(steps)), ("b", pb, range(steps - 1, -1, -1))):
        h, at = np.zeros((n, HIDDEN), kind), slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        for t in order:
            u = h @ p[f"U{d}"]
            gates = sigmoid(x[t][:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[t][:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = (c + z * (h - c)) * mask[t][:, None]
            if keep:
                memo[d][t] = (h, u, z, r, c)
            h = new
            states[t, :, at] = h
    a = np.tanh(states @ p["A"])
    e = np.where(mask > 0, a @ p["v"], -1e9).astype(kind)
    w = np.exp(e - e.max(0)) * (mask > 0)
    w /= np.maximum(w.sum(0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", w, states)
    logit = pooled @ p["o"] + p["b"]
    return (logit, (states, memo, a, w, pooled)) if keep else logit


def backward(p: Params, pf: np.ndarray, pb: np.ndarray, mask: np.ndarray, kept: tuple, d_logit: np.ndarray) -> tuple[Params, np.ndarray, np.ndarray]:
    """(gradients of all but the inputs' parameters, gradients of pf and pb) for a gradient of the logits."""
    states, memo, a, w, pooled = kept
    g = {"o": pooled.T @ d_logit, "b": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["o"]
    d_states = w[:, :, None] * d_pooled
    d_w = np.einsum("nh,tnh->tn", d_pooled, states)
    d_e = w * (d_w - (w * d_w).sum(0))
    g["v"] = np.einsum("tn,tna->a", d_e, a)
    d_a = d_e[:, :, None] * p["v"] * (1 - a * a)
    g["A"] = np.einsum("tnh,tna->ha", states, d_a)
    d_states = d_states + d_a @ p["A"].T
    out = []
    steps = len(mask)
    for d, x, order in (("f", pf, range(steps - 1, -1, -1)), ("b", pb, range(steps))):
        at = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        d_x, d_u_total, d_h = np.zeros_like(x), np.zeros_like(p[f"U{d}"]), np.zeros_like(memo[d][0][0])
        for t in order:
            h, u, z, r, c = memo[d][t]
            d_new = (d_h + d_states[t, :, at]) * mask[t][:, None]
            d_z = d_new * (h - c) * z * (1 - z)
            d_c = d_new * (1 - z) * (1 - c * c)
            d_r = d_c * u[:, 2 * HIDDEN :] * r * (1 - r)
            d_x[t] = np.hstack([d_z, d_r, d_c])
            d_u = np.hstack([d_z, d_r, d_c * r])
            d_u_total += h.T @ d_u
            d_h = d_new * z + d_u @ p[f"U{d}"].T
        g[f"U{d}"], g[f"c{d}"] = d_u_total, d_x.sum((0, 1))
        out.append(d_x)
    return g, out[0], out[1]


@dataclass
class Model:
    """What a worker needs to score texts. `constant` is the score of all texts if training had one class only."""

    params: Params
    vocabulary: dict[str, int]
    slope: float
    shift: float
    rate: float
    constant: bool = False


class Scorer:
    """Scores texts; remembers the projected inputs of words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1, 6 * HIDDEN), np.float32)  # row 0: no word
        self.used = 1

    def learn(self, words: list[str]) -> None:
        """Project words that aren't known yet."""
        p, known = self.model.params, self.model.vocabulary
        if not words:
            return
        cleaned = [clean(w) for w in words]
        x = inputs(p, np.array([known.get(w, 0) for w in cleaned]), gram_buckets(cleaned))
        new = np.hstack([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]])
        while self.used + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used : self.used + len(new)] = new
        self.ids.update(zip(words, range(self.used, self.used + len(words)), strict=True))
        self.used += len(new)

    def logits(self, texts: list[str]) -> list[np.ndarray]:
        """The logit of each window of each text; none for a text without words."""
        if self.used > REMEMBERED:
            self.forget()
        split = [t.split() for t in texts]
        self.learn(list({w for s in split for w in s} - self.ids.keys()))
        get = self.ids.__getitem__
        counts = [len(s) for s in split]
        flat = np.fromiter((get(w) for s in split for w in s), np.int64, sum(counts))
        base = np.cumsum(counts) - counts
        starts, ends, owner = [], [], []
        for i, (b, n) in enumerate(zip(base.tolist(), counts, strict=True)):
            if n:
                at = windows_of(n) + b
                starts.append(at)
                ends.append(np.full(len(at), b + n))
                owner.append(len(at))
            else:
                owner.append(0)
        if not starts:
            return [np.zeros(0, np.float32) for _ in texts]
        first, last = np.concatenate(starts), np.concatenate(ends)
        out = np.empty(len(first), np.float32)
        for k in range(0, len(first), BLOCK):
            places = first[k : k + BLOCK] + np.arange(WINDOW)[:, None]
            mask = places < last[k : k + BLOCK]
            ids = np.where(mask, flat[np.minimum(places, len(flat) - 1)], 0)
            x = [self.rows[ids[t]] for t in range(WINDOW)]
            out[k : k + BLOCK] = forward(self.model.params, [r[:, : 3 * HIDDEN] for r in x], [r[:, 3 * HIDDEN :] for r in x], mask.astype(np.float32))
        return np.split(out, np.cumsum(owner)[:-1])

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        if m.constant:
            return np.full(len(texts), m.rate)
        best = [x.max() if len(x) else np.nan for x in self.logits(texts)]
        z = np.clip(m.slope * np.array(best, np.float64) + m.shift, -60, 60)
        return np.where(np.isnan(z), m.rate, 1 / (1 + np.exp(-z)))


def evidence(items: list[np.ndarray], y: np.ndarray, n: int) -> np.ndarray:
    """For each of n items the log-odds that a document with it is of class 1, brought towards 0 by two standard errors.
    items: those of each document."""
    have = np.zeros((2, n))
    for x, c in zip(items, y, strict=True):
        have[c, np.unique(x)] += 1
    total = np.bincount(y, minlength=2)[:, None]
    p, q = (have + 0.5) / (total + 1), (total - have + 0.5) / (total + 1)
    odds = np.log(p[1] / q[1]) - np.log(p[0] / q[0])
    error = np.sqrt((1 / (have + 0.5)).sum(0) + (1 / (total - have + 0.5)).sum(0))
    return np.sign(odds) * np.maximum(np.abs(odds) - 2 * error, 0)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least weighted loss on a grid of slopes and midpoints."""
    values = np.unique(x)
    middles = np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 201))) if len(values) > 1 else values
    best = (np.inf, 1.0, 0.0)
    for slope in np.geomspace(0.1, 3, 20):
        z = slope * (x[None, :] - middles[:, None])
        loss = (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum(1)
        k = int(loss.argmin())
        if loss[k] < best[0] - 1e-9:
            best = (loss[k], float(slope), float(-slope * middles[k]))
    return best[1], best[2]


def train(texts: list[str], labels: list[int], rate: float, steps: int = STEPS, seed: int = SEED) -> Model:
    """Fit on labelled texts. rate: the share of toxic ones among all labelled rows, of which texts may be a sample
    with other shares. With one class only, or none, every score is the rate."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    same: dict[str, str] = {}  # one object for each word, however often it comes
    split = [[same.setdefault(c, c) for c in map(clean, t.split())] for t in texts]
    usable = np.array([bool(s) for s in split], bool)
    if not usable.any() or len(set(y[usable].tolist())) < 2:
        return Model({}, {}, 1.0, 0.0, rate, constant=True)
    seen = Counter(w for s in split for w in set(s))
    vocabulary = {w: i for i, (w, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:MAX_WORDS], 1) if n >= MIN_DOCS}
    every = sorted(seen)
    number = {w: i for i, w in enumerate(every, 1)}
    grams = gram_buckets(["", *every])
    word_of = np.array([0, *(vocabulary.get(w, 0) for w in every)])
    docs = [np.array([number[w] for w in s], np.int64) for s in split]
    del split, same
    for_fit = usable & ((np.arange(len(docs)) % 10 < 8) | (len(docs) < 100))
    for_scale = usable & (~for_fit | (len(docs) < 100))
    if len(set(y[for_fit].tolist())) < 2 or len(set(y[for_scale].tolist())) < 2:
        for_fit = for_scale = usable
    p = new_params(MAX_WORDS, rng)
    # the first place of each embedding starts at how surely documents that have the word or n-gram are toxic or not
    fit = np.flatnonzero(for_fit)
    words_in = [np.unique(docs[d]) for d in fit]
    p["word"][:, 0] = evidence([word_of[w] for w in words_in], y[fit], MAX_WORDS + 1)
    p["word"][0] = 0
    p["char"][:, 0] = evidence([grams[ws].reshape(-1) for ws in words_in], y[fit], CHAR_BUCKETS)
    p["char"][0] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    toxic, other = np.flatnonzero(for_fit & (y == 1)), np.flatnonzero(for_fit & (y == 0))
    n_windows = np.array([len(windows_of(len(d))) for d in docs])
    short = [c[np.argsort(n_windows[c], kind="stable")[: max(32, len(c) // 3)]] for c in (toxic, other)]
    best: dict[int, int] = {}
    hard = other

    def cut(d: int, k: int) -> np.ndarray:
        return docs[d][k * STRIDE : k * STRIDE + WINDOW]

    def project(ids: np.ndarray, drop: float = 0.0):
        """Inputs of the distinct words of ids, and their projections laid out like ids."""
        distinct, at = np.unique(ids, return_inverse=True)
        words = np.where(rng.random(len(distinct)) < drop, 0, word_of[distinct])
        x = inputs(p, words, grams[distinct])
        x[distinct == 0] = 0
        at = at.reshape(ids.shape)
        return distinct, words, x, at

    def batch_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.zeros((WINDOW, len(rows)), np.int64)
        for j, r in enumerate(rows):
            ids[: len(r), j] = r
        return ids, (ids > 0).astype(np.float32)

    def logits_of(rows: list[np.ndarray]) -> np.ndarray:
        out = []
        for k in range(0, len(rows), BLOCK):
            ids, mask = batch_of(rows[k : k + BLOCK])
            _, _, x, at = project(ids)
            out.append(forward(p, (x @ p["Wf"] + p["cf"])[at], (x @ p["Wb"] + p["cb"])[at], mask))
        return np.concatenate(out) if out else np.zeros(0)

    def choose() -> np.ndarray:
        """The window that scores highest in each document; returns the other documents, highest first."""
        pairs = [(int(d), k) for d in (*toxic, *other) for k in range(n_windows[d])]
        values = logits_of([cut(d, k) for d, k in pairs])
        top: dict[int, float] = {}
        for (d, k), v in zip(pairs, values.tolist(), strict=True):
            if v > top.get(d, -np.inf):
                top[d], best[d] = v, k
        return other[np.argsort([-top[int(d)] for d in other], kind="stable")]

    for step in range(1, steps + 1):
        warm = step <= steps // 4
        if not warm and (not best or (step - steps // 4) % max(1, steps // 6) == 1):
            hard = choose()
        half = BATCH // 2
        ones = rng.choice(short[0] if warm else toxic, half)
        zeros = rng.choice(short[1] if warm else other, half)
        rows = [cut(d, best[int(d)] if not warm else int(rng.integers(n_windows[d]))) for d in ones]
        if not warm:  # half of them where the network errs most
            zeros[: half // 2] = rng.choice(hard[: max(16, len(hard) // 20)], half // 2)
        rows += [cut(d, best[int(d)] if not warm and j < half // 2 else int(rng.integers(n_windows[d]))) for j, d in enumerate(zeros)]
        target = np.repeat(np.array([1, 0], np.float32), half)
        ids, mask = batch_of(rows)
        distinct, words, x, at = project(ids, drop=0.3)
        pf, pb = (x @ p["Wf"] + p["cf"])[at], (x @ p["Wb"] + p["cb"])[at]
        logit, kept = forward(p, pf, pb, mask, keep=True)
        g, d_f, d_b = backward(p, pf, pb, mask, kept, ((sigmoid(logit) - target) / len(rows)).astype(np.float32))
        flat = at.reshape(-1)
        d_x = np.zeros_like(x)
        for d, grad in (("f", d_f), ("b", d_b)):
            by_word = np.zeros((len(distinct), 3 * HIDDEN), np.float32)
            np.add.at(by_word, flat, grad.reshape(-1, 3 * HIDDEN))
            g[f"W{d}"] = x.T @ by_word
            d_x += by_word @ p[f"W{d}"].T
        d_x[distinct == 0] = 0
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], words, d_x[:, :WORD_SIZE])
        np.add.at(g["char"], grams[distinct].reshape(-1), np.repeat(0.4 * d_x[:, WORD_SIZE:], grams.shape[1], axis=0))
        g["char"][0] = 0
        rate_now = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in p.items():
            m1, m2 = moments[k]
            m1 *= 0.9
            m1 += 0.1 * g[k]
            m2 *= 0.99
            m2 += 0.01 * g[k] * g[k]
            v -= rate_now * (m1 / (1 - 0.9**step) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6) + (1e-3 * v if k not in ("word", "char") else 0))
    del moments
    model = Model(p, vocabulary, 1.0, 0.0, rate)
    scale = np.flatnonzero(for_scale)
    top = np.array([x.max() for x in Scorer(model).logits([texts[i] for i in scale])], np.float64)
    share = y[scale].mean()
    weight = np.where(y[scale] == 1, rate / share, (1 - rate) / (1 - share))
    model.slope, model.shift = calibrate(top, y[scale], weight)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[list[str], list[int], float]:
    """(texts, labels, share of toxic ones among all usable labels): at most `rows` of each class, drawn by a hash of
    the id among documents of at most MAX_BYTES. Labels of null ids or values are left out; of several labels of an id the largest holds."""
    known = labels.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & usable).groupBy(F.col(f"`{id_col}`").alias("id")).agg((F.max(f"`{label_col}`") > 0).cast("int").alias("y"))
    n, positive = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return [], [], 0.0
    order = F.xxhash64(F.lit(SEED), "id")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    fitting = docs.filter(F.octet_length(text) <= MAX_BYTES)
    there = known.join(fitting.select(F.col(f"`{id_col}`").alias("id")), "id", "left_semi")
    there = shared_table(there, "labelled")
    drawn = [there.filter(F.col("y") == c).orderBy(order, "id").limit(rows) for c in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * rows at most
    found = fitting.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).join(ids, "id")
    found = found.groupBy("id", "y").agg(F.min("text").alias("text")).orderBy(order, "id").collect()
    return [r["text"] for r in found], [r["y"] for r in found], positive / n


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, steps: int = STEPS) -> DataFrame:
    """docs with `score` (double, 0 to 1) and `predicted` (int, 1 if score >= 0.5).

    Trained on labels of docs for which `usable` (a condition on labels' columns) holds; the model, under 1 MB, is
    broadcast. A null text or one without words scores the share of toxic labels. A text of any length is scored over
    all its windows. Rows alike score alike. Input columns named like an output are replaced. Without labels of both
    classes every score is that share (0 without any). No rows in: no rows out.
    """
    spark = docs.sparkSession
    docs = docs.drop("score", "predicted")
    model = train(*labelled_sample(docs, labels, F.lit(True) if usable is None else usable, id_col, text_col, label_col, train_rows), steps=steps)
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("toxicity", name), lambda: Scorer(shared.value))
        for batch in batches:
            scores = [scorer.scores(texts) for _, texts in slices(batch.column(at))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
