from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormloom.llm import queries, toxicity, urls

RULES = queries.URL_RULES


def brute_rule(url: str | None) -> tuple[str, str, str | None, str | None]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if not m else (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2])
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_rules(spark):
    samples = [None, "", "no scheme", "http://A.Com/x", "http://com", "http://com/", "https://www.EXAMPLE.com/en/1", "https://m.www.example.com/en/", "https://example.com/en/a?b#c", "https://xexample.com/en/", "http://a.net/es/1", "http://a.net/es", "http://net/fr/?q", "x://y://z/", "http://a.com?x=://b/", "http://a.net#/es/", "http://\n.com/"]
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame([(u, "x") for u in samples], "url string, host string"), RULES).collect()}
    for u in samples:
        want = brute_rule(u)
        assert got[u][:3] == want[:3], u
        assert got[u][3] == (want[3] or got[u][3])


def brute_score(counted: list[list[bytes]], url: bytes) -> float:
    """The same mixture from exact counts."""
    def logs(known: list[bytes]) -> float:
        total = 0.0
        for i in range(len(url)):
            padded, p = b"\0" * urls.ORDER + url, 1 / 256
            for k in range(urls.ORDER + 1):
                ctx, nxt = padded[i + urls.ORDER - k : i + urls.ORDER], url[i : i + 1]
                n = b = 0
                for u in known:
                    w = b"\0" * urls.ORDER + u
                    for j in range(urls.ORDER, len(w)):
                        if w[j - k : j] == ctx:
                            n += 1
                            b += w[j : j + 1] == nxt
                p = (b + urls.PRIOR * p) / (n + urls.PRIOR)
            total += np.log(p)
        return total

    return (logs(counted[0]) - logs(counted[1])) / max(len(url), 1)


@pytest.mark.parametrize("frequent", [urls.FREQUENT, 40, 0])
def test_scores_are_those_of_exact_counts(spark, frequent):
    """Over all contexts, whether their values are broadcast or joined."""
    rng = random.Random(3)
    rows = [*(f"http://a.com/en/{rng.randrange(99)}" for _ in range(25)), *(f"http://b{rng.randrange(9)}.net/es/{'x' * rng.randrange(5)}" for _ in range(25))]
    rows += ["http://z.org/en/1", "http://z.org/en/1", "http://b.org/" + "es/" * 400, "", None, "é漢", "http://a.com/en/1"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    calibrates = {r.url for r in pages.filter(F.pmod(F.xxhash64(F.lit(urls.SEED), "url"), F.lit(urls.CALIBRATE_1_IN)) == 0).collect()}
    known: list[list[bytes]] = [[], []]
    for u in rows:
        if (v := brute_rule(u)[3]) and u not in calibrates:
            known[v == "block"].append(u.encode())
    assert all(known) and calibrates
    got = {r.page_id: r.score for r in urls.filter_urls(pages, RULES, frequent=frequent).collect()}
    want = {u: brute_score(known, (u or "").encode()) for u in set(rows)}
    assert len(got) == len(rows) and np.allclose([got[i] for i in range(len(rows))], [want[u] for u in rows], atol=1e-9)


def test_verdicts_generalise(spark):
    rng = random.Random(0)
    good, bad = [f"https://g{rng.randrange(99)}.com/news/{rng.randrange(999)}" for _ in range(300)], [f"https://g{rng.randrange(99)}.net/es/buy-{rng.randrange(999)}" for _ in range(300)]
    asked = ["https://g1.org/news/5", "https://g2.org/es/buy-7"]
    rows = [(i, u) for i, u in enumerate([*good, *bad, *asked, None])]
    got = {r.url: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert [got[u] for u in asked] == ["allow", "block"]


def test_no_labels_or_rows(spark):
    one = spark.createDataFrame([(1, "https://a.org/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in urls.filter_urls(one, RULES).collect()] == ["allow", "allow"]
    assert urls.filter_urls(one.limit(0), RULES).count() == 0


def test_threshold():
    h = np.zeros((2, urls.BINS), np.int64)
    h[0, 3000], h[1, 1000] = 5, 50
    assert -urls.SPAN + 2 * urls.SPAN * 1000 / urls.BINS < urls.best_threshold(h) < -urls.SPAN + 2 * urls.SPAN * 3000 / urls.BINS


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_params(3, rng).items()}
    x = rng.normal(size=(2, 5, 3, 3 * toxicity.HIDDEN))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], np.float64)
    logit, kept = toxicity.forward(p, x[0], x[1], mask, keep=True)
    out = rng.normal(size=3)
    grads, d_f, d_b = toxicity.backward(p, x[0], x[1], mask, kept, out)
    value = lambda: float(toxicity.forward(p, x[0], x[1], mask) @ out)
    targets = [(p[k], grads[k]) for k in ("A", "v", "o", "b", "Uf", "Ub")] + [(x[0], d_f), (x[1], d_b)]
    for array, grad in targets:
        for i in rng.integers(array.size, size=6):
            at = np.unravel_index(i, array.shape)
            old = array[at]
            array[at] = old + 1e-6
            up = value()
            array[at] = old - 1e-6
            assert abs((up - value()) / 2e-6 - grad[at]) < 1e-5
            array[at] = old


def test_forward_by_the_formulas():
    """The network written out for one window at a time, in plain loops."""
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_params(3, rng).items()}
    x = rng.normal(size=(2, 6, 4, 3 * toxicity.HIDDEN))
    lengths = [6, 4, 1, 3]
    mask = np.array([[float(t < n) for n in lengths] for t in range(6)])
    h = toxicity.HIDDEN

    def sig(v: float) -> float:
        return 1 / (1 + np.exp(-v))

    want = []
    for j, n in enumerate(lengths):
        states = [[0.0] * (2 * h) for _ in range(n)]
        for k, d in enumerate("fb"):
            state = [0.0] * h
            for t in range(n) if d == "f" else reversed(range(n)):
                u = [sum(state[a] * p[f"U{d}"][a, b] for a in range(h)) for b in range(3 * h)]
                z = [sig(x[k, t, j, a] + u[a]) for a in range(h)]
                r = [sig(x[k, t, j, h + a] + u[h + a]) for a in range(h)]
                c = [np.tanh(x[k, t, j, 2 * h + a] + r[a] * u[2 * h + a]) for a in range(h)]
                state = [(1 - z[a]) * c[a] + z[a] * state[a] for a in range(h)]
                states[t][k * h : (k + 1) * h] = state
        energy = [sum(np.tanh(sum(s[a] * p["A"][a, b] for a in range(2 * h))) * p["v"][b] for b in range(toxicity.ATTENTION)) for s in states]
        weight = [np.exp(e) / sum(np.exp(o) for o in energy) for e in energy]
        want.append(sum(w * sum(s[a] * p["o"][a] for a in range(2 * h)) for w, s in zip(weight, states, strict=True)) + p["b"][0])
    assert np.allclose(toxicity.forward(p, x[0], x[1], mask), want)


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 55, 56, 57, 1000):
        starts = toxicity.windows_of(n)
        assert {w for s in starts for w in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def labelled(n: int, seed: int) -> tuple[list[str], list[int]]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts, y = [], []
    for _ in range(n):
        row = [rng.choice(words) for _ in range(rng.randrange(5, 150))]
        y.append(int(rng.random() < 0.2))
        for _ in range(rng.randrange(1, 4) * y[-1]):
            row.insert(rng.randrange(len(row)), rng.choice(["idiot", "scum", "blarg" + rng.choice(words)]))
        texts.append(" ".join(row))
    return texts, y


def test_held_out_accuracy():
    model = toxicity.train(*labelled(700, 1), 0.2, steps=200)
    texts, y = labelled(300, 1)[0][:0], []
    more, more_y = labelled(1000, 1)
    texts, y = more[700:], np.array(more_y[700:])
    score = toxicity.Scorer(model).scores(texts)
    assert ((score >= 0.5) == y).mean() > 0.96
    mixed = toxicity.Scorer(model).scores([*texts[:5], "", " \n"])
    assert np.allclose(mixed[:5], score[:5], atol=1e-5) and mixed[5] == mixed[6] == 0.2


def test_score_toxicity(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs.withColumn("score", F.lit("clash")), labels, steps=10).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.score_toxicity(no_docs, labels, steps=10).count() == 0
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.score_toxicity(docs, few, steps=10).collect()} == {0.0}
    assert {r.score for r in toxicity.score_toxicity(docs, labels.filter("toxic = 1"), steps=10).collect()} == {1.0}
