"""The language model against a plain one: counts, base, probabilities that sum to 1, weights that fit deleted texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import interpolation as lm
from plumbline.llm.queries import op12_deleted_interpolation

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + [None]


class Plain:
    """Counts of all orders in dictionaries."""

    def __init__(self, texts):
        self.n = {k: Counter() for k in (1, 2, 3)}
        self.seen = {2: Counter(), 3: Counter()}
        for t in texts:
            row = ["<", "<", *tokens(t)]
            for i in range(2, len(row)):
                for k in (1, 2, 3):
                    self.n[k][tuple(row[i - k + 1 : i + 1])] += 1
                for k in (2, 3):
                    self.seen[k][tuple(row[i - k + 1 : i])] += 1
        self.tokens, self.distinct = sum(self.n[1].values()), len(self.n[1])

    def events(self, text):
        row = ["<", "<", *tokens(text)]
        for i in range(2, len(row)):
            g = [tuple(row[i - k + 1 : i + 1]) for k in (1, 2, 3)]
            yield self.n[3][g[2]], self.seen[3][g[2][:-1]], self.n[2][g[1]], self.seen[2][g[1][:-1]], self.n[1][g[0]]

    def log10(self, text, w):
        out = 0.0
        for k3, c3, k2, c2, k1 in self.events(text):
            p = w.one * k1 / max(self.tokens, 1) + (1 - w.one) / (self.distinct + 1)
            for share, k, c in ((w.two, k2, c2), (w.three, k3, c3)):
                s = share[c.bit_length()] if c else 0.0
                p = s * k / max(c, 1) + (1 - s) * p
            out += math.log10(p)
        return out


def plain_weights(model, deleted, rounds):
    """The same rounds over single events in Python."""
    events = [e for t in deleted for e in model.events(t)]
    w = lm.Weights(lm._filled({}), lm._filled({}), 0.5)
    for _ in range(rounds):
        sums = {3: {}, 2: {}, 1: {0: [0.0, 1.0]}}
        for k3, c3, k2, c2, k1 in events:
            s3, s2 = w.three[c3.bit_length()] * (c3 > 0), w.two[c2.bit_length()] * (c2 > 0)
            e3, e2, e1 = k3 / max(c3, 1), k2 / max(c2, 1), k1 / max(model.tokens, 1)
            p1 = w.one * e1 + (1 - w.one) / (model.distinct + 1)
            p2 = s2 * e2 + (1 - s2) * p1
            p3 = s3 * e3 + (1 - s3) * p2
            r3, r2, r1 = s3 * e3 / p3, s2 * e2 / p2, w.one * e1 / p1
            for order, b, mass, r in ((3, c3.bit_length(), 1.0, r3), (2, c2.bit_length(), 1 - r3, r2), (1, 0, (1 - r3) * (1 - r2), r1)):
                if order == 1 or b:
                    held = sums[order].setdefault(b, [0.0, 1.0])
                    held[0] += mass * r
                    held[1] += mass * (1 - r)
        share = {k: {b: a / (a + z) for b, (a, z) in v.items()} for k, v in sums.items()}
        w = lm.Weights(lm._filled(share[3]), lm._filled(share[2]), share[1][0])
    return w


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    return docs, {r["doc_id"]: r for r in op12_deleted_interpolation(spark, sf_dir).collect()}


def test_counts_and_base(found):
    docs, got = found
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    c = Counter(t for d, text in docs.items() if not out[d] for t in tokens(text))
    n, v = sum(c.values()), len(c)
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        own = tokens(text)
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[d], len(own), sum(c[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)


def test_held_out_texts_are_likelier_than_by_the_base(found):
    _, got = found
    held = [r for r in got.values() if r["held_out"]]
    total = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert total("score") > total("base_score") + 0.3


def test_weights_and_scores_as_by_hand(spark):
    rnd = np.random.default_rng(5)
    some = ["the", "cat", "dog", "sat", "ran", "on", "mat", "A", "b"]
    rows = [(i, " ".join(rnd.choice(some, int(rnd.integers(0, 12))))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = df.withColumn("fold", F.pmod(F.xxhash64("doc_id", "text"), F.lit(4)) == 0).collect()
    learn = lambda i: i % 5 != 0
    kept = Plain([r["text"] for r in marked if learn(r["doc_id"]) and not r["fold"]])
    deleted = [r["text"] for r in marked if learn(r["doc_id"]) and r["fold"]]
    full = Plain([t for i, t in rows if learn(i)])
    got = {r["doc_id"]: r for r in lm.score(df, F.col("doc_id") % 5 != 0, deleted=4).collect()}
    names = [n for n, _ in lm._EVENTS]
    events = [(c3.bit_length(), c2.bit_length(), k3, c3, k2, c2, k1, 1) for t in deleted for k3, c3, k2, c2, k1 in kept.events(t)]
    corpus = lm.Corpus(kept.distinct, kept.tokens, 0)
    frame = spark.createDataFrame(events, ", ".join(f"{n} {t}" for n, t in lm._EVENTS))
    w = lm.learned(frame.select(*names), corpus)
    assert len(deleted) > 5 and w.one == pytest.approx(lm.learned(frame.groupBy(*names[:-1]).agg(F.sum("h").alias("h")), corpus).one)
    few = lm.learned(frame, corpus, rounds=3, gain=-1.0)
    hand = plain_weights(kept, deleted, 3)
    assert few.one == pytest.approx(hand.one) and few.three == pytest.approx(hand.three) and few.two == pytest.approx(hand.two)
    for i, text in rows:
        assert got[i]["score"] == pytest.approx(full.log10(text, w), rel=1e-6), text
    assert sum(kept.log10(t, w) for t in deleted) > sum(kept.log10(t, lm.Weights(lm._filled({}), lm._filled({}), 0.5)) for t in deleted)


def test_probabilities_of_all_tokens_sum_to_one(spark):
    full = Plain(["a b c", "a b d", "b"])
    w = lm.Weights(lm._filled({1: 0.6, 2: 0.8}), lm._filled({1: 0.3}), 0.9)
    kinds = [*full.n[1], ("new",)]
    for u, v in (("a", "b"), ("<", "<"), ("x", "b"), ("x", "y")):
        counts = [np.array([full.n[3][(u, v, *t)] for t in kinds]), np.full(len(kinds), full.seen[3][(u, v)]), np.array([full.n[2][(v, *t)] for t in kinds]), np.full(len(kinds), full.seen[2][(v,)]), np.array([full.n[1][t] for t in kinds])]
        assert w.probability(tuple(counts), lm.Corpus(full.distinct, full.tokens, 3)).sum() == pytest.approx(1.0)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 700}" for i in range(50_000))
    rows = [(None, "a b c"), (None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "É é Ab"), (4, "É é Ab"), (5, long), (9, "new words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("key", "learn", "fold", "block", "score")})
    got = lm.score(df, F.col("doc_id") != 9).collect()
    learnt = [t for i, t in rows if i not in (None, 9)]  # a null condition: not learned from
    c = Counter(t for x in learnt for t in tokens(x))
    n, v = sum(c.values()), len(c)
    assert sorted(r["n_tokens"] for r in got) == sorted(len(tokens(t)) for _, t in rows) and all(r["train_tokens"] == n for r in got)
    want = sorted(round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 6) for _, x in rows)
    assert sorted(round(r["base_score"], 6) for r in got) == want and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    none = lm.score(df, F.lit(False)).collect()
    assert all((r["score"], r["base_score"], r["train_tokens"], r["n_known"]) == (0, 0, 0, 0) for r in none) and len(none) == len(rows)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0
