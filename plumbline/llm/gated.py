"""Toxicity of texts: a bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, byte_view, mix64, ragged
from .shingles import word_hashes, words

_BLOCK = 2 << 20
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), ord("'"), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_GRAM = np.random.default_rng(31).integers(0, 2**64, (5, 257), np.uint64)


@dataclass
class Shape:
    """Sizes of the network and its windows. Windows of ``window`` words start every ``stride`` words, so they overlap."""

    window: int = 32
    stride: int = 24
    word_rows: int = 1 << 14
    gram_rows: int = 1 << 15
    width: int = 12  # of word and of character vectors
    hidden: int = 12
    seed: int = 5


@dataclass
class Tokens:
    """Distinct words of some texts, and their windows as rows of word numbers (-1: no word)."""

    word: np.ndarray  # word row of each distinct word
    gram: np.ndarray  # character rows, one after another
    grams: np.ndarray  # how many of them each distinct word has
    windows: np.ndarray
    owner: np.ndarray  # text of each window
    found: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # words of each text


def _gram_rows(raw: np.ndarray, own: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """Two character rows for each byte of words: of three bytes around it, and of five. Bytes outside the word are 256."""
    i = ragged(own, sizes)
    before = ragged(np.zeros(len(sizes), np.int64), sizes)
    after = np.repeat(sizes, sizes) - 1 - before
    near = {0: _LOWER[raw[i]]}
    for k in (1, 2):
        near[-k] = np.where(before >= k, _LOWER[raw[i - k]], 256)
        near[k] = np.where(after >= k, _LOWER[raw[np.minimum(i + k, len(raw) - 1)]], 256)
    three = sum((_GRAM[k + 2][near[k]] for k in (-1, 0, 1)), np.zeros(len(i), np.uint64))
    five = three + _GRAM[0][near[-2]] + _GRAM[4][near[2]] + np.uint64(1)
    return (mix64(np.stack([three, five], axis=1).ravel()) % np.uint64(rows)).astype(np.int32)


def tokens_of(raw: np.ndarray, offsets: np.ndarray, shape: Shape) -> Tokens:
    starts, ends, at = words(raw, offsets, _LETTERS)
    h = word_hashes(raw, starts, ends)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    own, sizes = starts[first], (ends - starts)[first]
    gram = [np.zeros(0, np.int32)]
    for k in range(0, len(own), 1 << 15):
        gram.append(_gram_rows(raw, own[k : k + (1 << 15)], sizes[k : k + (1 << 15)], shape.gram_rows))
    gram, sizes = np.concatenate(gram), 2 * sizes
    counts = np.diff(at)
    n = np.where(counts > shape.window, 1 + -(-(counts - shape.window) // shape.stride), (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), n)
    begin = at[:-1][owner] + ragged(np.zeros(len(n), np.int64), n) * shape.stride
    place = begin[:, None] + np.arange(shape.window)
    inside = place < at[1:][owner][:, None]
    windows = np.where(inside, number[np.minimum(place, max(0, len(number) - 1))] if len(number) else -1, -1).astype(np.int32)
    word = (mix64(h[first]) >> np.uint64(20)) % np.uint64(shape.word_rows)
    return Tokens(word.astype(np.int32), gram, sizes, windows, owner, counts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _gathered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values by row, of n rows; negative rows are left out."""
    o = np.argsort(rows, kind="stable")
    o = o[np.searchsorted(rows[o], 0) :]
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(o):
        own = rows[o]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] = np.add.reduceat(values[o], first, axis=0)
    return out


class Network:
    """Word and character vectors, gated units in both directions, attention, one logit."""

    def __init__(self, shape: Shape) -> None:
        self.shape = shape
        rnd = np.random.default_rng(shape.seed)
        d, h = 2 * shape.width, shape.hidden

        def draw(*size: int, scale: float) -> np.ndarray:
            return (rnd.standard_normal(size) * scale).astype(np.float32)

        self.p = {"word": draw(shape.word_rows, shape.width, scale=0.02), "gram": draw(shape.gram_rows, shape.width, scale=0.02)}
        for way in "fb":
            self.p |= {f"W{way}": draw(d, 3 * h, scale=d**-0.5), f"U{way}": draw(h, 3 * h, scale=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": draw(2 * h, h, scale=(2 * h) ** -0.5), "a": np.zeros(h, np.float32), "v": draw(h, scale=h**-0.5), "w": draw(2 * h, scale=(2 * h) ** -0.5), "b": np.zeros(1, np.float32)}
        self.prior = 0.5

    def vectors(self, t: Tokens) -> np.ndarray:
        """Inputs of the distinct words: word vector, and sum of character vectors over the root of their number."""
        if not len(t.word):
            return np.zeros((0, 2 * self.shape.width), np.float32)
        out = np.empty((len(t.word), 2 * self.shape.width), np.float32)
        out[:, : self.shape.width] = self.p["word"][t.word]
        starts = np.cumsum(t.grams) - t.grams
        for i in range(0, len(t.word), 8192):  # a part of the words at a time: their characters' vectors are many
            j = min(i + 8192, len(t.word))
            rows = t.gram[starts[i] : starts[j - 1] + t.grams[j - 1]]
            total = np.add.reduceat(self.p["gram"][rows], starts[i:j] - starts[i], axis=0)
            out[i:j, self.shape.width :] = total / np.sqrt(t.grams[i:j, None], dtype=np.float32)
        return out

    def _direction(self, way: str, inputs: np.ndarray, index: np.ndarray, keep: list | None) -> np.ndarray:
        h3, h = self.p[f"U{way}"].shape[1], self.shape.hidden
        table = np.vstack([inputs @ self.p[f"W{way}"] + self.p[f"c{way}"], np.zeros((1, h3), np.float32)])
        state = np.zeros((len(index), h), np.float32)
        out = np.empty((index.shape[1], len(index), h), np.float32)
        for t in range(index.shape[1]) if way == "f" else range(index.shape[1] - 1, -1, -1):
            x, u = table[index[:, t]], state @ self.p[f"U{way}"]
            gates = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            new = n + z * (state - n)
            new = np.where((index[:, t] >= 0)[:, None], new, state)
            if keep is not None:
                keep.append((t, state, z, r, n, u[:, 2 * h :]))
            out[t] = state = new
        return out

    def forward(self, inputs: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit for each window; keep gets what backward needs."""
        steps: dict[str, list | None] = {"f": None, "b": None} if keep is None else {"f": [], "b": []}
        states = np.concatenate([self._direction(way, inputs, index, steps[way]) for way in "fb"], axis=2)
        u = np.tanh(states @ self.p["A"] + self.p["a"])
        score = np.where(index.T >= 0, u @ self.p["v"], np.float32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = (weight[..., None] * states).sum(0)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "u": u, "weight": weight, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"]

    def backward(self, inputs: np.ndarray, index: np.ndarray, kept: dict, error: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the inputs, and of the inputs, for the errors of the logits."""
        g = {k: np.zeros_like(x) for k, x in self.p.items() if k not in ("word", "gram")}
        states, u, weight, pooled = (kept[k] for k in ("states", "u", "weight", "pooled"))
        g["w"], g["b"] = error @ pooled, error.sum(keepdims=True)
        into = error[:, None] * self.p["w"]
        by_weight = (states * into).sum(2)
        by_score = weight * (by_weight - (weight * by_weight).sum(0))
        g["v"] = (by_score[..., None] * u).sum((0, 1))
        by_u = by_score[..., None] * self.p["v"] * (1 - u * u)
        g["A"], g["a"] = np.einsum("tbi,tbj->ij", states, by_u), by_u.sum((0, 1))
        by_state = weight[..., None] * into + by_u @ self.p["A"].T
        h = self.shape.hidden
        full = np.vstack([inputs, np.zeros((1, inputs.shape[1]), np.float32)])
        by_token = np.zeros((index.shape[1], len(index), inputs.shape[1]), np.float32)
        for k, way in enumerate("fb"):
            matrix = self.p[f"U{way}"]
            carry = np.zeros((len(index), h), np.float32)
            for t, before, z, r, n, un in reversed(kept["steps"][way]):
                live = (index[:, t] >= 0)[:, None]
                d = by_state[t][:, k * h : (k + 1) * h] + carry
                dn, dz = d * (1 - z) * (1 - n * n), d * (before - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                dx = np.where(live, np.hstack([dz, dr, dn]), np.float32(0))
                du = np.where(live, np.hstack([dz, dr, dn * r]), np.float32(0))
                g[f"U{way}"] += before.T @ du
                g[f"W{way}"] += full[index[:, t]].T @ dx
                g[f"c{way}"] += dx.sum(0)
                carry = np.where(live, d * z, d) + du @ matrix.T
                by_token[t] += dx @ self.p[f"W{way}"].T
        return g, _gathered(index.T.ravel(), by_token.reshape(-1, inputs.shape[1]), len(inputs))

    def probabilities(self, t: Tokens, batch: int = 4096) -> np.ndarray:
        """The score of each window."""
        inputs = self.vectors(t)
        parts = [self.forward(inputs, t.windows[i : i + batch]) for i in range(0, len(t.windows), batch)]
        return _sigmoid(np.concatenate(parts)).astype(np.float64) if parts else np.zeros(0)

    def scores(self, t: Tokens) -> np.ndarray:
        """The score of each text: that of its highest window; without words, the prior."""
        out = np.full(len(t.found), -1.0)
        np.maximum.at(out, t.owner, self.probabilities(t))
        return np.where(t.found > 0, out, self.prior)


def _rows(t: Tokens, chosen: np.ndarray) -> Tokens:
    """Some windows, with only their words."""
    used, index = np.unique(t.windows[chosen], return_inverse=True)
    index = index.reshape(len(chosen), -1)
    if len(used) and used[0] == -1:
        used, index = used[1:], index - 1
    starts = np.cumsum(t.grams) - t.grams
    return Tokens(t.word[used], t.gram[ragged(starts[used], t.grams[used])], t.grams[used], index, t.owner[chosen])


def train(texts: list[str], labels: list[int], shape: Shape | None = None, *, prior: float | None = None, epochs: int = 1, rounds: int = 8, batch: int = 256, rate: float = 0.005, spread: float = 0.05, blind: float = 0.6, least_steps: int = 150) -> Network:
    """Fits the network to labelled texts: first windows drawn from all texts under their text's label, then rounds
    on the windows that now score highest in each text (those make its score) and as many drawn ones of clean texts.
    Few texts get more rounds, until there were least_steps steps. prior: the score of texts without words, by default the
    share of toxic ones in labels.
    """
    shape = shape or Shape()
    net, rnd = Network(shape), np.random.default_rng(shape.seed + 1)
    y = np.array(labels, np.float32)
    net.prior = prior if prior is not None else float(y.mean()) if len(y) else 0.0
    t = tokens_of(*byte_view(pa.array(texts, pa.string())), shape)
    if not len(t.windows) or len(set(labels)) < 2:
        return net
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items() if k not in ("word", "gram")}
    seen = {k: np.full(len(net.p[k]), 1e-8, np.float32) for k in ("word", "gram")}
    step = 0

    def adapt(name: str, rows: np.ndarray, values: np.ndarray) -> None:
        """Vectors move by a rate of their own (adaptive gradient), and only those that occur."""
        used, own = np.unique(rows, return_inverse=True)
        g = _gathered(own, values, len(used))
        seen[name][used] += (g * g).mean(1)
        net.p[name][used] -= np.float32(spread) * g / np.sqrt(seen[name][used])[:, None]

    def fit(chosen: np.ndarray) -> None:
        nonlocal step
        chosen = rnd.permutation(chosen)
        for i in range(0, len(chosen), batch):
            some = _rows(t, chosen[i : i + batch])
            inputs, kept = net.vectors(some), {}
            keep = (rnd.random(len(inputs)) >= blind).astype(np.float32)[:, None]
            inputs[:, : shape.width] *= keep  # some words are known by their characters alone
            logits = net.forward(inputs, some.windows, kept)
            error = ((_sigmoid(logits) - y[some.owner]) / len(some.owner)).astype(np.float32)
            g, back = net.backward(inputs, some.windows, kept, error)
            adapt("word", some.word, back[:, : shape.width] * keep)
            adapt("gram", some.gram, np.repeat(back[:, shape.width :] / np.sqrt(some.grams[:, None]), some.grams, axis=0).astype(np.float32))
            step += 1
            for k, (m, v) in moments.items():
                m += 0.1 * (g[k] - m)
                v += 0.001 * (g[k] * g[k] - v)
                net.p[k] -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-7))

    every = np.arange(len(t.windows))
    first = np.searchsorted(t.owner, np.arange(len(texts)))
    for _ in range(epochs):
        few = rnd.permutation(every)
        order = few[np.argsort(t.owner[few], kind="stable")]
        fit(order[(np.arange(len(order)) - first[t.owner[order]]) < 12])
    done = 0
    while done < rounds or step < least_steps:
        done += 1
        p = net.probabilities(t)
        order = np.lexsort((-p, t.owner))
        rank = np.arange(len(order)) - first[t.owner[order]]
        top = order[rank < np.where(y[t.owner[order]] > 0, 1, 3)]
        clean = every[y[t.owner] == 0]
        fit(np.concatenate([top, rnd.choice(clean, min(len(clean), len(texts)), replace=False)]))
    return net


def _usable(labels: DataFrame, key: str, target: str) -> DataFrame:
    """Labels that aren't held out, and have a key and a class."""
    return labels.where(F.col(key).isNotNull() & F.col(target).isin(0, 1) & (F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2))


def toxic_share(labels: DataFrame, *, key: str = "doc_id", target: str = "toxic") -> float:
    """The share of toxic ones among all labels that aren't held out (0 if there are none)."""
    return _usable(labels, key, target).agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0


def labelled_sample(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", target: str = "toxic", each: int = 1000) -> tuple[list[str], list[int]]:
    """At most ``each`` labelled texts of either class, those with the least key hashes, without held-out keys.

    A key is held out if the CRC-32 of its decimal text leaves 2 modulo 4. Labels and keys that are null don't count.
    """
    usable = _usable(labels, key, target)
    wanted = []
    for value in (0, 1):
        found = usable.where(F.col(target) == value).select(key, F.col(target).cast("int").alias("_y"), F.xxhash64(key).alias("_h")).orderBy("_h", key).limit(each)
        wanted += found.collect()
    chosen = documents.sparkSession.createDataFrame(wanted, usable.select(key, F.col(target).cast("int").alias("_y"), F.xxhash64(key).alias("_h")).schema)
    rows = documents.select(key, F.col(text).alias("_t")).join(F.broadcast(chosen), key).where("_t is not null").orderBy("_h", key, F.xxhash64("_t")).limit(4 * each).collect()
    return [r["_t"] for r in rows], [r["_y"] for r in rows]


def with_toxicity(df: DataFrame, net: Network, *, text: str = "text", out: str = "score") -> DataFrame:
    """Adds a score between 0 and 1: the highest of all overlapping windows of the whole text.

    Null and empty texts and texts without words get the network's prior. All rows and columns stay;
    a column that had the name out is replaced.
    """
    df = df.drop(out)
    model = df.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text, _BLOCK):
                found = model.value.scores(tokens_of(*byte_view(part.column(text)), model.value.shape))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], schema.fieldNames())

    return df.mapInArrow(run, schema)


def has_words(text: Column) -> Column:
    """Whether the network finds a word in a text (null: no)."""
    return F.coalesce(text, F.lit("")).rlike(r"[0-9A-Za-z']|[^\x00-\x7F]")


def is_held_out(key: int) -> bool:
    """The rule of labelled_sample for one key."""
    return zlib.crc32(str(key).encode()) % 4 == 2
