"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A step of the network is a word (a run of letters, digits and non-ASCII characters, lower-case). Its input is a word part,
how much likelier the word is in toxic texts of the sample and a trained embedding, and a character part, the mean of
trained embeddings of its character trigrams. Texts are scored in windows of ``WINDOW`` words, each overlapping the next by half;
a text is as toxic as its most toxic window, and is trained on that window.

The sample: at most ``sample`` toxic texts and three times as many others, of at most ``longest`` characters, by the order of a hash of their id.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from equiloom.llm.decontaminate import words_of

WINDOW, STRIDE = 32, 16
HIDDEN, EMBEDDED, TRIGRAMS = 8, 4, 4096
INPUTS = 1 + 2 * EMBEDDED
KEPT_WORDS = 300_000
CHUNK = 150_000
WINDOWS_AT_ONCE = 1024


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows(count: int) -> np.ndarray:
    """First words of the windows of a text; the last window ends with the text."""
    if count <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, count - WINDOW + STRIDE, STRIDE)
    return np.minimum(starts, count - WINDOW)


def trigram_slots(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding slots of the trigrams of words between bounds, and where each word's begin and end."""
    text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.uint32)
    slots = ((text[:-2] * 8191 + text[1:-1] * 131 + text[2:]) * np.uint32(2654435761) >> np.uint32(20)) & np.uint32(TRIGRAMS - 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    return slots.astype(np.int64), starts, starts + sizes


@dataclass
class Network:
    """Weights. ``forward`` and ``backward`` hold gates in the order update, reset, candidate."""

    words: dict[bytes, int]
    lift: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def known(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))

    def inputs(self, words: Sequence[bytes]) -> np.ndarray:
        """[words, INPUTS]; row 0 of the word tables stands for words that are not in the sample's vocabulary."""
        known = self.known(words)
        slots, starts, ends = trigram_slots(words)
        summed = np.vstack([np.zeros((1, EMBEDDED)), np.cumsum(self.weights["trigrams"][slots], axis=0, dtype=np.float64)])
        chars = (summed[ends] - summed[starts]) / np.maximum(ends - starts, 1)[:, None]
        return np.hstack([self.lift[known, None], self.weights["words"][known], chars]).astype(np.float32)


def run(net: Network, x: np.ndarray | None, real: np.ndarray, keep: list | None = None, gates: tuple | None = None) -> np.ndarray:
    """Logit of each window. ``x``: [windows, WINDOW, INPUTS], or ``gates``: (tables, word numbers); ``real``: False beyond the end of a text."""
    w = net.weights
    n, length = real.shape
    whole = bool(real.all())
    states = np.zeros((2, length, n, HIDDEN), np.float32)
    for side, order in ((0, range(length)), (1, range(length - 1, -1, -1))):
        h, u = np.zeros((n, HIDDEN), np.float32), w[f"u{side}"]
        for t in order:
            gx = gates[0][side].take(gates[1][:, t], axis=0) if gates else x[:, t] @ w[f"x{side}"] + w[f"b{side}"]
            gh = h @ u
            zr = gx[:, :2 * HIDDEN] + gh[:, :2 * HIDDEN]
            zr = 1 / (1 + np.exp(np.negative(zr, out=zr), out=zr))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = gx[:, 2 * HIDDEN:] + r * gh[:, 2 * HIDDEN:]
            c = 1 - 2 / (np.exp(2 * c) + 1)  # tanh
            new = c + z * (h - c)
            if not whole:
                new = np.where(real[:, t, None], new, h)
            if keep is not None:
                keep.append((side, t, h, z, r, c, gh))
            h = states[side, t] = new
    both = np.concatenate([states[0], states[1]], axis=2)
    energy = both @ w["query"]
    energy = np.where(real.T, energy, -1e9)
    share = np.exp(energy - energy.max(axis=0))
    share = share * real.T
    share /= np.maximum(share.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", share, both)
    if keep is not None:
        keep.append((both, share, pooled))
    return pooled @ w["out"] + w["bias"][0]


def gradients(net: Network, x: np.ndarray, real: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean cross entropy by the weights and by the inputs."""
    w, keep = net.weights, []
    logit = run(net, x, real, keep)
    both, share, pooled = keep.pop()
    p = sigmoid(logit)
    loss = float(-np.mean(np.where(target > 0, np.log(p + 1e-7), np.log(1 - p + 1e-7))))
    d = ((p - target) / len(target)).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in w.items() if k not in ("words", "trigrams")}
    g["out"], g["bias"][0] = pooled.T @ d, d.sum()
    d_pooled = d[:, None] * w["out"]
    d_share = np.einsum("nh,tnh->tn", d_pooled, both)
    d_energy = share * (d_share - (share * d_share).sum(axis=0))
    g["query"] = np.einsum("tn,tnh->h", d_energy, both)
    d_both = share[:, :, None] * d_pooled + d_energy[:, :, None] * w["query"]
    dx = np.zeros_like(x)
    carried = [np.zeros((len(x), HIDDEN), np.float32) for _ in range(2)]
    for side, t, h, z, r, c, gh in reversed(keep):
        u = w[f"u{side}"]
        dh = d_both[t][:, side * HIDDEN:(side + 1) * HIDDEN] + carried[side]
        there = real[:, t, None]
        through, dh = np.where(there, 0, dh), np.where(there, dh, 0)
        dc, dz = dh * (1 - z) * (1 - c**2), dh * (h - c) * z * (1 - z)
        dr = dc * gh[:, 2 * HIDDEN:] * r * (1 - r)
        d_gates = np.hstack([dz, dr, dc])
        d_state = np.hstack([dz, dr, dc * r])
        g[f"x{side}"] += x[:, t].T @ d_gates
        g[f"b{side}"] += d_gates.sum(axis=0)
        g[f"u{side}"] += h.T @ d_state
        dx[:, t] += d_gates @ w[f"x{side}"].T
        carried[side] = dh * z + d_state @ u.T + through
    return g, dx, loss


def far_apart(texts: list[list[bytes]], words: int = 5, marks: int = 3) -> list[int]:
    """Numbers of texts that share no minimum of shingle hashes with one before: copies would count words again and again."""
    seen: list[set[int]] = [set() for _ in range(marks)]
    out = []
    odd = np.array([2654435761, 40503 * 65537 + 2, 2246822519], np.uint64)[:marks] | np.uint64(1)
    for n, found in enumerate(texts):
        hashes = np.array([zlib.crc32(b" ".join(found[i:i + words])) for i in range(max(1, len(found) - words + 1))], np.uint64)
        least = [int(((hashes * o) & np.uint64(0xFFFFFFFF)).min()) for o in odd]
        if not any(m in s for m, s in zip(least, seen, strict=True)):
            out.append(n)
        for m, s in zip(least, seen, strict=True):
            s.add(m)
    return out


def train(texts: Sequence[bytes], labels: Sequence[int], epochs: int = 8, steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """A network from texts labelled 0 or 1, after ``epochs`` rounds and ``steps`` batches at least. With no text of one class the score is the share of toxic texts (0 with no text)."""
    found = [words_of(t) for t in texts]
    kept = far_apart(found)
    found, y = [found[i] for i in kept], np.array([labels[i] for i in kept], np.float32)
    rng = np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        return Network({}, np.zeros(1, np.float32), {}, float(y.mean()) if len(y) else 0.0)
    counts = [Counter(w for i in np.flatnonzero(y == c) for w in set(found[i])) for c in (0, 1)]
    vocabulary = sorted(w for w in counts[0] | counts[1] if counts[0][w] + counts[1][w] >= 4)
    totals = [(y == c).sum() for c in (0, 1)]

    def lift(word: bytes) -> float:
        held = [counts[c][word] for c in (0, 1)]
        odds = np.log((held[1] + 0.5) / (totals[1] + 1)) - np.log((held[0] + 0.5) / (totals[0] + 1))
        return float(np.clip(odds, -3, 6) / 3 * sum(held) / (sum(held) + 6))

    def drawn(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    weights = {"words": drawn(len(vocabulary) + 1, EMBEDDED, scale=0.02), "trigrams": drawn(TRIGRAMS, EMBEDDED, scale=0.02), "query": drawn(2 * HIDDEN, scale=0.3), "out": drawn(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
    for side in (0, 1):
        weights |= {f"x{side}": drawn(INPUTS, 3 * HIDDEN, scale=0.4), f"u{side}": drawn(HIDDEN, 3 * HIDDEN, scale=0.3), f"b{side}": np.zeros(3 * HIDDEN, np.float32)}
    net = Network({w: n + 1 for n, w in enumerate(vocabulary)}, np.array([0.0, *map(lift, vocabulary)], np.float32), weights)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in weights.items()}
    step, epochs = 0, max(epochs, -(-steps * batch // len(found)))
    for epoch in range(epochs):
        if epoch & (epoch + 1) == 0:  # the first round, and ever fewer later
            start = window_of_most(net, found)
        order = rng.permutation(len(found))
        for at in range(0, len(order), batch):
            chosen = order[at:at + batch]
            parts = [found[i][start[i]:start[i] + WINDOW] for i in chosen]
            real = np.array([[t < len(p) for t in range(WINDOW)] for p in parts])
            flat = [w for p in parts for w in p]
            x = np.zeros((len(parts), WINDOW, INPUTS), np.float32)
            if flat:
                x[real] = net.inputs(flat)
            g, dx, _ = gradients(net, x, real, y[chosen])
            inner = dx[real]
            g["words"], g["trigrams"] = np.zeros_like(weights["words"]), np.zeros_like(weights["trigrams"])
            if flat:
                known = net.known(flat)
                np.add.at(g["words"], known, inner[:, 1:1 + EMBEDDED])
                slots, starts, ends = trigram_slots(flat)
                sizes = ends - starts
                places = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                np.add.at(g["trigrams"], slots[places], np.repeat(inner[:, 1 + EMBEDDED:] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
            step += 1
            pace = rate * (1 - epoch / epochs) ** 0.5
            for k, v in weights.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + pace * (3e-2 if k == "trigrams" else 1e-3) * v
    return net


def _tables(net: Network, words: Sequence[bytes]) -> list[np.ndarray]:
    """What each word adds to the gates of either side."""
    x = net.inputs(words)
    return [x @ net.weights[f"x{s}"] + net.weights[f"b{s}"] for s in (0, 1)]


def logits(net: Network, found: Sequence[list[bytes]], cache: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every text: text number, first word, logit."""
    cache = {} if cache is None else cache
    number = cache.setdefault("number", {})
    if len(number) > KEPT_WORDS:
        number.clear()
        cache.pop("tables", None)
    fresh = list(set().union(*found).difference(number))
    if fresh or "tables" not in cache:
        more = _tables(net, fresh or [b"a"])
        if "tables" in cache:
            cache["tables"] = [np.vstack(x) for x in zip(cache["tables"], more, strict=True)]
        else:  # row 0 stands beyond the end of a text
            cache["tables"] = [np.vstack([np.zeros((1, 3 * HIDDEN), np.float32), x]) for x in more]
            number.clear() if not fresh else None
        base = len(cache["tables"][0]) - len(more[0])
        number.update({w: base + i for i, w in enumerate(fresh)})
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
    ids = np.r_[ids, np.zeros(WINDOW, np.int64)]
    first = np.cumsum([0, *map(len, found)])[:-1]
    starts = [windows(len(words)) for words in found]
    text = np.repeat(np.arange(len(found)), [len(s) for s in starts])
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    left = np.array([len(words) for words in found], np.int64)[text] - start
    out = np.zeros(len(text), np.float32)
    span = np.arange(WINDOW)
    for some in (np.flatnonzero(left >= WINDOW), np.flatnonzero(left < WINDOW)):
        for at in range(0, len(some), WINDOWS_AT_ONCE):
            part = some[at:at + WINDOWS_AT_ONCE]
            real = span < left[part, None]
            places = np.where(real, ids[np.minimum(first[text[part], None] + start[part, None] + span, len(ids) - 1)], 0)
            out[part] = run(net, None, real, gates=(cache["tables"], places))
    return text, start, out


def window_of_most(net: Network, found: Sequence[list[bytes]]) -> np.ndarray:
    """First word of each text's most toxic window."""
    out = np.zeros(len(found), np.int64)
    for at in range(0, len(found), 500):
        text, start, logit = logits(net, found[at:at + 500])
        order = np.lexsort((-logit, text))
        head = order[np.r_[True, text[order][1:] != text[order][:-1]]]
        out[at:at + len(head)] = start[head]
    return out


def scores(net: Network, texts: Sequence[bytes | None], cache: dict | None = None) -> np.ndarray:
    """Score of each whole text, the highest of its windows."""
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    cache = {} if cache is None else cache
    out, held, begin, size = [], [], 0, 0

    def flush() -> None:
        nonlocal held, size
        text, _, logit = logits(net, held, cache)
        best = np.full(len(held), -np.inf)
        np.maximum.at(best, text, logit)
        out.append(best)
        held, size = [], 0

    for text in texts:
        held.append(words_of(text))
        size += len(held[-1])
        if size >= CHUNK:
            flush()
    if held:
        flush()
    return sigmoid(np.concatenate(out)) if out else np.zeros(0)


def training_sample(docs: DataFrame, labels: DataFrame, wanted: Column, sample: int = 1500, longest: int = 8000) -> tuple[list[bytes], list[int]]:
    """At most ``sample`` toxic texts and ``3 * sample`` others, and their labels. Rows with a null id, text or label are left out; of unequal labels the higher counts."""
    sizes = docs.where(F.col("doc_id").isNotNull() & wanted).select("doc_id", F.length("text").alias("size")).where(F.col("size") <= longest).select("doc_id").distinct()
    marks = labels.where(F.col("toxic").isNotNull() & wanted).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    both = sizes.join(marks, "doc_id")
    chosen = [both.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample * (1 if c else 3)) for c in (0, 1)]
    ids = {r["doc_id"]: r["toxic"] for part in chosen for r in part.collect()}
    if not ids:
        return [], []
    kept = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(kept), "doc_id").where(F.length("text") <= longest)
    texts = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [r["text"].encode() for r in texts], [r["toxic"] for r in texts]


def score(net: Network, spark) -> Column:
    """Column function of the text column: the score of each whole text."""
    sent = spark.sparkContext.broadcast((net.words, net.lift, net.weights, net.constant))

    @F.pandas_udf("double")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        own = Network(*sent.value)
        for texts in batches:
            yield pd.Series(scores(own, list(texts), cache), dtype="float64")

    return lambda text: whole(F.col(text).cast("binary"))
