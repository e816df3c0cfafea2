"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the mean of hashed embeddings: one for the word, and character inputs (its three-byte runs with ends
marked, its beginnings and its end). Two gated recurrent layers read a window of words in both directions, attention
pools their states, and a logistic unit gives the window's score. Windows of 32 words overlap by half and cover the whole
text; a document scores as its highest window, calibrated on labelled documents that training left out.

Labels belong to documents, so training alternates: the network scores the windows of every training document, then
learns from the highest windows of each and some others. It sees a bounded sample of labelled documents (``Bounds``);
scoring sees all windows of all documents.

Defined results: null and empty texts, and texts without words, score 0; null and repeated ids are scored row by row;
without labels of both kinds every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, slices, utf8
from .words import LOWER, hash_spans, mix, spans

WINDOW, STRIDE = 32, 16
BUCKETS, DIM, HIDDEN, ATTEND = 1 << 14, 16, 8, 8
_STARTS = (3, 5, 7)  # bytes of the beginnings that are inputs of their own
_SALT = np.random.Generator(np.random.PCG64(20260303)).integers(1, 1 << 63, 8, dtype=np.uint64)


@dataclass
class Bounds:
    """The sample that training sees."""

    toxic: int = 900
    clean: int = 2100
    rounds: int = 4
    steps: int = 90  # updates a round
    least_documents: int = 3  # that an input must be in; rarer ones would only let the network learn texts by heart
    any_windows: int = 6  # windows of a text that the first round learns from, at random
    best_windows: int = 2  # windows of a text that later rounds learn from, the highest
    clean_windows: int = 12  # the highest windows of a clean text of which
    clean_share: float = 0.1  # this share is learnt from too
    seed: int = 5


@dataclass
class Words:
    """Distinct words and their inputs: bucket numbers, with the first of each word."""

    codes: np.ndarray  # of every word in order
    at: np.ndarray  # words before each text
    inputs: np.ndarray
    first: np.ndarray


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h ^ _SALT[salt]) >> np.uint64(50)).astype(np.int64) % BUCKETS


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Inputs of all words of texts, computed once for each distinct word."""
    data = LOWER[data]
    starts, ends, at = spans(data, offsets)
    codes, distinct = pd.factorize(hash_spans(data, starts, ends).view(np.int64))
    n = len(distinct)
    if not n:
        return Words(codes, at, np.zeros(0, np.int64), np.zeros(0, np.int64))
    seen = np.empty(n, np.int64)
    seen[codes[::-1]] = np.arange(len(codes))[::-1]
    s, e = starts[seen], ends[seen]
    parts = [_bucket(distinct.view(np.uint64), 0)[:, None]]
    for k, size in enumerate(_STARTS):
        parts.append(_bucket(hash_spans_at(data, s, np.minimum(s + size, e)), 1 + k)[:, None])
    parts.append(_bucket(hash_spans_at(data, np.maximum(e - 3, s), e), 5)[:, None])
    fixed = np.concatenate(parts, axis=1)
    # three-byte runs of the word with a mark at both ends: as many as it has bytes
    size = e - s
    total = size + fixed.shape[1]
    first = np.cumsum(total) - total
    inputs = np.empty(int(total.sum()), np.int64)
    for k in range(fixed.shape[1]):
        inputs[first + k] = fixed[:, k]
    word = np.repeat(np.arange(n), size)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    here = s[word] + nth
    padded = np.concatenate([data, np.zeros(1, np.uint8)]).astype(np.uint64)
    before = np.where(nth > 0, padded[here - 1], np.uint64(1))
    after = np.where(nth < size[word] - 1, padded[here + 1], np.uint64(2))
    run = padded[here] | before << np.uint64(8) | after << np.uint64(16)
    inputs[first[word] + fixed.shape[1] + nth] = _bucket(run, 6)
    return Words(codes, at, inputs, first)


def hash_spans_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """hash_spans for spans in any order."""
    order = np.argsort(starts, kind="stable")
    out = np.empty(len(starts), np.uint64)
    out[order] = hash_spans(data, starts[order], ends[order])
    return out


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words: every STRIDE words, the last one flush with the end."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def all_windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of every window of every text."""
    sizes = np.diff(at)
    each = np.where(sizes > WINDOW, 1 + -(-(sizes - WINDOW) // STRIDE), np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    length = np.minimum(sizes[text], WINDOW)
    start = at[text] + np.minimum(nth * STRIDE, sizes[text] - length)
    return text, start, length


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index: numpy's own scatter-add is many times slower."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.diff(index, prepend=-1))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[index[first]] = np.add.reduceat(rows[order], first)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Network:
    """Weights, and what a score is made of."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0
    fitted: bool = False

    @staticmethod
    def new(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        w = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        p = {"E": w(BUCKETS, DIM, by=0.02), "a": w(2 * HIDDEN, ATTEND, by=0.3), "ab": np.zeros(ATTEND, np.float32), "v": w(ATTEND, by=0.3)}
        p |= {"o": w(2 * HIDDEN, by=0.3), "ob": np.full(1, -1.0, np.float32)}
        for d in "fb":
            p |= {f"W{d}": w(DIM, 3 * HIDDEN, by=DIM**-0.5), f"U{d}": w(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        return Network(p)

    def embed(self, words: Words, some: np.ndarray | None = None) -> np.ndarray:
        """Inputs of distinct words (or some of them): means of embeddings."""
        n = len(words.first)
        sizes = np.diff(np.append(words.first, len(words.inputs)))
        out = np.empty((n if some is None else len(some), DIM), np.float32)
        for lo in range(0, len(out), 8192):
            own = np.arange(lo, min(lo + 8192, n)) if some is None else some[lo : lo + 8192]
            size = sizes[own]
            first = np.cumsum(size) - size
            flat = np.repeat(words.first[own] - first, size) + np.arange(int(size.sum()))
            out[lo : lo + len(own)] = np.add.reduceat(self.p["E"][words.inputs[flat]], first) / size[:, None]
        return out

    def run(self, x: np.ndarray, tokens: np.ndarray, length: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: x are inputs of words, tokens (windows, WINDOW) index them. keep: gets what backward needs."""
        p, (n, steps) = self.p, tokens.shape
        short = bool((length < steps).any())
        states = np.empty((2, steps, n, HIDDEN), np.float32)
        for d, name in enumerate("fb"):
            table = x @ p[f"W{name}"] + p[f"c{name}"]
            u, h = p[f"U{name}"], np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g, hu = table[tokens[:, t]], h @ u
                zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                m = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = m + z * (h - m)
                if short:
                    new = np.where((t < length)[:, None], new, h)
                if keep is not None:
                    keep.append((d, t, h, z, r, m, hu[:, 2 * HIDDEN :]))
                states[d, t] = h = new
        both = np.concatenate([states[0], states[1]], axis=2)  # steps, windows, 2 * HIDDEN
        hidden = np.tanh(both @ p["a"] + p["ab"])
        e = hidden @ p["v"]
        if short:
            e = np.where(np.arange(steps)[:, None] < length, e, np.float32(-30))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, both)
        if keep is not None:
            keep.append((both, hidden, w, pooled))
        return pooled @ p["o"] + p["ob"][0]

    def gradient(self, x: np.ndarray, tokens: np.ndarray, length: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted logistic loss for all weights but E, and for the inputs x."""
        p, (n, steps) = self.p, tokens.shape
        keep: list = []
        logit = self.run(x, tokens, length, keep)
        both, hidden, w, pooled = keep.pop()
        d = ((_sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
        g = {"o": pooled.T @ d, "ob": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * p["o"]
        de = np.einsum("nh,tnh->tn", dpool, both)
        de = w * (de - (w * de).sum(0))
        dhid = de[:, :, None] * p["v"] * (1 - hidden**2)
        g["v"] = np.einsum("tn,tna->a", de, hidden)
        g["a"] = np.einsum("tnh,tna->ha", both, dhid)
        g["ab"] = dhid.sum((0, 1))
        dstate = w[:, :, None] * dpool + dhid @ p["a"].T
        dx = np.zeros_like(x)
        for side, name in enumerate("fb"):
            u = p[f"U{name}"]
            gu, dgs = np.zeros_like(u), np.empty((steps, n, 3 * HIDDEN), np.float32)
            dh = np.zeros((n, HIDDEN), np.float32)
            for s, t, h, z, r, m, hu in reversed(keep):
                if s != side:
                    continue
                dh = dh + dstate[t, :, side * HIDDEN : (side + 1) * HIDDEN]
                live = (t < length)[:, None]
                dn = dh * live
                dm = dn * (1 - z) * (1 - m * m)
                dz = dn * (h - m) * z * (1 - z)
                dr = dm * hu * r * (1 - r)
                dg = np.concatenate([dz, dr, dm], axis=1)
                dgs[t] = dg
                dhu = np.concatenate([dz, dr, dm * r], axis=1)
                gu += h.T @ dhu
                dh = np.where(live, dn * z + dhu @ u.T, dh)
            table = _summed(tokens.T.reshape(-1), dgs.reshape(-1, 3 * HIDDEN), len(x))
            g[f"U{name}"], g[f"W{name}"], g[f"c{name}"] = gu, x.T @ table, table.sum(0)
            dx += table @ p[f"W{name}"].T
        return g, dx

    def windows(self, words: Words, batch: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits of all windows of all texts, with (text, first word, number of words) of each."""
        text, start, length = all_windows(words.at)
        out = np.empty(len(text), np.float32)
        if len(text):
            x = self.embed(words)
            order = np.argsort(length != WINDOW, kind="stable")  # short ones, which need masks, last
            step = np.arange(WINDOW)
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                at = start[own, None] + np.minimum(step, length[own, None] - 1)
                out[own] = self.run(x, words.codes[at], length[own])
        return out, text, start, length

    def scores(self, words: Words) -> np.ndarray:
        """Score of each text: its highest window's, calibrated."""
        n = len(words.at) - 1
        if not self.fitted:
            return np.zeros(n)
        best = np.full(n, -np.inf)
        logit, text, _, _ = self.windows(words)
        np.maximum.at(best, text, logit.astype(np.float64))
        return np.where(np.isinf(best), 0.0, 1 / (1 + np.exp(-np.clip(self.scale * best + self.shift, -40, 40))))


def _corpus(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return read_words(np.frombuffer(b"".join(raw), np.uint8), offsets)


def fit(texts: list[str], labels: np.ndarray, prior: float, bounds: Bounds) -> Network:
    """Trains on texts and 0/1 labels; prior is the share of 1 among all labelled documents."""
    labels = np.asarray(labels, np.float32)
    net = Network.new(bounds.seed)
    if not 0 < labels.sum() < len(labels):
        return net
    rng = np.random.default_rng(bounds.seed)
    words = _corpus(texts)
    sizes = np.diff(words.at)
    held = rng.random(len(texts)) < 0.2  # for calibration
    learn = ~held & (sizes > 0)
    live = _start(net, words, labels, learn, bounds)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for phase in range(bounds.rounds):
        logit, text, start, length = net.windows(words)
        order = np.lexsort((-logit if phase else rng.random(len(logit)), text))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        # at first any windows stand for a text, then its highest; clean texts also show some others
        some_clean = (labels[text] == 0) & (rng.random(len(text)) < bounds.clean_share) & (rank < bounds.clean_windows)
        take = learn[text] & ((rank < (bounds.best_windows if phase else bounds.any_windows)) | some_clean)
        chosen = np.flatnonzero(take)
        ones, zeros = chosen[labels[text[chosen]] == 1], chosen[labels[text[chosen]] == 0]
        if not len(ones) or not len(zeros):
            break
        for _ in range(bounds.steps):
            own = np.concatenate([rng.choice(ones, 40), rng.choice(zeros, 88)])
            at = start[own, None] + np.minimum(np.arange(WINDOW), length[own, None] - 1)
            some, tokens = np.unique(words.codes[at], return_inverse=True)
            tokens = tokens.reshape(at.shape)
            target = labels[text[own]]
            weight = np.ones(len(own), np.float32)
            g, dx = net.gradient(net.embed(words, some), tokens, length[own], target, weight)
            size = np.diff(np.append(words.first, len(words.inputs)))[some]
            flat = np.repeat(words.first[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            g["E"] = _summed(words.inputs[flat], np.repeat(dx / size[:, None].astype(np.float32), size, axis=0), BUCKETS) * live[:, None] + np.float32(1e-4) * net.p["E"]
            step += 1
            _adam(net.p, g, moments, step, 0.01)
    net.fitted = True
    _calibrate(net, words, labels, held if 0 < labels[held].sum() < held.sum() else np.ones(len(texts), bool), prior)
    return net


def _start(net: Network, words: Words, labels: np.ndarray, learn: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Sets the first coordinate of each embedding to its input's log odds over documents, and silences rare inputs.

    Gives the inputs that take part.
    """
    size = np.diff(np.append(words.first, len(words.inputs)))
    counts = np.zeros((2, BUCKETS))
    for k in np.flatnonzero(learn):
        distinct = np.unique(words.codes[words.at[k] : words.at[k + 1]])
        own = size[distinct]
        flat = np.repeat(words.first[distinct] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        counts[int(labels[k]), np.unique(words.inputs[flat])] += 1
    total = np.array([(learn & (labels == y)).sum() for y in (0, 1)], float)[:, None]
    rate = (counts + 0.5) / (total + 1)
    odds = np.log(rate[1] / rate[0]) * (counts.sum(0) / (counts.sum(0) + 4))
    live = (counts.sum(0) >= bounds.least_documents).astype(np.float32)
    net.p["E"][:, 0] = np.clip(odds, -1, 4)
    net.p["E"] *= live[:, None]
    return live


def _adam(p: dict, g: dict, moments: dict, step: int, rate: float) -> None:
    for k, d in g.items():
        m, v = moments[k]
        m *= 0.9
        m += 0.1 * d
        v *= 0.99
        v += 0.01 * d * d
        p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def _calibrate(net: Network, words: Words, labels: np.ndarray, own: np.ndarray, prior: float) -> None:
    """Fits scale and shift of the logit by logistic regression, then moves the sample's share of 1 to the corpus's."""
    best = np.full(len(labels), -np.inf)
    logit, text, _, _ = net.windows(words)
    np.maximum.at(best, text, logit.astype(np.float64))
    use = own & ~np.isinf(best)
    x, y = best[use], labels[use].astype(np.float64)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    mean, sd = x.mean(), x.std() + 1e-6
    z = (x - mean) / sd
    a, b = 1.0, float(np.log(share / (1 - share)))
    for _ in range(50):  # Newton steps, with a little pull towards a = 1
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r = np.maximum(q * (1 - q), 1e-9)
        grad = np.array([((q - y) * z).sum() + 0.5 * (a - 1), (q - y).sum()])
        hess = np.array([[(r * z * z).sum() + 0.5, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-7:
            break
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    net.scale = float(max(a, 1e-3) / sd)
    net.shift = float(b - a * mean / sd + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bounds: Bounds | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """A network from a bounded sample of labelled documents outside the held-out part."""
    bounds = bounds or Bounds()
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    marks = marks.where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {int(r["y"]): int(r["count"]) for r in marks.groupBy("y").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Network.new(bounds.seed)
    order = F.md5(F.concat(F.lit(f"{bounds.seed}:"), F.col("doc_id").cast("string")))
    picked = marks.where("y = 1").orderBy(order).limit(bounds.toxic).union(marks.where("y = 0").orderBy(order).limit(bounds.clean))
    sample = narrow(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")
    prior = totals[1] / (totals[0] + totals[1])

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "y": []}), *parts])
        rows = rows.sort_values(["doc_id", "text"], ignore_index=True, na_position="first")
        yield pd.DataFrame({"network": [pickle.dumps(fit([t or "" for t in rows["text"]], rows["y"].to_numpy(np.float32), prior, bounds))]})

    # one task of the cluster learns from the sample; the driver gets the weights only
    return pickle.loads(sample.repartition(1).mapInPandas(learn, "network binary").collect()[0][0])


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    rows = narrow(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words = read_words(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(words), pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The input rows, whole, whose text scores below the threshold; scored in place, so nothing is joined back."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 20):
            words = read_words(*utf8(batch.column(batch.schema.get_field_index(text_col))))
            yield batch.filter(pa.array(shared.value.scores(words) < threshold))

    return docs.mapInArrow(run, schema)
