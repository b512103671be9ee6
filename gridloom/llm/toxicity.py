"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Every word is a hashed word vector beside the mean of its hashed character n-gram vectors. Windows of
``WINDOW`` words start at every ``STRIDE``th word and cover the whole text, so any passage of up to a window less a
stride lies whole in one of them; one network (a GRU in each direction,
attention pooling, a logistic output) scores each of them, and a document's score is that of its worst window.
Trained in numpy by back-propagation on windows of a bounded sample of labelled documents (``most_rows`` a
label, ``most_chars`` in all): the worst window of each document and a random one of each clean document.
The hashed vectors start from the label log-odds of their bucket. Inputs of a score are the text's bytes alone.

Defined results: null and empty texts and texts without letters have no window and score as the pooled zero
vector, which training treats as clean; without labels of both kinds every score is 0. Repeated rows repeat;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import distinct, grams
from .sampling import labelled_sample
from .textvec import LETTER, mix, slices, utf8, words
from .work import crc_mod, table

WINDOW, STRIDE = 48, 16
BUCKETS = 1 << 17
DIM, HIDDEN, ATTEND = 6, 6, 6
GRAMS = (3, 4, 5)
BLOCK = 4096
PART = 20_000
#: Steps of training at least.
STEPS = 120


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 * _sigmoid(2 * x) - 1


class Features:
    """Distinct words of a run of texts, their buckets, and windows over them."""

    def __init__(self, col: pa.Array):
        data, offsets = utf8(col)
        self.n = len(offsets) - 1
        h, starts, lengths, rows = words(data, offsets, LETTER)
        self.u, one, self.inverse = distinct(h)
        self.word_bucket = (self.u % np.uint64(BUCKETS)).astype(np.int64)
        owners, buckets = [], []
        for a in range(0, len(one), PART):  # a part of the words at a time: grams are many
            some = one[a : a + PART]
            parts = [grams(data, starts[some], lengths[some], n) for n in GRAMS]
            bucket = np.concatenate([(mix(c + np.uint64(n << 56)) % np.uint64(BUCKETS)).astype(np.int32) for (c, _), n in zip(parts, GRAMS)])
            owner = np.concatenate([o for _, o in parts]).astype(np.int32)
            order = np.argsort(owner, kind="stable")
            owners.append(owner[order] + a)
            buckets.append(bucket[order])
        self.gram_word = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        self.gram_bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
        self.gram_count = np.bincount(self.gram_word, minlength=len(self.u))
        self.count = np.bincount(rows, minlength=self.n)
        first = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)
        per = np.where(self.count > 0, 1 + np.maximum(0, -(-(self.count - WINDOW) // STRIDE)), 0)
        self.window_row = np.repeat(np.arange(self.n), per)
        k = np.arange(len(self.window_row)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per).astype(np.int64)
        last = np.maximum(0, self.count - WINDOW)
        self.window_start = first[self.window_row] + np.minimum(k * STRIDE, last[self.window_row])
        self.window_size = np.minimum(self.count[self.window_row], WINDOW)

    def char_means(self, vectors: np.ndarray) -> np.ndarray:
        """The mean of each word's gram vectors; every word has a gram, since its marks make it three bytes long."""
        out = np.zeros((len(self.u), vectors.shape[1]), np.float32)
        edge = np.concatenate([[0], np.cumsum(self.gram_count)])
        for a in range(0, len(self.u), PART):
            b = min(a + PART, len(self.u))
            per_gram = vectors[self.gram_bucket[edge[a] : edge[b]]]
            out[a:b] = np.add.reduceat(per_gram, edge[a:b] - edge[a], axis=0) / self.gram_count[a:b, None]
        return out

    def index(self, windows: np.ndarray) -> np.ndarray:
        """[WINDOW, windows] of distinct-word numbers; past the end of a short document, len(u)."""
        at = self.window_start[windows] + np.arange(WINDOW)[:, None]
        inside = np.arange(WINDOW)[:, None] < self.window_size[windows]
        return np.where(inside, self.inverse[np.minimum(at, len(self.inverse) - 1)], len(self.u))


class Net:
    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        f = lambda *shape: (g.normal(size=shape) / np.sqrt(shape[-1])).astype(np.float32)
        self.words, self.chars = f(BUCKETS, DIM) * 0.1, f(BUCKETS, DIM) * 0.1
        self.w = {d: {"W": f(3 * HIDDEN, 2 * DIM), "U": f(3 * HIDDEN, HIDDEN), "b": np.zeros((3 * HIDDEN, 1), np.float32)} for d in "fb"}
        self.head = {"A": f(ATTEND, 2 * HIDDEN), "v": f(1, ATTEND), "o": f(1, 2 * HIDDEN), "c": np.full((1, 1), -2, np.float32)}

    def inputs(self, x: Features) -> np.ndarray:
        out = np.concatenate([self.words[x.word_bucket], x.char_means(self.chars)], 1).T
        return np.concatenate([out, np.zeros((2 * DIM, 1), np.float32)], 1)

    def run(self, e: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows; with ``keep``, what back-propagation needs."""
        pad = e.shape[1] - 1
        inside = (index != pad).astype(np.float32)
        padded = not inside.all()
        n, states, kept = index.shape[1], {}, {"inside": inside}
        for d, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            p = self.w[d]
            proj = p["W"] @ e + p["b"]
            h, hs, log = np.zeros((HIDDEN, n), np.float32), np.empty((WINDOW, HIDDEN, n), np.float32), []
            for t in steps:
                g, u = np.take(proj, index[t], axis=1), p["U"] @ h
                zr = _sigmoid(g[: 2 * HIDDEN] + u[: 2 * HIDDEN])
                z, r = zr[:HIDDEN], zr[HIDDEN:]
                c = _tanh(g[2 * HIDDEN :] + r * u[2 * HIDDEN :])
                new = c + z * (h - c)
                if padded:
                    new = new * inside[t]
                if keep:
                    log.append((t, h, z, r, c, u[2 * HIDDEN :]))
                h = hs[t] = new
            states[d] = hs
            kept[d] = log
        hs = np.concatenate([states["f"], states["b"]], 1)
        q = _tanh(np.matmul(self.head["A"], hs))
        s = np.matmul(self.head["v"], q)[:, 0]
        s = np.where(inside > 0, s, -1e9)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,thn->hn", a, hs)
        logit = (self.head["o"] @ pooled + self.head["c"])[0]
        if keep:
            kept |= {"hs": hs, "q": q, "a": a, "pooled": pooled, "e": e, "index": index}
        return logit, kept

    def back(self, k: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights, and of the inputs of each distinct word."""
        hs, q, a, inside = k["hs"], k["q"], k["a"], k["inside"]
        grad: dict = {"o": dlogit[None] @ k["pooled"].T, "c": dlogit.sum().reshape(1, 1)}
        dpool = self.head["o"].T @ dlogit[None]
        dhs = a[:, None] * dpool
        da = np.einsum("hn,thn->tn", dpool, hs)
        ds = a * (da - (a * da).sum(0))
        grad["v"] = np.einsum("tn,tkn->k", ds, q)[None]
        dq = ds[:, None] * self.head["v"].T * (1 - q * q)
        grad["A"] = np.einsum("tkn,thn->kh", dq, hs)
        dhs = dhs + np.matmul(self.head["A"].T, dq)
        dproj_words = np.zeros_like(k["e"])
        for d, sl in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            p = self.w[d]
            gU, dproj, dh = np.zeros_like(p["U"]), np.zeros((k["e"].shape[1], 3 * HIDDEN), np.float32), np.zeros_like(hs[0, sl])
            for t, h, z, r, c, un in reversed(k[d]):
                dh = (dh + dhs[t, sl]) * inside[t]
                dc, dz = dh * (1 - z), dh * (h - c) * z * (1 - z)
                dg = dc * (1 - c * c)
                dr = dg * un * r * (1 - r)
                du = np.concatenate([dz, dr, dg * r])
                gU += du @ h.T
                np.add.at(dproj, k["index"][t], np.concatenate([dz, dr, dg]).T)
                dh = dh * z + p["U"].T @ du
            grad[f"U{d}"] = gU
            grad[f"W{d}"] = dproj.T @ k["e"].T
            grad[f"b{d}"] = dproj.sum(0)[:, None]
            dproj_words += p["W"].T @ dproj.T
        return grad, dproj_words

    def logits(self, x: Features) -> np.ndarray:
        """Of every window."""
        if not len(x.window_row):
            return np.zeros(0, np.float32)
        e = self.inputs(x)
        return np.concatenate([self.run(e, x.index(np.arange(a, min(a + BLOCK, len(x.window_row)))))[0] for a in range(0, len(x.window_row), BLOCK)])

    def score(self, col: pa.Array) -> np.ndarray:
        x = Features(col)
        worst = np.full(x.n, float(self.head["c"][0, 0]))
        if len(x.window_row):
            edges = np.flatnonzero(np.diff(x.window_row, prepend=-1))
            worst[x.window_row[edges]] = np.maximum.reduceat(self.logits(x), edges)
        return _sigmoid(worst.astype(float))


def _log_odds(x: Features, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word and gram bucket, from the documents that hold it; a few documents at a time."""
    held = {k: np.zeros((2, BUCKETS)) for k in ("word", "gram")}
    first = np.concatenate([[0], np.cumsum(x.gram_count)[:-1]])
    begin = np.concatenate([[0], np.cumsum(x.count)])
    for a in range(0, x.n, 50):
        b = min(a + 50, x.n)
        row = np.repeat(np.arange(b - a), x.count[a:b])
        pairs = np.unique(row * len(x.u) + x.inverse[begin[a] : begin[b]])
        doc, word = pairs // len(x.u), pairs % len(x.u)
        per = x.gram_count[word]
        at = np.repeat(first[word], per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        for kind, d, bucket in (("word", doc, x.word_bucket[word]), ("gram", np.repeat(doc, per), x.gram_bucket[at])):
            one = np.unique(d.astype(np.int64) * BUCKETS + bucket)
            y = toxic[a + one // BUCKETS]
            held[kind][0] += np.bincount(one % BUCKETS, weights=y, minlength=BUCKETS)
            held[kind][1] += np.bincount(one % BUCKETS, weights=1 - y, minlength=BUCKETS)
    out = []
    for t, c in held.values():
        odds = np.log((t + 0.5) / (toxic.sum() + 1)) - np.log((c + 0.5) / ((1 - toxic).sum() + 1))
        out.append(np.where(t + c >= 2, odds, 0).clip(-4, 4).astype(np.float32))
    return out[0], out[1]


def train(texts: list[str], labels: list[int], epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 11) -> Net | None:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    net, g = Net(), np.random.default_rng(seed)
    x = Features(pa.array(texts, pa.large_string()))
    if not len(x.u):
        return None
    net.words[:, 0], net.chars[:, 0] = _log_odds(x, y)
    e = net.inputs(x)
    risk = (e[0] + e[DIM])[:-1][x.inverse]
    window_score = np.array([risk[s : s + n].max() for s, n in zip(x.window_start, x.window_size)])
    edges = np.flatnonzero(np.diff(x.window_row, prepend=-1))
    ends = np.append(edges[1:], len(x.window_row))
    docs_with = x.window_row[edges]
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in _weights(net).items()}
    step, mined = 0, -1
    n = len(docs_with) + int((y[docs_with] == 0).sum())
    batch = min(batch, max(16, n // 8))
    repeat = max(1, -(-STEPS * batch // (n * epochs)))  # few labels take more rounds
    for epoch in (e for e in range(epochs) for _ in range(repeat)):
        if epoch in (2, 5) and epoch != mined:
            mined = epoch
            window_score = net.logits(x)
        worst = np.array([a + window_score[a:b].argmax() for a, b in zip(edges, ends)])
        other = np.array([g.integers(a, b) for a, b in zip(edges, ends)])
        clean = y[docs_with] == 0
        chosen = np.concatenate([worst, other[clean]])
        target = np.concatenate([y[docs_with], np.zeros(clean.sum())])
        order = g.permutation(len(chosen))
        decay = rate * (0.5 ** (epoch // 3))
        for a in range(0, len(order), batch):
            w, t = chosen[order[a : a + batch]], target[order[a : a + batch]]
            index = x.index(w)
            used, local = np.unique(index, return_inverse=True)
            real = used[used < len(x.u)]
            sub = _Sub(x, real)
            e = net.inputs(sub)
            logit, kept = net.run(e, local.reshape(index.shape), keep=True)
            d = ((_sigmoid(logit) - t) / len(t)).astype(np.float32)
            grad, dwords = net.back(kept, d)
            step += 1
            for k, v in _weights(net).items():
                m1, m2 = m[k]
                m1 += 0.1 * (grad[k] - m1)
                m2 += 0.01 * (grad[k] ** 2 - m2)
                v -= decay * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
            dwords = dwords[:, : len(real)].T
            np.add.at(net.words, sub.word_bucket, -0.5 * dwords[:, :DIM])
            share = dwords[:, DIM:] / np.maximum(1, sub.gram_count)[:, None]
            np.add.at(net.chars, sub.gram_bucket, -0.5 * share[sub.gram_word])
    return net


class _Sub(Features):
    """The features of some of the distinct words."""

    def __init__(self, x: Features, real: np.ndarray):
        first = np.concatenate([[0], np.cumsum(x.gram_count)[:-1]])[real]
        self.u, self.word_bucket, self.gram_count = x.u[real], x.word_bucket[real], x.gram_count[real]
        self.gram_word = np.repeat(np.arange(len(real)), self.gram_count)
        at = np.repeat(first, self.gram_count) + np.arange(len(self.gram_word)) - np.repeat(np.cumsum(self.gram_count) - self.gram_count, self.gram_count)
        self.gram_bucket = x.gram_bucket[at]


def _weights(net: Net) -> dict[str, np.ndarray]:
    return {f"{k}{d}": net.w[d][k] for d in "fb" for k in ("W", "U", "b")} | net.head


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 1200, most_chars: int = 12_000_000, id_col: str = "doc_id", text_col: str = "text") -> Net | None:
    """``labels`` has doc_id and toxic; only its documents are learned from."""
    known = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("int").alias("y")).where("y IN (0, 1)")
    texts, y = labelled_sample(docs, known, most_rows, most_chars, id_col, text_col)
    return train(texts, y)


def score_documents(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` read here, as doc_id, text, and toxic_score."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if net is None:
        return named.withColumn("toxic_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = named.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)))], names=["doc_id", "toxic_score"])

    return named.mapInArrow(score, f"doc_id {kind}, toxic_score double")


def drop_toxic(docs: DataFrame, net: Net | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, in one pass, with the columns of ``docs``."""
    if net is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_col):
                yield b.filter(pa.array(shared.value.score(b.column(b.schema.get_field_index(text_col))) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = learn(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = score_documents(docs, net)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
