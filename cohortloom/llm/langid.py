"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window of fixed
length, the maximum of each filter over the window is taken, and a softmax
layer names the language. The network is trained in numpy on labelled windows
from a bounded sample of documents; a text is cut into windows that cover all
of it, and its languages' probabilities are the mean over its windows, weighted
by their bytes.

To apply the network, embedding and filters are folded into tables indexed by
pairs of bytes, so that a filter of width 4 costs two look-ups and an addition.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
equal rows get equal results; an empty table, or one without labels to learn
from, gives ``und`` throughout. Windows are made in blocks, so memory does not
grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 8
#: Bound of the sample that the network is fitted on: windows, one from each document.
SAMPLE = 6000
FOLDS, HELD_OUT = 5, 0
_REACH = WINDOW + max(WIDTHS) - 1


@dataclass
class Network:
    """Parameters of a fitted network; ``conv[w]`` has shape (width, EMBED, FILTERS)."""

    langs: list[str]
    embed: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def fit(windows: np.ndarray, labels: list[str], epochs: int = 5, batch: int = 64, rate: float = 4e-3, seed: int = 0) -> Network:
    """Adam on the cross-entropy of labelled windows (rows of ``WINDOW + 3`` bytes)."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.searchsorted(langs, labels)
    params = [rng.normal(0, 0.5, (256, EMBED))]
    params += [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), np.zeros(len(langs))]
    params = [p.astype(np.float32) for p in params]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    k, step = len(WIDTHS), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            x, t = windows[order[at : at + batch]], y[order[at : at + batch]]
            embed, convs, biases, out, out_bias = params[0], params[1 : 1 + k], params[1 + k : 1 + 2 * k], params[-2], params[-1]
            e = embed[x]
            pooled, best = [], []
            for w, c, b in zip(WIDTHS, convs, biases, strict=True):
                z = sum(e[:, j : j + WINDOW] @ c[j] for j in range(w)) + b
                best.append(z.argmax(axis=1))
                pooled.append(np.take_along_axis(z, best[-1][:, None], axis=1)[:, 0])
            p = np.concatenate(pooled, axis=1)
            h = np.maximum(p, 0)
            s = h @ out + out_bias
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
            s[np.arange(len(t)), t] -= 1
            s /= len(t)
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = h.T @ s, s.sum(axis=0)
            d = (s @ out.T) * (p > 0)
            # Only the place of each maximum takes part in the step back.
            for n, (w, c, place) in enumerate(zip(WIDTHS, convs, best, strict=True)):
                dz = d[:, n * FILTERS : (n + 1) * FILTERS]
                grads[1 + k + n] = dz.sum(axis=0)
                for j in range(w):
                    byte = np.take_along_axis(x, place + j, axis=1)
                    grads[1 + n][j] = np.einsum("bf,bfe->ef", dz, embed[byte])
                    np.add.at(grads[0], byte.ravel(), (dz[:, :, None] * c[j].T[None]).reshape(-1, EMBED))
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(langs, params[0], params[1 : 1 + k], params[1 + k : 1 + 2 * k], params[-2], params[-1])


class Reader:
    """A network folded into tables over pairs of bytes; made once in each task."""

    def __init__(self, net: Network):
        self.net = net
        single = [[net.embed @ c[j] for j in range(w)] for w, c in zip(WIDTHS, net.conv, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        two, three, four = single
        self.head = np.ascontiguousarray(np.concatenate([pair(*two) + net.bias[0], pair(three[0], three[1]) + net.bias[1], pair(four[0], four[1]) + net.bias[2]], axis=1), dtype=np.float32)
        self.third, self.tail = three[2].astype(np.float32), np.ascontiguousarray(pair(four[2], four[3]), dtype=np.float32)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for each row of ``x`` (``WINDOW + 3`` bytes)."""
        t = np.ascontiguousarray(x.T)
        pair = t[:-1].astype(np.int32) * 256 + t[1:]
        most = np.zeros((len(x), FILTERS * len(WIDTHS)), dtype=np.float32)  # zero: what a rectifier leaves
        for j in range(WINDOW):
            z = self.head[pair[j]]
            z[:, FILTERS : 2 * FILTERS] += self.third[t[j + 2]]
            z[:, 2 * FILTERS :] += self.tail[pair[j + 2]]
            np.maximum(most, z, out=most)
        s = most @ self.net.out + self.net.out_bias
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities for each non-empty text, over all windows of it."""
        margin = _REACH - WINDOW
        count = [-(-(len(t) + margin) // WINDOW) for t in texts]
        buffer = np.zeros(sum(count) * WINDOW + margin, dtype=np.uint8)
        weight, owner, at = np.zeros(sum(count), dtype=np.float32), np.repeat(np.arange(len(texts)), count), 0
        for t, n in zip(texts, count, strict=True):
            buffer[at * WINDOW : at * WINDOW + len(t)] = np.frombuffer(t, dtype=np.uint8)
            weight[at : at + n] = np.clip(len(t) - WINDOW * np.arange(n), 0, WINDOW)
            at += n
        rows = np.lib.stride_tricks.as_strided(buffer, (len(weight), _REACH), (WINDOW, 1))
        total = np.zeros((len(texts), len(self.net.langs)))
        for k in range(0, len(weight), 1024):
            p = self.windows(rows[k : k + 1024]) * weight[k : k + 1024, None]
            np.add.at(total, owner[k : k + 1024], p)
        return total / np.array([len(t) for t in texts])[:, None]


def _fold(docs: DataFrame, folds: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def train(docs: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Network | None:
    """Fits a network on at most ``sample`` windows of documents with a language that are not held out.

    A threshold on a hash, set after the documents have been counted, chooses them, so that
    the driver gets about as many rows as it uses, whatever the number of partitions.
    """
    known = docs.where(F.col("lang").isNotNull() & (_fold(docs, folds) != held_out))
    n = known.select("doc_id", "lang").count()
    if not n:
        return None
    raw = F.encode("text", "UTF-8")
    place = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.lit(1), F.octet_length("text").cast("long") / WINDOW).cast("long")) * WINDOW + 1).cast("int")
    share = min(1 << 40, int(1.1 * sample / n * (1 << 40)) + 1)
    rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share).where("text is not null")
    rows = rows.select("doc_id", "lang", F.substring(raw, place, F.lit(_REACH)).alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id", "x", "lang").limit(sample).collect()
    rows = [r for r in rows if r["x"]]
    if not rows:
        return None
    x = np.zeros((len(rows), _REACH), dtype=np.uint8)
    for k, r in enumerate(rows):
        x[k, : len(r["x"])] = np.frombuffer(bytes(r["x"]), dtype=np.uint8)
    return fit(x, [r["lang"] for r in rows])


def languages(docs: DataFrame, net: Network | None, block: int = 2 << 20) -> DataFrame:
    """(``doc_id``, ``lang_pred``, ``score``) for each row; ``block``: bytes of text that are read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for b in batches:
            lang, score = ["und"] * b.num_rows, [0.0] * b.num_rows
            texts, rows, held = [], [], 0

            def read(texts: list[bytes], rows: list[int]) -> None:
                p = reader.texts(texts)
                for k, best in zip(rows, p.argmax(axis=1).tolist(), strict=True):
                    lang[k] = net.langs[best]
                for k, s in zip(rows, p.max(axis=1).tolist(), strict=True):
                    score[k] = min(1.0, max(0.0, s))

            for k, v in enumerate(b.column(1)):
                text = v.as_py()
                if reader is None or not text or not any(map(str.isalpha, text)):
                    continue
                texts.append(text.encode())
                rows.append(k)
                held += len(texts[-1])
                if held >= block:
                    read(texts, rows)
                    texts, rows, held = [], [], 0
            if texts:
                read(texts, rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score, type=pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Trained on the documents that are not held out, applied to all."""
    out = languages(docs, train(docs))
    return out.select("doc_id", F.coalesce(_fold(out, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
