"""Language of documents by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text, blanks included, in both directions, gives each byte
position a probability for each language, and a document gets the mean over all its
positions. A text is read in windows side by side: each labels 224 positions and reads 16
more bytes of the text on either side first; at the ends of the text both directions start
with an empty state, as they do in training. The network is trained in numpy by
backpropagation through time, on windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Positions that a window labels, bytes it reads before and after them, and bytes of a training window.
LABELLED, WARM, TRAINED = 224, 16, 64
BATCH = 1024  # windows read at once


def _soft(x: np.ndarray) -> np.ndarray:
    """The squashing function of the network, from -1 to 1; far cheaper than tanh. Its slope is (1 - |value|) ** 2."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * _soft(x) + 0.5


def _read(e: np.ndarray, u: np.ndarray, x: np.ndarray, keep: bool = False):
    """Hidden states (places, words, units) for bytes x (places, words); with keep what training needs."""
    size = u.shape[0]
    h = np.zeros((x.shape[1], size), dtype=np.float32)
    out = np.empty((*x.shape, size), dtype=np.float32)
    kept = []
    for t in range(len(x)):
        g, a = e[x[t]], h @ u
        gates = _gate(g[:, : 2 * size] + a[:, : 2 * size])
        z, r, inner = gates[:, :size], gates[:, size:], a[:, 2 * size :]
        n = _soft(g[:, 2 * size :] + r * inner)
        new = n + z * (h - n)
        if keep:
            kept.append((h, z, r, n, inner))
        out[t] = h = new
    return out, kept


def _states(e: np.ndarray, u: np.ndarray, x: np.ndarray, out: np.ndarray, inside: np.ndarray | None = None) -> None:
    """The hidden states of `_read` into out, without what training needs: all arrays are whole and used again.

    Where inside (places, words) is False the state stays zero, so that a text is read from its own end.
    """
    size, n = u.shape[0], x.shape[1]
    half = np.float32(0.5)
    tables = [np.ascontiguousarray(e[:, k * size : (k + 1) * size]) for k in range(3)]
    weights = [np.ascontiguousarray(u[:, k * size : (k + 1) * size] * f) for k, f in enumerate((1, 1, half))]
    z, r, c, a = (np.empty((n, size), dtype=np.float32) for _ in range(4))
    h = np.zeros((n, size), dtype=np.float32)

    def soft(y: np.ndarray) -> None:
        np.abs(y, out=a)
        np.add(a, np.float32(1), out=a)
        y /= a

    for t in range(len(x)):
        for gate, table, weight in zip((z, r), tables, weights, strict=False):  # twice the gate, less one
            np.take(table, x[t], axis=0, out=gate, mode="clip")
            gate += np.matmul(h, weight, out=a)
            soft(gate)
        np.matmul(h, weights[2], out=a)
        np.take(tables[2], x[t], axis=0, out=c, mode="clip")
        c += a
        c += np.multiply(r, a, out=a)
        soft(c)
        np.subtract(h, c, out=a)
        c += np.multiply(a, half, out=h)
        h *= z
        np.add(c, h, out=out[t])
        if inside is not None:
            out[t] *= inside[t][:, None]
        h[:] = out[t]


def _unread(u: np.ndarray, x: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of e and u by backpropagation through time."""
    size = u.shape[0]
    d_u, d_h = np.zeros_like(u), np.zeros_like(d_out[0])
    d_in = np.empty((*x.shape, 3 * size), dtype=np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, inner = kept[t]
        d = d_out[t] + d_h
        d_n = d * (1 - z) * (1 - np.abs(n)) ** 2
        d_z = d * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        d_r = d_n * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_in[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_a = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_u += h.T @ d_a
        d_h = d * z + d_a @ u.T
    flat, at = d_in.reshape(-1, 3 * size), x.reshape(-1)
    d_e = np.stack([np.bincount(at, weights=flat[:, k], minlength=256) for k in range(3 * size)], axis=1)
    return d_e.astype(np.float32), d_u


class Network:
    """Two recurrent layers, one a direction, and a softmax over languages at each byte."""

    def __init__(self, languages: list[str], units: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, size=shape).astype(np.float32)
        self.languages = languages
        self.w = {"e1": draw(256, 3 * units), "u1": draw(units, 3 * units), "e2": draw(256, 3 * units), "u2": draw(units, 3 * units), "o": draw(2 * units, len(languages)), "b": np.zeros(len(languages), np.float32)}

    def label(self, x: np.ndarray, keep: bool = False):
        """Probabilities (places, words, languages) for bytes x (places, words)."""
        w = self.w
        ahead, k1 = _read(w["e1"], w["u1"], x, keep)
        behind, k2 = _read(w["e2"], w["u2"], x[::-1], keep)
        h = np.concatenate([ahead, behind[::-1]], axis=2)
        logits = h @ w["o"] + w["b"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        return (p, h, k1, k2) if keep else p

    def train(self, words: list[bytes], labels: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.01, least: int = 500, seed: int = 1) -> None:
        """Adam on the mean cross entropy of all byte positions, in batches of equal length; `least` steps at least."""
        rng = np.random.default_rng(seed)
        sizes = np.array([len(x) for x in words])
        batches = []
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            rng.shuffle(at)
            batches += [at[i : i + batch] for i in range(0, len(at), batch)]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        epochs = max(epochs, -(-least // max(len(batches), 1)))
        for epoch in range(epochs):
            for b in rng.permutation(len(batches)):
                at = batches[b]
                x = np.frombuffer(b"".join(words[i] for i in at), dtype=np.uint8).reshape(len(at), -1).T
                p, h, k1, k2 = self.label(x, keep=True)
                d = p / (p.shape[0] * p.shape[1])
                d[:, np.arange(len(at)), labels[at]] -= 1 / (p.shape[0] * p.shape[1])
                units = self.w["u1"].shape[0]
                d_h = d @ self.w["o"].T
                e1, u1 = _unread(self.w["u1"], x, k1, d_h[:, :, :units])
                e2, u2 = _unread(self.w["u2"], x[::-1], k2, d_h[::-1, :, units:])
                grads = {"e1": e1, "u1": u1, "e2": e2, "u2": u2, "o": h.reshape(-1, 2 * units).T @ d.reshape(-1, d.shape[2]), "b": d.sum(axis=(0, 1))}
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.w[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def sums(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text of these bytes the sum over all positions of the probabilities of all languages."""
        size = np.diff(offsets)
        number = -(-size // LABELLED)
        text = np.repeat(np.arange(len(size)), number)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
        first = offsets[:-1][text] + nth * LABELLED  # first labelled position
        whole = (nth > 0) & (first + LABELLED + WARM <= offsets[1:][text])  # windows that end nowhere outside their text
        order = np.argsort(~whole, kind="stable")
        text, first, n_whole = text[order], first[order], int(whole.sum())
        out = np.zeros((len(size), len(self.languages)))
        for at in [*range(0, n_whole, BATCH), *range(n_whole, len(text), BATCH)]:
            some = slice(at, min(at + BATCH, n_whole if at < n_whole else len(text)))
            place = first[some] + np.arange(-WARM, LABELLED + WARM)[:, None]
            inside = (place >= offsets[:-1][text[some]]) & (place < offsets[1:][text[some]])
            x = np.where(inside, raw[np.clip(place, 0, max(len(raw) - 1, 0))], np.uint8(32))
            counted = inside[WARM:-WARM].astype(np.float32)
            p = self.probabilities(x, None if at < n_whole else inside)[:, WARM:-WARM]
            np.add.at(out, text[some], np.stack([(q * counted).sum(axis=0) for q in p], axis=1))
        return out

    def probabilities(self, x: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """As label, but languages first, and faster; both directions start anew where inside begins to hold."""
        w, size = self.w, self.w["u1"].shape[0]
        ahead, behind = (np.empty((*x.shape, size), dtype=np.float32) for _ in range(2))
        _states(w["e1"], w["u1"], x, ahead, inside)
        _states(w["e2"], w["u2"], x[::-1], behind, None if inside is None else inside[::-1])
        logits = ahead.reshape(-1, size) @ w["o"][:size]
        logits += (behind[::-1].reshape(-1, size)) @ w["o"][size:]
        p = np.ascontiguousarray(logits.T) + w["b"][:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.reshape(-1, *x.shape)


def _training_windows(most: int):
    """Map function: up to `most` windows of each document, evenly spaced over its text."""

    def chosen(text: str) -> list[bytes]:
        raw = text.encode()
        last = max(len(raw) - TRAINED, 0)
        return [raw[k : k + TRAINED] for k in np.linspace(0, last, min(most, last // TRAINED + 1 + (last > 0))).astype(int)] if raw else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(order, lang, w) for order, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in chosen(text)]
            order, lang, w = zip(*rows, strict=True) if rows else ([],) * 3
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(lang, pa.string()), pa.array(w, pa.binary())], names=["order", "lang", "window"])

    return run


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 400, windows: int = 10, units: int = 16, epochs: int = 4) -> Network:
    """A network trained on a bounded sample of labelled documents.

    About `per_language` distinct documents of each language, those whose hashes of doc_id and
    text come first, and at most `windows` windows of 64 bytes of each, come to the driver;
    besides them one row for each language. Documents that are held out or have a null lang,
    text or doc_id are not learned from.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("order"))
    counts = known.groupBy("lang").agg(F.count_distinct("order").alias("count")).collect()
    names = sorted(r["lang"] for r in counts)
    if not names:
        return Network(["und"], units)
    # a document is likely enough chosen that about per_language are; repeated rows are chosen together and count once
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, share double")
    likely = known.join(F.broadcast(shares), "lang").where(F.pmod("order", F.lit(1_000_003)) < F.lit(1_000_003) * F.col("share"))
    chosen = likely.dropDuplicates(["lang", "order"]).orderBy("order", "lang").limit(2 * per_language * len(names)).select("order", "lang", "text")
    rows = chosen.mapInArrow(_training_windows(windows), "order bigint, lang string, window binary").collect()
    rows.sort(key=lambda r: (r["order"], r["lang"], bytes(r["window"])))
    net = Network(names, units)
    number = {x: i for i, x in enumerate(names)}
    net.train([bytes(r["window"]) for r in rows], np.array([number[r["lang"]] for r in rows], dtype=np.int64), epochs)
    return net


def _predict(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches, most=1 << 19):
            letters = np.array([text is not None and any(map(str.isalpha, text)) for text in batch.column(2).to_pylist()])
            raw, offsets = C.string_bytes(batch.column(2))
            total = net.sums(raw, offsets)
            best = total.argmax(axis=1)
            score = total[np.arange(len(best)), best] / np.maximum(total.sum(axis=1), 1e-30)
            lang = [net.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(np.where(letters, np.minimum(score, 1.0), 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    docs needs doc_id, text and, where no trained network is given, lang. score is the mean
    probability of lang_pred over all byte positions of the whole text.

    Null text, and text without a letter: lang_pred und, score 0. A null doc_id is not held
    out and not learned from. Without any labelled document every text with a letter is und.
    Repeated rows are rows like others. Empty table: no rows. Other columns are not read.
    """
    net = net or fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
