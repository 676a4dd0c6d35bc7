"""Language identification by a byte convolutional network, trained and run in numpy.

Texts are cut into windows of ``WINDOW`` bytes, A-Z lower-cased.  A window's bytes are embedded, convolved with filters of
several widths, rectified, max-pooled over the window and classified by softmax.  A document's language has the largest
mean log-probability over all its windows; its score is that language's mean probability.

The fit reads at most ``train_docs`` documents of each language, chosen by a hash of doc_id, and ``train_windows`` windows
of each, spread over the text; prediction reads every window of every text.

Null texts, empty ones and those without a letter (Unicode category L) are ``und`` with score 0; very long texts are whole;
rows with equal doc_id are predicted each, and those without one are not held out; of languages with equal scores the first
in order is taken; without labelled rows every text is ``und``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.shared import rows_of, sized, texts, trim, written

WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
LETTER = regex.compile(r"\p{L}")


def windows(text: str) -> np.ndarray:
    """(n, WINDOW) bytes of the whole text; the last window is filled with zeros."""
    data = np.frombuffer(text.encode().lower(), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


class ByteNetwork:
    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        size = FILTERS * len(WIDTHS)
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (size, len(classes))), "bias": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
            self.p[f"shift{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Pooled activations of byte windows, and what the gradient needs."""
        e = self.p["embed"][x]
        e[x == 0] = 0  # the filling of last windows
        flat, pooled, kept = np.ascontiguousarray(e.reshape(len(x), -1)), [], {}
        for w in WIDTHS:
            n = WINDOW - w + 1
            cols = np.lib.stride_tricks.as_strided(flat, (len(x), n, w * EMBED), (flat.strides[0], 4 * EMBED, 4))
            a = np.ascontiguousarray(cols).reshape(-1, w * EMBED) @ self.p[f"conv{w}"]
            a = a.reshape(len(x), n, FILTERS)
            at = a.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(a, at[:, None, :], 1)[:, 0] + self.p[f"shift{w}"], 0))
            kept[w] = (at, cols)
        return np.concatenate(pooled, 1), kept

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self._pool(x)[0] @ self.p["out"] + self.p["bias"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, kept = self._pool(x)
        z = pooled @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": pooled.T @ d, "bias": d.sum(0), "embed": np.zeros_like(self.p["embed"])}
        back = (d @ self.p["out"].T) * (pooled > 0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            at, cols = kept[w]
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            seen = cols[rows, at]  # the inputs under each filter's largest activation
            g[f"conv{w}"] = np.einsum("nf,nfc->cf", part, seen, optimize=True)
            g[f"shift{w}"] = part.sum(0)
            into = part[:, :, None] * self.p[f"conv{w}"].T[None]
            for k in range(w):
                np.add.at(g["embed"], x[rows, at + k], into[:, :, k * EMBED : (k + 1) * EMBED])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, least_steps: int = 400) -> ByteNetwork:
        """Adam; few windows are seen more often, until there are least_steps steps."""
        rng, step = np.random.default_rng(11), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        batches = -(-len(x) // batch)
        epochs = max(epochs, -(-least_steps // batches))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                slower = rate / (1 + 5 * step / (epochs * batches))
                step += 1
                for k, g in self.gradients(x[order[at : at + batch]], y[order[at : at + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (slower * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, learn: Column | None = None, train_docs: int = 1_000, train_windows: int = 4) -> ByteNetwork | None:
    """A network from rows with text and lang for which learn holds."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")) if learn is None else learn)
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    # about 4 train_docs rows of each language, the lowest of their hashes, are all that is ranked, however many there are
    share = written(ids.groupBy("lang").agg((F.lit(4.0 * train_docs) / F.count("*")).alias("share")), "language-shares")
    low = ids.join(sized(share), "lang").filter((F.xxhash64("doc_id") / F.lit(2.0**63) + 1) / 2 <= F.col("share")).drop("share")
    best = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = written(low.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= train_docs).drop("r"), "language-chosen")  # train_docs rows a language

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                w = windows(text)
                out.append(w[np.unique(np.linspace(0, len(w) - 1, train_windows).astype(int))].tobytes() if LETTER.search(text) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "windows"])

    got = texts(docs).join(sized(chosen), "doc_id").select("lang", "text").mapInArrow(spread, "lang string, windows binary").collect()
    got = sorted((r["lang"], bytes(r["windows"])) for r in got if r["windows"])
    classes = sorted({k for k, _ in got})
    if not classes:
        return None
    x = np.concatenate([np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for _, w in got])
    y = np.concatenate([np.full(len(w) // WINDOW, classes.index(k)) for k, w in got])
    return ByteNetwork(classes).train(x, y)


def predict(docs: DataFrame, model: ByteNetwork | None, block: int = 512) -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 128):
                cut, langs, scores = [], [], []
                for text in part.column(1).to_pylist():
                    cut.append(windows(text) if model and LETTER.search(text) else None)
                every = np.concatenate([w for w in cut if w is not None]) if any(w is not None for w in cut) else np.zeros((0, WINDOW), np.uint8)
                logs = [model.log_probabilities(every[a : a + block]) for a in range(0, len(every), block)]
                logs, at = np.concatenate(logs) if logs else None, 0
                for w in cut:
                    if w is None:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    own = logs[at : at + len(w)].astype(np.float64)
                    at += len(w)
                    best = int(own.mean(0).argmax())
                    langs.append(model.classes[best])
                    scores.append(float(min(1.0, np.exp(own[:, best]).mean())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
