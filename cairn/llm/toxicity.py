"""Toxicity by compression distance: a zstandard dictionary of each class, window by window.

zstandard trains one dictionary on windows of ordinary labelled text, and one on what is typical of toxic labelled text: the
words of its documents that hold a string of 5 to 8 bytes whose document frequency is far above that in ordinary documents (if
those are too few to train on, all its words).  Lengths with the ordinary dictionary are compared with those when the toxic
one is added to it, so both know the language alike and differ in what tells the classes apart.  A window is one word, without the marks at its ends, in a fixed frame of frequent words; in the frame every window
compresses to a proper block, where bare short windows are stored raw.  Its distance is the difference of its two compressed
lengths.  A document's features are the mean distance, its largest value, and shares and counts of windows above the
thresholds 1 to 4; a logistic regression on other labelled documents, weighted to the labels' true shares, calibrates what
exceeding each threshold means.

The fit reads at most ``train_docs`` documents of each class, chosen by a hash of doc_id, and at most ``train_words`` words
of each, spread over the text; scoring reads every word of every text.  Distances of distinct words are remembered, in
arrays of at most ``MEMORY`` bytes.

Null and empty texts have a single empty window and get a score; very long texts are whole; rows with equal doc_id are
scored each; a null doc_id isn't held out; with no labelled documents of one class all scores are 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import blocks, texts, trim, written

BEFORE, AFTER = b" the and of to in is it that ", b" der die und le la de que "
LEVEL, MATCH = 19, 5
BASE_BYTES, OWN_BYTES = 32_768, 8_192
MEMORY = 16 << 20
MARKS = ".,!?;:%$&#*()[]\"'"
THRESHOLDS = (1, 2, 3, 4)
FEATURES = 3 + 2 * len(THRESHOLDS)


def _words(text: str | None) -> list[bytes]:
    return [w.strip(MARKS.encode()) for w in (text or "").encode().lower().split()]


def _grams(word: bytes) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + k] for k in (5, 6, 7, 8) for i in range(len(padded) - k + 1)}


def _trained(size: int, docs: list[list[bytes]], group: int = 8) -> bytes | None:
    """What zstandard trains on windows of the documents' words; None if they are too few for it."""
    windows = [b" " + b" ".join(words[i : i + group]) + b" " for words in docs for i in range(0, len(words), group)]
    try:
        return zstandard.train_dictionary(size, windows, k=16, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], least_docs: int = 5, least_odds: float = 2.0) -> tuple[bytes, bytes]:
    """(ordinary, ordinary and toxic) dictionaries from the words of labelled documents."""
    counts = []
    for docs in (toxic, ordinary):
        of: Counter[bytes] = Counter()
        for words in docs:
            seen: set[bytes] = set()
            for w in set(words):
                seen |= _grams(w)
            of.update(seen)
        counts.append(of)
    odds = lambda g, n: math.log((n + 0.5) / (len(toxic) + 1) / ((counts[1][g] + 0.5) / (len(ordinary) + 1)))
    typical = {g for g, n in counts[0].items() if n >= least_docs and odds(g, n) > least_odds}
    chosen = [[w for w in words if not typical.isdisjoint(_grams(w))] for words in toxic]
    # plain content where there is too little to train on
    base = _trained(BASE_BYTES, ordinary) or b" ".join(w for words in ordinary for w in words)[:BASE_BYTES]
    own = _trained(OWN_BYTES, chosen) or _trained(OWN_BYTES, toxic) or b" ".join(w for words in toxic for w in words)[:OWN_BYTES]
    # the frame at the end, so that nothing of the classes is among the last bytes, which aren't indexed
    return base + BEFORE + AFTER, base + own + BEFORE + AFTER


class Distance:
    """(ordinary - toxic) compressed length of the words of texts in the frame."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, min_match=MATCH, window_log=18)
        self.pack = []
        for data in (ordinary, toxic):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(compression_params=params)
            self.pack.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))
        self.words, self.known = pa.array([], pa.large_string()), np.zeros(0, np.int16)

    def _window(self, word: str) -> int:
        window = BEFORE + word.encode() + AFTER
        return len(self.pack[0].compress(window)) - len(self.pack[1].compress(window))

    def _distinct(self, words: pa.Array) -> np.ndarray:
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = words.filter(pa.array(at < 0))
        at[at < 0] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, new])
        self.known = np.concatenate([self.known, np.fromiter(map(self._window, new.to_pylist()), np.int16, len(new))])
        out = self.known[at]
        if self.words.nbytes + self.known.nbytes > MEMORY:
            self.words, self.known = (words, out) if words.nbytes + out.nbytes <= MEMORY else (words[:0], out[:0])
        return out

    def of(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(distances of the words one after the other, number of words of each text); an empty text has one empty word."""
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(part)))
        words = split.flatten().dictionary_encode()
        bare = pc.utf8_trim(words.dictionary, characters=MARKS).dictionary_encode()
        return self._distinct(bare.dictionary)[bare.indices.to_numpy()][words.indices.to_numpy()], pc.list_value_length(split).to_numpy()

    def features(self, column: pa.Array) -> np.ndarray:
        """A row of features for each text."""
        out = [np.zeros((0, FEATURES))]
        for part in blocks(column, 2 << 20):
            d, n = self.of(part)
            at = np.cumsum(n) - n
            above = [np.add.reduceat((d >= k).astype(np.int64), at) for k in THRESHOLDS]
            out.append(np.stack([np.maximum.reduceat(d, at), np.add.reduceat(d, at, dtype=np.int64) / n, *(x / n for x in above), *(np.log1p(x) for x in above), np.log(n)], 1))
        return np.concatenate(out)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the intercept last), by Newton's steps with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z.T * (weight * p * (1 - p))) @ z + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (weight * (y - p)) - 0.1 * w)
    return mean, scale, w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Model:
    """What a fit gives; it is sent to the workers as it is."""

    def __init__(self, ordinary: bytes, toxic: bytes, mean: np.ndarray | None = None, scale: np.ndarray | None = None, w: np.ndarray | None = None):
        self.ordinary, self.toxic, self.mean, self.scale, self.w = ordinary, toxic, mean, scale, w

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, train_docs: int = 3_000, train_words: int = 512) -> Model:
    """Half of the chosen documents make the dictionaries, the other half the calibration."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")) if learn is None else learn)
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return Model(b"", b"")
    part = lambda y: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    chosen = part(1).unionByName(part(0)).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)))
    chosen = written(texts(docs).join(F.broadcast(chosen), "doc_id"), "toxicity-chosen")  # 2 train_docs rows

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = _words(text)
                groups = -(-len(words) // 8)
                step = max(1.0, groups / (train_words // 8))
                out.append(b" ".join(w for g in range(min(groups, train_words // 8)) for w in words[8 * int(g * step) : 8 * int(g * step) + 8]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["toxic", "words"])

    got = sorted(tuple(r) for r in chosen.filter("half = 0").select("toxic", "text").mapInArrow(spread, "toxic int, words binary").collect())
    model = Model(*train_dictionaries(*([bytes(w).split() for t, w in got if t == kind] for kind in (1, 0))))
    seen = sorted(tuple(r) for r in _featured(chosen.filter("half = 1").select("toxic", "text"), model).collect())
    x, y = np.array([f for _, f in seen]).reshape(-1, FEATURES), np.array([t for t, _ in seen])
    if len(set(y.tolist())) == 2:
        weight = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum())) * len(y) / (shares[0] + shares[1])
        model.mean, model.scale, model.w = logistic(x, y, weight)
    return model


def _featured(rows: DataFrame, model: Model) -> DataFrame:
    """features of (toxic, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(distance.features(batch.column(1)).tolist(), pa.list_(pa.float64()))], names=["toxic", "features"])

    return rows.mapInArrow(run, "toxic int, features array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic) if model.w is not None else None
        for batch in batches:
            scores = model.scores(distance.features(batch.column(1))) if distance else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])
        del distance
        trim()

    return texts(docs).mapInArrow(run, "doc_id long, score double")
