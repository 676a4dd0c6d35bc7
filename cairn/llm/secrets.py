"""Secret scan: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Every maximal run of at least ``min_length`` characters of ``[A-Za-z0-9+/_-]`` gets an inferred encoding (hex, base32,
lower alphanumeric, base64 or base64url); one that fits no alphabet, since it has signs of base64 and of base64url, is
split at the signs of the one and of the other, and of the parts of at least ``min_length`` characters those of the highest
p-values that don't overlap are runs.  Each run gets three tests of the hypothesis that its symbols are drawn at random from
that alphabet: chi-squared uniformity of the symbol counts and of their classes (letter cases, digits, signs), the number of runs above and below the middle of the
alphabet, and the lag-1 serial correlation of the symbols.  The smallest of their p-values is a statistic whose distribution
for random strings is simulated, with a fixed seed, for each encoding and length band; the combined p-value is read off
that, so it is uniform for random strings, and near 0 for words and paths.  For each encoding and length band the share of random strings among all runs is read off the
upper half of the p-values, and the smallest cut-off is taken at which the expected share of non-random runs among the
reported ones stays below ``fdr``.  Fewer than ``FEW`` runs are too few to estimate from: a cell of fewer has the cut-off
``least_p``, one with fewer above its lowest bin of p-values at most the end of that bin, so a lone secret stays.

The histogram behind the cut-offs has at most 5 x 6 x 20 cells whatever the input; everything else is one pass over the texts.

Null and empty texts give no span; very long texts are scanned whole; repeated rows and rows with equal doc_id give one result
row each, also those without doc_id; spans of several kinds at one place all stay, in the order of KINDS, and of parts of a run
with equal p-values the first is taken; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import rows_of, texts, written

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # greedy runs: the same matches as [0-9a-f]+ of 16 and more
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
PARTS = (re.compile(r"[A-Za-z0-9+/]{20,}"), re.compile(r"[A-Za-z0-9_-]{20,}"))
KINDS = ("assign", "access", "hex", "random")

#: Alphabets in the order in which they are tried; the first that holds all characters is the inferred encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_CLASSES = {k: [sum(_class(c) == i for c in v) / len(v) for i in range(4)] for k, v in ALPHABETS.items()}
BANDS = (24, 32, 40, 64, 128)
BINS = 20
FEW = 20
SIMULATED = 4_000  # random strings behind each cell's distribution

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<s:int,k:int,e:int>>, found array<struct<s:int,k:int,e:int,g:string,p:double>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _upper_chi2(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson and Hilferty's cube root)."""
    s = 2 / (9 * k)
    return 0.5 * math.erfc(((max(x, 1e-12) / k) ** (1 / 3) - 1 + s) / math.sqrt(2 * s))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding(token: str) -> str | None:
    has = set(token)
    return next((k for k, v in _INDEX.items() if has <= v.keys()), None)


def runs_of(token: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, p) of the token itself, or of its parts if no alphabet holds it, outside the spans taken."""
    whole = encoding(token)
    parts = {(0, len(token)): token} if whole else {m.span(): m[0] for p in PARTS for m in p.finditer(token)}
    free = [(s, e, t) for (s, e), t in parts.items() if not any(x < e and s < y for x, y in taken)]
    tested = sorted((-battery(t, k), s, e, k) for s, e, t in free if (k := whole or encoding(t)))
    out: list[tuple[int, int, str, float]] = []
    for p, s, e, k in tested:
        if not any(x < e and s < y for x, y, _, _ in out):
            out.append((s, e, k, -p))
    return sorted(out)


def battery(token: str, kind: str) -> float:
    """Combined p-value of the three tests under 'symbols are drawn at random from this encoding's alphabet'."""
    null = _null(kind, band(len(token)))
    return bisect_right(null, statistic(token, kind)) / len(null)


def band(n: int) -> int:
    return sum(n >= x for x in BANDS)


@lru_cache(maxsize=None)
def _null(kind: str, number: int) -> tuple[float, ...]:
    """The sorted statistics of random strings of an encoding and a length band."""
    edges = (20, *BANDS, 2 * BANDS[-1])
    rng, out = np.random.default_rng([7, number, list(ALPHABETS).index(kind)]), []
    lengths = np.unique(np.linspace(edges[number], edges[number + 1] - 1, 8).astype(int))
    for n in lengths.tolist():
        out.append(statistics(rng.integers(0, len(ALPHABETS[kind]), (SIMULATED // len(lengths), n)), kind))
    return tuple(np.sort(np.concatenate(out)).tolist())


_erfc = np.vectorize(math.erfc, otypes=[float])


def statistics(at: np.ndarray, kind: str) -> np.ndarray:
    """statistic() of many strings of one length, given as rows of places in the alphabet."""
    (m, n), size, alphabet = at.shape, len(ALPHABETS[kind]), ALPHABETS[kind]

    def chi(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        x, k = ((counts - n * shares) ** 2 / (n * shares)).sum(1), len(shares) - 1
        s = 2 / (9 * k)
        return 0.5 * _erfc((np.cbrt(np.maximum(x, 1e-12) / k) - 1 + s) / math.sqrt(2 * s))

    two = lambda z: _erfc(np.abs(z) / math.sqrt(2))
    tally = lambda x, k: np.bincount((np.arange(m)[:, None] * k + x).ravel(), minlength=m * k).reshape(m, k)
    symbols = chi(tally(at, size), np.full(size, 1 / size))
    shares = np.array(_CLASSES[kind])
    if (shares > 0).sum() > 1:
        counts = tally(np.array([_class(c) for c in alphabet])[at], 4)
        symbols = 2 * np.minimum(symbols, chi(counts[:, shares > 0], shares[shares > 0]))
    high = 2 * at >= size
    a = high.sum(1)
    b = n - a
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    mean = 1 + 2 * a * b / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        by_runs = np.where(spread > 0, two(np.nan_to_num((runs - mean) / np.sqrt(np.maximum(spread, 0)))), 1.0)
        halves = np.where((a > 0) & (b > 0), 2 * np.minimum(by_runs, two((a - b) / math.sqrt(n))), 2.0 ** (1 - n))
        off = at - at.mean(1, keepdims=True)
        around = (off**2).sum(1)
        serial = np.where(around > 0, two(np.nan_to_num((off[:, 1:] * off[:, :-1]).sum(1) / around * math.sqrt(n))), 0.0)
    return np.minimum(np.minimum(symbols, halves), serial)


def statistic(token: str, kind: str) -> float:
    """The smallest p-value of the three tests, each doubled where it is the smaller one of two."""
    index, n = _INDEX[kind], len(token)
    at, size = [index[c] for c in token], len(index)
    counts: dict[int, int] = {}
    for i in at:
        counts[i] = counts.get(i, 0) + 1
    p_chi = _upper_chi2(sum(c * c for c in counts.values()) * size / n - n, size - 1)
    kinds = [0] * 4
    for c in token:
        kinds[_class(c)] += 1
    shares = [(k, s) for k, s in zip(kinds, _CLASSES[kind]) if s]
    if len(shares) > 1:
        p_chi = 2 * min(p_chi, _upper_chi2(sum((k - n * s) ** 2 / (n * s) for k, s in shares), len(shares) - 1))
    high = [2 * i >= size for i in at]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    if a and b:
        mean = 1 + 2 * a * b / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        # how one-sided the string is counts as well: random strings have about n/2 symbols of each half
        p_runs = 2 * min(_two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0, _two_sided((a - b) / math.sqrt(n)))
    else:
        p_runs = 2.0 ** (1 - n)
    m = sum(at) / n
    around = sum((i - m) ** 2 for i in at)
    p_serial = _two_sided(sum((x - m) * (y - m) for x, y in zip(at, at[1:])) / around * math.sqrt(n)) if around else 0.0
    return min(p_chi, p_runs, p_serial)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string())]
        + [("base", pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))), ("found", pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("g", pa.string()), ("p", pa.float64())])))]
    )
    for batch in batches:
        for part in rows_of(batch):
            out: list[tuple] = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                base = base_spans(text)
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                found, starts, reach = [], [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
                for m in TOKEN.finditer(text):
                    near = base[bisect_right(reach, m.start()) : bisect_left(starts, m.end())]
                    for s, e, kind, p in runs_of(m[0], [(x - m.start(), y - m.start()) for x, _, y in near]):
                        found.append({"s": m.start() + s, "k": 3, "e": m.start() + e, "g": f"{kind}/{band(e - s)}", "p": p})
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((doc_id, *n, hashlib.sha256(joined.encode()).hexdigest(), [{"s": s, "k": k, "e": e} for s, k, e in base], found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def cut_offs(cells: list[tuple[str, int, int]], fdr: float, least_p: float) -> dict[str, float]:
    """Per group the smallest p above which at most a share fdr of the runs is expected not to be random.

    cells: (group, bin of p, count).  Random strings fill the bins evenly, so twice the upper half estimates their number; one
    more in it (Storey's estimator) keeps the estimate above 0.  The lowest two cut-offs also hold if fewer than FEW runs are above.
    """
    groups: dict[str, list[int]] = {}
    for g, b, n in cells:
        groups.setdefault(g, [0] * BINS)[min(b, BINS - 1)] += n
    out = {}
    for g, bins in groups.items():
        random = 2 * (sum(bins[BINS // 2 :]) + 1)
        for b in range(BINS):
            over = sum(bins[b:])
            if not over or (b < 2 and over < FEW) or 1 - random * (1 - b / BINS) / over <= fdr:
                break
        out[g] = max(least_p, b / BINS)
    return out


def secret_scan(docs: DataFrame, fdr: float = 0.1, least_p: float = 0.01) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (array of s, k, e; k numbers KINDS)."""
    scanned = written(texts(docs).mapInArrow(_scan, SCHEMA), "secrets")
    cells = scanned.select(F.explode("found").alias("f")).groupBy(F.col("f.g").alias("g"), F.floor(F.col("f.p") * BINS).cast("int").alias("b")).count().collect()  # at most 600 rows
    cuts = cut_offs([tuple(r) for r in cells], fdr, least_p)
    cut = F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]) if cuts else None
    reported = F.filter("found", lambda f: f["p"] > cut[f["g"]]) if cuts else F.filter("found", lambda f: F.lit(False))
    spans = F.array_sort(F.concat("base", F.transform(reported, lambda f: F.struct(f["s"].alias("s"), f["k"].alias("k"), f["e"].alias("e")))))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])
    return found.withColumn("spans", F.array_join(F.transform("spans", one), ","))
