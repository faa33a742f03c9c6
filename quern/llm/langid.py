"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte bigrams and trigrams (A-Z folded, digits
and ASCII punctuation left out), damped by square root, weighed by inverse document frequency and normalised. Each
language's sample is clustered by spherical k-means into CENTROIDS directions; a
text takes the language of the centroid with the largest cosine. It is rejected
if that cosine is below a share of what beginnings of about as many n-grams of the
language's own sample reach, but for the lowest few, which is where no known language
is near. So junk in the sample sets no bound, and short texts have lower ones.

The classifier is fitted on at most SAMPLE labelled rows, dealt evenly to the
languages; it is a few megabytes and is broadcast. Prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import pieces, text_buffer

DIMENSIONS = 4096
SAMPLE = 3200
CENTROIDS = 4
#: A text is rejected below REJECT times the QUANTILE of the cosines of beginnings of its size.
REJECT = 0.5
QUANTILE = 0.05
#: Characters in the beginnings of sampled texts that set the bounds; whole texts count too.
CUTS = [2**j for j in range(1, 14)]
#: Sizes in n-grams, by powers of two; the last holds all above.
SIZES = 16
#: A size of fewer texts sets no bound, if there is one of as many.
FEW = 40
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_SKIP = np.zeros(256, bool)
_SKIP[:128] = True
_SKIP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, *range(65, 91), *range(97, 123)]] = False


def vectors(column: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The counts of hashed n-grams of each text, under the square root."""
    data, offs = text_buffer(column)
    n = len(offs) - 1
    if not len(data):
        return np.zeros((n, dimensions), np.float32)
    doc = np.repeat(np.arange(n), np.diff(offs))
    keep = ~_SKIP[data]
    b, doc = _FOLD[data[keep]], doc[keep] * dimensions
    two = b[:-1] * 256 + b[1:]
    three = two[:-1] * 256 + b[2:]
    cell = lambda x: (x * 0x9E3779B1 & 0xFFFFFFFF) >> 16 & dimensions - 1
    same2, same3 = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    at = np.concatenate([(doc[:-1] + cell(two + 1))[same2], (doc[:-2] + cell(three + (7 << 24)))[same3]])
    return np.sqrt(np.bincount(at, minlength=n * dimensions)).astype(np.float32).reshape(n, dimensions)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _sizes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of n-grams that the vectors x count, and the power of two below."""
    n = np.square(x, dtype=np.float64).sum(1).round()
    return n, np.minimum(np.log2(np.maximum(n, 1)).astype(int), SIZES - 1)


@dataclass
class Model:
    """least: by language and size, the cosine below which a text is rejected; one without an n-gram has nothing against it."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, and whether it is rejected, for each text. Null, and no letter: und, 0, rejected."""
        n = len(column)
        texts = column.to_pylist()
        letter = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        x = vectors(column, len(self.idf))
        near = _unit(x * self.idf) @ self.centroids.T
        best = near.argmax(1)
        lang = self.owner[best]
        score = np.where(letter, np.clip(near[np.arange(n), best], 0, 1), 0).astype(np.float64)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(lang, letter, strict=True)]
        grams, size = _sizes(x)
        return names, score, ~letter | (score < np.where(grams > 0, self.least[lang, size], 0))


def _cluster(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; a centroid that loses all its vectors goes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    at = [int(rng.integers(len(x)))]
    for _ in range(min(k, len(x)) - 1):
        at.append(int((x @ x[at].T).max(1).argmin()))
    c = x[at]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[own == j].sum(0) for j in np.unique(own)]))
    return c


def _measure(model: Model):
    """(lang, size, cosine) of each labelled text's beginnings and the whole text, with its own language's centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            text, y = part.column("text"), np.array([model.languages.index(v) for v in part.column("lang").to_pylist()])
            length = pc.utf8_length(text).to_numpy(zero_copy_only=False)
            for cut in [*CUTS, None]:
                ok = length > (cut or 0)
                x = vectors(text if cut is None else pc.utf8_slice_codeunits(text, 0, cut))
                grams, size = _sizes(x)
                near = _unit(x * model.idf) @ model.centroids.T
                cosine = np.where(model.owner == y[:, None], near, -1).max(1).astype(np.float64)
                ok &= grams > 0
                yield pa.RecordBatch.from_arrays([pa.array(y[ok], pa.int32()), pa.array(size[ok], pa.int32()), pa.array(cosine[ok])], names=["lang", "size", "cosine"])

    return run


def _bounds(rows: list, languages: int, reject: float) -> np.ndarray:
    """By language and size; none is above that of a larger size, and sizes of too few texts take that of the next larger, else the next smaller."""
    lang, size, cosine = (np.array([r[c] for r in rows]) for c in ("lang", "size", "cosine"))
    out = np.zeros((languages, SIZES))
    for k in range(languages):
        low, last = np.full(SIZES, np.inf), 0.0
        of = [cosine[(lang == k) & (size == j)] if len(rows) else [] for j in range(SIZES)]
        least = min(FEW, max(1, *map(len, of)))
        for j in range(SIZES):
            if len(of[j]) >= least:
                low[j] = last = reject * max(0.0, np.quantile(of[j], QUANTILE))
        low[-1] = min(low[-1], last)
        out[k] = np.minimum.accumulate(low[::-1])[::-1]
    return out


def train(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, reject: float = REJECT, seed: int = 5) -> Model:
    """Fit on labelled (doc_id, text, lang): rows with a null text or lang teach nothing. No rows: a model that knows no language."""
    known = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(sample).collect()}
    if not counts:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros((0, SIZES)))
    each = max(1, sample // len(counts))
    # keep a little over `each` rows of a language by hash before any are ranked
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.3 * (each + 30) / n))])
    point = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    some = known.where(point <= F.element_at(share, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    some = some.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "lang", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            rows = [r.tobytes() for r in vectors(part.column("text")).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "lang", "x"])

    rows = sorted(some.mapInArrow(featurise, "doc_id long, lang string, x binary").collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    languages = sorted(counts)
    y = np.array([languages.index(r["lang"]) for r in rows])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = _unit(x * idf)
    parts = [_cluster(x[y == k], centroids, seed) for k in range(len(languages)) if (y == k).any()]
    owner = np.concatenate([[k] * len(p) for k, p in zip((k for k in range(len(languages)) if (y == k).any()), parts, strict=True)])
    c = np.concatenate(parts).astype(np.float32)
    model = Model(languages, idf, c, owner, np.zeros((len(languages), SIZES)))
    measured = some.select("lang", "text").mapInArrow(_measure(model), "lang int, size int, cosine double").collect()
    model.least = _bounds(measured, len(languages), reject)
    return model


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if none are named), with lang_pred string, score double, rejected boolean.

    Only text is looked at. Null text, or one without a letter: und, 0, rejected.
    Columns of docs named lang_pred, score or rejected give way to the new ones.
    """
    new = ["lang_pred", "score", "rejected"]
    docs = docs.drop(*new)
    kept = [c for c in (keep or docs.columns) if c not in new]
    docs = docs.select(*dict.fromkeys([*kept, "text"]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            lang, score, rejected = shared.value.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*kept, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
