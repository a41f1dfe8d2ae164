"""Toxicity by a counterfactually regularised classifier.

A logistic regression over hashed words and word beginnings. Labelled texts that name a
group get a counterfactual twin in which identity terms are swapped for others of the same
kind; the loss adds the squared difference of the twins' scores, so that a neutral mention
of a group can't carry weight. Features of at most ``limit`` labelled rows (and a bounded
number of bytes, see :func:`ponding.llm.labelled.sample`) are computed where the rows are;
the driver gets them as 32-bit bucket numbers and learns. One narrow pass scores every
whole text, and the twin of a text that names a group.

Nulls: a null or empty text gets the score of no features. Without labels the score is 0.
A null doc_id is never held out nor learnt from. Repeated rows get equal scores, long texts
are read whole, other columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ponding.llm.common import documents, table
from ponding.llm.labelled import LONGEST_LEARNT, MOST_BYTES, remainder, sample
from ponding.llm.words import NOT_ALNUM, Powers, Rolling, U, byte_values, separators, slices, word_spans

#: Identity terms by kind, for the languages of the documents (fixed values); a term is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives", "refugees"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("schwarze", "weiße"),
    ("schwule", "lesben"),
    ("einwanderer", "flüchtlinge"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("noirs", "blancs"),
    ("immigrés", "réfugiés"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("negros", "blancos"),
    ("inmigrantes", "refugiados"),
)
Terms = tuple[tuple[str, ...], ...]
BUCKETS, PREFIXES = 1 << 20, (3, 4, 5)
KEEP, VALUES = separators(NOT_ALNUM, lower=True), byte_values(lower=True)


def _hash_word(word: str) -> np.ndarray:
    data = np.frombuffer(word.encode(), np.uint8)
    return Rolling(VALUES[data], Powers()).spans(np.array([0]), np.array([len(data)]))


def swaps(terms: Terms = IDENTITY_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of identity terms, sorted, and of what each is swapped for."""
    pairs = [(t, kind[(i + 1) % len(kind)]) for kind in terms for i, t in enumerate(kind)]
    old, new = (np.concatenate([_hash_word(p[k]) for p in pairs]) for k in (0, 1))
    order = np.argsort(old)
    return old[order], new[order]


def features(data: np.ndarray, offsets: np.ndarray, powers: Powers, terms: tuple[np.ndarray, np.ndarray] | None = None, twins: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(document, bucket) of every feature present, each once; with ``twins`` also those of the swapped twins."""
    starts, ends = word_spans(data, offsets, KEEP)
    rolling = Rolling(VALUES[data], powers)
    whole = rolling.spans(starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1

    def present(words: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """plain: words whose beginnings count too, those that no twin swaps."""
        keys = [doc.astype(U) << U(20) | words % U(BUCKETS)]
        for n in PREFIXES:
            long = np.flatnonzero((ends - starts > n) & plain)
            begin = rolling.spans(starts[long], starts[long] + n) + U(n)
            keys.append(doc[long].astype(U) << U(20) | begin % U(BUCKETS))
        keys = np.concatenate(keys)
        keys.sort()
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
        return (keys >> U(20)).astype(np.int64), (keys & U(BUCKETS - 1)).astype(np.int64)

    terms = terms or swaps()
    at = np.minimum(np.searchsorted(terms[0], whole), len(terms[0]) - 1)
    named = terms[0][at] == whole
    if not twins:
        return *present(whole, ~named), None, None
    own = present(whole, ~named)
    return *own, *(present(np.where(named, terms[1][at], whole), ~named) if named.any() else own)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(doc, self.weights[bucket], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Example:
    """A label, the buckets of a text, and those of its twin where it names a group."""

    y: int
    own: np.ndarray
    twin: np.ndarray | None


def feature_rows(data: np.ndarray, offsets: np.ndarray, terms: Terms) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each document its buckets as 32-bit numbers, and its twin's where they differ."""
    doc, bucket, twin_doc, twin_bucket = features(data, offsets, Powers(), swaps(terms), twins=True)
    at = np.arange(len(offsets))
    cut, twin_cut = np.searchsorted(doc, at), np.searchsorted(twin_doc, at)
    for i in range(len(offsets) - 1):
        own, twin = bucket[cut[i] : cut[i + 1]].astype(np.uint32), twin_bucket[twin_cut[i] : twin_cut[i + 1]].astype(np.uint32)
        yield own, None if np.array_equal(own, twin) else twin


def examples(rows: DataFrame, terms: Terms = IDENTITY_TERMS) -> list[Example]:
    """rows: doc_id, text, y, a bounded sample. Their features, computed by the executors, in the order of doc_id."""

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in (x for b in batches for x in slices(b, 1_000_000)):
            own, twin = zip(*((a.tobytes(), None if b is None else b.tobytes()) for a, b in feature_rows(data, offsets, terms)), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(own, pa.binary()), pa.array(twin, pa.binary())], names=["doc_id", "y", "own", "twin"])

    got = [(r[0], Example(r[1], *(None if x is None else np.frombuffer(x, np.uint32) for x in r[2:]))) for r in rows.mapInArrow(compact, "doc_id long, y int, own binary, twin binary").toLocalIterator()]
    return [e for _, e in sorted(got, key=lambda x: x[0])]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling(rows: list[Example], y: np.ndarray, least_z: float) -> np.ndarray:
    """Which buckets' shares in the two labels differ by ``least_z`` standard errors."""
    n, count = len(y), np.zeros((2, BUCKETS))
    for label in (0, 1):
        own = [e.own for e in rows if e.y == label]
        for i in range(0, len(own), 256):
            count[label] += np.bincount(np.concatenate(own[i : i + 256]), minlength=BUCKETS)
    n1, n0 = max(y.sum(), 1), max(n - y.sum(), 1)
    share = (count[0] + count[1] + 1) / (n + 2)
    return np.abs(count[1] / n1 - count[0] / n0) >= least_z * np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))


def _flat(sets: list[np.ndarray], which: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place in used) of every feature of some of the documents."""
    own = [sets[i] for i in which.tolist()]
    return np.repeat(which, [len(x) for x in own]), np.searchsorted(used, np.concatenate([*own, np.zeros(0, np.uint32)]))


def learn(rows: list[Example], terms: Terms = IDENTITY_TERMS, steps: int = 200, rate: float = 0.08, ridge: float = 1e-5, fairness: float = 1.0, least_z: float = 4.0) -> Model:
    """Adam on log loss plus ridge plus ``fairness`` times the squared score change under swapping.

    Only features that tell the labels apart get a weight (:func:`telling`), and identity
    terms, which the penalty then holds down.
    """
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), -40.0)
    y = np.array([e.y for e in rows], float)
    n, prior = len(y), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    seen = telling(rows, y, least_z)
    seen[(swaps(terms)[0] % U(BUCKETS)).astype(np.int64)] = True
    own = [e.own[seen[e.own]] for e in rows]
    twin = [o if e.twin is None else e.twin[seen[e.twin]] for e, o in zip(rows, own, strict=True)]
    # Only texts whose twin differs take part in the penalty.
    changed = np.array([not np.array_equal(a, b) for a, b in zip(own, twin, strict=True)])
    used = np.unique(np.concatenate([*own, *(twin[i] for i in np.flatnonzero(changed))]))
    if not len(used):
        return Model(np.zeros(BUCKETS, np.float32), prior)
    doc, compact = _flat(own, np.arange(n), used)
    own_doc, own_bucket = _flat(own, np.flatnonzero(changed), used)
    twin_doc, twin_bucket = _flat(twin, np.flatnonzero(changed), used)
    w, bias = np.zeros(len(used)), prior
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        p = sigmoid(np.bincount(doc, w[compact], n) + bias)
        grad = np.bincount(compact, ((p - y) / n)[doc], len(used)) + ridge * w
        if changed.any():
            q = sigmoid(np.bincount(twin_doc, w[twin_bucket], n) + bias)
            gap = np.where(changed, 2 * fairness * (p - q) / n, 0)
            grad += np.bincount(own_bucket, (gap * p * (1 - p))[own_doc], len(used)) - np.bincount(twin_bucket, (gap * q * (1 - q))[twin_doc], len(used))
        grad = np.r_[grad, (p - y).mean()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


def score(docs: DataFrame, model: Model, terms: Terms = IDENTITY_TERMS) -> DataFrame:
    """docs: doc_id, text. One row per document: doc_id, score, twin_score (after swapping its identity terms; equal without any)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, swap, own = Powers(), swaps(terms), Model(*shared.value)
        for part, data, offsets in (x for b in batches for x in slices(b, 1_000_000)):
            doc, bucket, twin_doc, twin_bucket = features(data, offsets, powers, swap, twins=True)
            both = [pa.array(own.score(d, b, part.num_rows)) for d, b in ((doc, bucket), (twin_doc, twin_bucket))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *both], names=["doc_id", "score", "twin_score"])

    return docs.mapInArrow(scored, "doc_id long, score double, twin_score double")


def op6_toxicity(spark, sf_dir: str, limit: int = 10_000, most_bytes: int = MOST_BYTES, terms: Terms = IDENTITY_TERMS, longest: int = LONGEST_LEARNT) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    model = learn(examples(sample(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2, limit, most_bytes, longest), terms), terms)
    out = score(docs, model, terms)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "twin_score")
