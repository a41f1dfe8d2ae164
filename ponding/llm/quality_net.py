"""Quality by a convolutional network over bytes, in numpy.

Bytes are embedded; learned filters slide over chunks of 16 bytes, 8 apart, that cover the
whole document; each filter keeps its strongest response, and two dense layers combine
these into one probability. It is trained here, on the driver, on at most ``limit``
labelled rows and ``most_bytes`` bytes, of texts of up to ``longest`` bytes, and scores every whole text in one narrow pass.

Nulls: a null or empty text is one chunk of padding. Without labels every score is 0.5.
A null doc_id is never held out nor learnt from. Repeated rows get equal scores, long texts
are read whole, other columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ponding.llm.common import documents, table
from ponding.llm.labelled import LONGEST_LEARNT, MOST_BYTES, remainder, sample
from ponding.llm.words import slices

WIDTH, STEP, EMBED, FILTERS, HIDDEN = 16, 8, 6, 24, 12
#: Chunks that are scored at a time.
BLOCK = 1 << 15
Net = dict[str, np.ndarray]


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after the other, each padded with zeros to whole steps and one more; and where each one's chunks begin (len+1)."""
    size = np.diff(offsets)
    padded = STEP * np.maximum(-(-size // STEP), 1) + STEP
    begin = np.cumsum(padded) - padded
    out = np.zeros(int(padded.sum()) + WIDTH, np.uint8)
    for at, i, j in zip(begin.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        out[at : at + j - i] = data[i:j]
    return out, np.r_[begin, padded.sum()] // STEP


def chunks(net: Net, padded: np.ndarray, n: int) -> np.ndarray:
    """One row of embedded bytes per chunk, as overlapping views of one array."""
    flat = net["embed"][padded]
    return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * EMBED), (flat.strides[0] * STEP, flat.strides[1]))


def pooled(net: Net, padded: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest response of each filter in each document; all responses; the chunks."""
    x = np.ascontiguousarray(chunks(net, padded, int(first[-1])))
    act = x @ net["filters"]
    act[first[1:] - 1] = -np.inf  # the chunk that would reach into the next document
    return np.maximum.reduceat(act, first[:-1], axis=0), act, x


def strongest(net: Net, padded: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each document, of :data:`BLOCK` chunks at a time: memory does not grow with a text."""
    top = np.full((len(first) - 1, FILTERS), -np.inf, net["filters"].dtype)
    for i in range(0, int(first[-1]), BLOCK):
        j = min(i + BLOCK, int(first[-1]))
        act = chunks(net, padded[i * STEP : (j - 1) * STEP + WIDTH], j - i) @ net["filters"]
        a, b = int(np.searchsorted(first, i, "right")) - 1, int(np.searchsorted(first, j, "left"))
        last = first[a + 1 : b + 1] - 1
        act[last[last < j] - i] = -np.inf  # the chunk that would reach into the next document
        top[a:b] = np.maximum(top[a:b], np.maximum.reduceat(act, np.maximum(first[a:b] - i, 0), axis=0))
    return top


def head(net: Net, top: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the strongest responses, set against what a document of ``count`` chunks would reach, to a probability."""
    a = np.tanh(top + net["shift"] + np.outer(np.log(count) / 4, net["growth"]).astype(np.float32))
    h = np.tanh(a @ net["dense"] + net["dense_bias"])
    return a, h, 1 / (1 + np.exp(-np.clip(h @ net["out"] + net["out_bias"], -30, 30)))


def score_batch(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    padded, first = layout(data, offsets)
    return head(net, strongest(net, padded, first), np.diff(first) - 1)[2].astype(float)


def start(rng: np.random.Generator) -> Net:
    f = np.float32
    net = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
        "shift": np.full(FILTERS, -1.0),
        "growth": np.zeros(FILTERS),
        "dense": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)),
        "dense_bias": np.zeros(HIDDEN),
        "out": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "out_bias": np.zeros(1),
    }
    net = {k: v.astype(f) for k, v in net.items()}
    net["embed"][0] = 0
    return net


def gradients(net: Net, data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> Net:
    """Of the mean log loss of a batch. Only each filter's strongest chunk passes anything back."""
    padded, first = layout(data, offsets)
    top, act, x = pooled(net, padded, first)
    count = np.diff(first) - 1
    a, h, p = head(net, top, count)
    best = np.stack([act[i:j].argmax(0) + i for i, j in zip(first, first[1:])])
    dz = ((p - y) / len(y)).astype(np.float32)
    dh = np.outer(dz, net["out"]) * (1 - h**2)
    da = (dh @ net["dense"].T) * (1 - a**2)
    own = x[best]  # documents x filters x inputs
    dx = da[:, :, None] * net["filters"].T[None]
    at = padded[(best * STEP)[:, :, None] + np.arange(WIDTH)]
    embed = np.zeros_like(net["embed"])
    np.add.at(embed, at.ravel(), dx.reshape(-1, EMBED))
    embed[0] = 0
    return {"embed": embed, "filters": np.einsum("dfi,df->if", own, da), "shift": da.sum(0), "growth": (da * (np.log(count) / 4)[:, None].astype(np.float32)).sum(0), "dense": a.T @ dh, "dense_bias": dh.sum(0), "out": h.T @ dz, "out_bias": dz.sum(keepdims=True)}


def learn(rows: list[tuple[str, int]], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Net | None:
    """Adam, with the learning rate falling to nothing over the epochs."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    raw, y = [np.frombuffer(t.encode(), np.uint8) for t, _ in rows], np.array([v for _, v in rows], np.float32)
    net = start(rng)
    net["out_bias"][:] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    m, v = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2))
    steps, t = epochs * -(-len(raw) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(raw))
        for i in range(0, len(order), batch):
            which = order[i : i + batch]
            t += 1
            g = gradients(net, np.concatenate([raw[k] for k in which]), np.cumsum([0, *(len(raw[k]) for k in which)]), y[which])
            now = rate * (1 - t / (steps + 1)) / (1 - 0.9**t)
            for k in net:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net[k] -= (now * m[k] / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs: doc_id, text. One row per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in (x for b in batches for x in slices(b, 1_000_000)):
            net = shared.value
            value = np.full(part.num_rows, 0.5) if net is None else score_batch(net, data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(scored, "doc_id long, score double")


def op8_byte_network(spark, sf_dir: str, limit: int = 4_000, most_bytes: int = MOST_BYTES // 2, longest: int = LONGEST_LEARNT) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    rows = sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1, limit, most_bytes, longest)
    net = learn([(r.text, r.y) for r in sorted(rows.toLocalIterator(), key=lambda r: r.doc_id)])
    out = score(docs, net)
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
