"""The two classifiers: what they learn, on which rows, and what their queries return."""

import random
import zlib

import numpy as np
import pytest

from ponding.llm import labelled, quality_net, toxicity

RESULT = ["doc_id", "held_out", "score", "predicted"]


def learnt(rows, **options):
    raw = [t.encode() for t, _ in rows]
    found = toxicity.feature_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), toxicity.IDENTITY_TERMS)
    return toxicity.learn([toxicity.Example(y, own, twin) for (_, y), (own, twin) in zip(rows, found, strict=True)], **options)


def test_toxicity_is_learnt_and_fair():
    rng = random.Random(2)
    filler = [f"word{k}" for k in range(200)]
    rows = []
    for i in range(1500):
        words = rng.sample(filler, 30)
        toxic = int(i % 5 == 0)
        if toxic and rng.random() < 0.6:
            words[3] = rng.choice(["vilestuff", "vilething"])
        if rng.random() < (0.6 if toxic else 0.05):
            words[5] = "muslim"  # named far more often in toxic texts
        rows.append((" ".join(words), toxic))

    def scores(model, texts):
        raw = [t.encode() for t in texts]
        d, b, *_ = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), toxicity.Powers())
        return model.score(d, b, len(raw))

    neutral = " ".join(rng.sample(filler, 30))
    texts = [neutral + " vilething", neutral, neutral + " muslim", neutral + " christian"]
    fair, unfair = (scores(learnt(rows, fairness=f), texts) for f in (30.0, 0.0))
    assert fair[0] > 0.5 and fair[1] < 0.3
    assert abs(fair[2] - fair[3]) < 0.5 * abs(unfair[2] - unfair[3])
    assert toxicity.learn([]).score(np.zeros(0, int), np.zeros(0, int), 2).max() < 1e-6


def test_quality_network_learns():
    rng = random.Random(3)
    clean = lambda: " ".join(rng.choice(["lorem", "ipsum,", "dolor", "sit", "amet."]) for _ in range(rng.randint(20, 80)))
    junk = lambda: "".join(rng.choice("#*$%&") for _ in range(rng.randint(60, 300)))
    rows = [((clean() + junk(), 0) if i % 3 == 0 else (clean(), 1)) for i in range(240)]
    net = quality_net.learn(rows, epochs=6)
    raw = [t.encode() for t, _ in [(clean() + " " + junk() + clean(), 0), (clean(), 1), ("", 1)]]
    s = quality_net.score_batch(net, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert s[0] < 0.5 < s[1] and 0 <= s[2] <= 1


def test_blocks_of_chunks_give_the_same(monkeypatch):
    """Texts of all lengths, one of a megabyte: the largest responses do not depend on the blocks."""
    rng = np.random.default_rng(5)
    net = quality_net.start(rng)
    raw = [rng.integers(1, 255, n, np.uint8).tobytes() for n in (0, 1, 7, 8, 9, 15, 16, 17, 100, 1_000_003, 0, 333, 64)]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    padded, first = quality_net.layout(data, offsets)
    want = quality_net.pooled(net, padded, first)[0]
    for block in (1, 3, 64, 1 << 15, 1 << 22):
        if block > 3:
            monkeypatch.setattr(quality_net, "BLOCK", block)
            assert np.allclose(quality_net.strongest(net, padded, first), want, atol=1e-6)
    small = np.cumsum([0, *map(len, raw[:9])])
    padded, first = quality_net.layout(data[: small[-1]], small)
    for block in (1, 2, 3, 5):
        monkeypatch.setattr(quality_net, "BLOCK", block)
        assert np.allclose(quality_net.strongest(net, padded, first), quality_net.pooled(net, padded, first)[0], atol=1e-6)


def test_gradients():
    """Back-propagation agrees with finite differences."""
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in quality_net.start(rng).items()}
    data, offsets, y = rng.integers(1, 255, 300, dtype=np.uint8), np.array([0, 40, 41, 300]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = np.clip(quality_net.score_batch(net, data, offsets), 1e-9, 1 - 1e-9)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    g = quality_net.gradients(net, data, offsets, y)
    for name in ("filters", "dense", "shift", "growth", "out"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, eps = net[name][at], 1e-4
        net[name][at] = old + eps
        up = loss()
        net[name][at] = old - eps
        down = loss()
        net[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-3 * max(1, abs(g[name][at]))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and labels with nulls, an empty and a very long text, repeated ids, ids without label, clashing columns."""
    rng = random.Random(4)
    prose = lambda k: " ".join(rng.choice("lorem ipsum dolor sit amet elit sed do eius".split()) for _ in range(k))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(40) + (" vilestuff $$$###" * 6 if bad else " women")))
        if i % 5:
            labels.append((i, int(not bad), int(bad)))
    rows += [(1000, None), (1001, ""), (None, prose(20)), (1002, prose(60_000)), *[(2000, prose(5))] * 5000, (3, rows[3][1])]
    labels += [(1000, 1, 0), (1002, 1, 0), (2000, 1, 0), (7, 0, 1), (None, 1, 1), (5000, 1, 0), (9, None, None)]
    home = tmp_path_factory.mktemp("classifiers")
    docs = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], "doc_id long, text string, y string, score string, twin string")
    docs.repartition(4).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home), rows, labels


def test_sample_is_bounded_in_rows_and_bytes(spark, tables):
    home, rows, labels = tables
    docs, known = (spark.read.parquet(f"{home}/{t}.parquet") for t in ("documents", "labels"))
    got = labelled.sample(docs, known, "toxic", 4, 2, 10_000).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and 2000 in ids and 7 not in ids and 1002 not in ids
    assert not [i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2]
    few = labelled.sample(docs, known, "toxic", 4, 2, 10_000, most_bytes=5_000).collect()
    assert 0 < sum(len(r.text) for r in few) <= 5_000
    assert labelled.sample(docs, known, "toxic", 4, 2, 10).count() <= 10


@pytest.mark.parametrize("query, label, modulus, out", [(toxicity.op6_toxicity, "toxic", 4, 2), (quality_net.op8_byte_network, "quality", 3, 1)])
def test_queries_hold_out_and_score_every_row(spark, tables, tmp_path, query, label, modulus, out):
    home, rows, labels = tables
    got = query(spark, home).select(RESULT).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == out) and 0 <= r.score <= 1 for r in got)
    y = {i: (q if label == "quality" else t) for i, q, t in labels if i is not None and i < 400 and i not in (7, 9)}
    right = [r.predicted == y[r.doc_id] for r in got if r.held_out and r.doc_id in y]
    assert len(right) > 50 and np.mean(right) > 0.95
    # Labels of held-out rows, and other columns, change nothing.
    spark.read.parquet(f"{home}/documents.parquet").select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    turned = [(i, *((None if v is None else 1 - v for v in (q, t)) if i is not None and zlib.crc32(str(i).encode()) % modulus == out else (q, t))) for i, q, t in labels]
    spark.createDataFrame(turned, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    again = query(spark, str(tmp_path)).select(RESULT).collect()
    assert [(r.doc_id, round(r.score, 5)) for r in sorted(again, key=key)] == [(r.doc_id, round(r.score, 5)) for r in sorted(got, key=key)]


def test_twins_are_scored(spark, tables):
    home, *_ = tables
    got = toxicity.op6_toxicity(spark, home).where("twin_score is not null")
    assert got.where("abs(twin_score - score) > 0.05").count() == 0


def test_empty_tables_are_scored(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.examples(labelled.sample(docs, labels, "toxic", 4, 2, 10)) == []
    assert toxicity.score(docs, toxicity.learn([])).count() == 0
    assert quality_net.score(docs, None).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert quality_net.score(one, None).first().score == 0.5 and toxicity.score(one, toxicity.learn([])).first().score < 1e-6
