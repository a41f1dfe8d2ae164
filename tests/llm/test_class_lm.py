"""The class model: base scores against plain Python, gains against likelihoods computed anew, probabilities that sum to one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ponding.llm import class_lm
from ponding.llm.sketch import expand, squeeze

SCHEMA = "doc_id long, text string, held boolean, score string, block int, bucket string, n_tokens int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.fixture(scope="module")
def rows():
    """Sentences of two languages that alternate between two kinds of words, and odd rows."""
    rng = random.Random(4)
    kinds = [[f"{a}{i}" for i in range(25)] for a in ("der", "geht", "the", "goes")]
    out = []
    for i in range(240):
        a, b = kinds[2 * (i % 2)], kinds[2 * (i % 2) + 1]
        text = " ".join(x for _ in range(rng.randint(3, 30)) for x in (rng.choice(a), rng.choice(b)))
        out.append((i, text.upper() if i % 9 == 0 else text, i % 5 == 1))
    out += [(300, None, False), (301, "", True), (302, " \n\t ", False), (None, "the1 goes1", None), (5, "the2 goes2", False), (5, "the2 goes2", False), (303, "never seen Ünseen ünseen", True), (304, "x" * 9000, False)]
    return out


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, h, "x", 1, "x", 1) for i, t, h in rows], SCHEMA).repartition(parts)


def scored(spark, rows, parts=4, **more):
    return class_lm.score(table(spark, rows, parts), F.col("held"), **({"classes": 6, "sweeps": 3, "groups": 2} | more)).collect()


def test_base_and_model(spark, rows, monkeypatch):
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(class_lm, "STEP_BYTES", 200)
    got = scored(spark, rows)
    counts = Counter(w for _, t, h in rows if not h for w in [*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, h in rows:
        own = [*words(t), "\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want.append((str(i), bool(h), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    held = [r for r in got if r.held_out and r.n_tokens > 5 and r.doc_id != 303]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.4  # of log10(4), which alternation and language give
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)
    # Neither the layout of the rows nor the size of blocks matters.
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 8_000_000)
    again = scored(spark, rows, parts=1)
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score)
    assert [r.score for r in sorted(again, key=key)] == pytest.approx([r.score for r in sorted(got, key=key)])


def test_many_blocks_meet_in_shares(spark, rows, monkeypatch):
    want = sorted(round(r.score, 9) for r in scored(spark, rows, parts=1))
    monkeypatch.setattr(class_lm, "BLOCK_BYTES", 500)
    monkeypatch.setattr(class_lm, "MEET", 8)
    assert sorted(round(r.score, 9) for r in scored(spark, rows)) == want


def test_a_round_shuffles_only_what_is_new(spark, rows, monkeypatch):
    """Blocks are written once where they are made; dictionary and vocabulary are joined where they lie."""
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    written, keep = [], class_lm.dealt
    monkeypatch.setattr(class_lm, "dealt", lambda df, *keys: (written.append(exchanges(df)), keep(df, *keys))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    c = class_lm.Clustering(docs, 6, 2)
    assert written == [0, 1, 0]  # blocks, dictionary, vocabulary
    assert exchanges(c.classed()) == 0
    c.exchange(*c.looked(c.classed(), 0))
    assert written[3:] == [1]  # the contexts
    assert exchanges(c.by_block(c.classed(), None, "x long")) == 1  # the words' classes


def test_words_and_places_are_sent_as_planes_of_bytes():
    rng = np.random.default_rng(2)
    for words in (np.unique(rng.integers(0, 2**64, 20_000, np.uint64)), np.array([0, 2**64 - 1], np.uint64), np.zeros(0, np.uint64)):
        assert (class_lm.words_at(class_lm.steps_of(words)) == words).all()
        assert len(words) < 3 or len(squeeze(class_lm.steps_of(words))) < 0.85 * len(squeeze(words))
    for places in (rng.integers(0, 2**20, 5000).astype(np.uint32), np.zeros(0, np.uint32)):
        assert (class_lm.whole(class_lm.planes(places), np.uint32) == places).all()


def test_rows_of_dictionaries_stay_few():
    """Each block has a row for each bucket: at 48 GB of text under eight million in all, and for little text one for each 16 MB."""
    size = 48 * 10**9
    assert class_lm.buckets_for(size) * size // class_lm.BLOCK_BYTES < 8 * 10**6
    assert size // class_lm.BLOCK_BYTES < class_lm.MEET
    assert [class_lm.buckets_for(x) for x in (0, 10**8, 5 * 10**8, 10**9, 10**10)] == [16, 16, 31, 62, 156]


def plain_bigrams(texts, classes, k):
    """Class bigrams of a corpus, counted with a loop."""
    b = np.zeros((k + 1, k + 1), np.int64)
    for t in texts:
        path = [k, *(classes[w] for w in t), k]
        for x, y in zip(path, path[1:]):
            b[x, y] += 1
    return b


def test_gains_are_differences_of_likelihoods():
    """Moving one word and counting everything anew gives the same."""
    rng, k = np.random.default_rng(3), 4
    vocabulary = [f"w{i}" for i in range(12)]
    texts = [list(rng.choice(vocabulary, rng.integers(0, 15), p=np.arange(1, 13) / 78)) for _ in range(60)]
    classes = {w: i % k for i, w in enumerate(vocabulary)}
    b = plain_bigrams(texts, classes, k)
    now = np.array([classes[w] for w in vocabulary])
    left, right, twice = np.zeros((12, k + 1)), np.zeros((12, k + 1)), np.zeros(12)
    for t in texts:
        path = [None, *t, None]
        for x, y, z in zip(path, path[1:], path[2:]):
            i = vocabulary.index(y)
            left[i, k if x is None else classes[x]] += 1
            right[i, k if z is None else classes[z]] += 1
            twice[i] += x == y
    gain = class_lm.gains(b.astype(float), now, left, right, twice)
    for i, w in enumerate(vocabulary):
        anew = [class_lm.likelihood(plain_bigrams(texts, classes | {w: c}, k)) for c in range(k)]
        assert gain[i] - gain[i, now[i]] == pytest.approx(np.array(anew) - anew[now[i]], abs=1e-6)


def test_counts_and_course(spark, rows):
    """Bigrams equal a plain count under the classes found, and the likelihood rises."""
    c = class_lm.Clustering(table(spark, rows).selectExpr("doc_id", "text", "coalesce(held, false) held_out"), 6, 2)
    course = c.cluster(3)
    _, bigrams = c.looked(c.classed(), None)
    assert class_lm.likelihood(bigrams) == pytest.approx(max(course)) and max(course) > course[0]
    classes = {}
    from ponding.llm.words import Powers

    for r in c.vocabulary.collect():
        found, _, own = expand(bytes(r.data), np.uint64, np.int64, np.uint16)
        classes |= dict(zip(found.tolist(), own.tolist()))
    number = lambda w: int(class_lm.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), Powers())[0][0])
    texts = [words(t) for _, t, h in rows if not h]
    want = plain_bigrams(texts, {w: classes[number(w)] for t in texts for w in t}, 6)
    assert (bigrams == want).all()


def test_probabilities_sum_to_one():
    rng, k = np.random.default_rng(8), 5
    words_, counts = rng.integers(0, k, 80), rng.integers(1, 9, 80)
    types = np.bincount(words_, minlength=k)
    b = rng.integers(0, 40, (k + 1, k + 1)).astype(float)
    b[:, :k] *= np.bincount(words_, counts, k) / b[:, :k].sum(0)  # classes as often as their words
    steps, sizes = class_lm.smoothed(b, types, 0.6, 10.0)
    for row in 10**steps:
        known = sum(row[c] * (n - 0.6) / sizes[c] for c, n in zip(words_, counts))
        assert known + row[k] + row[k + 1] == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    assert scored(spark, []) == []
    for r in scored(spark, [(1, "a b", True), (2, None, True)]):
        assert r.score == r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0
    only = scored(spark, [(1, None, False), (2, "a", True)])
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in only} == {(1, 1, 1, 1), (2, 2, 1, 1)}
    assert all(math.isfinite(r.base_score) for r in only)


def test_a_long_text_is_hashed_in_steps(monkeypatch):
    from ponding.llm.words import Powers

    text = ("Aa bb " * 400 + "c" * 700 + " dd").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = class_lm.word_hashes(data, offsets, Powers())
    monkeypatch.setattr(class_lm, "STEP_BYTES", 100)
    steps = class_lm.word_hashes(data, offsets, Powers())
    assert (whole[0] == steps[0]).all() and whole[1] == steps[1] == [802]
