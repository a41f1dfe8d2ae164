"""Scores of documents under a Brown class-based bigram model, with classes by exchange clustering.

log P(word | before) = log P(class of word | class of the word before) + log P(word | its class).

Documents are cut into blocks of words as numbers, each with a dictionary of its distinct
words (64-bit hashes) and their counts in training documents. The vocabulary lies in buckets
of hashes; blocks and buckets meet in joins, so neither the vocabulary nor the corpus is in
one place, and a word that makes up a third of all words is one entry of a block's dictionary.

Exchange: the most frequent words begin with a class each, all others share the last. In turn,
each of ``groups`` parts of the vocabulary is taken up: every word's classes before and after
are counted over the whole training text, and the word goes to the class that raises the
likelihood of the class bigrams most, exactly as if it alone moved. A round after which the
likelihood is lower is undone, and smaller parts move from then on. Only the matrix of class
bigrams, whose size is a parameter, comes to the driver.

Smoothing: transitions are interpolated with class frequencies; emissions are discounted by
what words seen once and twice say of unseen ones, and a class's discount is its probability of
a word never seen. All unseen words are one word, so probabilities sum to one over the
vocabulary, that word and the end. After an unseen word the classes follow as after the discounts' mix.

Defined results: a null text is empty (its one token is the end), a null doc_id is trained on,
repeated rows count each. Without training documents, or with an empty table, every score is
the base score. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ponding.llm.common import dealt, discard, materialize, partitions, table, total_bytes
from ponding.llm.sketch import expand, planes, squeeze, whole
from ponding.llm.tree import fold, of_task
from ponding.llm.words import SPACE, U, Powers, byte_values, separators, slices, words_of

#: Bytes of text in a block, bytes hashed at a time, bytes of text for one bucket of the vocabulary, blobs that meet in one task.
BLOCK_BYTES, STEP_BYTES, BUCKET_BYTES, MEET = 6_000_000, 1_000_000, 16_000_000, 16_384
KEEP, VALUES = separators(SPACE), byte_values(lower=True)
VOCABULARY = "bucket long, salt int, data binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order and how many each document has; a long text is hashed in steps that end between words."""
    if len(data) <= 2 * STEP_BYTES or len(offsets) > 2:
        _, _, hashes, first = words_of(data, offsets, KEEP, VALUES, powers)
        return hashes, np.diff(first)
    found, at = [], 0
    while at < len(data):
        rest = KEEP[data[at + STEP_BYTES :]]
        to = at + STEP_BYTES + int(np.argmin(rest)) if len(rest) and not rest.all() else len(data)
        found.append(words_of(data[at:to], np.array([0, to - at]), KEEP, VALUES, powers)[2])
        at = to
    hashes = np.concatenate(found)
    return hashes, np.array([len(hashes)])


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the hash, so a bucket is a stretch of the sorted words."""
    return ((words >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def buckets_for(size: int) -> int:
    """Of so many bytes of text: small ones at first, so that all cores have some, then larger ones, as each block has a row for each."""
    return max(16, min(64, size // BUCKET_BYTES), size // (4 * BUCKET_BYTES))


def steps_of(words: np.ndarray) -> np.ndarray:
    """Sorted words as their differences, whose high bytes are zeros."""
    return planes(np.diff(words, prepend=U(0)))


def words_at(steps: np.ndarray) -> np.ndarray:
    """What :func:`steps_of` made smaller."""
    return np.cumsum(whole(steps, np.uint64), dtype=np.uint64)


def encode(docs: DataFrame, buckets: int) -> DataFrame:
    """docs: doc_id, text, held_out. Rows (block, bucket, data), dealt out by block: bucket -1 has a block's words as places in its dictionary; the others have the dictionary's stretches with counts."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, powers = TaskContext.get().partitionId() << 32, Powers()
        for b, _, _ in (x for whole in batches for x in slices(whole, BLOCK_BYTES)):
            parts = [word_hashes(data, offsets, powers) for _, data, offsets in slices(b, STEP_BYTES)]
            hashes, lengths = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            ids, held = b.column("doc_id"), b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            words, places = np.unique(hashes, return_inverse=True)
            trained = np.bincount(places[~np.repeat(held, lengths)], minlength=len(words))
            nulls = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            rows = [(-1, squeeze(planes(places.astype(np.uint32)), lengths.astype(np.int64), ids.fill_null(0).to_numpy(), nulls, held.astype(np.uint8)))]
            own = bucket_of(words, buckets)
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
            rows += [(int(own[i]), squeeze(steps_of(words[i:j]), trained[i:j])) for i, j in zip(cuts, [*cuts[1:], len(own)])]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], names=["block", "bucket", "data"])
            block += 1

    return dealt(docs.mapInArrow(blocks, "block long, bucket long, data binary"), "block")


def salt_of(block: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(block), F.lit(salts)).cast("int").alias("salt")


def meet(parts: DataFrame, merge: Callable[[list[bytes]], bytes], *keys: str) -> DataFrame:
    """One blob for each bucket and what else is among the keys."""

    def together(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([merge(t.column("data").to_pylist())], pa.binary())})

    return parts.select(*keys, "data").groupBy(*keys).applyInArrow(together, "bucket long, data binary")


def add_counts(blobs: list[bytes]) -> bytes:
    """Words seen in training, with the sums of their counts."""
    pairs = [expand(b, np.uint8, np.int64) for b in blobs]
    words, places = np.unique(np.concatenate([words_at(w) for w, _ in pairs]), return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, places, np.concatenate([c for _, c in pairs]))
    return squeeze(steps_of(words[counts > 0]), counts[counts > 0])


def xlogx(a: np.ndarray) -> np.ndarray:
    return a * np.log(np.maximum(a, 1e-300))


def gains(bigrams: np.ndarray, now: np.ndarray, left: np.ndarray, right: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """What the log likelihood gains over leaving a word out if it goes to each class: words by classes.

    bigrams: counts by class before (K and the start) and class after (K and the end). For each word: its class ``now``,
    its counts by class before (``left``) and after (``right``), and how often it follows itself (``twice``).
    """
    k, rows = len(bigrams) - 1, np.arange(len(now))
    sizes, f = bigrams[:, :k].sum(0), xlogx(bigrams)
    n = left.sum(1)
    left, right = left.copy(), right.copy()
    left[rows, now] -= twice
    right[rows, now] -= twice
    out = np.zeros((len(now), k))
    for own, other, table_, logs in ((left, right, bigrams, f), (right, left, bigrams.T, f.T)):
        w, c = np.nonzero(own)
        w, c = w[c != now[w]], c[c != now[w]]
        step = xlogx(table_[c, :k] + own[w, c][:, None]) - logs[c, :k]
        inside = np.flatnonzero(c < k)
        step[inside, c[inside]] = 0
        first = np.searchsorted(w, rows)
        sums = np.concatenate([np.zeros((1, k)), np.cumsum(step, 0)])
        out += sums[np.append(first[1:], len(w))] - sums[first]
        some = np.flatnonzero(own[rows, now])
        rest = np.maximum(table_[now[some], :k] - other[some, :k], 0)
        out[some] += xlogx(rest + own[some, now[some]][:, None]) - xlogx(rest)
    diagonal = np.diag(bigrams)[:k]
    out += xlogx(diagonal + left[:, :k] + right[:, :k] + twice[:, None]) - f.diagonal()[:k] - 2 * (xlogx(sizes + n[:, None]) - xlogx(sizes))
    # Staying: against the counts without the word.
    stay = -2 * (xlogx(sizes[now]) - xlogx(sizes[now] - n)) + xlogx(diagonal[now]) - xlogx(diagonal[now] - left[rows, now] - right[rows, now] - twice)
    for own, table_, logs in ((left, bigrams.T, f.T), (right, bigrams, f)):
        w, c = np.nonzero(own)
        w, c = w[c != now[w]], c[c != now[w]]
        stay += np.bincount(w, logs[now[w], c] - xlogx(table_[now[w], c] - own[w, c]), len(now))
    out[rows, now] = stay
    return out


def add_contexts(blobs: list[bytes]) -> bytes:
    """Words, how many contexts each has, the contexts and their counts; counts of the same word and context add up."""
    parts = [expand(b, np.uint8, np.int32, np.uint16, np.int64) for b in blobs]
    words, places = np.unique(np.concatenate([words_at(p[0]) for p in parts]), return_inverse=True)
    key = np.repeat(places, np.concatenate([p[1] for p in parts])) << 16 | np.concatenate([p[2] for p in parts])
    key, where = np.unique(key, return_inverse=True)
    counts = np.zeros(len(key), np.int64)
    np.add.at(counts, where, np.concatenate([p[3] for p in parts]))
    return squeeze(steps_of(words), np.bincount(key >> 16, minlength=len(words)).astype(np.int32), (key & 0xFFFF).astype(np.uint16), counts)


class Clustering:
    """The encoded corpus, and the vocabulary with its classes."""

    def __init__(self, docs: DataFrame, classes: int, groups: int):
        self.k, self.groups = classes, groups
        self.buckets = buckets_for(total_bytes(docs))
        # Blocks, dictionary and vocabulary lie dealt out by the key they are joined on, so that a round shuffles none of them.
        self.coded = encode(docs, self.buckets)
        self.salts = 1 + self.coded.where("bucket < 0").count() // MEET
        parts = self.coded.where("bucket >= 0").select("block", "bucket", salt_of(F.col("block"), self.salts), "data")
        self.dictionary = dealt(parts.repartition(partitions(docs.sparkSession), "bucket", "salt"), "bucket", "salt")
        # Where many blocks have a bucket, shares of them meet first.
        shares = meet(self.dictionary, add_counts, "bucket", "salt")
        counted = materialize(shares if self.salts == 1 else meet(shares, add_counts, "bucket"), "counts")
        stats, top = self.totals(counted)
        self.types, self.words, self.ones, self.twos = stats
        self.vocabulary = self.seeded(counted, top)
        discard(counted)

    def totals(self, counted: DataFrame) -> tuple[list[int], np.ndarray]:
        """Types, tokens, types seen once and twice; the classes - 1 most frequent words."""
        k = self.k

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stats, top = np.zeros(4, np.int64), [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
            for blob in (x for b in batches for x in b.column("data").to_pylist()):
                words, counts = expand(blob, np.uint8, np.int64)
                words = words_at(words)
                stats += [len(words), counts.sum(), (counts == 1).sum(), (counts == 2).sum()]
                top = most([top, [words, counts]])
            return of_task(squeeze(stats, *top))

        def most(parts: list) -> list[np.ndarray]:
            words, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            by = np.lexsort((words, -counts))[: k - 1]
            return [words[by], counts[by]]

        def both(blobs: list[bytes]) -> bytes:
            parts = [expand(b, np.int64, np.uint64, np.int64) for b in blobs]
            return squeeze(sum(p[0] for p in parts), *most([p[1:] for p in parts]))

        data = fold(counted.select("data").mapInArrow(look, "part int, data binary"), both, counted.rdd.getNumPartitions())
        stats, words, _ = expand(data, np.int64, np.uint64, np.int64) if data else (np.zeros(4, np.int64), np.zeros(0, np.uint64), None)
        return stats.tolist(), np.array(words)

    def seeded(self, counted: DataFrame, top: np.ndarray) -> DataFrame:
        last, by = self.k - 1, np.argsort(top)
        ordered = top[by]

        def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for blob in b.column("data").to_pylist():
                    words, counts = expand(blob, np.uint8, np.int64)
                    words = words_at(words)
                    classes = np.full(len(words), last, np.uint16)
                    at = np.searchsorted(words, ordered)
                    hit = at < len(words)
                    hit[hit] = words[at[hit]] == ordered[hit]
                    classes[at[hit]] = by[hit]
                    out.append(squeeze(words, counts, classes))
                yield pa.RecordBatch.from_arrays([b.column("bucket"), pa.array([0] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["bucket", "salt", "data"])

        return dealt(counted.mapInArrow(seed, VOCABULARY), "bucket", "salt")

    def classed(self, with_counts: bool = False) -> DataFrame:
        """For each stretch of a block's dictionary: its words' class + 1 (0: not in the vocabulary), and their counts if asked for."""

        def look_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            blobs = right.column("data").to_pylist()
            words, counts, classes = expand(blobs[0], np.uint64, np.int64, np.uint16) if blobs else [np.zeros(0, t) for t in (np.uint64, np.int64, np.uint16)]
            out = []
            for blob in left.column("data").to_pylist():
                own = words_at(expand(blob, np.uint8, np.int64)[0])
                at = np.minimum(np.searchsorted(words, own), max(len(words) - 1, 0))
                known = words[at] == own if len(words) else np.zeros(len(own), bool)
                at = at[known]
                kind, seen = np.zeros(len(own), np.uint16), np.zeros(len(own) * with_counts, np.int64)
                kind[known] = classes[at] + 1
                if with_counts:
                    seen[known] = counts[at]
                out.append(squeeze(kind, seen))
            return pa.table({"block": left.column("block"), "bucket": left.column("bucket"), "data": pa.array(out, pa.binary())})

        salted = self.vocabulary if self.salts == 1 else self.vocabulary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        return self.dictionary.groupBy("bucket", "salt").cogroup(salted.groupBy("bucket", "salt")).applyInArrow(look_up, "block long, bucket long, data binary")

    def by_block(self, classed: DataFrame, work: Callable[[list[np.ndarray], list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
        """Calls work with a block's places, lengths, ids, nulls, held_out and words, and with the words' classes and counts."""
        kinds = (np.uint16, np.int64)

        def block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            payload, *stretches = left.sort_by("bucket").column("data").to_pylist()
            words = np.concatenate([np.zeros(0, np.uint64), *(words_at(expand(b, np.uint8, np.int64)[0]) for b in stretches)])
            parts = [expand(b, *kinds) for b in right.sort_by("bucket").column("data").to_pylist()]
            places, *rest = expand(payload, np.uint8, np.int64, np.int64, np.uint8, np.uint8)
            return work([whole(places, np.uint32), *rest, words], [np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in enumerate(kinds)])

        return self.coded.groupBy("block").cogroup(classed.groupBy("block")).applyInArrow(block, schema)

    def looked(self, classed: DataFrame, group: int | None) -> tuple[DataFrame, np.ndarray]:
        """Contexts, by bucket, of the words of a group (none if that is None), and the class bigrams of the training text."""
        k, groups, buckets = self.k, self.groups, self.buckets

        def look(payload: list[np.ndarray], dictionary: list[np.ndarray]) -> pa.Table:
            places, lengths, _, _, held, words = payload
            kind, _ = dictionary
            places, lengths = places[np.repeat(held == 0, lengths)].astype(np.int64), lengths[held == 0]
            ends = np.cumsum(lengths)
            first, last = (ends - lengths)[lengths > 0], ends[lengths > 0] - 1
            own = kind[places].astype(np.int64) - 1
            before, after = np.r_[k, own][:-1], np.r_[own, k][1:]
            before[first], after[last] = k, k
            pairs = np.bincount(before * (k + 1) + own, minlength=(k + 1) ** 2) + np.bincount(own[last] * (k + 1) + k, minlength=(k + 1) ** 2)
            pairs[-1] += (lengths == 0).sum()
            rows = [(-1, squeeze(pairs.astype(np.int64)))]
            if group is not None and len(own):
                mine = (words % U(groups) == group)[places]
                same = np.r_[False, places[1:] == places[:-1]] & mine
                same[first] = False
                wide = 2 * k + 3  # classes before, classes after, and the word itself before
                at = places[mine] * wide
                key, counts = np.unique(np.concatenate([at + before[mine], at + k + 1 + after[mine], places[same] * wide + wide - 1]), return_counts=True)
                at, slots = key // wide, (key % wide).astype(np.uint16)
                bucket = bucket_of(words[at], buckets)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(at) else []
                for i, j in zip(cuts, [*cuts[1:], len(at)]):
                    own_words, counted = np.unique(at[i:j], return_counts=True)
                    rows.append((int(bucket[i]), squeeze(steps_of(words[own_words]), counted.astype(np.int32), slots[i:j], counts[i:j].astype(np.int64))))
            return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})

        seen = materialize(self.by_block(classed, look, "bucket long, data binary"), "contexts")

        def added(blobs: list[bytes]) -> bytes:
            return squeeze(sum(expand(b, np.int64)[0] for b in blobs))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blobs = [x for b in batches for x in b.column("data").to_pylist()]
            return of_task(added(blobs) if blobs else None)

        data = fold(seen.where("bucket < 0").select("data").mapInArrow(task, "part int, data binary"), added, seen.rdd.getNumPartitions())
        flat = expand(data, np.int64)[0] if data else np.zeros((k + 1) ** 2, np.int64)
        return seen, flat.reshape(k + 1, k + 1).copy()

    def exchange(self, seen: DataFrame, bigrams: np.ndarray) -> None:
        """Each word of the group goes to the class where it gains most; the lowest of equally good ones, its own first."""
        k, counts_of = self.k, bigrams.astype(np.float64)

        def move(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            words, counts, classes = expand(left.column("data")[0].as_py(), np.uint64, np.int64, np.uint16)
            classes, blobs = classes.copy(), right.column("data").to_pylist()
            if blobs:
                own, sizes, slots, seen = expand(add_contexts(blobs), np.uint8, np.int32, np.uint16, np.int64)
                own = words_at(own)
                at, end = np.searchsorted(words, own), np.cumsum(sizes)
                for i in range(0, len(own), 2000):
                    j = min(i + 2000, len(own))
                    grid, e = np.zeros((j - i, 2 * k + 3)), slice(end[i] - sizes[i], end[j - 1])
                    grid[np.repeat(np.arange(j - i), sizes[i:j]), slots[e]] = seen[e]
                    now = classes[at[i:j]].astype(np.int64)
                    gain = gains(counts_of, now, grid[:, : k + 1], grid[:, k + 1 : 2 * k + 2], grid[:, -1])
                    best = gain.argmax(1)
                    better = gain[np.arange(j - i), best] > gain[np.arange(j - i), now] + 1e-6
                    classes[at[i:j]] = np.where(better, best, now)
            return pa.table({"bucket": left.column("bucket"), "salt": left.column("salt"), "data": pa.array([squeeze(words, counts, classes)], pa.binary())})

        contexts = seen.where("bucket >= 0")
        if self.salts > 1:
            contexts = meet(contexts.withColumn("salt", salt_of(F.monotonically_increasing_id(), self.salts)), add_contexts, "bucket", "salt")
        contexts = contexts.select("bucket", F.lit(0).alias("salt"), "data")
        self.vocabulary = dealt(self.vocabulary.groupBy("bucket", "salt").cogroup(contexts.groupBy("bucket", "salt")).applyInArrow(move, VOCABULARY), "bucket", "salt")
        discard(seen)

    def cluster(self, sweeps: int) -> list[float]:
        """The log likelihood of the class bigrams before each round of the exchange and at the end.

        Words that move together can spoil each other's gain. A round that lowers the likelihood is undone, and from
        then on half as many words move at a time.
        """
        course, best = [], None
        rounds = sweeps * self.groups
        for i in range(rounds + 1):
            last = i == rounds
            seen, bigrams = self.looked(self.classed(), None if last else i % self.groups)
            course.append(likelihood(bigrams))
            if best and course[-1] < best[0]:
                discard(seen, self.vocabulary)
                self.vocabulary, self.groups = best[1], 2 * self.groups
                continue
            if best and best[1] is not self.vocabulary:
                discard(best[1])
            best = course[-1], self.vocabulary
            if last:
                discard(seen)
            else:
                self.exchange(seen, bigrams)
        return course

    def class_types(self) -> np.ndarray:
        """How many words each class has."""
        k = self.k

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k, np.int64)
            for blob in (x for b in batches for x in b.column("data").to_pylist()):
                total += np.bincount(expand(blob, np.uint64, np.int64, np.uint16)[2], minlength=k)
            return of_task(squeeze(total))

        data = fold(self.vocabulary.select("data").mapInArrow(count, "part int, data binary"), lambda blobs: squeeze(sum(expand(b, np.int64)[0] for b in blobs)), self.vocabulary.rdd.getNumPartitions())
        return expand(data, np.int64)[0] if data else np.zeros(k, np.int64)


def likelihood(bigrams: np.ndarray) -> float:
    """The part of the training text's log likelihood that depends on the classes."""
    b = bigrams.astype(np.float64)
    return float(xlogx(b).sum() - xlogx(b[:, :-1].sum(0)).sum() - xlogx(b.sum(1)).sum())


def smoothed(bigrams: np.ndarray, types: np.ndarray, discount: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class after | class before), and each class's tokens.

    Rows: K classes, the start, an unseen word; columns: K classes, the end, an unseen word.
    """
    b = bigrams.astype(np.float64)
    k = len(b) - 1
    sizes = b[:, :k].sum(0)
    unseen = np.divide(discount * types, sizes, out=np.zeros(k), where=sizes > 0)
    rows = np.concatenate([b, [unseen @ b[:k]]])
    after = b.sum(0)
    p = (rows + strength * after / after.sum()) / (rows.sum(1, keepdims=True) + strength)
    with np.errstate(divide="ignore"):
        return np.log10(np.c_[p, p[:, :k] @ unseen]), sizes


def score(docs: DataFrame, held_out: Column, classes: int = 64, sweeps: int = 2, groups: int = 3, strength: float = 16.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    held_out: true for documents that are scored but not learnt from (null: learnt from).
    strength: how many tokens of class frequencies are mixed into the transitions after a class.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    c = Clustering(src, classes, groups)
    if c.words:
        c.cluster(sweeps)
    classed = materialize(c.classed(with_counts=True), "classed")
    seen, bigrams = c.looked(classed, None)
    discard(seen)
    documents_learnt, k = int(bigrams[:, -1].sum()), classes
    total, types = c.words + documents_learnt, c.types + bool(documents_learnt)
    discount = min(0.9, max(0.1, c.ones / (c.ones + 2 * c.twos))) if c.ones + c.twos else 0.5
    steps, sizes = smoothed(bigrams, c.class_types(), discount, strength) if total else (np.zeros((k + 2, k + 2)), np.zeros(k))
    below = np.log10(total + 0.5 * (types + 1))
    end_base = np.log10(documents_learnt + 0.5) - below

    def work(payload: list[np.ndarray], dictionary: list[np.ndarray]) -> pa.Table:
        places, lengths, ids, nulls, held, _ = payload
        kind, seen = dictionary
        known = kind > 0
        emitted = np.zeros(len(kind))
        emitted[known] = np.log10((seen[known] - discount) / sizes[kind[known].astype(np.int64) - 1])
        own = np.where(known, kind.astype(np.int64) - 1, k + 1)[places]
        ends, document = np.cumsum(lengths), np.repeat(np.arange(len(lengths)), lengths)
        before, some = np.r_[k, own][:-1], lengths > 0
        before[(ends - lengths)[some]] = k
        last = np.full(len(lengths), k)
        last[some] = own[ends[some] - 1]
        add = lambda x: np.bincount(document, x, len(lengths))
        base = add((np.log10(seen + 0.5) - below)[places]) + end_base
        model = add(steps[before, own] + emitted[places]) + steps[last, k] if total else base
        columns = [pa.array(ids, mask=nulls.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths + 1), pa.array(add(known[places]).astype(np.int64) + bool(documents_learnt)), pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(model)]
        return pa.table(dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), columns, strict=True)))

    return c.by_block(classed, work, SCORED).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op13_class_lm(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score(table(spark, sf_dir, "documents"), held_out)
