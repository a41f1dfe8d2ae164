"""Benchmark decontamination with training suffix arrays.

Each task is a shard of the corpus. Of a shard's words a suffix array is built over the
benchmark's alphabet: every word gets the rank of its hash among the benchmark's words,
and a suffix starts wherever such a word stands. Every test suffix, cut to ``width`` words
(the whole item where it has fewer), is then binary-searched in every shard; the interval
found holds all places where these words stand verbatim. Those words are hit. Of a place
and a test suffix whose words before differ, the words after are compared on: this gives
the longest verbatim match of each document with each item, and its place. (The suffixes
of the last ``width`` - 1 words of a longer item are inside such matches or in none.)

Nothing is shuffled: documents are read once for each block of the benchmark, and a block
is broadcast when it has ``block_bytes`` of distinct benchmark texts. A longer item is cut
into overlapping parts; a match longer than a part is then found in parts.

A null text has no words and is never hit; neither is an item without words. Equal texts
are searched once and named by all their item_ids; items that share an item_id are searched
apart and named once. A null item_id takes part in n_hit but is not listed. An empty
benchmark hits nothing, empty documents give no rows, repeated rows get equal results,
other columns are carried along or left behind whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ponding.llm.common import documents, table
from ponding.llm.words import NOT_ALNUM, Powers, byte_values, ranges, separators, slices, words_of

KEEP, VALUES = separators(NOT_ALNUM, lower=True), byte_values(lower=True)
PER_KEY = 2  # words in one 64-bit sort key, 32 bits each
SHARD_BYTES, PAIRS = 4_000_000, 2_000_000


@dataclass
class TestSuffixes:
    """A block of the benchmark: its word hashes, sorted (the alphabet), and its suffixes, cut to windows, by the windows' length."""

    alphabet: np.ndarray
    codes: np.ndarray  # of all items, one after the other, a 0 before, between and after them
    item: np.ndarray  # of each of these places
    ids: list[list[int | None]]  # of each item
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # distinct windows x length; their places in codes, and where each one's begin (len+1)


def words_in(text: str | None, powers: Powers) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]), KEEP, VALUES, powers)[2]


def prepare(items: list[tuple[list[int | None], np.ndarray]], width: int) -> TestSuffixes:
    """items: their ids and the hashes of their words."""
    items = [(ids, own) for ids, own in items if len(own)]
    hashes = [own for _, own in items]
    alphabet = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    size = np.array([len(h) for h in hashes], np.int64)
    codes, item = np.zeros(int((size + 1).sum()) + 1, np.uint32), np.full(int((size + 1).sum()) + 1, -1)
    begin = np.cumsum(size + 1) - size
    for k, own in enumerate(hashes):
        codes[begin[k] : begin[k] + size[k]] = np.searchsorted(alphabet, own) + 1
        item[begin[k] : begin[k] + size[k]] = k
    windows = []
    for n in np.unique(np.minimum(size, width)).tolist():
        which = np.flatnonzero(np.minimum(size, width) == n)
        places = ranges(begin[which], size[which] - n + 1)
        rows = codes[places[:, None] + np.arange(n)]
        distinct, at = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(at.ravel(), kind="stable")
        windows.append((distinct, places[order], np.searchsorted(at.ravel()[order], np.arange(len(distinct) + 1))))
    return TestSuffixes(alphabet, codes, item, [ids for ids, _ in items], windows)


def bisect(column: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """For each key its place in column[lo:hi], all at once."""
    lo, hi = lo.copy(), hi.copy()
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) >> 1
        up = column[mid] <= key[live] if right else column[mid] < key[live]
        lo[live[up]] = mid[up] + 1
        hi[live[~up]] = mid[~up]
    return lo


class SuffixArray:
    """Suffixes of a sequence of codes (0: outside the alphabet), sorted by their first ``depth`` codes."""

    def __init__(self, codes: np.ndarray, depth: int):
        n, self.rounds = len(codes), -(-depth // PER_KEY)
        padded = np.concatenate([codes, np.zeros(self.rounds * PER_KEY, codes.dtype)]).astype(np.uint64)
        self.keys = np.zeros(n + self.rounds * PER_KEY, np.uint64)
        self.keys[:n] = padded[:n] << np.uint64(32) | padded[1 : n + 1]
        places = np.flatnonzero(codes)
        order = places[np.argsort(self.keys[places], kind="stable")]
        # Ties are sorted by the next words, round by round, until all differ or the depth is reached.
        tied = np.arange(len(order))
        group = np.cumsum(np.r_[False, self.keys[order][1:] != self.keys[order][:-1]]) if len(order) else tied
        for r in range(1, self.rounds):
            sizes = np.bincount(group, minlength=1) if len(group) else np.zeros(1, int)
            many = sizes[group] > 1
            tied, group = tied[many], group[many]
            if not len(tied):
                break
            key = self.keys[order[tied] + r * PER_KEY]
            by = np.lexsort((key, group))
            order[tied] = order[tied][by]
            key, group = key[by], group[by]
            group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        self.order = order

    def find(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of patterns the interval of suffixes that begin with it."""
        m, length = pattern.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, len(self.order), np.int64)
        for r in range(-(-length // PER_KEY)):
            part = pattern[:, r * PER_KEY : (r + 1) * PER_KEY].astype(np.uint64)
            key = part[:, 0] << np.uint64(32)
            top = key | (part[:, 1] if part.shape[1] > 1 else np.uint64(2**32 - 1))
            key = top if part.shape[1] > 1 else key
            live = np.flatnonzero(lo < hi)
            column = self.keys[self.order + r * PER_KEY]
            lo[live], hi[live] = bisect(column, key[live], lo[live], hi[live], False), bisect(column, top[live], lo[live], hi[live], True)
        return lo, hi


def _places(codes: np.ndarray, test: TestSuffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the length, windows found and their places in ``codes``, and the windows' places in the benchmark (see :class:`TestSuffixes`)."""
    if len(codes) and test.windows:
        array = SuffixArray(codes, max(w.shape[1] for w, *_ in test.windows))
        for patterns, owners, cut in test.windows:
            lo, hi = array.find(patterns)
            yield patterns.shape[1], np.repeat(np.arange(len(patterns)), hi - lo), array.order[ranges(lo, hi - lo)], owners, cut


def _longest(codes: np.ndarray, test: TestSuffixes, n: int, window: np.ndarray, place: np.ndarray, owners: np.ndarray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, item, words) of every match that can't be extended, from places of windows of ``n`` words, some pairs at a time."""
    pairs = np.r_[0, np.cumsum(cut[window + 1] - cut[window])]
    edges = np.unique(np.r_[0, np.searchsorted(pairs, np.arange(PAIRS, pairs[-1], PAIRS)), len(window)])
    for i, j in zip(edges[:-1], edges[1:]):
        count = cut[window[i:j] + 1] - cut[window[i:j]]
        x, p = np.repeat(place[i:j], count), owners[ranges(cut[window[i:j]], count)]
        begins = (codes[x - 1] != test.codes[p - 1]) | (test.codes[p - 1] == 0)
        x, p = x[begins], p[begins]
        words, live = np.full(len(x), n), np.arange(len(x))
        while len(live):
            a, b = codes[x[live] + words[live]], test.codes[p[live] + words[live]]
            live = live[(a == b) & (b != 0)]
            words[live] += 1
        yield x, test.item[p], words


def _search(codes: np.ndarray, first: np.ndarray, test: TestSuffixes, longest: bool) -> tuple[np.ndarray, list[list[int]], list[list[tuple[int, int, int]]]]:
    """Of a shard: the mask of hit words, the items of each document, and (item, word offset, words) of its longest match with each."""
    n_docs, n_items = len(first) - 1, max(len(test.ids), 1)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    # An unmatchable code before and after each document keeps matches inside.
    spaced = np.zeros(len(codes) + n_docs + 1, np.uint32)
    at = np.arange(len(codes)) + doc + 1
    spaced[at] = codes
    back, where = np.zeros(len(spaced), np.int64), np.zeros(len(spaced), np.int64)
    back[at], where[at] = np.arange(len(codes)), doc
    change, pairs, best = np.zeros(len(codes) + 1, np.int64), [np.zeros(0, np.int64)], []
    for n, window, place, owners, cut in _places(spaced, test):
        np.add.at(change, back[place], 1)
        np.add.at(change, back[place] + n, -1)
        own = np.unique(where[place] * len(cut) + window)
        d, w = own // len(cut), own % len(cut)
        count = cut[w + 1] - cut[w]
        pairs.append(np.unique(np.repeat(d, count) * n_items + test.item[owners[ranges(cut[w], count)]]))
        if longest:
            best += _longest(spaced, test, n, window, place, owners, cut)
    found, matches = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)]
    for pair in np.unique(np.concatenate(pairs)).tolist():
        found[pair // n_items].append(pair % n_items)
    if best:
        x, item, words = (np.concatenate(c) for c in zip(*best, strict=True))
        order = np.lexsort((x, -words, item, where[x]))
        key = where[x[order]] * n_items + item[order]
        for k in order[np.flatnonzero(np.r_[True, key[1:] != key[:-1]])] if len(order) else ():
            d = int(where[x[k]])
            matches[d].append((int(item[k]), int(back[x[k]] - first[d]), int(words[k])))
    return np.cumsum(change[:-1]) > 0, found, matches


LONGS, MATCHES = pa.list_(pa.int64()), pa.list_(pa.struct([("item_id", pa.int64()), ("word", pa.int64()), ("words", pa.int64())]))
FOUND = {"n_words": pa.int64(), "hit_starts": LONGS, "hit_lengths": LONGS, "items": LONGS, "matches": MATCHES}
DDL = "n_words long, hit_starts array<long>, hit_lengths array<long>, items array<long>, matches array<struct<item_id: long, word: long, words: long>>"


def _scan(docs: DataFrame, test: TestSuffixes, carry: list[str], longest: bool, merge: bool) -> DataFrame:
    """Adds to each document its hit runs of words, items and longest matches; ``merge``: to those of earlier blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(test, f.name) for f in fields(test)))
    names = ["doc_id", "text", *carry]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, powers = TestSuffixes(*shared.value), Powers()
        for part, data, offsets in (x for b in batches for x in slices(b, SHARD_BYTES)):
            _, _, hashes, first = words_of(data, offsets, KEEP, VALUES, powers)
            at = np.searchsorted(test.alphabet, hashes)
            known = at < len(test.alphabet)
            known[known] = test.alphabet[at[known]] == hashes[known]
            codes = np.where(known, at + 1, 0)
            hit, found, best = _search(codes, first, test, longest)
            items = [[i for k in s for i in test.ids[k] if i is not None] for s in found]
            matches = [[{"item_id": i, "word": w, "words": n} for k, w, n in r for i in test.ids[k]] for r in best]
            if merge:
                old = {c: part.column(c).to_pylist() for c in ("hit_starts", "hit_lengths", "items", "matches")}
                counts = np.array([len(x) for x in old["hit_starts"]])
                flat = [np.array([v for x in old[c] for v in x], np.int64) for c in ("hit_starts", "hit_lengths")]
                hit[ranges(flat[0] + np.repeat(first[:-1], counts), flat[1])] = True
                items = [x + y for x, y in zip(old["items"], items, strict=True)]
                matches = [x + y for x, y in zip(old["matches"], matches, strict=True)]
            edge = np.diff(np.r_[False, hit, False].astype(np.int8))
            edge[first] = np.where(np.r_[hit, False][first] & np.r_[False, hit][first], 2, edge[first])
            starts, ends = np.flatnonzero(edge > 0), np.flatnonzero((edge == -1) | (edge == 2))
            span = np.searchsorted(starts, first)
            rows = [
                np.diff(first).tolist(),
                [(starts[i:j] - f).tolist() for i, j, f in zip(span, span[1:], first)],
                [(ends[i:j] - starts[i:j]).tolist() for i, j in zip(span, span[1:])],
                items,
                matches,
            ]
            arrays = [pa.array(v, kind) for v, kind in zip(rows, FOUND.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *arrays], names=[*names, *FOUND])

    return docs.mapInArrow(scan, StructType([*[docs.schema[c] for c in names], *StructType.fromDDL(DDL).fields]))


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[TestSuffixes]:
    """The benchmark's distinct texts, block by block; the driver holds one at a time."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    equal = bench.groupBy("text").agg(F.array_agg("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("unnamed"))
    powers, part, block, size = Powers(), max(2 * width, block_bytes // 6), [], 0
    for text, ids, unnamed in equal.toLocalIterator():
        ids, own = sorted({i for i in ids if i is not None}) + [None] * unnamed, words_in(text, powers)
        for i in range(0, max(len(own) - width + 1, 1), part):
            piece = own[i : i + part + width - 1]
            block.append((ids, piece))
            size += 6 * len(piece)
            if size >= block_bytes:
                yield prepare(block, width)
                block, size = [], 0
    yield prepare(block, width)


def match(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 2_000_000, longest: bool = True) -> DataFrame:
    """docs: doc_id, text and others; benchmark: item_id, text. Adds what the benchmark hits, by row.

    The benchmark is taken in blocks of ``block_bytes`` of distinct texts; each is broadcast
    and searched for in a narrow pass over the documents, which hands its hits on to the next.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    for k, test in enumerate(_blocks(benchmark, width, block_bytes)):
        docs = _scan(docs, test, carry, longest, merge=k > 0)
    return docs


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_at long, longest_item long"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each document, and its longest match: words, place, item (ties: the first place, then the smallest item_id)."""
    for b in batches:
        lengths, items = b.column("hit_lengths").to_pylist(), b.column("items").to_pylist()
        named = [sorted({str(i) for i in x}) for x in items]
        n_hit = [sum(x) for x in lengths]
        best = [min(((-m["words"], m["word"], m["item_id"] is None, m["item_id"]) for m in r), default=(0, None, True, None)) for r in b.column("matches").to_pylist()]
        columns = [
            pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in named], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()),
            pa.array([n > 0 for n in n_hit], pa.bool_()),
            pa.array([-m[0] for m in best], pa.int64()),
            pa.array([m[1] for m in best], pa.int64()),
            pa.array([m[3] for m in best], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), *columns], names=[c.split()[0] for c in DIGEST.split(", ")])


def op2_suffix_decontamination(spark, sf_dir: str) -> DataFrame:
    found = match(documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), width=10)
    return found.mapInArrow(digest, DIGEST)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any word hit, with all their columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*others).alias("row"))
    clean = match(plain, benchmark, width, longest=False).where(F.size("hit_lengths") == 0)
    return clean.select(*[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
