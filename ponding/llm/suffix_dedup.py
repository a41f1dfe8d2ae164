"""Suffix-array deduplication of bytes: maximal repeats from the interval tree of an enhanced suffix array.

Suffixes are dealt to shards by the anchor of their first ``width`` bytes, so that all
suffixes that share such a prefix lie in one shard, whatever document they come from. A
shard sorts the suffixes of its distinct segments, takes the common prefixes of
neighbours, and scans them with a stack: every interval of at least ``width`` common bytes
is a repeat with all of its occurrences. Intervals whose occurrences have different bytes
on their left cannot be extended there: these are the maximal repeats (up to the end of a
segment; a longer one shows as several that follow each other).

For the cut, every byte goes that lies in a ``width``-byte string which also starts in a
document with a smaller doc_id: what the maximal repeats cover outside their smallest documents.

Nulls: a null text is empty. A null doc_id counts as larger than any other, and null ids
do not come before each other. Rows that repeat a doc_id are one document's: they do not
cut each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ponding.llm.anchors import runs
from ponding.llm.common import documents, table, with_tags
from ponding.llm.window_exchange import NULL_ID, VALUES, Grain, Shard, deal, judge, read_shard, unpacked, window_spans, with_runs
from ponding.llm.words import Powers, Rolling, U, covered, ranges, same_bytes, slices

GRAM, SCATTER = 16, 2_000_000


def big_endian(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number that sorts like them."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), U)
    for j in range(8):
        out |= padded[j : j + len(text)].astype(U) << U(8 * (7 - j))
    return out


def suffix_array(keys: np.ndarray, pos: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that start at ``pos`` and stop at ``end``, and the bytes each shares with the one before.

    Sorted by eight bytes at a time; only ties go on to the next eight.
    """
    n = len(pos)
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    if not n:
        return order, lcp

    def column(which: np.ndarray, at: int) -> np.ndarray:
        left = np.clip(end[which] - pos[which] - at, 0, 8)
        key = keys[np.minimum(pos[which] + at, len(keys) - 1)]
        return np.where(left == 8, key, np.where(left == 0, U(0), key & ~((U(1) << (U(8) * (U(8) - np.maximum(left, 1).astype(U)))) - U(1))))

    slots, group = np.arange(n), np.zeros(n, np.int64)
    for at in range(0, depth, 8):
        key = column(order[slots], at)
        by = np.argsort(key, kind="stable") if at == 0 else np.lexsort((key, group))
        order[slots], key, group = order[slots][by], key[by], group[by]
        same = np.r_[False, group[1:] == group[:-1]]
        differ = np.r_[U(0), key[1:] ^ key[:-1]]
        equal = same & (differ == 0)
        part = same & (differ != 0)
        # Leading equal bytes of the pairs that part here: frexp gives the highest set bit exactly for a masked byte.
        lead = np.zeros(len(key), np.int64)
        rest = differ.copy()
        for b in range(8):
            lead += (rest >> U(56 - 8 * b) == 0) & (lead == b)
        lcp[slots[part]] = at + lead[part]
        lcp[slots[equal]] = at + 8
        new = np.cumsum(~equal) - 1
        many = np.bincount(new)[new] > 1
        slots, group = slots[many], new[many]
        if not len(slots):
            break
    own = end[order] - pos[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(own[1:], own[:-1]))
    lcp[0] = 0
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(common bytes, first, last) of every interval with at least ``least`` common bytes, by one scan with a stack."""
    out, stack = [], []
    for i, h in enumerate([*lcp.tolist()[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][0] > h:
            top, first = stack.pop()
            if top >= least:
                out.append((top, first, i - 1))
        if h > 0 and (not stack or stack[-1][0] < h):
            stack.append((h, first))
    return out


class Enhanced:
    """The enhanced suffix array of a shard: distinct segments, their suffixes in order, and common prefixes."""

    def __init__(self, s: Shard, width: int):
        self.s, self.width = s, width
        size = s.count + width  # one byte on the left, then the windows
        begin = np.cumsum(size) - size
        # Anchors that only one segment has, and that once, have nothing to share.
        rolling = Rolling(VALUES[s.load], Powers())
        key = rolling.spans(begin + 1 + s.off, begin + 1 + s.off + GRAM)
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, np.int64)
        total = np.add.reduceat(s.refs, cut) if len(cut) else cut
        live = np.zeros(len(order), bool)
        live[order] = np.repeat(total > 1, np.diff(np.r_[cut, len(order)]))
        self.live = np.flatnonzero(live)
        content = rolling.spans(begin[self.live] + 1, begin[self.live] + size[self.live])
        # Segments of one hash are compared byte by byte; one that differs from the first stands alone.
        _, rep, which = np.unique(content, return_index=True, return_inverse=True)
        a, b = self.live, self.live[rep][which]
        alike = size[a] == size[b]
        alike[alike] = same_bytes(s.load, begin[a[alike]] + 1, begin[b[alike]] + 1, size[a[alike]] - 1)
        if not alike.all():
            which[~alike] = len(rep) + np.arange(int((~alike).sum()))
            rep = np.r_[rep, np.flatnonzero(~alike)]
        self.which = which
        rep = self.live[rep]
        self.count = s.count[rep]
        length = self.count + width - 1
        self.text = s.load[ranges(begin[rep] + 1, length)]
        self.begin = np.cumsum(length) - length
        self.first = np.cumsum(self.count) - self.count
        self.owner = np.repeat(np.arange(len(rep)), self.count)
        self.pos = ranges(self.begin, self.count)
        end = (self.begin + length)[self.owner]
        depth = int(length.max(initial=0))
        self.order, self.lcp = suffix_array(big_endian(self.text), self.pos, end, depth)
        self.smallest = np.full(len(rep), NULL_ID)
        np.minimum.at(self.smallest, self.which, s.doc[self.live])
        self.weight = np.bincount(self.which, s.refs[self.live], len(rep)).astype(np.int64)

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Common bytes, first and last place in the order of every left-diverse interval, by one stack scan of the shard.

        The byte left of a segment lies in another shard, so a segment's first suffix counts as
        diverse. A suffix that several members of one segment have is an interval of its own.
        """
        entry, pos = self.owner[self.order], self.pos[self.order]
        begins = pos == self.begin[entry]
        left = self.text[np.maximum(pos - 1, 0)]
        low = self.lcp < self.width
        sub = np.flatnonzero(~low | np.r_[~low[1:], False])
        common, a, b = np.array(intervals(np.where(low, 0, self.lcp)[sub], self.width), np.int64).reshape(-1, 3).T
        turns = np.cumsum(np.r_[False, left[sub][1:] != left[sub][:-1]])
        starts = np.r_[0, np.cumsum(begins[sub])]
        diverse = (turns[a] != turns[b]) | (starts[b + 1] > starts[a])
        rest = self.count[entry] + self.width - 1 - (pos - self.begin[entry])
        leaf = np.flatnonzero(begins & (self.weight[entry] > 1) & (rest > np.maximum(self.lcp, np.r_[self.lcp[1:], 0])))
        return np.r_[common[diverse], rest[leaf]], np.r_[sub[a[diverse]], leaf], np.r_[sub[b[diverse]], leaf]

    def removed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows that also start in a smaller document: what the repeats cover in all but their smallest documents."""
        s = self.s
        none = np.zeros(0, np.int64)
        if not len(self.order):
            return none, none, none, none
        common, a, b = self.repeats()
        entry = self.owner[self.order]
        place = self.first[entry] + self.pos[self.order] - self.begin[entry]
        least = np.minimum.reduceat(np.r_[self.smallest[entry], NULL_ID], np.c_[a, b + 1].ravel())[::2] if len(a) else none
        # The smallest document in which each window of the distinct segments starts.
        window = np.full(len(self.order), NULL_ID)
        total = np.cumsum((b - a + 1) * (common - self.width + 1))
        cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(SCATTER, total[-1] if len(a) else 0, SCATTER)), len(a)])
        for i, j in zip(cuts[:-1], cuts[1:]):
            size = b[i:j] - a[i:j] + 1
            n = np.repeat(common[i:j] - self.width + 1, size)
            np.minimum.at(window, ranges(place[ranges(a[i:j], size)], n), np.repeat(np.repeat(least[i:j], size), n))
        count = s.count[self.live]
        begin = np.cumsum(count) - count
        own = np.repeat(np.arange(len(self.live)), count)
        at, n = runs(window[ranges(self.first[self.which], count)] < s.doc[self.live][own], begin)
        seg = self.live[own[at]]
        refs = s.refs[seg]
        ref = ranges((np.cumsum(s.refs) - s.refs)[seg], refs)
        return np.repeat(s.doc[seg], refs), s.tag[ref], s.start[ref] + np.repeat(at - begin[own[at]], refs), np.repeat(n, refs)

    def maximal(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each maximal repeat: its bytes, and the documents and places of all its occurrences in the shard."""
        s = self.s
        if not len(self.order):
            return
        entry = self.owner[self.order]
        members = np.argsort(self.which, kind="stable")
        mcut = np.searchsorted(self.which[members], np.arange(len(self.count) + 1))
        rcut = np.cumsum(s.refs) - s.refs
        for common, a, b in zip(*(x.tolist() for x in self.repeats())):
            docs, starts = [], []
            for e in range(a, b + 1):
                own_segs = self.live[members[mcut[entry[e]] : mcut[entry[e] + 1]]]
                refs = s.refs[own_segs]
                docs.append(np.repeat(s.doc[own_segs], refs))
                starts.append(s.start[ranges(rcut[own_segs], refs)] + self.pos[self.order[e]] - self.begin[entry[e]])
            yield common, np.concatenate(docs), np.concatenate(starts)


def removable_runs(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs: doc_id, text, tag. Runs of windows of ``width`` bytes that also start in a smaller document."""
    return judge(deal(docs, Grain(False, width, GRAM)), False, lambda s: Enhanced(s, width).removed())


def maximal_repeats(df: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal repeat: its bytes, and all its occurrences as (doc_id, start)."""
    docs = documents(df, id_col, text_col)
    schema = "bytes long, occurrences array<struct<doc_id: long, start: long>>"

    def shard(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x.as_py() for b in batches for x in b.column("blob")]
        rows = [(n, [{"doc_id": None if d == NULL_ID else d, "start": p} for d, p in zip(doc.tolist(), at.tolist())]) for n, doc, at in Enhanced(read_shard(blobs, False), width).maximal()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64())])))], names=["bytes", "occurrences"])

    return deal(with_tags(docs), Grain(False, width, GRAM), copies=True).groupBy("bucket").applyInArrow(shard, schema)


def cut_batch(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """For each row: bytes, bytes removed, maximal runs removed, the bytes that stay."""
    for k, (a, b) in enumerate(window_spans(part.column("runs"), width)):
        own = data[offsets[k] : offsets[k + 1]]
        if not len(a):
            yield len(own), 0, 0, own.tobytes()
            continue
        gone = covered(len(own), a, b)
        yield len(own), int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) > 0)), own[~gone].tobytes()


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = with_tags(documents(table(spark, sf_dir, "documents")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in (x for b in unpacked(batches) for x in slices(b, 4_000_000)):
            rows = [(n, r, s, hashlib.sha256(kept).hexdigest()) for n, r, s, kept in cut_batch(part, data, offsets, 50)]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_runs(docs, removable_runs(docs, 50)).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_documents(docs: DataFrame, width: int = 50) -> DataFrame:
    """The documents with repeated bytes cut from their texts and n_chars set anew; a character that loses some of its bytes goes whole."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    plain = with_tags(plain)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in (x for b in unpacked(batches) for x in slices(b, 4_000_000)):
            kept = [k.decode(errors="ignore") for *_, k in cut_batch(part, data, offsets, width)]
            texts = pa.array([k if ok else None for k, ok in zip(kept, part.column("text").is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts, part.column("row")], names=["kept", "row"])

    schema = StructType([StructField("kept", StringType()), StructField("row", plain.schema["row"].dataType)])
    runs_of = removable_runs(plain.select("doc_id", "text", "tag"), width)
    out = with_runs(plain, runs_of).mapInArrow(cut, schema)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
