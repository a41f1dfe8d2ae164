"""Substring deduplication of word windows: a count-min prefilter, then exact groups of what it lets through.

Partition sketches of the windows' anchors are merged; an estimate is never below the
number of occurrences of any window with that anchor. Windows estimated to occur once are
done. The others are grouped exactly (by 128 bits of hash: of the window and of its
anchor), and every occurrence of a repeated one is cut. The sketch can cost time, never a result.

Nulls: a null text has no words; its kept text is empty. A null doc_id is a document of
its own kind. Repeated rows repeat each other's windows, so all of their windows go. Texts
shorter than a window stay. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ponding.llm.anchors import runs
from ponding.llm.common import documents, table, with_tags
from ponding.llm.window_exchange import KEEP, Grain, Shard, deal, judge, unpacked, window_spans, with_runs
from ponding.llm.words import covered, slices, word_spans

GRAM = 8


def repeated(s: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the shard's segments that occur at least twice in all."""
    owner = np.repeat(np.arange(len(s.key)), s.count)
    order = np.lexsort((s.key[owner], s.load))
    w, k = s.load[order], s.key[owner][order]
    cut = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (k[1:] != k[:-1])]) if len(w) else np.zeros(0, np.int64)
    total = np.add.reduceat(s.weight[owner][order].astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64)
    twice = np.zeros(len(w), bool)
    twice[order] = np.repeat(total > 1, np.diff(np.r_[cut, len(w)]))
    wanted = s.refs > 0  # others were settled where they were found
    mask = twice & wanted[owner]
    begin = np.cumsum(s.count) - s.count
    at, n = runs(mask, begin)
    own = owner[at]
    ref = (np.cumsum(s.refs) - s.refs)[own]
    return s.doc[own], s.tag[ref], s.start[ref] + at - begin[own], n


def repeated_runs(docs: DataFrame, width: int = 35) -> DataFrame:
    """docs: doc_id, text, tag. Runs of windows of ``width`` words that also start elsewhere: doc_id, tag, start, n."""
    return judge(deal(docs, Grain(True, width, GRAM)), True, repeated)


def cut_repeats(df: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its remaining words, joined by one space)."""
    docs = with_tags(documents(df, id_col, text_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in (x for b in unpacked(batches) for x in slices(b, 4_000_000)):
            starts, ends = word_spans(data, offsets, KEEP)
            first = np.searchsorted(starts, offsets)
            raw, rows = data.tobytes(), []
            for k, (a, b) in enumerate(window_spans(part.column("runs"), width)):
                i, j = first[k], first[k + 1]
                gone = covered(j - i, a, b) if len(a) else np.zeros(j - i, bool)
                left = np.flatnonzero(~gone) + i
                rows.append((j - i, int(gone.sum()), b" ".join([raw[p:q] for p, q in zip(starts[left].tolist(), ends[left].tolist())]).decode()))
            n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_runs(docs, repeated_runs(docs, width)).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
