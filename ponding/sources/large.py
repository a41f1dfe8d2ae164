"""Large documents in pieces: features of one collection, placemarks of one file, read by many tasks.

Spark's text source cuts a file at a closing brace or tag wherever its splits fall, so tasks
share one document and none holds it. What a piece means depends on what stands before it:
braces and quotes that are open, folders that are open. Each split sums that up in one small
row; the rows of a file are folded in order, and a second pass over the splits knows where it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ponding.operators.grid import drop, settle

#: Depth of brackets at which a feature opens: inside the array of the collection.
INSIDE = 2
ORDER = "file string, split long"


def pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """file, split, value: the file between its ``end`` strings; a split's rows come in order."""
    return spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _brackets(text: bytes, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where brackets outside strings stand and whether they open (1) or close (-1); whether the text ends inside a string."""
    b = np.frombuffer(text, np.uint8)
    slash = b == 92
    quotes = np.flatnonzero(b == 34)
    if slash.any():
        # A quote counts unless an odd number of backslashes stands before it.
        at = np.arange(len(b))
        plain = np.maximum.accumulate(np.where(slash, -1, at))
        quotes = quotes[(quotes - 1 - np.where(quotes > 0, plain[quotes - 1], -1)) % 2 == 0]
    found = np.flatnonzero((b == 123) | (b == 91) | (b == 125) | (b == 93))
    inside = (np.searchsorted(quotes, found) + quoted) % 2 == 1
    found = found[~inside]
    return found, np.where((b[found] == 123) | (b[found] == 91), 1, -1), bool((len(quotes) + quoted) % 2)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """The text of each split in stretches; every piece has its closing brace again."""
    for b in batches:
        files, splits, values = (b.column(c).to_pylist() for c in ("file", "split", "value"))
        cuts = [0, *[i for i in range(1, len(files)) if (files[i], splits[i]) != (files[i - 1], splits[i - 1])], len(files)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                yield (files[i], splits[i]), ("}".join(values[i:j]) + "}").encode()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split, whether it begins outside (0) or inside (1) a string: the change of depth and whether it ends inside one."""
    sums: dict[tuple[str, int], list[list[int]]] = {}
    for key, text in _by_split(batches):
        state = sums.setdefault(key, [[0, 0], [0, 1]])
        for s in state:
            _, step, quoted = _brackets(text, bool(s[1]))
            s[0] += int(step.sum())
            s[1] = int(quoted)
    rows = [(f, k, *s[0], *s[1]) for (f, k), s in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), *[pa.int64()] * 4))], names=["file", "split", "depth0", "ends0", "depth1", "ends1"])


def _begins(part: pd.DataFrame) -> pd.DataFrame:
    """The depth and string state with which each split of a file begins."""
    part, depth, quoted, rows = part.sort_values("split"), 0, 0, []
    for r in part.itertuples():
        rows.append((r.file, r.split, depth, quoted))
        depth, quoted = depth + (r.depth1 if quoted else r.depth0), r.ends1 if quoted else r.ends0
    return pd.DataFrame(rows, columns=["file", "split", "depth", "quoted"])


class _Open:
    """Where a split stands: its depth, whether inside a string, the text of an object that is open, whether that began here, and how many have begun."""

    def __init__(self, depth: int, quoted: bool):
        self.depth, self.quoted, self.held, self.own, self.begun = depth, quoted, b"", False, 0

    def take(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Objects that end in the text: number, kind and text."""
        found, step, self.quoted = _brackets(text, self.quoted)
        level, brace = self.depth + np.cumsum(step), np.frombuffer(text, np.uint8)[found]
        opens = found[(step == 1) & (level == INSIDE + 1) & (brace == 123)].tolist()
        closes = (found[(step == -1) & (level == INSIDE) & (brace == 125)] + 1).tolist()
        if self.depth > INSIDE:
            stop = closes[0] if closes else len(text)
            self.held += text[:stop]
            if closes:
                yield self.begun - 1, WHOLE if self.own else REST, self.held
                closes, self.held = closes[1:], b""
        for start, stop in zip(opens, closes):
            yield self.begun, WHOLE, text[start:stop]
            self.begun += 1
        if len(opens) > len(closes):
            self.held, self.own, self.begun = text[opens[-1] :], True, self.begun + 1
        self.depth += int(step.sum())

    def left(self) -> Iterator[tuple[int, int, bytes]]:
        if self.depth > INSIDE and self.held:
            yield self.begun - 1, HEAD if self.own else MIDDLE, self.held


#: An object within its split; the end, the middle and the beginning of one that reaches over several.
WHOLE, REST, MIDDLE, HEAD = range(4)


def objects(spark: SparkSession, path: str, type_: str = "Feature") -> DataFrame:
    """layer (file path), fid, feature: the objects of that type two levels inside the files' top-level objects, numbered in order, as text."""
    text = pieces(spark, path, "}")
    begins = text.mapInArrow(_sums, f"{ORDER}, depth0 long, ends0 long, depth1 long, ends1 long").groupBy("file").applyInPandas(_begins, f"{ORDER}, depth long, quoted long")
    known = {(r.file, r.split): (r.depth, bool(r.quoted)) for r in begins.collect()}  # a row for each split

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str, int], _Open] = {}
        for key, stretch in _by_split(batches):
            state = states.setdefault(key, _Open(*known[key]))
            yield frame([(*key, *row) for row in state.take(stretch)])
        yield frame([(*key, *row) for key, state in states.items() for row in state.left()])

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "split", "n", "kind", "text"])

    found = settle(text.mapInArrow(cut, f"{ORDER}, n long, kind int, text binary"))
    # Of objects that reach over splits there are at most two parts a split.
    w = Window.partitionBy("file").orderBy("split", "kind")
    parts = found.where(F.col("kind") != WHOLE).withColumn("of", F.count(F.when(F.col("kind") == HEAD, 1)).over(w))
    ordered = F.array_sort(F.collect_list(F.struct("split", "kind", F.decode("text", "UTF-8").alias("text"), "n")))
    stitched = parts.groupBy("file", "of").agg(ordered.alias("p")).select("file", F.col("p")[0].split.alias("split"), F.col("p")[0].n.alias("n"), F.concat_ws("", F.transform("p", lambda p: p.text)).alias("feature"))
    whole = found.where(F.col("kind") == WHOLE).select("file", "split", "n", F.decode("text", "UTF-8").alias("feature"))
    every = settle(whole.unionByName(stitched).where(F.get_json_object("feature", "$.type") == type_))
    drop(found)
    counts = every.groupBy("file", "split").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("file", "split", (F.sum("c").over(Window.partitionBy("file").orderBy("split")) - F.col("c")).alias("before"))
    number = F.row_number().over(Window.partitionBy("file", "split").orderBy("n")) - 1
    return every.withColumn("number", number).join(F.broadcast(before), ["file", "split"]).select(F.col("file").alias("layer"), (F.col("before") + F.col("number")).alias("fid"), "feature")


FOLDER = re.compile(r"(?s)</(?:\w+:)?Folder>|<(?:\w+:)?Folder\b[^>]*>(?:\s*<(?:\w+:)?name>(.*?)</(?:\w+:)?name>)?")
MARK = re.compile(r"<(?:\w+:)?Placemark\b")


def placemarks(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """file, pos, folder, xml: one row per placemark, with the name of the innermost folder it stands in. prefix: of the tags, such as "kml:"."""
    text = pieces(spark, path, f"</{prefix}Placemark>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str, int], list] = {}
        for b in batches:
            rows = []
            for key in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), b.column("value").to_pylist()):
                state = states.setdefault(key[:2], [0, 0, []])  # placemarks, folders closed that were open before, folders opened
                mark = MARK.search(key[2])
                for tag in FOLDER.finditer(key[2], 0, mark.start() if mark else len(key[2])):
                    if tag.group().startswith("</"):
                        if state[2]:
                            state[2] = state[2][:-1]
                        else:
                            state[1] += 1
                    else:
                        state[2] = [*state[2], tag.group(1) or ""]
                if mark:
                    rows.append((*key[:2], state[0], state[1], state[2][-1:], re.sub(r"<(/?)\w+:", r"<\1", key[2][mark.end() :])))
                    state[0] += 1
            yield frame(rows)
        yield frame([(*key, n, closed, opened, None) for key, (n, closed, opened) in states.items()])

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "split", "n", "closed", "opened", "xml"])

    def begins(part: pd.DataFrame) -> pd.DataFrame:
        """The folders open where each split begins, and the placemarks before it."""
        open_, before, rows = [], 0, []
        for r in part.sort_values("split").itertuples():
            rows.append((r.file, r.split, before, open_))
            open_ = [*open_[: max(0, len(open_) - r.closed)], *r.opened]
            before += r.n
        return pd.DataFrame(rows, columns=["file", "split", "before", "open"])

    found = settle(text.mapInArrow(scan, f"{ORDER}, n long, closed long, opened array<string>, xml string"))
    # One row for each split of a file, so it is broadcast.
    known = found.where("xml is null").groupBy("file").applyInPandas(begins, f"{ORDER}, before long, open array<string>")
    folder = F.when(F.size("opened") > 0, F.element_at("opened", -1)).otherwise(F.get("open", (F.size("open") - F.col("closed") - 1).cast("int")))
    rows = found.where("xml is not null").join(F.broadcast(known), ["file", "split"])
    return rows.select("file", (F.col("before") + F.col("n")).cast("int").alias("pos"), folder.alias("folder"), "xml")
