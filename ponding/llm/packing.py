"""Best-fit-decreasing packing of tokenised documents, with a segment tree over remaining capacities.

A document is its token ids and an end token; only a document longer than a sequence is
cut, into full sequences and a rest. Pieces are dealt to groups of a bounded number of
pieces and packed there; the pieces of loosely filled sequences are then dealt anew, once, to
groups of the same bound, and stay as they were if that doesn't lower the number of sequences.

Nulls: a null text is empty (its one piece is the end token). A null doc_id and repeated
rows are ordinary pieces. Ties go by length, then doc_id, piece and CRC. An empty table
gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ponding.llm.common import materialize
from ponding.llm.words import Powers, Rolling, SPACE, byte_values, mix, ranges, same_bytes, slices, word_spans

#: Bytes whose pre-tokens are looked up together, bytes that numpy handles at a time, pre-tokens for one call.
BATCH_BYTES, STEP_BYTES, CALL_WORDS = 8_000_000, 1_000_000, 10_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts, each distinct pre-token of a batch encoded once.

    Texts of ASCII and the Latin letters U+00C0 to U+024F need no composition, and their
    lower-casing and the pre-tokenizer's split go by character, so numpy finds the
    pre-tokens. A text with anything else, with an apostrophe or with the string of a token
    that the vocabulary adds (such as its end of text) goes to the library whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.bare = Tokenizer.from_file(vocabulary), Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        # The end of a pre-token shows in its last id, so that many are encoded in one call.
        self.ends = np.zeros(self.bare.get_vocab_size(), bool)
        self.ends[[i for token, i in self.bare.get_vocab().items() if token.endswith("</w>")]] = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: b for b in visible} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)} | {32: 32}
        self.kind, self.digit = np.full(256, 3, np.uint8), np.zeros(256, bool)
        self.kind[list(SPACE)] = 0
        self.kind[[*range(97, 123), *range(128, 256)]] = 1
        self.kind[48:58] = 2
        self.digit[48:58] = True
        self.values, self.powers = byte_values(), Powers()
        self.plain = re.compile("[\\x00-&(-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*").fullmatch

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin (len+1)."""
        lower = [t.lower() for t in texts]
        odd = [k for k, (t, low) in enumerate(zip(texts, lower, strict=True)) if not (self.plain(t) and self.plain(low)) or any(a in t for a in self.added)]
        for k in odd:
            lower[k] = ""
        raw = [t.encode() for t in lower]
        offsets = np.cumsum([0, *map(len, raw)])
        joined = b"".join(raw)
        starts, ends, hashes = [], [], []
        at = 0
        while at < len(raw):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
            data = np.frombuffer(joined, np.uint8)[offsets[at] : offsets[to]]
            s, e = word_spans(data, offsets[at : to + 1] - offsets[at], self.kind, self.digit)
            hashes.append(Rolling(self.values[data], self.powers).spans(s, e))
            starts.append(s + offsets[at])
            ends.append(e + offsets[at])
            at = to
        starts, ends, hashes = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((starts, np.int64), (ends, np.int64), (hashes, np.uint64)))
        whole, size = np.frombuffer(joined, np.uint8), ends - starts
        while True:
            _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            # Pre-tokens of one hash are compared with the first of them; one that differs gets a hash of its own.
            rep = first[which]
            alike = size == size[rep]
            alike[alike] = same_bytes(whole, starts[alike], starts[rep[alike]], size[alike])
            if alike.all():
                break
            hashes[~alike] = mix(hashes[~alike] + np.flatnonzero(~alike).astype(np.uint64) + np.uint64(1))
        flat = [np.zeros(0, np.uint32)]
        for k in range(0, len(first), CALL_WORDS):
            own = first[k : k + CALL_WORDS]
            plain = b" ".join([joined[i:j] for i, j in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]).decode("latin-1").translate(self.letters)
            flat.append(np.array(self.bare.encode_batch_fast([plain], add_special_tokens=False)[0].ids, np.uint32))
        flat = np.concatenate(flat)
        bounds = np.concatenate([[0], np.flatnonzero(self.ends[flat]) + 1])
        if len(bounds) != len(first) + 1:
            raise ValueError("the vocabulary has pre-tokens that do not end in an end-of-word token")
        lengths = np.diff(bounds)[which]
        ids = flat[ranges(bounds[:-1][which], lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        at = before[np.searchsorted(starts, offsets)]
        if not odd:
            return ids, at
        parts = [ids[i:j] for i, j in zip(at, at[1:])]
        for k in odd:
            parts[k] = np.array(self.whole.encode(texts[k], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def tokenised_pieces(df: DataFrame, capacity: int, end_id: int, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, little-endian, if asked for)."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step = WordIds(vocabulary), 4 * capacity
        for b, _, _ in (x for whole in batches for x in slices(whole, BATCH_BYTES)):
            ids, at = words.encode_many(b.column(1).to_pylist())
            flat, rows = ids.astype("<u4").tobytes(), []
            for doc_id, i, j in zip(b.column(0).to_pylist(), (4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True):
                for k, p in enumerate(range(i, j + 4, step)):
                    own = flat[p : min(p + step, j)]
                    if len(own) < step:
                        own += end
                    rows.append((doc_id, k, k * capacity, len(own) // 4, zlib.crc32(own), *([own] if keep_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if keep_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)

    return src.mapInArrow(pieces, schema)


class Capacities:
    """A segment tree over the capacities 0..size: which of them some open bin has left."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def put(self, left: int, bin_no: int) -> None:
        self.bins.setdefault(left, []).append(bin_no)
        at, count = self.leaves + left, self.count
        while at:
            count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (left, bin) of the tightest open bin with room for ``need``."""
        count, at = self.count, self.leaves + need
        while not count[at]:
            while at & 1:  # a right child: its parent's successor lies higher up
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            if not at & (at - 1):  # past the last leaf of this level
                return None
        while at < self.leaves:
            at *= 2
            if not count[at]:
                at += 1
        left = at - self.leaves
        got = self.bins[left].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return left, got


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset for each length (given in decreasing order), and what each bin has left."""
    tree, left = Capacities(capacity), []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        found = tree.take(need)
        if found is None:
            at = len(left)
            left.append(capacity)
        else:
            at = found[1]
        bins[i], offsets[i] = at, capacity - left[at]
        left[at] -= need
        if left[at]:
            tree.put(left[at], at)
    return bins, offsets, np.array(left, np.int64)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, grp long, bin long, offset long, spare long"


def _pack_groups(pieces: DataFrame, groups: int, capacity: int) -> DataFrame:
    """Each group packs its own pieces; a group's size is bounded by the choice of ``groups``."""

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.select(["doc_id", "piece", "start", "length", "ids_crc32"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets, left = best_fit_decreasing(t.column("length").to_numpy(), capacity)
        grp = np.full(len(bins), key[0].as_py(), np.int64)
        for name, values in (("grp", grp), ("bin", bins), ("offset", offsets), ("spare", left[bins])):
            t = t.append_column(name, pa.array(values, pa.int64()))
        return t

    grp = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(groups)).alias("grp")
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", grp).groupBy("grp").applyInArrow(pack, PACKED)


def pack(df: DataFrame, capacity: int = 4096, end_id: int = 1, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = 4096, loose: float = 0.02) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    group_pieces bounds a group. Sequences with more than ``loose`` of the capacity left
    are opened once more and packed together with those of other groups.
    """
    pieces = materialize(tokenised_pieces(df, capacity, end_id, vocabulary or default_vocabulary(), id_col, text_col), "pieces")
    # Equal rows get different groups: a hot document is dealt out like any other.
    salted = pieces.withColumn("salt", F.monotonically_increasing_id())
    n = pieces.count()
    first = materialize(_pack_groups(salted, max(1, -(-n // group_pieces)), capacity), "packed")
    kept, opened = first.where(F.col("spare") <= loose * capacity), first.where(F.col("spare") > loose * capacity)
    rest = opened.count()
    groups = max(1, -(-rest // group_pieces))
    again = materialize(_pack_groups(opened.withColumn("salt", F.lit(1) + F.monotonically_increasing_id()), groups, capacity), "repacked") if rest else opened
    before = opened.select("grp", "bin").distinct().count()
    if again.select("grp", "bin").distinct().count() > before:
        again = opened
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    number = lambda level: ((F.col("grp") * 2 + level) * (1 << 24) + F.col("bin")).alias("sequence_id")
    return kept.select(*columns, number(0), "offset").unionByName(again.select(*columns, number(1), "offset"))


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=4096, end_id=1)
