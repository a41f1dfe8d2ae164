"""The trie of conversation prefixes, from rolling fingerprints.

Turns become codes first: a 64-bit hash of role and text, and a number that tells apart
texts of one hash, so that equal codes are equal turns. Rows are then dealt by ranges of
(conversation, order), so that a conversation of any length is spread over tasks; each task
scans its rows with numpy for places and polynomial prefix sums, and what a conversation
brings along from earlier tasks is added afterwards (at most one such row for each task).

Prefixes of one depth and fingerprint are a candidate group. A group holds if the last turn
and the group before it are those of its representative for every member; as the groups
before hold as well, that is turn by turn. Groups that do not hold are split by what differs,
their members' next rows follow, and all is verified again until every group holds.

What a node's subtree adds up to is gathered along the members' own paths: a node counts its
saving at its smallest member, a running sum from each conversation's end carries savings up,
and a node adds those of its members. Only nodes with two members or more take part.

Defined results: a null role or text is empty, a null turn comes first, equal turn numbers go by
the code of the turn, repeated rows are turns like any other, and rows without conv_id are
left out. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ponding.llm.common import discard, materialize, partitions, table
from ponding.llm.words import BASE, U, Powers, mix

WORD = r"[^\x20\x09-\x0D]+"
#: Depths in one window of the running sums, and ids in one piece of a list that is hashed.
STRETCH, PIECE_IDS = 1024, 2000
NODE = ["depth", "fp"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
SCANNED = "conv_id long, key long, twin int, words long, part int, place long, total long"
PREFIXES = "conv_id long, key long, twin int, words long, depth long, fp long, before long"


def coded(df: DataFrame, key_bits: int = 64) -> DataFrame:
    """conv_id, turn, key, twin, words: (key, twin) is the same for two turns if and only if role and text are."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")).where("conv_id is not null")
    key = F.xxhash64("role", "text")
    rows = rows.withColumn("key", key if key_bits == 64 else F.pmod(key, F.lit(1 << key_bits)))
    words = F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")
    texts = rows.select("key", "role", "text").distinct()
    shared = materialize(texts.groupBy("key").count().where("count > 1").select("key"), "keys")
    twin = F.lit(0).alias("twin")
    if not shared.isEmpty():
        twins = texts.join(shared, "key", "left_semi").withColumn("twin", F.row_number().over(Window.partitionBy("key").orderBy("role", "text")))
        rows = rows.join(twins, ["key", "role", "text"], "left")
        twin = F.coalesce("twin", F.lit(0)).alias("twin")
    return rows.select("conv_id", "turn", "key", twin, words)


def _values(b: pa.RecordBatch) -> np.ndarray:
    """A 64-bit value for each turn's code."""
    return mix(b.column("key").to_numpy().astype(np.int64).view(np.uint64) + U(BASE) * (b.column("twin").to_numpy().astype(np.uint64) + U(1)))


def _carried(key: tuple, t: pa.Table) -> pa.Table:
    """What a conversation's stretches begin with: turns and prefix sum of the stretches before."""
    t = t.sort_by("part")
    before, total, offs, carries = 0, 0, [], []
    for n, s in zip(t.column("n").to_pylist(), t.column("s").to_pylist(), strict=True):
        offs.append(before)
        carries.append(total - 2**64 if total >= 2**63 else total)
        total = (total + pow(BASE, before, 2**64) * s) % 2**64
        before += n
    return t.select(["part", "conv_id"]).append_column("off", pa.array(offs, pa.int64())).append_column("carry", pa.array(carries, pa.int64()))


def prefixes(rows: DataFrame, order: list[Column], bits: int = 64) -> DataFrame:
    """Each row's place in its conversation (depth, from 1), the fingerprint of all turns up to it (fp), and of those before it (before)."""
    spark, mask = rows.sparkSession, U(2**bits - 1)
    keys = [F.col("conv_id"), *order, F.col("at")]
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, powers, last, seen, total = TaskContext.get().partitionId(), Powers(), None, 0, U(0)
        for b in batches:
            conv, n = b.column("conv_id").to_numpy(), b.num_rows
            if not n:
                continue
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            run = np.repeat(starts, np.diff(np.r_[starts, n]))
            place, old = np.arange(n) - run, int(conv[0]) == last
            first = run == 0
            if old:
                place[first] += seen
            terms = _values(b) * powers.to(int(place.max()) + 1)[0][place]
            sums = np.cumsum(terms)
            sums -= (sums - terms)[run]
            if old:
                sums[first] += total
            last, seen, total = int(conv[-1]), int(place[-1]) + 1, sums[-1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "key", "twin", "words")), pa.array(np.full(n, part, np.int32)), pa.array(place), pa.array(sums.view(np.int64))], names=["conv_id", "key", "twin", "words", "part", "place", "total"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            if not b.num_rows:
                continue
            off, place = b.column("off").to_numpy(), b.column("place").to_numpy()
            distinct, which = np.unique(off, return_inverse=True)
            lift = np.array([pow(BASE, int(o), 2**64) for o in distinct], np.uint64)[which]
            fp = b.column("carry").to_numpy().view(np.uint64) + lift * b.column("total").to_numpy().view(np.uint64)
            before = fp - lift * _values(b) * powers.to(int(place.max()) + 1)[0][place]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "key", "twin", "words")), pa.array(off + place + 1), pa.array((fp & mask).view(np.int64)), pa.array((before & mask).view(np.int64))], names=["conv_id", "key", "twin", "words", "depth", "fp", "before"])

    scanned = materialize(dealt.select("conv_id", "key", "twin", "words").mapInArrow(scan, SCANNED), "scanned")
    stretches = scanned.groupBy("part", "conv_id").agg((F.max("place") + 1).alias("n"), F.max_by("total", "place").alias("s"))
    several = stretches.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).where("of > 1").drop("of")
    # A task begins inside one conversation at most: as many rows as tasks, so they are broadcast.
    carried = several.groupBy("conv_id").applyInArrow(_carried, "part int, conv_id long, off long, carry long").where("off > 0")
    whole = scanned.join(F.broadcast(carried), ["part", "conv_id"], "left").withColumns({"off": F.coalesce("off", F.lit(0).cast("long")), "carry": F.coalesce("carry", F.lit(0).cast("long"))})
    out = materialize(whole.mapInArrow(finish, PREFIXES), "prefixes")
    discard(scanned)
    return out


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes and their groups, once every group's members agree with its representative; groups that don't are split."""
    turn, rounds = ["before", "key", "twin"], 0
    while True:
        ends = [f(c).alias(f"{name}_{c}") for c in turn for name, f in (("low", F.min), ("high", F.max))]
        groups = materialize(rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep"), F.max("words").alias("words"), *ends), "groups")
        wrong = groups.where(" or ".join(f"low_{c} <> high_{c}" for c in turn)).select(*NODE)
        if wrong.isEmpty():
            return rows, groups.select(*NODE, "n", "rep", "words", F.col("low_before").alias("before"))
        rounds += 1
        named = rows.join(wrong, NODE, "left_semi").select("conv_id", "depth", F.xxhash64(*turn, F.lit(rounds)).alias("own"))
        named = materialize(named, "split")
        after = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("own").alias("above"))
        again = rows.join(named, ["conv_id", "depth"], "left").join(after, ["conv_id", "depth"], "left")
        again = materialize(again.select("conv_id", "key", "twin", "words", "depth", F.coalesce("own", "fp").alias("fp"), F.coalesce("above", "before").alias("before")), "prefixes")
        discard(rows, groups, named)
        rows = again


def id_digests(ends: DataFrame) -> DataFrame:
    """depth, fp, n_ends, ends_sha256 of the ascending, comma-joined ids that end at a node.

    Ids are dealt by ranges of (node, id), so a node's list may be long; its pieces are then hashed in order, one at a time.
    """
    n, keys = partitions(ends.sparkSession), [*NODE, "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            depth, fp, ids = (b.column(c).to_numpy() for c in keys)
            cuts = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1])]) if len(ids) else np.zeros(0, np.int64)
            cuts = np.union1d(cuts, np.arange(0, len(ids), PIECE_IDS)).astype(np.int64)
            to, text = [*cuts[1:].tolist(), len(ids)], ids.astype(str).tolist()
            rows = [depth[cuts], fp[cuts], np.full(len(cuts), part, np.int32), np.arange(seq, seq + len(cuts)), np.diff(np.r_[cuts, len(ids)])]
            seq += len(cuts)
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array([",".join(text[i:j]) for i, j in zip(cuts.tolist(), to)], pa.string())], names=[*NODE, "part", "seq", "ids", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, sha, done = None, 0, None, []
        for b in batches:
            for depth, fp, m, text in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids", "text")), strict=True):
                if (depth, fp) != now:
                    if now:
                        done.append((*now, count, sha.hexdigest()))
                    now, count, sha = (depth, fp), 0, hashlib.sha256()
                sha.update(("," * (count > 0) + text).encode())
                count += m
            if len(done) > 5000:
                yield out(done)
                done = []
        if now:
            done.append((*now, count, sha.hexdigest()))
        yield out(done)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*NODE, "n_ends", "ends_sha256"])

    listed = ends.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(pieces, "depth long, fp long, part int, seq long, ids long, text string")
    return listed.repartition(n, *NODE).sortWithinPartitions(*NODE, "part", "seq").mapInArrow(digest, "depth long, fp long, n_ends long, ends_sha256 string")


def trie(rows: DataFrame, ids: DataFrame, order: list[Column], bits: int = 64) -> DataFrame:
    """One row per node. rows: conv_id, key, twin, words and what ``order`` needs; ids: all conv_ids, once each, those without turns too.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    rows, nodes = verified(prefixes(rows, order, bits))
    ids = materialize(ids, "ids")
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")).select("conv_id", "end.*")
    turnless = ids.join(last, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"))
    ends = materialize(id_digests(last.unionByName(turnless)), "ends")
    zero = F.lit(0).cast("long")
    root = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep")).where("n > 0").select(zero.alias("depth"), zero.alias("fp"), "n", "rep", zero.alias("words"), F.lit(None).cast("long").alias("before"))
    full = nodes.unionByName(root).join(ends, NODE, "left")
    deep = nodes.where("depth > 1")
    children = deep.groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("fp")).agg(F.count(F.lit(1)).alias("n_children"))
    children = children.unionByName(nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children")).select(zero.alias("depth"), zero.alias("fp"), "n_children"))
    # Members' rows in nodes that several share, with the saving of the nodes that count at this member.
    common = nodes.where("n > 1").select(*NODE, "rep", ((F.col("n") - 1) * F.col("words")).alias("saving"))
    on = rows.select("conv_id", *NODE).join(common, NODE)
    on = on.select("conv_id", *NODE, F.floor(F.col("depth") / STRETCH).alias("stretch"), F.when(F.col("conv_id") == F.col("rep"), F.col("saving")).otherwise(zero).alias("saving"))
    on = materialize(on, "members")
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    whole = on.groupBy("conv_id", "stretch").agg(F.sum("saving").alias("own")).select("conv_id", "stretch", F.coalesce(F.sum("own").over(later), zero).alias("later"))
    leaves = full.where("n_ends = n").select(F.col("rep").alias("conv_id"), F.lit(1).alias("leaf"))
    below = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth"))
    carried = on.join(whole, ["conv_id", "stretch"]).select("conv_id", *NODE, (F.col("later") + F.sum("saving").over(below)).alias("saved")).join(leaves, "conv_id", "left")
    rolled = carried.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.count("leaf").alias("n_leaves"))
    total = common.agg(F.coalesce(F.sum("saving"), zero).alias("saved_tokens")).crossJoin(F.broadcast(leaves.agg(F.count(F.lit(1)).alias("n_leaves")))).select(zero.alias("depth"), zero.alias("fp"), "saved_tokens", "n_leaves")
    joined = full.join(children, NODE, "left").join(rolled.unionByName(total), NODE, "left")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("before"), F.col("rep").alias("parent_conv_id"))
    out = joined.where("depth > 1").join(above, ["depth", "before"], "left")
    top = joined.where("depth <= 1").crossJoin(F.broadcast(ids.agg(F.min("conv_id").alias("least")))).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("least"))).drop("least")
    return out.unionByName(top).select(
        F.col("rep").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def with_shared_heads(rows: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % every, h = crc32(c) % heads, in place of its own. rows: coded turns.

    Adds place, the order of the turns in a conversation. The remainder has the sign of c, as in SQL.
    """
    ranked = prefixes(rows, [F.col("turn").asc_nulls_first(), F.col("key"), F.col("twin")]).select("conv_id", "key", "twin", "words", (F.col("depth") - 1).alias("place"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    first = ranked.where(F.col("place") < heads - 1).withColumnRenamed("conv_id", "of")
    ids = ranked.select("conv_id").distinct().withColumns({"of": F.col("conv_id") - F.col("conv_id") % every, "h": h})
    return ranked.where(F.col("place") >= h).unionByName(ids.join(first, "of").where("place < h").drop("of", "h"))


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    rows = materialize(coded(table(spark, sf_dir, "conversations")), "turns")
    return trie(with_shared_heads(rows), rows.select("conv_id").distinct(), [F.col("place")])
