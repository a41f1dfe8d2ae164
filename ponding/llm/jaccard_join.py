"""N-gram Jaccard join with prefixes of token combinations, and the components of its links.

Documents with equal shingle sets are one class, joined once. Of a class's shingles, in one
global order (those that occur once, rare ones, frequent ones), a prefix is indexed. A rare shingle is a signature by itself. Frequent shingles
are split by hash into many token classes of a few each, and signatures are pairs inside a
class: x shingles of a class count for x-1, so the prefix is extended until its shingles
count for more than a partner can lack. Two sets that link then share a signature
(pigeonhole over the classes). Shingles known to occur once can't be shared; they fill the
prefix and are not indexed.

Shingles are counted where they are dealt out by hash (``shared_keys``), so this holds at any
size: first a sample of all shingles, which leaves the classes that can have a partner, and
then all shingles of these, the only ones that are written. Candidates are verified on whole
sets, which lie dealt out by class. A signature's classes are first compared with one hub (a star, not
all pairs); what stars leave in different components is compared pair by pair, in groups of
signatures with one smallest class and in parts of bounded size, save pairs that sizes,
known-unique shingles and parities rule out.

Nulls: null and word-less texts have no shingles and link with nothing. Rows with a null
doc_id take part; a component's id is its smallest doc_id that is not null. Repeated rows
fall into one class. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ponding.llm.common import dealt, discard, documents, materialize, table, text_tag, total_bytes
from ponding.llm.shared_keys import Sets, ranks
from ponding.llm.sketch import Sketch, build, width_for
from ponding.llm.words import SPACE, Powers, Rolling, U, byte_values, mix, ranges, separators, slices, words_of

N, PERCENT = 5, 75
KEEP, VALUES = separators(SPACE, lower=True), byte_values(lower=True)
SAMPLED, FREQUENT = 0.4, 64
#: Bands of sets with fewer shingles than this index single shingles only.
SMALL = 8


def shingle_sets(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, powers: Powers, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, one after the other, and where each begins (len+1)."""
    _, _, hashes, first = words_of(data, offsets, KEEP, VALUES, powers)
    rolling = Rolling(hashes, powers)
    size = np.diff(first)
    windows = rolling.windows(n)
    long = np.maximum(size - n + 1, 0)
    values = windows[ranges(first[:-1], long)]
    doc = np.repeat(np.arange(len(size)), long)
    short = np.flatnonzero((size > 0) & (size < n))
    values = np.r_[values, rolling.spans(first[short], first[short + 1])]
    doc = np.r_[doc, short]
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])] if len(values) else np.zeros(0, bool)
    return values[new], np.searchsorted(doc[new], np.arange(len(size) + 1))


def class_ids(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, the same for equal sets (0 shingles: any)."""
    sums = np.r_[U(0), np.cumsum(mix(values + U(0x7F4A7C15)))]
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U)).astype(np.int64)


def _sampled(values: np.ndarray) -> np.ndarray:
    return (mix(values ^ U(0xA5A5A5A5)) >> U(40)) < U(int(SAMPLED * (1 << 24)))


def signatures(values: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set. rank: 0 occurs once, 1 rare, 2 frequent."""
    n = len(values)
    smallest = -(-n * percent // 100)  # shingles that a partner shares at least, and its smallest size
    lacking = n - smallest
    out = []
    for band in {n.bit_length(), smallest.bit_length()}:
        if (1 << (band - 1)) < SMALL:
            token_class, order = values, np.lexsort((values, rank))
            gain = np.ones(n, np.int64)
        else:
            classes = U(max(1, (1 << (band - 1)) // SMALL))
            token_class = np.where(rank == 2, mix(values) % classes, U(0))
            order = np.lexsort((values, token_class, rank))
            first = np.r_[True, token_class[order][1:] != token_class[order][:-1]] | np.r_[True, rank[order][1:] != rank[order][:-1]]
            gain = np.where((rank[order] == 2) & first, 0, 1)
        end = int(np.searchsorted(np.cumsum(gain), lacking + 1)) + 1
        order = order[:end]
        paired = (rank[order] == 2) if (1 << (band - 1)) >= SMALL else np.zeros(len(order), bool)
        out.append(mix(values[order[~paired & (rank[order] > 0)]]))
        two = order[paired]
        if len(two) > 1:
            group, v = token_class[two], values[two]
            for step in range(1, len(two)):
                same = np.flatnonzero(group[step:] == group[:-step])
                if not len(same):
                    break
                out.append(mix(mix(v[same] + U(band)) + v[same + step]))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


def _distinct_classes(values: np.ndarray, first: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which of the documents are the first of their class here; those without shingles are left out."""
    ids, keep = class_ids(values, first), []
    for k, (c, n) in enumerate(zip(ids.tolist(), np.diff(first).tolist(), strict=True)):
        if n and c not in seen:
            seen.add(c)
            keep.append(k)
    return np.array(keep, np.int64)


SETS = "cid long, n int, shingles binary"
CANDIDATES = "cid long, n int, once int, sigs binary, parity binary"
#: Counters for each class that can have a partner: of the others, one in 250 passes with them, and the next count drops it.
PER_CLASS = 16
PARITY_BITS = 1024


def parity(values: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each of the bits. Two sets differ in at least as many shingles as their parities in bits."""
    counts = np.bincount((mix(values ^ U(0x3C6EF372)) % U(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of parities differ."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), np.uint64).reshape(-1, PARITY_BITS // 64)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[name for name, _ in fields])


def _few(ones: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n shingles with so many known to occur nowhere else can have a partner."""
    return ones <= n - -(-n * percent // 100)


def _ones(rank: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many ranks of each set are 0."""
    return np.diff(np.r_[0, np.cumsum(rank == 0)][first])


def possible_texts(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Tags of the texts whose classes can have a partner, as far as a sample of the shingles tells; of a class, one text of each task.

    A set whose shingles mostly occur once has no partner, whatever the others are.
    """

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[Sets]:
        powers, seen = Powers(), set()
        for part, data, offsets in (x for b in batches for x in slices(b, 2_000_000)):
            values, first = shingle_sets(part, data, offsets, powers, n)
            new, size = _distinct_classes(values, first, seen), np.diff(first)
            own = values[ranges(first[new], size[new])]
            keep = _sampled(own)
            yield part.column("tag").to_numpy()[new], size[new], own[keep], np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(size[new])]]

    def left(tags: np.ndarray, size: np.ndarray, rank: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(tags[_few(_ones(rank, first), size, percent)])], names=["tag"])

    return ranks(docs.select("text", text_tag()), sampled, total_bytes(docs) / 6.0 * SAMPLED, lambda counts: counts > 1, left, "tag long")


def possible_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The sets of those classes, each once, dealt out by cid, so that no join shuffles them: cid, n, shingles."""
    tags = materialize(possible_texts(docs, n, percent), "possible")
    # A filter of the tags alone: it grows with the texts that pass, not with their shingles, and who passes by mistake does no harm.
    passed = build(tags, lambda b: [b.column("tag").to_numpy().view(U)], width_for(tags.count(), PER_CLASS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen, passing = Powers(), set(), Sketch(*passed.value)
        for b in batches:
            b = b.filter(pa.array(passing.estimate(b.column("tag").to_numpy().view(U)) > 0))
            for part, data, offsets in slices(b, 2_000_000):
                values, first = shingle_sets(part, data, offsets, powers, n)
                ids = class_ids(values, first)
                new = _distinct_classes(values, first, seen).tolist()
                yield _batch(SETS, [(int(ids[k]), int(first[k + 1] - first[k]), values[first[k] : first[k + 1]].tobytes()) for k in new])

    # Tasks keep one of each class; so does the shuffle, for copies in different tasks.
    out = dealt(docs.select("text", text_tag()).mapInArrow(sets, SETS).dropDuplicates(["cid"]), "cid")
    passed.destroy()
    discard(tags)
    return out


def candidate_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Classes that can have a partner among the sets: cid, n, once (shingles known to occur nowhere else), sigs, parity; dealt out by cid."""

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[Sets]:
        for b in batches:
            n = b.column("n").to_numpy().astype(np.int64)
            yield b.column("cid").to_numpy(), n, np.frombuffer(b"".join(x.as_py() for x in b.column("shingles")), U), np.r_[0, np.cumsum(n)]

    def left(cids: np.ndarray, size: np.ndarray, rank: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        keep = np.flatnonzero(_few(_ones(rank, first), size, percent)).tolist()
        return _batch("cid long, ranks binary", [(int(cids[k]), rank[first[k] : first[k + 1]].tobytes()) for k in keep])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cid, blob, known in zip(b.column("cid").to_pylist(), b.column("shingles"), b.column("ranks"), strict=True):
                v, rank = np.frombuffer(blob.as_py(), U), np.frombuffer(known.as_py(), np.uint8)
                rows.append((cid, len(v), int((rank == 0).sum()), signatures(v, rank, percent).tobytes(), parity(v)))
            yield _batch(CANDIDATES, rows)

    total = int(sets.agg(F.sum("n")).first()[0] or 0)
    rank_of = lambda counts: np.where(counts == 1, 0, np.where(counts >= FREQUENT, 2, 1))
    ranked = ranks(sets, whole_sets, total, rank_of, left, "cid long, ranks binary")
    return dealt(ranked.join(sets, "cid").select("cid", "shingles", "ranks").mapInArrow(signed, CANDIDATES), "cid")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            part = b.slice(i, 2000)
            sigs = [np.frombuffer(x.as_py(), np.int64) for x in part.column("sigs")]
            size = [len(x) for x in sigs]
            flat = np.concatenate([*sigs, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(flat), *(pa.array(np.repeat(part.column(c).to_numpy(), size)) for c in ("cid", "n", "once"))], names=["sig", "cid", "n", "once"])


def possible(a: str, b: str, percent: int):
    """Whether sizes and known-unique shingles leave a pair a chance: the shared part is at most what neither has alone."""
    shared = F.least(F.col(f"n{a}") - F.col(f"once{a}"), F.col(f"n{b}") - F.col(f"once{b}"))
    return 100 * shared >= percent * (F.col(f"n{a}") + F.col(f"n{b}") - shared)


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities leave a link possible: linked sets differ in few shingles. Loses no link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy()
            ok = (100 + percent) * apart(bits(b.column("pa")), bits(b.column("pb"))) <= (100 - percent) * total if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda k: sets.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(test, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                u, v = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = np.concatenate([u, v])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * shared >= percent * (len(u) + len(v) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # The sets lie dealt out by cid: a pair takes one along, and the other waits for it.
    s = sets.select("cid", "shingles")
    joined = pairs.join(s.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(s.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(cid, comp): the smallest id reachable. Labels spread along links and along labels until nothing changes.

    After only some ``rounds`` equal labels still mean that ids are linked, but not the other way round.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.col("cid"), F.min("b")).alias("comp")), "labels")
    kept = labels
    for left in itertools.count(1) if rounds is None else range(rounds, 0, -1):
        near = both.join(labels.select(F.col("cid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("near"))
        up = labels.select(F.col("cid").alias("comp"), F.col("comp").alias("up"))
        new = labels.join(up, "comp", "left").join(near, "cid").select("cid", F.least("comp", F.coalesce("up", "comp"), "near").alias("comp"), F.col("comp").alias("old"))
        old, kept = kept, materialize(new, "labels")
        discard(old)
        new, labels = kept, kept.select("cid", "comp")
        if left == 1 and rounds or not rounds and not new.where(F.col("comp") != F.col("old")).limit(1).count():
            return labels


def cross_pairs(percent: int):
    """Of two parts of a group's classes (or one with itself) the pairs in different components that neither sizes nor parities rule out."""

    def pairs(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by("n")
        one, part = key[1].as_py() == key[2].as_py(), t.column("part").to_numpy()
        cid, n, once, comp = (t.column(c).to_numpy() for c in ("cid", "n", "once", "comp"))
        n, once, odd = n.astype(np.int64), once.astype(np.int64), bits(t.column("parity"))
        for i in range(0, len(cid), 256):
            # Partners are at least as large, and not larger than size allows.
            top = int(np.searchsorted(n, n[min(i + 256, len(n)) - 1] * 100 // percent, "right"))
            a, b = np.arange(i, min(i + 256, len(cid)))[:, None], np.arange(i + 1, max(top, i + 1))[None, :]
            shared = np.minimum((n - once)[a], (n - once)[b])
            ok = (b > a) & (one | (part[a] != part[b])) & (comp[a] != comp[b]) & (100 * shared >= percent * (n[a] + n[b] - shared))
            x, y = np.nonzero(ok)
            x, y = a[x, 0], b[0, y]
            close = np.concatenate([(100 + percent) * apart(odd[x[k : k + 50_000]], odd[y[k : k + 50_000]]) <= (100 - percent) * (n[x[k : k + 50_000]] + n[y[k : k + 50_000]]) for k in range(0, len(x), 50_000)] or [np.zeros(0, bool)])
            x, y = x[close], y[close]
            p, q = cid[x], cid[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    return pairs


#: Classes of a group that meet in one task, about: a larger group is dealt out by pairs of parts of this size.
PART = 4_000


def merged_groups(rest: DataFrame) -> DataFrame:
    """The classes of all signatures with one smallest class: least, cid, n, once, comp, size (of the group).

    Two signatures have the same smallest class as likely as their classes overlap, so those
    that hold nearly the same classes, as the many of a text with many copies do, are compared
    once. Every pair of a signature is in its group.
    """
    own = materialize(rest.select("least", "cid", "n", "once", "comp").distinct(), "groups")
    sizes = own.groupBy("least").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("least", "size")
    return own.join(sizes, "least")


def in_parts(groups: DataFrame) -> DataFrame:
    """Each class of a group once for every part of it: i and j, the parts that meet, and part, its own."""
    n = F.ceil(F.col("size") / PART).cast("int")
    own = groups.withColumn("part", F.pmod(F.xxhash64("cid"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return own.select("least", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cid", "n", "once", "comp", "parity")


#: Stars go on until few pairs are left to compare one by one, or for this many rounds. A star's
#: labels spread in one round; labels that lag behind only leave more pairs to compare.
STARS, SPREAD = 2, 1


def links_and_components(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cid, comp) for every class with a link. found: the candidates, whose shingles are in sets.

    A star's hub is the class with the fewest shingles of its own: the text that the others
    of a group of near copies were made from, where it is among them.
    """
    index = found.select("sigs", "cid", "n", "once").mapInArrow(_index, "sig long, cid long, n int, once int")
    rest = index.groupBy("sig", "cid").agg(F.first("n").alias("n"), F.first("once").alias("once")).withColumn("comp", F.col("cid"))
    links = labels = None
    for _ in range(STARS):
        hubs = rest.groupBy("sig").agg(F.min(F.struct("once", "cid", "n", "comp")).alias("hub"), F.min("cid").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        rest = materialize(rest.drop("least").join(hubs.select("sig", "hub", "least"), "sig").where(F.col("cid") != F.col("hub.cid")), "index")
        if not rest.limit(1).count():
            break
        star = rest.where(F.col("comp") != F.col("hub.comp"))
        star = star.select(F.col("cid").alias("b"), F.col("hub.cid").alias("a"), F.col("n").alias("nb"), F.col("once").alias("onceb"), F.col("hub.n").alias("na"), F.col("hub.once").alias("oncea"))
        pairs = star.where(possible("a", "b", percent)).select("a", "b").distinct()
        new = verify(near(pairs, found, percent), sets, percent)
        links = materialize(new if links is None else links.union(new), "links")
        labels = components(links, SPREAD)
        rest = rest.drop("comp", "hub").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        rest = materialize(rest, "rest")
        # Signatures in one component are settled; the next round's hubs leave them out.
        left = rest.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        size = left.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if not size[0] or size[1] <= 8 * size[0]:
            break
    if links is None:
        return materialize(found.select("cid", F.col("cid").alias("comp")).limit(0), "labels")
    groups = merged_groups(rest).join(found.select("cid", "parity"), "cid")
    pairs = in_parts(groups).groupBy("least", "i", "j").applyInArrow(cross_pairs(percent), "a long, b long").distinct()
    return components(links.union(verify(pairs, sets, percent)))


def classes(docs: DataFrame, n: int = N) -> DataFrame:
    """docs: doc_id, text and others. Replaces text by n_shingles and cid (null without shingles)."""
    rest = [c for c in docs.columns if c != "text"]

    def per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for part, data, offsets in (x for b in batches for x in slices(b, 2_000_000)):
            values, first = shingle_sets(part, data, offsets, powers, n)
            size = np.diff(first)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(size.astype(np.int64)), pa.array(class_ids(values, first), mask=size == 0)], names=[*rest, "n_shingles", "cid"])

    schema = StructType([*[docs.schema[c] for c in rest], StructField("n_shingles", LongType()), StructField("cid", LongType())])
    return docs.mapInArrow(per_row, schema)


def join(df: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, tag (of its text), n_shingles, class_id (its set), group (the component's key) and
    component_id (the smallest doc_id linked, itself included). class_id and group are null without shingles."""
    docs = documents(df, id_col, text_col)
    own = materialize(classes(docs.select("*", text_tag()), n), "classes")
    sets = possible_sets(docs, n, percent)
    found = candidate_sets(sets, percent)
    comps = links_and_components(found, sets, percent)
    discard(sets, found)
    ids = own.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("smallest"))
    named = ids.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    ids_of = named.groupBy("comp").agg(F.min("smallest").alias("component_id"))
    named = named.join(ids_of, "comp").select(F.col("cid").alias("k"), F.col("comp").alias("group"), "component_id")
    out = own.join(named, own.cid == named.k, "left")
    return out.select("doc_id", "tag", "n_shingles", F.col("cid").alias("class_id"), "group", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with its columns: that of the smallest doc_id (null last). Rows without shingles stay."""
    joined = materialize(join(docs), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("best")
    keep = joined.where(F.col("group").isNotNull()).groupBy("group").agg(best).select(F.col("best.doc_id").alias("k_id"), F.col("best.tag").alias("k_tag"))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text_tag())
    wordless = ~F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    kept = tagged.join(keep, tagged.id.eqNullSafe(keep.k_id) & (tagged.tag == keep.k_tag), "left_semi").where(~wordless)
    # Repeated rows share the key; the extra pass over them is spared where there are none.
    if joined.groupBy("doc_id", "tag").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["id", "tag"])
    return kept.unionByName(tagged.where(wordless)).select("row.*")
