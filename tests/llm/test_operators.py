"""Each operator against plain Python, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ponding.llm import decontaminate, feistel_shards, jaccard_join, license_scan, packing, quality_rules, substring_dedup, suffix_dedup
from ponding.llm.common import documents
from ponding.llm.window_exchange import unpacked
from ponding.llm.words import slices
from tests.llm import brute

CLASHING = "doc_id long, text string, n_words string, tag int, runs string, items string, start int, row string, blob string, kept string, cid string, y int"


def corpus(seed=3, n=120):
    """Documents that share passages, near and exact copies, and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ka lo mi Té nü ro sa".split() for b in "ra ne li do un os it".split()]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, rows = prose(60), []
    for i in range(n):
        kind = i % 6
        if kind == 0 and i:
            words = rows[i - 6][1].split(" ")
            for _ in range(len(words) // 60):
                words[rng.randrange(len(words))] = "edited"
            rows.append((i, " ".join(words)))
        elif kind == 1:
            rows.append((i, f"{prose(rng.randint(1, 80))}\n{passage} {prose(rng.randint(0, 40))}"))
        elif kind == 2 and i > 6:
            rows.append((i, rows[i - 6][1]))
        elif kind == 3:
            rows.append((i, prose(rng.randint(0, 6))))
        else:
            rows.append((i, prose(rng.randint(20, 120))))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (None, rows[4][1]), (None, prose(70)), (None, None), (5, rows[5][1]), (5, prose(50)), (n + 3, "a " * 3000), (n + 4, "ab" * 4000), (n + 5, rows[4][1].upper())]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def table(spark, rows):
    return spark.createDataFrame([(i, t, *["x", 1, "x", "x", 1, "x", "x", "x", "x", 1]) for i, t in rows], CLASHING).repartition(5)


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_substring(spark, rows):
    got = substring_dedup.cut_repeats(table(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    same(got, brute.substring(rows))


def test_a_full_sketch_loses_nothing(spark, rows, monkeypatch):
    """With hardly any counters every anchor passes and looks frequent: the same rows, and no flood of single windows."""
    from ponding.llm import sketch, window_exchange

    monkeypatch.setattr(sketch, "BLOCK", 256)
    monkeypatch.setattr(sketch, "MOST", 256)
    monkeypatch.setattr(sketch.width_for, "__defaults__", (1.5, 256))
    many = rows + [(2000 + i, t) for i, (_, t) in enumerate(corpus(seed=5, n=240)) if t]
    assert sketch.width_for(1e9, 2.5) == 256
    same(substring_dedup.cut_repeats(table(spark, many)).select("doc_id", "n_words", "n_removed", "kept").collect(), brute.substring(many))
    same(suffix_rows(spark, many), brute.suffix(many))
    text = sum(len((t or "").encode()) for _, t in many)
    sent = window_exchange.deal(documents(table(spark, many)).selectExpr("doc_id", "text", "0L tag"), window_exchange.Grain(False, 50, 16)).agg(F.sum(F.length("blob"))).first()[0]
    assert sent < 4 * text  # single windows would be fifty times the text


def test_segments_of_one_hash_are_told_apart(spark, rows, monkeypatch):
    """A hash that equates many different segments costs time, not results."""
    from ponding.llm import window_exchange, words

    plain = words.Rolling.spans
    monkeypatch.setattr(words.Rolling, "spans", lambda self, a, b: plain(self, a, b) % words.U(3))
    chunk = window_exchange.Chunk(window_exchange.Grain(False, 50, 16), 4)
    texts = [b"x" * 30 + bytes([65 + k % 3] * 60) + b"y" * 30 for k in range(9)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.arange(10) * 120
    rolling, first = window_exchange.sequence(chunk.grain, data, offsets, words.Powers())
    s = window_exchange.segments(rolling, first, 50, 16)
    chunk.add(s, np.zeros(len(s.start), bool), rolling, data, first, np.arange(9), np.zeros(9, np.int64))
    runs = []
    for bucket, blob in chunk.flush():
        if bucket < 0:
            d, _, start, n = window_exchange.expand(blob, np.int64, np.int64, np.int64, np.int64)
            runs += [(int(i), int(a + k)) for i, a, m in zip(d, start, n) for k in range(m)]
    known = {(i, k) for i in range(3, 9) for k in range(71)}
    assert set(runs) <= known and len(runs) > 0


def suffix_rows(spark, rows):
    from ponding.llm.common import with_tags

    docs = with_tags(documents(table(spark, rows)))

    def cut(batches):
        for part, data, offsets in (x for b in unpacked(batches) for x in slices(b, 3000)):
            got = [(n, r, s, hashlib.sha256(k).hexdigest()) for n, r, s, k in suffix_dedup.cut_batch(part, data, offsets, 50)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in zip(*got))], names=["doc_id", "n", "r", "s", "h"])

    return suffix_dedup.with_runs(docs, suffix_dedup.removable_runs(docs)).mapInArrow(cut, "doc_id long, n long, r long, s long, h string").collect()


def test_suffix(spark, rows):
    same(suffix_rows(spark, rows), brute.suffix(rows))


def test_maximal_repeats_have_all_occurrences(spark):
    shared = "The quick brown fox jumps over the lazy dog near the river bank"
    docs = spark.createDataFrame([(1, f"xx {shared} one"), (2, f"yy {shared} two"), (3, f"zz {shared} three"), (4, "nothing like it")], "doc_id long, text string")
    got = suffix_dedup.maximal_repeats(docs).collect()
    full = [r for r in got if {o.doc_id for o in r.occurrences} == {1, 2, 3}]
    assert full and all(r.bytes >= 50 for r in got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert len({texts[o.doc_id][o.start : o.start + r.bytes] for o in r.occurrences}) == 1


@pytest.mark.parametrize("parts", [1, 4])
def test_maximal_repeats_of_one_chunk(spark, parts):
    """Every occurrence of every repeated window counts, also where all copies lie in one partition."""
    rng = random.Random(8)
    prose = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    shared, tail = prose(300), prose(80)
    texts = {1: prose(30) + shared + tail, 2: prose(20) + shared, 3: "x" + shared + tail, 4: shared[100:] + prose(9), 5: prose(200), 6: shared + "q", 7: shared + "q"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).repartition(parts)
    got = suffix_dedup.maximal_repeats(docs).collect()
    found = {}
    for r in got:
        assert len({texts[o.doc_id][o.start : o.start + r.bytes] for o in r.occurrences}) == 1
        for o in r.occurrences:
            for k in range(r.bytes - 49):
                found.setdefault(texts[o.doc_id][o.start + k : o.start + k + 50], set()).add((o.doc_id, o.start + k))
    windows = {}
    for i, t in texts.items():
        for k in range(len(t) - 49):
            windows.setdefault(t[k : k + 50], set()).add((i, k))
    assert found == {w: at for w, at in windows.items() if len(at) > 1}


def test_cut_documents_keeps_columns(spark, rows):
    got = suffix_dedup.cut_documents(table(spark, rows))
    assert got.columns == [c.split()[0] for c in CLASHING.split(", ")]
    assert got.count() == len(rows)
    assert got.where("doc_id = 120").first().text is None


def test_decontamination(spark, rows):
    items = [(1, " ".join(rows[4][1].split(" ")[3:20])), (2, "Short one"), (3, None), (4, ""), (10, " ".join(rows[4][1].split(" ")[3:20])), (None, rows[1][1]), (7, rows[16][1]), (8, "a " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(rows, items)
    for block in (1_000_000, 200):
        found = decontaminate.match(documents(table(spark, rows)), bench, 10, block_bytes=block)
        got = found.mapInArrow(decontaminate.digest, decontaminate.DIGEST).drop("longest_words", "longest_at", "longest_item")
        same(got.collect(), want)
    found = decontaminate.match(documents(table(spark, rows)), bench, 10)
    longest = brute.longest_matches(rows, items)
    same([(r.doc_id, *longest[r.doc_id, r.text]) for r in found.collect()], [(r.doc_id, *((r.longest_words, r.longest_at, r.longest_item))) for r in found.mapInArrow(decontaminate.digest, decontaminate.DIGEST).collect()])
    clean = decontaminate.remove_contaminated(table(spark, rows), bench)
    assert clean.columns == [c.split()[0] for c in CLASHING.split(", ")]
    assert clean.count() == sum(not r[-1] for r in want)


def test_decontamination_takes_any_vocabulary(spark):
    """An item of more different words than 16 bits can number, searched whole and in parts, for every length of match."""
    words = [f"w{k}" for k in range(70_000)]
    docs = [(1, " ".join(words[50:62])), (2, " ".join(words[69_000:70_000])), (3, " ".join(words[7:16])), (4, "x " + " ".join(words[100:400]) + " y")]
    bench = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    for block in (2_000_000, 30_000):
        got = decontaminate.match(spark.createDataFrame(docs, "doc_id long, text string"), bench, 10, block_bytes=block).mapInArrow(decontaminate.digest, decontaminate.DIGEST)
        same(got.select("doc_id", "n_hit", "longest_words", "longest_at").collect(), [(1, 12, 12, 0), (2, 1000, 1000, 0), (3, 0, 0, None), (4, 300, 300, 1)])


def test_jaccard(spark, rows):
    got = jaccard_join.join(table(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    # A component of null ids only has no smallest id.
    same(got, brute.jaccard_components(rows))


def test_jaccard_of_many_near_copies(spark):
    """Frequent shingles go by combinations; every link of a large group is found."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60)))) for i in range(40)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).select("doc_id", "n_shingles", "component_id").collect()
    same(got, brute.jaccard_components(rows))


def test_jaccard_of_a_hot_signature(spark, monkeypatch):
    """Many texts that share a template but do not link: groups are dealt out by parts, and no link is lost."""
    monkeypatch.setattr(jaccard_join, "PART", 40)
    rng = random.Random(7)
    template = [f"t{k}" for k in range(60)]
    rows = [(i, " ".join(template + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(25, 40))])) for i in range(250)]
    rows += [(1000 + i, rows[i * 7][1] + " more") for i in range(30)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).select("doc_id", "n_shingles", "component_id").collect()
    same(got, brute.jaccard_components(rows))
    members = spark.range(500).selectExpr("id % 2 least", "id cid", "1 n", "0 once", "id comp", "cast('' as binary) parity", "250L size")
    parts = jaccard_join.in_parts(members)
    assert parts.groupBy("least", "i", "j").count().agg(F.max("count")).first()[0] <= 160
    met = parts.alias("x").join(parts.alias("y"), ["least", "i", "j"]).where("x.cid < y.cid and (i = j or x.part <> y.part)")
    assert met.select("x.cid", F.col("y.cid").alias("z")).count() == 2 * 250 * 249 // 2
    rest = spark.createDataFrame([(s, c, 1, 0, c, min(m)) for s, m in enumerate(([1, 2, 3], [1, 3, 4], [2, 5], [7, 8])) for c in m], "sig long, cid long, n int, once int, comp long, least long")
    assert sorted((r.least, r.cid, r.size) for r in jaccard_join.merged_groups(rest).collect()) == [(1, 1, 4), (1, 2, 4), (1, 3, 4), (1, 4, 4), (2, 2, 2), (2, 5, 2), (7, 7, 2), (7, 8, 2)]


def test_jaccard_writes_few_sets_however_many_shingles(spark, monkeypatch):
    """Where a sketch that tasks hold would have hardly any counters, sets without partners still are not written."""
    from ponding.llm import sketch

    monkeypatch.setattr(sketch, "BLOCK", 256)
    monkeypatch.setattr(sketch, "MOST", 256)
    monkeypatch.setattr(sketch.width_for, "__defaults__", (1.5, 256))
    written = []

    def recorded(write):
        def put(df, *rest):
            out = write(df, *rest)
            if "shingles" in out.columns:
                written.append(out.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()[0])
            return out

        return put

    for name in ("materialize", "dealt"):
        if hasattr(jaccard_join, name):
            monkeypatch.setattr(jaccard_join, name, recorded(getattr(jaccard_join, name)))
    rng = random.Random(11)
    rows = [(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randint(40, 120)))) for i in range(220)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(12)] + [(2000, rows[30][1]), (2001, None), (2002, "two words"), (2003, "Two words")]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).select("doc_id", "n_shingles", "component_id").collect()
    want = brute.jaccard_components(rows)
    same(got, want)
    assert 0 < sum(written) < 8 * sum(n for _, n, _ in want) / 3


def test_ranks_of_shared_keys(spark, monkeypatch):
    """Small blocks, many parts: every key of every set gets its count, in order, and a set without keys stays."""
    from ponding.llm import shared_keys

    monkeypatch.setattr(shared_keys, "BLOCK", 300)
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
    sets = [np.sort(rng.choice(pool, size, replace=False)) for size in (0, 1, 2, 390, *rng.integers(3, 60, 80).tolist())]
    counts = dict(zip(*(x.tolist() for x in np.unique(np.concatenate(sets), return_counts=True)), strict=True))

    def sets_of(batches):
        for b in batches:
            found = [np.frombuffer(x.as_py(), np.uint64) for x in b.column("keys")]
            yield b.column("id").to_numpy(), 7 * b.column("id").to_numpy(), np.concatenate(found), np.r_[0, np.cumsum([len(x) for x in found])]

    def finish(ids, numbers, rank, first):
        blobs = [rank[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(numbers), pa.array(blobs, pa.binary())], names=["id", "number", "ranks"])

    df = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "id long, keys binary").repartition(3)
    for expected in (10, 10**4, 10**9):
        assert sum(shared_keys.layout(expected)) <= 64 and 1 << shared_keys.layout(expected)[0] >= expected / shared_keys.PER_PART
        got = shared_keys.ranks(df, sets_of, expected, lambda c: np.minimum(c, 200), finish, "id long, number long, ranks binary").collect()
        assert sorted(r.id for r in got) == list(range(len(sets))) and all(r.number == 7 * r.id for r in got)
        right = [list(r.ranks) == [min(counts[k], 200) for k in sets[r.id].tolist()] for r in got]
        # With keys shortened to hardly any bits counts are never below the true ones.
        assert all(x >= counts[k] for r in got for x, k in zip(r.ranks, sets[r.id].tolist(), strict=True))
        assert expected == 10 or all(right)


def test_near_duplicates_leave_no_sets_on_disk(spark, rows, tmp_path, monkeypatch):
    """The pipeline's second stage deletes the tables of sets before it shuffles texts."""
    import corpus_pipeline
    from ponding.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    kept = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    folders = sorted({f.parent for f in tmp_path.rglob("*.parquet")})
    assert folders and not [f.name for f in folders if "shingles" in spark.read.parquet(str(f)).columns]
    assert kept.count() == brute.jaccard_components(rows, roots=True)


def test_one_of_each(spark, rows):
    kept = jaccard_join.one_of_each(table(spark, rows))
    assert kept.columns == [c.split()[0] for c in CLASHING.split(", ")]
    assert kept.count() == brute.jaccard_components(rows, roots=True)


def test_statistics(spark, rows):
    got = quality_rules.statistics(documents(table(spark, rows))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(got, [(i, *brute.statistics(t)) for i, t in rows])


def test_outliers(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(60, 200))), "en" if i % 3 else None, "s1") for i in range(400)]
    bad = [(1000 + i, " ".join(word() + "$$$" for _ in range(100)), "en", "s1") for i in range(90)]
    docs = spark.createDataFrame([*clean, *bad, (2000, None, "en", None), (2001, "too short", None, None)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert kept == {r[0] for r in clean}


def test_permutation_round_trip():
    for n in (1, 2, 3, 10, 255, 256, 257, 5000):
        p = feistel_shards.permute(np.arange(n), n, 5)
        assert sorted(p) == list(range(n))
        assert (feistel_shards.unpermute(p, n, 5) == np.arange(n)).all()


def test_shards(spark, rows):
    got = feistel_shards.shard(table(spark, rows), 7).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r.size, r.text_crc32) for r in got) == want
    again = feistel_shards.shard(table(spark, rows).repartition(2), 7).collect()
    assert len({r.row_number for r in feistel_shards.shard(table(spark, rows), 7, buckets=3).collect()}) == len(rows)
    same([tuple(r) for r in got], [tuple(r) for r in again])


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    extra = [(900, "Don't x y\x85z\x1c ½² 中文 é İ ΣΣ 'll"), (901, "A,b.c!? 12 éÉ"), (902, "hello <|endoftext|> world"), (903, "<|startoftext|><|ENDOFTEXT|> a<|endoftext|>b"), (904, "<|endoftext| >")]
    got = packing.pack(table(spark, rows + extra), capacity=64, group_pieces=50).collect()
    want = []
    for i, text in rows + extra:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, 64 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(64, len(ids), 64)))]
    same([tuple(r)[:5] for r in got], want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * sum(w[3] for w in want) / 64 + 3


def test_pre_tokens_of_one_hash_are_told_apart(monkeypatch):
    from ponding.llm import words

    texts = ["the cat sat on the mat", "a dog, a cat: 12 mats", ""]
    want = [x.tolist() for x in packing.WordIds(packing.default_vocabulary()).encode_many(texts)]
    plain = words.Rolling.spans
    monkeypatch.setattr(words.Rolling, "spans", lambda self, a, b: plain(self, a, b) % words.U(2))
    assert [x.tolist() for x in packing.WordIds(packing.default_vocabulary()).encode_many(texts)] == want


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 101, 500))[::-1]
    bins, offsets, left = packing.best_fit_decreasing(lengths, 100)
    plain = []
    for n in lengths:
        room = [k for k, r in enumerate(plain) if r >= n]
        if room:
            plain[min(room, key=lambda k: plain[k])] -= n
        else:
            plain.append(100 - n)
    assert sorted(plain) == sorted(left.tolist())


def test_licences(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License.\nand more"),
        ("a/b/c/x.txt", "plain text"),
        ("a/b/y.txt", "code\nLicensed under the Apache License, Version 2.0.\ncode"),
        ("z/w.txt", "nothing"),
        ("q/head.txt", "Licensed under CC BY-NC 4.0.\nbody"),
        ("q/r/other.txt", None),
        (None, "Released under the MIT License."),
        ("a/b/c/x.txt", "plain text"),
    ]
    got = license_scan.scan(spark.createDataFrame(files, "path string, text string")).select("path", "licence", "own", "inherited_from").collect()
    same(got, [
        ("a/LICENSE", "MIT", True, None), ("a/b/c/x.txt", "MIT", False, "a"), ("a/b/y.txt", "Apache-2.0", True, None), ("z/w.txt", None, False, None),
        ("q/head.txt", "CC-BY-NC-4.0", True, None), ("q/r/other.txt", "CC-BY-NC-4.0", False, "q"), (None, "MIT", True, None), ("a/b/c/x.txt", "MIT", False, "a"),
    ])


def test_fits_are_minimum_covariance_determinants(spark):
    """Against numpy with hundreds of random starts and exact halves, per group, with a third of one group far out."""
    rng = np.random.default_rng(12)
    p, groups = quality_rules.P, {}
    for g, (n, bad) in enumerate(((600, 190), (300, 0), (400, 40))):
        mix = rng.normal(size=(p, p)) / 3 + np.eye(p)
        x = rng.normal(size=(n, p)) @ mix.T + g
        x[:bad] = rng.normal(size=(bad, p)) * 0.3 + 12
        groups[f"g{g}"] = (x, bad)
    rows = spark.createDataFrame([(0, g, *map(float, v)) for g, (x, _) in groups.items() for v in x], ["level", "g_0", *quality_rules.FEATURES])
    fits = {r.g_0: r for r in quality_rules.robust_fits(rows, ["level", "g_0"], True).collect()}
    floor = np.diag(np.square(quality_rules.FLOOR))
    cut = quality_rules.chi_square_quantile(0.999, p)
    for g, (x, bad) in groups.items():
        half, best = (len(x) + 1) // 2, None
        for _ in range(300):
            own = x[rng.choice(len(x), p + 1, False)]
            for _ in range(20):
                m, c = own.mean(0), np.cov(own.T, bias=True) + floor
                d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
                own = x[np.argsort(d)[:half]]
            det = np.linalg.slogdet(np.cov(own.T, bias=True) + floor)[1]
            best = min(best or (np.inf,), (det, own.mean(0), np.cov(own.T, bias=True) + floor), key=lambda b: b[0])
        _, m, c = best
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        c = c * max(np.median(d) / quality_rules.MEDIAN, 1)
        own = x[np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) <= quality_rules.INNER]
        m, c = own.mean(0), np.cov(own.T, bias=True) * quality_rules.INNER_TO_WHOLE + floor
        r = fits[g]
        low = np.array([[r[f"l_{i}_{j}"] if i >= j else 0.0 for j in range(p)] for i in range(p)])
        mean = np.array([r[f"m_{i}"] for i in range(p)])
        assert np.abs(mean - m).max() < 0.15 and np.abs(low @ low.T - c).max() < 0.15 * np.abs(c).max()
        far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(low @ low.T), x - mean) > cut
        assert far[:bad].all() and far[bad:].mean() < 0.02
    assert abs(quality_rules.chi_square_quantile(0.975, 5) - 12.8325) < 1e-3 and abs(quality_rules.chi_square_cdf(4.3515, 5) - 0.5) < 1e-4


HEADER = """/*
 * Copyright (C) 2020 Somebody
 *
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */
int main() { return 0; }
"""
WRAPPED = """# Copyright (c) 2011, Somebody. All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
#
# 1. Redistributions of source code must retain the above notice.
"""
MIT_FILE = """MIT License

Copyright (c) 2019 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_licences_of_headers_and_files(spark):
    """Wrapped headers, whole files, titles over two lines, and prose that only speaks of licences; columns with clashing names."""
    prose = "The committee will issue a licence to the public in general for version two of the road plan."
    files = [("a/x.c", HEADER), ("a/x.c", HEADER), ("b/y.py", WRAPPED), ("c/LICENSE", MIT_FILE), ("c/d/z.c", "int x;"), ("e/COPYING", "          GNU GENERAL PUBLIC LICENSE\n             Version 2, June 1991\n\n Copyright (C) 1989"), ("f/p.txt", prose), ("g/long.txt", "word " * 30_000 + "\nLicensed under CC BY 4.0.\n" + "word " * 30_000), (None, None)]
    docs = spark.createDataFrame([(p, t, 1, "x", "x", "x", "x", "x") for p, t in files], "path string, text string, tag int, licence string, token string, b string, opens string, row string")
    got = license_scan.scan(docs)
    assert got.columns == ["path", "text", "tag", "token", "b", "opens", "row", "licence", "score", "own", "inherited_from"]
    same(got.select("path", "licence", "own", "inherited_from").collect(), [
        ("a/x.c", "GPL-2.0", True, None), ("a/x.c", "GPL-2.0", True, None), ("b/y.py", "BSD-3-Clause", True, None), ("c/LICENSE", "MIT", True, None), ("c/d/z.c", "MIT", False, "c"),
        ("e/COPYING", "GPL-2.0", True, None), ("f/p.txt", None, False, None), ("g/long.txt", "CC-BY-4.0", True, None), (None, None, False, None),
    ])


def test_licence_scores_are_cosines(spark):
    """Every unit's best cosine against plain TF-IDF, without the gate."""
    rng = random.Random(9)
    texts = [HEADER, WRAPPED, MIT_FILE, "Licensed under CC BY 4.0.", "x\n\nReleased under the MIT License.\n"]
    bag = sorted({t for x in texts for t in x.split()})
    texts += ["\n".join(" ".join(rng.choice(bag) for _ in range(rng.randint(1, 9))) for _ in range(4)) for _ in range(60)]
    files = [(f"{k}/f", t) for k, t in enumerate(texts)]
    want = brute.licences([t for _, t in files], license_scan.TEMPLATES, license_scan.LEAST)
    got = {r.path: (r.licence, round(r.score, 4)) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).where("own").collect()}
    assert got == {f"{k}/f": (n, round(c, 4)) for k, (n, c) in want.items()} and len(got) >= 5


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.cut_repeats(docs).count() == 0
    assert suffix_dedup.cut_documents(docs).count() == 0
    assert decontaminate.remove_contaminated(docs, bench).count() == 0
    assert jaccard_join.one_of_each(docs).count() == 0
    assert quality_rules.keep_good(docs).count() == 0
    assert feistel_shards.shard(docs, 3).count() == 0
    assert packing.pack(docs).count() == 0
    assert license_scan.scan(docs.select(F.col("source").alias("path"), "text")).count() == 0
