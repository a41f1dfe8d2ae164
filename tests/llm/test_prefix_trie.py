"""The trie of conversation prefixes against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ponding.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, place string, depth int, key string, at int, fp string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def rebuilt(rows, every=20, heads=4):
    conversations = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conversations[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in conversations.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = own.get(c - (abs(c) % every) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    return out


def brute(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        of = members[node]
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(of) - 1) * words(node[-1][1]) if node else 0)
        ends = ",".join(map(str, sorted(c for c in of if len(conversations[c]) == len(node))))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "x", 1, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(5), []
    for c in range(130):
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            out.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "it is so", "", f"only {c}"])))
    out += [(7, None, None, "before all"), (8, 2**40, "user", None), (None, 1, "user", "nobody's"), (-3, 1, None, None), (10**12, 0, "user", "far"), (31, 0, "user", "yes")]
    out += [(900, t, "user", f"turn {t % 3}") for t in range(700)] + [(901, t, "user", f"turn {t % 3}") for t in range(650)]  # long, alike
    out += [(c, t, "system", "the same") for c in range(2000, 2060) for t in range(4)]  # copies
    out += [(1000, t, "user", "again") for t in (0, 0, 0, 1)]  # repeated rows
    return [r for i, r in enumerate(out) if r[:2] != (31, 0) or i == len(out) - 1]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def run(spark, rows, parts=5, key_bits=64, bits=64):
    coded = prefix_trie.coded(table(spark, rows).repartition(parts), key_bits)
    return got(prefix_trie.trie(prefix_trie.with_shared_heads(coded), coded.select("conv_id").distinct(), [F.col("place")], bits))


@pytest.mark.parametrize("parts", [1, 7])
def test_trie(spark, rows, parts):
    distinct = {}
    for r in rows:  # one role and text for each turn number, as their order is open otherwise
        distinct.setdefault(r[:2], r[2:])
    rows = [(*r[:2], *distinct[r[:2]]) for r in rows]
    assert run(spark, rows, parts) == brute(rebuilt(rows))


def test_colliding_fingerprints_and_codes_are_split(spark, rows):
    """With four bits nearly everything collides: turns of one hash are told apart, and false groups split until none is left."""
    few = [r for r in rows if r[0] is not None and r[0] < 40 and not (r[0] == 7 and r[1] is None)]
    want = brute(rebuilt(few))
    assert run(spark, few, bits=4) == want
    assert run(spark, few, key_bits=2) == want
    assert run(spark, few, key_bits=3, bits=3) == want


def test_stretches_and_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 8)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    some = [r for r in rows if r[0] is not None and r[0] >= 900 and r[0] != 1000]
    assert run(spark, some) == brute(rebuilt(some))


def test_empty_and_turnless(spark, rows):
    assert run(spark, []) == []
    alone = [(22, 0, "user", "gone")]  # its head comes from a conversation that is not there
    assert zlib.crc32(b"22") % 4
    assert run(spark, alone) == brute(rebuilt(alone)) == [(22, 0, None, 1, 0, 1, 0, hashlib.sha256(b"22").hexdigest())]


def test_sql_gives_the_same(spark, tmp_path, rows):
    import duckdb

    from ponding.llm.oracles import OP12

    once = list({r[:2]: r for r in rows}.values())
    table(spark, once).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted((tuple(r) for r in db.sql(OP12).fetchall()), key=str)
    assert got(prefix_trie.op12_conversation_trie(spark, str(tmp_path))) == want
