"""The trie against one built in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from massflow.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = {}
    for i, turn, role, text in rows:
        if i is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]
            turns.setdefault(i, []).append((turn is not None, turn or 0, key, role, text))
    turns = {i: [t[3:] for t in sorted(ts)] for i, ts in turns.items()}
    built = {}
    for i, own in turns.items():
        h = zlib.crc32(str(i).encode()) % 6
        built[i] = tuple(turns.get(i - (i % 100 if i >= 0 else -(-i % 100)), [])[:h] + own[h:])
    members = {}
    for i, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(i)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        own = kids.get(p, [])
        saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        sums[p] = (sum(sums[k][0] for k in own) if own else 1, saved + sum(sums[k][1] for k in own))
    out = []
    for p, ms in members.items():
        ends = ",".join(str(i) for i in sorted(ms) if len(built[i]) == len(p))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("depth", F.lit("mine")).withColumn("owner", F.lit(0))
    return sorted((tuple(r) for r in P.prefix_trie(df).select(*COLUMNS).collect()), key=str)


def rows_of(seed, convs=140, most=9):
    rng = random.Random(seed)
    rows = []
    for i in range(convs):
        same = rng.random() < 0.4
        for k in range(rng.randint(0, most) if not same else 7):
            text = "same" * k if same else rng.choice(["a", "bb", "ccc", "é漢", "", None])
            rows.append((i, k, rng.choice(["user", "user", None]) if not same else "user", text))
    return rows


def test_equals_brute_force(spark):
    rows = rows_of(1)
    # Null ids and turns, turns that tie, repeated rows, negative and large ids, one absent base (300).
    rows += [(None, 0, "user", "x"), (5, None, "user", "first"), (5, None, "a", "also"), (6, 2, "user", "tie"), (6, 2, "user", "tie"), (6, 2, "user", "other")]
    rows += [(-7, k, "user", "bb") for k in range(7)] + [(10**15 + 3, 0, "user", "a"), (305, 0, "user", "a"), (305, 1, "user", "a"), (311, 0, "u", "a")]
    rng = random.Random(2)
    rng.shuffle(rows)
    assert trie(spark, rows) == brute(rows)


def test_long_and_common_conversations_in_small_pieces(spark, monkeypatch):
    # Chains over several blocks, lists of ends over several pieces, hot keys by broadcast.
    monkeypatch.setattr(P, "BLOCK_BITS", 3)
    monkeypatch.setattr(P, "ENDS_BITS", 2)
    monkeypatch.setattr(P, "HOT_SHARE", 1 / 64)
    rows = [(0, k, "user", f"t{k % 5}") for k in range(300)] + [(i, k, "user", f"t{k % 5}") for i in range(1, 60) for k in range(9)]
    # Each a longer prefix of the last one: the tree of chains is as high as it can be.
    rows += [(200 + i, k, "user", f"s{k}") for i in range(40) for k in range(i + 1)]
    assert trie(spark, rows, 7) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(100, 0, None, None)], [(4, 0, "user", "a"), (104, 1, "user", "a")]])
def test_small_tables(spark, rows):
    assert trie(spark, rows, 1) == brute(rows)


def test_equals_sql(spark):
    import duckdb
    import pandas as pd

    rows = rows_of(3) + rows_of(4, 30)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    want = duckdb.sql(P.ORACLE).select(*COLUMNS).fetchall()
    assert sorted(map(tuple, want), key=str) == brute(rows) == trie(spark, rows)
