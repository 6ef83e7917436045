"""Codebooks and codes against comparing every part with every entry."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from massflow.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds):
    """{(vec_id, code): error} as a sorted list, and the codebooks, in plain Python."""
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v in kept), default=0) // parts) * parts
    whole = [(i, v, [math.floor(x * 256) if abs(x) < 2**52 else int(x) * 256 for x in v] + [0] * (width - len(v))) for i, v in kept]
    whole.sort(key=lambda t: (t[0] is None, t[0] or 0, t[1]))
    w = width // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, _, v in whole]
    books = [[row[p] for row in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for row in cut:
                groups.setdefault(near(row[p], books[p])[1], []).append(row[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for (i, _, _), row in zip(whole, cut):
        best = [near(x, b) for x, b in zip(row, books)]
        error = sum(d for d, _ in best)
        out.append((i, "".join(f"{k:02x}" for _, k in best), error if error < 2**63 else None))
    return sorted(out, key=str), books


def test_equals_brute_force_with_ties_and_awkward_rows(spark):
    rng = random.Random(3)
    # Whole quarters: many equal distances, so ties must go to the lower entry.
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.25, 0.5]) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(7, [0.5] * 32, 1), (None, [0.1] * 32, 1), (3, rows[3][1], rows[3][2]), (200, None, 1), (201, [1.0, None] * 16, 1), (202, [math.nan] * 32, 2), (203, [math.inf] * 32, 2), (204, [], None), (205, [1.0] * 5, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, books = brute(rows, V.PARTS, V.ENTRIES, V.ROUNDS)
    got = V.vector_codes(df.withColumn("code", F.lit("mine")).withColumn("error", F.lit(1))).collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=str) == want
    flat = ",".join(str(v) for b in books for e in b for v in e)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(flat.encode()).hexdigest()}
    label = {}
    for r in V.encode(df, V.fit(df)).collect():
        label[r.label] = label.get(r.label, 0) + r.error
    assert {r.label_error for r in got} == set(label.values())


def test_numbers_beyond_64_bits_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.choice([0, 8, 30]) for _ in range(16)], 1) for i in range(90)]
    want, books = brute(rows, V.PARTS, V.ENTRIES, V.ROUNDS)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert V.fit(df).books == books
    assert sorted(((r.vec_id, r.code, r.error) for r in V.vector_codes(df).collect()), key=str) == want


def test_general_interface_and_decoding(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)], None) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    books = V.fit(df, parts=4, entries=10, rounds=3)
    want, known = brute(rows, 4, 10, 3)
    assert books.books == known
    back = V.decode(V.encode(df, books), books).collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in back), key=str) == want
    for r in back:
        assert sum((math.floor(x * 256) - a * 256) ** 2 for x, a in zip(r.embedding, r.approximation)) == r.error


def test_many_labels_are_joined_by_salted_keys(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7)] * 16, i % 5 or None) for i in range(60)], SCHEMA)
    want = sorted(map(tuple, V.vector_codes(df).collect()))
    monkeypatch.setattr(V, "MOST_LABELS", 2)
    assert sorted(map(tuple, V.vector_codes(df).collect())) == want


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [math.nan] * 16, None)]])
def test_no_rows(spark, rows):
    assert V.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect() == []
