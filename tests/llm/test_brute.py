"""Whole queries of the trained and scheduled operators, said again in plain Python."""

import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from massflow.llm import hashed_lr, mixing, quality_rules, text, toxicity
from tests.llm.test_operators import AWKWARD, corpus  # noqa: F401

MASK32 = (1 << 32) - 1


def _span(word: bytes) -> int:
    buf = np.frombuffer(word, np.uint8)
    return int(text.PrefixHash(buf).span(np.array([0]), np.array([len(buf)]))[0])


def _mix(x: int) -> int:
    return int(text.mix64(np.array([x & ((1 << 64) - 1)], np.uint64))[0])


def _logistic(x):
    return 1 / (1 + math.exp(-min(40, max(-40, x))))


def brute_features(t: str) -> list[list[int]]:
    """Indices of the words, word pairs, 3 and 4 characters of a text."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
    h = [_span(w) for w in words]
    pairs = [_mix(a * 0x100000001B3 + b) for a, b in zip(h, h[1:])]
    chars = [int.from_bytes(c.encode(), "big") for c in t]
    out = [[x >> 46 for x in h], [x >> 46 for x in pairs]]
    for n in (3, 4):
        own = []
        for k in range(len(chars) - n + 1):
            v = 0
            for c in chars[k : k + n]:
                v = (v * 0x9E3779B1 + c) & MASK32
            own.append(((v ^ (v >> 15)) * 0x85EBCA6B & MASK32) >> 14)
        out.append(own)
    return out


def test_quality_verdicts(spark, corpus):  # noqa: F811
    docs, labels = corpus
    model = quality_rules.fit(docs, labels)
    known = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.quality_p, r.base_failed, r.kept) for r in quality_rules.judge(docs, model).collect())
    want = []
    for i, t in known:
        if len(t) > 2000:
            continue
        z = model.bias + sum(np.mean([model.weights[k * hashed_lr.SPACE + x] for x in f]) if f else 0.0 for k, f in enumerate(brute_features(t)))
        want.append((i, len(t.encode()), _logistic(model.slope * z + model.shift)))
    probs = {}
    for has, i, n, p, failed, kept in got:
        probs.setdefault(i if has else None, []).append(p)
        assert kept == (not failed and p >= quality_rules.KEEP_AT)
    for i, _, p in want:
        assert min(abs(p - q) for q in probs[i]) < 1e-5


def test_calibration_gives_the_proportions_back(spark, corpus):  # noqa: F811
    docs, labels = corpus
    even = hashed_lr.train(hashed_lr.labelled_sample(docs, labels, "quality", 30))
    model = hashed_lr.train(hashed_lr.labelled_sample(docs, labels, "quality", 30), hashed_lr.class_counts(labels, "quality"))
    n = hashed_lr.class_counts(labels, "quality")
    assert model.shift - even.shift == pytest.approx(math.log(n[1] / n[0]))


def brute_toxicity(t: str, m) -> tuple[float, str | None]:
    """Score and worst sentence of a text: letters' words, sentences between stops, noisy-or."""
    raw = t.encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    bags, last = [], None
    for w in re.finditer(rb"[a-z\x80-\xff]+", low):
        stops = sum(raw[: w.start()].count(c) for c in b".!?\n")
        if stops != last:
            bags.append([set(), w.start(), 0])
            last = stops
        bags[-1][2] = w.end()
        for k, n in enumerate(toxicity.BEGINNINGS):
            if n == 0 or len(w[0]) > n:
                bags[-1][0].add((k << toxicity.BITS) | _span(w[0][:n] if n else w[0]) >> (64 - toxicity.BITS))
    z = [m.bias + sum(float(m.weights[f]) for f in b[0]) for b in bags]
    clean = min(sum(-np.logaddexp(0, x) for x in z), -1e-9)
    score = _logistic(m.slope * min(20, max(-20, math.log(-math.expm1(clean)) - clean)) + m.shift)
    worst = max(range(len(z)), key=lambda k: (z[k], -k)) if z else None
    return score, None if worst is None else raw[bags[worst][1] : bags[worst][2]].decode()


def test_toxicity_scores(spark, corpus):  # noqa: F811
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(7, "You idiot. Fine!"), (7, "Fine again"), (8, "Ünïcode? You moron\nno")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("extra", F.lit(1))
    got = toxicity.score(table, model)
    assert got.columns.count("score") == 1 and "extra" in got.columns
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        if len(r.text or "") > 2000:
            continue
        score, worst = brute_toxicity(r.text or "", model)
        assert r.score == pytest.approx(score, abs=1e-6)
        assert (r.text[r.worst_start : r.worst_end] if r.worst_start is not None else None) == worst


def brute_mix(rows, weights):
    """{row number: (block, slot, part)} by walking every block and every slot."""
    groups = {}
    for k, (src, shard, i, size, tie) in enumerate(rows):
        groups.setdefault((src, shard), []).append((i is not None, i or 0, size, tie, k))
    names = sorted({s for s, _ in groups})
    where, blocks = {}, {n: 0 for n in names}
    for src, shard in sorted(groups):
        filled, seen = 0, {}
        for part, (_, _, size, _, k) in enumerate(sorted(groups[src, shard]), 1):
            local = filled // mixing.BLOCK_CHARS
            seen.setdefault(local, blocks[src] + len(seen))
            where[k] = [src, seen[local], part]
            filled += size
        blocks[src] += len(seen)
    # every slot takes the released block with the earliest deadline
    left, done, at, slot = dict(blocks), dict.fromkeys(names, 0), {}, 0
    while any(left.values()):
        live = [n for n in names if left[n]]
        total = sum(Fraction(weights[n]) for n in live)
        share = {n: Fraction(weights[n]) / total for n in live}
        begun, used = slot, dict.fromkeys(live, 0)
        while all(left[n] > used[n] for n in live):
            t = slot - begun
            ready = [n for n in live if math.floor(used[n] / share[n]) <= t]
            n = min(ready, key=lambda n: (math.ceil((used[n] + 1) / share[n]), names.index(n)))
            at[n, done[n] + used[n]] = slot
            used[n] += 1
            slot += 1
        for n in live:
            left[n] -= used[n]
            done[n] += used[n]
    return {k: (b, at[s, b], p) for k, (s, b, p) in where.items()}


def test_the_whole_mix(spark, corpus, monkeypatch):  # noqa: F811
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 900)
    docs = corpus[0].unionByName(corpus[0].where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 5000))
    light = docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), F.xxhash64("text").alias("text"))
    shards = max(1, math.ceil(docs.count() / 60))
    rows = light.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard"), "doc_id", F.greatest("n", F.lit(1)).alias("size"), F.xxhash64("doc_id", "text").alias("tie")).collect()
    chars = {}
    for r in rows:
        chars[r.src] = chars.get(r.src, 0) + r["size"]
    want = brute_mix([tuple(r) for r in rows], {n: c**mixing.TEMPERATURE for n, c in chars.items()})
    plain = light.withColumn("slot", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("src", F.lit("clash"))
    got = mixing.mix(plain, size_col="n", block_chars=900, shard_docs=60)
    assert got.columns == ["doc_id", "source", "n", "text", "size", "src", "block", "slot", "part"]
    seen = sorted((r.src_, r.doc_id is not None, r.doc_id or 0, r.n, r.text or 0, r.block, r.slot, r.part) for r in got.withColumn("src_", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).collect())
    keys = light.collect()
    told = sorted((r.src, k.doc_id is not None, k.doc_id or 0, k.n, k.text or 0, *want[i]) for i, (r, k) in enumerate(zip(rows, keys)))
    assert seen == told
    assert AWKWARD


def test_empty_tables_and_clashing_columns(spark, corpus):  # noqa: F811
    docs, labels = corpus
    wide = docs.withColumn("kept", F.lit("clash")).withColumn("quality_p", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    judged = quality_rules.judge(wide, None)
    assert len(judged.columns) == len(set(judged.columns)) and judged.count() == docs.count()
    stage = quality_rules.keep_good(wide, labels)
    assert stage.columns == wide.columns and stage.where("kept != 'clash'").count() == 0
    assert quality_rules.keep_good(wide.limit(0), labels).count() == 0
    assert mixing.in_order(wide.limit(0)).columns == wide.columns


def test_stages_on_awkward_tables(spark, corpus, tmp_path):  # noqa: F811
    """Empty tables, null columns, very long texts, repeated rows and columns with clashing names, through every stage."""
    import corpus_pipeline

    docs, labels = corpus
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"word{k % 997} of a long text, number {k}." for k in range(30_000))
    odd = spark.createDataFrame([(70, None, None, None, None), (70, None, None, None, None), (None, "x " * 99, None, None, None), (71, long, "en", "src0", 1), (71, long, "en", "src0", 1)], docs.schema)
    wide = odd.withColumn("kept", F.lit("clash")).withColumn("slot", F.lit("clash")).withColumn("evidence", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        for table in (wide, wide.limit(0)):
            out = stage(spark, table, str(tmp_path))
            n = out.count()
            assert n <= table.count() and (name != "source_mix" or n == table.count())
            if name == "sentencepiece":
                assert n == table.count() and out.where("NOT decoded_ok").count() == 0
            else:
                assert out.columns == wide.columns
                assert out.where("kept != 'clash' OR slot != 'clash'").count() == 0
    assert corpus_pipeline.near_duplicates(spark, wide, str(tmp_path)).where("doc_id = 71").count() == 1
