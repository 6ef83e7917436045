"""The ten operators and the pipeline against brute force on small, awkward tables."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from massflow.llm import hashed_lr, html_extract, mixing, near_dup, nearest, piece_codec, quality_rules, site_quality, text, token_store, toxicity, warc
from massflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdeghilmnorstu") for _ in range(RNG.randint(2, 9))) for _ in range(900)]


def prose(n, rng):
    out = []
    while len(out) < n:
        s = [rng.choice(VOCAB) for _ in range(rng.randint(4, 12))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


def junk(n, rng):
    return " ".join(rng.choice(VOCAB).upper() + rng.choice(["###", "***", "$$$"]) for _ in range(n))


AWKWARD = [None, "", "   \n\t ", "one", "a b c d", "É é ñ 漢字 \x00 end", "x " * 4000, "line a\nline a\n\nline b\nline a", "a\r\n\r\nb", "  lead", "trail  ", "z" * 5000]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        bad, toxic = i % 6 == 5, i % 5 == 2
        t = junk(120, rng) if bad else prose(rng.randint(60, 200), rng)
        if toxic:
            t += " You stupid " + rng.choice(["moron", "idiot"]) + " go. " + prose(12, rng)
        rows.append((i, t, rng.choice(["en", "fr", None]), "src0" if i % 3 else f"src{i % 7}", len(t)))
        labels.append((i, int(not bad), int(toxic)))
    base = rows[0][1].split()
    for k in range(6):
        w = list(base)
        w[3 * k + 5] = "edited"
        rows.append((1000 + k, " ".join(w), "en", "src0", 1))
    rows += [(1100 + k, rows[7][1], "en", None, 1) for k in range(5)]
    rows += [(2000 + k, t, None, None, None) for k, t in enumerate(AWKWARD)]
    rows += [rows[3], (None, "no id at all", "en", "src1", 3)]  # a repeated row, a null id
    docs = spark.createDataFrame(rows, DOCS).repartition(5).cache()
    return docs, spark.createDataFrame(labels, LABELS).cache()


def brute_rules(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    g = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_rule_counts_against_brute_force():
    texts = [*AWKWARD, *(prose(80, RNG) for _ in range(20))]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for size in (1, 300, 1 << 20):
        got = []
        for _, _, buf, off in text.slices(pa.array(texts), size):
            r = text.rule_counts(buf, off)
            got += list(zip(*(r[n].tolist() for n in names)))
        assert got == [brute_rules(t) for t in texts]


def test_quality_rules(spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    known = {r.doc_id: r.text for r in docs.collect()}
    for i, r in got.items():
        n, chars, symbols, dup, rep = brute_rules(known[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)
    good = [got[r.doc_id] for r in labels.collect() if r.quality == 1]
    bad = [got[r.doc_id] for r in labels.collect() if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.03 * len(bad)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_no_labels_and_no_rows(spark, corpus):
    docs, labels = corpus
    none = labels.limit(0)
    assert quality_rules.quality_rules(docs, none).where("NOT base_failed AND NOT kept").count() == 0
    assert site_quality.quality_classifier(docs, none).where("NOT kept").count() == 0
    assert toxicity.toxicity(docs, none).agg(F.max("score")).first()[0] == 0
    empty = docs.limit(0)
    for f in (lambda: quality_rules.quality_rules(empty, labels), lambda: site_quality.quality_classifier(empty, labels), lambda: toxicity.toxicity(empty, labels), lambda: near_dup.near_duplicates(empty), lambda: mixing.mixing(empty), lambda: mixing.in_order(empty)):
        assert f().count() == 0


def test_site_quality(spark, corpus):
    docs, labels = corpus
    wide = docs.withColumn("evidence", F.lit("clash")).withColumn("host", F.lit(1))
    kept = site_quality.keep_good(wide, labels)
    assert kept.columns == wide.columns
    rows = site_quality.quality_classifier(docs, labels).collect()
    assert len(rows) == docs.count()
    verdict = {r.doc_id: r.kept for r in rows}
    lab = labels.collect()
    assert sum(verdict[r.doc_id] for r in lab if r.quality) >= 0.97 * sum(r.quality for r in lab)
    assert sum(verdict[r.doc_id] for r in lab if not r.quality) <= 0.05 * sum(1 - r.quality for r in lab)
    # the rates again, by hand
    total = len(rows)
    rate = sum(r.evidence for r in rows) / total
    hosts, paths = {}, {}
    for r in rows:
        for d, k in ((hosts, r.source), (paths, (r.source, r.lang))):
            n, s = d.get(k, (0, 0.0))
            d[k] = n + 1, s + r.evidence

    def weight(groups, center):
        d = sum(n * (s / n - center(k)) ** 2 for k, (n, s) in groups.items())
        return min(max(rate * (1 - rate) / max((d - len(groups) * rate * (1 - rate)) / total, 1e-12) - 1, 1), 1e4)

    a, b = weight(hosts, lambda k: rate), weight(paths, lambda k: hosts[k[0]][1] / hosts[k[0]][0])
    for r in rows[:50]:
        n, s = hosts[r.source]
        h = (s - r.evidence + a * rate) / (n - 1 + a)
        n, s = paths[r.source, r.lang]
        assert r.host_rate == pytest.approx(h) and r.site_rate == pytest.approx((s - r.evidence + b * h) / (n - 1 + b))


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, corpus):
    docs, _ = corpus
    rng = random.Random(9)
    base = prose(170, rng).split()
    more = []
    for k in range(40):  # each copy near the base, few near each other
        w = list(base)
        for j in rng.sample(range(len(w)), 3):
            w[j] = f"new{k}x{j}"
        more.append((3000 + k, " ".join(w), "en", "s", 1))
    docs = docs.unionByName(spark.createDataFrame([*more, (3100, " ".join(base).upper(), "en", "s", 1)], DOCS))
    got = near_dup.near_duplicates(docs).collect()
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    kept = near_dup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in want.items() if c == i) and ids.count(None) == 1


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:700], rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    k = near_dup.registers([a, b, np.union1d(a, b)]).astype(int)
    assert (np.maximum(k[0], k[1]) == k[2]).all()  # mergeable
    est = near_dup.likeliest(np.array([(k[0] > k[1]).sum()]), np.array([(k[0] < k[1]).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
    assert est == pytest.approx(700 / 1100, abs=0.12)


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + k) for k in range(1, 60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{200 + k: 200 for k in range(60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_deviates_by_less_than_a_block(spark, corpus):
    for _ in range(20):
        n = RNG.randint(1, 9)
        blocks, weights = [RNG.randint(0, 900) for _ in range(n)], [RNG.random() + 0.01 for _ in range(n)]
        phases = mixing.plan(blocks, weights)
        src = np.repeat(np.arange(n), blocks)
        slot = mixing.place(phases, src, np.concatenate([np.arange(b) for b in blocks]))
        assert sorted(slot) == list(range(sum(blocks)))
        order = src[np.argsort(slot)]
        for p in phases:
            part = order[p.first_slot : p.first_slot + p.slots]
            for i in range(n):
                ideal = np.arange(1, len(part) + 1) * p.share[i] / sum(p.share)
                assert np.abs(np.cumsum(part == i) - ideal).max(initial=0) < 1
    docs, _ = corpus
    got = mixing.mix(docs, {"src0": 3.0, "src1": 1.0}, block_chars=2000, shard_docs=50).toPandas()
    assert len(got) == docs.count()
    per = got.groupby(got.source.fillna("-"))[["block", "slot"]].nunique()
    assert (per.block == per.slot).all()
    assert mixing.in_order(docs).count() == docs.count()


def test_mixing_keeps_to_the_given_weights():
    weights = [0.33, 0.27, 0.2, 0.1, 0.07, 0.0299, 9e-5, 1e-5]
    blocks = [int(60_000 * w) + 1 for w in weights]
    phases = mixing.plan(blocks, weights)
    src = np.repeat(np.arange(8), blocks)
    slot = mixing.place(phases, src, np.concatenate([np.arange(b) for b in blocks]))
    assert sorted(slot) == list(range(sum(blocks)))
    order = src[np.argsort(slot)]
    done = np.zeros(8, int)
    for p in phases:
        part = order[p.first_slot : p.first_slot + p.slots]
        live = done < blocks
        total = sum(Fraction(w) for w, on in zip(weights, live) if on)
        slots = np.arange(1, p.slots + 1).astype(object)
        for i in range(8):
            own = Fraction(weights[i]) / total if live[i] else 0
            assert np.abs(np.cumsum(part == i).astype(object) - slots * own).max() < 1
        done += np.bincount(part, minlength=8)
    assert phases[0].slots > 50_000
    # a source of weight 0 waits for the others
    some = mixing.plan([2, 3, 4], [0.0, 1.0, 1.0])
    assert sorted(mixing.place(some, np.array([0, 0]), np.array([0, 1]))) == [7, 8]


PAGES = "page_id long, url string, html string"
ARTICLE = "<p>Some words that make a sentence, and then more of them.</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Head</h1>{ARTICLE}<p>Short<br>one.</p></article><footer>c</footer></body></html>", "Head\nSome words that make a sentence, and then more of them.\nShort one."),
        (f"<body><script>var t='<p>no</p>'</script><div class='cookie-notice'>{ARTICLE}</div><main>{ARTICLE}</main><section id=comments>{ARTICLE}</section><form>{ARTICLE}</form></body>", "Some words that make a sentence, and then more of them."),
        (f"<article><p><b>A &amp;amp; B &lt;x&gt;<br><p>{'w ' * 30}.<!-- <p>not</p> --><div class=ad>Buy this now, it is very good.</div><p>End.</article>", "A &amp; B <x>\n" + " ".join(["w"] * 30) + " .\nEnd."),
    ],
)
def test_html_extraction(page, want):
    assert html_extract.main_text(page)[0] == want


def test_min_cut_is_the_best_labelling():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 9)
        z = [rng.uniform(-3, 3) for _ in range(n)]
        ties = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]

        def loss(keep):
            return sum(max(v, 0) if not k else max(-v, 0) for v, k in zip(z, keep)) + sum(c for i, j, c in ties if keep[i] != keep[j])

        best = min(loss([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert loss(html_extract.min_cut(z, ties)) == pytest.approx(best, abs=1e-6)


def test_html_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (1, None, None), (None, "v", "<nav>x</nav>")]
    got = html_extract.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 55]
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_warc(spark):
    pay = [None, "", "a\r\n\r\nWARC/1.1\r\nx: y", "a\r\n\r\nWARC/1.1\r\nx: y", "é", None, "x", "x", "x" * 200_000]
    rows = [(i, None if i % 2 else f"http://h/{i}\r\n", p) for i, p in enumerate(pay)] + [(None, "u", "x")]
    pages = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r for r in warc.archive_pages(pages).collect()}
    last = {}
    for i, p in enumerate(pay):
        last[p or ""] = i
    for i, p in enumerate(pay):
        raw = (p or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[p or ""] == i else ("revisit", last[p or ""]))
    assert got[None].record_type == "response"
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_payloads_survive(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "p\r\n\r\nq"), (2, "v", "other")], PAGES)
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()}
    assert got == {1: "p\r\n\r\nq", 2: "other"}


BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_store(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BPE)
    docs, _ = corpus
    extra = ["a  b", "a   b \n", "a\n b", "\n\n", "a\n\nb c", " x", "x ", "it's <|endoftext|>   b", "it's <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c", "\ta\tb", "a\n  b", "é  f  g", "don't, we'll|no", "12,5 ab12 x²"]
    docs = docs.unionByName(spark.createDataFrame([(9000 + i, t, None, None, None) for i, t in enumerate(extra)], DOCS))
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, BPE, shard_ids=3000)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    at = 0
    for r, (known, i, t) in zip(got, rows, strict=True):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i if known else None, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    for row in spark.read.parquet(path).limit(3).collect():
        s = token_store.Shard(bytes(row.data))
        whole = s.ids()
        for k in range(0, row.n_docs, 3):
            doc = whole[int(s.start[k]) : int(s.start[k + 1])]
            assert (s.document(k) == doc).all()
            a, b = sorted(RNG.choices(range(len(doc) + 1), k=2))
            assert (s.tokens(k, a, b) == doc[a:b]).all()
    assert token_store.token_ids(docs.limit(0), BPE).count() == 0


def test_re_pair_shortens_and_respects_documents():
    ids = np.tile(np.array([5, 6, 7, 5, 6], np.uint32), 400)
    starts = np.array([0, 3, 3, 1000, 2000])
    seq, first, left, right = token_store.re_pair(ids, starts)
    assert len(seq) < len(ids) / 3 and first[-1] == len(seq)
    s = token_store.Shard(token_store.pack_shard([1, 2, 3, 4], [ids[a:b].tobytes() for a, b in zip(starts, starts[1:])]))
    assert (s.ids() == ids).all() and len(s.document(1)) == 0


def test_sentencepiece_bpe(spark, corpus):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    docs, _ = corpus
    got = piece_codec.encode(docs, piece_codec.load(path)).collect()
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert list(r.ids) == sp.encode(known[r.doc_id])
        assert r.decoded_ok and r.n_tokens == len(r.ids)
    assert piece_codec.encode(docs.limit(0), piece_codec.load(path)).count() == 0


def test_sentencepiece_unigram(spark):
    rng = random.Random(3)
    letters = [piece_codec.MARK, *"abc"]
    names = letters + sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(25)} | {piece_codec.MARK + "ab"})
    pieces = piece_codec.Pieces(names, [-rng.uniform(4, 6) if len(n) == 1 else -rng.uniform(4, 9) for n in names], ["normal"] * len(names), "unigram")
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["abc" * 20]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 3])) for i in range(len(words))], "doc_id long, text string")
    for r in piece_codec.encode(docs, pieces).collect():
        t = piece_codec.MARK + " ".join(words[r.doc_id : r.doc_id + 3]).replace(" ", piece_codec.MARK)
        best = [0.0] + [-1e18] * len(t)
        for e in range(1, len(t) + 1):
            best[e] = max(best[s] - pieces.rank[t[s:e]][0] for s in range(max(0, e - 5), e) if t[s:e] in pieces.rank)
        assert sum(pieces.score[i] for i in r.ids) == pytest.approx(best[-1])
        assert r.decoded_ok


def brute_nearest(rows, k, every):
    out = {}
    for q, x in rows.items():
        if q % every == 0:
            s = sorted(((-float(np.dot(x, y)), i) for i, y in rows.items() if i != q))
            out[q] = [(i, -v) for v, i in s[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 16))
    rows = {i: (centers[i % 12] + 0.3 * rng.standard_normal(16)) * (1 + i % 3) for i in range(600)}
    rows |= {1000 + i: rows[40] for i in range(60)}  # one common vector
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (None, [1.0] * 16), (2080, [1.0])]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows.items()] + bad, "vec_id long, embedding array<double>")
    got = nearest.search(df, k=20, every=20).collect()
    want = brute_nearest(rows, 20, 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert by.keys() == want.keys()
    hit = 0
    for q, found in by.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        assert all(s == pytest.approx(float(np.dot(rows[q], rows[i])), rel=1e-12) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hit >= 0.9 * 20 * len(want)
    few = nearest.search(df.where("vec_id < 5"), k=20, every=2).collect()
    assert Counter(r.query_id for r in few) == {0: 4, 2: 4, 4: 4}
    assert nearest.search(df.limit(0)).count() == 0


def test_nearest_sees_large_nodes_in_full(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nearest, "NODE_ROWS", 30)  # every node is dealt out, over salts and over turns
    x = np.random.default_rng(7).standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}), str(tmp_path / "v.parquet"))
    got = nearest.search(spark.read.parquet(str(tmp_path / "v.parquet")), k=20, every=20).toPandas()
    assert len(got) == 600 * 20 and not got.duplicated(["query_id", "vec_id"]).any()
    score = x[::20] @ x.T
    score[np.arange(600), np.arange(0, 12_000, 20)] = -2
    want = {(20 * i, int(j)) for i, s in enumerate(score) for j in np.argsort(-s)[:20]}
    assert len(want & set(zip(got.query_id, got.vec_id))) >= 0.9 * len(want)


def test_toxicity(spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    lab = {r.doc_id: r.toxic for r in labels.collect()}
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i in lab if got[i].held_out]
    assert np.mean([got[i].predicted == lab[i] for i in held]) >= 0.9
    known = {r.doc_id: r.text for r in docs.collect()}
    found = [known[i][got[i].worst_start : got[i].worst_end] for i in lab if lab[i] and got[i].predicted]
    assert np.mean([bool(re.search("stupid|moron|idiot", s)) for s in found]) >= 0.9
    assert got[2000].worst_start is None and got[2000].n_offending == 0


def test_platt_orders():
    z = np.linspace(-3, 3, 50)
    slope, shift = hashed_lr.platt(z, (z > 0.5).astype(int))
    assert slope > 0 and abs(-shift / slope - 0.5) < 0.3


def test_pipeline_stages(spark, corpus, tmp_path):
    docs, labels = corpus
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "source_mix", "sentencepiece"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    good = {r.doc_id for r in labels.collect() if r.quality}
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    lost = [i for i in good if groups[i][1] == i and i not in ids]
    assert len(lost) <= 0.05 * len(good)
    assert not set(ids) & {r.doc_id for r in labels.collect() if not r.quality}
    assert len(ids) == len(set(ids)) and all(r.decoded_ok for r in out)


def test_pipeline_result_is_in_the_order_of_the_mix(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "PART_DOCS", 50, raising=False)
    docs = corpus[0].where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = [r.doc_id for r in mixing.mix(docs).orderBy("slot", "part").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    try:
        corpus_pipeline.source_mix(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "m").glob("part-*"))) > 1
    corpus_pipeline.sentencepiece(spark, spark.read.parquet(str(tmp_path / "m")), str(tmp_path)).write.parquet(str(tmp_path / "s"))
    out = spark.read.parquet(str(tmp_path / "s"))
    assert [(r.position, r.doc_id) for r in out.orderBy("position").collect()] == list(enumerate(want))
    rows = [r for f in sorted((tmp_path / "s").glob("part-*")) for r in pq.read_table(str(f))["doc_id"].to_pylist()]
    assert rows == want
    unmixed = corpus_pipeline.sentencepiece(spark, docs.limit(500).orderBy("doc_id"), str(tmp_path))  # not plainly files
    assert [r.doc_id for r in unmixed.orderBy("position").collect()] == sorted(want)


def test_pipeline_rules_are_fitted_on_all_documents(spark, corpus, tmp_path):
    docs, labels = corpus
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rng = random.Random(8)
    bad = spark.createDataFrame([(9000 + i, junk(120, rng), "en", "src0", 0) for i in range(10)], DOCS)
    good = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    left = corpus_pipeline.quality_rule_filter(spark, good.unionByName(bad), str(tmp_path))  # no labelled bad row is left
    ids = {r.doc_id for r in left.collect()}
    assert not [i for i in ids if i >= 9000]
    assert len(ids) >= 0.9 * good.count()


def test_places_are_told_apart_in_any_files(spark, tmp_path):
    from massflow.llm.frames import with_position

    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).cast("string").alias("part"))
    df.repartition(5).write.partitionBy("part").parquet(str(tmp_path / "dirs"))
    df.repartition(4).write.parquet(str(tmp_path / "plain"))
    for read in (spark.read.parquet(str(tmp_path / "dirs")), spark.read.parquet(str(tmp_path / "plain")), spark.read.parquet(str(tmp_path / "plain")).where("id % 3 = 0"), df.orderBy("id")):
        got, end = with_position(read, "place")
        places = [r.place for r in got.collect()]
        assert len(places) == len(set(places)) == read.count() and max(places) == end - 1 and min(places) >= 0


def test_common_words_are_coded_once_a_range_of_chunks(spark, corpus, monkeypatch):
    docs, _ = corpus
    pieces = piece_codec.load(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(piece_codec, "CHUNK_BYTES", 4_000)
    want = sorted(map(tuple, piece_codec.encode(docs, pieces).collect()), key=str)
    monkeypatch.setattr(piece_codec, "CHUNKS_OF_A_WORD", 2)
    assert sorted(map(tuple, piece_codec.encode(docs, pieces).collect()), key=str) == want
