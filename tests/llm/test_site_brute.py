"""op8's statistics, evidence, posteriors and verdicts, said again in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from massflow.llm import site_quality as Q
from tests.llm.test_operators import AWKWARD, corpus  # noqa: F401


def brute_features(t: str) -> list[float]:
    raw = t.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    letters = max(1, sum(x >= 128 or chr(x).isalpha() for x in raw))
    punct = sum(chr(x) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for x in raw)
    shares = [
        sum(x in b"#*$%&|<>" for x in raw) / n, len(hit) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(65 <= x < 91 for x in raw) / letters, raw.count(b"!") / n, raw.count(b"|") / n, punct / n, sum(48 <= x < 58 for x in raw) / n,
    ]
    chars = sum(len(w.decode()) for w in words)
    first = [math.log1p(len(words)), chars / n / 10, (len(lines) - len(set(lines))) / (1 + raw.count(b"\n")), len(set(words)) / n, raw.count(b".") / n]
    return [*first, *shares, *(math.sqrt(min(s, 4)) for s in shares)]


def _strength(groups):
    """groups: (n, sum, center)."""
    n, s = sum(g[0] for g in groups), sum(g[1] for g in groups)
    rate = min(max(s / n, 1e-6), 1 - 1e-6)
    d = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups)
    within = rate * (1 - rate)
    return min(max(within / max((d - len(groups) * within) / n, 1e-12) - 1, 1.0), 10_000.0)


def _logit(p):
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def test_every_document_equals_the_plain_words(spark, corpus):  # noqa: F811
    docs, labels = corpus
    model = Q.fit(docs, labels)
    known = [(r.doc_id, r.text or "", r.source, r.lang) for r in docs.collect()]
    evidence = []
    for _, t, _, _ in known:
        z = np.clip((np.array(brute_features(t)) - model.mean) / model.scale, -6, 6) @ model.coef + model.bias
        evidence.append(1 / (1 + math.exp(-z)))
    hosts, paths = {}, {}
    for (_, _, h, p), e in zip(known, evidence):
        for table, key in ((hosts, h), (paths, (h, p))):
            n, s = table.get(key, (0, 0.0))
            table[key] = n + 1, s + e
    rate = min(max(sum(evidence) / len(evidence), 1e-6), 1 - 1e-6)
    a = _strength([(n, s, rate) for n, s in hosts.values()])
    b = _strength([(n, s, hosts[h][1] / hosts[h][0]) for (h, _), (n, s) in paths.items()])
    want = []
    for (i, _, h, p), e in zip(known, evidence):
        host = (hosts[h][1] - e + a * rate) / (hosts[h][0] - 1 + a)
        site = (paths[h, p][1] - e + b * host) / (paths[h, p][0] - 1 + b)
        post = 1 / (1 + math.exp(-(_logit(e) + _logit(site) - math.log(rate / (1 - rate)))))
        want.append((str(i), e, host, site, post))
    got = sorted((str(r.doc_id), r.evidence, r.host_rate, r.site_rate, r.posterior, r.kept) for r in Q.quality_classifier(docs, labels).collect())
    assert len(got) == len(want) and len(AWKWARD) < len(got)
    for g, w in zip(got, sorted(want)):
        assert g[0] == w[0] and g[1:5] == pytest.approx(w[1:], abs=1e-7)
        assert g[5] == (g[4] >= Q.KEEP_AT)
