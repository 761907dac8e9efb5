"""op11 against a brute-force run finder."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from ledgerfold.llm import periodic, queries
from ledgerfold.llm.common import workspace

SCHEMA = "doc_id long, text string, runs string, n long, _words string, _n long"
RNG = random.Random(11)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, repeats=4, least=6):
    """(start, length, period) by all distances; a stretch counts at its
    smallest period only."""
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i - a + q >= max(least, repeats * q):
                found.setdefault((a, i - a + q), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def kept(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_text(rng):
    parts, alphabet = [], "ab" if rng.random() < 0.4 else "abcdefgh"
    for _ in range(rng.randint(1, 6)):
        unit = [rng.choice(alphabet) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 12, 17, 31]))]
        parts += (unit * rng.choice([1, 2, 3, 4, 5, 6, 9, 30]))[:rng.randint(1, 200)]
        parts += [rng.choice(alphabet) for _ in range(rng.randint(0, 9))]
    return parts


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = [random_text(rng) if rng.random() < 0.9 else [] for _ in range(6)]
        first = np.cumsum([0, *map(len, texts)])
        names = {}
        x = np.array([names.setdefault(w, rng.getrandbits(63)) for t in texts for w in t], np.uint64)
        got = list(zip(*(v.tolist() for v in periodic.find_runs(x, first)), strict=True))
        assert got == [(a + f, n, q) for t, f in zip(texts, first.tolist(), strict=False) for a, n, q in brute_runs(t)]


def test_every_period_and_place():
    for q in (*range(1, 40), 63, 64, 65, 127, 128):
        for extra in (0, 1, q - 1):
            lead, tail = RNG.randint(0, 2 * q), RNG.randint(0, 2 * q)
            unit = list(range(q))
            w = [*range(1000, 1000 + lead), *(unit * 8)[:max(4 * q + extra, 6)], *range(5000, 5000 + tail)]
            x = np.array(w, np.uint64)
            assert list(zip(*(v.tolist() for v in periodic.find_runs(x, np.array([0, len(w)]))), strict=True)) == [(lead, max(4 * q + extra, 6), q)]


@pytest.mark.parametrize("primes", [1, 2, 3])
def test_sums_are_exact(primes):
    rng = np.random.default_rng(primes)
    for size in (1, 2, 8, 64):
        b, w = rng.integers(0, 50, (4, size)), rng.integers(0, 50, (4, 2 * size))
        want = np.array([[((x - y[t:t + size]) ** 2).sum() for t in range(size)] for x, y in zip(b, w, strict=True)])
        p, g = periodic.PRIMES[primes - 1]
        assert (periodic.differences(b, w, p, g) == want % p).all()


def test_primes():
    for p, g in periodic.PRIMES:
        assert all(p % d for d in range(2, int(p ** 0.5) + 1)) and (p - 1) % (1 << 26) == 0
        assert all(pow(g, (p - 1) // f, p) != 1 for f in (2, 3, 5, 7) if (p - 1) % f == 0)


def test_large_numbers_use_more_primes():
    size, limit = 16, 1 << 40
    x = np.array([*range(limit - 16, limit), *range(limit - 16, limit), *range(32)], np.int64)
    block, distance = periodic.occurrences(x, np.array([0]), np.array([64]), np.array([limit]), size)
    assert block.tolist() == [0] and distance.tolist() == [16]


def test_long_runs_are_quick():
    for w in (np.zeros(300_000), np.arange(300_000) % 2, np.arange(300_000) % 1000, np.arange(300_000) % 75_000):
        _, n, q = periodic.find_runs(w.astype(np.uint64), np.array([0, len(w)]))
        assert n.tolist() == [300_000] and q.tolist() == [int(w.max()) + 1]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "a a a a a a", "A a A a a a a a a", "É É É É É É x", " a b a b  ", "x x x x x x x",
             *[" ".join(random_text(rng)) for _ in range(120)],
             *["  ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 300))) + "\n" for _ in range(120)],
             "z " * 30_000 + " ".join(str(i) for i in range(3000))]
    out = list(enumerate(texts))
    return [*out, out[15], out[15], (None, "b b b b b b b"), (None, None), (4, "c c")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA).repartition(3).cache()


def test_operator_on_texts(docs, rows):
    got = periodic.periodic_runs(docs, ["doc_id", "_n"]).collect()
    want = Counter()
    for i, t in rows:
        w = words_of(t)
        if len(w) < 5000:
            runs = brute_runs(w)
            want[i, 2, len(w), tuple(runs), kept(w, runs)] += 1
    assert Counter((r.doc_id, r._n, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got if r.n_words < 5000) == want
    long = next(r for r in got if r.n_words >= 5000)
    assert [tuple(r) for r in long.runs] == [(0, 30_000, 1)] and len(long.collapsed.split(" ")) == 3001


def test_odd_input(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0
    got = periodic.periodic_runs(spark.createDataFrame([(None, None)], "doc_id long, text string"), ["doc_id"]).collect()
    assert [tuple(r) for r in got] == [(None, 0, [], "")]
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(8, np.uint64), np.array([0, 8]), repeats=3)


def test_registered_query(spark, docs, rows):
    uri = workspace(spark, "test")
    docs.write.parquet(f"{uri}/documents.parquet")
    want, planted = Counter(), 0
    for i, t in rows:
        w = words_of(t)
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            planted += 1
        if n > 5000:
            continue
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in ("".join(f"{a},{m},{q}\n" for a, m, q in runs), kept(w, runs))]
        want[i, len(runs), *best, None if not runs else 1000 * best[1] // best[2], *digests] += 1
    result = queries.QUERIES["op11_periodic_runs"](spark, uri)
    assert dict(result.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
                                   "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    got = Counter(tuple(r) for r in result.collect())
    assert planted > 10 and not want - got and sum((got - want).values()) == 1
