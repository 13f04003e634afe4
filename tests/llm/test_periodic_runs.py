"""Periodic runs against brute force, and the query's rewriting and digests."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from scanloom.llm import periodic_runs
from scanloom.llm import queries as llm


def brute(w, times=4, least=6):
    """For each period the longest stretches of equal places; of one stretch the smallest period."""
    found, n = {}, len(w)
    for p in range(1, n // times + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((i, j - i, p) for (i, j), p in found.items())


def found(texts, **limits):
    items, bounds = periodic_runs.numbered(texts)
    start, length, period = periodic_runs.find(items, **limits)
    out = [[] for _ in texts]
    for s, n, p in zip(start.tolist(), length.tolist(), period.tolist()):
        k = int(np.searchsorted(bounds, s, "right")) - 1
        out[k].append((s - int(bounds[k]), n, p))
    return out


def made(rng, size, letters):
    """Words with repeated stretches, copies of stretches with runs in them, and noise."""
    out = []
    while len(out) < size:
        kind = rng.randrange(4)
        if kind == 0:
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 6))]
            out += (unit * rng.randrange(2, 9))[: rng.randrange(1, 40)]
        elif kind == 1 and out:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randrange(1, 60)]
        elif kind == 2 and out:
            unit = out[-rng.randrange(1, 30) :]
            out += unit * rng.randrange(1, 5)
        else:
            out += [rng.choice(letters) for _ in range(rng.randrange(1, 5))]
    return out[:size]


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc", b"abcdefgh"])
@pytest.mark.parametrize("limits", [{}, {"times": 3, "least": 1}])
def test_all_runs(letters, limits):
    rng = random.Random(len(letters))
    letters = [bytes([c]) for c in letters]
    for _ in range(60):
        texts = [made(rng, rng.randrange(0, 160), letters) for _ in range(5)] + [[rng.choice(letters) for _ in range(rng.randrange(200))]]
        assert found(texts, **limits) == [brute(t, **limits) for t in texts]


def test_every_short_sequence():
    texts = [[bytes([97 + (k >> b & 1)]) for b in range(n)] for n in (6, 9, 12) for k in range(1 << n)]
    assert found(texts) == [brute(t) for t in texts]


def test_long_texts():
    unit = [b"w%d" % k for k in range(1000)]
    text = [b"x", *unit * 50, b"y", *[b"z"] * 5000, *unit * 4]
    assert found([text, [b"a"] * 50_000]) == [[(1, 50_000, 1000), (50_002, 5000, 1), (55_002, 4000, 1000)], [(0, 50_000, 1)]]


def contract(doc_id, text):
    """The row as the contract words it."""
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {k for s, m, p in runs for k in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_query_equals_the_contract(spark, tmp_path):
    rng = random.Random(8)
    words = "alpha beta gamma Ünï 日本 x y".split(" ")
    texts = [None, "", " \n\t", "one", "a " * 7, "A a " * 9, "x\x0by\x0c" * 20, "é " * 6 + "e " * 6]
    texts += [" ".join(w.decode() for w in made(rng, rng.randrange(1, 150), [x.encode() for x in words])) for _ in range(200)]
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 120))) for _ in range(200)]
    rows = [(i, t, 5, "r", "c") for i, t in enumerate(texts)] + [(None, "b " * 8, 1, "r", "c"), (7, "c " * 6, 1, "r", "c"), (7, "c " * 6, 1, "r", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string, collapsed string").write.parquet(f"{tmp_path}/documents.parquet")
    df = llm.op12_periodic_runs(spark, str(tmp_path))
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    assert sum(crc32(str(i).encode()) % 10 == 0 and len((t or "").split()) > 20 for i, t, *_ in rows if i is not None) > 20
    assert sorted(map(tuple, df.collect()), key=str) == sorted((contract(i, t) for i, t, *_ in rows), key=str)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.with_digests(periodic_runs.find_runs(none)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(none, times=2)
