"""Periodic runs against a comparison of every word with every later one."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixspark.llm import periodic_runs as pr
from mixspark.llm.common import WordHashes
from mixspark.llm.queries import op12_periodic_runs


def brute(w, least=pr.MIN_LENGTH):
    """All runs (start, length, period) of a list."""
    ids = np.array([hash(x) for x in w], np.int64)
    found = []
    for q in range(1, len(w) // 2 + 1):
        agree = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(agree))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= q and not any(p < q and s <= a and s + n >= b + q for s, n, p in found):
                found.append((a, b + q - a, q))
    return sorted((r for r in found if r[1] >= least), key=lambda r: (r[0], r[2]))


def fast(texts):
    hashes = WordHashes()
    out = pr.runs_of([hashes.of(" ".join(t).encode()) for t in texts])
    return [list(zip(*(x.tolist() for x in r))) for r in out]


def check(texts):
    assert fast(texts) == [brute(t) for t in texts]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def thue_morse(n):
    return [str(bin(i).count("1") % 2) for i in range(n)]


def test_random_texts():
    r = random.Random(1)
    for _ in range(60):
        check([[r.choice("abcd"[:r.choice([1, 2, 2, 3, 4])]) for _ in range(r.choice([0, 1, 11, 12, 30, 100, 333]))]
               for _ in range(5)])


def test_known_words():
    check([fibonacci(700), thue_morse(600), [], ["x"], list("ab" * 200), list("a" * 150)])


@pytest.mark.parametrize("root", ["ab", "abc", "aab", "abcde", "aabab"])
def test_touching_regions(root):
    """Many runs of growing period lie across the place where two periodic regions touch."""
    p = len(root)
    check([list(root * k + root[:j] + root * m) for k, m in ((30, 30), (40, 25), (9, 60)) for j in range(p + 1)])
    check([list((root * k + root[:j]) * m) for k, m in ((12, 3), (20, 2), (25, 4)) for j in range(1, p)])


def test_nested_repeats():
    r = random.Random(2)
    for _ in range(150):
        t = [r.choice("abc") for _ in range(r.randint(1, 6))]
        while len(t) < 250:
            k = r.randint(2, 6)
            t = t * k + t[:r.randint(0, len(t))]
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = r.choice("abc")
            if r.random() < .3:
                t = [r.choice("abc") for _ in range(r.randint(0, 20))] + t
        check([t[:700]])


def test_texts_do_not_touch():
    check([list("abcabcabcabcab"), list("cabcabcabcabc"), list("abcabc"), list("abcabc"), ["a"] * 11, ["a"] * 12])


def test_a_long_text():
    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    words[20_000:50_000] = [words[20_000 + i % 7001] for i in range(30_000)]
    words[1000:1500] = ["x"] * 500
    [got] = fast([words])
    longest = max(got, key=lambda g: g[1])
    assert longest[2] == 7001 and longest[0] <= 20_000 and longest[1] >= 30_000
    assert any(g[2] == 1 and g[1] >= 500 for g in got) and len(got) < 5


def expected(doc, text):
    words = (text or "").split()
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n, h = len(words), zlib.crc32(("" if doc is None else str(doc)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda t: (t[1], -t[0], -t[2]), default=(None,) * 3)

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["a", "b", "Ä", "word", " x"]) for _ in range(r.choice([0, 5, 40, 200])))) for i in range(150)]
    rows += [(None, "p q " * 20), (None, None), (7, None), (7, ""), (8, " \n\t\x0b"), (9, "same\n" * 30), (9, "same\n" * 30),
             (500, "x\x1cy x\x85y " * 10), (501, " ".join(map(str, range(900))) + " z" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for c in ("runs", "body", "collapsed", "n_words", "start"):
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(g) for g in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(expected(*row)) for row in rows)
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_collapsed_text_of_the_operator(spark):
    docs = spark.createDataFrame([("k", "say ha ha ha ha ha ha ha ha ha ha ha ha now")], "id string, body string")
    [got] = pr.find_runs(docs, "id", "body").collect()
    assert got.doc_id == "k" and got.n_words == 14 and got.collapsed == "say ha now"
    assert [tuple(x) for x in got.runs] == [(1, 12, 1)]
