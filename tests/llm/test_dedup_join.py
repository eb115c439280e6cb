"""Exact dedup, the Jaccard join, components and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixspark.llm import decontaminate as dc
from mixspark.llm import exact_dedup as dd
from mixspark.llm import jaccard_join as jj
from mixspark.llm.common import unpacked
from mixspark.llm.components import components


def low(text):
    return (text or "").encode().lower().decode()


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


# ---- exact dedup ---------------------------------------------------------------------------------

TEXTS = [(1, "Same"), (2, "same"), (3, "SAME"), (4, "Ä"), (5, "ä"), (6, None), (7, ""), (8, "alone"),
         (None, "same"), (9, " same"), (10, "x" * 200_000), (11, "X" * 200_000)]


@pytest.mark.parametrize("salts", [1, 64])
def test_dedup_groups(spark, salts):
    rows = TEXTS + [(100 + i, "hot") for i in range(50)]
    got = {r.doc_id: r for r in dd.exact_dedup(frame(spark, rows), salts=salts).collect()}
    for i, text in rows:
        same = [j for j, t in rows if low(t) == low(text)]
        want = max(j for j in same if j is not None)
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (want, len(same), i == want)
        assert r.text_sha256 == hashlib.sha256(low(text).encode()).hexdigest()


def test_texts_are_compared_where_digests_agree(spark):
    """A digest of one byte: many texts share it, and stay apart."""
    rows = [(i, f"text {i % 90}") for i in range(400)] + [(1, "text 1"), (None, "text 2")]
    got = dd.exact_dedup(frame(spark, rows), digest=lambda t: hashlib.sha256(t).digest()[:1] * 4).collect()
    size = Counter(t for _, t in rows)
    top = {t: max(i for i, u in rows if u == t and i is not None) for t in size}
    want = sorted((str(i), top[t], size[t]) for i, t in rows)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == 90


def test_dedup_names_may_clash(spark):
    docs = frame(spark, [(1, "a"), (2, "A"), (3, "b")])
    for c in ("digest", "row", "salt", "best", "n", "bucket", "bitmap", "body", "sha", "kept", "_dd_sha", "_dd_id", "keep_id"):
        docs = docs.withColumn(c, F.lit("clash"))
    kept = dd.kept_rows(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert all(r.digest == "clash" for r in kept.collect())


def test_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "B"), (3, "c")]
    got = dd.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 3
    kept = dd.kept_rows(frame(spark, rows).withColumn("n", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_dedup_of_nothing(spark):
    assert dd.exact_dedup(frame(spark, [], 1)).count() == 0


# ---- components ----------------------------------------------------------------------------------

def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(300, 360)]
    edges += edges[:5]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- Jaccard join --------------------------------------------------------------------------------

def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_join(rows):
    sets = [shingle_set(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    top, low_id = roots(range(len(rows)), edges), {}
    for k, (i, _) in enumerate(rows):
        low_id[top[k]] = min(low_id.get(top[k], i), i)
    return {i: (len(sets[k]), low_id[top[k]]) for k, (i, _) in enumerate(rows)}


def near_copies(seed, groups=12, size=14):
    """Chains of edits: neighbours are similar, the ends often are not; a passage is in many texts."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows, n = [], 0
    for g in range(groups):
        words = [f"g{g}w{r.randrange(60)}" for _ in range(r.choice([4, 5, 9, 40, 90]))]
        if g % 3 == 0:
            words[:0] = passage
        for _ in range(size):
            rows.append((n, r.choice([" ", "\t", "\n "]).join(w.upper() if r.random() < 0.1 else w for w in words)))
            n += 1
            if r.random() < 0.8:
                words = list(words)
                words[r.randrange(len(words))] = f"e{r.randrange(10 ** 6)}"
    r.shuffle(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "two words"), (n + 4, "TWO words"), (n + 5, "words two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_join(frame(spark, rows)).collect()}
    assert got == brute_join(rows)


def test_large_group_links_through_one_column(spark):
    """More variants than a group is searched for useless entries; all hang together."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i % 60], f"v{i}", *base[i % 60 + 1:]])) for i in range(150)]
    got = {r.component_id for r in jj.jaccard_join(frame(spark, rows)).collect()}
    assert got == {c for _, c in brute_join(rows).values()}


def test_documents_spread_over_groups(spark):
    """The records of the documents do not meet in one group, also when texts or ids repeat."""
    rows = [(i, "the same text in all of them" if i % 2 else f"text {i}") for i in range(6000)]
    order = spark.sparkContext.broadcast((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    texts = frame(spark, rows, 4).select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("body"))
    got = texts.mapInArrow(jj.index_rows(1, 5, 75, order), "block long, cols binary, s binary, size binary, pos binary")
    groups = {}
    for r in got.where("block < 0").collect():
        groups.setdefault(r.block, []).extend(unpacked(bytes(r.cols), np.int64).tolist())
    assert sorted(i for ids in groups.values() for i in ids) == list(range(6000))
    assert max(map(len, groups.values())) < 6000 // 20


def test_prefix_holds_what_a_partner_needs():
    for n in range(1, 200):
        assert jj.prefix(n) == n - -(-75 * n // 100) + 1
    assert jj.allowed(100, 100, 14, 14, 75) and not jj.allowed(100, 100, 15, 14, 75)


def test_one_of_each_keeps_the_smallest_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (3, text + " more"), (9, "other"), (None, text), (None, None)]
    kept = jj.one_of_each(frame(spark, rows).withColumn("s", F.lit(0)))
    assert kept.columns == ["doc_id", "text", "s"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None", "None"]


# ---- decontamination -----------------------------------------------------------------------------

def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def brute_hits(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        k = min(13, len(w))
        grams = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i:i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(words), hit, sorted(found)


def contaminated_case():
    r = random.Random(3)
    vocab = ["the", "é", "b2", "of", "Zed", "a"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 13, 20])))) for i in range(12)]
    items += [(90, None), (91, "same three words"), (92, "Same, three: WORDS!")]
    rows = []
    for i in range(40):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randrange(20)))]
        if i % 2:
            parts.insert(r.randrange(2), r.choice(items)[1] or "")
        rows.append((i, " ; ".join(parts)))
    return rows + [(100, None), (101, ""), (102, "...")], items


@pytest.mark.parametrize("slice_bytes", [1 << 20, 60])
def test_hits_against_all_windows(spark, slice_bytes):
    rows, items = contaminated_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_hits(frame(spark, rows), bench, slice_bytes=slice_bytes).withColumn("bad", dc.contaminated())
    for r in got.collect():
        n, hit, found = brute_hits(r.text, items)
        mine = {k for h in r["_dc_hits"] for k in range(h["first"], h["last"] + 1)}
        assert (r["_dc_words"], mine, r["_dc_items"]) == (n, hit, found)
        assert r.bad == (len(hit) > 0 and 20 * len(hit) >= n)


def test_removing_spans_and_documents(spark):
    passage = " ".join(f"b{i}" for i in range(15))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = frame(spark, [(1, f"Before é, {passage.upper()}! After."), (2, "Clean."), (3, None)]).withColumn(
        "items", F.lit("x"))
    spans = {r.doc_id: r.text for r in dc.decontaminate(rows, bench, remove="spans").collect()}
    assert spans == {1: "Before é, ! After.", 2: "Clean.", 3: None}
    kept = dc.decontaminate(rows, bench)
    assert kept.columns == ["doc_id", "text", "items"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(rows, empty).count() == 3


def test_counts_of_windows_share_item_lists():
    w = dc.Windows([("a", b"x y"), ("b", b"X y"), ("c", b"x y z")])
    n, hit, items = w.scan(b"q x y z")
    assert n == 4 and hit.tolist() == [False, True, True, True] and items == {"a", "b", "c"}
    assert Counter(map(len, w.found[2].values())) == {2: 1}
