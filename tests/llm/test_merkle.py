"""The Merkle manifest against a tree built level by level in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mixspark.llm import merkle as mk
from mixspark.llm.queries import op11_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return h(*[field(v) for v in row[:4]], field(text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def steps(tree, at):
    for level in tree[:-1]:
        start = at - at % 3
        yield level[start:at], level[at + 1:start + 3]
        at //= 3


def brute(rows):
    """One tuple per row: doc_id, leaf, subroot, root, proof, folded root, verified."""
    trees = {}
    for s in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = (mine, levels([leaf(r, r[4]) for r in mine]))
    top = levels([t[-1][0] for _, t in trees.values()])
    for k, (mine, tree) in enumerate(trees.values()):
        for i, r in enumerate(mine):
            way = list(steps(tree, i)) + list(steps(top, k))
            even = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
            at = leaf(r, r[4].replace("\n", "")) if even and r[4] is not None else leaf(r, r[4])
            for left, right in way:
                at = h(*left, at, *right)
            root = top[-1][0]
            yield (r[0], tree[0][i], tree[-1][0], root, h(*[x for lr in way for p in lr for x in p]), at, at == root)


def run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("tree", "pos", "digest", "n", "steps", "row", "name", "tampered", "root", "order"):
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted(map(repr, (tuple(r) for r in got)))


def random_rows(sizes, seed):
    r = random.Random(seed)
    rows = [(i, s, r.choice(["en", None]), r.choice([3, None]), r.choice(["a\nb", "plain", "", None, "ä\n\n"]))
            for s, n in sizes.items() for i in r.sample(range(10_000), n)]
    return rows


@pytest.mark.parametrize("sizes", [
    {"hot": 700, None: 82, "": 1, "two": 2, "ä": 81, "=": 9, "z": 10}, {None: 1}, {"one": 243}, {"a": 1, "b": 1}])
def test_against_brute_force(spark, tmp_path, sizes):
    rows = random_rows(sizes, len(sizes))
    assert run(spark, rows, tmp_path) == sorted(map(repr, brute(rows)))


def test_odd_rows(spark, tmp_path):
    rows = [(None, "a", None, None, None), (None, "a", None, None, None), (1, "a", "x", 1, "t\n"), (1, "a", "x", 1, "t\n"),
            (1, "a", "x", 1, "other"), (2, None, None, None, "\n" * 50_000), (-5, "a", "", 0, "")] + [
                (7, "copies", "en", 1, "same\n")] * 300
    assert run(spark, rows, tmp_path) == sorted(map(repr, brute(rows)))


def test_many_trees(spark, tmp_path):
    rows = [(i, f"s{i}", "en", 1, "x\n") for i in range(400)]
    assert run(spark, rows, tmp_path) == sorted(map(repr, brute(rows)))


def test_nothing(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_only_every_fourth_level_is_stored(spark):
    docs = spark.range(7000).withColumn("s", F.lit("a"))
    m = mk.build_manifest(docs, mk.digest(F.col("id").cast("string")), F.col("s"), F.col("id"), {"id": F.col("id")})
    assert [level.count() for level in m.levels] == [7000, 87, 2, 1]
    tree = levels([h(str(i)) for i in range(7000)])
    assert m.root() == tree[-1][0]
    got = m.proofs().where("id = 6999").first()
    assert [(s.left, s.right) for s in got.steps] == [("".join(a), "".join(b)) for a, b in steps(tree, 6999)]
