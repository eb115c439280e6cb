"""Context-tree weighting, toxicity, language, quality and secrets against brute force or held-out texts."""

import functools
import hashlib
import math
import random
import re
import string
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixspark.llm import ctw, linear
from mixspark.llm import language as lg
from mixspark.llm import quality as ql
from mixspark.llm import secrets as se
from mixspark.llm import toxicity as tx


def crc(i):
    return zlib.crc32(str(i).encode()) % 5


# ---- context-tree weighting ----------------------------------------------------------------------

def test_ln_gamma_and_kt():
    x = np.array([0.5, 1.0, 2.5, 9.9, 10.0, 70000.5])
    assert np.allclose(ctw.ln_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    want = math.lgamma(3.5) + math.lgamma(70000.5) - math.lgamma(70004) - math.log(math.pi)
    assert math.isclose(ctw.ln_kt(np.array([3]), np.array([70000]))[0], want, rel_tol=1e-10)


def test_byte_strings_of_a_text():
    line = np.frombuffer(b"\xff\xffabab\xff", np.uint8)
    name, place = ctw.grams(line, 2)
    assert [name[p].tobytes()[:3][::-1] for p in place] == [b"\xff\xffa", b"a\xffb", b"baa", b"abb", b"ba\xff"]
    code = np.random.default_rng(1).integers(0, 1 << 30, 500)
    for got in (ctw.ranks(code % 1000, 1000), ctw.ranks(code, 1 << 40)):
        assert (np.diff(got[0]) > 0).all()


class BruteTree:
    """Node by node: counts of every context of every depth, then the recursion of the weighting."""

    def __init__(self, texts, depth):
        self.depth, self.count, self.below = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            s = self.line(t)
            for j in range(depth, len(s)):
                for k in range(8):
                    path = self.path(s, j, k)
                    for n in path:
                        self.count[n][s[j] >> (7 - k) & 1] += 1
                    for a, b in zip(path, path[1:]):
                        self.below[a].add(b)
        self.total = functools.lru_cache(None)(self._total)

    def line(self, t):
        return b"\xff" * self.depth + (t or "").encode().lower() + b"\xff"

    def path(self, s, j, k):
        return [(s[j - d:j], 1 << k | s[j] >> (8 - k)) for d in range(self.depth + 1)]

    def kt(self, n):
        a, b = self.count.get(n, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def _total(self, n):
        if len(n[0]) == self.depth:
            return self.kt(n)
        return np.logaddexp(self.kt(n), sum(map(self.total, self.below[n]))) - math.log(2) if n in self.count else 0.0

    def log10(self, t):
        s, out = self.line(t), 0.0
        for j in range(self.depth, len(s)):
            for k in range(8):
                p = None
                for n in reversed(self.path(s, j, k)):
                    a, b = self.count.get(n, (0, 0))
                    one = (b + 0.5) / (a + b + 1)
                    w = 1.0 if p is None else math.exp(self.kt(n) - math.log(2) - self.total(n))
                    p = one if p is None else w * one + (1 - w) * p
                out += math.log10(p if s[j] >> (7 - k) & 1 else 1 - p)
        return out


@pytest.mark.parametrize("depth", [2, 5])
def test_scores_against_the_recursion(spark, depth):
    r = random.Random(depth)
    docs = [(i, "".join(r.choice(["ab", "ba ", "c", "Ä", "the "]) for _ in range(r.randint(0, 30)))) for i in range(25)]
    docs += [(25, None), (26, ""), (27, "Z" * 3000), (3, docs[3][1]), (None, "ab ab")]
    train = [t for i, t in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    tree, counts = BruteTree(train, depth), Counter()
    for t in train:
        counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {g.doc_id: g for g in ctw.ctw_scores(frame, depth=depth, block_bytes=300).collect()}
    for i, t in docs:
        tokens, g = [*(t or "").encode().lower().split(), b""], got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert math.isclose(g.base_score, base, rel_tol=1e-9)
        assert math.isclose(g.score, tree.log10(t), rel_tol=1e-4, abs_tol=1e-4)
        if i is not None:
            assert g.held_out == (crc(i) == 1)


def test_scores_use_five_bytes_of_context_by_default(spark):
    """A byte that only the fifth byte before it tells."""
    docs = [(i, "".join(c + "----" + c for c in random.Random(i).choices("abcdefgh", k=20))) for i in range(25)]
    tree = BruteTree([t for i, t in docs if crc(i) != 1], 5)
    got = {g.doc_id: g.score for g in ctw.ctw_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert math.isclose(got[i], tree.log10(t), rel_tol=1e-4, abs_tol=1e-4)


# ---- toxicity ------------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row


def test_labels_stay_with_their_texts(spark):
    """Near copies of one label count once; texts of another label, or that share only a passage, stay."""
    ids = [i for i in range(400) if crc(i) != 0][:24]
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [f"{passage} own{i} words{i} here{i}" for i in ids[:22]] + ["copy of one text here"] * 2
    docs = spark.createDataFrame([*zip(ids, texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(n in (0, 22))) for n, i in enumerate(ids)], "doc_id long, toxic int")
    got = sorted((r.y, bytes(r.body).decode()) for r in tx.labelled_sample(docs, labels, "toxic", "doc_id", "text", 100).collect())
    assert [b for y, b in got if y == 1] == sorted([texts[0], texts[22]])
    assert texts[23] in [b for y, b in got if y == 0]


def test_automaton_against_edit_distance():
    terms = [tx.Term("idiot", False, 3), tx.Term("losers", False, 2), tx.Term("vequ", True, 4),
             tx.Term("lostra", True, 5), tx.Term("bad", False, 1)]
    lexicon, r = tx.Lexicon(terms), random.Random(2)
    for _ in range(4000):
        w = list(r.choice(terms).text + r.choice(["", "", "an", "s"]))
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(w) + 1)
            w[k:k + r.choice([0, 1])] = r.choice(["", "x", "e", "i"])
        w = "".join(w)
        found = []
        for i, t in enumerate(terms):
            row = edits(t.text, w)
            d = min(row) if t.stem else row[-1]
            if d <= (len(t.text) >= tx.FUZZY_FROM):
                found.append((d, -t.weight, i))
        want = min(found, default=None)
        assert lexicon.find(w) == (want and (want[2], want[0])), w


def test_context_tells_quotation_from_abuse():
    abuse = b"you are such an idiot!".split()
    quote = b'he said the word "idiot" was wrong'.split()
    assert tx.usage(abuse, 4)[0] > 0 > tx.usage(quote, 4)[0]


def toxic_table(spark, n=600):
    r = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    bad = ["grumblefest", "nastyword", "zork" + "x", "zorky", "zorkan"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = [r.choice(words) for _ in range(30)]
        if toxic:
            for _ in range(3):
                text[r.randrange(30)] = r.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_toxicity_held_out(spark):
    docs, labels, truth = toxic_table(spark)
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "a grumblefst here"), (None, "w1")],
                                  "doc_id long, text string")
    got = tx.toxicity(docs.union(extra).withColumn("label", F.lit(1)), labels).collect()
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert len(held) > 80 and all(g.predicted == truth[g.doc_id] for g in held)
    by = {g.doc_id: g for g in got}
    assert by[9001].score == by[9002].score < 0.5 and by[9003].terms == ["grumblefest"]
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_table(spark, 20)
    assert {g.score for g in tx.toxicity(docs, labels.limit(0)).collect()} == {0.5}


# ---- language ------------------------------------------------------------------------------------

def test_language_held_out_and_undetermined(spark):
    r = random.Random(4)
    parts = {"xx": ["ka", "ti", "mo"], "yy": ["sch", "ung", "ü"], "zz": ["ción", "que", "la"]}
    rows = [(i, (lang := list(parts)[i % 3]), " ".join("".join(r.choice(parts[lang]) for _ in range(3))
                                                       for _ in range(r.choice([3, 40, 200])))) for i in range(450)]
    rows += [(1000, "xx", None), (1001, None, ""), (1002, "yy", "123 ... 4"), (1003, None, "la que ción")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {g.doc_id: g for g in lg.language(docs).collect()}
    held = [i for i, lang, _ in rows[:450] if crc(i) == 0]
    assert np.mean([got[i].lang_pred == rows[i][1] for i in held]) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "zz"
    assert {g.lang_pred for g in lg.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_windows_cover_the_text():
    text = bytes(range(65, 91)) * 40
    w, sizes = lg.windows_of(text)
    assert b"".join(x[:n].tobytes() for x, n in zip(w, sizes)) == text.lower()
    assert lg.windows_of(b"")[0].shape == (1, lg.LENGTH)


# ---- quality -------------------------------------------------------------------------------------

def test_quality_held_out(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(800):
        bad = i % 5 == 2
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(60)]
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "en", f"src{i % 7}", len(text)))
        if i < 500:
            labels.append((i, int(not bad)))
    rows += [(9000, None, None, None, None), (9001, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    good = ql.good_documents(docs.withColumn("_quality_", F.lit(1)), labels)
    assert good.columns == [*docs.columns, "_quality_"]
    kept = {g.doc_id for g in good.collect()}
    assert [i for i in range(800) if (i in kept) != (i % 5 != 2)] == []
    # The table may lack the metadata.
    assert ql.good_documents(docs.select("doc_id", "text"), labels).count() > 600


def test_a_view_that_knows_nothing_teaches_nothing():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.98).astype(float)
    t, pool_t = (y * 2 - 1)[:, None] + rng.normal(0, 0.1, (400, 1)), rng.normal(0, 1, (300, 1))
    m, pool_m = rng.normal(0, 1, (400, 1)), rng.normal(0, 1, (300, 1))
    model = ql.cotrain(t, m, y, pool_t, pool_m)
    assert ((model.proba(t, m) >= 0.5) == (y == 1)).all()


def test_logistic_of_one_class_is_its_share():
    f = linear.fit(np.zeros((8, 2)), np.ones(8))
    assert math.isclose(f.proba(np.zeros((1, 2)))[0], 8.5 / 9)


# ---- secrets -------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_spans_against_regular_expressions(spark):
    r = random.Random(11)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "x1/+_.=-",
            "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é😀", "\n", "ſecret", "K"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(25)))) for i in range(300)] + [(300, None), (301, "")]
    got = se.scan(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", se.named(F.col("base")).alias("base"), F.size("assign").alias("n")).collect()
    for g in got:
        want = brute_base(dict(rows)[g.doc_id] or "")
        assert g.base == ",".join(f"{se.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert g.n == sum(k == 0 for _, k, _ in want)


def test_models_tell_random_from_ordinary(spark):
    r = random.Random(12)
    rand = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    word = lambda n: "".join(r.choice(["tion", "ment", "er", "the", "ing", "al"]) for _ in range(n))
    rows = [(i, " ".join([word(2), word(9), word(3), f"token={rand(32)}" if i % 2 else "", word(12)])) for i in range(200)]
    planted = {1000: rand(40), 1001: rand(24), 1002: word(14)}
    rows += [(i, f"see {s} there") for i, s in planted.items()]
    found = {g.doc_id: g.added for g in se.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in found[1000]] == [(4, 44)] and [(s["start"], s["end"]) for s in found[1001]] == [(4, 28)]
    assert found[1002] == [] and all(not found[i] for i in range(200))


def test_hash_of_no_spans(spark):
    q = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    got = se.scan(q).select(F.sha2(se.named(F.col("base")).cast("binary"), 256).alias("h")).head()
    assert got.h == hashlib.sha256(b"").hexdigest()


def test_rare_secrets_still_teach_the_model(spark):
    """Labelled strings in one document of many are found, and so are random strings that no pattern knows."""
    r = random.Random(8)
    chars = string.ascii_letters + string.digits + "+/"
    value = lambda n: "".join(r.choice(chars) for _ in range(n))
    rows = [(i, f"ordinary words about number {i} in some_long-file_name or word-list_{i}") for i in range(3000)]
    rows += [(10_000 + i, f"token={value(32)}") for i in range(60)]
    planted = {20_000 + i: value(28) for i in range(40)}
    rows += [(i, f"see {v} there") for i, v in planted.items()]
    rows += [(30_000 + i, "a long_identifier_of_ordinary_words and configuration-file-for-production") for i in range(40)]
    got = {g.doc_id: g.added for g in se.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4),
                                              max_ordinary=200).collect()}
    assert sum(bool(got[i]) for i in planted) >= 38  # recall on strings outside the patterns
    assert not any(a for i, a in got.items() if i not in planted)


def test_many_matches_in_one_text(spark):
    n = 20_000
    text = "".join(f"password=abcdef{i % 7} é " for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "password=abcdefg")], "doc_id long, text string")
    began = time.time()
    got = {g.doc_id: g for g in se.scan(docs).select("doc_id", "base").collect()}
    assert time.time() - began < 60
    want = [(m.start(), m.end()) for m in re.finditer(r"password=abcdef\d", text)]
    assert [(b.start, b.end) for b in got[1].base] == want and len(want) == n
    assert [(b.start, b.end) for b in got[2].base] == [(0, 16)]
