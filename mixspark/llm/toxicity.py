"""Toxic documents: a lexicon in a trie, met by Levenshtein automata, and the context of each hit.

The lexicon is learned: words and word stems that mark the labelled toxic documents. Every
word of a text runs through the trie together with a Levenshtein automaton, so misspelled terms are
met too. A window around each hit tells quotation from abuse, and a small logistic
model turns the hits into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.llm import linear
from mixspark.llm.common import REMEMBERED, WordHashes, as_signed, body, fold, mixed, values, word_lists
from mixspark.llm.jaccard_join import K, shingles
from mixspark.sources.scratch import stored

#: Bound of the labelled sample, chosen by a hash of the id.
MAX_LABELLED = 20_000
#: Stems have at least and whole prefixes tried at most so many letters.
STEM_FROM, STEM_TO = 4, 8
#: A term marks toxicity from this odds ratio and this log-likelihood ratio on.
MIN_RATIO, MIN_LLR = 12.0, 20.0
#: Terms of at least so many letters are also met with one edit.
FUZZY_FROM = 5
#: Words on each side of a hit that say how it is used.
WINDOW = 5
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¡¿…"
QUOTES = tuple(c.encode() for c in '"«»“”„‘’`')
REPORTING = frozenset(
    "said says say wrote write writes called calls call quote quoted quotes term word reported "
    "dijo dice llamado palabra dit disait appelle mot sagte sagt nannte wort zitat".encode().split())
ADDRESS = frozenset("you your you're youre u ur du dich dir dein deine tu te toi ton vous votre "
                    "usted tú ti eres".encode().split())


# ---- lexicon -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # any word that begins so, else this word alone
    weight: float  # log odds ratio


def letters(word: bytes) -> str:
    """The word without punctuation at its ends."""
    return word.decode("utf-8", "ignore").lower().strip(EDGE)


def forms(text: bytes) -> set[tuple[str, bool]]:
    """The distinct words of a text and the prefixes that could be stems."""
    words = {letters(w) for some in word_lists(text) for w in set(some)}
    out = {(w, False) for w in words if len(w) > 2}
    out.update((w[:n], True) for w in words for n in range(STEM_FROM, min(STEM_TO, len(w)) + 1))
    return out


def log_likelihood_ratio(a: float, n: float, b: float, m: float) -> float:
    """How far a of n and b of m are from one common share."""
    def part(x, total, p):
        return x * math.log(x / total / p) if x else 0.0
    p = (a + b) / (n + m)
    if not 0 < p < 1:
        return 0.0
    return 2 * (part(a, n, p) + part(n - a, n, 1 - p) + part(b, m, p) + part(m - b, m, 1 - p))


def select_terms(counts: dict[tuple[str, bool], tuple[int, int]], toxic: int, clean: int) -> list[Term]:
    """Terms that mark toxic documents: of each marked stem the longest form that still covers most of
    it, be it a longer stem or a single word."""
    def ratio(a, b):
        return ((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1))
    good = {t: math.log(ratio(*c)) for t, c in counts.items()
            if ratio(*c) >= MIN_RATIO and log_likelihood_ratio(c[0], toxic, c[1], clean) >= MIN_LLR}
    children: dict[str, list[tuple[str, bool]]] = {}
    for w, stem in good:
        if stem and len(w) > STEM_FROM:
            children.setdefault(w[:-1], []).append((w, True))
        elif not stem:
            for n in range(STEM_FROM, min(STEM_TO, len(w)) + 1):
                children.setdefault(w[:n], []).append((w, False))
    chosen = {}
    for term in sorted(good, key=lambda t: (len(t[0]), t)):
        w, stem = term
        if stem and (w[:-1], True) in good or not stem and any((w[:n], True) in good for n in range(STEM_FROM, len(w) + 1)):
            continue  # its shortest marked stem decides
        while stem:
            most = max(children.get(w, []), key=lambda t: (counts[t][0], not t[1], t), default=None)
            if most is None or counts[most][0] < 0.8 * counts[w, True][0]:
                break
            w, stem = most
        chosen[w, stem] = good[w, stem]
    return [Term(w, s, x) for (w, s), x in sorted(chosen.items())]


class Lexicon:
    """A trie of terms. ``find`` walks it along with a Levenshtein automaton of the word."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        # With one edit at most, one half of a term stays as it is; only such words need the walk.
        self.first, self.last, self.inner = set(), set(), set()
        self.first_stem, self.exact = set(), {}
        for i, t in enumerate(terms):
            node = 0
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(i)
            n, h = len(t.text), len(t.text) // 2
            if not t.stem:
                self.exact[t.text] = i
            elif n < FUZZY_FROM:
                self.first_stem.add(t.text)
            if n >= FUZZY_FROM:
                if t.stem:
                    self.first_stem.add(t.text[:h])
                    self.inner.update((h + d, t.text[h:]) for d in (-1, 0, 1))
                else:
                    self.first.update((t.text[:h], n + d) for d in (-1, 0, 1))
                    self.last.update((t.text[h:], n + d) for d in (-1, 0, 1))
        self.first_sizes = sorted({len(f) for f, _ in self.first})
        self.last_sizes = sorted({len(x) for x, _ in self.last})
        self.stem_sizes = sorted({len(x) for x in self.first_stem})
        self.inner_places = sorted({(p, len(x)) for p, x in self.inner})

    def possible(self, w: str) -> bool:
        n = len(w)
        return (w in self.exact or any((w[:k], n) in self.first for k in self.first_sizes)
                or any((w[-k:], n) in self.last for k in self.last_sizes)
                or any(w[:k] in self.first_stem for k in self.stem_sizes)
                or any((p, w[p:p + k]) in self.inner for p, k in self.inner_places))

    def find(self, w: str) -> tuple[int, int] | None:
        """The best term of a word and its edits: fewest edits first, then the most telling."""
        if not w or not self.possible(w):
            return None
        found, start = [], [min(j, 2) for j in range(len(w) + 1)]
        stack = [(0, start, 0)]
        while stack:
            node, row, depth = stack.pop()
            for i in self.ends[node]:
                t = self.terms[i]
                edits = min(row) if t.stem else row[-1]
                if edits <= (len(t.text) >= FUZZY_FROM):
                    found.append((edits, -t.weight, i))
            for c, child in self.children[node].items():
                new = [min(depth + 1, 2)]
                for j, x in enumerate(w):
                    new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1, 2))
                if min(new) < 2:
                    stack.append((child, new, depth + 1))
        if not found:
            return None
        edits, _, i = min(found)
        return i, edits


# ---- documents ---------------------------------------------------------------------------------

class Hits(dict):
    """What the lexicon says of a word, remembered up to a bound; None for no hit."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes):
        got = self.lexicon.find(letters(word))
        if len(self) < REMEMBERED:
            self[word] = got
        return got


FEATURES = 13


def usage(words: list[bytes], i: int) -> tuple[float, float]:
    """From -1 (quotation) to 1 (abuse) and whether someone is addressed, by the words around a hit."""
    near = words[max(0, i - WINDOW):i + WINDOW + 1]
    quoted = sum(any(q in w for q in QUOTES) for w in near) + sum(w.strip(b".,:;") in REPORTING for w in near)
    address = sum(w.strip(b".,:;!?") in ADDRESS for w in near)
    shouted = sum(w.endswith(b"!") for w in near) / len(near)
    return math.tanh(0.5 * address + shouted - 0.7 * quoted), float(address > 0)


def features(text: bytes, hits: Hits) -> np.ndarray:
    terms = hits.lexicon.terms
    exact = stems = fuzzy = abuse = quoted = address = 0.0
    weight, best, n, seen = 0.0, 0.0, 0, set()
    for words in word_lists(text):
        n += len(words)
        got = list(map(hits.__getitem__, words))
        if not any(got):
            continue
        for i, hit in enumerate(got):
            if hit is None:
                continue
            t = terms[hit[0]]
            exact += not hit[1] and not t.stem
            stems += not hit[1] and t.stem
            fuzzy += hit[1]
            tone, you = usage(words, i)
            abuse += max(tone, 0)
            quoted += max(-tone, 0)
            address += you
            if not hit[1]:
                weight += t.weight
                best = max(best, t.weight)
                seen.add(hit[0])
    log = np.log1p
    return np.array([exact > 0, log(exact), stems > 0, log(stems), fuzzy > 0, log(fuzzy), log(len(seen)), best,
                     log(weight), log(abuse), log(quoted), log(address),
                     100 * (exact + stems) / (n + 20)])


@dataclass
class ToxicModel:
    lexicon: Lexicon
    classifier: linear.Logistic


def form_counts(wanted):
    """Per task and form the number of texts that have it; of all forms, or of the wanted ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        only = None if wanted is None else wanted.value
        for b in batches:
            for text in values(b["body"]):
                got = forms(text)
                counts.update(got if only is None else got & only)
        rows = [(w, s, n) for (w, s), n in counts.items()]
        for i in range(0, len(rows), 10_000):
            w, s, n = zip(*rows[i:i + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(w, pa.string()), pa.array(s, pa.bool_()), pa.array(n, pa.int64())], ["form", "stem", "n"])
    return run


def copy_marks():
    """Two independent minima of the shingles' hashes; a text without words has none."""
    @F.pandas_udf("array<long>")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            sets = (shingles(hashes.of(t)) for t in texts)
            yield pd.Series([as_signed(np.array([s[0], mixed(s + K).min()])) if len(s) else np.zeros(0, np.int64)
                             for s in sets], dtype=object)
    return marks


def labelled_sample(docs, labels, label, id_col, text_col, bound):
    truth = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(label).cast("int").alias("y"))
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").where(fold(F.col("id")) != 0).join(
        truth, "id").distinct().orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = docs.select(F.col(id_col).alias("id"), body(F.col(text_col)).alias("body")).join(F.broadcast(ids), "id")
    # Copies would make every word of theirs look telling: texts of one label whose marks are the same,
    # as they are for most near copies, count once. The text is that of the smallest id.
    return rows.groupBy("y", copy_marks()(F.col("body")).alias("marks")).agg(
        F.min(F.struct("id", "body")).alias("one")).select("y", "one.body")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", max_labelled: int = MAX_LABELLED) -> ToxicModel:
    """Learns from labelled documents whose fold (crc32 of the id modulo 5) is not 0. Of
    contradicting labels the highest counts. Without toxic examples the lexicon is empty and the score
    is the smoothed share of toxic labels."""
    context = docs.sparkSession.sparkContext
    sample = stored(labelled_sample(docs, labels, label, id_col, text_col, max_labelled), "labelled")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    kind = "form string, stem boolean, n long"
    least = max(3, toxic // 200)
    marked = {(r["form"], r["stem"]): r["n"] for r in sample.where("y = 1").mapInArrow(form_counts(None), kind)
              .groupBy("form", "stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toLocalIterator()}
    wanted = context.broadcast(frozenset(marked))
    other = {(r["form"], r["stem"]): r["n"] for r in sample.where("y = 0").mapInArrow(form_counts(wanted), kind)
             .groupBy("form", "stem").agg(F.sum("n").alias("n")).toLocalIterator()}
    terms = select_terms({t: (n, other.get(t, 0)) for t, n in marked.items()}, toxic, clean)
    lexicon = context.broadcast(Lexicon(terms))

    def vectors(batches):
        hits = Hits(lexicon.value)
        for b in batches:
            f = [features(t, hits).tolist() for t in values(b["body"])]
            yield pa.RecordBatch.from_arrays([b["y"], pa.array(f, pa.list_(pa.float64()))], ["y", "f"])

    got = sample.mapInArrow(vectors, "y int, f array<double>").toPandas()
    x = np.array(got["f"].tolist()).reshape(-1, FEATURES)
    return ToxicModel(lexicon.value, linear.fit(x, got["y"].to_numpy(np.float64)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **options) -> DataFrame:
    """Per row: doc_id, held_out (fold 0), score (0 to 1), predicted (score >= 0.5), and terms
    (the distinct terms met).

    Whole texts are scored from their words alone. A null or empty text has no hits and gets the
    score of a text without hits; so does any text when no label says otherwise. Repeated rows score
    alike; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        train(docs, labels, id_col=id_col, text_col=text_col, **options))

    def score(batches):
        m = model.value
        hits = Hits(m.lexicon)
        for b in batches:
            met, x = [], []
            for text in values(b["body"]):
                x.append(features(text, hits))
                met.append(sorted({m.lexicon.terms[h[0]].text for some in word_lists(text)
                                   for h in map(hits.__getitem__, set(some)) if h}) if x[-1].any() else [])
            p = m.classifier.proba(np.array(x).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)),
                 pa.array(met, pa.list_(pa.string()))], ["doc_id", "held_out", "score", "predicted", "terms"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"),
                       body(F.col(text_col)).alias("body")).mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int, terms array<string>")
