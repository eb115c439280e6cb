"""Secret scan in DataFrame functions: fixed patterns, and character Markov models of random strings
against ordinary identifiers.

The two models are bigram tables, counted from labelled samples: values that the fixed patterns
matched, and words of the same texts that no pattern touches. A long run of token characters is a
secret when its mean log-likelihood ratio is above a threshold set between both samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixspark.sources.scratch import stored

#: Labelled random strings the model is fitted on, of all distinct ones in the table, and documents that
#: give ordinary words; the first by their hashes.
MAX_RANDOM, MAX_ORDINARY = 20_000, 1_000
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|""" \
    r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Only a run that is long enough can be a match, and no shorter run hides another match.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6
#: Characters of the model, with all others as one, and the shortest run it judges.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST_RUN = 20
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
ORDINARY = "[A-Za-z][A-Za-z0-9_-]{3,}"
#: The threshold is halfway between the medians of both samples, and never below so many nats a pair.
LEAST_RATIO = 0.5
STATES = len(ALPHABET) + 1
#: Pseudo-counts of the single characters' shares in each row of a model.
BACKOFF = 30.0
#: Matches whose places are added up in one array.
SPAN_BLOCK = 64


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; written out, it would be computed at every use, and
    inside a lambda for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, kind: int, values: Column | None = None, keep=None) -> Column:
    """array<struct<start, kind, end>> of a pattern's matches in code points; ``keep`` filters by the
    match's entry of ``values``. Time is linear in the text."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def placed(portion, begin):
        return F.aggregate(portion, F.struct(begin.alias("at"), none.alias("out")), lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(s["out"], F.array(F.struct(
                (s["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"),
                (s["at"] + x["gap"] + x["len"]).alias("end")))).alias("out")), lambda s: s["out"])

    def portions(lengths):
        last = F.floor((F.size(lengths) - 1) / F.lit(SPAN_BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(lengths, j * SPAN_BLOCK + 1, SPAN_BLOCK))

    def begins(parts):
        return F.aggregate(parts, F.array(F.lit(0)), lambda s, portion: F.concat(s, F.array(
            F.element_at(s, -1) + F.aggregate(portion, F.lit(0), lambda n, x: n + x["gap"] + x["len"]))))

    def all_of(found):
        # After i gaps and i - 1 matches stands the i-th match.
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(
            F.length(g).alias("gap"), F.length(m).alias("len")))
        # An array grows by copying it. So places are added up block by block, and the blocks put together.
        got = bound(lengths, lambda n: bound(portions(n), lambda p: bound(
            begins(p), lambda b: F.flatten(F.zip_with(p, F.slice(b, F.lit(1), F.size(p)), placed)))))
        if keep is not None:
            got = bound(values, lambda v: F.filter(got, lambda _, i: keep(F.get(v, i))))
        return F.when(F.size(found) > 0, got).otherwise(none)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), all_of)


def base_spans(text: Column) -> list[Column]:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    return [spans(text, ASSIGN, 0, values, lambda v: F.length(v) >= LEAST_VALUE),
            spans(text, ACCESS, 1), spans(text, HEX, 2)]


def named(found: Column) -> Column:
    """kind:start:end by start, then kind, joined with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def bigrams(word: Column) -> Column:
    """The numbers of a word's neighbouring character pairs, in time linear in its length."""
    states = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.greatest(F.length(word) - 1, F.lit(0))
    return F.zip_with(F.slice(states, F.lit(1), n), F.slice(states, F.lit(2), n), lambda a, b: a * STATES + b)


@dataclass
class Ratio:
    """Log-likelihood ratio of a random against an ordinary string for each pair of characters."""
    pairs: np.ndarray
    threshold: float

    def of(self, word: Column) -> Column:
        """Mean ratio a pair of characters."""
        table = F.lit(self.pairs)
        total = F.aggregate(bigrams(word), F.lit(0.0), lambda s, b: s + F.get(table, b))
        return total / (F.length(word) - 1)


def log_transitions(counts: dict[int, int]) -> np.ndarray:
    """Pair counts as log transition probabilities. What was rarely seen follows the single
    characters' shares, so a small sample does not punish pairs that it lacks."""
    n = np.zeros(STATES * STATES)
    for pair, c in counts.items():
        n[pair] = c
    n = n.reshape(STATES, STATES)
    single = (n.sum(0) + 0.5) / (n.sum() + 0.5 * STATES)
    return np.log((n + BACKOFF * single) / (n.sum(1, keepdims=True) + BACKOFF)).ravel()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_random: int = MAX_RANDOM,
          max_ordinary: int = MAX_ORDINARY) -> Ratio:
    """Counts both models: random strings are distinct values that the fixed patterns match anywhere in the
    table, at most ``max_random`` of them; ordinary words come from ``max_ordinary`` documents. Only pair counts
    (at most STATES squared) and two medians reach the driver. Without labelled random strings nothing is ever
    added."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    secret = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1)),
                      F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    random = texts.select(F.explode(secret).alias("w")).where(F.length("w") >= LEAST_RUN).distinct().orderBy(
        F.xxhash64("w"), "w").limit(max_random)
    random = stored(random.select(F.lit(1).alias("y"), "w"), "random")
    ids = texts.where("id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_ordinary)
    words = texts.join(F.broadcast(ids), "id").select(F.lit(0).alias("y"), F.explode(
        F.array_distinct(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0)))).alias("w")).where(
        F.length("w") < LEAST_RUN)  # a longer run may be a secret that no pattern knows
    pairs = random.unionByName(words).select("y", F.explode(bigrams(F.col("w"))).alias("pair")).groupBy(
        "y", "pair").count()
    counts = {0: {}, 1: {}}
    for r in pairs.toLocalIterator():
        counts[r["y"]][r["pair"]] = r["count"]
    ratio = Ratio(log_transitions(counts[1]) - log_transitions(counts[0]), float("inf"))
    if counts[1]:
        mean = ratio.of(F.col("w"))
        middle = random.unionByName(words).groupBy("y").agg(F.percentile_approx(mean, 0.5).alias("m"))
        middles = {r["y"]: r["m"] for r in middle.collect()}
        ratio.threshold = max(LEAST_RATIO, (middles[1] + middles.get(0, -middles[1])) / 2)
    return ratio


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id and arrays of struct<start, kind, end>: base (the fixed patterns, kinds 0 to 2)
    and added (runs the models call random, kind 3, that touch no base span).

    Offsets are code points, the end exclusive. A null or empty text has no spans. Repeated rows
    are scanned alike; other columns are not read. Texts of any length are scanned whole.
    """
    ratio = train(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    found = rows.select("doc_id", *[c.alias(k) for c, k in zip(base_spans(text), KINDS)],
                        spans(text, RUN, 3, runs, lambda w: ratio.of(w) > ratio.threshold).alias("markov"))
    found = found.withColumn("base", F.concat("assign", "access", "hex"))
    apart = F.filter("markov", lambda m: ~F.exists(
        "base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.select("doc_id", "assign", "access", "hex", "base", apart.alias("added"))
