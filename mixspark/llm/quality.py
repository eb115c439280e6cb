"""Document quality by co-training: one classifier sees the text, the other the page's metadata.

Both start from the labelled sample. In each round each view labels the unlabelled documents it
is surest of for the other view. Then each view is calibrated on labelled documents that neither was
trained on, and a small model combines the two calibrated views.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixspark.llm import linear
from mixspark.llm.common import body, fold, free_names, word_lists

#: Bounds of the samples that are fitted on the driver, chosen by a hash of the id.
MAX_LABELLED, MAX_UNLABELLED = 8000, 8000
ROUNDS = 4
#: How sure a view must be to label for the other, and the largest share of the pool a round takes.
SURE, TAKEN = 0.97, 0.1
KEEP_AT = 0.5

PUNCTUATION = np.frombuffer(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", np.uint8)
LANGS, SOURCES = 16, 64
TEXT_DIM = len(PUNCTUATION) + 14
META_DIM = LANGS + SOURCES + 4


def text_features(text: bytes) -> np.ndarray:
    """Shares of character classes and of repeated, shouted and wordless words, of the whole text."""
    out = np.zeros(TEXT_DIM)
    n = len(text)
    if not n:
        return out
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    out[:len(PUNCTUATION)] = np.sqrt(c[PUNCTUATION])
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    words = distinct = again = short = long = plain = 0
    top: Counter = Counter()
    last = None
    for some in word_lists(text):
        words += len(some)
        again += sum(a == b for a, b in zip(some, some[1:])) + (bool(some) and last == some[0])
        short += sum(len(w) <= 2 for w in some)
        long += sum(len(w) > 15 for w in some)
        plain += sum(w.isalpha() for w in some)
        top.update(some)
        last = some[-1] if some else last
    distinct = len(top)
    w = max(words, 1)
    lines = text.split(b"\n")
    k = len(PUNCTUATION)
    out[k:] = [1.0, upper, lower, digit, c[32] + c[9:14].sum(), c[128:].sum(), upper / max(upper + lower, 1e-9),
               distinct / w ** 0.9, again / w, short / w, long / w, plain / w,
               max(top.values(), default=0) / w, 1 - len(set(lines)) / len(lines)]
    return out


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed language and source, and the stated length; a null has a mark of its own."""
    out = np.zeros(META_DIM)
    if lang is not None:
        out[zlib.crc32(lang.encode()) % LANGS] = 1
    if source is not None:
        out[LANGS + zlib.crc32(source.encode()) % SOURCES] = 1
    known = n_chars is not None and n_chars == n_chars
    size = np.log1p(max(n_chars, 0)) if known else 0.0
    out[-4:] = [size, size * size, not known, source is None]
    return out


@dataclass
class CoTrained:
    text: linear.Logistic
    meta: linear.Logistic
    text_scale: linear.Logistic
    meta_scale: linear.Logistic
    both: linear.Logistic

    def views(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The calibrated logits of both views."""
        return (self.text_scale.logit(self.text.logit(t)[:, None]),
                self.meta_scale.logit(self.meta.logit(m)[:, None]))

    def proba(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.both.proba(np.column_stack(self.views(t, m)))


def cotrain(t: np.ndarray, m: np.ndarray, y: np.ndarray, pool_t: np.ndarray, pool_m: np.ndarray,
            rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """Every fifth labelled row is set aside to calibrate and combine the views."""
    aside = np.arange(len(y)) % 5 == 0
    a = ~aside
    views, pools = {"text": t, "meta": m}, {"text": pool_t, "meta": pool_m}
    given = {v: np.full(len(pool_t), np.nan) for v in views}  # pseudo-labels each view received

    def fitted(v):
        """The view's classifier and its calibration on the rows that were set aside."""
        got = ~np.isnan(given[v])
        f = linear.fit(np.vstack([views[v][a], pools[v][got]]), np.concatenate([y[a], given[v][got]]))
        return f, linear.fit(f.logit(views[v][aside])[:, None], y[aside], ridge=0.1)

    for _ in range(rounds):
        models, new = {v: fitted(v) for v in views}, 0
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            f, scale = models[teacher]
            p = scale.proba(f.logit(pools[teacher])[:, None])
            for label in (0, 1):  # in proportion, so the exchange keeps the classes' shares
                share = np.mean(y[a] == label) if a.any() else 0.5
                doubt = np.abs(p - label)
                # Surer than the class's share alone would make a view that knows nothing.
                mine = np.flatnonzero(np.isnan(given[pupil]) & (doubt <= (1 - sure) * min(1, 4 * (1 - share))))
                most = int(np.ceil(TAKEN * share * len(p)))
                pick = mine[np.argsort(doubt[mine], kind="stable")][:most]
                given[pupil][pick] = label
                new += len(pick)
        if not new:
            break
    (text, text_scale), (meta, meta_scale) = fitted("text"), fitted("meta")
    model = CoTrained(text, meta, text_scale, meta_scale, linear.fit(np.zeros((0, 2)), np.zeros(0)))
    model.both = linear.fit(np.column_stack(model.views(t[aside], m[aside])), y[aside], ridge=0.1)
    return model


def scorer(model):
    """A Pandas UDF of (text bytes, lang, source, n_chars) with the combined and both views' scores."""
    @F.pandas_udf("score double, text_score double, meta_score double")
    def quality(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        fitted = model.value
        for texts, langs, sources, sizes in batches:
            t = np.array([text_features(x) for x in texts]).reshape(-1, TEXT_DIM)
            m = np.array([meta_features(*x) for x in zip(langs, sources, sizes)]).reshape(-1, META_DIM)
            one, two = fitted.views(t, m)
            yield pd.DataFrame({"score": fitted.proba(t, m), "text_score": linear.sigmoid(one),
                                "meta_score": linear.sigmoid(two)})
    return quality


def view_columns(docs: DataFrame, text_col: str) -> list[Column]:
    """What the views read; a metadata column that the table lacks counts as null."""
    def or_null(c, kind):
        return F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    return [body(F.col(text_col)), or_null("lang", "string"), or_null("source", "string"),
            or_null("n_chars", "double")]


def features(*columns: Column) -> Column:
    """Both views' features as a struct of arrays t and m."""
    @F.pandas_udf("t array<double>, m array<double>")
    def of(texts: pd.Series, langs: pd.Series, sources: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"t": [text_features(x).tolist() for x in texts],
                             "m": [meta_features(*x).tolist() for x in zip(langs, sources, sizes)]})
    return of(*columns)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", max_labelled: int = MAX_LABELLED,
          max_unlabelled: int = MAX_UNLABELLED) -> CoTrained:
    """Fits on documents whose fold (crc32 of the id modulo 5) is not 0. Of contradicting labels
    the lowest counts; null labels are none. Without labels every score is 0.5."""
    q_id, q_y = free_names(docs, "_q_id", "_q_y")
    truth = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias(q_id)).agg(
        F.min(label).cast("double").alias(q_y))
    ids = docs.select(F.col(id_col).alias(q_id)).where(F.col(q_id).isNotNull()).where(
        fold(F.col(q_id)) != 0).join(truth, q_id, "left")
    order = [F.xxhash64(q_id), F.col(q_id)]
    sample = ids.where(F.col(q_y).isNotNull()).distinct().orderBy(*order).limit(max_labelled).union(
        ids.where(F.col(q_y).isNull()).distinct().orderBy(*order).limit(max_unlabelled))
    rows = docs.join(F.broadcast(sample), F.col(id_col) == F.col(q_id)).select(
        F.col(q_id).alias("id"), F.col(q_y).alias("y"), features(*view_columns(docs, text_col)).alias("f"))
    got = rows.groupBy("id").agg(F.min("y").alias("y"), F.min("f").alias("f")).toPandas()
    got = got.iloc[np.argsort([zlib.crc32(str(i).encode()) for i in got["id"]], kind="stable")]
    t = np.array([f["t"] for f in got["f"]]).reshape(-1, TEXT_DIM)
    m = np.array([f["m"] for f in got["f"]]).reshape(-1, META_DIM)
    y = got["y"].to_numpy(np.float64)
    known = ~np.isnan(y)
    return cotrain(t[known], m[known], y[known], t[~known], m[~known])


def quality_scores(docs: DataFrame, labels: DataFrame, name: str = "_quality", id_col: str = "doc_id",
                   text_col: str = "text", **options) -> DataFrame:
    """``docs`` with a struct column of score, text_score and meta_score (probabilities of good quality).

    Whole texts are scored; null and empty ones alike, by metadata and the intercept of the text view.
    Repeated rows get equal scores. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        train(docs, labels, id_col=id_col, text_col=text_col, **options))
    return docs.withColumn(name, scorer(model)(*view_columns(docs, text_col)))


def good_documents(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    [name] = free_names(docs, "_quality")
    scored = quality_scores(docs, labels, name, **options)
    return scored.where(F.col(f"{name}.score") >= keep_at).select(*docs.columns)
