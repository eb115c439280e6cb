"""Language identification by a small convolutional network over bytes.

Bytes are embedded; filters of several widths slide over a window of fixed length; the largest
response of each filter goes through a softmax layer. The network is trained in numpy on windows
of labelled texts. A text's prediction averages all of its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.llm.common import body, fold, values

#: Bounds of the training sample, chosen by a hash of the id: documents, and windows of each.
MAX_LABELLED, WINDOWS_EACH = 4000, 2
LENGTH = 192
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 8
EPOCHS, BATCH, RATE = 8, 64, 3e-3
#: Windows scored at once.
TOGETHER = 256
PAD = 0
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray    # 256 x EMBED
    conv: np.ndarray     # widest * EMBED x filters; narrow filters are zero beyond their width
    conv_bias: np.ndarray
    out: np.ndarray      # filters x langs
    out_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, filters) before the pooling; a place sees the widest filter's bytes."""
        e = self.embed[windows]
        n, length, d = e.shape
        wide = max(WIDTHS)
        step = e.strides
        patches = np.lib.stride_tricks.as_strided(
            e, (n, length - wide + 1, wide * d), (step[0], step[1], step[2]))
        return np.ascontiguousarray(patches).reshape(-1, wide * d).dot(self.conv).reshape(
            n, length - wide + 1, -1)

    def proba(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(windows).max(1) + self.conv_bias, 0)
        return softmax(pooled @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def width_mask() -> np.ndarray:
    """Which weights of the widest filter each filter has."""
    rows = np.arange(max(WIDTHS) * EMBED)[:, None] // EMBED
    return (rows < np.repeat(WIDTHS, FILTERS)[None]).astype(np.float32)


def windows_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The whole text in windows, A-Z in lower case, the last one padded; and their lengths."""
    raw = np.frombuffer(text.lower(), np.uint8)
    n = max(1, -(-len(raw) // LENGTH))
    out = np.full(n * LENGTH, PAD, np.uint8)
    out[:len(raw)] = raw
    sizes = np.full(n, LENGTH)
    sizes[-1] = len(raw) - (n - 1) * LENGTH
    return out.reshape(n, LENGTH), sizes


def fit(windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Adam on the cross entropy. Only the place where a filter responds most learns."""
    rng = np.random.default_rng(seed)
    mask, filters = width_mask(), len(WIDTHS) * FILTERS
    scale = 1 / np.sqrt(np.repeat(WIDTHS, FILTERS) * EMBED)
    net = Network(langs, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                  (rng.normal(0, 1, (max(WIDTHS) * EMBED, filters)) * scale * mask).astype(np.float32),
                  np.zeros(filters, np.float32),
                  rng.normal(0, 0.1, (filters, len(langs))).astype(np.float32),
                  np.zeros(len(langs), np.float32))
    names = ["embed", "conv", "conv_bias", "out", "out_bias"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    # Rare languages weigh as much as the square root of their share.
    weight = 1 / np.sqrt(np.maximum(np.bincount(labels, minlength=len(langs)), 1))
    weight = weight[labels] / weight[labels].mean()
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            x, y, w = windows[pick], labels[pick], weight[pick].astype(np.float32)
            r = net.responses(x)
            place = r.argmax(1)
            top = np.take_along_axis(r, place[:, None], 1)[:, 0] + net.conv_bias
            pooled = np.maximum(top, 0)
            d = softmax(pooled @ net.out + net.out_bias)
            d[np.arange(len(y)), y] -= 1
            d *= w[:, None] / len(y)
            back = (d @ net.out.T) * (top > 0)
            bytes_at = x[np.arange(len(x))[:, None, None], place[:, :, None] + np.arange(max(WIDTHS))]
            patch = net.embed[bytes_at].reshape(len(x), filters, -1)
            g = {"out": pooled.T @ d, "out_bias": d.sum(0), "conv_bias": back.sum(0),
                 "conv": np.einsum("nf,nfk->kf", back, patch) * mask, "embed": np.zeros_like(net.embed)}
            np.add.at(g["embed"], bytes_at, (back[:, :, None] * (net.conv * mask).T).reshape(*bytes_at.shape, EMBED))
            step += 1
            for k in names:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                getattr(net, k)[...] -= RATE * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_labelled: int = MAX_LABELLED) -> Network:
    """Learns from texts with a language whose fold (crc32 of the id modulo 5) is not 0; windows are
    taken anywhere in the whole text."""
    ids = docs.select(F.col(id_col).alias("id")).where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
        & (fold(F.col(id_col)) != 0)).distinct().orderBy(F.xxhash64("id"), "id").limit(max_labelled)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picked = []
            for i, text in zip(values(b["id"]), values(b["body"])):
                w, sizes = windows_of(text)
                rng = np.random.default_rng(abs(hash(i)))
                take = rng.choice(len(w), min(WINDOWS_EACH, len(w)), replace=False)
                picked.append([w[j].tobytes() for j in take if sizes[j] >= 8])
            yield pa.RecordBatch.from_arrays([b["id"], b["lang"], pa.array(picked, pa.list_(pa.binary()))],
                                             ["id", "lang", "windows"])

    got = (docs.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), body(F.col(text_col)).alias("body"))
        .join(F.broadcast(ids), "id")
        .mapInArrow(some, "id long, lang string, windows array<binary>")
        .groupBy("id").agg(F.min_by("windows", "lang").alias("windows"), F.min("lang").alias("lang"))
        .orderBy("id").toPandas())
    pairs = [(lang, w) for lang, ws in zip(got["lang"], got["windows"]) for w in ws]
    langs = sorted({lang for lang, _ in pairs}) or [UNKNOWN]
    x = np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(-1, LENGTH)
    return fit(x, np.array([langs.index(lang) for lang, _ in pairs], np.int64), langs)


def predict(texts: list[bytes], net: Network) -> np.ndarray:
    """Per text the mean probability of each language over its windows, weighted by their lengths."""
    sums, sizes, held, owner, length = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts)), [], [], []

    def out():
        w, who, n = np.concatenate(held), np.concatenate(owner), np.concatenate(length)
        for i in range(0, len(w), TOGETHER):
            p = net.proba(w[i:i + TOGETHER]) * n[i:i + TOGETHER, None]
            np.add.at(sums, who[i:i + TOGETHER], p)
        np.add.at(sizes, who, n)
        held.clear(), owner.clear(), length.clear()

    for i, text in enumerate(texts):
        w, n = windows_of(text)
        held.append(w)
        owner.append(np.full(len(w), i))
        length.append(np.maximum(n, 1))
        if sum(map(len, held)) >= TOGETHER:
            out()
    if held:
        out()
    return sums / np.maximum(sizes, 1)[:, None]


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, held_out (fold 0), lang_pred, score (mean probability of that language).

    A null text, an empty one and one without any letter is "und" with score 0. Without any labelled
    text all predictions are "und". Very long texts are read window by window. Repeated rows get
    equal answers; columns besides the id and the text are read in training only.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = net.value
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                texts = list(values(part["body"]))
                p = predict(texts, n)
                known = np.array([bool(LETTER.search(t.decode("utf-8", "ignore"))) for t in texts])
                known &= n.langs != [UNKNOWN]
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"],
                     pa.array([n.langs[j] if k else UNKNOWN for j, k in zip(best, known)], pa.string()),
                     pa.array(np.where(known, p.max(1), 0.0).clip(0, 1), pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"),
                       body(F.col(text_col)).alias("body")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
