"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period q and at least two periods that no neighbour extends.
Periods up to four are compared directly. Each scale t = 2, 4, 8, ... then finds the periods from
3t - 1 to 6t - 2. Its synchronising set holds the positions i for which the least hash of the windows of
t words that start in i..i+t stands at one of both ends. Whether a position belongs depends on its 2t
words only, so a run repeats its positions at every period: two positions with equal contexts of 2t words
propose their distance, and the matching words around them are counted.

Windows with a period of at most t / 3 are left out of the set. They lie in runs that lower scales have
found already. A run whose period block lies in such a region needs two regions of one period that touch;
their words then agree at one distance modulo that period, and those distances are proposed as well.

Words and windows are told apart by 64-bit hashes. All texts of a batch are worked on together, longest
first, so that the texts long enough for a scale stand in front.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.llm.common import WordHashes, body, mixed, values

#: A run has at least this many words.
MIN_LENGTH = 12
#: Words of texts that are worked on together; a longer text is a batch by itself.
BATCH_WORDS = 1 << 18
#: Periods up to here are compared directly.
DIRECT = 4
PRIMES = (2, 3, 5, 7, 11, 13, 17)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
PAIR = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """Hashes of all windows of 1, 2, 4, ... words of texts that a separator of its own ends."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, lengths: np.ndarray):
        """``words`` begins with a separator; text k has ``lengths[k]`` words, descending, and its
        separator stands at ``ends[k]``."""
        self.levels = [words]
        self.ends, self.lengths = ends, lengths
        while len(lengths) and lengths[0] >= 2 << (len(self.levels) - 1):
            below, t = self.levels[-1], 1 << (len(self.levels) - 1)
            stop = self.prefix(2 * t)
            up = np.empty(stop, np.uint64)
            n = max(stop - t, 0)
            up[:n] = mixed(below[:n] * PAIR + below[t:n + t])
            # A window over the end is equal to no other.
            up[n:] = mixed(np.arange(n, stop, dtype=np.uint64) + np.uint64(len(self.levels) << 48))
            self.levels.append(up)

    def prefix(self, words: int) -> int:
        """Where the texts of at least so many words end, with the last one's separator."""
        k = int(np.searchsorted(-self.lengths, -words, side="right"))
        return int(self.ends[k - 1]) + 1 if k else 0

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            h = self.levels[k]
            a, b = i + n, j + n
            inside = b < len(h)
            n += np.where(inside & (h[np.where(inside, a, 0)] == h[np.where(inside, b, 0)]), 1 << k, 0)
        return n

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            h = self.levels[k]
            a, b = i - n - (1 << k), j - n - (1 << k)
            inside = (a >= 0) & (b < len(h))
            n += np.where(inside & (h[np.where(inside, a, 0)] == h[np.where(inside, b, 0)]), 1 << k, 0)
        return n

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i on equal those from j on, both inside one text."""
        out = np.zeros(len(i), bool)
        level = np.frexp(n.astype(float))[1] - 1
        for k in np.unique(level):
            m, h = level == k, self.levels[k]
            a, b, rest = i[m], j[m], n[m] - (1 << int(k))
            out[m] = (h[a] == h[b]) & (h[a + rest] == h[b + rest])
        return out


def _primitive(win: Windows, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether q is the smallest period of runs that start at s. Proposed periods are at most 18 times the
    smallest one."""
    out = np.ones(len(s), bool)
    for r in PRIMES:
        m = np.flatnonzero(out & (q % r == 0))
        if len(m):
            out[m] = ~win.same(s[m], s[m] + q[m] // r, q[m])
    return out


def _unique(s, e, q):
    order = np.lexsort((e, s, q))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1]) | (q[1:] != q[:-1])
    return s[new], e[new], q[new]


def _extended(win: Windows, i: np.ndarray, q: np.ndarray):
    """The runs (start, end, period) around positions where the words agree with those q further on."""
    left, right = win.behind(i, i + q), win.ahead(i, i + q)
    enough = left + right >= q
    i, q, left, right = i[enough], q[enough], left[enough], right[enough]
    s, e, q = _unique(i - left, i + q + right, q)
    smallest = _primitive(win, s, q)
    return s[smallest], e[smallest], q[smallest]


def _direct(win: Windows, q: int):
    """All runs of one small period."""
    w = win.levels[0]
    agree = np.zeros(max(len(w) - q, 0) + 2, np.int8)
    agree[1:-1] = w[:-q] == w[q:]
    edge = np.flatnonzero(np.diff(agree))
    a, b = edge[::2], edge[1::2]
    long = b - a >= q
    s, period = a[long], np.full(long.sum(), q, np.int64)
    smallest = _primitive(win, s, period)
    return s[smallest], b[long][smallest] + q, period[smallest]


def _synchronising(win: Windows, k: int, stop: int, found) -> np.ndarray:
    """Positions of the synchronising set of scale 2**k among the first ``stop`` words."""
    t = 1 << k
    key = win.levels[k][:stop].copy()
    s, e, p = found
    periodic = (p * 3 <= t) & (e - s >= t) & (e <= stop)
    if periodic.any():
        covers = np.zeros(stop + 1, np.int64)
        np.add.at(covers, s[periodic], 1)
        np.add.at(covers, e[periodic] - t + 1, -1)
        key[np.cumsum(covers)[:-1] > 0] = NONE
    least = key
    for j in range(k):
        least = np.minimum(least[:-(1 << j)], least[1 << j:])
    least = np.minimum(least[:-1], least[1:])  # over t + 1 windows
    n = len(least)
    return np.flatnonzero((least != NONE) & ((least == key[:n]) | (least == key[t:t + n])))


def _proposed(win: Windows, k: int, found):
    """(position, distance) of pairs with equal contexts, for the periods of scale 2**k."""
    t = 1 << k
    least, most = 3 * t - 1, 6 * t - 2
    at = _synchronising(win, k, win.prefix(2 * least), found)
    context = win.levels[k + 1][at]
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    i, q = [], []
    # Equal contexts are over t / 3 words apart, so few steps reach all that are near.
    for step in range(1, len(at)):
        far = at[step:] - at[:-step]
        near = (context[step:] == context[:-step]) & (far <= most)
        if not near.any():
            break
        near &= far >= least
        i.append(at[:-step][near])
        q.append(far[near])
    return (np.concatenate(i), np.concatenate(q)) if i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _between_regions(win: Windows, found):
    """(position, distance) where highly periodic regions of one period touch."""
    s, e, p = found
    long = (e - s >= 9 * p - 1) & (p > 1)
    s, e, p = s[long], e[long], p[long]
    order = np.lexsort((s, p))
    s, e, p = s[order], e[order], p[order]
    i, q = [], []
    for k in np.flatnonzero((p[1:] == p[:-1]) & (s[1:] <= e[:-1])):
        a, b, a2, b2, period = s[k], e[k], s[k + 1], e[k + 1], p[k]
        places = np.arange(a, a + period)
        fits = places[win.same(places, np.full(period, a2), np.full(period, period))]
        if not len(fits):
            continue
        most = min(b - a, b2 - a2, (b2 - a) // 2)
        first = (a2 - fits[0]) % period
        distance = np.arange(first + period * (-(-(9 * period - 1 - first) // period)), most + 1, period)
        i.append(np.maximum(a, a2 - distance))
        q.append(distance)
    return (np.concatenate(i), np.concatenate(q)) if i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def runs_of(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text, given as hashes of its words: starts, lengths and periods of its runs of at least
    MIN_LENGTH words, by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    ends = np.cumsum(lengths[order] + 1)
    words = np.empty(int(ends[-1]) + 1 if len(ends) else 1, np.uint64)
    marks = np.concatenate([[0], ends])
    words[marks] = mixed(np.arange(len(marks), dtype=np.uint64) + np.uint64(1 << 62))
    for k, end in zip(order, ends):
        words[end - lengths[k]:end] = texts[k]
    win = Windows(words, ends, lengths[order])

    parts = [_direct(win, q) for q in range(1, DIRECT + 1)]
    found = tuple(np.concatenate(x) for x in zip(*parts))
    k = 1
    while len(lengths) and 2 * (3 * (1 << k) - 1) <= lengths[order[0]]:
        more = _extended(win, *_proposed(win, k, found))
        found = tuple(np.concatenate(x) for x in zip(found, more))
        k += 1
    more = _extended(win, *_between_regions(win, found))
    s, e, q = _unique(*(np.concatenate(x) for x in zip(found, more)))

    long = e - s >= MIN_LENGTH
    s, e, q = s[long], e[long], q[long]
    text = np.searchsorted(ends, s, side="right")  # in the order of the lengths
    by = np.lexsort((q, s, text))
    s, e, q, text = s[by], e[by], q[by], text[by]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    out = [None] * len(texts)
    for k, at in enumerate(order):
        mine = slice(cuts[k], cuts[k + 1])
        out[at] = (s[mine] - (ends[k] - lengths[at]), (e - s)[mine], q[mine])
    return out


def kept_words(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """The words outside every run's part after its first period."""
    drop = np.zeros(n + 1, np.int64)
    np.add.at(drop, starts + periods, 1)
    np.add.at(drop, starts + lengths, -1)
    return np.flatnonzero(np.cumsum(drop)[:n] == 0)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period), collapsed: the text's words without the
    repeats of its runs, joined by one space.

    Words are what stands between ASCII white space, taken as they are. ``rewrite`` may give, for an id
    and a number of words, the places the words are to be taken from instead. A null or empty text has no
    words and no runs. Every row gives one row, also where ids are null or repeat. An empty table gives an empty
    result; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), body(F.col(text_col)).alias("body"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch["doc_id"], values(batch["body"])):
                words = text.split()
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                places = rewrite(doc.as_py(), len(words)) if rewrite else None
                if places is not None:
                    words, h = [words[p] for p in places.tolist()], h[places]
                held.append((doc, words, h))
                size += len(words)
                if size >= BATCH_WORDS:
                    yield emit(held, batch.schema.field("doc_id").type)
                    held, size = [], 0
            if held:
                yield emit(held, batch.schema.field("doc_id").type)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {id_type}, n_words bigint, runs {RUNS}, collapsed string")


def emit(held, id_type) -> pa.RecordBatch:
    """The result rows of some texts: (id, words, hashes of the words)."""
    runs = runs_of([h for _, _, h in held])
    texts = []
    for (_, words, _), found in zip(held, runs):
        if len(found[0]):
            words = [words[k] for k in kept_words(len(words), *found).tolist()]
        texts.append(b" ".join(words))
    offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in runs])])
    starts, lengths, periods = (np.concatenate(x) for x in zip(*runs))
    return pa.RecordBatch.from_arrays([
        pa.array([d.as_py() for d, _, _ in held], id_type),
        pa.array([len(w) for _, w, _ in held], pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(a, pa.int64()) for a in (starts, lengths, periods)], ["start", "length", "period"])),
        pa.array(texts, pa.binary()).cast(pa.string()),
    ], ["doc_id", "n_words", "runs", "collapsed"])
