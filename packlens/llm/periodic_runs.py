"""Runs of repeated words: stretches with a period of q words that hold it at least `times` times.

A run of smallest period q from s to e shows as a maximal pair: the suffixes at s and s + q share their first
e - s - q words, and the words before them differ. Conversely a maximal pair whose distance is small against
what it shares is a whole run already, so nothing is extended. The suffixes of many texts are sorted at
once by prefix doubling; only those that share their first words with another one go on. The LCP-interval tree over them is then built
bottom-up: an interval holds the positions of its suffixes in order, each with the class of the word on its left. When
a child joins, each position of the smaller list meets its two neighbours in the larger one. A pair counts where the
classes differ. Neighbours suffice: two occurrences closer than a third of what they share differ by their smallest
period if none lies between. Where one comes in later, the same stretch is found once more with a
smaller distance, and the smallest stays.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from packlens.llm.common import opened, quoted, sealed, text_or_empty
from packlens.llm.lines import columns, sliced, texts

#: Words whose suffixes are sorted at a time; a longer text is sorted alone.
HELD_WORDS = 1 << 17
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
KINDS = {"n_words": pa.int64(), "runs": pa.list_(RUN), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "collapsed": pa.string()}


def numbered(own: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts as numbers, equal only within a text, and the end of its text for each word."""
    ids: list[int] = []
    base = 0
    for words in own:
        seen: dict[bytes, int] = {}
        ids += [base + seen.setdefault(w, len(seen)) for w in words]
        base += len(seen)
    sizes = [len(w) for w in own]
    return np.array(ids, np.int64), np.repeat(np.cumsum(sizes, dtype=np.int64), sizes)


class Suffixes:
    """Suffixes in an order in which those that share their first words stand together."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray):
        n = len(ids)
        self.levels: list[np.ndarray] = []  # of each power of two the class of the words from each position on
        self.order = np.argsort(ids, kind="stable")
        slots, size = np.arange(n), 1
        key = ids[self.order]
        rank = np.full(n + 1, -1, np.int64)  # the first slot of a class is its number; no class stands past the end
        while True:
            opens = np.concatenate([[True], key[1:] != key[:-1]])
            firsts = np.flatnonzero(opens)
            rank[self.order[slots]] = slots[firsts][np.cumsum(opens) - 1]
            self.levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
            many = np.repeat(np.diff(firsts, append=len(slots)) > 1, np.diff(firsts, append=len(slots)))
            slots = slots[many]
            if size == 4:
                self.tied = slots
            if not len(slots):
                break
            at = self.order[slots]
            after = np.where(at + size < ends[at], rank[np.minimum(at + size, n)] + 1, 0)
            key = rank[at] * (n + 1) + after
            by = np.argsort(key)
            self.order[slots], key, size = at[by], key[by], 2 * size
        if size < 4:
            self.tied = slots

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and b have in common."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            same = self.levels[k][a] == self.levels[k][b]
            step = same.astype(np.int64) << k
            a, b, out = a + step, b + step, out + step
        return out


def maximal_pairs(order: np.ndarray, shared: np.ndarray, left: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """(start, end) to the smallest distance of the maximal pairs that are runs.

    `shared[i]` is what the suffixes order[i - 1] and order[i] have in common, less than 1 where a new group begins.
    """
    found: dict[tuple[int, int], int] = {}

    def pair(i: int, j: int, lcp: int) -> None:
        d = j - i
        if (times - 1) * d <= lcp and lcp + d >= least and left[i] != left[j]:
            at = (i, j + lcp)
            if d < found.get(at, d + 1):
                found[at] = d

    def joined(a: list[int], b: list[int], lcp: int) -> list[int]:
        small, big = (a, b) if len(a) < len(b) else (b, a)
        for p in small:
            k = bisect_left(big, p)
            if k:
                pair(big[k - 1], p, lcp)
            if k < len(big):
                pair(p, big[k], lcp)
        if len(small) > 8:
            big += small
            big.sort()  # two sorted stretches: merged
        else:
            for p in small:
                insort(big, p)
        return big

    stack: list[tuple[int, list[int]]] = []  # open intervals: what their suffixes share, and their positions so far
    last: list[int] = []
    for p, lcp in [*zip(order.tolist(), shared.tolist()), (0, 0)]:
        if last:
            while stack and stack[-1][0] > lcp:
                above, held = stack.pop()
                last = joined(held, last, above)
            if lcp > 0:
                if stack and stack[-1][0] == lcp:
                    last = joined(stack.pop()[1], last, lcp)
                stack.append((lcp, last))
        last = [p]
    return found


def runs_of(own: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """Of each text's words: (start, length, period) of every run, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in own]
    ids, ends = numbered(own)
    if not len(ids):
        return out
    # what a pair at distance d shares: (times - 1) * d words at least and least - d: the smallest of it over all d
    floor = min(max((times - 1) * d, least - d) for d in range(1, least + 1))
    suffixes = Suffixes(ids, ends)
    slots = suffixes.tied if floor >= 4 else np.arange(len(ids))
    if len(slots) < 2:
        return out
    order = suffixes.order[slots]
    shared = np.concatenate([[0], suffixes.shared(order[:-1], order[1:])])
    shared[shared < floor] = 0
    # groups that share `floor` words; one is left out if even its closest two are too far apart for what it shares at most
    group = np.cumsum(shared == 0) - 1
    by_place = np.lexsort((order, group))
    gap = np.diff(order[by_place], prepend=0)
    firsts = np.flatnonzero(shared == 0)
    gap[firsts] = len(ids) + 1
    near = (times - 1) * np.minimum.reduceat(gap, firsts) <= np.maximum.reduceat(shared, firsts)
    kept = near[group]
    begins = ends - np.diff(np.concatenate([[0], np.unique(ends)]))[np.searchsorted(np.unique(ends), ends)]
    left = np.where(np.arange(len(ids)) == begins, -1, np.concatenate([[-1], ids[:-1]]))
    found = maximal_pairs(order[kept], shared[kept], left, least, times)
    text_of = np.repeat(np.arange(len(own)), [len(w) for w in own])
    for (start, end), period in sorted((at, d) for at, d in found.items()):
        k, first = int(text_of[start]), int(begins[start])
        out[k].append((start - first, end - start, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; then the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _held(own: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    size = 0

    def part(words: list[bytes]) -> int:
        nonlocal size
        size += len(words)
        return size // HELD_WORDS

    for _, some in groupby(own, part):
        yield list(some)


def _digest(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 256):
        got: dict[str, list] = {n: [] for n in KINDS}
        own = [t.encode("utf-8", "surrogatepass").split() for t in texts(batch)]
        for some in _held(own):
            for words, runs in zip(some, runs_of(some, least, times), strict=True):
                best = longest(runs) or (None, None, None)
                facts = (len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2])
                for name, value in zip(KINDS, (*facts, b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")), strict=True):
                    got[name].append(value)
        yield columns(batch, KINDS, got)


def periodic_runs(docs: DataFrame, min_length: int = 6, min_times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with n_words, runs (start, length, period in words, by start, then period), n_runs, the run that repeats most (start, length, period,
    exponent_milli: 1000 times length / period, rounded down) and collapsed: the text without the words that a run holds after its first period.

    A run is a stretch of words with smallest period q, of at least max(min_length, min_times * q) words, that no neighbouring word extends. Words
    are what ASCII blanks leave. min_times is 3 at least. Ties of the run that repeats most go to the smallest start, then period. Null and
    empty texts have no words, no runs and an empty collapsed text; repeated rows get the same result each; an
    empty table gives no rows; columns of `docs` travel as one struct, and one named like a result is replaced. A text is held whole by one task,
    with about 8 bytes a word and power of two that its longest repeat reaches.
    """
    if min_times < 3:
        raise ValueError("neighbours tell runs of three repetitions or more")
    rows = sealed(docs, id_col, text_col, __text=text_or_empty(quoted(text_col)))
    made = "n_words long, runs array<struct<start: long, length: long, period: long>>, n_runs long, start long, length long, period long, exponent_milli long, collapsed string"
    schema = StructType([f for f in rows.schema if f.name != "__text"] + StructType.fromDDL(made).fields)
    found = rows.mapInArrow(partial(_digest, least=min_length, times=min_times), schema)
    return opened(found, docs.columns, **{n: found[n] for n in KINDS})
