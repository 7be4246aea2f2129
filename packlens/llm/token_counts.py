"""Token counts of whole texts by a byte-pair vocabulary file of the sentencepiece kind, merged in arrays.

A text is cut where no piece of the vocabulary holds the two characters side by side: no merge can
cross such a place, so the cuts lose nothing. The distinct pre-tokens of a batch are one ragged array of
symbols. In each round every sequence applies its own lowest-ranked pair, at all places at once, from
the left; sequences without a pair left are done and their symbols are counted. A symbol that is no piece counts its bytes,
as the library falls back to them.

Applying a rank at all places at once equals the library's merge by merge as long as a sequence's lowest
rank never falls from round to round. Where it does, the sequence is merged one pair at a time.
Pieces that share one score, below all others (runs of blanks), are merged last, from the left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import quoted, text_or_empty
from packlens.llm.lines import sliced, texts

BLANK = "▁"
NEVER = np.iinfo(np.int32).max
#: The rank of pieces that share a score.
LAST = NEVER - 1
#: Characters that are held as arrays at a time.
HELD_CHARS = 1 << 21


class Pieces:
    """The merges of a vocabulary file: symbols, pairs with their ranks, and where texts can be cut."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        if own.normalize(" a  ﬁ ") != f"{BLANK}{BLANK}a{BLANK}{BLANK}ﬁ{BLANK}":
            raise ValueError("only vocabularies that leave characters as they are and lead texts by a blank are supported")
        plain = [i for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
        score = {own.id_to_piece(i): own.get_score(i) for i in plain}
        shared = Counter(s for p, s in score.items() if len(p) > 1)
        tied = {s for s, k in shared.items() if k > 1}
        order = sorted((s for s in shared if s not in tied), reverse=True)
        if len(tied) > 1 or tied and order and max(tied) > order[-1]:
            raise ValueError("pieces of equal score must come after all others")
        rank = {s: k for k, s in enumerate(order)} | dict.fromkeys(tied, LAST)
        multi = [p for p in score if len(p) > 1]
        symbols = [*score, *sorted({c for p in multi for c in p} - set(score))]
        number = {p: k for k, p in enumerate(symbols)}
        #: What a symbol counts if it survives.
        self.weight = np.array([1 if p in score else len(p.encode()) for p in symbols], np.int64)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p in symbols:
            if len(p) == 1:
                self.of_char[ord(p)] = number[p]
        pairs = {(number[p[:k]], number[p[k:]]): (rank[score[p]], number[p]) for p in multi for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.pairs, self.n = pairs, len(symbols)
        keys = np.array([a * self.n + b for a, b in pairs], np.int64)
        by_key = np.argsort(keys)
        self.keys = keys[by_key]
        self.ranks, self.merged = (np.array([v[j] for v in pairs.values()], np.int32)[by_key] for j in (0, 1))
        # characters that stand in a longer piece get a class; a table of classes tells which can meet in a piece
        held = sorted({c for p in multi for c in p})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in held]] = np.arange(1, len(held) + 1)
        self.meet = np.zeros((len(held) + 1, len(held) + 1), bool)
        for p in multi:
            at = self.kind[[ord(c) for c in p]]
            self.meet[at[:-1], at[1:]] = True

    def joined(self, a: str, b: str) -> bool:
        """Whether some piece holds the two characters side by side."""
        return bool(self.meet[self.kind[ord(a)], self.kind[ord(b)]])

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the tables, -1 where it is none."""
        wanted = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), at, -1)

    def _slow(self, symbols: list[int], tied: bool = False) -> list[int]:
        """One pair at a time: the lowest rank, then the leftmost. tied: the pairs that share a score only."""
        if tied:  # with equal ranks the leftmost pair is next to the settled part
            out: list[int] = []
            for s in symbols:
                out.append(s)
                while len(out) > 1 and (found := self.pairs.get((out[-2], out[-1]))):
                    out[-2:] = [found[1]]
            return out
        while True:
            best = min(((v[0], i, v[1]) for i, pair in enumerate(zip(symbols, symbols[1:])) if (v := self.pairs.get(pair))), default=None)
            if best is None:
                return symbols
            symbols = [*symbols[: best[1]], best[2], *symbols[best[1] + 2 :]]

    def counts(self, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Surviving tokens of each sequence; `chars` are code points, `first` where sequences (none empty) begin, and the end."""
        count = np.zeros(len(first) - 1, np.int64)
        sym = self.of_char[chars]
        unknown = np.flatnonzero(sym < 0)
        if len(unknown):  # never part of a merge: counted at once
            code = chars[unknown]
            size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            np.add.at(count, np.searchsorted(first, unknown, "right") - 1, size)
        start, name = np.asarray(first[:-1]), np.arange(len(count))
        before, origin = np.full(len(count), -1, np.int32), sym
        own = self._pairs_of(sym, start)
        while len(start):
            rank = np.where(own >= 0, self.ranks[own], NEVER)
            least = np.minimum.reduceat(rank, start)
            size = np.diff(start, append=len(sym))
            fell = np.flatnonzero((least < before) | (least == LAST))
            done = least >= LAST
            done[fell] = True
            value = np.where(sym >= 0, self.weight[sym], 0)
            total = np.add.reduceat(value, start)
            for k in fell.tolist():
                symbols, tied = sym[start[k] : start[k] + size[k]].tolist(), least[k] == LAST
                if not tied:
                    symbols = origin[first[name[k]] : first[name[k] + 1]].tolist()
                total[k] = sum(int(self.weight[s]) for s in self._slow(symbols, tied) if s >= 0)
            count[name[done]] += total[done]
            # every other sequence merges its lowest pair wherever it stands
            hit = (rank == np.repeat(least, size)) & ~np.repeat(done, size)
            at = np.flatnonzero(hit)
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
            at = at[run % 2 == 0]  # pairs that overlap: from the left
            sym = sym.copy()
            sym[at] = self.merged[own[at]]
            keep = ~np.repeat(done, size)
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            keep[at + 1] = False
            sym, own, changed = sym[keep], own[keep], changed[keep]
            left = np.add.reduceat(keep, start, dtype=np.int64)[~done] if len(start) else start
            start, name, before = np.cumsum(left) - left, name[~done], least[~done]
            # a pair is new where one of its symbols is, and none crosses a sequence's end
            fresh = np.flatnonzero(changed)
            right = np.minimum(fresh + 1, max(len(sym) - 1, 0))
            own[fresh] = self._looked_up(sym[fresh], sym[right])
            if len(sym):
                own[np.concatenate([start[1:] - 1, [len(sym) - 1]])] = -1
        return count

    def _pairs_of(self, sym: np.ndarray, start: np.ndarray) -> np.ndarray:
        own = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            own[:-1] = self._looked_up(sym[:-1], sym[1:])
            own[start[1:] - 1] = -1
        return own

    def parts(self, text: str) -> Iterator[str]:
        """The text, led by a blank, in parts of about HELD_CHARS that no merge crosses."""
        text, at = BLANK + text.replace(" ", BLANK) if text else "", 0
        while at < len(text):
            end = min(at + HELD_CHARS, len(text))
            while at < end < len(text) and self.joined(text[end - 1], text[end]):
                end -= 1
            if end == at:
                end = min(at + HELD_CHARS, len(text))
                while end < len(text) and self.joined(text[end - 1], text[end]):
                    end += 1
            yield text[at:end]
            at = end

    def count(self, some: list[str]) -> list[int]:
        """The number of tokens of each text."""
        total, names, held, size = np.zeros(len(some), np.int64), [], [], 0
        for i, text in enumerate(some):
            for part in self.parts(text):
                names.append(i)
                held.append(part)
                size += len(part)
                if size >= HELD_CHARS:
                    np.add.at(total, names, self._counted(held))
                    names, held, size = [], [], 0
        if held:
            np.add.at(total, names, self._counted(held))
        return total.tolist()

    def _counted(self, some: list[str]) -> np.ndarray:
        raw = "".join(some).encode("utf-32-le", "surrogatepass")
        code, ends = np.frombuffer(raw, "<u4"), np.cumsum([0, *map(len, some)])
        kind, mark = self.kind[code], np.ones(len(code) + 1, bool)
        mark[1:-1] = ~self.meet[kind[:-1], kind[1:]]
        mark[ends] = True
        bounds = np.flatnonzero(mark)
        runs = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 4), pa.py_buffer(raw)]).dictionary_encode()
        distinct = runs.dictionary
        first = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1] // 4
        each = self.counts(np.frombuffer(distinct.buffers()[2], "<u4")[first[0] : first[-1]], first - first[0])
        per_run = np.concatenate([[0], np.cumsum(each[runs.indices.to_numpy()])])
        return np.diff(per_run[np.searchsorted(bounds, ends)])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One vocabulary a worker."""
    return Pieces(path)


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = pieces(path)
    for batch in sliced(batches):
        tokens = pa.array(own.count(texts(batch)), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("n_bytes"), tokens], names=["__id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document row: its id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens).

    `path` names a byte-pair vocabulary of the sentencepiece kind on every worker. Null and empty texts have 0
    bytes and 0 tokens; null ids stay; repeated rows are counted each; an empty table gives no rows. Very long
    texts are cut where no merge crosses and held a part at a time. Other columns, whatever their names, are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    text = text_or_empty(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__text"))
    counted = rows.mapInArrow(partial(_counts, path=path), f"__id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
