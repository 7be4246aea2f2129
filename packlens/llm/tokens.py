"""Token ids of whole texts by a public tokenizer file.

A text is cut where every pre-tokenizer of the supported files cuts anyway. The first cut is made on the
bytes of many texts at once: before a blank that leads a visible run, and around a line feed or tab
before one. Runs are numbered by their distinct values, and only those meet Python: a run that is not in
the bounded memo is cut once more, between a word and a closing `.` or `,`, and the library encodes what
is new, words of letters many in one call, since a call's cost is mostly fixed. The ids of all runs are
then gathered as one array.
A text with blanks or controls beyond ASCII goes to the library whole. The ids equal those of the
whole text, which the tests check.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa

_PIECE = re.compile(
    r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,]?(?:[ \n\t\r]|\Z))"  # a word before its closing mark or a blank
    r"| ?[^ \n\t\r]++"  # a visible run with the blank that leads it
    r"|[ \n\t\r]+(?=[ \n\t\r][^ \n\t\r])"  # blanks but for the last one before a run
    r"|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]"
)
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|<\\|")
_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
MEMO_ENTRIES = 600_000
JOINED = 256
HELD_CHARS = 1 << 22


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.most = memo_entries
        vocabulary = self.tokenizer.get_vocab()
        self.first = np.zeros(max(vocabulary.values()) + 2, bool)  # ids that only open a word with the blank before it
        self.last = self.first.copy()  # ids that only close a word
        for token, i in vocabulary.items():
            self.first[i], self.last[i] = token.startswith("Ġ"), token.endswith("</w>")
        self.led = not self.last.any()

    def _words(self, words: list[str]) -> list[bytes] | None:
        """Ids of words, each led by a blank, from one call; None where the marks of the words don't tell them apart."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self.first[ids])
        if len(starts) == len(words) and starts[0] == 0:
            bounds = [*starts.tolist(), len(ids)]
        else:
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(words) or ends[-1] != len(ids) - 1:
                return None
            bounds = [0, *(ends + 1).tolist()]
        flat = ids.tobytes()
        return [flat[4 * a : 4 * b] for a, b in pairwise(bounds)]

    def _groups(self, pieces: list[str]) -> Iterator[Iterable[tuple[str, bytes]]]:
        words, rest = [], []
        for p in pieces:  # where words are told by their blank, marks and digits may follow
            joins = p[0] == " " and (p[1:].isalpha() or self.led and p[1:2] > " ")
            (words if joins else rest).append(p)
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            got = self._words(some)
            if got is None:
                rest += some
            else:
                yield zip(some, got, strict=True)
        for i in range(0, len(rest), 20_000):
            some = rest[i : i + 20_000]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            yield zip(some, [np.asarray(x.ids, dtype="<u4").tobytes() for x in found], strict=True)

    def _pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        return chain.from_iterable(self._groups(pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for flat, counts in self.encoded(texts):
            ends, raw = np.cumsum(counts) * 4, flat.tobytes()
            out += [raw[a:b] for a, b in pairwise([0, *ends.tolist()])]
        return out

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of consecutive groups of the texts: all ids as one array, and their number in each text."""
        first = chars = 0
        for i, t in enumerate(texts):  # runs of a few texts at a time are held, whatever the batch
            chars += len(t)
            if chars >= HELD_CHARS or i + 1 == len(texts):
                yield self._encoded(texts[first : i + 1])
                first, chars = i + 1, 0

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        memo = self.memo
        if len(memo) > self.most:  # frequent runs came first; the tail goes
            memo = self.memo = dict(islice(memo.items(), self.most // 3))
        odd = {i: t for i, t in enumerate(texts) if _ODD.search(t)}
        starts, first_run, raw = _cut([b"" if i in odd else t.encode() for i, t in enumerate(texts)])
        runs = pa.BinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(raw)]).dictionary_encode()
        names = runs.dictionary.to_pylist()
        missing = [n.decode() for n in names if n not in memo]
        split = [_PIECE.findall(n) for n in missing]
        pieces = set().union(*split)
        found = dict(self._pieces([*pieces, *set(odd.values())]))
        made = {n.encode(): b"".join([found[p] for p in parts]) for n, parts in zip(missing, split, strict=True)}
        memo.update((n, ids) for n, ids in made.items() if len(n) < 64)  # long runs are not kept
        held = [memo[n] if n in memo else made[n] for n in names]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        table = np.frombuffer(b"".join(held), "<u4")
        code = runs.indices.to_numpy()
        size = sizes[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = _gathered(table, (np.cumsum(sizes) - sizes)[code], size, ends)
        bounds = ends[first_run]
        if odd:  # texts that are not cut
            parts = [np.frombuffer(found[t], "<u4") if (t := odd.get(i)) else flat[a:b] for i, (a, b) in enumerate(pairwise(bounds.tolist()))]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return flat, np.diff(bounds)


def _cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Where the runs of the joined texts start (and the end), the number of each text's first run (and the last's end), and the joined texts."""
    raw = b"".join(texts)
    data, edges = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)])
    blank, mark = _BLANK[data], np.zeros(len(raw) + 1, bool)
    leads = np.flatnonzero(blank[:-1] > blank[1:])
    mark[leads], mark[edges] = True, True
    mark[leads[data[leads] != 32] + 1] = True
    starts = np.flatnonzero(mark)
    return starts, np.searchsorted(starts, edges), raw


def _gathered(table: np.ndarray, first: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The slices of the table that begin at `first` and have these sizes, one after another."""
    return table[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker."""
    return Encoder(path)
