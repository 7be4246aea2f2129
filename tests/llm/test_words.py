"""Spelling variants, periodic runs and token counts against brute force and the tokenizer library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from packlens.llm import queries, token_counts
from packlens.llm.periodic_runs import KINDS, collapsed, longest, periodic_runs, runs_of
from packlens.llm.spelling import near_words, spelling_variants
from packlens.llm.token_counts import count_tokens, pieces
from packlens.llm.tokens import tokenizer_path

MODEL = "piece_bpe_32k.model"
EXTRA = ["__id", "__row", "__th", "word", "n", "runs", "n_words", "key", "a.b", "collapsed"]
SCHEMA = "doc_id long, text string" + "".join(f", `{n}` string" for n in EXTRA)
ODD = [None, "", " \n ", "Ünï ﷺ　word", "x", "a b c\n" * 30]


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


# spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(rows, noise):
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(upper)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= 5
    count = {w: n for w, n in count.items() if n >= 3}
    near = {w: [x for x in count if one_edit(w, x)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), count[form[w]] if form[w] else 0) for w, n in count.items())


def found_variants(docs, **more):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling_variants(docs, **more).collect())


def test_spelling_variants(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abé", k=rng.randint(4, 9))) for _ in range(60)] + ["Colour", "color", "COLOUR", "ÉTÉ-étéss", "×÷×÷×"]
    texts = [" ".join(rng.choices(base, [1 / (k + 1) for k in range(len(base))], k=120)) for _ in range(40)]
    texts += [*ODD, texts[0], texts[0], "hotword " * 3000 + "hotwort " * 1000 + "hotworts " * 400 + "hatworts " * 150]
    ids = [*range(len(texts) - 3), None, 7, 7]
    for noise in (None, 11):
        want = plain_variants(list(zip(ids, texts)), noise)
        assert found_variants(table(spark, texts, ids), noise=noise) == want
        assert len(want) > 40 and any(r[1] and r[2] != r[1] for r in want), "some chain is longer than one form"
    assert not spelling_variants(table(spark, [])).count() and not spelling_variants(table(spark, ODD)).where("n_near > 0").count()
    with pytest.raises(ValueError):
        spelling_variants(table(spark, []), min_letters=3)


def test_no_table_of_words_is_broadcast(spark, tmp_path):
    held = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    spark.createDataFrame([(w, 3) for w in held], "word string, n long").write.parquet(str(tmp_path / "words"))
    # a file of a few kB, which Spark would send to all tasks with the keys that are made of it
    words = spark.read.parquet(str(tmp_path / "words"))
    pairs = near_words(words)
    assert {(r.word, r.near) for r in pairs.collect()} == {(a, b) for a in held for b in held if one_edit(a, b)}
    for made in (pairs, spelling_variants(table(spark, [f"{w} " * 3 for w in held] + ["wortaa " * 20]))):
        told = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in told and "Broadcast" not in told


def test_every_edit_is_near(spark):
    """All words of five to seven letters around a few: no pair one edit apart is lost, none further apart is found."""
    words = set()
    for w in ("aabba", "ababab", "abcabca", "ééabcd"):
        words |= {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
        words |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in "abé" for k in (0, 1)}
    words = sorted(w for w in words if len(w) >= 4)
    got = {tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


# periodic runs

def plain_runs(words, least=6, times=4):
    out = {}
    for q in range(1, len(words) // times + 1):
        for s in range(len(words) - q):
            e = s
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(least, times * q) and (s == 0 or words[s - 1] != words[s - 1 + q]):
                out.setdefault((s, e + q - s), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def repeated(seed, n, letters, parts):
    rng = random.Random(seed)
    words = [rng.choice(letters) for _ in range(n)]
    a = rng.randrange(n)
    p = 1 + (n - a) // parts
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@pytest.mark.parametrize("least, times", [(6, 4), (2, 3), (9, 5)])
def test_runs_equal_plain_search(least, times):
    some = [repeated(i, 1 + i % 70, "abcde"[: 1 + i % 5], 3 + i % 6) for i in range(400)]
    some = [[c.encode() for c in w * (1 + (i % 7 == 0) * 4)] for i, w in enumerate(some)] + [[]]
    assert runs_of(some, least, times) == [plain_runs(w, least, times) for w in some]


def test_periodic_runs(spark):
    texts = [*ODD, " ".join(repeated(1, 300, "abcdefghij", 6)), "x y\n" * 20000 + "tail", " ".join(repeated(2, 9000, [f"w{i}" for i in range(900)], 5)), "a b c\n" * 30, "a " * 6 + "b " * 6]
    rows = {r.doc_id: r for r in periodic_runs(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        want = plain_runs(words) if len(words) < 1000 else runs_of([words])[0]
        assert [tuple(x) for x in rows[i].runs] == want and rows[i].n_runs == len(want) and rows[i].n_words == len(words)
        assert rows[i].collapsed == b" ".join(collapsed(words, want)).decode()
        best = longest(want)
        assert (rows[i].start, rows[i].length, rows[i].period) == (best or (None, None, None))
        assert rows[i]["a.b"] == "a.b" and rows[i]["key"] == "key"
    assert rows[7].collapsed == "x y tail" and rows[7].exponent_milli == 20_000_000 and rows[10].collapsed == "a b"
    assert (rows[10].start, rows[10].length, rows[10].exponent_milli) == (0, 6, 6000), "ties: the smallest start"
    assert not periodic_runs(table(spark, [])).count() and set(KINDS) <= set(periodic_runs(table(spark, [])).columns)


def test_digests_of_the_query(spark, tmp_path):
    texts = [" ".join(repeated(i, 200, "abcdefgh", 4)) for i in range(60)] + [None, "", "word " * 50]
    table(spark, texts).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect():
        words = (texts[r.doc_id] or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        told = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert r.runs_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs))).hexdigest()
        assert r.exponent_milli == (max(1000 * k // q for _, k, q in runs) if runs else None)


# token counts

def library():
    return SentencePieceProcessor(model_file=tokenizer_path(MODEL))


def hard_texts():
    own, rng = library(), random.Random(4)
    known = [own.id_to_piece(i) for i in range(259, own.get_piece_size())]
    texts = ["".join(rng.choice(known) for _ in range(rng.randint(1, 12))).replace("▁", " ") for _ in range(1500)]
    texts += ["".join(rng.choice(["a", "b", "the", " ", "in", "\n", "  ", "é", "日", " ", "😀", "▁"]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return texts + ["", " ", "<s> x </s>", "<unk><0x41>", "\0a", "é", "a" * 700, " " * 1000 + "x" + " " * 33, "=-" * 300, "\t" * 50]


def test_tokens_equal_the_library():
    texts = hard_texts()
    assert pieces(tokenizer_path(MODEL)).count(texts) == [len(x) for x in library().encode(texts)]


def test_parts_of_long_texts(monkeypatch):
    text = "".join(hard_texts())
    for held in (1, 50, 5000):
        monkeypatch.setattr(token_counts, "HELD_CHARS", held)
        assert pieces(tokenizer_path(MODEL)).count([text]) == [len(library().encode(text))]


def test_every_piece_is_reached_by_rising_ranks():
    """What makes merging all places at once right: merged one pair at a time, no piece needs a rank after a higher one."""
    own = pieces(tokenizer_path(MODEL))
    number = {k: v for k, v in own.pairs.items()}
    lib = library()
    for i in range(261, lib.get_piece_size(), 3):
        symbols, last = [int(own.of_char[ord(c)]) for c in lib.id_to_piece(i)], -1
        while len(symbols) > 1:
            best = min(((number[p][0], k, number[p][1]) for k, p in enumerate(zip(symbols, symbols[1:])) if p in number))
            assert best[0] >= last
            symbols[best[1] : best[1] + 2], last = [best[2]], best[0]


def test_ranks_that_fall_are_merged_one_by_one():
    own = pieces(tokenizer_path(MODEL))
    symbols = [int(own.of_char[ord(c)]) for c in "▁counting▁rabbits"]
    assert len(own._slow(symbols)) == len(library().encode("counting rabbits"))
    blank = int(own.of_char[ord("▁")])
    assert len(own._slow([blank] * 41, tied=True)) == len(library().encode(" " * 40))


def test_count_tokens(spark):
    texts = [*ODD, "long words of one text " * 20000, "b", "b"]
    rows = sorted(count_tokens(table(spark, texts, [*range(7), None, None]), tokenizer_path(MODEL)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.n_tokens for r in rows] == [len(x) for x in library().encode([t or "" for t in texts])]
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in rows] == [i == 6 for i in range(9)]
    assert not count_tokens(table(spark, []), tokenizer_path(MODEL)).count()
    assert count_tokens(table(spark, texts).select("doc_id", "text", F.lit(1).alias("n_tokens")), tokenizer_path(MODEL)).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
