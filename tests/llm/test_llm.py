"""The training-data operators against brute force on small tables with nulls, ties and repeats."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import near_stage
from packlens.llm import queries
from packlens.llm.language_model import discounts, score, score_held_out, train
from packlens.llm.line_dedup import line_dedup
from packlens.llm.mixing import mix, mixed_documents
from packlens.llm.nearest import hilbert_keys, nearest
from packlens.llm.packing import pack, plan_packs
from packlens.llm.quality_rules import _repeated_plain, keep_good, quality_rules, repeated_words
from packlens.llm.simhash import components, drop_near_duplicates, fingerprint, links, simhash_groups
from packlens.llm.substring_dedup import pieces, sentences, substring_dedup
from packlens.llm.token_output import Block, EliasFano, encode_block, tokens_round_trip
from packlens.llm.tokens import Encoder, encoder, tokenizer_path
from packlens.llm.toxicity import BUCKETS, STEMS, TOP, Model, State, WordIds, _counts, _round, _with_texts, fit, score_toxicity

#: Names that operators use themselves, inside or as results, stand among the user's columns.
EXTRA = ["__x", "h", "__id", "__th", "__row", "__drop", "__size", "size", "n_lines", "n_removed", "kept", "node", "a.b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{n}` string" for n in EXTRA)


def table(spark, texts, ids=None, sources=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", (sources or ["a"] * len(texts))[k], len(t or ""), *EXTRA) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 6))) + rng.choice(["", "", ".", "\n", "."]) for _ in range(n))


ODD = [None, "", " \n ", "Ünï ﷺ　word", "x", "a b c\n" * 30]


def test_empty_table(spark):
    none = table(spark, ["x"]).limit(0)
    assert not quality_rules(none).count() and not line_dedup(none).count() and not simhash_groups(none).count()
    assert not mix(none).count() and not substring_dedup(none).count() and not score_held_out(none).count()
    assert not pack(none, tokenizer_path("byte_bpe_50k.json")).count() and not tokens_round_trip(none, tokenizer_path("word_bpe_49k.json")).count()
    assert not nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count()


def test_repeated_words():
    rng = random.Random(1)
    for _ in range(200):
        words = [bytes([rng.choice(b"abc")]) for _ in range(rng.randint(0, 60))]
        assert repeated_words(words) == _repeated_plain(words, 8)


def test_quality(spark):
    common = "this very line stands in all of them\n"
    texts = [common + prose(i, 60) for i in range(40)] + [common * 5 + f"word{i}" for i in range(40)] + ODD + [prose(99, 60)] * 50
    got = {r.doc_id: r for r in quality_rules(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert all(got[i].kept for i in range(40)) and all(got[i].depleted for i in range(40, 80))
    assert not any(got[80 + i].kept for i in range(len(ODD)))
    assert all(got[86 + i].kept for i in range(50)), "copies of one text count once"
    assert got[83].word_chars == len("Ünï ﷺ　word") - 1
    good = {r.doc_id: r.text for r in keep_good(table(spark, texts)).collect()}
    assert keep_good(table(spark, texts)).columns == table(spark, texts).columns and set(good) == {i for i in got if got[i].kept}
    assert all(good[i] == texts[i].removeprefix(common) and got[i].removed == [0] for i in range(40)), "the line that stands everywhere goes"
    assert all(good[86 + i] == texts[86 + i] for i in range(50)) and all(got[i].removed == [0, 1, 2, 3, 4] for i in range(40, 80))


def own_line(seed, n):
    letters = "".join(chr(97 + int(c)) for c in str(seed))
    return " ".join(f"own{letters}x{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))


def test_quality_with_several_shared_lines(spark):
    shared = [f"shared line {chr(97 + i)} stands on every page of this host" for i in range(8)]
    pages = ["\n".join([*shared, own_line(i, 9), own_line(i + 1000, 9)]) for i in range(300)]
    common = "one line that many different pages hold"
    several = [f"{common}\n{own_line(i, 40)}" for i in range(5000, 5040)]
    clean = f"{own_line(7000, 30)}\n{own_line(7001, 30)}"
    texts = pages + several + [several[0]] * 300 + [clean] * 300
    rows = {r.doc_id: r for r in quality_rules(table(spark, texts)).collect()}
    assert all(rows[i].n_boilerplate_words == 8 * len(shared[0].split()) and rows[i].depleted for i in range(300))
    assert all(rows[i].n_boilerplate_words == len(common.split()) and rows[i].kept for i in range(300, 640))
    assert all(rows[i].n_boilerplate_words == 0 and rows[i].kept for i in range(640, 940))


def test_line_dedup_with_several_recurring_lines(spark):
    frame = ["home products about contact imprint", "all rights are reserved by nobody here", "follow us on every network there is"]
    texts = ["\n".join([frame[0], frame[1], own_line(i, 12), frame[2]]) for i in range(60)]
    texts += [texts[0]] * 300 + [f"{own_line(900, 12)}\n{own_line(901, 15)}"] * 300
    rows = {r.doc_id: r for r in line_dedup(table(spark, texts)).collect()}
    assert all(rows[i].text == own_line(i if i < 60 else 0, 12) and rows[i].n_dropped == 3 for i in range(360))
    assert all(rows[i].text == texts[i] for i in range(360, 660))


def test_line_dedup(spark):
    texts = [prose(i, 30).replace("\n", " ") + f"\nfooter of page {i} and more words\nunique tail {prose(i + 500, 5)}" for i in range(30)] + ODD + [prose(77, 50)] * 20
    got = {r.doc_id: r for r in line_dedup(table(spark, texts)).collect()}
    assert all("footer of page" not in got[i].text and "unique tail" in got[i].text for i in range(30))
    assert got[30].text is None and got[31].text == "" and all(got[36 + i].text == texts[36] for i in range(20))


def groups(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in list(root)}


def test_links_of_a_dense_group_grow_with_its_members(spark):
    rng = random.Random(12)
    made = {}
    for n in (500, 2000):
        fps = set()
        while len(fps) < n:
            f = 0x5DEECE66D1234567
            for b in rng.sample(range(16), rng.randint(0, 5)):
                f ^= 1 << b
            fps.add(f - (1 << 64) if f >> 63 else f)
        near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
        got = [tuple(r) for r in links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
        assert groups(got) == groups(near)
        made[n] = len(got), len(near)
    assert made[2000][0] < 8 * made[500][0] and 8 * made[500][1] < made[2000][1], made


def test_line_dedup_equals_plain_count(spark):
    rng = random.Random(21)
    words = ["red", "sky", "page 7"]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(rng.randint(0, 12))) for _ in range(150)] + ODD
    texts += texts[:20] + [texts[3].upper()]
    contents, leaves = {}, {}
    for t in {t or "" for t in texts}:
        own = [" ".join(x.split()) for x in (t or "").lower().split("\n")]
        leaves[t] = [plain_templates(x) for x in own]
        for x in {leaf for some in leaves[t] for leaf in some}:
            contents.setdefault(x, set()).add("\n".join(x for x in own if x))
    often = {x for x, some in contents.items() if len(some) > 8}
    assert often
    rows = {r.doc_id: r for r in line_dedup(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        kept = [x for x, some in zip((t or "").split("\n"), leaves[t or ""]) if not often & set(some)]
        assert (rows[i].text or "") == "\n".join(kept) and rows[i].h == "h" and rows[i].n_lines == len((t or "").split("\n")) * (t is not None)


def plain_templates(line):
    tokens = ["<*>" if any(c in "0123456789" for c in w) else w for w in line.split()]
    if len(tokens) < 4:
        return set()
    head, rest = tuple(tokens[:2]), tokens[2:]
    if len(rest) < 3:
        return {(len(tokens), head, tuple(rest))}
    ends = [len(rest) * i // 3 for i in range(4)]
    parts = [tuple(rest[a:b]) for a, b in zip(ends, ends[1:])]
    return {(len(tokens), head, i, tuple("*" if j == i else x for j, x in enumerate(parts))) for i in range(3)}


def test_quality_equals_plain_rules(spark):
    rng = random.Random(22)
    words = ["a", "bb", "#c", "d|d", "Émile", "zz9", "<e>"]
    shared = [" ".join(rng.choices(words, k=6)) for _ in range(5)]
    texts, sources = list(ODD), [None] * len(ODD)
    for i in range(200):
        lines = [prose(i, rng.randint(5, 30)).replace("\n", " ")] + rng.sample(shared, rng.randint(0, 5)) + [" ".join(rng.choices(words, k=rng.randint(0, 9)))]
        texts.append("\n".join(rng.sample(lines, len(lines))))
        sources.append(rng.choice(["x", "x", "y", None]))
    texts, sources = texts + texts[:30], sources + sources[:30]
    docs = {}
    for t, s in zip(texts, sources):
        for x in {y for y in (" ".join(x.split()) for x in (t or "").lower().split("\n")) if y}:
            docs.setdefault((s, x), set()).add("\n".join(y for y in (" ".join(x.split()) for x in (t or "").lower().split("\n")) if y))
    rows = {r.doc_id: r for r in quality_rules(table(spark, texts, sources=sources)).collect()}
    for i, (t, s) in enumerate(zip(texts, sources)):
        t = t or ""
        own = [w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in t).split(" ") if w]
        full = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        lost = sum(len(x.split()) for x in t.lower().split("\n") if x.split() and len(docs[s, " ".join(x.split())]) > 20)
        repeats = _repeated_plain([w.encode() for w in own], 8)
        failed = len(own) < 20 or 100 * repeats > 30 * len(own)
        depleted = 100 * (len(own) - lost) < 30 * len(own)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(own), sum(map(len, own)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words, r.n_boilerplate_words) == (len(full) - len(set(full)), repeats, lost)
        assert (r.base_failed, r.depleted, r.kept) == (failed, depleted, not failed and not depleted)
    assert any(r.n_boilerplate_words for r in rows.values()) and any(r.depleted for r in rows.values())


def test_fingerprint_and_components(spark):
    def plain(text):
        words = text.encode().lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    for t in [prose(1, 600), prose(2, 3), "A", "", *[prose(i, 40) for i in range(20)]]:
        assert fingerprint(t, 4) == plain(t)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    near = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    for dense in (64, 4, 1):  # pairs only; both ways; centres only
        got = {tuple(r) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long"), dense=dense).collect()}
        assert got == near if dense == 64 else got <= near
        assert groups(got) == groups(near)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "src long, dst long")
    assert {r.node: r.root for r in components(chain).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_near_duplicates(spark):
    base = prose(3, 400)
    texts = [base, base, prose(4, 300), base, None, "", prose(5, 2)]
    docs = table(spark, texts, ids=[5, 6, 7, 6, 8, 9, 10])
    got = [(r.doc_id, r.component_id) for r in simhash_groups(docs).collect()]
    assert sorted(got) == sorted([(5, 5), (6, 5), (7, 7), (6, 5), (8, 8), (9, 8), (10, 10)])
    assert sorted(r.doc_id for r in drop_near_duplicates(docs).collect()) == [5, 7, 8, 10]


def test_near_stage_catches_jaccard_of_four_fifths(spark):
    def grams(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    rng, texts = random.Random(6), []
    for group in range(12):
        base = [f"w{group}x{i}" for i in range(200)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 9):  # the last two fall below 0.8
            words = list(base)
            for at in rng.sample(range(5, 195), edits):
                words[at] = f"edit{len(texts)}x{at}"
            texts.append(" ".join(words))
    base = [f"hot{i}" for i in range(200)]
    texts += [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(60)] + [None, "", "two words", "Two  words"]
    sets = [grams(t or "") for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    kept = near_stage(spark, table(spark, texts), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({top(i) for i in range(len(texts))})


def test_mixing(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.randint(0, 50)) for _ in range(300)] + [None]
    sources = [rng.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    docs = table(spark, texts, sources=sources)
    rows = mix(docs).collect()
    size = Counter()
    for s, t in zip(sources, texts):
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:
        rest = left - sum(2 * size[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[o] for o in order if o not in full) for s in order if s not in full}
        over = {s for s, x in share.items() if x > 2 * size[s]}
        if not over:
            target = share | {s: 2.0 * size[s] for s in full}
            break
        full |= over
    taken = Counter()
    for r in rows:
        taken[r.source] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and math.isclose(r["target"], target[r.source]) and r["__size"] == "__size" and "text" not in r
    assert all(abs(taken[s] - target[s]) <= 25 for s in order), "half of the longest document"
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter(r.doc_id for r in got) == {r.doc_id: r["times"] for r in rows if r["times"]}
    # positions: the demand of all sources at the time at which the own source's demand reaches the document
    slope = {s: (0.5, -0.5, 0.0)[i % 3] for i, s in enumerate(order)}
    demand = lambda s, u: target[s] * (u + slope[s] * (u * u - u))
    streams = {s: sorted((r for r in rows if r.source == s), key=lambda r: r["position"] if r["position"] is not None else 1e18) for s in order}
    for s, some in streams.items():
        before = 0
        for r in (r for r in some if r["times"]):
            lo, hi = 0.0, 2.0
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if demand(s, mid) < before else (lo, mid)
            assert math.isclose(r["position"], sum(demand(o, lo) for o in order), rel_tol=1e-6, abs_tol=1e-3)
            before += r["size"]
    places = {r.doc_id: r["position"] for r in rows}
    first = [places[r.doc_id] for k, r in enumerate(got) if r.doc_id not in {x.doc_id for x in got[:k]}]
    assert first == sorted(first)


def test_mixing_ends_with_the_document_that_fits(spark):
    rng = random.Random(5)
    sources = ["a"] * 60 + ["b"] * 60 + [None] * 60 + [""] * 3
    texts = [" ".join(["w"] * rng.randint(1, 400)) for _ in sources[:-3]] + ["w " * 900, "w", "w " * 30]
    rows = mix(table(spark, texts, sources=sources), max_epochs=1.5, budget=0.8).collect()
    assert len(rows) == len(texts)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        target, taken = own[0]["target"], sum(r["taken"] for r in own)
        missing = abs(target - taken)
        spare = [r["size"] for r in own if r["times"] < 2 and target > r["source_size"] or r["times"] == 0]
        assert all(abs(target - taken - n) >= missing for n in spare), "no document more brings the source nearer"
        assert all(r["times"] <= 2 for r in own)
        # of the documents that are taken once, the last one starts where all others have been read
        last = max((r for r in own if r["times"]), key=lambda r: r["position"])
        assert s == "" or missing <= 200 and last["position"] > 0, "half of the longest document"
    got = Counter(r.doc_id for r in mixed_documents(table(spark, texts, sources=sources), max_epochs=1.5, budget=0.8).collect())
    assert got == {r["doc_id"]: r["times"] for r in rows if r["times"]}


def test_mixing_takes_a_source_up_to_max_epochs(spark):
    docs = table(spark, [" ".join(["w"] * 10) for _ in range(40)] + [" ".join(["w"] * 40) for _ in range(100)], sources=["a"] * 40 + ["b"] * 100)
    rows = mix(docs, max_epochs=4, budget=1.0).collect()
    taken = {s: sum(r["taken"] for r in rows if r.source == s) for s in "ab"}
    assert taken == {"a": 1600, "b": 2800} and {r["times"] for r in rows if r.source == "a"} == {4}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_whole_texts(name):
    code, rng = Encoder(tokenizer_path(name), memo_entries=50), random.Random(3)
    parts = ["a", "bc", " ", "  ", "\n", ".", ",", "\t", "É", "é", "Σ", "́", "　", "'s", "7", "!", "<|endoftext|>", "中", "\r", "İ"]
    texts = ["".join(rng.choices(parts, k=40)) for _ in range(1500)]
    for i in range(0, 1500, 100):
        for t, got in zip(texts[i : i + 100], code.encode(texts[i : i + 100])):
            assert np.frombuffer(got, "<u4").tolist() == code.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_in_one_call(name):
    """Letters of many scripts and cases, joined, keep the ids that each word has alone."""
    code, rng = Encoder(tokenizer_path(name)), random.Random(5)
    letters = [c for c in map(chr, [*range(65, 0x250), *range(0x370, 0x5D0), *range(0x905, 0x93A), *range(0x1100, 0x1200), *range(0x4E00, 0x4E40), 0x130, 0x120]) if c.isalpha()]
    words = list({" " + "".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(3000)})
    got = dict(code._pieces(words))
    assert all(np.frombuffer(got[w], "<u4").tolist() == code.tokenizer.encode(w, add_special_tokens=False).ids for w in words)
    for some in ([" ab", " s", " t", " ll"], [" x"]):
        assert code._words(some) == [np.array(code.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in some]


def test_plan_packs():
    rng = random.Random(4)
    for _ in range(50):
        width = rng.choice([8, 64, 2048])
        hist = {rng.randint(1, width - 1): rng.randint(1, 500) for _ in range(rng.randint(1, 40))}
        lots = plan_packs(hist, width)
        items, packs = {}, {}
        for n, rank, k, start, part, first, offset in lots:
            for j in range(k):
                items.setdefault((n, rank + j), []).append((start, part))
                packs.setdefault(first + j, []).append((offset, part))
        assert {k: sum(1 for n, _ in items if n == k) for k in hist} == hist
        for (n, _), parts in items.items():
            at = 0
            for start, part in sorted(parts):
                assert start == at
                at += part
            assert at == n
        assert sorted(packs) == list(range(-(-sum(n * k for n, k in hist.items()) // width)))
        for parts in packs.values():
            at = 0
            for offset, part in sorted(parts):
                assert offset == at
                at += part
            assert at <= width


def test_packing_and_token_blocks(spark):
    texts = [prose(i, 20 + 37 * i) for i in range(40)] + ODD + [prose(3, 50)] * 10
    docs = table(spark, texts, ids=[*range(40), *range(100, 106), *[200] * 10])
    code = Encoder(tokenizer_path("byte_bpe_50k.json"))
    whole = {(i, x + b"\1\0\0\0") for i, x in zip([*range(40), *range(100, 106), *[200] * 10], code.encode([t or "" for t in texts]))}
    pieces = pack(docs, tokenizer_path("byte_bpe_50k.json"), width=256).collect()
    for i, ids in whole:
        own = sorted((p.start, p.length, bytes(p.ids)) for p in pieces if p.doc_id == i)
        if i != 200:
            assert b"".join(x for _, _, x in own) == ids
    assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)
    read = tokens_round_trip(docs, tokenizer_path("word_bpe_49k.json")).orderBy("start").collect()
    assert [r.doc_id for r in read] == sorted(r.doc_id for r in read) and len(read) == len(texts)
    at = 0
    plain = encoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    order = sorted(zip([*range(40), *range(100, 106), *[200] * 10], [t or "" for t in texts]))
    for r, (i, t) in zip(read, order):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += r.n_tokens


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (700, 3), (900, 2**40)):
        v = np.sort(rng.integers(0, top, n))
        e = EliasFano.from_bytes(EliasFano.of(v).to_bytes())
        assert e.all().tolist() == v.tolist() and [e.select(i) for i in range(n)] == v.tolist()
        assert [x for k in range(len(e.samples)) for x in e.between_samples(k).tolist()] == v.tolist()
    b = Block(encode_block([None, 3, 3, 9], [np.array(x, "<u4").tobytes() for x in ([1], [70000, 2], [], [4, 5, 6])]))
    assert b.doc_ids() == [None, 3, 3, 9] and [b.document(i).tolist() for i in range(4)] == [[1], [70000, 2], [], [4, 5, 6]]


def test_language_model(spark):
    texts = [prose(i % 9, 60) for i in range(40)] + [None, ""]
    rows = {r.doc_id: r for r in score_held_out(table(spark, texts), min_count=2).collect()}
    toks = {i: (t or "").encode().lower().split() + [None] for i, t in enumerate(texts)}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for i in train for p in zip([b"\0"] + toks[i], toks[i]))
    d = discounts([sum(x == k for x in pairs.values()) for k in (1, 2, 3, 4)])
    ways = Counter(w for _, w in pairs)
    u = discounts([sum(x == k for x in ways.values()) for k in (1, 2, 3, 4)])
    unknown = sum(u[min(x, 3) - 1] for x in ways.values()) / len(pairs) / (v + 1)
    p1 = lambda w: (ways[w] - u[min(ways[w], 3) - 1]) / len(pairs) + unknown if w in ways else unknown
    assert math.isclose(sum(map(p1, ways)) + unknown, 1)
    mass, context = Counter(), Counter(c)
    context[b"\0"] = len(train)
    for (a, _), k in pairs.items():
        mass[a] += k - d[min(k, 3) - 1] if k > 1 else 0
    for i, t in toks.items():
        s = 0.0
        for a, w in zip([b"\0"] + t, t):
            k = pairs[a, w]
            s += math.log10((k - d[min(k, 3) - 1] if k > 1 else 0) / context[a] + (1 - mass[a] / context[a]) * p1(w) if context[a] else p1(w))
        assert math.isclose(rows[i].score, s, rel_tol=1e-9) and rows[i].train_tokens == n and rows[i].held_out == (i not in train)
        assert math.isclose(rows[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))


def test_language_model_keeps_bigrams_seen_once(spark, monkeypatch):
    texts = [prose(i, 60) for i in range(60)]
    monkeypatch.setattr(queries, "table", lambda *_: table(spark, texts))
    rows = {r.doc_id: r for r in queries.op2_lm_scoring(spark, "").collect()}
    toks = {i: t.encode().lower().split() + [None] for i, t in enumerate(texts)}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in toks[i])
    pairs = Counter(p for i in train for p in zip([b"\0"] + toks[i], toks[i]))
    ways, seen = Counter(w for _, w in pairs), Counter(c)
    seen[b"\0"] = len(train)
    d, u = (discounts([sum(x == k for x in some.values()) for k in (1, 2, 3, 4)]) for some in (pairs, ways))
    unknown = sum(u[min(x, 3) - 1] for x in ways.values()) / len(pairs) / (len(c) + 1)
    p1 = lambda w: (ways[w] - u[min(ways[w], 3) - 1]) / len(pairs) + unknown if w in ways else unknown
    mass = Counter()
    for (a, _), k in pairs.items():
        mass[a] += k - d[min(k, 3) - 1]
    assert sum(k == 1 for k in pairs.values()) > len(pairs) / 2
    for i, t in toks.items():
        s = 0.0
        for a, w in zip([b"\0"] + t, t):
            k = pairs[a, w]
            s += math.log10((k - d[min(k, 3) - 1] if k else 0) / seen[a] + (1 - mass[a] / seen[a]) * p1(w) if seen[a] else p1(w))
        assert math.isclose(rows[i].score, s, rel_tol=1e-9)


def test_a_lost_part_of_the_model_is_an_error(spark):
    docs = table(spark, [prose(i, 60) for i in range(30)])
    model = train(docs)
    assert score(docs, model, ["doc_id"]).count() == 30
    for f in Path(model["folder"].removeprefix("file://")).glob("pairs-*"):
        f.rename(f.with_name("lost-" + f.name))
    with pytest.raises(Exception, match="FileNotFoundError"):
        score(docs, model | {"folder": model["folder"] + "/."}, ["doc_id"]).collect()


def test_convolution_equals_a_plain_one():
    rng, m = np.random.default_rng(5), Model.fresh(3)
    m.bias[:] = rng.normal(size=m.bias.shape) * 0.1
    docs = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 2, 3, 50, 70_000)]
    for ids, got in zip(docs, m.logits(docs)):
        parts = [(ids >> np.uint64(16 * k)).astype(np.int64) % BUCKETS for k in range(len(STEMS) + 1)]
        x = np.concatenate([m.table[parts[0]], sum(m.table[BUCKETS + p] for p in parts[1:])], axis=1)
        top = np.full((TOP, len(m.bias) // TOP), -1e9)
        for k, w in enumerate(m.filters):
            n = w.shape[2]
            if len(ids) >= len(w):
                each = sum(x[j : len(ids) - len(w) + 1 + j] @ w[j] for j in range(len(w)))
                best = np.sort(each, axis=0)[::-1][:TOP]
                top[: len(best), k * n : (k + 1) * n] = best
        want = np.maximum(top.ravel() + m.bias, 0) @ m.weights + m.offset
        assert math.isclose(got, want, rel_tol=1e-3, abs_tol=1e-4)


def test_toxic_words_that_stand_apart(spark):
    """One word of a rare kind says nothing, two of it in one text do; their endings vary."""
    rng = random.Random(21)

    def text(i):
        words = prose(i, 80).split()
        for _ in range(2 if i % 5 == 0 else i % 2):
            words.insert(rng.randrange(len(words)), "gromel" + rng.choice(["a", "os", "ent", "ix", "um", "ar", "ek", "il"]))
        return " ".join(words)

    docs = table(spark, [text(i) for i in range(900)])
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id long, toxic int")
    held = [r for r in score_toxicity(docs, labels).collect() if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)


def test_toxicity(spark):
    rng = random.Random(8)
    bad = lambda i: i % 4 == 0
    texts = [prose(i, 40) + (" you idiot clown" if bad(i) else " you kind friend") + " " + prose(i + 1000, 20) for i in range(900)] + ODD
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(bad(i)), 1) for i in range(900) if rng.random() < 0.9], "doc_id long, toxic int, quality int")
    got = score_toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(bad(r.doc_id)) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 < r.threshold < 1 and r.flagged == (r.score >= r.threshold) for r in got) and len({r.threshold for r in got}) == 1
    assert {r.predicted for r in score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert not score_toxicity(docs.limit(0), labels).count()
    long = table(spark, [prose(1, 60_000) + " you idiot clown " + prose(2, 60_000), None, ""], ids=[2000, 2001, None])
    assert {r.doc_id: r.predicted for r in score_toxicity(docs.unionByName(long), labels).collect() if r.doc_id in (None, 2000, 2001)} == {2000: 1, 2001: 0, None: 0}


def test_toxicity_learns_from_all_rows(spark):
    """Each kind of toxic word is in nine texts that may be learnt from and in five of two thirds of them at least, for the most part: too few if some are left out."""
    rng, kinds = random.Random(4), 800
    word = lambda: "".join(rng.choices("hijklmnopqrstuvwxyz", k=8))
    words = [word() for _ in range(kinds)]
    learnt = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 3 != 1][: 9 * kinds + 3000]
    held = [i for i in range(20_000, 30_000) if zlib.crc32(str(i).encode()) % 3 == 1][: 2 * kinds]
    toxic = {i: words[n % kinds] for n, i in enumerate(learnt[: 9 * kinds] + held[:kinds])}
    ids = learnt + held
    docs = table(spark, [f"{prose(i, 4)} {toxic.get(i) or word()} {prose(-i, 4)}" for i in ids], ids=ids)
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in learnt], "doc_id long, toxic int")
    got = [r for r in score_toxicity(docs, labels, shard_rows=len(learnt) // 3).collect() if r.held_out]
    assert sorted(r.doc_id for r in got) == held
    assert sum(r.predicted for r in got if r.doc_id in toxic) >= 0.95 * kinds
    assert sum(r.predicted for r in got if r.doc_id not in toxic) <= 0.05 * kinds


def test_toxicity_counts_every_text_and_means_of_shards(spark):
    docs = [(i, i * 7, "en", f"common {'left' if i % 2 else 'right'} {'rare' if i == 5 else ''}") for i in range(300)]
    some = spark.createDataFrame([*docs, docs[5], *[(i, i, "en", "common") for i in range(1000, 1400)]], "__id long, __th long, __l string, __text string")
    known = spark.createDataFrame([(i, i * 7, i % 2, i % 3) for i in range(300)], "__id long, __th long, __y int, part int")
    rows = _with_texts(some, known, 300, 3)
    assert sorted((r.toxic, r.part) for r in rows.collect()) == sorted((i % 2, i % 3) for i in range(300))
    assert len({r.shard for r in rows.collect()}) == rows.rdd.getNumPartitions() == 3
    counts, memo = _counts(rows), WordIds()
    at = lambda w: int(memo.of(w)[0] & np.uint64(0xFFFF))
    assert [c[at("common")] for c in counts] == [100, 100, 100] and sum(c[at("left")] for c in counts) == 150 and [c[at("rare")] for c in counts] == [0, 0, 1]
    states = [State.fresh(counts.sum(axis=0)) for _ in range(2)]
    before, wanted = states[1].model.table.copy(), []
    for shard in sorted({r.shard for r in rows.collect()}):
        own, state = sorted((r for r in rows.collect() if r.shard == shard and r.part != 1), key=lambda r: r.order), states[1].copy()
        zstd = pa.Codec("zstd")
        fit([np.frombuffer(zstd.decompress(r.ids, 8 * r.words, asbytes=True), np.uint64) for r in own], np.array([r.toxic for r in own], np.float32), state, seed=3 + shard)
        wanted.append((len(own), state))
    _round(rows, states, 1, 3)
    n = sum(w for w, _ in wanted)
    assert np.allclose(states[1].model.weights, sum(w * s.model.weights for w, s in wanted) / n, atol=1e-5)
    moved = [(s.model.table != before).any(axis=1) for _, s in wanted]
    assert moved[0][at("left")] and (states[1].model.table[~np.any(moved, axis=0)] == before[~np.any(moved, axis=0)]).all()
    all_moved = np.all(moved, axis=0)
    assert np.allclose(states[1].model.table[all_moved], sum(s.model.table for _, s in wanted)[all_moved] / 3, atol=1e-3)


def test_substring_dedup(spark):
    shared = "this passage goes on for a good while. it has several sentences in it, and each one of them counts. and then it ends here, after twenty and some more words."
    texts = [f"{prose(i, 20).replace(chr(10), ' ')}.\n{shared}\n{prose(i + 50, 20)}" for i in range(10)] + ODD
    got = {r.doc_id: r for r in substring_dedup(table(spark, texts)).collect()}
    assert got[0].text == texts[0] and all("several sentences" not in got[i].text for i in range(1, 10))
    assert got[10].text is None and got[14].text == "x" and got[0]["a.b"] == "a.b"
    assert substring_dedup(table(spark, texts)).columns.count("n_removed") == 1


def test_a_passage_without_full_stops_goes_from_any_context(spark):
    rng = random.Random(31)
    passage = " ".join("".join(rng.choices("klmnop", k=5)) for _ in range(60))

    def around(i):
        own = random.Random(i)
        return " ".join("".join(own.choices("abcdef", k=6)) for _ in range(17 + i))

    texts = [f"{around(i)} {passage} {around(i + 40)}" for i in range(30)] + [around(200), around(200)]
    rows = {r.doc_id: r for r in substring_dedup(table(spark, texts)).collect()}
    assert rows[0].text == texts[0]
    words = set(passage.split())
    for i in range(1, 30):
        assert sum(w in words for w in rows[i].text.split()) < 30 and all(w in rows[i].text.split() for w in around(i).split()[:8])


def test_substring_dedup_equals_plain_runs(spark):
    rng = random.Random(32)
    some = [" ".join(rng.choices(["oak", "elm", "fir", "ash"], k=rng.randint(2, 9))) + rng.choice([".", "?", "\n"]) for _ in range(25)]
    texts = [" ".join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(60)] + [" ".join(rng.choices(["Yew", "box"], k=400))] * 2 + ODD
    ids = list(range(len(texts)))
    docs = [(i, [(j, w) for j, w in sentences(t or "")]) for i, t in zip(ids, texts)]
    assert all("".join(pieces(t or "")) == (t or "") for t in texts)
    first, gone = {}, {i: set() for i in ids}
    for i, own in docs:
        for at in range(len(own)):
            n = 2
            while at + n <= len(own) and sum(len(w.split()) for _, w in own[at : at + n]) < 25:
                n += 1
            if at + n <= len(own):
                run = tuple(w for _, w in own[at : at + n])
                if run in first:
                    gone[i] |= {own[k][0] for k in range(at, at + n)}
                first.setdefault(run, (i, at))
    assert sum(map(len, gone.values())) > 50
    rows = {r.doc_id: r for r in substring_dedup(table(spark, texts, ids=ids)).collect()}
    for i, t in zip(ids, texts):
        assert rows[i].removed == sorted(gone[i]) and rows[i].n_removed == len(gone[i])
        assert (rows[i].text or "") == "".join(p for j, p in enumerate(pieces(t or "")) if j not in gone[i])


def test_hilbert_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_nearest_with_a_tight_cluster_and_a_long_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:1000] = x[0] + rng.normal(size=(1000, 24)) * 0.003
    x[5] *= 300
    got = nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    for part in (got[got.query_id < 1000], got[got.query_id >= 1000]):
        hits = 0
        for q, own in part.groupby("query_id"):
            scores = x @ x[q]
            scores[q] = -np.inf
            hits += len(set(np.argsort(-scores, kind="stable")[:20]) & set(own.vec_id))
        assert hits >= 0.9 * len(part)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, []), (740, [0.0] * 16), (760, [float("nan")] * 16), (None, x[0].tolist())]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    found = hits = 0
    for q in range(0, 600, 20):
        scores = x @ x[q]
        best = sorted((-scores[i], i) for i in range(600) if i != q)[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, [scores[i] for i in own.vec_id])
        found += 20
        hits += len({i for _, i in best} & set(own.vec_id))
    assert hits >= 0.9 * found and set(got.query_id) == set(range(0, 600, 20))
    assert got[got.query_id == 120].sort_values("rank").vec_id.tolist()[:3] == [100, 101, 102]


def plain_contents(text):
    return "\n".join(y for y in (" ".join(x.split()) for x in (text or "").lower().split("\n")) if y)


def plain_pipeline(rows):
    """The first three stages over (id, text, source), by counting and by comparing all pairs."""
    hosts = {}
    for _, t, s in rows:
        for x in {x for x in plain_contents(t).split("\n") if x}:
            hosts.setdefault((s, x), set()).add(plain_contents(t))
    kept = []
    for i, t, s in rows:
        words = (t or "").split()
        lost = sum(len(x.split()) for x in (t or "").lower().split("\n") if x.split() and len(hosts[s, " ".join(x.split())]) > 20)
        if len(words) >= 20 and 100 * _repeated_plain([w.encode() for w in words], 8) <= 30 * len(words) and 100 * (len(words) - lost) >= 30 * len(words):
            kept.append((i, "\n".join(x for x in t.split("\n") if not x.split() or len(hosts[s, " ".join(x.lower().split())]) <= 20), s))
    seen = {}
    for _, t, _ in kept:
        for x in {leaf for line in t.lower().split("\n") for leaf in plain_templates(" ".join(line.split()))}:
            seen.setdefault(x, set()).add(plain_contents(t))
    often = {x for x, some in seen.items() if len(some) > 8}
    kept = [(i, "\n".join(x for x in t.split("\n") if not often & plain_templates(" ".join(x.lower().split()))), s) for i, t, s in kept]
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} if t.split() else set()
    sets = [(i, grams(t)) for i, t, _ in kept]
    near = [(i, j) for i, a in sets for j, b in sets if i < j and (a == b or 10 * len(a & b) >= 8 * len(a | b))]
    root = groups(near)
    return [(i, t, s) for i, t, s in kept if root.get(i, i) == i]


def test_pipeline(spark, tmp_path):
    rng = random.Random(40)
    own = lambda i, n: " ".join("".join(random.Random(1000 * i + k).choices("abcdefghij", k=6)) for k in range(n))
    frame = ["home about contact imprint terms", "all rights are reserved by nobody"]
    texts = [f"{frame[0]}\n{own(i, rng.randint(15, 90))}\n{own(i + 500, 9)}\n{frame[1]}" for i in range(70)] + [own(600 + i, 120) for i in range(20)]
    texts += [texts[75], texts[76].replace(" ", "  "), " ".join([*texts[77].split()[:-1], "changed"]), " ".join(["same few words here"] * 20), *ODD]
    sources = [("a", "b", None)[i % 3] for i in range(len(texts))]
    rows = list(zip(range(len(texts)), texts, sources))
    table(spark, texts, sources=sources).drop(*EXTRA).write.parquet(str(tmp_path / "documents.parquet"))
    expected = plain_pipeline(rows)
    assert 60 < len(expected) < 92 and all(frame[0] not in t for _, t, _ in expected)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    code = encoder(tokenizer_path("byte_bpe_50k.json")).tokenizer
    ids = {i: np.array([*code.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t, _ in expected}
    size, taken, times = Counter(), Counter(), Counter()
    for i, t, s in expected:
        size[s] += len(t.split())
    for p in out:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(part.tobytes())
        times[p.doc_id, p.start, p.length] += 1
    covered = Counter()
    for (i, _, n), k in times.items():
        covered[i] += n * k
    for i, t, s in expected:
        assert covered[i] % len(ids[i]) == 0 and covered[i] <= 2 * len(ids[i])
        taken[s] += covered[i] // len(ids[i]) * len(t.split())
    total, weight = 1.5 * sum(size.values()), {"a": 3, "b": 1, None: 2}
    target = {s: total * w / 6 for s, w in weight.items()}
    if target["a"] > 2 * size["a"]:
        target = {"a": 2 * size["a"]} | {s: (total - 2 * size["a"]) * weight[s] / 3 for s in ("b", None)}
    assert all(abs(taken[s] - target[s]) <= 65 for s in target), (taken, target)
    places = {}
    for p in out:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for some in places.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at <= 2048


def test_stages_take_empty_tables_and_null_columns(spark):
    docs = table(spark, ["x"]).limit(0)
    nulls = spark.createDataFrame([(None,) * len(docs.columns)] * 2, docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
    quality, lines, near, mixing, packing = (stage for _, stage in corpus_pipeline.STAGES)
    assert quality(spark, nulls, "").count() == 0 and lines(spark, nulls, "").count() == 2 and near(spark, nulls, "").count() == 1
    assert mixing(spark, nulls, "").count() == 0 and [r.doc_tokens for r in packing(spark, nulls, "").collect()] == [1, 1]


def test_very_long_texts(spark):
    long = prose(50, 200_000)
    docs = table(spark, [long, long + " end", None, ""])
    assert line_dedup(docs).count() == substring_dedup(docs).count() == mix(docs).count() == 4
    assert {r.doc_id: r.component_id for r in simhash_groups(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert [r.n_removed > 0 for r in substring_dedup(docs).orderBy("doc_id").collect()][:2] == [False, True]
