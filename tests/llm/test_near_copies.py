"""Near copies in buckets of many members that are not all alike, against all pairs."""

import random

from pyspark.sql import functions as F

from packlens.llm import near_copies
from packlens.llm.near_copies import near_groups


def grams(text, n=5):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def plain_components(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def pages(seed, n, shared, own):
    """Pages of one site: `shared` words of its frame, then own ones, some pages edited copies of others."""
    rng, frame, made = random.Random(seed), [f"f{seed}x{i}" for i in range(shared)], []
    for k in range(n):
        if k % 7 == 3:
            words = made[rng.randrange(len(made))].split()
            for at in rng.sample(range(len(words)), rng.choice([1, 2, 4])):
                words[at] = f"e{seed}x{k}x{at}"
        else:
            words = frame + [f"u{seed}x{k}x{i}" for i in range(own + k % 9)]
        made.append(" ".join(words))
    return made


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.component_id for r in near_groups(docs).orderBy("doc_id").collect()]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Pages that share too little, just enough and nearly all, three sites, buckets over PAIRED members."""
    monkeypatch.setattr(near_copies, "PAIRED", 8)
    texts = pages(1, 90, 160, 40) + pages(2, 60, 150, 17) + pages(3, 40, 120, 8) + ["", "a b", "a b"]
    want = plain_components(texts)
    assert found(spark, texts) == want
    assert 100 < len(set(want)) < 180


def test_pages_of_a_site_are_not_paired(spark, monkeypatch):
    """Candidates of pages that share 160 of 200 words grow with the pages."""
    tested = {}
    plain = near_copies.verified

    def counted(pairs, sets, least_percent):
        tested[n] = tested.get(n, 0) + pairs.count()
        return plain(pairs, sets, least_percent)

    monkeypatch.setattr(near_copies, "verified", counted)
    for n in (100, 300):
        texts = [" ".join([f"t{i}" for i in range(160)] + [f"u{k}x{j}" for j in range(40)]) for k in range(n)]
        assert found(spark, texts) == list(range(n))
    assert all(tested[n] <= 2 * n for n in tested), tested


def test_components_meet_others_once(spark):
    """A shingle that a component of many nodes has is met by the other roots only."""
    own = {k: [1, 2, 3, 10 + k % 2] for k in range(50)} | {100: [1, 2, 3, 10], 101: [7, 8, 9, 6]}
    sets = spark.createDataFrame([(k, sorted(v)) for k, v in own.items()], "node long, own array<long>")
    members = spark.createDataFrame([(k, 0 if k < 50 else k, k >= 50, 4) for k in own], "node long, root long, late boolean, size long")
    members = members.select("*", *[F.lit(0).cast("long").alias(c) for c in near_copies.SKETCH])
    pairs = {tuple(r) for r in near_copies._by_rare_shingles(members, sets, 50).collect()}
    assert pairs == {(k, 100) for k in range(50)}
