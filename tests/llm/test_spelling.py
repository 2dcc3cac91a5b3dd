"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from rampart.llm import spelling
from rampart.llm.spelling import op13_spelling_variants, planted_words, spelling_groups


def brute_words(docs, min_length=7):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                out[run] += 1
    return out


def near(w, v):
    if len(w) > len(v):
        w, v = v, w
    if len(w) == len(v):
        return sum(a != b for a, b in zip(w, v)) == 1
    return len(v) == len(w) + 1 and any(v[:k] + v[k + 1:] == w for k in range(len(v)))


def brute(counts, min_count=2, ratio=10):
    n = {w: c for w, c in counts.items() if c >= min_count and w}
    by_part = {}
    for w in n:  # words that share all but one letter share a deletion of at most one letter
        for x in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            by_part.setdefault(x, set()).add(w)
    close = {w: set() for w in n}
    for ws in by_part.values():
        for a in ws:
            close[a] |= {b for b in ws if b != a and near(a, b)}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(close[w]), n[form[w]] if form[w] else -1) for w in n)


def rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def occurrences(spark, counts):
    return spark.createDataFrame([(w, c, "x") for w, c in counts.items()], "word string, c int, num string").selectExpr(
        "word", "num", "explode(sequence(1, greatest(c, 1))) as n").where("n > 0")


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcé"), (3, "aàâz")])
def test_against_brute_force(spark, seed, letters):
    """Dense vocabularies, where letters repeat and every word has many near ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(seed == 2).lower())
    rng = random.Random(seed)
    counts = Counter()
    for _ in range(400):
        counts["".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))] += rng.choice([1, 1, 2, 3, 30, 400])
    counts.update({"z" * 60: 2, "z" * 61: 30, "z" * 59 + "y": 3, "𐍈b": 5, "𐍈c": 50})
    got = rows(spelling_groups(occurrences(spark, counts)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(counts)


def test_chains(spark):
    counts = Counter({"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20000, "zzzzzzzz": 2, "zzzzzzz": 19})
    got = {r.word: r for r in spelling_groups(occurrences(spark, counts)).collect()}
    assert {w: got[w].root for w in counts} == {**{w: "aaaabbbb" for w in counts if w[0] == "a"}, "zzzzzzzz": "zzzzzzzz", "zzzzzzz": "zzzzzzz"}
    assert got["zzzzzzzz"].form is None and got["zzzzzzzz"].n_near == 1


def test_planted_words(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["Straße", "naïveté", "HAUPTSTADT", "l'hôpital", "übergängen×÷ÿ", "sevenlet", "word", "éÉÀàÿÞ", "x" * 3000]) for _ in range(30)))
            for i in range(-20, 60)]
    docs += [(None, "Hauptstadt Hauptstadt"), (5, None), (6, ""), docs[3], (7, "abcdefgŸhijklmn1opqrstu")]
    df = spark.createDataFrame([(i, t, "h") for i, t in docs], "doc_id long, text string, run string")
    got = Counter(r.word for r in planted_words(df).collect())
    assert got == brute_words(docs)
    assert rows(spelling_groups(planted_words(df))) == brute(brute_words(docs))


def test_few_words(spark):
    df = spark.createDataFrame([(None,), ("",), ("one",)], "word string")
    assert rows(spelling_groups(df)) == []
    assert rows(spelling_groups(df.limit(0))) == []
    assert rows(spelling_groups(df, min_count=1)) == [("one", "", "one", 1, 0, -1)]


def test_prefixes_over_partitions(spark):
    """Prefixes that reach over many partitions get one number."""
    words = [f"{'k' * 20}{i:04d}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ahead = spelling._number(df, spelling.F.col("word"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ahead.select("part").distinct().count() > 3
    joints, seen = spelling._joints(ahead, False), {}
    for r in ahead.collect():
        for k, x in enumerate(spelling._joined(r.nodes, r.part, joints[r.part])):
            assert seen.setdefault(r.word[:k + 1], x) == x
    assert len(set(seen.values())) == len(seen)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(op13_spelling_variants(spark, sf)) == brute(brute_words(docs))
