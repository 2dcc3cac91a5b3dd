"""Spelling variants by a dictionary of trie-node pairs.

The words of the vocabulary are sorted over all partitions; a pass over the sorted words numbers
the nodes of their trie (a node is a prefix), and a second sort of the reversed words numbers the
suffixes. A word then is a row of integer pairs (prefix node, suffix node): the pair before and
after position i with that position skipped, and the pair that meets between two positions. Two
words that share a skipped pair differ by a replaced letter there; a skipped pair of one word that
is an unskipped pair of another is a deleted letter. A pair is held by at most one word a letter,
so the groups of the join are as small as the alphabet, whatever the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.session import discard, materialize

_PART = 40  # bits of a number inside its partition
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CUT = 31  # one run in so many loses a letter


def planted_words(docs: DataFrame, min_length: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): every run of Latin letters that gives a word of ``min_length`` letters or more, A-Z
    lower-cased; where 31 divides h, the crc32 of "<doc_id>:<run>", the letter h % length goes. A
    null id reads as an empty one."""
    # a run of fewer letters gives no word, as no run gains letters
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}"), F.lit(0))
    low = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("run")) \
        .select("i", F.translate("run", _UPPER, _LOWER).alias("run"))
    low = low.withColumn("h", F.crc32(F.encode(F.concat("i", F.lit(":"), "run"), "utf-8")))
    n = F.char_length("run")
    at = (F.col("h") % n).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, n))
    return low.select(F.when(F.col("h") % _CUT == 0, less).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= min_length)


def _number(words: DataFrame, order: Column) -> DataFrame:
    """(word, part, num, nodes): the words in the order of ``order`` over partitions; num rises
    with it, and nodes numbers the prefixes of ``order`` of 1, 2, .. letters. Prefixes that reach
    over a partition's start have numbers of their own there (``_joints`` says which are one)."""

    def run(batches):
        part = TaskContext.get().partitionId()
        fresh = part << _PART
        before, path, place = "", [], fresh
        for b in batches:
            nodes, size = [], []
            for w in b.column(1).to_pylist():
                same = 0
                for x, y in zip(before, w):
                    if x != y:
                        break
                    same += 1
                new = len(w) - same
                path = path[:same] + list(range(fresh + 1, fresh + 1 + new))
                fresh += new
                before = w
                nodes += path
                size.append(len(w))
            off = pa.array(np.append(0, np.cumsum(size)), pa.int32())
            num = np.arange(place, place + len(b))
            place += len(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(b), pa.int64()), pa.array(num, pa.int64()),
                                              pa.ListArray.from_arrays(off, pa.array(nodes, pa.int64()))], names=["word", "part", "num", "nodes"])

    sorted_ = words.select("word", order.alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    return materialize(sorted_.mapInArrow(run, "word string, part long, num long, nodes array<long>"), "trie-nodes")


def _joints(numbered: DataFrame, reverse: bool) -> dict[int, list[int]]:
    """Of each partition, the true numbers of its first prefixes, which words of earlier
    partitions share. Two words a partition are gathered, as many as there are partitions."""
    ends = numbered.groupBy("part").agg(F.min_by("word", "num").alias("first"), F.max_by("word", "num").alias("last"), F.max_by("nodes", "num").alias("nodes")) \
        .orderBy("part").collect()
    out, before, path = {}, "", []
    for r in ends:
        first, last = (r.first[::-1], r.last[::-1]) if reverse else (r.first, r.last)
        same = next((k for k, (x, y) in enumerate(zip(before, first)) if x != y), min(len(before), len(first)))
        out[r.part] = path[:same]
        path = _joined(r.nodes, r.part, out[r.part])
        before = last
    return out


def _joined(nodes: list[int], part: int, joint: list[int]) -> list[int]:
    """A word's nodes with the numbers its partition took over."""
    base = (part << _PART) + 1  # the first word's prefixes are base, base + 1, ..
    return [joint[k] if k < len(joint) and x == base + k else x for k, x in enumerate(nodes)]


def _pairs(both: DataFrame, forward: dict[int, list[int]], backward: dict[int, list[int]]) -> DataFrame:
    """(p, s, num, n, kind): kind 0 a pair between two positions, 1 a pair around a skipped one,
    2 the same where the letter before is another (of equal letters in a row only the first
    counts as the deleted one)."""

    def flat(col: pa.ListArray, part: np.ndarray, joints: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        x, size = col.flatten().to_numpy().copy(), np.diff(col.offsets.to_numpy())
        off = np.append(0, np.cumsum(size))
        depth = np.arange(len(x)) - np.repeat(off[:-1], size)
        longest = max((len(j) for j in joints.values()), default=0)
        if longest:
            known = sorted(joints)
            table = np.full((len(known), longest), -1, np.int64)
            for i, k in enumerate(known):
                table[i, :len(joints[k])] = joints[k]
            owner = np.repeat(np.searchsorted(known, part), size)
            at = np.flatnonzero((depth < longest) & (x == (np.repeat(part, size) << _PART) + 1 + depth))
            said = table[owner[at], depth[at]]
            x[at[said >= 0]] = said[said >= 0]
        return x, off

    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            p, off = flat(col("fnodes"), np.asarray(col("fpart")), forward)
            s, _ = flat(col("bnodes"), np.asarray(col("bpart")), backward)
            size = np.diff(off)
            # node of 0 letters is the root, 0
            size1 = size + 1
            off1 = np.append(0, np.cumsum(size1))
            p0, s0 = np.zeros(int(off1[-1]), np.int64), np.zeros(int(off1[-1]), np.int64)
            inner = np.ones(int(off1[-1]), bool)
            inner[off1[:-1]] = False
            p0[inner], s0[inner] = p, s
            word1, word = np.repeat(np.arange(len(size)), size1), np.repeat(np.arange(len(size)), size)
            i1, i = np.arange(len(word1)) - off1[word1], np.arange(len(word)) - off[word]
            code = np.frombuffer("".join(col("word").to_pylist()).encode("utf-32-le"), "<u4")
            opens = np.append(True, code[1:] != code[:-1])[:len(code)] | (i == 0)
            left = np.concatenate([p0, p0[off1[word] + i]])
            right = np.concatenate([s0[off1[word1] + size[word1] - i1], s0[off1[word] + size[word] - 1 - i]])
            who = np.concatenate([word1, word])
            kind = np.concatenate([np.zeros(len(word1), np.int8), 1 + opens.astype(np.int8)])
            out = [pa.array(left), pa.array(right), pa.array(np.asarray(col("num"))[who]), pa.array(np.asarray(col("n"))[who]), pa.array(kind)]
            yield from pa.table(out, names=["p", "s", "num", "n", "kind"]).to_batches(max_chunksize=100_000)

    return both.mapInArrow(run, "p long, s long, num long, n long, kind tinyint")


def _neighbours(pairs: DataFrame) -> DataFrame:
    """(num, near, best_n, best): of every pair a word shares, how many words it meets there for
    the first time, and the most frequent of them (ties: the smallest number)."""

    def groups(batches):
        """Whole groups of equal (p, s), which stand together, as arrays in any number."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            p, s = np.asarray(t.column("p")), np.asarray(t.column("s"))
            last = np.flatnonzero((p != p[-1]) | (s != s[-1])) if len(p) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut)
        if held is not None and len(held):
            yield held

    def run(batches):
        for t in groups(batches):
            p, s, num, n, kind = (np.asarray(t.column(c)) for c in ("p", "s", "num", "n", "kind"))
            new = np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1]))
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(p)))
            g = np.cumsum(new) - 1
            skips = np.add.reduceat((kind > 0).astype(np.int64), first)
            on = ((size > 1) & (skips > 0))[g]
            if not on.any():
                continue
            num, n, kind, g = num[on], n[on], kind[on], g[on]
            # skipped pairs first, the most frequent word of them in front
            order = np.lexsort((num, -n, kind == 0, g))
            num, n, kind, g = num[order], n[order], kind[order], g[order]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            size = np.diff(np.append(first, len(g)))
            own = np.repeat(np.arange(len(first)), size)
            skips = np.add.reduceat((kind > 0).astype(np.int64), first)
            opens = np.add.reduceat((kind == 2).astype(np.int64), first)
            whole = size - skips  # 0 or 1: the word that has no letter here
            place = np.arange(len(g)) - first[own]
            skip = kind > 0
            near = np.where(skip, skips[own] - 1 + (kind == 2) * whole[own], opens[own])
            # the best other skipped word: the first, for the first itself the second
            other = np.where(skip & (place == 0), 1, 0)
            has = other < skips[own]
            at = first[own] + np.minimum(other, size[own] - 1)
            best_n, best = np.where(has, n[at], -1), np.where(has, num[at], 0)
            tail = first[own] + size[own] - 1
            short = skip & (whole[own] > 0)
            better = short & ((n[tail] > best_n) | ((n[tail] == best_n) & (num[tail] < best)))
            best_n, best = np.where(better, n[tail], best_n), np.where(better, num[tail], best)
            ok = best_n >= 0
            yield from pa.table([pa.array(num[ok]), pa.array(near[ok]), pa.array(best_n[ok]), pa.array(best[ok])],
                                names=["num", "near", "best_n", "best"]).to_batches()

    dealt = pairs.repartition("p", "s").sortWithinPartitions("p", "s")
    return dealt.mapInArrow(run, "num long, near long, best_n long, best long")


def _roots(forms: DataFrame) -> DataFrame:
    """(num, root) for (num, to): every word's last form, by doubling. Counts grow tenfold a step,
    so chains are short."""
    at = materialize(forms.select("num", F.col("to").alias("root")), "spelling-roots")
    while True:
        far = at.select(F.col("num").alias("mid"), F.col("root").alias("far"))
        step = materialize(at.join(far, at["root"] == far["mid"], "left").select("num", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        moved = not step.where("moved").isEmpty()
        discard(at)
        at = step
        if not moved:
            return at.select("num", "root")


def spelling_groups(words: DataFrame, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """Spelling variants among the words (a row an occurrence, column ``word``) that occur at
    least ``min_count`` times.

    Two words are near if one code point is inserted, deleted or replaced between them. A word's
    form is its near word of most occurrences (ties: the smallest in code-point order) if it
    has at least ``ratio`` times the word's own, else null. Returns word, form, root (follow
    forms to the last; the word itself without one), n, n_near (near words) and form_n (null
    without a form). Null and empty words and other columns are ignored; an empty table gives
    no rows.
    """
    counted = materialize(words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count), "spelling-words")
    ahead, back = _number(counted, F.col("word")), _number(counted, F.reverse("word"))
    a = ahead.select("word", F.col("part").alias("fpart"), "num", F.col("nodes").alias("fnodes"))
    b = back.select("word", F.col("part").alias("bpart"), F.col("nodes").alias("bnodes"))
    both = counted.join(a, "word").join(b, "word")
    pairs = _pairs(both, _joints(ahead, False), _joints(back, True))
    met = _neighbours(pairs).groupBy("num").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("b")) \
        .select("num", "n_near", "b.best_n", (-F.col("b.best")).alias("best"))
    near = materialize(met, "spelling-near")
    known = materialize(counted.join(ahead.select("word", "num"), "word"), "spelling-known")
    discard(ahead, back)
    rows = known.join(near, "num", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    forms = materialize(rows.where(has).select("num", F.col("best").alias("to")), "spelling-forms")
    roots = _roots(forms)
    name = lambda c, out: known.select(F.col("num").alias(c), F.col("word").alias(out))
    out = rows.withColumn("to", F.when(has, F.col("best"))).join(roots, "num", "left")
    # only the words that have a form look one up
    named = out.where("to is not null").join(name("to", "form"), "to").join(name("root", "last"), "root") \
        .select("word", "form", F.col("last").alias("root"), "n", "n_near", F.col("best_n").alias("form_n"))
    alone = out.where("to is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n",
                                           F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    return named.unionByName(alone)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Thin query: words of at least 7 letters and 2 occurrences of the whole documents table."""
    return spelling_groups(planted_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
