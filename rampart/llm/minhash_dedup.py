"""MinHash near-duplicate groups with tensored banding.

Two small collections of L band hashes are computed per document; the L x L table keys are
all pairs (one hash of either collection), so the tables cost a square root of the usual
minhash work. Only bands that two documents share are paired. Documents of one key are
candidates. They are verified on their full shingle sets: first against the smallest document
of each key; then the documents of keys that still span several components meet on their
rarest shingles. Two sets as similar as asked share a shingle of their prefixes (their rarest
shingles, a share of 1 - t), so this loses no link, while texts that are similar yet below the
threshold have rare shingles of their own in front; a bound from places and from shingle
bitmaps drops most of the rest inside the join. No pairs of a group are listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampart.llm.components import components
from rampart.llm.textkit import Words, batches_of, mix64, text_bytes
from rampart.session import discard, materialize

_VERIFY_BYTES = 4 << 20
_BITMAP = 16  # words of 64 bits in a set's parity bitmap


_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def band_count(threshold: float, rows: int, miss: float = 5e-5) -> int:
    """Bands per collection so that a pair at the threshold misses one with at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document (A-Z lower-cased), end to end,
    and their offsets. Fewer than n words make one shingle, no words none."""
    w = Words(buf, offs, lower=True)
    at, h = w.windows(n, 1)
    first = np.searchsorted(at, w.doc_off)
    short = np.flatnonzero((w.n_words > 0) & (w.n_words < n))
    odd = {}
    for size in np.unique(w.n_words[short]).tolist():
        d = short[w.n_words[short] == size]
        odd.update(zip(d.tolist(), w.window_hash(w.doc_off[d], size, 1).tolist()))
    sets = []
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            s = np.sort(h[a:b])
            sets.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            sets.append(np.array([odd[d]], np.uint64) if d in odd else np.zeros(0, np.uint64))
    size = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.append(0, np.cumsum(size))


def band_hashes(sh: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(2 * bands, documents): each band mixes ``rows`` minhashes; empty sets get zeros."""
    n = len(off) - 1
    out = np.zeros((2 * bands, n), np.uint64)
    full = np.flatnonzero(np.diff(off) > 0)
    if not len(full):
        return out
    starts = off[:-1][full]
    rng = np.random.default_rng(20240229)
    mult = rng.integers(0, 1 << 63, (2 * bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, (2 * bands, rows), dtype=np.uint64)
    for b in range(2 * bands):
        acc = np.full(len(full), b, np.uint64)
        for r in range(rows):
            x = sh * mult[b, r]
            x += add[b, r]
            x ^= x >> np.uint64(32)
            acc = mix64(acc ^ np.minimum.reduceat(x, starts), b + 1)
        out[b, full] = acc
    return out


def _features(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_bytes, n_shingles, a 128-bit set fingerprint (f1, f2) and the band hashes."""
    names = [f"h{i}" for i in range(2 * bands)]

    def run(batches):
        for t in batches_of(batches, 1 << 19, "text"):
            buf, offs = text_bytes(t.column("text"))
            sh, off = shingle_sets(buf, offs, n)
            sums = []
            for seed in (11, 12):
                pre = np.append(np.zeros(1, np.uint64), np.cumsum(mix64(sh, seed)))
                sums.append((pre[off[1:]] - pre[off[:-1]]).view(np.int64))
            cols = [t.column("doc_id"), pa.array(np.diff(offs), pa.int64()), pa.array(np.diff(off), pa.int64()), *map(pa.array, sums)]
            cols += [pa.array(h.view(np.int64)) for h in band_hashes(sh, off, bands, rows)]
            yield from pa.table(cols, names=["doc_id", "n_bytes", "n_shingles", "f1", "f2", *names]).to_batches()

    schema = "doc_id long, n_bytes long, n_shingles long, f1 long, f2 long, " + ", ".join(f"{c} long" for c in names)
    return docs.mapInArrow(run, schema)


def word_shingles(text: bytes, n: int) -> set[tuple]:
    """The distinct n-word shingles of a text as tuples of words."""
    w = text.lower().translate(_BLANKS).split(b" ")  # bytes: only A-Z change
    w = [x for x in w if x]
    return set(zip(*(w[i:] for i in range(n)))) if len(w) >= n else {tuple(w)} if w else set()


def verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, c) whose full shingle sets have ``den * |A and C| >= num * |A or C|``.

    Members of a centre are cut into chunks of a few MB by a hash; every chunk gets its own
    copy of the centre's text, so no task holds a whole group of copies.
    """
    weighed = pairs.join(sizes.select(F.col("doc_id").alias("a"), "n_bytes"), "a")
    chunks = weighed.groupBy("c").agg(F.ceil((F.sum("n_bytes") + 1) / F.lit(_VERIFY_BYTES)).alias("k"))
    members = pairs.join(chunks, "c").select(F.col("a").alias("doc_id"), "c", F.pmod(F.xxhash64("a"), "k").alias("chunk"), F.lit(False).alias("centre"))
    centres = members.select("c", "chunk").distinct().select(F.col("c").alias("doc_id"), "c", "chunk", F.lit(True).alias("centre"))
    work = members.unionByName(centres).join(docs, "doc_id")

    def check(t: pa.Table) -> pa.Table:
        order = np.argsort(~np.asarray(t.column("centre")), kind="stable")  # the centre first
        t = t.take(pa.array(order))
        ids = np.asarray(t.column("doc_id"))
        a, c = [], []
        n_c = int(np.count_nonzero(np.asarray(t.column("centre"))))
        buf, offs = text_bytes(t.column("text"))
        sh, off = shingle_sets(buf, offs, n)
        for i in range(n_c):  # one, unless rows repeat a doc_id
            mine, rest = sh[off[i]:off[i + 1]], sh[off[n_c]:]
            at = np.searchsorted(mine, rest)
            hit = np.append(0, np.cumsum(mine[np.minimum(at, len(mine) - 1)] == rest)) if len(mine) else np.zeros(len(rest) + 1, np.int64)
            lo, hi = off[n_c:-1] - off[n_c], off[n_c + 1:] - off[n_c]
            inter = hit[hi] - hit[lo]
            ok = n_c + np.flatnonzero((den * inter >= num * (len(mine) + (hi - lo) - inter)) & (hi > lo))
            if len(ok):  # hashes say so: the words decide
                whole = word_shingles(buf[offs[i]:offs[i + 1]].tobytes(), n)
                for j in ok.tolist():
                    other = word_shingles(buf[offs[j]:offs[j + 1]].tobytes(), n)
                    if den * len(whole & other) >= num * len(whole | other):
                        a.append(int(ids[j]))
                        c.append(int(ids[i]))
        return pa.table({"a": pa.array(a, pa.int64()), "c": pa.array(c, pa.int64())})

    return work.groupBy("c", "chunk").applyInArrow(check, "a long, c long")


def minhash_groups(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, rows: int = 3,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate groups: documents are linked when ``den * intersection >= num * union`` of
    their distinct ``shingle``-word sets; groups are the connected components of the links.

    Words are runs outside ASCII blanks, A-Z lower-cased; fewer words than ``shingle`` make one
    shingle. Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id
    reachable) and kept (doc_id = component_id). Null or blank texts have 0 shingles and stand
    alone. Rows that repeat a doc_id are one document with the links of all its rows. Rows with
    a null doc_id take no part: component_id null, kept true. Other columns are ignored; an
    empty table gives no rows.
    """
    bands = band_count(num / den, rows)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    feats = materialize(_features(src, shingle, bands, rows), "minhash-features")
    some = feats.where("doc_id is not null and n_shingles > 0")
    # equal sets are one class, represented by its smallest doc_id
    classes = materialize(some.groupBy("f1", "f2", "n_shingles")
                          .agg(F.min("doc_id").alias("rep"), *[F.first(f"h{i}").alias(f"h{i}") for i in range(2 * bands)]), "minhash-classes")
    meets = materialize(_meetings(classes, bands, num, den), "minhash-keys")  # (key, rep, c): sets of a key, its smallest set
    sizes = some.groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes"))
    star = materialize(meets.where("rep <> c").select(F.col("rep").alias("a"), "c").distinct(), "minhash-pairs")
    links = materialize(verified(star, src, sizes, shingle, num, den).distinct(), "minhash-links")
    discard(star)
    comp = materialize(components(links.select(F.col("a").alias("u"), F.col("c").alias("v"))), "minhash-comp")
    mixed = materialize(_mixed(meets, comp), "minhash-mixed")
    discard(meets)
    if not mixed.isEmpty():
        rest = materialize(_by_rare_shingles(mixed, src, shingle, num, den), "minhash-pairs")
        more = materialize(verified(rest, src, sizes, shingle, num, den), "minhash-links")
        comp = materialize(components(links.unionByName(more).select(F.col("a").alias("u"), F.col("c").alias("v"))), "minhash-comp")
        discard(rest, more)
    discard(links, mixed)
    label = classes.select("f1", "f2", "n_shingles", "rep").join(comp, F.col("rep") == F.col("node"), "left") \
        .select("f1", "f2", "n_shingles", F.coalesce("label", "rep").alias("component"))
    mine = some.select("doc_id", "f1", "f2", "n_shingles").join(label, ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = feats.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return mine.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _meetings(classes: DataFrame, bands: int, num: int, den: int) -> DataFrame:
    """(key, rep, c): the sets of every table key that two sets or more share, with the smallest
    of them. Sets so small that one shingle more or less is too much link with no other set."""
    big = classes.where(F.lit(den) * F.col("n_shingles") >= F.lit(num) * (F.col("n_shingles") + 1))
    band = big.select("rep", F.posexplode(F.array(*[f"h{i}" for i in range(2 * bands)])).alias("b", "h"))
    live = band.groupBy("b", "h").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("b", "h")
    # of each set the bands that another set has; keys are pairs of one collection and the other
    mine = band.join(live, ["b", "h"]).groupBy("rep").agg(F.collect_list(F.struct("b", "h")).alias("x"))
    first, second = (F.filter("x", lambda z: z["b"] < bands), F.filter("x", lambda z: z["b"] >= bands))
    keyed = mine.select("rep", first.alias("one"), second.alias("two")).where("size(one) > 0 and size(two) > 0") \
        .select("rep", "two", F.explode("one").alias("one")).select("rep", "one", F.explode("two").alias("two")) \
        .select("rep", F.xxhash64("one.b", "one.h", "two.b", "two.h").alias("key"))
    met = keyed.groupBy("key").agg(F.min("rep").alias("c"), F.max("rep").alias("top")).where("c < top").select("key", "c")
    return keyed.join(met, "key")


def _mixed(meets: DataFrame, comp: DataFrame) -> DataFrame:
    """(rep, comp): the sets of keys whose members lie in several components."""
    at = meets.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("key", "rep", F.coalesce("label", "rep").alias("comp"))
    keys = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return at.join(keys, "key", "left_semi").select("rep", "comp").distinct()


def _shingle_rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, comp, its shingle hashes, and a bitmap with the parity of the shingles of each bit."""
    names = [f"b{i}" for i in range(_BITMAP)]

    def run(batches):
        for t in batches_of(batches, 1 << 19, "text"):
            sh, off = shingle_sets(*text_bytes(t.column("text")), n)
            owner = np.repeat(np.arange(len(t)), np.diff(off))
            bit = (mix64(sh, 21) >> np.uint64(54)).astype(np.int64)
            flags = np.bincount(owner * 1024 + bit, minlength=1024 * len(t)).astype(np.uint8) & 1
            words = np.packbits(flags.reshape(len(t), 1024), axis=1).view(np.int64)
            sets = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(sh.view(np.int64)))
            yield from pa.table([t.column("rep"), t.column("comp"), sets, *(pa.array(np.ascontiguousarray(w)) for w in words.T)],
                                names=["rep", "comp", "sh", *names]).to_batches()

    return docs.mapInArrow(run, "rep long, comp long, sh array<long>, " + ", ".join(f"{c} long" for c in names))


def _by_rare_shingles(mixed: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs (a, c), a > c, of different components that can be similar enough.

    Shingles are put in order of their number of sets. Sets x, y with |x| <= |y| that overlap in
    o >= num / (num + den) * (|x| + |y|) shingles share one among the first
    |x| - ceil(2 num |x| / (num + den)) + 1 of x and the first |y| - ceil(num |y| / den) + 1 of y.
    Shingles that one set alone has can't be shared: they come first and are only counted.
    A pair that meets at places i and j overlaps in at most 1 + min(|x| - i, |y| - j) shingles
    (places from 1), and in at most half of |x| + |y| less the differing bits of the bitmaps.
    """
    some = docs.join(mixed.withColumnRenamed("rep", "doc_id"), "doc_id").withColumnRenamed("doc_id", "rep")
    # a doc_id that is repeated has several sets: r tells them apart
    rows = materialize(_shingle_rows(some, n).withColumn("r", F.monotonically_increasing_id()), "minhash-sets")
    token = rows.select("r", F.explode("sh").alias("t"))
    shared = token.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    mine = token.join(shared, "t").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("s"))
    bits = [f"b{i}" for i in range(_BITMAP)]
    size = F.size("sh").cast("long")
    ranked = rows.select("r", "rep", "comp", size.alias("n"), *bits).join(mine, "r").withColumn("own", F.col("n") - F.size("s"))
    # whole numbers throughout: ceil(p / q) is (p + q - 1) div q
    probe = F.expr(f"n - (n * {num} + {den} - 1) div {den} + 1")
    index = F.expr(f"n - (2 * n * {num} + {num + den} - 1) div {num + den} + 1")
    head = ranked.withColumns({"probe": probe, "index": index}).where("probe > own") \
        .withColumn("s", F.slice("s", F.lit(1), F.greatest(F.col("probe") - F.col("own"), F.lit(0)).cast("int")))
    entry = materialize(head.select("r", "rep", "comp", "n", "own", "index", *bits, F.posexplode("s").alias("i", "x"))
                        .select("r", "rep", "comp", "n", (F.col("own") + F.col("i") + 1).alias("at"), "index", F.col("x.t").alias("t"), *bits), "minhash-prefixes")
    x, y = entry.where("at <= index").alias("x"), entry.alias("y")
    differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in bits), F.lit(0))
    total = F.col("x.n") + F.col("y.n")
    by_place = F.lit(1) + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    by_bits = total - differ  # twice the overlap at most

    def enough(twice: Column) -> Column:
        """Whether twice an overlap reaches the threshold: den * o >= num * (total - o)."""
        return twice * (num + den) >= total * (2 * num)

    on = ((F.col("x.t") == F.col("y.t")) & (F.col("x.comp") != F.col("y.comp"))
          & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.r") < F.col("y.r"))))
          & (F.col("x.n") * den >= F.col("y.n") * num) & enough(by_place * 2) & enough(by_bits))
    pairs = materialize(x.join(y, on).select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("c")).distinct(), "minhash-near")
    discard(rows, entry)
    return pairs


def op9_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Thin query: 3-word shingles at 0.85 over the whole documents table."""
    return minhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, num=85, den=100)
