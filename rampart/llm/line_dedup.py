"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as word sequences. Two lines are duplicates when they are equal or, if both
have at least ``min_words`` words, when one word edit (replace, insert, delete) turns one into
the other. Every line that could have a partner emits all its one-word-deletion variants as
hashed keys; lines with an equal key are within the bound, and the earliest line of a key is
all that the others need, so no pairs of a crowded key are listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampart.llm.textkit import fresh_name
from rampart.session import discard, materialize

# moduli of the position-weighted word hashes: primes near 2^31 (fixed values)
_P, _Q = 2147483647, 2147483629
_LAST = 2**63 - 1  # null ids come after all others
#: documents (ids of 8 bytes) that a broadcast may carry, counted first; beyond, a shuffle join
BROADCAST_DOCS = 1_000_000


def line_words(line: Column) -> Column:
    """Words of a line: runs outside ASCII blanks."""
    return F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), "")


def plain_line(line: Column) -> Column:
    """The words of a line joined by single spaces; most lines are that already and need no
    cutting into words."""
    blanks = [F.contains(line, F.lit(x)) for x in ("\t", "\x0b", "\x0c", "\r", "  ")]
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for x in blanks:
        odd = odd | x
    return F.when(odd, F.array_join(line_words(line), " ")).otherwise(line)


def _hashes(plain: Column) -> list[Column]:
    """A 128-bit hash of a line."""
    return [F.xxhash64(plain), F.xxhash64(F.lit(1), plain)]


def _halves(n: Column, min_words: int) -> list[Column]:
    """Keys of the first and last p words, for p half the words of the line or of a line one
    word shorter: one edit leaves the same half of both lines whole."""
    def key(side: int, p: Column) -> Column:
        return F.xxhash64(F.lit(side), p, F.call_function("substring_index", F.col("c"), F.lit(" "), p if side == 0 else -p))

    p, q = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return [F.when((n >= min_words) & only, key(side, half)) for half, only in ((p, F.lit(True)), (q, p != q)) for side in (0, 1)]


def line_keys(docs: DataFrame, min_words: int) -> DataFrame:
    """One row a line: its document d, the hash r of the text it stands in, its number l, its hash
    (h1, h2; null without a word) and half keys k0 .. k3 (of first and last words; null if absent)."""
    c = docs.select("d", F.xxhash64("text").alias("r"), F.posexplode(F.split("text", "\n", -1)).alias("l", "line")) \
        .select("d", "r", "l", plain_line(F.col("line")).alias("c"))
    c = c.withColumn("n", F.octet_length("c") - F.octet_length(F.replace(F.col("c"), F.lit(" "), F.lit(""))) + 1)
    h1, h2 = (F.when(F.col("c") != "", h) for h in _hashes(F.col("c")))
    return c.select("d", "r", "l", h1.alias("h1"), h2.alias("h2"), *[k.alias(f"k{i}") for i, k in enumerate(_halves(F.col("n"), min_words))])


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row a distinct line with a word: h1, h2, the first document d that has it, k0 .. k3."""
    return lines.where("h1 is not null").groupBy("h1", "h2").agg(F.min("d").alias("d"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])


def _candidates(distinct: DataFrame) -> DataFrame:
    """Lines that share a half with another distinct line (no other line can have a partner),
    with the sides they share: an edit then lies on the other side."""
    sides = F.array(*[F.struct(F.lit(i % 2).alias("side"), F.col(f"k{i}").alias("key")) for i in range(4)])
    keyed = distinct.where("k0 is not null").select("h1", "h2", "d", F.explode(F.filter(sides, lambda x: x["key"].isNotNull())).alias("x")) \
        .select("h1", "h2", "d", "x.side", "x.key")
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return keyed.join(shared, "key", "left_semi").groupBy("h1", "h2", "d") \
        .agg(F.max(F.col("side") == 0).alias("first"), F.max(F.col("side") == 1).alias("last"))


def _with_words(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """The words of the given lines and their place (d, line number, text hash), read from the
    document that has them first."""
    ids = materialize(lines.select("d").distinct(), "line-docs")
    # only documents that hold a candidate are read: few ids are sent to the tasks, many are joined
    few = ids.count() <= BROADCAST_DOCS
    some = docs.join(F.broadcast(ids) if few else ids, "d", "left_semi")
    at = some.select("d", F.xxhash64("text").alias("r"), F.posexplode(F.split("text", "\n", -1)).alias("l", "line")) \
        .select("d", "l", "r", plain_line(F.col("line")).alias("c")).where("c <> ''")
    h1, h2 = _hashes(F.col("c"))
    got = at.withColumns({"h1": h1, "h2": h2}).join(lines, ["h1", "h2", "d"])
    one = got.groupBy("h1", "h2", "first", "last").agg(F.min(F.struct("d", "l", "r")).alias("ord"), F.first("c").alias("c"))
    return one.select("h1", "h2", "first", "last", "ord", F.split("c", " ").alias("w"))


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """(key, kind, h1, h2): kind 0 the whole line, 1 the line without one word, 2 the line with
    one word blanked, for the words where an edit can lie. Keys are word-hash sums and
    position-weighted sums, so a deletion's key follows from running sums: linear in the
    words, however long the line. Lines are dealt out before their words are."""
    words = lines.repartition("h1", "h2").select("h1", "h2", "first", "last", F.size("w").alias("n"), F.posexplode("w").alias("i", "word")) \
        .select("h1", "h2", "first", "last", "n", "i", F.pmod(F.xxhash64("word"), F.lit(_P)).alias("x"), F.pmod(F.xxhash64(F.lit(1), "word"), F.lit(_Q)).alias("y"))
    line = Window.partitionBy("h1", "h2")
    run = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = words.select("*", F.sum("x").over(line).alias("sx"), F.sum("y").over(line).alias("sy"),
                        F.sum(F.pmod(F.col("i") * F.col("x"), F.lit(_P))).over(line).alias("tx"), F.sum(F.pmod(F.col("i") * F.col("y"), F.lit(_Q))).over(line).alias("ty"),
                        F.sum("x").over(run).alias("px"), F.sum("y").over(run).alias("py"))

    def key(tag: int, n: Column, x: Column, y: Column, tx: Column, ty: Column, *more: Column) -> Column:
        return F.xxhash64(F.lit(tag), n, x, y, F.pmod(tx, F.lit(_P)), F.pmod(ty, F.lit(_Q)), *more)

    n, i, x, y, sx, sy, tx, ty, px, py = (F.col(c) for c in ("n", "i", "x", "y", "sx", "sy", "tx", "ty", "px", "py"))
    ix, iy = F.pmod(i * x, F.lit(_P)), F.pmod(i * y, F.lit(_Q))
    whole = F.struct(key(0, n, sx, sy, tx, ty).alias("key"), F.lit(0).alias("kind"))
    shorter = F.struct(key(0, n - 1, sx - x, sy - y, tx - ix - (sx - px), ty - iy - (sy - py)).alias("key"), F.lit(1).alias("kind"))
    blanked = F.struct(key(1, n, sx - x, sy - y, tx - ix, ty - iy, i).alias("key"), F.lit(2).alias("kind"))
    # a shared first half leaves edits in the rest, and the other way round
    open_ = (F.col("first") & (i >= F.floor((n - 1) / 2))) | (F.col("last") & (i < n - F.floor((n - 1) / 2)))
    emitted = F.concat(F.when(i == 0, F.array(whole)).otherwise(F.array().cast("array<struct<key:bigint,kind:int>>")),
                       F.when(open_, F.array(shorter, blanked)).otherwise(F.array().cast("array<struct<key:bigint,kind:int>>")))
    return sums.select("h1", "h2", F.explode(emitted).alias("v")).select("v.key", "v.kind", "h1", "h2")


def near_duplicates(lines: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that have an earlier line one word edit away, with that partner
    checked word by word. ``lines``: h1, h2, first, last, ord, w."""
    v = _neighbourhood(lines)
    met = v.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    v = materialize(v.join(met, "key", "left_semi"), "line-variants").join(lines.select("h1", "h2", "ord"), ["h1", "h2"])
    # of a key: the earliest whole line, shortened line, blanked line
    mins = v.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, F.col("ord"))).alias(f"m{k}") for k in range(3)])
    partner = F.when(F.col("kind") == 0, F.col("m1")).when(F.col("kind") == 1, F.col("m0")).otherwise(F.col("m2"))
    claims = v.join(mins, "key").withColumn("partner", partner).where("partner < ord") \
        .groupBy("h1", "h2").agg(F.min("partner").alias("partner"))
    mine = lines.select("h1", "h2", F.col("w").alias("a"))
    theirs = lines.select(F.col("ord").alias("partner"), F.col("w").alias("b"))
    both = claims.join(mine, ["h1", "h2"]).join(theirs, "partner")
    return both.where(_one_edit(F.col("a"), F.col("b"))).select("h1", "h2")


def _one_edit(a: Column, b: Column) -> Column:
    """At most one word replaced, inserted or deleted: past the first difference the rests are
    equal when one or both of the differing words are skipped."""
    def but_one(long: Column, short: Column) -> Column:
        first = F.coalesce(F.array_position(F.zip_with(short, F.slice(long, 1, F.size(short)), lambda x, y: x != y), True), F.lit(0))
        at = F.when(first == 0, F.size(long)).otherwise(first).cast("int")
        return F.concat(F.slice(long, 1, at - 1), F.slice(long, at + 1, F.size(long))) == short

    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda z: z)) <= 1
    return F.when(F.size(a) == F.size(b), same).when(F.size(a) == F.size(b) + 1, but_one(a, b)).when(F.size(b) == F.size(a) + 1, but_one(b, a)).otherwise(False)


def line_dedup(docs: DataFrame, min_words: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep the earliest of duplicate lines, in the order of (doc_id, line number).

    A line goes if an earlier line equals it, or is one word edit away and both have at least
    ``min_words`` words (earlier lines count even if they go themselves). All columns of
    ``docs`` are returned, the text without the lines that go, and n_lines, n_removed
    (replacing columns of those names; any other name may occur in ``docs``). Lines without a
    word always stay. A null text stays null with 0 lines. Null doc_ids come last. Rows that
    share a doc_id (or have none) are one document: a line that this document has first stays
    once in each of its rows; near duplicates among them go by line number, then by a hash of
    the text. An empty table gives no rows.
    """
    rest = docs.drop("n_lines", "n_removed")
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))
    src = docs.select(d.alias("d"), F.col(text).cast("string").alias("text")).where("text is not null")
    lines = materialize(line_keys(src, min_words), "line-keys")
    distinct = materialize(distinct_lines(lines), "line-distinct")
    near = materialize(_with_words(_candidates(distinct), src), "line-near")
    kept = distinct.select("h1", "h2", "d").join(near_duplicates(near), ["h1", "h2"], "left_anti")
    # a line stays where it stands first in a text of the document that keeps it
    first = lines.join(kept, ["h1", "h2", "d"]).groupBy("d", "r", "h1", "h2").agg(F.min("l").alias("l"))
    blank = lines.where("h1 is null").select("d", "r", "l").distinct()
    stay = materialize(first.select("d", "r", "l").unionByName(blank).groupBy("d", "r").agg(F.array_sort(F.collect_list("l")).alias("stay")), "line-stay")
    discard(lines, distinct, near)
    mine, there, stays = (fresh_name(x, docs.columns) for x in ("d", "r", "stay"))
    at = stay.select(F.col("d").alias(mine), F.col("r").alias(there), F.col("stay").alias(stays))
    whole = F.col(text).cast("string")
    out = rest.withColumns({mine: d, there: F.xxhash64(whole)}).join(at, [mine, there], "left")
    n = F.when(whole.isNull(), F.lit(0)).otherwise(F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1)
    gone = F.when(whole.isNull(), F.lit(0)).otherwise(n - F.coalesce(F.size(stays), F.lit(0)))
    # the lines are cut once a text: they are the outer lambda's variable
    left = F.element_at(F.transform(F.array(F.split(whole, "\n", -1)), lambda cut: F.array_join(F.transform(
        F.coalesce(stays, F.array().cast("array<int>")), lambda i: F.get(cut, i)), "\n")), 1)
    cut = F.when(gone == 0, whole).otherwise(left)
    return out.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in rest.columns], n.cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Thin query: the whole documents table."""
    got = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with l as (
  select doc_id, t.i::bigint as line_no, t.line,
         [x for x in string_split_regex(t.line, '[\x20\x09-\x0D]+') if x <> ''] as w
  from (select doc_id, unnest(list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10))), recursive := false) as z
        from documents where text is not null), lateral (select z[1] as i, z[2] as line) t),
u as (select row_number() over (order by min(doc_id * 1000000 + line_no)) as o, min(doc_id * 1000000 + line_no) as pl, w
      from l where len(w) > 0 group by w),
v as (select o, i, len(w) as n, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') as rest
      from (select o, w, unnest(range(1, len(w) + 1)) as i from u where len(w) >= 8)),
s as (select i, n, rest, min(o) as lo from v group by all having count(*) > 1),
f as (select o, len(w) as n, array_to_string(w, ' ') as whole from u where len(w) >= 8),
gone as (
  select v.o from v join s using (i, n, rest) where s.lo < v.o
  union select v.o from v join f on f.whole = v.rest and f.n = v.n - 1 where f.o < v.o
  union select f.o from v join f on f.whole = v.rest and f.n = v.n - 1 where v.o < f.o),
k as (select pl from u where o not in (select o from gone)),
d as (select l.doc_id, count(*) as n_lines, count(*) filter (where len(l.w) > 0 and k.pl is null) as n_removed,
             coalesce(string_agg(l.line, chr(10) order by l.line_no) filter (where len(l.w) = 0 or k.pl is not null), '') as kept
      from l left join k on k.pl = l.doc_id * 1000000 + l.line_no group by l.doc_id)
select d0.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       case when d0.text is not null then sha256(kept) end as kept_sha256
from documents d0 left join d using (doc_id)
"""
