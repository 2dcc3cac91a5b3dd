"""The pipeline's stages against brute force, and its registration."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rampart.llm.decontaminate import find_leaks
from rampart.llm.langid import predict_languages, train_language_model
from rampart.session import materialize

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, monkeypatch):
    """Each stage on its own input; the whole chain is run()."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "", None, "s", 0), (90_003, "12 34", "en", None, 5), (None, None, None, None, None),
                                   (90_004, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 4, None, "s", 9)], docs.schema)
    docs = materialize(docs.unionByName(extra), "t")
    kept = {}
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    rows = {None: docs}
    last = docs
    for name, f in corpus_pipeline.STAGES:
        last = materialize(f(spark, last, SF), "t")
        rows[name] = last
        kept[name] = [tuple(r) for r in last.collect()]
        if name != "packing":
            assert last.columns == cols
    # language ID: what the model rejects goes, nothing else
    model = train_language_model(docs, "true")
    want = {r.doc_id for r in predict_languages(docs, model).collect() if r.lang_pred != "und" and r.score >= model.floor}
    assert {r[0] for r in kept["language_id"]} == want and len(want) >= docs.count() - 7
    assert not {90_001, 90_002, 90_003, 90_004, None} & want  # 90_004: a script no label taught
    # line dedup
    before = {r[0]: r for r in kept["language_id"]}
    lines = brute.line_dedup([(i, r[1]) for i, r in before.items()], 8)
    want = {(i, text) for i, (_, n, text) in lines.items() if n == 0 or brute.words(text)}
    assert {(r[0], r[1]) for r in kept["line_dedup"]} == want
    assert all(r[4] == len(r[1]) for r in kept["line_dedup"] if lines[r[0]][1])
    # near-duplicates: one document of each group
    groups = brute.minhash_groups([(r[0], r[1]) for r in kept["line_dedup"]], 5, 80, 100)
    assert {r[0] for r in kept["minhash_near_dedup"]} == {i for i, (_, c) in groups.items() if c == i}
    # decontamination
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute.leaks([(r[0], r[1]) for r in kept["minhash_near_dedup"]], items)}
    assert {r[0] for r in kept["benchmark_decontamination"]} == {r[0] for r in kept["minhash_near_dedup"]} - bad
    # packing: every id of every kept text once
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = {r[0]: brute.token_ids(tok, r[1], 1) for r in kept["benchmark_decontamination"]}
    pieces = sorted(kept["packing"])
    at = dict.fromkeys(left, 0)
    for doc, start, n, crc, total, *_ in pieces:
        assert (start, total, crc) == (at[doc], len(left[doc]), brute.crc(left[doc][start:start + n]))
        at[doc] += n
    assert at == {i: len(x) for i, x in left.items()}
    assert find_leaks(rows["benchmark_decontamination"], spark.read.parquet(f"{SF}/benchmark.parquet")).isEmpty()


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like the operators' own come back as they were."""
    rows = [(i, t, "en", "s", len(t), 0.5, "x", 7, 8, [1], 2.0) for i, t in enumerate(["The cat sat on the mat.\nThe end of it all", "Another text\nThe end of it all", "One more line here"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, "
                                       "n_lines int, n_removed int, __stay array<int>, r double")
    for f in dict(corpus_pipeline.STAGES[:4]).values():
        got = materialize(f(spark, docs, SF), "t")
        assert got.columns == docs.columns
        assert all((r.score, r.lang_pred, r.n_lines, r.n_removed, r["__stay"], r.r) == (0.5, "x", 7, 8, [1], 2.0) for r in got.collect())
        docs = got


def test_stages_on_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, SF), "t")
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14))
    assert {"op3_line_dedup", "op12_hard_negatives"} <= set(entry.oracle_sql())


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and got.columns[:3] == ["doc_id", "start", "length"]
