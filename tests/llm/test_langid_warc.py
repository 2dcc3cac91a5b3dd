"""The byte network, language ID, and WARC histories."""

import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampart.llm import gru
from rampart.llm.langid import LANES, STEPS, LanguageModel, document_probabilities, op5_language_id, predict_languages, train_language_model, windows
from rampart.llm.textkit import Words, batches_of, text_bytes
from rampart.llm.warc import LoserTree, capture_histories, members, merge_runs, read_runs, record_bytes, url_key, write_archives
from rampart.llm.shared_files import new_folder, open_file

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    p = gru.Params.init(3, hidden=4, embed=3)
    x, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    mask = np.ones((6, 5), np.float32)
    mask[4:, 2] = 0
    weight = np.ones(5, np.float32)
    _, grads = gru.loss_and_grads(p, x, y, weight, mask)
    checked = 0
    for k, a in enumerate(p.arrays()):
        for _ in range(25):
            i = tuple(rng.integers(0, s) for s in a.shape)
            i = (i[0], int(x[0, i[1] % 5])) if k == 0 else i
            if abs(grads[k][i]) < 1e-3:
                continue
            old, e = a[i], 3e-3
            a[i] = old + e
            up = gru.loss_and_grads(p, x, y, weight, mask)[0]
            a[i] = old - e
            down = gru.loss_and_grads(p, x, y, weight, mask)[0]
            a[i] = old
            assert grads[k][i] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-4)
            checked += 1
    assert checked > 15


def test_mask_equals_shorter_window():
    """Positions past a window's end change nothing before it, in either direction."""
    rng = np.random.default_rng(1)
    p = gru.Params.init(3)
    x = rng.integers(0, 256, (20, 7)).astype(np.uint8)
    mask = np.zeros((20, 7), np.float32)
    mask[:12] = 1
    assert np.allclose(gru.pooled(p, x, mask), gru.pooled(p, x[:12]), atol=1e-4)


def test_windows_cover_texts():
    buf, offs = text_bytes(__import__("pyarrow").array(["a" * 130, "", None, "b", "c" * STEPS]))
    start, size, doc = windows(buf, offs)
    seen = np.zeros(len(buf), int)
    for s, n, d in zip(start, size, doc):
        seen[s:s + n] += 1
        assert offs[d] <= s and s + n <= offs[d + 1]
    assert (seen == 1).all()


def test_probabilities_do_not_depend_on_batches():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdé .", k=rng.randint(0, 700))) for _ in range(40)]
    model = LanguageModel(["a", "b", "c"], gru.Params.init(3))
    import pyarrow as pa

    both = document_probabilities(model, *text_bytes(pa.array(texts)))
    for t, want in zip(texts[:10], both):
        assert np.allclose(document_probabilities(model, *text_bytes(pa.array([t])))[0], want, atol=1e-4)
        assert not t or want.sum() == pytest.approx(1, abs=1e-3)
    assert LANES >= 1


def test_document_probabilities_byte_by_byte():
    """The batched forward pass and pooling against one byte at a time, in plain Python floats."""
    import math

    from rampart.llm.gru import Params
    from rampart.llm.langid import STEPS, LanguageModel, document_probabilities

    p = Params.init(3, seed=9)
    rng = np.random.default_rng(9)
    p.w = [(m + rng.normal(0, 0.3, m.shape)).astype(np.float32) for m in p.w]

    def states(way, window):
        h, out = [0.0] * p.hidden, [None] * len(window)
        for t in range(len(window)) if way == 0 else range(len(window) - 1, -1, -1):
            inp = [*p.emb[:, window[t]].tolist(), *h, 1.0]
            g = [sum(a * b for a, b in zip(row, inp)) for row in p.w[way].tolist()]
            n = p.hidden
            z, r = ([min(1.0, max(0.0, x + 0.5)) for x in g[a:a + n]] for a in (0, n))
            cand = [math.tanh(g[2 * n + i] + r[i] * g[3 * n + i]) for i in range(n)]
            h = [z[i] * h[i] + (1 - z[i]) * cand[i] for i in range(n)]
            out[t] = h
        return out

    texts = [b"a", b"", "The quick brown f\u00f6x ".encode() * 9, bytes(range(1, 65)), b"x" * 130]
    got = document_probabilities(LanguageModel(["a", "b", "c"], p), np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    for i, t in enumerate(texts):
        total = np.zeros(3)
        for k in range(0, len(t), STEPS):
            w = t[k:k + STEPS]
            for f, b in zip(states(0, w), states(1, w)):
                x = [sum(a * c for a, c in zip(row, [*f, *b, 1.0])) for row in p.out.tolist()]
                e = np.exp(np.array(x) - max(x))
                total += e / e.sum()
        assert np.allclose(got[i], total / max(1, len(t)), atol=2e-5)


def test_held_out_accuracy(spark):
    got = op5_language_id(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = got.join(docs, "doc_id").select("held_out", (F.col("lang_pred") == F.col("lang")).alias("ok"), "score", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("rest")).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == r.rest and 0 <= r.score <= 1 for r in rows)
    held = [r.ok for r in rows if r.held_out]
    assert len(held) > 100 and sum(held) / len(held) > 0.97


def test_language_edges(spark):
    rows = [(1, "the and the of", "en", "p"), (2, "der die das und", "de", "p"), (3, None, "en", "p"), (4, "", "de", "p"), (5, "123 !?", None, "p"),
            (None, "the the", None, "p"), (2, "der die das und", "de", "p"), (6, "x" * 100_000, None, "p")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = train_language_model(d, "true")
    assert model.langs == ["de", "en"]
    got = predict_languages(d, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == len(rows)
    for key in ((3, None), (4, ""), (5, "123 !?")):
        assert by[key].lang_pred == "und" and by[key].score == 0
    assert by[1, "the and the of"].lang_pred == "en" and by[2, "der die das und"].lang_pred == "de"
    assert by[6, "x" * 100_000].lang_pred in model.langs
    none = train_language_model(d, "false")
    assert none.langs == [] and {r.lang_pred for r in predict_languages(d, none).collect()} == {"und"}
    assert predict_languages(d.limit(0), model).collect() == []


def test_words_and_batches():
    import pyarrow as pa

    texts = ["a b  c\nd", "", "é x y", None, " z ", "  ", "A a"]
    buf, offs = text_bytes(pa.array(texts))
    w = Words(buf, offs, lower=True)
    assert [bytes(buf[s:e]).decode() for s, e in zip(w.start, w.end)] == ["a", "b", "c", "d", "é x", "y", "z", "A", "a"]
    assert w.n_words.tolist() == [4, 0, 2, 0, 1, 0, 2] and w.hash[0] == w.hash[-1] == w.hash[-2] != w.hash[1]
    big = pa.record_batch({"text": ["x" * 10] * 25, "k": list(range(25))})
    cut = list(batches_of([big, big], 35, "text"))
    assert [len(t) for t in cut] == [3] * 16 + [2] and sum((t.column("k").to_pylist() for t in cut), []) == [*range(25), *range(25)]


PAGES = "page_id long, url string, html string, digest string, run long, at long, captured timestamp"


def page_frame(spark, rows):
    import datetime

    return spark.createDataFrame([(*r, "d", 1, 2, datetime.datetime(2024, 1, 1 + (i * 7) % 28)) for i, r in enumerate(rows)], PAGES)


def test_histories(spark):
    rng = random.Random(4)
    bodies = ["<p>" + "x" * rng.randint(80, 400) + "é" * rng.randint(0, 9) for _ in range(12)]
    rows = [(i * 3, rng.choice(["http://www.B.org:80/a?q=1#f", "https://a.b.org/x y", "", "no url", "http://[bad", None, f"http://h{i % 4}.com/p"]), rng.choice(bodies)) for i in range(120)]
    rows += [(900, "u", None), (901, "u", ""), (902, "u", "short"), (903, "u", "short"), (904, "a\r\nb", "z" * 300_000), (None, "n", bodies[0]), (None, "n", "only here " * 20),
             (None, "n", "only here " * 20), rows[0]]
    got = capture_histories(page_frame(spark, rows), captured=F.col("captured")).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and f != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    got.sort(key=lambda r: (r.key_range, r.place))
    order = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert order == sorted(order)
    assert capture_histories(page_frame(spark, []).limit(0)).collect() == []


def test_many_ranges_are_in_global_order(spark):
    rows = [(i, f"http://h{i * 37 % 50}.com/", f"body {i} " * 5) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several archives
    manifest = write_archives(page_frame(spark, rows), new_folder(spark, "w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = merge_runs(read_runs(manifest), range_rows=60).collect()
    assert len({r.key_range for r in got}) >= 5 and len({r.run for r in got}) >= 2
    got.sort(key=lambda r: (r.key_range, r.place))
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and len(set(keys)) == 400
    one = got[17]
    with open_file(one.uri) as f:
        f.seek(one.offset)
        raw = f.read(one.length)
    _, size, content = next(members(io.BytesIO(raw)))
    assert size == one.length and content.startswith(b"WARC/1.1\r\n")


def test_ranges_of_many_small_archives(spark):
    """Runs of a few captures give range cuts too."""
    rows = [(i, f"http://h{i * 37 % 50}.com/", f"body {i} " * 5) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    runs = read_runs(write_archives(page_frame(spark, rows), new_folder(spark, "w")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = merge_runs(runs, range_rows=30).collect()
    assert len({r.run for r in got}) > 20 and len({r.key_range for r in got}) >= 8
    got.sort(key=lambda r: (r.key_range, r.place))
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == 300


def test_damaged_archive_is_refused():
    import zlib

    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    rec = record_bytes(1, "http://a/", "2024-01-01T00:00:00Z", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "1")
    raw = c.compress(rec) + c.flush()
    assert [m[2] for m in members(io.BytesIO(raw * 3), chunk=7)] == [rec] * 3
    with pytest.raises(ValueError):
        list(members(io.BytesIO(raw[:-9])))


def test_loser_tree():
    rng = random.Random(1)
    for k in range(14):
        runs = [sorted(rng.choices(range(40), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_url_key():
    assert url_key("http://www.Example.com:80/A?b=1#c") == "com,example)/a?b=1"
    assert url_key(None) == "" and url_key("http://a.b:8080") == "b,a:8080)/"
