"""Language of whole texts by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampart.llm.gru import Params, pooled, train
from rampart.llm.textkit import batches_of, text_bytes

UNKNOWN = "und"
STEPS = 64  # bytes of a window; the state starts anew in each
LANES = 4096


@dataclass
class LanguageModel:
    langs: list[str]
    params: Params | None = None
    sampled: dict[str, int] = field(default_factory=dict)
    floor: float = 0.0  # a lower score is that of a text in none of the languages
    taught: np.ndarray | None = None  # of each byte value, whether the fit saw it; the others speak for no language


def windows(buf: np.ndarray, offs: np.ndarray):
    """Starts, sizes and documents of the windows that cover every byte of every text."""
    n = -(-np.diff(offs) // STEPS)
    doc = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = offs[doc] + k * STEPS
    return start, np.minimum(STEPS, offs[doc + 1] - start), doc


def train_language_model(docs: DataFrame, learn: str, docs_per_lang: int = 600, windows_per_doc: int = 6,
                         text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Fit the network on a bounded sample: of the rows where the SQL condition ``learn`` holds
    and the label is not null, at most ``docs_per_lang`` documents of each label (lowest hash
    of ``key``), and at most ``windows_per_doc`` windows spread evenly over each text. As many
    documents more, which the fit does not see, give the model's floor."""
    rows = docs.where(learn).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()) \
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(2**31)).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([])
    langs = sorted(counts)
    share = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, 6 * docs_per_lang / counts[k]))]), F.col("lang"))
    near = rows.where(F.col("h") <= share * (2**31)).where(F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))

    def cut(batches):
        number = count(TaskContext.get().partitionId() << 32)
        for t in batches_of(batches, 1 << 20, "text"):
            buf, offs = text_bytes(t.column("text"))
            start, size, doc = windows(buf, offs)
            first = np.searchsorted(doc, np.arange(len(t) + 1))
            out, fits = [], t.column("fit").to_pylist()
            for d, name in enumerate(t.column("lang").to_pylist()):
                n, doc = first[d + 1] - first[d], next(number)
                for k in sorted({int(i * n // windows_per_doc) for i in range(windows_per_doc)} if n else ()):
                    w = first[d] + k
                    out.append((name, buf[start[w]:start[w] + size[w]].tobytes(), doc, fits[d], k))
            cols = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.int64()))],
                                             names=["lang", "bytes", "doc", "fit", "window"])

    sample = near.withColumn("rank", rank).where(F.col("rank") <= 2 * docs_per_lang) \
        .select("lang", "text", (F.col("rank") <= docs_per_lang).alias("fit")) \
        .mapInArrow(cut, "lang string, bytes binary, doc long, fit boolean, window long").toPandas()
    got = sample[sample["fit"]].sort_values(["lang", "bytes"], kind="stable")  # the fit does not depend on row order
    langs = sorted(set(got["lang"]))
    if not langs:
        return LanguageModel([])
    y = np.searchsorted(langs, got["lang"].to_numpy().astype(str))
    x = np.zeros((len(got), STEPS), np.uint8)
    mask = np.zeros((len(got), STEPS), np.float32)
    for i, b in enumerate(got["bytes"]):
        x[i, :len(b)] = np.frombuffer(b, np.uint8)
        mask[i, :len(b)] = 1
    model = LanguageModel(langs, train(x, mask, y, len(langs)), got["lang"].value_counts().to_dict())
    model.taught = np.bincount(x[mask > 0], minlength=256) > 0
    unseen = sample[~sample["fit"]]
    model.floor = _floor(model, unseen if len(unseen) else sample)
    return model


def _floor(model: LanguageModel, sample) -> float:
    """Halfway between chance and the score that all but one in a thousand labelled texts reach:
    what lies below looks like none of the languages."""
    if len(model.langs) < 2:
        return 0.0
    texts = [b"".join(x) for _, x in sample.sort_values(["doc", "window"]).groupby("doc")["bytes"]]
    probs = document_probabilities(model, np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    chance = 1 / len(model.langs)
    return chance + max(0.0, float(np.quantile(probs.max(axis=1), 0.001, method="lower")) - chance) / 2


def document_probabilities(model: LanguageModel, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, langs): probabilities of all positions of a text, averaged; empty texts 0. Bytes that
    the fit never saw count evenly for all languages."""
    start, size, doc = windows(buf, offs)
    total = np.zeros((len(offs) - 1, len(model.langs)))
    full = size == STEPS
    for group in (np.flatnonzero(full), np.flatnonzero(~full)):
        for i in range(0, len(group), LANES):
            g = group[i:i + LANES]
            at = start[g] + np.arange(STEPS)[:, None]
            if size[g[0]] == STEPS:
                probs = pooled(model.params, buf[at], known=model.taught)
            else:
                mask = (np.arange(STEPS)[:, None] < size[g]).astype(np.float32)
                probs = pooled(model.params, buf[np.minimum(at, len(buf) - 1)], mask, model.taught)
            for k in range(len(model.langs)):
                total[:, k] += np.bincount(doc[g], probs[k], minlength=len(total))
    return total / np.maximum(np.diff(offs), 1)[:, None]


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text", pred_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """All columns of ``docs`` with lang_pred and score, or the names given (replacing columns of
    those names).

    The score is the pooled probability of the predicted language, 0 to 1; ties go to the first
    label in order. A null text or one without a letter, or a model that learned no label,
    gives ``und`` and 0. Every byte of a text is labelled, however long; repeated rows get the
    same answer; an empty table gives no rows.
    """
    src = docs.drop(pred_name, score_name)
    names = src.columns

    def run(batches):
        for t in batches_of(batches, 1 << 20, text):
            texts = t.column(text).to_pylist()
            lettered = np.array([s is not None and any(map(str.isalpha, s)) for s in texts], bool)
            if model.langs:
                probs = document_probabilities(model, *text_bytes(t.column(text)))
                best = probs.argmax(axis=1)
                score = np.clip(probs[np.arange(len(best)), best], 0, 1)
                pred = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
            else:
                score, pred = np.zeros(len(t)), [UNKNOWN] * len(t)
            score = np.where(lettered, score, 0.0)
            out = pa.table([*t.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, pred_name, score_name])
            yield from out.to_batches()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema), f"`{pred_name}` string", f"`{score_name}` double"])
    return src.mapInArrow(run, schema)


#: documents whose id hashes to 0 are never learned from
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)"


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Thin query: learn from the documents that are not held out, label the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_language_model(docs, f"not {HELD_OUT}")
    held = docs.select("doc_id", "text", F.expr(HELD_OUT).alias("held_out"))
    return predict_languages(held, model).select("doc_id", "held_out", "lang_pred", "score")
