"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, characters that are no letters become spaces, and every
1- to 3-gram with at least one letter is hashed into ``n_buckets``.  Training
counts (language, bucket) over all labelled rows: a task sums its rows in
numpy, Spark adds the tasks' sparse counts, and the driver gets one smoothed
log-probability matrix of ``languages x n_buckets`` (bounded, checked by
``MAX_LANGS``).  The matrix is broadcast; scoring gathers it at the n-grams
that occur, batch by batch, and sums by document.

Defined results: null text or a text without letters: ``und``, score 0.  With no
training row every text is ``und``.  Ties: the language that sorts first.
Repeated rows are scored alike, long texts whole.  Extra columns are kept;
input columns called like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.common import free_name, give_back, table, text_chunks, tidied

N_BUCKETS = 1 << 15
GRAM_SIZES = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGS = 512
CHUNK_CHARS = 1 << 17
UNKNOWN = "und"
_SPACE = 32


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


class Grams:
    """Turns a chunk of texts into bucket ids by position, with document starts."""

    def __init__(self, n_buckets: int, sizes=GRAM_SIZES):
        self.n_buckets, self.sizes, self.letters = n_buckets, sizes, _letter_table()

    def __call__(self, texts: list[str]):
        """(bucket ids per gram size, document start offsets, letters per document).

        Each text is followed by one zero; grams over it, or without a letter, get
        the id ``n_buckets``.
        """
        low = [t.lower() for t in texts]
        codes = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lengths = np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low))
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        ends = starts + lengths - 1
        is_letter = self.letters[codes]
        codes = np.where(is_letter, codes, np.uint32(_SPACE))
        letters = np.add.reduceat(is_letter.astype(np.int64), starts)
        out = []
        for n in self.sizes:
            m = len(codes) - n + 1
            if m <= 0:
                out.append(np.full(len(codes), self.n_buckets, dtype=np.int64))
                continue
            h = np.full(m, 2166136261 + n, dtype=np.uint32)
            some = np.zeros(m, dtype=bool)
            for j in range(n):
                h = (h ^ codes[j:j + m]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                some |= is_letter[j:j + m]
            ids = np.full(len(codes), self.n_buckets, dtype=np.int64)
            ids[:m] = np.where(some, h % np.uint32(self.n_buckets), self.n_buckets)
            for j in range(n):
                ids[np.maximum(ends - j, 0)] = self.n_buckets  # grams over a text's end
            out.append(ids)
        return out, starts, letters


def train_language_id(docs: DataFrame, text: str = "text", lang: str = "lang",
                      n_buckets: int = N_BUCKETS) -> tuple[list[str], np.ndarray]:
    """(sorted languages, log-probability matrix): last column log prior."""
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, sums = Grams(n_buckets), {}
        for batch in batches:
            for code, part in batch.groupby("lang", sort=False):
                texts = part["text"].tolist()
                if code not in sums:
                    sums[code] = np.zeros(n_buckets + 1, dtype=np.int64)
                for a, b in text_chunks(texts, CHUNK_CHARS):
                    ids, _, letters = grams(texts[a:b])
                    for x in ids:
                        sums[code][:n_buckets] += np.bincount(x, minlength=n_buckets + 1)[:n_buckets]
                    sums[code][n_buckets] += int((letters > 0).sum())  # documents, for the prior
        for code, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": code, "bucket": at.astype(np.int32), "n": total[at]})

    counts = labelled.mapInPandas(tidied(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    langs = sorted(r[0] for r in labelled.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages; the model would not be bounded")
    found = counts.toPandas()  # at most languages x (n_buckets + 1) rows
    matrix = np.zeros((len(langs), n_buckets + 1))
    at = {code: i for i, code in enumerate(langs)}
    matrix[found["lang"].map(at).to_numpy(dtype=np.int64), found["bucket"].to_numpy(dtype=np.int64)] = found["n"]
    seen = matrix[:, n_buckets] > 0  # a language without one letter cannot be predicted
    langs, matrix = [x for x, k in zip(langs, seen) if k], matrix[seen]
    docs_per = matrix[:, n_buckets].copy()
    grams = matrix[:, :n_buckets] + SMOOTHING
    model = np.empty_like(matrix)
    model[:, :n_buckets] = np.log(grams) - np.log(grams.sum(axis=1, keepdims=True))
    model[:, n_buckets] = np.log(docs_per) - np.log(max(docs_per.sum(), 1))
    return langs, model


def identify_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (posterior of that language)."""
    langs, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        n_buckets = m.shape[1] - 1
        grams, prior = Grams(n_buckets), m[:, n_buckets].astype(np.float64)
        logp = [np.append(row[:n_buckets], np.float32(0)) for row in m]
        for batch in batches:
            texts = batch.fillna("").tolist()
            preds, scores = [], []
            for a, b in text_chunks(texts, CHUNK_CHARS):
                ids, starts, letters = grams(texts[a:b])
                total = np.repeat(prior[None, :], b - a, axis=0)
                for x in ids:
                    for k, row in enumerate(logp):
                        total[:, k] += np.add.reduceat(row[x], starts, dtype=np.float64)
                if not langs:
                    letters = np.zeros(b - a)
                    best, post = np.zeros(b - a, dtype=int), np.zeros(b - a)
                else:
                    best = total.argmax(axis=1)
                    post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                preds += [langs[k] if n else UNKNOWN for k, n in zip(best, letters)]
                scores += np.where(letters > 0, post, 0.0).tolist()
            yield pd.DataFrame({"lang_pred": pd.Series(preds, dtype=object), "score": pd.Series(scores, dtype=float)})
        give_back()

    found = free_name(docs, "found")
    return docs.withColumn(found, predict(F.col(text))).withColumns({
        "lang_pred": F.col(found)["lang_pred"], "score": F.col(found)["score"]}).drop(found)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fitted_on_two_thirds(docs: DataFrame):
    """The model of all labelled documents that are not held out."""
    return train_language_id(docs.where(~held_out(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


@register("op3_language_id")
def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted_on_two_thirds(docs)
    return identify_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language cannot be told (``und``) go."""
    model = fitted_on_two_thirds(docs)
    return identify_language(docs, model).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)
