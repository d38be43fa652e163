"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Documents are tokenised once (an end id closes each); those longer than a
sequence are cut into pieces.  Piece lengths are small rows: they are written
to the shared folder, dealt by hash into groups of about ``GROUP_PIECES`` (so
the number of groups grows with the data, and each holds a like mix of lengths),
and each group is packed by one task:

1. fill a sequence greedily: always the longest piece that still fits;
2. take out its smallest piece if two unpacked pieces fit the gap this leaves
   more tightly.

Defined results: null text is an empty text (one piece, the end id).  Repeated
rows and equal ids are pieces of their own; ties of length go by row order.
Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.common import table, text_chunks, tidied, written
from clickcast.llm.word_ids import BATCH_CHARS, default_vocabulary, word_ids

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 16384
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document; ``slot`` numbers a task's rows."""
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, slot = word_ids(vocabulary), 0
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].fillna("").tolist()
            for a, b in text_chunks(texts, BATCH_CHARS):
                rows = []
                found, bounds = encode(texts[a:b])
                for key, first, last in zip(ids[a:b], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    got = found[first:last].tobytes() + end
                    for k, at in enumerate(range(0, len(got), width)):
                        part = got[at:at + width]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), slot))
                        slot += 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "slot"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        tidied(cut), PIECE_SCHEMA)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item of the given lengths (1 to ``capacity``)."""
    count = np.bincount(lengths, minlength=capacity + 1)
    by_length = np.argsort(lengths, kind="stable")
    top = np.cumsum(count)  # items of one length are handed out from the last
    sizes = np.arange(capacity + 1)
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    left, number = len(lengths), 0
    while left:
        below = np.maximum.accumulate(np.where(count > 0, sizes, 0))  # longest unpacked item up to a length
        gap, taken = capacity, []
        while gap:
            n = int(below[gap])
            while n and not count[n]:
                n = int(below[n - 1])
            if not n:
                break
            k = min(int(count[n]), gap // n)
            taken += [n] * k
            count[n] -= k
            gap -= n * k
        if gap and taken:
            smallest = taken[-1]
            wide = gap + smallest
            large = np.flatnonzero(count[:smallest])
            if len(large):
                below = np.maximum.accumulate(np.where(count[:smallest] > 0, sizes[:smallest], 0))
                other = below[np.minimum(large, wide - large)]
                alone = (other == large) & (count[large] < 2)
                other = np.where(alone, below[large - 1], other)
                total = np.where(other > 0, large + other, 0)
                best = int(total.argmax())
                if total[best] > smallest:
                    taken[-1:] = [int(large[best]), int(other[best])]
                    count[smallest] += 1
                    count[large[best]] -= 1
                    count[other[best]] -= 1
        offset = 0
        for n in taken:
            top[n] -= 1
            item = by_length[top[n]]
            bins[item], offsets[item] = number, offset
            offset += n
        left -= len(taken)
        number += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (as written by :func:`token_pieces`) plus ``sequence_id`` and ``offset``."""
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    kept = [c for c in pieces.columns if c != "slot"]
    schema = pieces.select(*kept).schema.simpleString()[len("struct<"):-1].replace(":", " ")

    def pack(key, group: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_two_fit(group["length"].to_numpy(dtype=np.int64), capacity)
        return group[kept].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "slot"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(pack, f"{schema}, sequence_id long, offset long")


def pack_documents(spark, docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return pack_pieces(written(spark, token_pieces(docs, vocabulary, capacity), "pieces"), capacity)


@register("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), default_vocabulary())


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pack all kept documents."""
    return pack_documents(spark, docs, default_vocabulary())
