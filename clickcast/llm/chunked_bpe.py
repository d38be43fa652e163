"""BPE encoding and decoding that encodes text shared by several documents once.

Every text is cut where a rolling hash of the last 32 bytes says so, so equal
passages are cut alike wherever they stand.  A chunk is the part of a cut from
its first to its last white space; what lies between two chunks is their join.

1. Chunk hashes are counted.  Those seen twice set a bit in a bitmap of fixed size
   (a false hit moves a text for nothing and changes no result).
2. Chunks whose bit is set meet by their 128-bit hash; those that really occur
   twice are encoded once and written as a dictionary (hash, ids).
3. Texts without a set bit are encoded where they are.  The others meet their
   dictionary entries by the hash of the whole text and encode only the rest.
4. Joins are repaired: the text from the last words of one chunk to the first
   words of the next is encoded again, and taken if its ids begin and end with the
   ids that the two chunks have there; else the window doubles, up to both chunks
   whole, and then to the whole text.  White space ends every token of the
   vocabularies this module accepts, so agreement at a word's edge is exact.

Hot chunks and hot texts: entries used often are copied over salts, and the rows
that look for them are dealt over these (:func:`join_hot`).

Defined results: null text is an empty text (no ids); equal rows and ids are rows of
their own; very long texts are whole; empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.common import join_hot, table, text_chunks, written
from clickcast.llm.word_ids import BATCH_CHARS, WordIds, default_vocabulary, load_tokenizer, word_ids

WINDOW = 32
CUT_BITS = 10
MIN_CUT, MAX_CUT = 256, 8192
BITMAP_BITS = 26
SPACES = np.isin(np.arange(256), list(b" \t\n\r\v\f"))
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, size=256, dtype=np.uint32)

Chunks = list[tuple[int, int]]


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """The sum of ``GEAR[data[i - j]] << j`` over the last ``WINDOW`` bytes, modulo 2^32, at every position i."""
    h, step = GEAR[data], 1
    while step < WINDOW:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step)
        h = h + older
        step *= 2
    return h


def cut_points(hits: np.ndarray, n: int) -> list[int]:
    """0, cuts at least ``MIN_CUT`` and at most ``MAX_CUT`` apart (at hits where possible), n."""
    cuts = [0]
    for at in [*hits.tolist(), n]:
        if at < n and at - cuts[-1] < MIN_CUT:
            continue
        while at - cuts[-1] > MAX_CUT:
            cuts.append(cuts[-1] + MAX_CUT)
        if at > cuts[-1]:
            cuts.append(at)
    return cuts


class Cutter:
    """Chunks of a batch of texts, as byte ranges of each text."""

    def __init__(self, texts: list[str]):
        self.data = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = np.frombuffer(b"".join(self.data), dtype=np.uint8)
        ends = np.cumsum([len(d) for d in self.data])
        hits = np.flatnonzero(rolling_hash(joined) >> np.uint32(32 - CUT_BITS) == 0) + 1 if len(joined) else joined
        space = np.flatnonzero(SPACES[joined])
        self.chunks: list[Chunks] = []
        self.spaces: list[np.ndarray] = []
        for n, end in zip(map(len, self.data), ends.tolist()):
            first = end - n
            here = space[np.searchsorted(space, first):np.searchsorted(space, end)] - first
            mine = hits[np.searchsorted(hits, first + WINDOW):np.searchsorted(hits, end)] - first
            self.spaces.append(here)
            self.chunks.append(self._chunks(cut_points(mine, n), here, n))

    @staticmethod
    def _chunks(cuts: list[int], space: np.ndarray, n: int) -> Chunks:
        if len(cuts) < 3:
            return [(0, n)] if n else []
        at = np.searchsorted(space, cuts)
        out = []
        for k in range(len(cuts) - 1):
            start = 0 if k == 0 else int(space[at[k]]) + 1 if at[k] < len(space) else n
            end = n if k == len(cuts) - 2 else int(space[at[k + 1] - 1]) if at[k + 1] > 0 else 0
            if start < end and (not out or start > out[-1][1]):
                out.append((start, end))
        # An empty chunk at an end without one makes what lies there a join as well.
        if not out or out[0][0] > 0:
            out.insert(0, (0, 0))
        if out[-1][1] < n:
            out.append((n, n))
        return out

    def keys(self, doc: int) -> list[tuple[int, bytes]]:
        """(number, 128-bit hash) of each chunk that is not empty."""
        return [(k, hashlib.blake2b(self.data[doc][start:end], digest_size=16).digest())
                for k, (start, end) in enumerate(self.chunks[doc]) if start < end]


def _bit(key: bytes) -> int:
    return int.from_bytes(key[:8], "little") & ((1 << BITMAP_BITS) - 1)


def _text_batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    for batch in batches:
        texts = batch["text"].fillna("").tolist()
        for a, b in text_chunks(texts, BATCH_CHARS):
            yield batch.iloc[a:b], texts[a:b]


def repeated_bits(docs: DataFrame) -> np.ndarray:
    """A bitmap of 2^BITMAP_BITS bits: the hash of each chunk that occurs twice has its bit set."""

    def keys(batches):
        for _, texts in _text_batches(batches):
            cut = Cutter(texts)
            bits = np.array([_bit(key) for d in range(len(texts)) for _, key in cut.keys(d)], dtype=np.int64)
            bit, n = np.unique(bits, return_counts=True)
            yield pd.DataFrame({"bit": bit, "n": n})

    seen = docs.select("text").mapInPandas(keys, "bit long, n long")
    words = (seen.groupBy("bit").agg(F.sum("n").alias("n")).where("n > 1")
             .groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")))
    got = words.toPandas()  # at most 2^(BITMAP_BITS - 6) rows
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    bitmap[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return bitmap


def _hits(bitmap: np.ndarray, keys: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The keys whose bit is set."""
    bits = np.array([_bit(key) for _, key in keys], dtype=np.int64)
    hit = ((bitmap[bits >> 6] >> (bits & 63)) & 1) == 1
    return [keys[j] for j in np.flatnonzero(hit).tolist()]


def chunk_dictionary(docs: DataFrame, bits, vocabulary: str) -> DataFrame:
    """key, ids (little-endian unsigned 32-bit), n: every chunk that occurs twice, encoded once."""

    def candidates(batches):
        for _, texts in _text_batches(batches):
            cut, found = Cutter(texts), {}
            for d in range(len(texts)):
                for k, key in _hits(bits.value, cut.keys(d)):
                    start, end = cut.chunks[d][k]
                    n = found[key][1] + 1 if key in found else 1
                    found[key] = (key, n, cut.data[d][start:end])
            yield pd.DataFrame(list(found.values()), columns=["key", "n", "chunk"])

    def encode(batches):
        encoder = word_ids(vocabulary)
        for batch in batches:
            texts = [c.decode("utf-8", "surrogatepass") for c in batch["chunk"]]
            for a, b in text_chunks(texts, BATCH_CHARS):
                ids, bounds = encoder(texts[a:b])
                part = batch.iloc[a:b]
                yield pd.DataFrame({"key": part["key"], "n": part["n"], "ids": [
                    ids[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]})

    return (docs.select("text").mapInPandas(candidates, "key binary, n long, chunk binary")
            .groupBy("key").agg(F.sum("n").alias("n"), F.first("chunk").alias("chunk")).where("n > 1")
            .mapInPandas(encode, "key binary, n long, ids binary"))


def encode_batch(texts: list[str], encoder: WordIds, known: list[dict[int, np.ndarray]]) -> list[np.ndarray]:
    """Ids of each text; ``known`` has the ids of some of its chunks by their number."""
    cut = Cutter(texts)
    fresh = [(d, k) for d, chunks in enumerate(cut.chunks) for k in range(len(chunks)) if k not in known[d]]
    part = lambda d, a, b: cut.data[d][a:b].decode("utf-8", "surrogatepass")
    ids, bounds = encoder([part(d, *cut.chunks[d][k]) for d, k in fresh])
    have = [dict(k) for k in known]
    for (d, k), a, b in zip(fresh, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        have[d][k] = ids[a:b]
    joins = repair_joins(cut, part, encoder, have)
    out = []
    for d, chunks in enumerate(cut.chunks):
        if any(joins.get((d, k), ()) is None for k in range(len(chunks) - 1)):
            out.append(encoder([texts[d]])[0])
            continue
        row = [np.empty(0, dtype="<u4")]
        for k in range(len(chunks)):
            row += [have[d][k], *([joins[d, k]] if k < len(chunks) - 1 else [])]
        out.append(np.concatenate(row))
    return out


def repair_joins(cut: Cutter, part: Callable, encoder: WordIds, have: list[dict]) -> dict[tuple[int, int], np.ndarray]:
    """(text, k) → the ids between its chunks k and k + 1; None where no window agrees."""
    out: dict[tuple[int, int], np.ndarray] = {}
    todo = [(d, k) for d, chunks in enumerate(cut.chunks) for k in range(len(chunks) - 1)]
    words = 1
    while todo:
        windows, whole = [], []
        for d, k in todo:
            (a, b), (c, e) = cut.chunks[d][k:k + 2]
            space = cut.spaces[d]
            left = int(np.searchsorted(space, b)) - words
            right = int(np.searchsorted(space, c)) + words - 1
            lo = max(a, int(space[left]) + 1) if left >= 0 else a
            hi = min(e, int(space[right])) if right < len(space) else e
            windows += [part(d, lo, hi), part(d, lo, b), part(d, c, hi)]
            whole.append(lo == a and hi == e)
        ids, bounds = encoder(windows)
        got = [ids[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        left_over = []
        for j, (d, k) in enumerate(todo):
            window, before, after = got[3 * j:3 * j + 3]
            x, y = len(before), len(window) - len(after)
            left, right = have[d][k], have[d][k + 1]
            if (x <= y and np.array_equal(window[:x], before) and np.array_equal(left[len(left) - x:], before)
                    and np.array_equal(window[y:], after) and np.array_equal(right[:len(after)], after)):
                out[d, k] = window[x:y]
            elif whole[j]:
                out[d, k] = None
            else:
                left_over.append((d, k))
        todo, words = left_over, words * 2
    return out


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str,
                     columns: Callable[[list[np.ndarray]], dict[str, list]] | None = None,
                     schema: str = "ids array<int>") -> DataFrame:
    """One row per document: doc_id and what ``columns`` makes of the ids of a batch; by default the ids."""
    columns = columns or (lambda ids: {"ids": [i.astype(np.int32) for i in ids]})
    schema = f"doc_id string, {schema}"  # pandas has no whole numbers beside nulls

    def finish(batch: pd.DataFrame, ids: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": batch["doc_id"].tolist(), **columns(ids)})

    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bits = spark.sparkContext.broadcast(repeated_bits(docs))
    dictionary = written(spark, chunk_dictionary(docs, bits, vocabulary), "chunk-ids")

    def in_place(batches):
        encoder = word_ids(vocabulary)
        for batch, texts in _text_batches(batches):
            cut = Cutter(texts)
            own = [d for d in range(len(texts)) if not _hits(bits.value, cut.keys(d))]
            if own:
                yield finish(batch.iloc[own], encode_batch([texts[d] for d in own], encoder, [{} for _ in own]))

    def shared(batches):
        for batch, texts in _text_batches(batches):
            cut = Cutter(texts)
            yield batch[[bool(_hits(bits.value, cut.keys(d))) for d in range(len(texts))]]

    def wanted(batches):
        for batch, texts in _text_batches(batches):
            cut, rows = Cutter(texts), []
            for d, whole in enumerate(batch["whole"]):
                rows += [(whole, k, key) for k, key in _hits(bits.value, cut.keys(d))]
            yield pd.DataFrame(rows, columns=["whole", "k", "key"])

    def fill(batches):
        encoder = word_ids(vocabulary)
        for batch, texts in _text_batches(batches):
            known = [dict(zip(ks, (np.frombuffer(i, dtype="<u4") for i in ids))) if ks is not None else {}
                     for ks, ids in zip(batch["ks"], batch["ids"], strict=True)]
            yield finish(batch, encode_batch(texts, encoder, known))

    whole = F.unhex(F.md5("text")).alias("whole")
    moved = docs.mapInPandas(shared, "doc_id string, text string").select("doc_id", "text", whole)
    wants = docs.select("text", whole).mapInPandas(wanted, "whole binary, k int, key binary")
    # Equal texts want the same: one of each text asks, with the number of texts that do.
    wants = wants.groupBy("whole", "k").agg(F.first("key").alias("key"), F.count("*").alias("texts"))
    entries = join_hot(wants, dictionary, ["key"], F.col("whole"), how="inner")
    entries = entries.groupBy("whole").agg(F.max("texts").alias("n"), F.collect_list(F.struct("k", "ids")).alias("e"))
    entries = entries.select("whole", "n", F.col("e.k").alias("ks"), F.col("e.ids").alias("ids"))
    entries = written(spark, entries, "text-chunks")
    filled = join_hot(moved, entries, ["whole"], F.col("doc_id"), how="left")
    both = docs.mapInPandas(in_place, schema).unionByName(
        filled.select("doc_id", "text", "ks", "ids").mapInPandas(fill, schema))
    return both.withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(tokens: np.ndarray, ids: np.ndarray) -> str:
    """The text of ids under a vocabulary without a decoder: its tokens, a space between two."""
    return " ".join(tokens[ids].tolist())


def token_strings(vocabulary: str) -> np.ndarray:
    tokenizer = load_tokenizer(vocabulary)
    if tokenizer.decoder is not None:
        raise ValueError("this vocabulary has a decoder of its own")
    return np.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())], dtype=object)


def digests(vocabulary: str) -> Callable[[list[np.ndarray]], dict[str, list]]:
    """Number of tokens, SHA-256 of the ids in decimal, SHA-256 of the decoded text."""
    state: dict[str, np.ndarray] = {}

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def columns(ids: list[np.ndarray]) -> dict[str, list]:
        if not state:
            state["tokens"] = token_strings(vocabulary)
            state["numbers"] = np.array([str(i) for i in range(len(state["tokens"]))], dtype=object)
        return {"n_tokens": [len(i) for i in ids],
                "ids_sha256": [sha(decode(state["numbers"], i)) for i in ids],
                "decoded_sha256": [sha(decode(state["tokens"], i)) for i in ids]}

    return columns


@register("op12_chunked_bpe")
def op12_chunked_bpe(spark, sf_dir: str) -> DataFrame:
    vocabulary = default_vocabulary()
    return encode_documents(spark, table(spark, sf_dir, "documents"), vocabulary, digests(vocabulary),
                            "n_tokens long, ids_sha256 string, decoded_sha256 string")
