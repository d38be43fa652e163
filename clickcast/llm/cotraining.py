"""Quality classifier by co-training of two views.

The *content* view is the frequency of hashed byte trigrams of the text; the
*metadata* view is what describes the page without its words: source, language,
length and the layout's shares (lines, blanks, digits, capitals, punctuation).
Each view has a logistic regression and a sigmoid that calibrates it on rows its
fit did not see (folds dealt by class).

1. *Pseudo-labels.*  A round is one pass over all documents (those of the fit too, so
   that unseen rows meet the class sums as any document does): where a view's
   calibrated probability is beyond ``CONFIDENT``, the document counts for that
   class in the other view.  The pass returns class sums of that view's
   features, in whole numbers, so that no split of the table changes them.
2. *Exchange.*  The difference of the two class means, over the labelled rows'
   variances, is one more feature of the other view's regression, at the best of
   ``STRENGTHS``.  Means weigh both classes alike, whatever their shares.  Each fold
   has teachers and class sums of its own, none of which saw its rows, from the same
   pass.  A view takes its new model only if it ranks such unseen rows no worse and
   their log loss falls by more than a standard error; once neither does, another round would pick the same documents, and the rounds end.
3. *Combination.*  Weights of the two views' calibrated log-odds, drawn to equal
   ones, are fitted on unseen rows and score every document.

Only the labelled side is bounded: ``MAX_LABELLED`` labelled documents of the table
(those of smallest id hash), whose feature rows reach the driver; the labels of
others are not used.

Defined results: null or empty text: no trigram, all layout shares 0.  Null
source or language is a value of its own.  With fewer than two labelled documents
of either class every score is the share of good labels (0.5 without any).  Labels
with a null quality or id, or of no document, do not count; of several for a document
the largest does.  Of rows with one id the fit takes the smallest (text, lang, source).
Repeated rows score alike, long texts whole.  Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickcast.llm.catalog import register
from clickcast.llm.common import free_name, table, text_chunks

MAX_LABELLED = 3000
N_BUCKETS = 2048
N_HASHED = 64
N_META = 8 + N_HASHED
ROUNDS = 4
FOLDS = 4
CONFIDENT = 0.9
STRENGTHS = (1.0, 0.25)
LEAST_WEIGHT = 0.05  # so that no order is lost where few labels tell nothing
UNIT = 1 << 28
CHUNK_BYTES = 1 << 20
COLUMNS = ["text", "lang", "source"]


def _encoded(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in texts]


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two."""
    x = data.astype(np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - N_BUCKETS.bit_length() + 1)).astype(np.int64)


_CLASSES = np.zeros(256, dtype=np.int64)  # 0 other, 1 blank, 2 line end, 3 digit, 4 capital, 5 small, 6 punctuation
_CLASSES[[32, 9]], _CLASSES[10], _CLASSES[48:58], _CLASSES[65:91], _CLASSES[97:123] = 1, 2, 3, 4, 5
_CLASSES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 6


def metadata(raw: bytes, lang, source) -> np.ndarray:
    """Layout shares, log length, and one-hot hashes of source and language."""
    out = np.zeros(N_META, dtype=np.float32)
    if raw:
        out[:7] = np.bincount(_CLASSES[np.frombuffer(raw, dtype=np.uint8)], minlength=7) / len(raw)
    out[7] = np.log1p(len(raw)) / 10
    for name, value in (("lang", lang), ("source", source)):
        out[8 + zlib.crc32(f"{name}={value}".encode()) % N_HASHED] = 1
    return out


def content_logits(raw: list[bytes], weights: list[np.ndarray]) -> np.ndarray:
    """By model, the mean weight of each text's trigrams; a text's sum does not depend on its neighbours."""
    out = np.zeros((len(weights), len(raw)))
    for i, j in text_chunks(raw, CHUNK_BYTES):
        some = [k for k in range(i, j) if len(raw[k]) > 2]
        if some:
            sizes, ids, inside = _joined([raw[k] for k in some])
            for row, w in zip(out, weights):
                row[some] = np.add.reduceat(w[ids] * inside, np.cumsum(sizes) - sizes) / (sizes - 2)
    return out


def _joined(texts: list[bytes]):
    """(bytes, trigrams at every byte, whether one lies in its text) of texts of three bytes at least."""
    sizes = np.array([len(t) for t in texts])
    ids = np.append(trigrams(np.frombuffer(b"".join(texts), dtype=np.uint8)), [0, 0])
    inside = np.ones(len(ids), dtype=bool)
    ends = np.cumsum(sizes)
    inside[ends - 1] = inside[ends - 2] = False
    return sizes, ids, inside


def content_sums(raw: list[bytes], sides: np.ndarray) -> np.ndarray:
    """By model, trigram frequencies in units, summed by side (0 bad, 1 good; others do not count)."""
    out = np.zeros((len(sides), 2, N_BUCKETS), dtype=np.int64)
    for i, j in text_chunks(raw, CHUNK_BYTES):
        some = [k for k in range(i, j) if len(raw[k]) > 2 and (sides[:, k] >= 0).any()]
        if some:
            sizes, ids, inside = _joined([raw[k] for k in some])
            share = np.repeat(np.maximum(UNIT // (sizes - 2), 1), sizes) * inside
            for total, side in zip(out, sides[:, some]):
                at = np.repeat(side, sizes) * N_BUCKETS + ids
                used = at >= 0
                total += np.bincount(at[used], share[used], 2 * N_BUCKETS).astype(np.int64).reshape(2, -1)
    return out


class Logistic:
    """Ridge logistic regression by accelerated gradient steps on standardised features.

    ``lead``, if given, is a direction in the features; the rows' places along it, ``strength`` wide, are one
    more feature.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, lead: np.ndarray | None = None, strength: float = 1.0,
                 ridge: float = 1.0):
        mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-6
        z = ((x - mean) / (scale * np.sqrt(x.shape[1]))).astype(np.float32)
        along = np.zeros(len(x)) if lead is None else (x - mean) @ lead
        spread = (along.std() + 1e-6) / strength
        z = np.column_stack((z, along / spread)).astype(np.float32)
        w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        step = 2.0 / (1 + 4 * ridge / len(y))
        vw, vb = np.zeros_like(w), 0.0
        for _ in range(300):  # each row of z has norm about 1 in either part
            p = 1 / (1 + np.exp(-(z @ w.astype(np.float32) + b)))
            vw = 0.9 * vw - step * (z.T @ (p - y).astype(np.float32) / len(y) + 0.01 * ridge / len(y) * w)
            vb = 0.9 * vb - step * float((p - y).mean())
            w, b = w + 0.1 * vw, b + 0.1 * vb
        self.weights = w[:-1] / (scale * np.sqrt(x.shape[1]))
        if lead is not None:
            self.weights = self.weights + w[-1] / spread * lead
        self.bias = float(b - mean @ self.weights)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibration(logits: np.ndarray, y: np.ndarray, prior: float, ridge: float) -> tuple[np.ndarray, float]:
    """Weights (at least ``LEAST_WEIGHT``, drawn to ``prior``) and shift of a sigmoid over columns of log-odds, on Platt's targets."""
    good, bad = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack((logits, np.ones(len(y))))
    base, pull = np.array([prior] * (x.shape[1] - 1) + [0.0]), np.array([ridge] * (x.shape[1] - 1) + [1e-3])

    def cost(w: np.ndarray) -> float:
        at = x @ w
        return float((np.logaddexp(0, at) - target * at).sum() + (pull * (w - base) ** 2).sum() / 2)

    w = base.copy()
    for _ in range(50):  # Newton steps, halved until the cost falls
        p = _sigmoid(x @ w)
        move = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull),
                               x.T @ (p - target) + pull * (w - base))
        while np.abs(move).max() > 1e-6 and cost(w - move) > cost(w):
            move = move / 2
        w = w - move
        if np.abs(move).max() <= 1e-6:
            break
    return np.maximum(w[:-1], LEAST_WEIGHT), float(w[-1])


def ranking(logits: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve."""
    ranks, good = pd.Series(logits).rank().to_numpy(), int(y.sum())
    return float((ranks[y > 0].sum() - good * (good + 1) / 2) / (good * (len(y) - good)))


class View:
    """A model per fold that did not see its rows, one of all rows, and their common calibration.

    ``leads``: the direction for each of these models, none for the first round.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: np.ndarray, leads: list | None = None,
                 strength: float = 1.0):
        n = int(folds.max()) + 1
        leads = leads or [None] * (n + 1)
        self.models = [Logistic(x[folds != f], y[folds != f], leads[f], strength) for f in range(n)]
        self.models.append(Logistic(x, y, leads[n], strength))
        outside = np.empty(len(y))
        for f in range(n):
            outside[folds == f] = self.models[f].logit(x[folds == f])
        (slope,), self.shift = calibration(outside[:, None], y, 1.0, 1e-3)
        self.slope = float(slope)
        self.outside = np.clip(self.slope * outside + self.shift, -30, 30)
        p = _sigmoid(self.outside)
        self.losses = -(y * np.log(p) + (1 - y) * np.log(1 - p))
        self.ranking = ranking(self.outside, y)

    def better_than(self, other: View) -> bool:
        """Ranks unseen rows no worse, and its log loss is lower by more than one standard error of the difference."""
        gain = other.losses - self.losses
        return self.ranking >= other.ranking and gain.mean() > gain.std() / np.sqrt(len(gain))

    def parameters(self) -> tuple:
        """Weights and biases by model, calibration included."""
        return [m.weights * self.slope for m in self.models], [m.bias * self.slope + self.shift for m in self.models]


def dealt_folds(y: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """A fold for each row, dealt in turn within its class."""
    out = np.zeros(len(y), dtype=np.int64)
    for side in (0, 1):
        rows = np.flatnonzero(y == side)
        out[rows] = np.arange(len(rows)) % min(folds, int((y == 0).sum()), int((y == 1).sum()))
    return out


def _view_logits(raw, lang, source, views) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated log-odds by (view, model, row), and the metadata rows."""
    meta = np.stack([metadata(*row) for row in zip(raw, lang, source)])
    (words, word_bias), (page, page_bias) = views
    both = np.stack((content_logits(raw, words) + np.array(word_bias)[:, None],
                     np.stack(page) @ meta.T.astype(np.float64) + np.array(page_bias)[:, None]))
    return np.clip(both, -30, 30), meta


def pseudo_leads(docs: DataFrame, views: list[View], scales: list[np.ndarray],
                 confident: float = CONFIDENT) -> list[list]:
    """Per view and model the direction between the classes that the other view's model finds in all of ``docs``.

    None where that model is not confident of both classes.
    """
    shared = docs.sparkSession.sparkContext.broadcast([v.parameters() for v in views])
    far, n = float(np.log(confident / (1 - confident))), len(views[0].models)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # By view, model, side and feature; the last feature counts documents.
        totals = [np.zeros((n, 2, size + 1), dtype=np.int64) for size in (N_BUCKETS, N_META)]
        for batch in batches:
            if not len(batch):
                continue
            raw = _encoded(batch["text"])
            logits, meta = _view_logits(raw, batch["lang"], batch["source"], shared.value)
            sides = np.where(logits >= far, 1, np.where(logits <= -far, 0, -1))
            totals[0][..., :-1] += content_sums(raw, sides[1])
            units = np.rint(meta.astype(np.float64) * UNIT).astype(np.int64)
            for side in (0, 1):
                totals[0][:, side, -1] += (sides[1] == side).sum(axis=1)
                totals[1][:, side, :-1] += (sides[0] == side).astype(np.int64) @ units
                totals[1][:, side, -1] += (sides[0] == side).sum(axis=1)
        for k, total in enumerate(totals):
            model, side, feature = np.nonzero(total)
            yield pd.DataFrame({"view": k, "model": model, "side": side, "feature": feature,
                                "s": total[model, side, feature]})

    # To the driver: at most 2 x (folds + 1) x (N_BUCKETS + N_META + 2) sums.
    keys = ["view", "model", "side", "feature"]
    found = docs.select(*COLUMNS).mapInPandas(
        sums, "view int, model int, side int, feature int, s long").groupBy(*keys).agg(F.sum("s").alias("s")).toPandas()
    shared.unpersist()
    leads = []
    for k, scale in enumerate(scales):
        part, total = found[found["view"] == k], np.zeros((n, 2, len(scale) + 1))
        total[tuple(part[c].to_numpy() for c in keys[1:])] = part["s"]
        means = total[..., :-1] / UNIT / np.maximum(total[..., -1:], 1)
        leads.append([(m[1] - m[0]) / scale ** 2 if t[:, -1].all() else None for m, t in zip(means, total)])
    return leads


def co_train(docs: DataFrame, features: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Parameters of both views and of their combination; ``features`` and ``y`` are the labelled rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return {"share": float(y.mean()) if len(y) else 0.5}
    folds = dealt_folds(y)
    views = [View(x, y, folds) for x in features]
    spreads = [x.var(axis=0, dtype=np.float64) for x in features]
    scales = [np.sqrt(v + v.mean() + 1e-12) for v in spreads]  # rare features do not outweigh all others
    taken = 0
    for _ in range(rounds):
        better = False
        for k, leads in enumerate(pseudo_leads(docs, views, scales)):
            if leads[-1] is None:
                continue
            new = min((View(features[k], y, folds, leads, s) for s in STRENGTHS), key=lambda v: v.losses.mean())
            if new.better_than(views[k]):
                views[k], better = new, True
        if not better:
            break
        taken += 1
    weights, shift = calibration(np.column_stack([v.outside for v in views]), y, 0.5, 10.0)
    last = [([w[-1]], [b[-1]]) for w, b in (v.parameters() for v in views)]
    return {"views": last, "weights": weights, "shift": shift, "rounds": taken}


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int):
    """(features of the views, y) of the bounded labelled rows, in an order of their ids' hashes."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") > 0).cast("double")).alias("y"))
    some = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", *COLUMNS).join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(
        F.min(F.struct(*COLUMNS)).alias("row")).select("doc_id", "y", "row.*")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for raw, lang, source in zip(_encoded(batch["text"]), batch["lang"], batch["source"]):
                count = np.zeros(N_BUCKETS, dtype=np.float32)
                if len(raw) > 2:
                    ids = trigrams(np.frombuffer(raw, dtype=np.uint8))
                    count += np.bincount(ids, minlength=N_BUCKETS) / len(ids)
                out.append((count.tobytes(), metadata(raw, lang, source).tobytes()))
            yield batch[["doc_id", "y"]].assign(a=[x[0] for x in out], b=[x[1] for x in out])

    found = rows.mapInPandas(features, "doc_id long, y double, a binary, b binary").toPandas().sort_values("doc_id")
    found = found.iloc[np.argsort([zlib.crc32(str(i).encode()) for i in found["doc_id"]], kind="stable")]
    if not len(found):
        return [np.zeros((0, N_BUCKETS)), np.zeros((0, N_META))], np.zeros(0)
    views = [np.stack([np.frombuffer(x, dtype=np.float32) for x in found[c]]) for c in ("a", "b")]
    return views, found["y"].to_numpy()


def score_quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS,
                  max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` plus ``p_text``, ``p_meta``, ``score`` and ``keep`` (score at least one half)."""
    spark = docs.sparkSession
    model = co_train(docs, *_labelled(docs, labels, max_labelled), rounds)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("p_text double, p_meta double, score double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series) -> pd.DataFrame:
        m = shared.value
        if "share" in m:
            return pd.DataFrame({c: np.full(len(text), m["share"]) for c in ("p_text", "p_meta", "score")})
        if not len(text):
            return pd.DataFrame({c: np.zeros(0) for c in ("p_text", "p_meta", "score")})
        logits, _ = _view_logits(_encoded(text), lang, source, m["views"])
        logits = logits[:, 0].T
        both = logits @ m["weights"] + m["shift"]
        return pd.DataFrame(_sigmoid(np.column_stack((logits, both))), columns=["p_text", "p_meta", "score"])

    name = free_name(docs, "_q")
    scored = docs.withColumn(name, score(*COLUMNS))
    return scored.withColumns({
        "p_text": F.col(f"{name}.p_text"), "p_meta": F.col(f"{name}.p_meta"), "score": F.col(f"{name}.score"),
        "keep": F.col(f"{name}.score") >= 0.5}).drop(name)


@register("op5_cotraining")
def op5_cotraining(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_quality(docs, labels).select("doc_id", "p_text", "p_meta", "score", "keep")
