"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning.

A linear model over hashed words, trained in numpy. Its risk is that of a classifier of both classes,
rewritten for positives and unlabelled rows by the class prior; the part that stands for the negatives is
kept from falling below zero, where the model would only be learning its examples by heart. Unlabelled rows
are all documents that may be used, in every step.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likegraph.llm.language_id import held_out
from likegraph.llm.shared import beside, drop_written, text_slices, written
from likegraph.workers import trimmed

BITS = 18
#: Lower-cases A-Z and blanks all else of ASCII that isn't a letter or digit.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words of all texts in a row, and how many each text has."""
    split = [t.encode("utf-8", "surrogatepass").translate(_PLAIN).split() for t in texts]
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    hashed = np.fromiter((h for words in split for h in map(zlib.crc32, words)), dtype=np.int64, count=int(sizes.sum()))
    code = np.unique((np.repeat(np.arange(len(split)), sizes) << BITS) | (hashed * 0x9E3779B1 >> 7 & (1 << BITS) - 1))
    return code & (1 << BITS) - 1, np.bincount(code >> BITS, minlength=len(split))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text; a text without words gets the bias alone."""
        at, sizes = features(texts)
        sums = np.bincount(np.repeat(np.arange(len(texts)), sizes), weights=self.weights[at], minlength=len(texts))
        return _sigmoid(sums + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def chosen_words(in_p: np.ndarray, in_u: np.ndarray, positives: int, unlabelled: int, screen: float = 4.0, least: int = 5) -> np.ndarray:
    """The buckets that get a weight: their share of the positives is screen standard errors from that of the unlabelled rows, and least positives hold them or would by the share of all. A rare word that one example holds says nothing of others."""
    rate_p, rate_u = in_p / max(positives, 1), (in_u + 1) / (unlabelled + 1)
    far = np.abs(rate_p - rate_u) >= screen * np.sqrt(rate_u * np.maximum(1 - rate_u, 1e-9) / max(positives, 1))
    return np.flatnonzero(far & (np.maximum(in_p, positives * rate_u) >= least))


def risk(sums: dict, prior: float, w: np.ndarray, decay: float, round_off: float) -> tuple[float, np.ndarray]:
    """The non-negative risk at w and its gradient, from sums over all rows.

    prior E_P[l(g)] + max(0, E_U[l(-g)] - prior E_P[l(-g)]) + decay / 2 |w|^2, l the logistic loss; the bias,
    which is last in w, is not decayed. The corner of the maximum is rounded off within round_off, or steps
    over all rows would go to and fro across it.
    """
    held = np.append(w[:-1], 0.0)
    positive = prior * sums["p_loss"] / sums["p"]
    negative = sums["u_loss_neg"] / sums["u"] - prior * sums["p_loss_neg"] / sums["p"]
    d_negative = sums["u_grad"] / sums["u"] - prior * sums["p_grad"] / sums["p"]
    d_positive = prior * (sums["p_grad"] - sums["p_words"]) / sums["p"]
    value = positive + round_off * np.logaddexp(0, negative / round_off) + decay / 2 * held @ held
    return value, d_positive + _sigmoid(negative / round_off) * d_negative + decay * held


def fit(totals, words: int, prior: float, rounds: int = 60, decay: float = 3e-4, round_off: float = 5e-3, tolerance: float = 1e-3, memory: int = 10, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the bias that make the risk least, by limited-memory quasi-Newton steps over all rows.

    totals(w) gives the sums of ``risk``. It ends when the gradient is tolerance times what it was at first,
    when no step lowers the risk, or after so many rounds over the rows.
    """
    w = np.zeros(words + 1)
    w[-1] = np.log(prior / (1 - prior))
    if start is not None:
        w = start
    value, grad = risk(totals(w), prior, w, decay, round_off)
    begun, pairs, done = np.linalg.norm(grad), [], 0
    while done < rounds and np.linalg.norm(grad) > tolerance * begun:
        move, kept = grad.copy(), []
        for s, y in reversed(pairs):
            kept.append(s @ move / (s @ y))
            move -= kept[-1] * y
        if pairs:
            s, y = pairs[-1]
            move *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            move += s * (a - y @ move / (s @ y))
        step = 1.0 if pairs else 1.0 / max(float(np.linalg.norm(move)), 1e-12)
        while step > 1e-4:
            trial = w - step * move
            now, done = risk(totals(trial), prior, trial, decay, round_off), done + 1
            if now[0] <= value - 1e-4 * step * (grad @ move):
                break
            step /= 4
        else:
            if not pairs:
                break
            pairs = []
            continue
        s, y = trial - w, now[1] - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        w, (value, grad) = trial, now
    return w


def most_positive(p: np.ndarray, u: np.ndarray, least: float = 0.2) -> float:
    """The greatest class prior that histograms of scores allow (bins from low to high, of positives and of unlabelled rows).

    Above any score, unlabelled rows are at least the prior times as many as positives, of which least are
    to be there. Each share is taken a standard error to the safe side.
    """
    over_p, over_u = (np.cumsum(x[::-1]) / max(x.sum(), 1) for x in (p, u))
    use = over_p >= least
    error = lambda share, n: np.sqrt(share * (1 - share) / max(n, 1))
    return float(((over_u + error(over_u, u.sum())) / np.maximum(over_p - error(over_p, p.sum()), 1e-9))[use].min())


_BINS = 1024


def _histograms(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many positives and how many unlabelled rows have a score in each of _BINS bins of -32 to 32 before the sigmoid."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        own, sums = shared.value, np.zeros((2, _BINS), dtype=np.int64)
        for batch in batches:
            at = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
            g = np.bincount(owner, weights=own[at.flatten().to_numpy()], minlength=batch.num_rows) + own[-1]
            place = np.clip((g + 32) / 64 * _BINS, 0, _BINS - 1).astype(np.int64)
            for k in (0, 1):
                sums[k] += np.bincount(place[batch.column(k).to_numpy(zero_copy_only=False)], minlength=_BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(_BINS), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], ["i", "p", "u"])

    got = rows.mapInArrow(trimmed(run), "i int, p long, u long").groupBy("i").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).orderBy("i").toArrow()
    return got["p"].to_numpy(), got["u"].to_numpy()


def _gathered(rows: DataFrame, w: np.ndarray) -> dict:
    """The sums of ``risk`` over rows (positive, unlabelled, at), each task's first: as many numbers come to the driver as there are weights."""
    shared, size = rows.sparkSession.sparkContext.broadcast(w), len(w)

    def run(batches):
        own = shared.value
        grads, losses = np.zeros((2, size)), np.zeros(3)
        for batch in batches:
            at = batch.column(2)
            n, words = np.diff(at.offsets.to_numpy()), at.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), n)
            g = np.bincount(owner, weights=own[words], minlength=batch.num_rows) + own[-1]
            p, u = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            losses += [np.logaddexp(0, -g[p]).sum(), np.logaddexp(0, g[p]).sum(), np.logaddexp(0, g[u]).sum()]
            for k, which in enumerate((p, u)):
                s = _sigmoid(g) * which
                grads[k] += np.bincount(words, weights=s[owner], minlength=size)
                grads[k, -1] += s.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 3), pa.int32()), pa.array(np.append(grads[0], losses)), pa.array(np.append(grads[1], np.zeros(3)))], ["i", "p", "u"])

    got = rows.mapInArrow(trimmed(run), "i int, p double, u double").groupBy("i").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    p, u = np.zeros(size + 3), np.zeros(size + 3)
    p[got["i"].to_numpy()], u[got["i"].to_numpy()] = got["p"].to_numpy(), got["u"].to_numpy()
    return {"p_grad": p[:size], "u_grad": u[:size], "p_loss": p[size], "p_loss_neg": p[size + 1], "u_loss_neg": p[size + 2]}


def learn(docs: DataFrame, labels: DataFrame, train_rows: Column, most: int = 20_000, prior: float | None = None, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Trains on at most about ``most`` confirmed toxic documents, picked by a hash of the id, and on all documents as unlabelled.

    train_rows says which rows may be used, by the column doc_id. The class prior, unless given, is the
    share of toxic rows among the labelled ones that may be used, or less if scores show that so many can't
    be among the unlabelled ones: labelled rows may be chosen otherwise than at random. Labels other than 1 are not used as
    negatives. Without any confirmed toxic document the model scores the prior (0.5 without labels) for
    all. A document with several labels is toxic if one says so; rows of null id or text are unlabelled
    ones, and repeated rows count each.

    Words are counted over all rows; then each row is its few words that have a weight, in a table that
    every step's sums are taken over. What comes to the driver is bounded by the buckets.
    """
    names = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")).filter(train_rows & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    seen = names.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    given = prior is not None
    if not given:
        prior = min(max((seen["p"] or 0) / seen["n"], 1e-3), 0.9) if seen["n"] else 0.5
    none = Model(np.zeros(1 << BITS), float(np.log(prior / (1 - prior))))
    if not seen["p"]:
        return none
    picked = F.xxhash64("doc_id", F.lit(3)) / 2.0**64 + 0.5 < min(1.0, most / seen["p"])
    positive = names.filter((F.col("toxic") == 1) & picked).select("doc_id").distinct().withColumn("positive", F.lit(True))
    usable = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(train_rows)
    usable = usable.join(F.broadcast(positive), "doc_id", "left").select(F.coalesce("positive", F.lit(False)).alias("positive"), F.lit(True).alias("unlabelled"), "text")

    def count(batches):
        sums, rows = np.zeros((2, 1 << BITS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            p = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, texts in text_slices(batch.column(2)):
                at, sizes = features(texts)
                sums[1] += np.bincount(at, minlength=1 << BITS)
                sums[0] += np.bincount(at[np.repeat(p[a:b], sizes)], minlength=1 << BITS)
            rows += [p.sum(), len(p)]
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), *(pa.array(np.append(s[at], n)) for s, n in zip(sums, rows, strict=True))], ["i", "p", "u"])

    got = usable.mapInArrow(trimmed(count), "i int, p long, u long").groupBy("i").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    i, p, u = (got[c].to_numpy() for c in ("i", "p", "u"))
    positives, rows = (int(x[i < 0].sum()) for x in (p, u))
    if not positives:
        return none
    in_p, in_u = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    in_p[i[i >= 0]], in_u[i[i >= 0]] = p[i >= 0], u[i >= 0]
    words = chosen_words(in_p, in_u, positives, rows)
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[words] = np.arange(len(words))
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def project(batches):
        for batch in batches:
            for a, b, texts in text_slices(batch.column(2)):
                at, sizes = features(texts)
                at = shared.value[at]
                ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes)[at >= 0], minlength=len(sizes)))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[at >= 0], pa.int32()))], ["positive", "unlabelled", "at"])

    short = written(usable.mapInArrow(trimmed(project), "positive boolean, unlabelled boolean, at array<int>"), "words")
    fixed = {"p": positives, "u": rows, "p_words": np.append(in_p[words], positives).astype(float)}
    totals = lambda x: fixed | _gathered(short, x)
    w = fit(totals, len(words), prior)
    allowed = most_positive(*_histograms(short, w))
    if allowed < prior and not given:
        w = fit(totals, len(words), allowed, start=w + np.append(np.zeros(len(words)), np.log(allowed / (1 - allowed)) - np.log(prior / (1 - prior))))
    drop_written(short)
    weights = np.zeros(1 << BITS)
    weights[words] = w[:-1]
    return Model(weights, float(w[-1]))


def score(docs: DataFrame, model: Model, keep: list = (), text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs' columns named in keep, with score and predicted (1 from the threshold on).

    Null text counts as empty; repeated rows each have their row, an empty table gives none, and long texts
    are read whole. A kept column whose name clashes with an added one gets underscores in front.
    """
    shared, kept = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias)), docs.select(*keep)
    inner = [f"c{k}" for k in range(len(kept.columns))]
    columns = [*inner, "score", "predicted"]

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(batch.num_columns - 1)):
                got = own.score(texts)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(got), pa.array((got >= threshold).astype(np.int32))], columns)

    plain = kept.toDF(*inner).schema
    out = docs.select(*keep, F.col(text).alias("__text")).toDF(*inner, "__text").mapInArrow(trimmed(run), T.StructType([*plain.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
    return out.toDF(*beside(kept.columns, ["score", "predicted"]), "score", "predicted")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the rows outside the held-out fold and scores every document: doc_id, held_out, score, predicted.

    Null ids are in no fold; null and empty texts score the bias alone; repeated rows are scored each; empty
    documents or labels give no rows, or the prior for all.
    """
    fold = held_out(parts=4, part=2)
    return score(docs, learn(docs, labels, ~fold), keep=["doc_id", fold.alias("held_out")])
