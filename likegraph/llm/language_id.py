"""Language identification as a mixture: which languages a document holds, and how much of each.

Languages are multinomials over hashed character trigrams of words. A document's proportions are those of
greatest likelihood, found by expectation-maximisation; the set of languages grows one at a time while the
likelihood gains more than a penalty for each further language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likegraph.llm.shared import beside, text_slices
from likegraph.workers import trimmed

BUCKETS = 1 << 16
UNKNOWN = "und"
#: Languages whose counts a task holds at a time.
_HELD = 200


def _letter_table() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


_LETTERS: np.ndarray | None = None


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased runs of letters, each with a blank on either side, of all texts in a row; and the text of each."""
    joined = "\n".join(texts) + "\n"
    # a blank holds the place of each letter whose lower case is longer, so that places stay
    low = joined.lower()
    if len(low) != len(joined):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in joined)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    letters = np.where(_letter_table()[codes], codes, 0).astype(np.uint64)
    letters = np.concatenate([[np.uint64(0)], letters])
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    # the middle is a letter, or none and so no trigram; blanks beyond it count once
    keep = np.flatnonzero(b)
    key = (a[keep] * np.uint64(0x1F123BB5) + b[keep] * np.uint64(0x5851F42D4C957F2D) + c[keep] * np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9E3779B97F4A7C15)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return (key >> np.uint64(64 - 16)).astype(np.int64), owner[keep]


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", smoothing: float = 0.05, most_languages: int = 1000) -> dict[str, np.ndarray]:
    """The log probability of each bucket in each language, from all rows with text and language.

    Rows without either are not read, repeated rows count as often, and a table without any gives no model.
    Counts are summed in each task, for at most _HELD languages at a time, and then by bucket. The model that
    comes to the driver has languages x BUCKETS numbers, however many documents there are; a column of more
    than most_languages values is no column of languages and raises an error before anything is collected.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def out():
            for x, row in sums.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1), 1_000_000):
                here = sorted(set(names[a:b]))
                number = {x: k for k, x in enumerate(here)}
                key, owner = trigrams(texts)
                code, got = np.unique(np.array([number[x] for x in names[a:b]])[owner] * BUCKETS + key, return_counts=True)
                cuts = np.searchsorted(code, np.arange(len(here) + 1) * BUCKETS)
                for k, x in enumerate(here):
                    if x not in sums and len(sums) >= _HELD:
                        yield from out()
                    own = sums.setdefault(x, np.zeros(BUCKETS, dtype=np.int64))
                    own[code[cuts[k] : cuts[k + 1]] % BUCKETS] += got[cuts[k] : cuts[k + 1]]
        yield from out()

    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    if rows.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    sums = rows.mapInArrow(trimmed(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sums["lang"].to_numpy(zero_copy_only=False).astype(str)
    model = {}
    for name in sorted(set(names.tolist())):
        own = names == name
        row = np.full(BUCKETS, smoothing)
        row[sums["bucket"].to_numpy()[own]] += sums["n"].to_numpy()[own]
        model[name] = np.log(row / row.sum())
    return model


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... n[k] places each, in a row."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _runs(sizes: np.ndarray, most: int):
    """(from, to) over sizes, each of a sum of at most most, or one."""
    ends, start, done = np.cumsum(sizes), 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield start, stop
        start, done = stop, int(ends[stop - 1])


def _proportions(p: np.ndarray, counts: np.ndarray, begin: np.ndarray, sizes: np.ndarray, w: np.ndarray, floor: np.ndarray, rival: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of many small mixtures at once: proportions (from w) and log likelihoods.

    p has a row for each n-gram of each mixture, which begin and sizes divide. The log likelihood is concave,
    so no proportions reach more than its value plus the greatest slope towards one language. A mixture is
    done when that leaves no more than gap to gain, or when it can't come above floor; and, as one of a
    group of rivals, when it can't come above what another has reached.
    """
    value, total = np.zeros(len(begin)), np.add.reduceat(counts, begin)
    live = np.arange(len(begin))
    rows = np.arange(len(counts))
    reached = np.full(int(rival.max()) + 1 if len(rival) else 0, -np.inf)
    while len(live):
        size = sizes[live]
        start = np.cumsum(size) - size
        own, c = p[rows], counts[rows]
        owner = np.repeat(np.arange(len(live)), size)
        mixed = np.einsum("ij,ij->i", own, w[live][owner])
        value[live] = np.add.reduceat(c * np.log(mixed), start)
        slope = np.add.reduceat(own * (c / mixed)[:, None], start, axis=0) / total[live][:, None]
        room = np.maximum(slope.max(axis=1) - 1, 0) * total[live]
        np.maximum.at(reached, rival[live], value[live])
        best = np.maximum(floor[live], np.where(value[live] < reached[rival[live]], reached[rival[live]], -np.inf))
        stay = (room > gap) & (value[live] + room > best)
        w[live] = np.where(stay[:, None], w[live] * slope, w[live])
        keep = np.repeat(stay, size)
        rows, live = rows[keep], live[stay]
    return w, value


def mixtures(likelihoods: np.ndarray, counts: np.ndarray, owner: np.ndarray, docs: int, penalty: float = 6.0, at: np.ndarray | None = None, gap: float = 1e-3, rows: int = 2_000_000, logs: np.ndarray | None = None) -> np.ndarray:
    """Proportions (docs x languages), given each distinct n-gram's row in likelihoods (at; else their order), count and document (ascending).

    Forward selection: start from the best single language; then, for each document, find by
    expectation-maximisation what each further language gains, and keep the one that gains most, if that is
    more than the penalty. At last a language goes whose loss costs no more than the penalty. The likelihood
    is concave: its slope towards a language bounds the gain, which leaves few languages to try, and stops
    each trial once it is within gap of its end or can't win. A document without n-grams has no language.
    Documents are taken in runs of about rows n-grams x languages tried. What is worked out for all languages
    is as precise as likelihoods are (logs, if given, are theirs), with room left for that where it decides.
    """
    langs = likelihoods.shape[1]
    at = np.arange(len(counts)) if at is None else at
    share = np.zeros((docs, langs))
    sizes = np.bincount(owner, minlength=docs)
    first = np.cumsum(sizes) - sizes
    live = np.flatnonzero(sizes)
    if not len(live) or not langs:
        return share
    wide = max(1, rows // langs)
    total = np.add.reduceat(counts, first[live])
    value, best = np.zeros(len(live)), np.zeros(len(live), dtype=int)
    for a, b in _runs(sizes[live], wide):
        these = _places(first[live[a:b]], sizes[live[a:b]])
        begin = np.cumsum(sizes[live[a:b]]) - sizes[live[a:b]]
        log = np.log(likelihoods[at[these]]) if logs is None else logs[at[these]]
        log *= counts[these, None].astype(log.dtype)
        best[a:b] = np.add.reduceat(log, begin, axis=0).argmax(axis=1)
        own = likelihoods[at[these], np.repeat(best[a:b], sizes[live[a:b]])].astype(float)
        value[a:b] = np.add.reduceat(counts[these] * np.log(own), begin)
    chosen = [[k] for k in best.tolist()]
    weights = [np.ones(1) for _ in chosen]
    active = np.arange(len(live))
    for many in range(1, langs):
        doc_of, lang_of, bound = [], [], []
        for a, b in _runs(sizes[live[active]], wide):
            who = active[a:b]
            n = sizes[live[who]]
            these, begin = _places(first[live[who]], n), np.cumsum(n) - n
            p = likelihoods[at[these]]
            has = np.array([chosen[d] for d in who])
            w = np.array([weights[d] for d in who])
            of = np.repeat(np.arange(b - a), n)
            mixed = (np.take_along_axis(p, has[of], axis=1) * w[of]).sum(axis=1)
            p *= (counts[these] / mixed)[:, None].astype(p.dtype)
            # less 1, times the n-grams; with room for the precision of p
            slope = np.add.reduceat(p, begin, axis=0) - (1 - 1e-4) * total[who][:, None]
            np.put_along_axis(slope, has, -np.inf, axis=1)
            d, k = np.nonzero(slope > penalty)
            order = np.lexsort((k, -slope[d, k], d))
            doc_of.append(who[d[order]])
            lang_of.append(k[order])
            bound.append(slope[d[order], k[order]])
        doc_of, lang_of, bound = np.concatenate(doc_of), np.concatenate(lang_of), np.concatenate(bound)
        gain = np.full(len(live), penalty)
        won: dict[int, tuple[int, np.ndarray, float]] = {}
        # the steepest first, then twice as many: most others can't win any more
        turn = 1
        while len(doc_of):
            rivals, cuts = np.unique(doc_of, return_index=True)
            place = np.arange(len(doc_of)) - np.repeat(cuts, np.diff(np.append(cuts, len(doc_of))))
            now_d, now_k = doc_of[place < turn], lang_of[place < turn]
            # trials of one document stay together: its rivals stop each other
            rivals, cuts, counted = np.unique(now_d, return_index=True, return_counts=True)
            for a, b in _runs(sizes[live[rivals]] * counted, rows // (many + 1)):
                lo, hi = cuts[a], cuts[b] if b < len(cuts) else len(now_d)
                d, k = now_d[lo:hi], now_k[lo:hi]
                n = sizes[live[d]]
                these = _places(first[live[d]], n)
                sets = np.concatenate([np.array([chosen[x] for x in d]), k[:, None]], axis=1)
                p = likelihoods[at[these][:, None], np.repeat(sets, n, axis=0)].astype(float)
                start = np.concatenate([np.array([weights[x] for x in d]) * 0.8, np.full((len(d), 1), 0.2)], axis=1)
                w, now = _proportions(p, counts[these], np.cumsum(n) - n, n, start, value[d] + gain[d], np.repeat(np.arange(b - a), counted[a:b]), gap)
                for i, (x, v) in enumerate(zip(d.tolist(), (now - value[d]).tolist(), strict=True)):
                    if v > gain[x]:
                        gain[x] = v
                        won[x] = (int(k[i]), w[i], v)
            left = (place >= turn) & (bound > gain[doc_of])
            doc_of, lang_of, bound, turn = doc_of[left], lang_of[left], bound[left], 2 * turn
        for x, (k, w, v) in won.items():
            chosen[x], weights[x], value[x] = [*chosen[x], k], w, value[x] + v
        active = np.array(sorted(won), dtype=int)
        if not len(active):
            break
    # with three or more, the first may have become superfluous
    todo = [x for x in range(len(live)) if len(chosen[x]) > 2]
    while todo:
        again = []
        for x in todo:
            a, n = first[live[x]], sizes[live[x]]
            sets = [[k for k in chosen[x] if k != out] for out in chosen[x]]
            trials = [_proportions(likelihoods[at[a : a + n]][:, s].astype(float), counts[a : a + n], np.zeros(1, int), np.array([n]), np.full((1, len(s)), 1 / len(s)), np.array([value[x] - penalty]), np.zeros(1, int), gap) for s in sets]
            k = max(range(len(sets)), key=lambda i: trials[i][1][0])
            if trials[k][1][0] > value[x] - penalty:
                chosen[x], weights[x], value[x] = sets[k], trials[k][0][0], trials[k][1][0]
                if len(sets[k]) > 2:
                    again.append(x)
        todo = again
    for x, d in enumerate(live.tolist()):
        share[d, chosen[x]] = weights[x]
    return share


def predict(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str | Column] = (), text: str = "text", penalty: float = 6.0) -> DataFrame:
    """docs' columns named in keep, with lang_pred, score and mixture (language to proportion).

    lang_pred has the largest proportion (ties: the first by name), which is the score. Null text, text
    without letters, or a model without languages: ``und``, 0 and an empty map. Repeated rows each have their
    row, an empty table gives none, and long texts are read whole. A kept column whose name clashes with an
    added one gets underscores in front.
    """
    names = sorted(model)
    table = docs.sparkSession.sparkContext.broadcast(np.exp(np.stack([model[x] for x in names], axis=1)).astype(np.float32) if names else None)
    kept = docs.select(*keep)
    inner = [f"c{k}" for k in range(len(kept.columns))]
    columns = [*inner, "lang_pred", "score", "mixture"]
    kinds = pa.map_(pa.string(), pa.float64())

    def run(batches):
        logs = np.log(table.value) if names else None
        for batch in batches:
            for a, b, texts in text_slices(batch.column(batch.num_columns - 1), 1_000_000):
                n = b - a
                share = np.zeros((n, len(names)))
                if names:
                    key, owner = trigrams(texts)
                    code, counts = np.unique(owner * BUCKETS + key, return_counts=True)
                    share = mixtures(table.value, counts.astype(float), code // BUCKETS, n, penalty, code % BUCKETS, logs=logs)
                found = share.any(axis=1)
                top = share.argmax(axis=1) if names else np.zeros(n, dtype=int)
                score = np.minimum(share.max(axis=1, initial=0), 1.0)
                langs = [names[k] if f else UNKNOWN for k, f in zip(top.tolist(), found.tolist(), strict=True)]
                maps = [[(names[k], float(s)) for k, s in enumerate(row) if s > 0] for row in share.tolist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, n) for c in batch.columns[:-1]), pa.array(langs), pa.array(score), pa.array(maps, kinds)], columns)

    plain = kept.toDF(*inner).schema
    schema = T.StructType([*plain.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    out = docs.select(*keep, F.col(text).alias("__text")).toDF(*inner, "__text").mapInArrow(trimmed(run), schema)
    return out.toDF(*beside(kept.columns, ["lang_pred", "score", "mixture"]), "lang_pred", "score", "mixture")


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether the id's fold (crc32 of its text form, by remainder) is the one kept from training. Null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from all but the held-out fold of docs and predicts every document: doc_id, held_out, lang_pred, score, mixture.

    Null ids are in no fold and so are learned from; repeated rows count and are predicted as often; null text
    is not learned from and is ``und``; ties go to the first language by name. An empty table gives no rows.
    """
    model = learn(docs.filter(~held_out()))
    return predict(docs, model, keep=["doc_id", held_out().alias("held_out")])
