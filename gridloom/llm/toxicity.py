"""Toxicity by weak supervision.

1. Voters.  Lexicon voters are words and word stems (first four and five bytes) whose presence speaks for a toxic label in a
   bounded sample of labelled training rows; pattern voters are fixed shapes of text.  Each votes or abstains.
2. Label model.  A generative model of the votes given the unseen label (class prior, each voter's rate in either
   class) is estimated by EM over the vote patterns of all training rows, started from the labelled sample, which
   also stays in it as a prior.  The last pass gives the voters' correlations within the classes; votes that repeat each
   other are discounted by them.
3. Classifier.  A logistic regression on word and stem presence is trained on the posterior labels of two bounded samples
   of training rows: unlabelled ones, as surely as their votes tell, and labelled ones, where a row's own label is one more vote.
4. Every text is scored whole.

Only rows with crc32(doc_id as text) % 5 <> 0 are learned from.  Defined cases: null and empty texts get the
score of a text without words; a null doc_id is never learned from and not held out; of several labels of a doc_id
the largest counts; null labels are left out; without labelled rows among the texts every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, docs_of, schema, slices
from .words import LETTERS, U64, flat, span_hashes, word_spans

SAMPLE = 20_000  # labelled training rows that voters are found in and the classifier is fitted on
UNLABELLED = 20_000  # other training rows that it is fitted on
FEATURES = 4_096  # words and stems of the classifier
LEXICON = 188  # lexicon voters, of those features
STEMS = (4, 5)
DOUBT = 0.25  # weight of an unlabelled row whose votes are certain, beside a labelled one
ROUNDS = 8  # of EM
_PATTERNS = 4
_CHUNK = 4096


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a batch: hashes of words and of the stems of longer ones."""
    start, end = word_spans(data, offs, LETTERS)
    rows = np.searchsorted(offs, start, "right") - 1
    all_rows, hashes = [rows], [span_hashes(data, start, end)]
    for n in STEMS:
        long = end - start > n
        all_rows.append(rows[long])
        hashes.append(span_hashes(data, start[long], start[long] + n) ^ U64(0x5BD1E995))
    return np.concatenate(all_rows), np.concatenate(hashes)


def _patterns(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Pattern votes by row: mostly capitals, runs of exclamation or question marks, masked words (a letter, then stars), long runs of one letter."""
    m = len(offs) - 1

    def count(hit):
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[offs[1:]] - total[offs[:-1]]

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    mark, star = (data == 33) | (data == 63), data == 42
    out = np.zeros((m, _PATTERNS), bool)
    caps = count(upper)
    out[:, 0] = (caps > 20) & (caps > count(lower))
    if len(data) > 3:
        two = np.zeros(len(data), bool)
        two[2:] = mark[2:] & mark[1:-1] & mark[:-2]
        out[:, 1] = count(two) > 0
        two = np.zeros(len(data), bool)
        two[2:] = star[2:] & star[1:-1] & LETTERS[data[:-2]]
        out[:, 2] = count(two) > 0
        two = np.zeros(len(data), bool)
        two[3:] = (data[3:] == data[2:-1]) & (data[2:-1] == data[1:-2]) & (data[1:-2] == data[:-3]) & LETTERS[data[3:]]
        out[:, 3] = count(two) > 0
    return out


class _Lookup:
    """Places of the known features among many hashes: a table by low bits, then the whole hash."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.sorted = np.argsort(known)
        self.table = np.zeros(1 << 20, bool)
        self.table[(known & U64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, index of feature)."""
        maybe = np.flatnonzero(self.table[(h & U64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.known) or not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, rows = h[maybe], rows[maybe]
        at = np.minimum(np.searchsorted(self.known, h, sorter=self.sorted), len(self.known) - 1)
        hit = self.known[self.sorted[at]] == h
        both = np.unique(rows[hit] * len(self.known) + self.sorted[at[hit]])
        return both // len(self.known), both % len(self.known)


def _count(batches):
    for whole in batches:
        for b in slices(whole, "text"):
            data, offs = flat(b.column("text"))
            rows, h = _features(data, offs)
            order = np.lexsort((rows, h))
            rows, h = rows[order], h[order]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
            toxic = b.column("toxic").to_numpy()[rows[keep]]
            u, inverse = np.unique(h[keep], return_inverse=True)
            pos = np.bincount(inverse, toxic, len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(pos), pa.array(np.bincount(inverse, minlength=len(u)) - pos)], names=["feature", "pos", "neg"])


def _vote(known: np.ndarray, voters: np.ndarray, features: bool):
    """Each row's votes as packed bits; if features also its features and label."""
    def run(batches):
        find, column = _Lookup(known if features else known[voters]), np.full(len(known), -1)
        column[voters] = np.arange(len(voters))
        for whole in batches:
            for b in slices(whole, "text"):
                data, offs = flat(b.column("text"))
                rows, at = find(*_features(data, offs))
                votes = np.zeros((len(b), len(voters) + _PATTERNS), bool)
                votes[:, len(voters) :] = _patterns(data, offs)
                place = column[at] if features else at
                votes[rows[place >= 0], place[place >= 0]] = True
                bits = pa.array([x.tobytes() for x in np.packbits(votes, axis=1)], pa.binary())
                if features:
                    edges = np.searchsorted(rows, np.arange(len(b) + 1))
                    own = pa.array([at[edges[i] : edges[i + 1]].astype("<u2").tobytes() for i in range(len(b))], pa.binary())
                    yield pa.RecordBatch.from_arrays([bits, own, b.column("toxic")], names=["votes", "features", "toxic"])
                else:
                    yield pa.RecordBatch.from_arrays([bits], names=["votes"])

    return run


def _unpack(column, n: int) -> np.ndarray:
    width = -(-n // 8)
    raw = np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(-1, width)
    return np.unpackbits(raw, axis=1, count=n).astype(float)


class LabelModel:
    """Class prior, voters' rates in either class, and discounts for voters that repeat each other."""

    def __init__(self, n: int, labelled_votes: np.ndarray, labels: np.ndarray):
        self.n = n
        self.seen = np.array([[(1 - labels).sum()], [labels.sum()]]), np.stack([(1 - labels) @ labelled_votes, labels @ labelled_votes])
        self.discount = np.ones(n)
        self.update(np.zeros((2, 1)), np.zeros((2, n)))

    def update(self, rows: np.ndarray, votes: np.ndarray) -> None:
        """From expected counts of rows and votes in each class, besides the labelled ones."""
        rows, votes = self.seen[0] + rows, self.seen[1] + votes
        self.rate = (votes + 0.05) / (rows + 1)
        self.prior = float(rows[1, 0] + 0.5) / float(rows.sum() + 1)
        self.on = np.log(self.rate[1] / self.rate[0]) * self.discount
        self.off = np.log((1 - self.rate[1]) / (1 - self.rate[0])) * self.discount

    def logit(self, votes: np.ndarray) -> np.ndarray:
        return np.log(self.prior / (1 - self.prior)) + votes @ self.on + (1 - votes) @ self.off

    def posterior(self, votes: np.ndarray, more=0.0) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(votes) + more, -30, 30)))

    def correlate(self, rows: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Discounts by correlations given the class (pooled), from each class's sums of rows, votes and pairs of votes.

        A voter counts 1 / (1 + its correlations with others).
        """
        cov = sum(xx - np.outer(x, x) / max(n, 1e-9) for n, x, xx in zip(rows, first, second)) / max(rows.sum(), 1e-9)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(corr, 0)
        corr[corr < 0.3] = 0
        self.discount = 1 / (1 + corr.sum(1))


def _expect(model: LabelModel, second: bool):
    """Expected sums over a part of the vote patterns: one row for each run."""
    def run(batches):
        total = None
        for b in batches:
            if len(b):
                x, w = _unpack(b.column("votes"), model.n), b.column("rows").to_numpy().astype(float)
                q = model.posterior(x) * w
                parts = [[(w - q).sum(), q.sum()], (w - q) @ x, q @ x]
                if second:
                    parts += [(x.T @ (y[:, None] * x)).ravel() for y in (w - q, q)]
                sums = np.concatenate(parts)
                total = sums if total is None else total + sums
        if total is not None:
            chunks = range(0, len(total), _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([k // _CHUNK for k in chunks], pa.int32()), pa.array([total[k : k + _CHUNK].tobytes() for k in chunks], pa.binary())], names=["k", "x"])

    return run


def _add(t: pa.Table) -> pa.Table:
    return pa.table([t["k"][:1], pa.array([sum(np.frombuffer(x.as_py()) for x in t["x"]).tobytes()], pa.binary())], names=["k", "x"])


def _sums(patterns: DataFrame, model: LabelModel, second: bool = False) -> list[np.ndarray]:
    """Expected sums in each class: rows, votes and, if second, pairs of votes."""
    n, kind = model.n, schema(k="int", x="binary")
    rows = patterns.mapInArrow(_expect(model, second), kind).groupBy("k").applyInArrow(_add, kind).toArrow().sort_by("k")
    flat = np.concatenate([np.zeros(0), *(np.frombuffer(x.as_py()) for x in rows["x"])]) if len(rows) else np.zeros(2 + 2 * n + 2 * n * n * second)
    return [flat[:2], flat[2 : 2 + 2 * n].reshape(2, n), *([flat[2 + 2 * n :].reshape(2, n, n)] if second else [])]


def estimate(patterns: DataFrame, model: LabelModel, rounds: int = ROUNDS) -> LabelModel:
    """EM over the patterns (votes, rows), which are all training rows; its last expectation also gives the correlations."""
    for k in range(rounds + 1):
        rows, votes, *pairs = _sums(patterns, model, second=k == rounds)
        if pairs:
            model.correlate(rows, votes, *pairs)
        model.update(rows[:, None], votes)
    return model


def _fit(rows: np.ndarray, at: np.ndarray, n: int, q: np.ndarray, sure: np.ndarray, ridge: float = 0.1, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on presence of features by accelerated full-batch gradient steps; sure: weights of the rows."""
    m, mean = len(q), float((q * sure).sum() / max(sure.sum(), 1e-9))
    w, b = np.zeros(n), float(np.log((mean + 1e-4) / (1 - mean + 1e-4)))
    df = np.bincount(at, sure[rows], minlength=n)
    step_w, step_b = 1 / (0.25 * np.maximum(df, 1) * 6 + ridge), 1 / (0.25 * max(sure.sum(), 1.0))
    vw, vb = w.copy(), b
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(vb + np.bincount(rows, vw[at], m), -30, 30)))
        r = (p - q) * sure
        new_w = vw - step_w * (np.bincount(at, r[rows], n) + ridge * vw)
        new_b = vb - step_b * r.sum() * 0.5
        beta = k / (k + 3)
        vw, vb = new_w + beta * (new_w - w), new_b + beta * (new_b - b)
        w, b = new_w, new_b
    return w, b


def _score(known: np.ndarray, w: np.ndarray, bias: float, own: list[str]):
    def run(batches):
        find = _Lookup(known)
        for whole in batches:
            for b in slices(whole, "text"):
                data, offs = flat(b.column("text"))
                rows, at = find(*_features(data, offs))
                z = bias + np.bincount(rows, w[at], len(b))
                score = 1 / (1 + np.exp(-np.clip(z, -50, 50))) if len(known) else np.zeros(len(b))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(score)], names=[*own, "score"])

    return run


def _some_ids(ids: DataFrame, most: int) -> pa.Table:
    """doc_ids (with their other columns) of so many rows at most, by hash; one that has more rows than that isn't taken."""
    ids = ids.withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    n = ids.count()
    if n > 8 * most:  # a share of the hashes, from which the first ones are taken
        ids = ids.where(F.col("h") <= int(-(2**63) + 2**64 * 4 * most // n))
    others = [F.max(c).alias(c) for c in ids.columns if c not in ("doc_id", "h")]
    found = ids.groupBy("h", "doc_id").agg(F.count("*").alias("rows"), *others).where(F.col("rows") <= most).orderBy("h", "doc_id").limit(most).toArrow()
    return found.filter(pa.array(np.cumsum(found["rows"].to_numpy()) <= most)).drop(["h", "rows"])


def _learn(docs: DataFrame, labels: DataFrame, sample: int, unlabelled: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The classifier's features, their weights and its bias; no features if there is nothing to learn from."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    learn = docs_of(docs, "doc_id", "text").where(fold != 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold != 0)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Samples are of fixed size, and so are what is broadcast and what comes to the driver of them.
    own = _some_ids(learn.select("doc_id").join(marks, "doc_id"), sample)
    if not len(own):
        return np.zeros(0, U64), np.zeros(0), 0.0
    own = scratch.keep(learn.join(F.broadcast(spark.createDataFrame(own)), "doc_id").select("text", "toxic"))
    n_rows, n_pos = own.agg(F.count("*"), F.sum("toxic")).first()
    n_pos, n_neg = float(n_pos), float(n_rows - n_pos)
    counts = own.mapInArrow(_count, schema(feature="long", pos="long", neg="long")).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 3")
    a, b, c, d = F.col("pos") + 0.5, F.col("neg") + 0.5, F.lit(n_pos + 0.5) - F.col("pos"), F.lit(n_neg + 0.5) - F.col("neg")
    total = F.lit(n_pos + n_neg + 2.0)

    def term(x, r, s):
        return x * F.log(F.greatest(x, F.lit(0.5)) * total / (r * s))

    g = 2 * (term(a, a + b, a + c) + term(b, a + b, b + d) + term(c, c + d, a + c) + term(d, c + d, b + d))
    found = counts.withColumn("g", g).orderBy(F.desc("g"), "feature").limit(FEATURES).toArrow()
    known = found["feature"].to_numpy().view(U64)
    if not len(known):
        return known, np.zeros(0), 0.0
    pos, neg = found["pos"].to_numpy(), found["neg"].to_numpy()
    voters = np.flatnonzero((pos + 0.5) * (n_neg + 1) > 8 * (neg + 0.5) * (n_pos + 1))[:LEXICON]
    others = _some_ids(learn.select("doc_id").join(marks, "doc_id", "left_anti"), unlabelled)
    rows = own
    if len(others):
        rows = own.union(learn.join(F.broadcast(spark.createDataFrame(others)), "doc_id").select("text", F.lit(-1).alias("toxic")))
    rows = rows.mapInArrow(_vote(known, voters, True), schema(votes="binary", features="binary", toxic="int")).toArrow()
    x, y = _unpack(rows["votes"], len(voters) + _PATTERNS), rows["toxic"].to_numpy().astype(float)
    marked = y >= 0
    patterns = scratch.keep(learn.select("text").mapInArrow(_vote(known, voters, False), schema(votes="binary")).groupBy("votes").agg(F.count("*").alias("rows")))
    model = estimate(patterns, LabelModel(len(voters) + _PATTERNS, x[marked], y[marked]))
    # A row's own label votes too, as strongly as it agrees with the other votes.
    agree = np.clip(np.mean((model.posterior(x[marked]) > 0.5) == (y[marked] > 0.5)), 0.6, 0.99)
    q = model.posterior(x, np.where(marked, (2 * y - 1) * np.log(agree / (1 - agree)), 0.0))
    lengths = np.array([len(v.as_py()) // 2 for v in rows["features"]])
    at = np.frombuffer(b"".join(v.as_py() for v in rows["features"]), "<u2").astype(np.int64)
    w, bias = _fit(np.repeat(np.arange(len(y)), lengths), at, len(known), q, np.where(marked, 1.0, DOUBT * np.abs(2 * q - 1)))
    return known, w, bias


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> DataFrame:
    """The rows of docs (doc_id, text and more) with a score last (which replaces a column of that name); labels: doc_id, toxic 0 or 1."""
    known, w, bias = _learn(docs, labels, sample, unlabelled)
    rows = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(_score(known, w, bias, rows.columns), T.StructType([*rows.schema, T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    out = scored(docs_of(docs, "doc_id", "text"), labels, sample)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.expr("if(score >= 0.5, 1, 0)").alias("predicted"))
