"""Toxicity of documents by their nearest labelled examples.

Examples are labelled documents whose crc32(doc_id) mod 5 is not 0, at most
``EXAMPLES_PER_CLASS`` of each class (those with the smallest hash of doc_id; the bound of the
sample). Features are all words of the examples, lower-cased and without outer punctuation;
none is left out and none is cut. Vectors are (1 + ln tf) * idf * sqrt(1 + G2), of length 1, so an inner
product is the cosine. G2 is the likelihood ratio of a word's counts in the two classes, about 1 for
one that has nothing to do with them: plain TF-IDF is led by the many words that say nothing.

The inverted index holds the examples in blocks of alike ones (of one class, with the same of the
commonest words), with the largest weight of each word in each block. The ``COMMON`` commonest words, whose lists are
the longest, are held as a matrix instead, and met by many documents at once. A document adds up
the bounds of all blocks, scores the ``FIRST_BLOCKS`` of the largest bounds, then all others
whose bound reaches the k-th best cosine: the k nearest are exact (cosines to 12 digits). Votes are weighted by cosine
and by what an example stands for in its class. Leave-one-out votes of the examples
themselves, in bins made monotone, calibrate votes to scores; a document without any word of
the examples gets the rate of toxic examples among examples like it. The nearest examples are
returned as evidence.

Defined results: a null or empty text has no features; a null doc_id is never an example
and not held out; of several labels of a document the largest counts, null labels don't;
of several texts of a document the least by code point is the example;
without labelled rows every score is 0; ties among examples go to the smaller doc_id;
repeated rows get equal scores; other columns are ignored. Labels, lang, source and doc_id
are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import append, slices, with_fields
from .common import Cache, give_back, table

EXAMPLES_PER_CLASS = 2000
NEIGHBOURS, BLOCK, FIRST_BLOCKS, BINS = 15, 64, 6, 20
#: Commonest words by which examples are ordered, and those that are held as a matrix.
COMMON_WORDS, COMMON = 24, 256
EDGES = re.compile(r"^\W+|\W+$")


def word_of(token: str) -> str:
    """A lower-cased token without outer punctuation."""
    return EDGES.sub("", token)


def count_words(text: str) -> Counter:
    out: Counter = Counter()
    for token, n in Counter(text.lower().split()).items():
        if word := word_of(token):
            out[word] += n
    return out


class _Known(Cache):
    """Numbers of the features of tokens, -1 for none."""

    def __init__(self, feature: dict[str, int]):
        super().__init__()
        self.feature = feature

    def __missing__(self, token: str) -> int:
        if (feature := self.old.get(token)) is None:
            feature = self.feature.get(word_of(token), -1)
        return self.keep(token, feature)

    def __reduce__(self):
        return _Known, (self.feature,)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end."""
    n = ends - starts
    return np.repeat(ends - np.cumsum(n), n) + np.arange(n.sum())


class Model:
    """Vocabulary, inverted index and calibration; all bounded by the texts of the sampled examples."""

    def __init__(self, names: list[str], weight: list[float]):
        self.feature = {f: i for i, f in enumerate(names)}
        self.weight = np.array(weight, float)
        self.known = _Known(self.feature)
        self.ids = self.labels = self.weights = np.zeros(0)
        self.blocks, self.prior, self.bare, self.bins = 0, 0.0, 0.0, None

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers, ascending, and how often each comes; both empty without words of the examples."""
        tokens = Counter(text.lower().split())
        found = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        times = np.fromiter(tokens.values(), np.int64, len(tokens))
        at, where = np.unique(found[found >= 0], return_inverse=True)
        return at, np.bincount(where, times[found >= 0], len(at)).astype(np.int64)

    def weigh(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.weight[at]
        return at, w / math.sqrt(float(w @ w)) if len(w) else w

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.weigh(*self.counts(text))

    def index(self, ids: list[int], labels: list[int], weights: list[float], vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Examples in any order; those without features only count for the bare rate."""
        labels_, weights_ = np.array(labels, float), np.array(weights, float)
        full = np.array([len(v[0]) > 0 for v in vectors], bool)
        rate = lambda m: float((labels_ * weights_)[m].sum() / weights_[m].sum()) if weights_[m].sum() else None
        self.prior = rate(full | ~full) or 0.0
        bare = rate(~full)
        self.bare = self.prior if bare is None else bare
        df = np.bincount(np.concatenate([v[0] for v in vectors]), minlength=len(self.weight)) if full.any() else np.zeros(0)
        common = np.argsort(-df, kind="stable")[:COMMON_WORDS]
        alike = [(labels[i], np.isin(common, vectors[i][0]).tobytes(), ids[i]) for i in range(len(ids))]
        keep = np.array(sorted(np.flatnonzero(full).tolist(), key=alike.__getitem__), np.int64)
        self.ids, self.labels, self.weights = np.array(ids, np.int64)[keep], labels_[keep], weights_[keep]
        self.blocks = -(-len(keep) // BLOCK)
        if not len(keep):
            return
        doc = np.repeat(np.arange(len(keep), dtype=np.int32), [len(vectors[i][0]) for i in keep])
        term, w = (np.concatenate([vectors[i][k] for i in keep]) for k in (0, 1))
        order = np.argsort(term, kind="stable")
        doc, term, w = doc[order], term[order], w[order]
        del order
        self.block_of = np.arange(len(keep)) // BLOCK
        self.column = np.full(len(self.weight), -1, np.int64)
        most = np.argsort(-df, kind="stable")[:COMMON]
        self.column[most] = np.arange(len(most))
        column = self.column[term]
        self.dense = np.zeros((len(most), len(keep)))
        self.dense[column[column >= 0], doc[column >= 0]] = w[column >= 0]
        self.dense_largest = np.maximum.reduceat(self.dense, np.arange(0, len(keep), BLOCK), axis=1)
        doc, term, w = doc[column < 0], term[column < 0], w[column < 0]
        # Runs: the entries of a feature in a block.
        block = doc // BLOCK
        runs = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.entries = doc, w
        self.runs = block[runs], np.maximum.reduceat(w, runs) if len(runs) else np.zeros(0), np.append(runs, len(doc))
        self.of_feature = np.searchsorted(term[runs], np.arange(len(self.weight) + 1))

    def common_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector what the common words add to the bounds of blocks and to the cosines of examples."""
        q = np.zeros((len(vectors), len(self.dense)))
        for row, (at, w) in zip(q, vectors):
            column = self.column[at]
            row[column[column >= 0]] = w[column >= 0]
        return q @ self.dense_largest, q @ self.dense

    def nearest(self, at: np.ndarray, w: np.ndarray, but: int | None = None, k: int = NEIGHBOURS, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples (by number) and cosines, nearest first; but: the id of one left out; common: the vector's common part."""
        (doc, weight), (block, largest, edge) = self.entries, self.runs
        bounds, products = common or (x[0] for x in self.common_part([(at, w)]))
        rare = self.column[at] < 0
        at, w = at[rare], w[rare]
        first, last = self.of_feature[at], self.of_feature[at + 1]
        run, q = spans(first, last), np.repeat(w, last - first)
        block = block[run]
        bound = np.bincount(block, q * largest[run], self.blocks) + bounds
        order = np.argsort(-bound, kind="stable")
        docs, scores, least = np.zeros(0, int), np.zeros(0), 0.0
        for part in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            chosen = np.zeros(self.blocks, bool)
            chosen[part] = (bound[part] > 0) & (bound[part] + 1e-9 >= least)
            m = chosen[block]
            a, b = edge[run[m]], edge[run[m] + 1]
            entry = spans(a, b)
            total = np.bincount(doc[entry], np.repeat(q[m], b - a) * weight[entry], len(self.ids))
            total = np.where(chosen[self.block_of], np.round(total + products, 12), 0)
            hit = np.flatnonzero(total)
            hit = hit[self.ids[hit] != but] if but is not None else hit
            docs, scores = np.concatenate([docs, hit]), np.concatenate([scores, total[hit]])
            best = np.lexsort((self.ids[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            least = scores[-1] if len(scores) == k else 0.0
        return docs, scores

    def vote(self, docs: np.ndarray, scores: np.ndarray) -> float:
        """Share of toxic among the nearest, each by its cosine and what it stands for, plus one faint vote for the prior."""
        w = scores * self.weights[docs] / max(self.weights.max(), 1e-12)
        faint = 1e-3
        return float(((w * self.labels[docs]).sum() + faint * self.prior) / (w.sum() + faint))

    def calibrate(self, votes: list[tuple[float, int, float]]) -> None:
        """Monotone rates of toxic by bins of votes (vote, label, weight)."""
        if not votes:
            return
        v, y, w = (np.array(x, float) for x in zip(*votes))
        bins = np.minimum((v * BINS).astype(int), BINS - 1)
        mass, toxic = np.bincount(bins, w, BINS), np.bincount(bins, w * y, BINS)
        unit = w.min()
        rate = [[(t + unit * (i + 0.5) / BINS) / (m + unit), m + unit, 1] for i, (t, m) in enumerate(zip(toxic, mass))]
        out: list = []
        for r in rate:
            out.append(r)
            while len(out) > 1 and out[-2][0] > out[-1][0]:
                (a, m, i), (b, n, j) = out[-2:]
                out[-2:] = [[(a * m + b * n) / (m + n), m + n, i + j]]
        self.bins = np.concatenate([[r] * n for r, _, n in out])

    def score_many(self, texts: list[str]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text its score, its nearest examples (by number) and their cosines."""
        vectors = [self.vector(t) for t in texts]
        none = np.zeros(0, int), np.zeros(0)
        if not len(self.ids):
            return [(self.bare, *none)] * len(texts)
        out = []
        for (at, w), *common in zip(vectors, *self.common_part(vectors)):
            if not len(at):
                out.append((self.bare, *none))
                continue
            docs, scores = self.nearest(at, w, common=tuple(common))
            v = self.vote(docs, scores)
            if self.bins is not None:
                v = float(np.interp(v, (np.arange(BINS) + 0.5) / BINS, self.bins))
            out.append((min(1.0, max(0.0, v)), docs, scores))
        return out

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        return self.score_many([text])[0]


def examples(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic, text) of the sampled examples, and how many labelled rows an example of each class stands for."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = some[0].unionByName(some[1])  # at most 2 * per_class rows
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return text.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), {c: n / min(n, per_class) for c, n in totals.items()}


def train(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS) -> Model:
    sample, stands_for = examples(docs, labels, per_class)

    def tokens(batches):
        for batch in batches:
            for part in slices(batch):
                found = [(f, y) for t, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()) for f in count_words(t)]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], names=["feature", "toxic"])

    sample = sample.persist()
    n = {c: sample.where(F.col("toxic") == c).count() for c in (0, 1)}
    counts = sample.mapInArrow(tokens, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b, n1, n0 = F.col("a"), F.col("b"), F.lit(max(1, n[1])), F.lit(max(1, n[0]))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    share = (a + b) / (n1 + n0)
    g2 = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    weight = F.log((n1 + n0 + 1) / (a + b)) * F.sqrt(1 + F.greatest(g2, F.lit(0.0)))
    chosen = counts.select("feature", weight.alias("weight")).toArrow().sort_by("feature")
    model = Model(chosen.column("feature").to_pylist(), chosen.column("weight").to_numpy())

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vectors(batches):
        for batch in batches:
            for part in slices(batch):
                v = [shared.value.counts(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *(pa.array([x[i].astype(np.int32) for x in v], pa.list_(pa.int32())) for i in (0, 1))], names=["doc_id", "toxic", "at", "tf"])

    rows = sample.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, at array<int>, tf array<int>").toArrow().sort_by("doc_id")
    sample.unpersist()
    shared.unpersist()
    v = [model.weigh(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(rows.column("at"), rows.column("tf"))]
    rows = rows.select(["doc_id", "toxic"]).to_pylist()
    weights = [stands_for[r["toxic"]] for r in rows]
    model.index([r["doc_id"] for r in rows], [r["toxic"] for r in rows], weights, v)
    votes = []
    for i in range(0, len(rows) if len(model.ids) else 0, 256):
        part = slice(i, i + 256)
        for r, x, w, *common in zip(rows[part], v[part], weights[part], *model.common_part(v[part])):
            if len(x[0]):
                docs_, scores = model.nearest(*x, but=r["doc_id"], common=tuple(common))
                votes.append((model.vote(docs_, scores), r["toxic"], w))
    model.calibrate(votes)
    del rows, v, votes
    give_back(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, evidence: bool = True) -> DataFrame:
    """Adds score, predicted and, if asked for, evidence (doc_id, cosine and label of the nearest examples) to documents with text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    of_example = ["doc_id", "cosine", "toxic"]

    def run(batches):
        m = shared.value
        m.known.use()
        for batch in batches:
            for part in slices(batch):
                found = m.score_many([t or "" for t in part.column("text").to_pylist()])
                s = np.array([x for x, _, _ in found], float)
                out = {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}
                if evidence:
                    near = np.concatenate([d for _, d, _ in found]).astype(np.int64)
                    near = [m.ids[near].astype(np.int64), np.concatenate([c for _, _, c in found]), m.labels[near].astype(np.int32)] if len(near) else [np.zeros(0, t) for t in (np.int64, float, np.int32)]
                    ends = pa.array(np.cumsum([0, *(len(d) for _, d, _ in found)]), pa.int32())
                    out["evidence"] = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x) for x in near], names=of_example))
                yield append(part, out)

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if evidence:
        kinds = (T.LongType(), T.DoubleType(), T.IntegerType())
        fields.append(T.StructField("evidence", T.ArrayType(T.StructType([T.StructField(n, k) for n, k in zip(of_example, kinds)]))))
    return docs.mapInArrow(run, with_fields(docs, *fields))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
