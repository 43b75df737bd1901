"""Mixing sources to target weights, by soft membership and projected-gradient least squares.

1. Membership. A document whose source is a label belongs to it. For all others a
   multinomial naive Bayes classifier over hashed words, fitted on a bounded sample of labelled
   documents with a temperature fitted on held-out ones, gives the posterior of every domain.
2. Rates. Document d gets a nonnegative rate r_d, at most its cap (the expected max_repeats of its
   domains), such that the expected domain totals sum_d r_d * tokens_d * p_ds come as close as
   possible to share_s * total, in squares weighted by 1 / supply_s. Each step of the projected
   gradient is one distributed sum of as many numbers as there are targets; a document's rate is
   replayed from the steps so far, so nothing is kept or shuffled between steps.
3. Repeats. Rates become whole numbers by a hash of the document against a threshold for each domain,
   set from a histogram so that the rounded totals match too.

The total is the largest at which no source with any supply runs out, unless one is given.
A target without supply can't be served: its share stays 0 and the others keep their proportions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .near_duplicates import word_hashes
from .tokens import VOCABULARY, token_counts

FEATURES = 1 << 14
SAMPLE_PER_LABEL, MOST_LABELS = 1_000, 200


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count) of the hashed words."""
    doc, h = word_hashes(texts)
    cell, n = np.unique(doc * FEATURES + (h % np.uint64(FEATURES)).astype(np.int64), return_counts=True)
    return cell // FEATURES, cell % FEATURES, n


class DomainClassifier:
    """Naive Bayes with a temperature: scores are divided by it before they become posteriors."""

    def __init__(self, labels: list[str]):
        self.labels, self.weights, self.prior, self.temperature = labels, np.zeros((len(labels), FEATURES)), np.zeros(len(labels)), 1.0

    def scores(self, texts: list[str]) -> np.ndarray:
        doc, feature, n = _rows(texts)
        out = np.tile(self.prior, (len(texts), 1))
        np.add.at(out, doc, np.log1p(n)[:, None] * self.weights[:, feature].T)
        return out

    def posteriors(self, texts: list[str]) -> np.ndarray:
        s = self.scores(texts) / self.temperature
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, labels: list[str], seed: int = 3) -> "DomainClassifier":
        self = cls(labels)
        held = np.random.default_rng(seed).random(len(texts)) < 0.2
        train = np.flatnonzero(~held)
        doc, feature, n = _rows([texts[i] for i in train])
        counts = np.full((len(labels), FEATURES), 0.1)
        np.add.at(counts, (y[train][doc], feature), np.log1p(n))
        self.weights = np.log(counts / counts.sum(1, keepdims=True))
        self.prior = np.log((np.bincount(y[train], minlength=len(labels)) + 1.0) / (len(train) + len(labels)))
        test = np.flatnonzero(held)
        if len(test):
            s = self.scores([texts[i] for i in test])

            def loss(t: float) -> float:
                z = s / t
                z = z - z.max(1, keepdims=True)
                return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(test)), y[test]]).mean())

            self.temperature = min([1, 2, 4, 8, 16, 32, 64, 128], key=loss)
        return self


def normal_label(source: str = "source"):
    """Labels without case and outer white space."""
    return F.lower(F.trim(F.regexp_replace(source, r"\s+", " ")))


def memberships(documents: DataFrame, targets: list[tuple[str, float, int]], vocabulary: str = VOCABULARY, seed: int = 3, sample_per_label: int = SAMPLE_PER_LABEL, most_labels: int = MOST_LABELS) -> DataFrame:
    """(id, label, n_tokens, p array<double>, cap) of the documents with tokens and some share in a
    target; p follows the order of targets. label is null where the classifier gave p, which is where there is no label. A label that isn't
    a target is another source, however many there are. The classifier is fitted on at most sample_per_label documents of each
    target and of the most_labels most frequent other labels."""
    docs = documents.select("doc_id", "text", normal_label().alias("label")).where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull())
    known = docs.where(F.col("label") != "")
    # per label at most sample_per_label documents, those with the smallest hashes
    names_of = [t for t, _, _ in targets]
    sizes = known.groupBy("label").count()
    others = sizes.where(~F.col("label").isin(names_of)).orderBy(F.desc("count"), "label").limit(most_labels)
    counts = {r.label: r["count"] for r in sizes.where(F.col("label").isin(names_of)).unionByName(others).collect()}
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, min(1.0, sample_per_label / n)).otherwise(rate)
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) < rate * 1_000_003).select("label", "text").toPandas()
    labels = sorted(set(sample.label))
    index = {s: i for i, s in enumerate(labels)}
    model = DomainClassifier.fit(list(sample.text), np.array([index[s] for s in sample.label], int), labels, seed) if labels else None
    column = [index.get(s) for s, _, _ in targets]
    place = {s: i for i, (s, _, _) in enumerate(targets)}
    caps = np.array([c for _, _, c in targets], float)
    names = ["doc_id", "label", "n_tokens", "p", "cap"]
    id_type = documents.schema["doc_id"].dataType.simpleString()
    # documents of a known source that isn't a target have no share and aren't tokenised
    wanted = docs.where(F.col("label").isNull() | (F.col("label") == "") | F.col("label").isin(list(place)))
    counted = token_counts(wanted, "doc_id", "text", ["label", F.when(F.col("label").isin(list(place)), F.lit(None)).otherwise(F.col("text")).alias("soft")], vocabulary).where(F.col("n_tokens") > 0)

    def assign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            label = b.column(1).to_pylist()
            p = np.zeros((len(label), len(targets)))
            soft = [i for i, s in enumerate(label) if s not in place]
            for i, s in enumerate(label):
                if s in place:
                    p[i, place[s]] = 1.0
            if soft and model:
                texts = b.column(2).to_pylist()
                post = model.posteriors([texts[i] for i in soft])
                for t, c in enumerate(column):
                    if c is not None:
                        p[soft, t] = post[:, c]
            offsets = np.arange(len(label) + 1, dtype=np.int32) * len(targets)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s if s in place else None for s in label], pa.string()), b.column(3), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.ravel())), pa.array(p @ caps)], names=names
            )

    return counted.mapInArrow(assign, f"doc_id {id_type}, label string, n_tokens int, p array<double>, cap double").where("cap > 0")


def _replay(p: np.ndarray, cap: np.ndarray, start: float, steps: list[np.ndarray]) -> np.ndarray:
    r = np.minimum(start, cap)
    for s in steps:
        r = np.clip(r - p @ s, 0.0, cap)
    return r


def _columns(b: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = b.column(b.schema.get_field_index("n_tokens")).to_numpy().astype(float)
    p = b.column(b.schema.get_field_index("p")).flatten().to_numpy().reshape(-1, n)
    return t, p, b.column(b.schema.get_field_index("cap")).to_numpy()


def _sums(members: DataFrame, n: int, of) -> np.ndarray:
    """Distributed sum of of(tokens, p, cap, batch), an array of a fixed length."""

    def part(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in source:
            v = of(*_columns(b, n), b)
            total = v if total is None else total + v
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "v"])

    got = members.mapInArrow(part, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max([r.k for r in got], default=-1) + 1)
    for r in got:
        out[r.k] = r.v
    return out


def fit_rates(members: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None, rounds: int = 40, tolerance: float = 1e-4) -> tuple[float, list[np.ndarray], np.ndarray]:
    """(first rate, steps, goal of each target in tokens). Documents of one label have one membership and one cap, hence one rate: they are
    added up once and iterated as one row each. Only documents whose membership the classifier gave are read at every step."""
    n = len(targets)
    pad = lambda v, m: np.r_[v, np.zeros(m - len(v))]
    both = pad(_sums(members, n, lambda t, p, cap, b: np.r_[(t * cap) @ p, t @ p]), 2 * n)
    most, once = both[:n], both[n:]
    labelled, soft = members.where("label is not null"), members.where("label is null")
    tokens = pad(_sums(labelled, n, lambda t, p, cap, b: t @ p), n)
    soft = materialize(soft, "soft")
    any_soft = not soft.isEmpty()
    caps = np.array([c for _, _, c in targets], float)
    share = np.array([s for _, s, _ in targets]) * (most > 0)
    if not share.sum():
        return 0.0, [], np.zeros(n)
    share /= share.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        size = float(np.min(np.where(share > 0, most / share, np.inf))) if total is None else float(total)
    goal = share * size
    start = size / max(once.sum(), 1.0)
    steps: list[np.ndarray] = []
    before = None
    for _ in range(rounds):
        reached = tokens * _replay(np.eye(n), caps, start, steps)
        if any_soft:
            reached = reached + pad(_sums(soft, n, lambda t, p, cap, b: (t * _replay(p, cap, start, steps)) @ p), n)
        off = reached - goal
        # met, or as near as documents that serve several targets allow: the totals don't move any more
        if np.abs(off).max() <= tolerance * size or (before is not None and np.abs(reached - before).max() <= tolerance * size):
            break
        before = reached
        step = np.where(once > 0, off / np.maximum(once, 1.0), 0.0)
        if steps and np.abs(step).max() < 1e-6:
            break
        steps.append(step)
    return start, steps, goal


BINS = 1024


def mix(documents: DataFrame, mix_targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY, seed: int = 3) -> DataFrame:
    """The documents chosen: (doc_id, source, soft, n_tokens, repeats). source is the target with the
    greatest membership; soft tells that the classifier gave it.

    Null or empty texts aren't chosen. Repeated rows of a document are different documents here, as doc_id is
    unique; null labels and unknown ones are classified. An empty table or no target gives an empty result.
    """
    rows = mix_targets.where("source is not null and target_share >= 0 and max_repeats > 0").select(normal_label().alias("s"), "target_share", "max_repeats").dropDuplicates(["s"]).orderBy("s").collect()
    targets = [(r.s, r.target_share, r.max_repeats) for r in rows]  # one row for each source of the mixture
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, source string, soft boolean, n_tokens int, repeats int"
    if not targets:
        return documents.sparkSession.createDataFrame([], schema)
    members = materialize(memberships(documents, targets, vocabulary, seed).withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)), "members")
    start, steps, goal = fit_rates(members, targets, total)
    n, labels = len(targets), np.array([s for s, _, _ in targets])

    def crossing(t, p, cap, b):
        """Tokens that each domain gains when its threshold falls below each bin."""
        r, u = _replay(p, cap, start, steps), b.column(b.schema.get_field_index("u")).to_numpy()
        low = np.floor(r + 1e-9)
        more = (r - low > 1e-9) | (low < np.floor(cap + 1e-9))
        top = p.argmax(1)
        # a document is raised once the threshold of its domain is under frac - u, from 1 down to -1
        at = np.clip(((1.0 - (r - low - u)) / 2 * BINS).astype(int), 0, BINS - 1)
        out = np.zeros(n * (BINS + 1))
        np.add.at(out, top[more] * (BINS + 1) + 1 + at[more], t[more])
        np.add.at(out, top * (BINS + 1), t * low)
        return out

    got = _sums(members, n, crossing)
    got = np.r_[got, np.zeros(n * (BINS + 1) - len(got))].reshape(n, BINS + 1)
    reached = np.cumsum(got, axis=1)
    limit = np.abs(reached - goal[:, None]).argmin(1)  # bins below it are raised

    def choose(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            t, p, cap = _columns(b, n)
            r, u = _replay(p, cap, start, steps), b.column(b.schema.get_field_index("u")).to_numpy()
            low = np.floor(r + 1e-9)
            more = (r - low > 1e-9) | (low < np.floor(cap + 1e-9))
            top = p.argmax(1)
            at = np.clip(((1.0 - (r - low - u)) / 2 * BINS).astype(int), 0, BINS - 1)
            repeats = (low + (more & (at < limit[top]))).astype(np.int32)
            label = b.column(b.schema.get_field_index("label"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(labels[top].tolist(), pa.string()), label.is_null(), b.column(b.schema.get_field_index("n_tokens")), pa.array(repeats)],
                names=["doc_id", "source", "soft", "n_tokens", "repeats"],
            )

    return members.mapInArrow(choose, schema).where("repeats > 0")


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, n_tokens, n_documents, most_repeats) of every target."""
    goal = mix_targets.where("source is not null").select(normal_label().alias("source"), "target_share").dropDuplicates(["source"])
    got = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("repeats").alias("most_repeats")
    )
    whole = got.agg(F.sum("n_tokens").alias("whole"))
    return (
        goal.join(got, "source", "left").crossJoin(F.broadcast(whole))
        .select("source", "target_share", (F.coalesce("n_tokens", F.lit(0)) / F.col("whole")).alias("reached_share"),
                F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    )
