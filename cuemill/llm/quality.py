"""Quality classifier: document evidence combined with host and path posteriors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import bounded_batches, fresh_worker, own_prefix, utf8, written


def features(text: str | None) -> np.ndarray:
    """Square roots of the byte shares, and how much of the words and lines repeats."""
    raw = utf8(text)
    n = max(1, len(raw))
    share = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n)
    words, lines = raw.split(), raw.split(b"\n")
    n_words = max(1, len(words))
    # The rest of a deflated text says how much of it repeats at any distance up to 32 KB.
    packed = sum(len(zlib.compress(raw[i:i + 32768], 1)) for i in range(0, len(raw), 32768))
    return np.concatenate([share, [np.log1p(len(raw)) / 10, len(set(words)) / n_words,
                                   min(30, len(raw) / n_words) / 10, len(set(lines)) / len(lines),
                                   packed / n]]).astype(np.float32)


N_FEATURES = 256 + 5


@dataclass
class Logistic:
    """Regularised logistic regression by Newton steps on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 0.01
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
        ridge[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(curve, z.T @ (p - y) + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -12, 12)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_labelled: int = 8000) -> Logistic | None:
    """Trained on at most ``max_labelled`` labelled documents, chosen by a hash of their ids.

    Only that sample's ids are broadcast and only its features reach the driver (about 1 KB each).
    Of rows that share an id the one with the smallest text hash is learned from.
    None if fewer than two classes are labelled.
    """
    bounded_batches(docs.sparkSession)
    sample = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
              .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(max_labelled))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"],
                                "x": [features(t).tobytes() for t in batch["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("y").alias("y"), F.min_by(
        "text", F.struct(F.xxhash64("text").alias("h"), "text")).alias("text")).mapInPandas(run, "id long, y double, x binary").collect()
    rows.sort(key=lambda r: (r.id, bytes(r.x)))
    if len({r.y for r in rows}) < 2:
        return None
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64)
    return Logistic.train(x, np.array([r.y for r in rows]))


def with_evidence(docs: DataFrame, model: Logistic | None, text_col: str, name: str) -> DataFrame:
    """Adds the classifier's log odds as ``name``; 0 without a model.

    Marked as not deterministic, or Spark would evaluate it a second time for a filter on what
    depends on it: each task would take another worker, which the executor then keeps.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fresh_worker()
        for batch in texts:
            if model is None:
                yield pd.Series(np.zeros(len(batch)))
            else:
                x = np.stack([features(t) for t in batch]) if len(batch) else np.zeros((0, N_FEATURES))
                yield pd.Series(model.logit(x))

    return docs.withColumn(name, evidence.asNondeterministic()(F.col(text_col)))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, value: str, prior: Column) -> float:
    """Beta prior strength from the spread of group means around their prior, by moments.

    Var(mean) = m (1 - m) (1 / n + (1 - 1 / n) / (strength + 1)), summed over groups by size.
    """
    m = F.least(F.greatest(prior, F.lit(1e-4)), F.lit(1 - 1e-4))
    row = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col(value) / F.col("n") - m, F.lit(2))).alias("seen"),
        F.sum(m * (1 - m)).alias("noise"), F.sum((F.col("n") - 1) * m * (1 - m)).alias("room")).first()
    if not row.room or row.seen is None:
        return 100.0
    spread = max((row.seen - row.noise) / row.room, 1e-4)  # 1 / (strength + 1)
    return float(min(max(1 / spread - 1, 2.0), 1e4))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """Per (host, path) the sums of soft evidence and the host's posterior; global mean, path strength.

    Hosts shrink towards the global rate, paths towards their host, each by a strength estimated
    from all groups: a path with few documents takes its host's rate, a sparse host the global one.
    Documents are summed per path first, then paths per host, so a hot host is pre-aggregated.
    """
    p = _sigmoid(F.col("evidence"))
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("good")), "paths")
    total = paths.agg(F.sum("good").alias("g"), F.sum("n").alias("n")).first()
    rate = (total.g + 1) / (total.n + 2) if total.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    strength = _strength(hosts, "good", F.lit(rate))
    hosts = hosts.select("host", ((F.col("good") + strength * rate) / (F.col("n") + strength)).alias("host_rate"))
    h, x = hosts.alias("h"), paths.alias("x")
    joined = written(x.join(h, F.col("x.host").eqNullSafe(F.col("h.host"))).select("x.*", "host_rate"), "sites")
    return joined, rate, _strength(joined, "good", F.col("host_rate"))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str,
            path_col: str, threshold: float, max_labelled: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with evidence, rates, score and decision, and the names of these columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, max_labelled=max_labelled)
    # First pass: evidence summed by site; only numbers are written. Second pass: the rows.
    narrow = with_evidence(docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"),
                                       F.col(text_col).alias("text")), model, "text", "evidence")
    sites, rate, strength = site_posteriors(written(narrow.drop("text"), "evidence"))
    p = own_prefix(docs)
    own = {c: f"{p}{c}" for c in ("host", "path", "n", "good", "host_rate", "path_rate", "evidence", "score", "keep")}
    col = {c: F.col(name) for c, name in own.items()}
    sites = sites.select(*[F.col(c).alias(own[c]) for c in ("host", "path", "n", "good", "host_rate")])
    rows = with_evidence(docs, model, text_col, own["evidence"]).join(
        sites, F.col(host_col).eqNullSafe(col["host"]) & F.col(path_col).eqNullSafe(col["path"]))
    others = F.greatest(col["good"] - _sigmoid(col["evidence"]), F.lit(0.0))
    path_rate = (others + strength * col["host_rate"]) / (col["n"] - 1 + strength)
    rows = rows.withColumn(own["path_rate"], F.least(F.greatest(path_rate, F.lit(1e-4)), F.lit(1 - 1e-4)))
    rate = min(max(rate, 1e-4), 1 - 1e-4)
    odds = F.log(col["path_rate"] / (1 - col["path_rate"])) - float(np.log(rate / (1 - rate)))
    score = _sigmoid(col["evidence"] + odds) if model else F.lit(0.5)
    rows = rows.withColumn(own["score"], score)
    return rows.withColumn(own["keep"], col["score"] >= threshold), own


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id",
                   text_col: str = "text", host_col: str = "source", path_col: str = "lang",
                   threshold: float = 0.5, max_labelled: int = 8000) -> DataFrame:
    """``id, evidence, host_rate, path_rate, score, keep`` per document.

    ``score`` is the classifier's probability with its log odds moved by how far the document's
    path, without the document itself, lies from the global rate. Tables without urls name a host
    and a path column: here the source and its language section. Null hosts and paths are groups of
    their own; a null text is an empty one; repeated rows are scored alike. Without two labelled
    classes every document has score 0.5 and is kept.
    """
    rows, own = _scored(docs, labels, id_col, text_col, host_col, path_col, threshold, max_labelled)
    return rows.select(F.col(id_col), *[F.col(own[c]).alias(c) for c in (
        "evidence", "host_rate", "path_rate", "score", "keep")])


def quality_filter(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id",
                   text_col: str = "text", host_col: str = "source", path_col: str = "lang",
                   threshold: float = 0.5, max_labelled: int = 8000) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    rows, own = _scored(docs, labels, id_col, text_col, host_col, path_col, threshold, max_labelled)
    return rows.where(F.col(own["keep"])).select(*[F.col(f"`{c}`") for c in docs.columns])
