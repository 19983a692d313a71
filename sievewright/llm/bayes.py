"""Quality by hierarchical empirical Bayes.

A logistic model on a text's counts gives the evidence of the document alone. Hosts and paths (for documents:
source, and language within it) have good rates of their own: the soft counts of their texts are summed, each
host's rate is shrunk toward the corpus', each path's toward its host's, by Beta priors whose strengths are
estimated from how much the groups differ. Evidence and the path's posterior odds are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, free, small, without
from .quality import COUNTS, _counts
from .textkernel import words

SAMPLE = 20_000  # labelled rows that the document classifier is fitted on at most, chosen by a hash of the id
STRONGEST = 12.0  # limit of a text's own evidence, in log odds
FEATURES = ("log_words", "word_length", "symbol_share", "line_repeat_share", "window_repeat_share", "next_repeat_share", "upper_share")


def _features(chunk) -> np.ndarray:
    c = _counts(chunk, 8).astype(float)
    n, rows = len(chunk.rows) - 1, chunk.rows
    hashes = chunk.hashes(lower=True)
    row_of = np.repeat(np.arange(n), np.diff(chunk.first))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row_of[1:] == row_of[:-1])
    again = np.bincount(row_of[same], minlength=n)
    upper = np.diff(np.concatenate(([0], np.cumsum((chunk.raw >= 65) & (chunk.raw <= 90))))[rows])
    w, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 3], 1)
    return np.column_stack([np.log1p(c[:, 0]), c[:, 1] / w, np.minimum(c[:, 2] / w, 3), c[:, 4] / lines, c[:, 5] / w, again / w, upper / chars])


def with_features(docs: DataFrame, text: str = "text", name: str = "_f") -> DataFrame:
    """``docs`` with an array column ``name`` of FEATURES; a null or empty text has zeros."""
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            parts = [_features(chunk) for chunk in words(batch.column(at))]
            made = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * len(FEATURES)), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, f], [*names, name])

    return docs.mapInArrow(run, docs.select("*", F.array().cast("array<double>").alias(name)).schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[list[float], list[float], list[float]]:
    """(weights with the intercept first, means, scales) of a ridge logistic regression of the quality label.

    The intercept is that of balanced classes, so the model gives evidence, not a prior. Fitted on ``sample``
    labelled ids at most; without both classes all weights are zero.
    """
    ids = labels.where(f"quality is not null and {id_col} is not null").groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("y"))
    ids = F.broadcast(ids.orderBy(F.xxhash64("id"), "id").limit(sample))  # sample rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(ids, "id").select("id", "y", F.xxhash64("text").alias("mark"), "text")
    # of rows with one id the one whose text has the least hash, so neither order nor repeats change the model
    one = with_features(rows, "text", "f").groupBy("id").agg(F.min("y").alias("y"), F.min_by("f", F.struct(F.col("mark"), "f")).alias("f"))
    got = one.select("f", "y").collect()  # sample rows
    x, y = np.array([r.f for r in got], float), np.array([r.y > 0 for r in got], float)
    k = len(FEATURES)
    if not len(y) or y.min() == y.max():
        return [0.0] * (k + 1), [0.0] * k, [1.0] * k
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta, ridge = np.zeros(k + 1), np.diag([1e-6] + [1.0] * k)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta.tolist(), mean.tolist(), scale.tolist()


def evidence(f: Column, model: tuple) -> Column:
    """Log odds of a good text from its features alone, between -STRONGEST and STRONGEST."""
    beta, mean, scale = model
    total = F.lit(beta[0])
    for i in range(len(FEATURES)):
        total += F.lit(beta[i + 1]) * (f[i] - F.lit(mean[i])) / F.lit(scale[i])
    return F.greatest(F.least(total, F.lit(STRONGEST)), F.lit(-STRONGEST))


def _strength(n: str, good: str, rate: str) -> Column:
    """Beta strength from the spread of group rates beyond what counting alone gives (method of moments)."""
    chance = F.sum(F.col(rate) * (1 - F.col(rate)))
    spread = F.sum(F.pow(F.col(good) / F.col(n) - F.col(rate), 2) - F.col(rate) * (1 - F.col(rate)) / F.col(n))
    return F.greatest(F.lit(2.0), F.least(F.lit(1000.0), F.when(spread > 0, chance / spread - 1).otherwise(1000.0)))


class Model:
    """The document classifier, and the rates of hosts and paths, of ``docs``.

    Null hosts and paths are groups of their own. Without labels all rests on the priors. Rates are exact sums, so the
    order of rows and tasks that run twice change nothing.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text: str, host: str, path: str, sample: int):
        self.scratch = scratch = Scratch(docs.sparkSession, "bayes")
        self.own = fit(docs, labels, id_col, text, sample)
        self.columns = [F.col(id_col).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), F.xxhash64(text, host, path).alias("mark"), F.col(text).alias("text")]
        slim = with_features(docs.select(self.columns), "text", "f")
        #: (id, host, path, mark, e) of every row: a hash of its text and group, and its own evidence
        self.rows = scratch.table(slim.select("id", "host", "path", "mark", evidence(F.col("f"), self.own).alias("e")), "evidence")
        soft = 1 / (1 + F.exp(-F.col("e")))
        paths = scratch.table(self.rows.groupBy("host", "path").agg(F.count("*").alias("n"), (F.sum(F.round(soft * 1e6).cast("long")) / 1e6).alias("good")), "paths")
        whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
        overall = (whole.good + 1.0) / (whole.n + 2.0) if whole.n else 0.5
        hosts = scratch.table(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("rate", F.lit(overall)), "hosts")
        k = hosts.agg(_strength("n", "good", "rate")).first()[0] or 1000.0
        hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + k * F.col("rate")) / (F.col("n") + k)).alias("host_rate"))
        both = scratch.table(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "both")
        k = both.agg(_strength("n", "good", "host_rate")).first()[0] or 1000.0
        #: (of_host, of_path, rates: struct of host_rate and path_rate)
        self.rates = scratch.table(both.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), F.struct("host_rate", ((F.col("good") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")).alias("rates")), "rates")


def _score(own: Column, rates: Column) -> Column:
    at = rates["path_rate"]
    return 1 / (1 + F.exp(-(own + F.log(at / (1 - at)))))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(id, host, path, mark, evidence, host_rate, path_rate, score, kept: score >= least) of every row of ``docs``.

    Rows are judged one by one; repeated ids, equal rows, nulls and other columns, whatever their names, do no harm.
    Without labels everything is kept. An empty table gives an empty result. Texts are read once, and never shuffle.
    """
    m = Model(docs, labels, id_col, text, host, path, sample)
    both = m.rows.join(small(m.rates), F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left")
    score = _score(F.col("e"), F.col("rates"))
    return both.select("id", "host", "path", "mark", F.col("e").alias("evidence"), "rates.host_rate", "rates.path_rate", score.alias("score"), (score >= least).alias("kept"))


def passed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, in all their columns, whatever the names of these.

    With a counted, broadcast table of rates texts are read a second time and never shuffle. With more paths than may be
    broadcast, the ids of rejected rows go out by an anti join, which shuffles by a hash of the row.
    """
    m = Model(docs, labels, id_col, text, host, path, sample)
    f, of_host, of_path, rates = free(docs.columns, "f", "of_host", "of_path", "rates")
    if m.rates.count() > BROADCAST_ROWS:
        met = m.rows.join(m.rates, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
        out = met.where(_score(F.col("e"), F.col("rates")) < least).select("id", "mark").distinct()
        return without(docs, m.scratch.table(out, "rejected"), id_col, F.xxhash64(text, host, path))
    known = F.broadcast(m.rates.withColumnsRenamed({"of_host": of_host, "of_path": of_path, "rates": rates}))
    both = with_features(docs, text, f).join(known, F.col(host).eqNullSafe(F.col(of_host)) & F.col(path).eqNullSafe(F.col(of_path)), "left")
    return both.where(_score(evidence(F.col(f), m.own), F.col(rates)) >= least).select(*docs.columns)
