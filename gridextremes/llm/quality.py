"""Document quality from classifier evidence and hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD, packed

MAX_FIT_ROWS = 20_000  # labelled rows that the classifier is fitted on
RIDGE = 1.0


def features(text: Column) -> dict[str, Column]:
    """Shares that tell prose from junk, in columns; each pattern runs in linear time on any text.

    Runs of marks and words are matched possessively and only where they begin.
    Digits and letters are counted by what is left without runs of them or of others.
    """
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1))
    marks = r"[!-/:-@\[-`{-~]"

    def share(pattern: str, of: Column) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / of

    return {
        "marked_words": share(rf"(?<!{marks}){marks}{{2,}}+(?!\S)", words),
        "symbol_words": share(r"(?<!\S)[^\p{L}\p{N}\s]++(?!\S)", words),
        "repeated_words": share(r"(?<!\S)(\S++)\s++\1(?!\S)", words),
        "upper": share(r"\p{Lu}", chars),
        "digits": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Nd}+", ""))) / chars,
        "letters": F.length(F.regexp_replace(text, r"\P{L}+", "")) / chars,
        "word_chars": F.least(chars / words, F.lit(20.0)) / 20,
        "few_words": F.exp(-words / 50),
        "lines": share(r"\n", words),
    }


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: weights (intercept last), means and scales of the features."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``label_id, good, order`` of at most ``max_rows`` labelled ids, those first by a hash of the id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(
        F.when(F.avg(label_col) >= 0.5, 1.0).otherwise(0.0).alias("good"))
    return known.withColumn("order", F.xxhash64("label_id")).orderBy("order", "label_id").limit(max_rows)


def evidence(texts: DataFrame, sample: DataFrame, max_rows: int = MAX_FIT_ROWS) -> tuple[Column, float]:
    """log odds of a good document, as a column over ``text``; share of good ones in the fit.

    ``texts`` has ``label_id, text``. The sample of labels is broadcast: it has
    ``max_rows`` rows at most. Texts stay where they are; what comes back are the
    features of at most ``max_rows`` rows. Without rows of both kinds there is no
    evidence: 0 for every text.
    """
    found = texts.join(F.broadcast(sample), "label_id")
    names = list(features(F.col("text")))
    shown = found.select("order", "good", *[c.alias(n) for n, c in features(F.col("text")).items()])
    rows = shown.orderBy("order", *names).limit(max_rows).collect()
    y = np.array([r["good"] for r in rows])
    prior = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < prior < 1:
        return F.lit(0.0), prior
    w, mean, scale = fit(np.array([[r[n] for n in names] for r in rows]), y)
    total = F.lit(float(w[-1]))
    for n, c, weight, m, s in zip(names, features(F.col("text")).values(), w, mean, scale, strict=False):
        total = total + (c - F.lit(float(m))) * F.lit(float(weight / s))
    return F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0)), prior


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, mean: float) -> float:
    """Pseudo-counts of the prior, by moments: the less group means differ beyond chance, the more."""
    r = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("spread"),
        F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    inside = mean * (1 - mean)
    if not r["n"] or r["groups"] < 2 or inside <= 0:
        return 100.0
    between = (r["spread"] - (r["groups"] - 1) * inside) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(np.clip(inside / max(between, 1e-9) - 1, 1.0, 1000.0))


def judge(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", threshold: float = 0.5, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """``row``, ``evidence``, ``host_rate``, ``path_rate``, ``posterior``, ``kept`` of every row of ``docs``.

    A classifier gives each document the log odds of being good. Expected good
    documents are summed per path and host (map-side, one pass); a host's rate is
    shrunk towards the rate of the corpus and a path's towards its host's, by
    prior strengths estimated from how much hosts and paths differ. A document's
    own evidence is left out of its host and path, then combined with the rate:
    posterior odds = likelihood ratio of the text x odds of the path. Rejected are
    posteriors below ``threshold``.

    ``labels`` holds ``id_col`` and ``label_col`` (1 good, 0 bad); null labels and
    ids are ignored, conflicting ones averaged and halves rounded up. Statistics
    cover all rows; the classifier sees ``max_fit_rows`` labelled rows at most, those
    first by a hash of the id.
    Null or empty texts count as texts without words; null hosts and paths are a
    host and a path of their own; repeated rows are judged alike; an empty table
    gives an empty result; extra columns of any name stay in ``row``.
    """
    packed_docs = docs.select(packed(docs), host.alias("host"), path.alias("path"))
    text, key = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`")
    sample = sampled_labels(labels, id_col, label_col, max_fit_rows)
    odds, prior = evidence(packed_docs.select(key.alias("label_id"), text.alias("text")), sample, max_fit_rows)
    base = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    # Written with the rows: each text is searched once here, and the second look at the rows is a plain join.
    judged = materialise(packed_docs.withColumn("text", text).withColumn("odds", odds).drop("text"), "judged").withColumn(
        "p", _logistic(F.col("odds")))
    paths = materialise(judged.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("s"), F.sum("n")).first()
    mean = whole[0] / whole[1] if whole[1] else prior
    host_strength, path_strength = _strength(hosts, mean), _strength(paths, mean)
    rates = materialise(
        paths.withColumnsRenamed({"s": "path_s", "n": "path_n"}).alias("p")
        .join(hosts.withColumnsRenamed({"s": "host_s", "n": "host_n", "host": "of"}), F.col("host").eqNullSafe(F.col("of"))).drop("of"),
        "rates",
    ).withColumnsRenamed({"host": "of_host", "path": "of_path"})
    same = F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path"))
    host_rate = (host_strength * mean + F.col("host_s") - F.col("p")) / (host_strength + F.col("host_n") - 1)
    path_rate = (path_strength * F.col("host_rate") + F.col("path_s") - F.col("p")) / (path_strength + F.col("path_n") - 1)
    rate = F.least(F.greatest(F.col("path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return (
        judged.join(rates, same).withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
        .withColumn("posterior", _logistic(F.col("odds") - base + F.log(rate / (1 - rate))))
        .select("row", F.col("odds").alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("kept"))
    )
