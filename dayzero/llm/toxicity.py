"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are a text's words and their beginnings of 4, 5 and 6 letters, each as log(1 + count). One weight per feature is
shared by all grades; ordered thresholds part them: P(grade > k) = logistic(w . x - threshold k). A text's severity is
its expected grade, and it is toxic if a grade above 0 is more likely than not.

The labels only tell toxic from clean. A labelled clean text has grade 0; a labelled toxic one has grade 1 to 3 by the
number of its words with a telling feature (one that nearly only toxic texts hold), with the bounds GRADE_HITS.

The model is fitted on a bounded sample of the labelled texts (about SAMPLE of them, the same ones whenever the labels
are the same): features are counted per part of the sample and summed, the FEATURES that tell most are kept, and one task
fits their weights. All documents are scored, each by its whole text.

Null or empty texts have severity 0. Without labelled texts of both kinds nothing is known, and every text has severity 0. Several labels of one id count as
their largest; null labels or ids count as none. Repeated rows are scored one by one; an empty table gives an empty
result. Input columns are carried in one struct, so they may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayzero.llm.common import written

SAMPLE = 16_000
FEATURES = 2_000
GRADE_HITS = (2, 5)
#: A feature is telling if this share of the texts that hold it is toxic, of at least TELLING_TEXTS.
TELLING_SHARE, TELLING_TEXTS = 0.9, 3
MIN_TEXTS = 3
PENALTY, STEPS, RATE = 5e-5, 600, 0.1
TOXIC = 0.5
GRADES = len(GRADE_HITS) + 1
BEGINNINGS = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")
#: Words whose features a worker remembers before it starts anew.
REMEMBERED = 200_000


def features(word: str) -> tuple[str, ...]:
    return (word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n])


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]


class Scorer:
    """Severity of texts; remembers which words hold features of the model."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def held(self, text: str | None) -> Counter:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, weights = self.known, self.model.weights
        found: Counter = Counter()
        for word, n in Counter(words(text)).items():
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(f for f in features(word) if f in weights)
            for f in own:
                found[f] += n
        return found

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for each k."""
        total = math.fsum(self.model.weights[f] * math.log1p(n) for f, n in self.held(text).items())
        return [1 / (1 + math.exp(min(700.0, t - total))) for t in self.model.thresholds]


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """text and toxic of the labelled documents in the sample; of rows that share an id one text, so the sample is bounded."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg((F.max("toxic") > 0).alias("toxic"))
    )
    share = min(1.0, sample / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("l_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About `sample` rows of nine bytes, whatever the tables hold.
    texts = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(picked), F.col("d_id") == F.col("l_id"))
    return found.groupBy("l_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def _feature_counts(rows: DataFrame) -> DataFrame:
    """feature, n_texts, n_toxic over the sample."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_texts, toxic_texts = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                own = {f for w in set(words(text)) for f in features(w)}
                all_texts.update(own)
                if toxic:
                    toxic_texts.update(own)
        if all_texts:
            yield pd.DataFrame(
                {"feature": list(all_texts), "n_texts": list(all_texts.values()), "n_toxic": [toxic_texts[f] for f in all_texts]}
            )

    counted = rows.mapInPandas(count, "feature string, n_texts long, n_toxic long")
    return counted.groupBy("feature").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_toxic").alias("n_toxic"))


def fit_ordinal(found: list[dict[str, float]], grades: np.ndarray, names: list[str]) -> Model:
    """Weights and thresholds by full gradient steps (Adam) on the mean log-likelihood with a squared penalty."""
    index = {f: i for i, f in enumerate(names)}
    rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
    cols = np.array([index[f] for x in found for f in x], dtype=np.int64)
    values = np.array([v for x in found for v in x.values()], dtype=np.float64)
    n = len(found)
    params = np.zeros(len(names) + GRADES)
    reached = [float(np.mean(grades > k)) for k in range(GRADES)]
    params[len(names)] = -math.log(max(reached[0], 1e-6) / max(1 - reached[0], 1e-6))
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        weights = params[: len(names)]
        # The gaps between thresholds are exponentials, which keeps them in order.
        gaps = np.exp(params[len(names) + 1 :])
        thresholds = params[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights[cols] * values, minlength=n)
        above = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -500, 500)))
        # P(grade = k) is a difference of neighbours; its slope by the score follows from those of above.
        edges = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        slopes = edges * (1 - edges)
        at = np.arange(n)
        chance = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
        by_score = -(slopes[at, grades] - slopes[at, grades + 1]) / chance / n
        by_threshold = np.zeros(GRADES)
        np.add.at(by_threshold, grades[grades > 0] - 1, (slopes[at, grades] / chance / n)[grades > 0])
        np.add.at(by_threshold, grades[grades < GRADES], -(slopes[at, grades + 1] / chance / n)[grades < GRADES])
        slope = np.concatenate(
            [
                np.bincount(cols, by_score[rows] * values, minlength=len(names)) + PENALTY * weights,
                [by_threshold.sum()],
                gaps * np.cumsum(by_threshold[::-1])[::-1][1:],
            ]
        )
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        params = params - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(params[len(names) + 1 :])
    thresholds = params[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)])
    return Model({f: float(w) for f, w in zip(names, params, strict=False)}, tuple(map(float, thresholds)))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text"
) -> Model | None:
    """The model, or None without labelled texts of both kinds."""
    rows = written(_sampled(docs, labels, sample, id_col, text_col), "toxicity-sample")
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic"), 1)).alias("toxic")).first()
    if not sizes["toxic"] or sizes["toxic"] == sizes["n"]:
        return None
    n, toxic = float(sizes["n"]), float(sizes["toxic"])
    # How unlike chance the share of toxic texts is among those with the feature: (seen - expected)^2 / variance.
    expected = F.col("n_texts") * (toxic / n)
    scored = _feature_counts(rows).where(F.col("n_texts") >= MIN_TEXTS).withColumn(
        "score", (F.col("n_toxic") - expected) ** 2 / (expected * (1 - toxic / n))
    )
    chosen = scored.orderBy(F.desc("score"), "feature").limit(n_features).collect()
    if not chosen:
        return None
    names = sorted(r["feature"] for r in chosen)
    telling = {
        r["feature"] for r in chosen if r["n_texts"] >= TELLING_TEXTS and r["n_toxic"] >= TELLING_SHARE * r["n_texts"]
    }
    empty = Model(dict.fromkeys(names, 0.0), ())

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, place = Scorer(empty), {f: i for i, f in enumerate(names)}
        for batch in batches:
            out = []
            for text, bad in zip(batch["text"], batch["toxic"], strict=True):
                held = scorer.held(text)
                hits = sum(any(f in telling for f in features(w)) for w in words(text))
                grade = 1 + sum(hits > bound for bound in GRADE_HITS) if bad else 0
                out.append((grade, [place[f] for f in held], [math.log1p(c) for c in held.values()]))
            yield pd.DataFrame(out, columns=["grade", "places", "amounts"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        found = [{names[p]: v for p, v in zip(ps, vs, strict=True)} for ps, vs in zip(rows["places"], rows["amounts"], strict=True)]
        model = fit_ordinal(found, rows["grade"].to_numpy().astype(np.int64), names)
        return pd.DataFrame({"weights": [[model.weights[f] for f in names]], "thresholds": [list(model.thresholds)]})

    table = rows.mapInPandas(numbered, "grade int, places array<int>, amounts array<double>")
    done = table.groupBy().applyInPandas(fit, "weights array<double>, thresholds array<double>").first()
    return Model(dict(zip(names, done["weights"], strict=True)), tuple(done["thresholds"]))


def _scoring(model: Model | None, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in batches:
            above = []
            for text in batch.column(0).field(text_at):
                text = text.as_py()
                own = scorer.above(text) if scorer and text else [0.0] * GRADES
                above.append(own)
            severity = [math.fsum(a) for a in above]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(severity, pa.float64()),
                    pa.array([sum(p > 0.5 for p in a) for a in above], pa.int32()),
                    pa.array([a[0] for a in above], pa.float64()),
                    pa.array([a[0] > TOXIC for a in above], pa.bool_()),
                ],
                names=["row", "severity", "grade", "p_toxic", "toxic"],
            )

    return run


def grade_documents(docs: DataFrame, model: Model | None, carried: list[str], text_col: str = "text") -> DataFrame:
    """row (struct of the carried columns), severity, grade (the median one), p_toxic and toxic of every row."""
    # The text is sent once: with the carried columns if it is one of them, else behind them and dropped again.
    sent = [*carried, *([] if text_col in carried else [text_col])]
    read = docs.select(F.struct(*[F.col(c) for c in sent]).alias("row"))
    row_type = read.schema["row"].dataType.simpleString()
    scored = read.mapInArrow(
        _scoring(model, sent.index(text_col)), f"row {row_type}, severity double, grade int, p_toxic double, toxic boolean"
    )
    return scored if sent == carried else scored.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in carried]))
