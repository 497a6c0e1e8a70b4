"""Toxicity by maximum-scoring segments of token log-odds, calibrated as extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitway.llm.common import appended, free_name, table

#: The model is fitted on at most this many labelled rows (those with the smallest md5 of their id).
TRAINING_ROWS = 20_000
#: Rows whose crc32(id) mod 4 is HELD_OUT are never learnt from; of the others, CALIBRATE sets the calibration.
FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3
#: The prior counts a token PRIOR_LEAST times and PRIOR_SHARE of its total on either side. A token's smallest |z| and count to get a weight of its own, and the largest weight.
PRIOR_LEAST, PRIOR_SHARE, LEAST_Z, LEAST_COUNT, MOST = 0.5, 0.01, 3.0, 4, 8.0
#: What each token costs a segment, so that segments of common words drift down.
DRIFT = 0.7
#: Words that share so many first letters also share a stem token, for forms that training hasn't shown.
STEM = 5
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def segments(weights: list[float]) -> list[float]:
    """Scores of all maximal scoring segments."""
    return [b - a for a, b, _, _ in placed_segments(weights)]


def placed_segments(weights: list[float]) -> list[tuple[float, float, int, int]]:
    """(sum before it, sum at its end, first, last) of all maximal scoring segments, by one linear scan (Ruzzo and Tompa).

    A candidate is (sum before it, sum at its end); a new one absorbs those back to the nearest whose
    start lies lower, as long as that one's end lies lower than its own.
    """
    # Of each candidate: sums, first and last weight, and the nearest candidate before it that starts lower.
    kept: list[tuple[float, float, int, int, int]] = []
    total = 0.0
    for at, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        left, first = before, at
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= total:
                kept.append((left, total, first, at, j))
                break
            left, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [x[:4] for x in kept]


@dataclass(frozen=True)
class Model:
    """words and stems: log-odds less DRIFT; rate and log_k: the extreme-value law of clean texts; slope and base: a logistic map."""

    words: dict[str, float]
    stems: dict[str, float]
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    base: float = -2.0

    def runs(self, found: list[str]) -> tuple[list[float], list[int]]:
        """Weights and the token that each is of. Tokens that can't start a segment are summed up to the next that can."""
        words, stems = self.words, self.stems
        out: list[float] = []
        places: list[int] = []
        down = 0.0
        for i, t in enumerate(found):
            w = words.get(t)
            if w is None:
                w = stems.get(t[:STEM])
                if w is None:
                    down -= DRIFT
                    continue
            if w <= 0:
                down += w
                continue
            if down:
                out.append(down)
                places.append(i)
                down = 0.0
            out.append(w)
            places.append(i)
        return out, places

    def scores(self, text: str | None) -> tuple[list[float], int]:
        """Segment scores and the number of tokens."""
        found = tokens(text)
        return segments(self.runs(found)[0]), len(found)

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """(begin, end, evidence) of the segments that count in evidence(), as code points of the text."""
        lowered = (text or "").lower()
        if len(lowered) != len(text or ""):  # a few letters have two in lower case: those stay as they are
            lowered = "".join(x if len(x) == 1 else c for c in text or "" for x in [c.lower()])
        spots = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(lowered)]
        weights, places = self.runs([t for t, _, _ in spots])
        floor = self.log_k + math.log(max(len(spots), 1))
        return [(spots[places[i]][1], spots[places[j]][2], x) for a, b, i, j in placed_segments(weights) if (x := self.rate * (b - a) - floor) > 0]

    def evidence(self, text: str | None) -> float:
        """Sum over the segments that chance would show less than once in a text of this length (expected count K m exp(-rate S) < 1) of -ln of that count."""
        scores, m = self.scores(text)
        floor = self.log_k + math.log(max(m, 1))
        return sum(x for s in scores if (x := self.rate * s - floor) > 0)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * min(self.evidence(text), 50.0) + self.base))))


def _weights(counts: DataFrame) -> dict[str, dict[str, float]]:
    """Log-odds with an informative Dirichlet prior of each significant token: (kind, token, toxic, clean) -> kind -> token -> weight.

    Only significant tokens of a bounded sample reach the driver.
    """
    totals = {r["kind"]: (r["t"], r["c"], r["n"]) for r in counts.groupBy("kind").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.count("*").alias("n")).collect()}
    out: dict[str, dict[str, float]] = {"word": {}, "stem": {}}
    for kind, (t, c, kinds) in totals.items():
        prior = F.lit(PRIOR_LEAST) + F.lit(PRIOR_SHARE) * (F.col("toxic") + F.col("clean"))
        every = PRIOR_LEAST * kinds + PRIOR_SHARE * (t + c)
        side = lambda n, whole: F.log((F.col(n) + prior) / (F.lit(whole + every) - F.col(n) - prior))  # noqa: B023, E731
        odds = side("toxic", t) - side("clean", c)
        z = odds / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
        named = counts.where((F.col("kind") == kind) & (F.col("toxic") + F.col("clean") >= LEAST_COUNT)).withColumns({"odds": odds, "z": z}).where(F.abs("z") >= LEAST_Z)
        out[kind] = {r["token"]: max(-MOST, min(MOST, r["odds"])) - DRIFT for r in named.select("token", "odds").collect()}
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton steps with a light ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), a.T @ (y - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most TRAINING_ROWS labelled rows outside the held-out fold.

    Weights come from the folds other than CALIBRATE; the law of chance segments (a Gumbel law, by its
    moments over clean texts) and the logistic map from CALIBRATE. A row labelled more than once is
    toxic if any of its labels is; null labels, ids and texts aren't learnt from; of rows that share an
    id, the smallest text is. Without rows of both
    classes the model knows no token and scores all texts alike.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) != HELD_OUT))
    chosen = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).cast("int").alias("_toxic"))
    chosen = chosen.orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(TRAINING_ROWS)
    found = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "_id")
    # One row an id, so that repeated rows don't pass the bound.
    rows = found.groupBy("_id", "_toxic").agg(F.min("text").alias("text")).withColumn("fold", fold(F.col("_id")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for line, toxic in zip(b["line"], b["_toxic"], strict=True):
                both[int(toxic > 0)].update(set(tokens(line)))
        for kind, name in (("word", lambda t: t), ("stem", lambda t: t[:STEM] if len(t) >= STEM else None)):
            seen: dict[str, list[int]] = {}
            for toxic, own in both.items():
                for t, n in own.items():
                    if key := name(t):
                        seen.setdefault(key, [0, 0])[toxic] += n
            if seen:
                yield pd.DataFrame({"kind": [kind] * len(seen), "token": list(seen), "clean": [x[0] for x in seen.values()], "toxic": [x[1] for x in seen.values()]})

    # Each distinct line counts once for a class, and a token once a line: copies and repeats of one text prove no more than it.
    lines = rows.where(F.col("fold") != CALIBRATE).select(F.explode(F.split("text", "\n")).alias("line"), "_toxic").distinct()
    part = lines.mapInPandas(count, "kind string, token string, clean long, toxic long")
    counts = part.groupBy("kind", "token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    found = _weights(counts)
    counts.unpersist()
    model = Model(found["word"], found["stem"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [model.scores(t) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["_toxic"] > 0, "m": [max(m, 1) for _, m in own], "scores": [s for s, _ in own]})

    held = rows.where(F.col("fold") == CALIBRATE).select("text", "_toxic").mapInPandas(measure, "toxic boolean, m long, scores array<double>").toPandas()
    if held["toxic"].nunique() < 2:
        return model
    held = held.sort_values(["m", "toxic"], kind="stable")
    clean = held[~held["toxic"]]
    top = np.array([max(s, default=0.0) for s in clean["scores"]])
    logs = np.log(clean["m"].to_numpy(float))
    # For a Gumbel law S ~ (ln(K m) + G) / rate, whose variance is (pi^2 / 6) / rate^2 and whose mean fixes K.
    rate = float(np.clip(math.pi / math.sqrt(6 * max(float(top.var()), 1e-6)), 0.2, 3.0))
    log_k = float(rate * top.mean() - logs.mean() - 0.5772156649)
    fitted = Model(found["word"], found["stem"], rate, log_k)
    floor = log_k + np.log(held["m"].to_numpy(float))
    x = np.array([min(50.0, sum(v for s in own if (v := rate * s - f) > 0)) for own, f in zip(held["scores"], floor, strict=True)])
    slope, base = _logistic(x, held["toxic"].to_numpy(float))
    return Model(fitted.words, fitted.stems, rate, log_k, slope, base)


def score(documents: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """documents with column out_col (0 to 1); all rows, and all other columns, come back as they were.

    The whole text, however long, is read in one linear scan. Null and empty texts get the score of no
    evidence; repeated rows get the same score. Where documents have such a column already, underscores
    are put after the new one's name. An empty table gives no rows.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([model.score(t) for t in b], dtype=float)

    return documents.withColumn(free_name(documents, out_col), F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(F.col(text_col)))


def passages(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin, end, evidence of every significant toxic passage: code points [begin, end) of the text.

    A passage is a maximal segment that chance would show less than once in a text of its length;
    evidence is -ln of that expected count. Texts without one (null and empty texts too) give no row;
    repeated rows give theirs each.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = T.ArrayType(T.StructType().add("begin", "long").add("end", "long").add("evidence", "double"))
    found = appended(rows, "text", lambda texts: ([model.passages(t) for t in texts],), T.StructType().add("found", kind))
    return found.select("doc_id", F.explode("found").alias("one")).select("doc_id", "one.*")


def clean_rows(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with the columns that they had."""
    name = free_name(documents, "toxicity")
    return score(documents, model, text_col, name).where(F.col(name) < threshold).select(*(F.col(f"`{c}`") for c in documents.columns))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels)
    scored = score(documents.select("doc_id", "text"), model)
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
