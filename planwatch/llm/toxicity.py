"""Toxicity by a logistic model with a counterfactual penalty on identity terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, modest, stored

#: Groups of terms that a neutral sentence may name interchangeably.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
#: Of a labelled corpus, at most so many documents teach the model: those of least hash.
SAMPLE = 12_000
PREFIXES = (3, 4, 5)
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """A text's distinct lower-case words and, marked by a hyphen, the first letters of longer ones."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:k] + "-" for k in PREFIXES for w in words if len(w) > k}


class Model:
    """bias + the weights of the features that a text has, as log odds."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = {f: w for f, w in weights.items() if f[-1] != "-"}
        self.starts = {k: {f[:-1]: w for f, w in weights.items() if f[-1] == "-" and len(f) == k + 1} for k in PREFIXES}

    def logit(self, text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        out = self.bias + sum(self.words[f] for f in sorted(self.words.keys() & words))
        for k, of in self.starts.items():
            out += sum(of[f] for f in sorted(of.keys() & {w[:k] for w in words if len(w) > k}))
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -500, 500))))


def swaps(text: str, label: int, number: int) -> list[tuple[set[str], set[str]]]:
    """Features that counterfactuals of a labelled text add and take away.

    In each sentence every identity term is swapped for each other of its group; a text that isn't toxic also
    gets one neutral mention added, of the term whose turn number it is.
    """
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        words = {w.lower() for w in WORD.findall(sentence)}
        for group in IDENTITY_TERMS:
            for term in sorted(words & set(group)):
                before = features(sentence)
                for other in [g for g in group if g != term]:
                    after = features(re.sub(rf"\b{term}\b", other, sentence, flags=re.I))
                    out.append((after - before, before - after))
    if not label:
        terms = [t for g in IDENTITY_TERMS for t in g]
        out.append((features(terms[number % len(terms)]) - features(text), set()))
    return out


def fit(names: list[str], docs: list[np.ndarray], labels: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]], l1: float = 1.5, swap_weight: float = 1.0, steps: int = 400) -> Model:
    """A sparse logistic model by proximal gradient steps with momentum and an L1 penalty of l1 / documents.

    docs: each document's features, as places in names. changes: the features and signs of each of swaps(); swap_weight
    weighs the mean square of the change of log odds. The classes weigh as the square roots of their sizes. With no
    document, or but one class, the model is constant: without a toxic example no text is toxic.
    """
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model({}, 6.0 if len(y) and y[0] else -6.0)
    n, m, k = len(y), max(len(changes), 1), len(names)
    rows, cols = np.repeat(np.arange(n), [len(d) for d in docs]), np.concatenate([*docs, np.empty(0)]).astype(np.int64)
    srow = np.repeat(np.arange(len(changes)), [len(c) for c, _ in changes])
    scol, sign = (np.concatenate([np.empty(0), *(c[i] for c in changes)]) for i in (0, 1))
    scol = scol.astype(np.int64)
    even = np.where(y == 1, np.sqrt((y == 0).sum() / (y == 1).sum()), 1.0)
    even /= even.mean()

    def pull(v: np.ndarray) -> np.ndarray:
        """The gradient of the penalty on changes of log odds."""
        change = np.bincount(srow, sign * v[scol], m)
        return 2 * swap_weight / m * np.bincount(scol, sign * change[srow], k)

    def curved(x: np.ndarray) -> np.ndarray:
        """The largest curvature that the loss can have, times x (the last element: the bias)."""
        u = even / (4 * n) * (np.bincount(rows, x[:-1][cols], n) + x[-1])
        return np.append(np.bincount(cols, u[rows], k) + pull(x[:-1]), u.sum())

    x = np.ones(k + 1)
    for _ in range(12):
        x = curved(x / np.linalg.norm(x))
    rate = 0.9 / np.linalg.norm(x)
    w, b = np.zeros(k), float(np.log((even * y).sum() / (even * (1 - y)).sum()))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        z = np.bincount(rows, v[cols], n) + vb
        g = even * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        step = v - rate * (np.bincount(cols, g[rows], k) + pull(v))
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1 / n, 0)
        nb = vb - rate * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        restart = ((v - new) * (new - w)).sum() > 0
        ahead = 0.0 if restart else (t - 1) / t2
        v, vb, w, b, t = new + ahead * (new - w), nb + ahead * (nb - b), new, nb, 1.0 if restart else t2
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE, most_features: int = 3000) -> Model:
    """The model of at most sample documents with a label: all if there are no more, else those of least hash.

    Of the features of several of them (and under half), those most_features take part whose frequency differs most surely
    between the classes: the size of the model, as that of a vocabulary; no row is left out for it. The driver gets these features, and of each document of the sample which it has. Rows whose label is null don't
    count; of repeated labels of an id the largest does.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("k"), "k").limit(sample)  # two numbers a row: the texts stay where they are
    texts = modest(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    taught = stored(texts.join(F.broadcast(some), F.col("id") == F.col("k")).select("k", "text", "y"))
    n, n1 = taught.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    n0 = n - n1

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in by_size(frames, "text", 2_000_000):
            seen: dict[str, list[int]] = {}
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                for f in features(text):
                    c = seen.setdefault(f, [0, 0])
                    c[0] += 1
                    c[1] += y
            yield pd.DataFrame([(f, *c) for f, c in seen.items()], columns=["f", "n", "n1"])

    least_docs = max(2, min(3 * n // 2000, 20))
    p = F.col("n") / n
    apart = F.abs(F.try_divide(F.col("n1"), F.lit(n1)) - F.try_divide(F.col("n") - F.col("n1"), F.lit(n0))) / F.sqrt(p * (1 - p))
    names = [
        r[0]
        for r in taught.mapInPandas(counted, "f string, n long, n1 long")
        .groupBy("f")
        .agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
        .where((F.col("n") >= least_docs) & (F.col("n") < 0.5 * n))
        .orderBy(apart.desc_nulls_last(), "f")
        .limit(most_features)
        .select("f")
        .collect()
    ]
    at = {f: i for i, f in enumerate(names)}

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, text, y in zip(pdf["k"], pdf["text"], pdf["y"], strict=True):
                out.append((k, "doc", y, sorted(at[f] for f in features(text) & at.keys()), []))
                for plus, minus in swaps(text, y, zlib.crc32(str(k).encode())):
                    signs = {at[f]: s for fs, s in ((plus, 1.0), (minus, -1.0)) for f in fs & at.keys()}
                    if signs:
                        out.append((k, "swap", y, list(signs), list(signs.values())))
            yield pd.DataFrame(out, columns=["k", "kind", "y", "places", "signs"])

    got = taught.mapInPandas(placed, "k long, kind string, y int, places array<int>, signs array<double>").toPandas()
    got["order"] = got["places"].map(lambda x: tuple(x))
    got = got.sort_values(["kind", "k", "order"])
    doc, swap = got[got["kind"] == "doc"], got[got["kind"] == "swap"]
    return fit(names, list(doc["places"]), doc["y"].to_numpy(), list(zip(swap["places"], swap["signs"], strict=True)))


def scored(docs: DataFrame, model: Model, text_col: str, score_col: str = "score") -> DataFrame:
    """docs with score_col double, from 0 to 1: how likely a text is toxic. Only the whole text counts; a null one is empty.

    Empty texts get the score of the bias; ties and repeated rows get equal scores; an empty table stays empty.
    Other columns are passed on, a column named score_col is replaced.
    """
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Model(weights.value, bias)
        for part in parts:
            yield part.map(held.score, na_action=None).astype(float)

    return modest(docs).withColumn(score_col, score(F.col(text_col)))
