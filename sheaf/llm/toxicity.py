"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from sys import intern

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.store import workspace, written
from sheaf.sources.tables import table

#: Labelled documents that the chain is fitted on at most: those of the smallest hashes of their ids.
SAMPLE = 8000
#: The model's size: words that a category's model sees at most; the documents that a word must be in, and the z-score it must have, to count.
WORDS, LEAST_DOCS, LEAST_Z = 256, 3, 2.5
FOLDS, PENALTY = 5, 1.0
LETTERS = re.compile(r"[^\W\d_]+")
STYLE = 5


def words_of(text: str) -> set[str]:
    """The distinct runs of letters, in lower case."""
    return set(LETTERS.findall(text.lower()))


def style(text: str, words: set[str]) -> list[float]:
    """Shape of a text: its length, and shares of symbols, capitals and digits, and the mean length of distinct words."""
    n = max(1, len(text))
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall(r"[A-Za-z]", text))
    blank, capital, digit = len(re.findall(r"\s", text)), len(re.findall(r"[A-Z]", text)), len(re.findall(r"\d", text))
    return [np.log1p(len(text)) / 10, (n - letters - blank - digit) / n, capital / n, digit / n, sum(map(len, words)) / max(1, len(words)) / 10]


@dataclass
class Link:
    """One category: its words, and weights for a constant, the style, the earlier probabilities and the words, in that order."""

    name: str
    words: tuple[str, ...]
    weights: np.ndarray
    threshold: float

    @cached_property
    def by_word(self) -> dict[str, float]:
        return dict(zip(self.words, self.weights[len(self.weights) - len(self.words) :].tolist(), strict=True))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights of a logistic model with an L2 penalty on all but the constant, by Newton's method."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], penalty)
    pull[0] = 1e-6
    for _ in range(25):
        p = chance(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def chance(score: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(score, -30, 30)))


def telling_words(
    sample: DataFrame, categories: list[str], folds: int = FOLDS, most: int = WORDS, least: int = LEAST_DOCS
) -> dict[tuple[str, int], tuple[str, ...]]:
    """By (category, fold left out): the words whose presence goes most with the label or against it, by the z-score of their log odds.

    Fold -1 leaves none out. ``sample`` has fold, words and a column of 0 or 1 for each category. Words are
    counted by an aggregation that combines in the map tasks; ``most`` words of each kind go to the driver.
    """
    keys = [(c, y, k) for c in categories for y in (0, 1) for k in range(folds)]
    count = lambda c, y, k: F.count_if((F.col(c) == y) & (F.col("fold") == k)).cast("double")
    seen = sample.select("fold", *categories, F.explode("words").alias("word")).groupBy("word").agg(
        *(count(*key).alias("_".join(map(str, ("n", categories.index(key[0]), *key[1:])))) for key in keys)
    )
    totals = dict(zip(keys, sample.agg(*(count(*key) for key in keys)).first(), strict=True))
    scores = []
    for c in categories:
        for held in range(-1, folds):
            others = [k for k in range(folds) if k != held]
            a = [sum((F.col(f"n_{categories.index(c)}_{y}_{k}") for k in others), F.lit(0.0)) for y in (0, 1)]
            n = [sum(totals[c, y, k] for k in others) for y in (0, 1)]
            half = [x + 0.5 for x in (a[1], n[0] - a[0], a[0], n[1] - a[1])]
            z = F.log(half[0] * half[1] / (half[2] * half[3])) / F.sqrt(sum((1 / x for x in half), F.lit(0.0)))
            scores.append(F.struct(F.lit(c).alias("category"), F.lit(held).alias("held"), F.when(a[0] + a[1] >= least, F.abs(z)).alias("z")))
    told = seen.select("word", F.explode(F.array(*scores)).alias("s")).select("word", "s.*").where(F.col("z") >= LEAST_Z)
    first = F.row_number().over(Window.partitionBy("category", "held").orderBy(F.col("z").desc(), "word"))
    out: dict[tuple[str, int], list[str]] = {(c, k): [] for c in categories for k in range(-1, folds)}
    for r in told.withColumn("n", first).where(F.col("n") <= most).orderBy("n").select("category", "held", "word").collect():
        out[r["category"], r["held"]].append(r["word"])
    return {k: tuple(v) for k, v in out.items()}


def matrix(sets: list[set[str]], styles: np.ndarray, words: tuple[str, ...], before: np.ndarray) -> np.ndarray:
    place = {w: i for i, w in enumerate(words)}
    out = np.zeros((len(sets), 1 + STYLE + before.shape[1] + len(words)))
    out[:, 0], first = 1.0, 1 + STYLE + before.shape[1]
    out[:, 1 : 1 + STYLE], out[:, 1 + STYLE : first] = styles, before
    for i, own in enumerate(sets):
        for w in own & place.keys():
            out[i, first + place[w]] = 1.0
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Between the two out-of-fold probabilities where the F1 of calling what lies above them is greatest."""
    order = np.argsort(-p, kind="stable")
    ranked, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(1.0, y.sum()))
    f1[:-1][ranked[:-1] == ranked[1:]] = -1
    at = int(np.argmax(f1))
    return float((ranked[at] + (ranked[at + 1] if at + 1 < len(p) else 0.0)) / 2)


def constant(name: str, earlier: int) -> Link:
    """A category without documents of either kind: no words and a threshold that nothing exceeds."""
    weights = np.zeros(1 + STYLE + earlier)
    weights[0] = -30.0
    return Link(name, (), weights, 1.0)


def fitted(
    sets: list[set[str]], styles: np.ndarray, fold: np.ndarray, labels: dict[str, np.ndarray], told: dict[tuple[str, int], tuple[str, ...]],
    folds: int = FOLDS
) -> list[Link]:
    """The chain over ``labels``, in their order. ``sets``: each document's words, of which only those in ``told`` count.

    A later model is trained on out-of-fold probabilities of the earlier ones, so it sees them as good as they
    will be on new documents. The words are those told within each fold's training part, too.
    """
    before, chain = np.zeros((len(sets), 0)), []
    for name, y in labels.items():
        y = y.astype(np.float64)
        if min(y.sum(), len(y) - y.sum()) < folds:
            chain.append(constant(name, before.shape[1]))
            before = np.column_stack([before, np.zeros(len(y))])
            continue
        held = np.zeros(len(y))
        for k in range(folds):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            w = logistic(matrix([sets[i] for i in train], styles[train], told[name, k], before[train]), y[train])
            held[test] = chance(matrix([sets[i] for i in test], styles[test], told[name, k], before[test]) @ w)
        words = told[name, -1]
        chain.append(Link(name, words, logistic(matrix(sets, styles, words, before), y), best_threshold(held, y)))
        before = np.column_stack([before, held])
    return chain


def probabilities(chain: list[Link], text: str) -> list[float]:
    """Each category's probability, down the chain."""
    words = words_of(text)
    base, out = [1.0, *style(text, words)], []
    for link in chain:
        first = len(base) + len(out)
        score = float(np.dot(link.weights[:first], base + out))
        if link.words:
            score += sum(link.by_word[w] for w in words & link.by_word.keys())
        out.append(float(chance(np.array(score))))
    return out


CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def trained(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> list[Link]:
    """A chain fitted on at most ``sample`` labelled documents, whole texts. The driver sees the telling words and the weights only.

    ``categories``: by name, SQL over ``labels`` that is 1 or 0. Labels with a null anywhere are left out; of an
    id labelled twice the greater values count, and of documents that share an id each one is used. Texts become
    their shape and distinct words where they are read; one task, of a size that ``sample`` bounds, fits the chain.
    """
    names, at = list(categories), workspace(docs.sparkSession, "toxicity")
    wanted = labels.select(F.col(id_col).alias("id"), *(F.expr(v).cast("int").alias(k) for k, v in categories.items())).dropna()
    wanted = wanted.groupBy("id").agg(*(F.max(k).alias(k) for k in names)).orderBy(F.xxhash64("id"), "id").limit(sample)
    wanted = wanted.withColumn("fold", F.pmod(F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")) - 1, F.lit(FOLDS)).cast("int"))  # ``sample`` rows at most
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.md5(text.cast("binary")).alias("mark")).join(F.broadcast(wanted), "id")
    kinds = {
        "id": pa.int64(), "mark": pa.string(), "fold": pa.int32(), "style": pa.list_(pa.float64()), "words": pa.list_(pa.string()),
        **dict.fromkeys(names, pa.int32())
    }

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, styles = [], []
            for i in range(len(batch)):
                text = batch.column(3)[i].as_py()
                words = words_of(text)
                own.append(sorted(words))
                styles.append(style(text, words))
            columns = [
                *(batch.column(k) for k in range(3)), pa.array(styles, kinds["style"]), pa.array(own, kinds["words"]),
                *(batch.column(4 + k) for k in range(len(names)))
            ]
            yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    plain = rows.select(F.col("id").cast("long").alias("id"), "mark", "fold", "text", *names)
    schema = ", ".join(["id long, mark string, fold int, style array<double>, words array<string>", *(f"`{n}` int" for n in names)])
    taken = written(plain.mapInArrow(read, schema).orderBy(F.xxhash64("id"), "id", "mark").limit(sample), f"{at}/sample")
    told = telling_words(taken, names)
    known = frozenset(intern(w) for own in told.values() for w in own)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            for i in range(len(batch)):
                row = [c[i].as_py() for c in batch.columns]
                found.append((*row[:4], {intern(w) for w in row[4] if w in known}, *row[5:]))
        found.sort(key=lambda r: r[:2])
        if found:
            given = {n: np.array([r[5 + k] for r in found], np.int64) for k, n in enumerate(names)}
            chain = fitted([r[4] for r in found], np.array([r[3] for r in found], np.float64), np.array([r[2] for r in found]), given, told)
            columns = [[k.name for k in chain], [list(k.words) for k in chain], [k.weights.tolist() for k in chain], [k.threshold for k in chain]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()), strict=True)],
                names=["name", "words", "weights", "threshold"]
            )

    made = taken.coalesce(1).mapInArrow(fit, "name string, words array<string>, weights array<double>, threshold double").collect()
    chain = {r["name"]: Link(r["name"], tuple(r["words"]), np.array(r["weights"]), r["threshold"]) for r in made}
    return [chain.get(n) or constant(n, k) for k, n in enumerate(names)]


def judged(docs: DataFrame, chain: list[Link], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, the probability of each category, and ``rejected``: whether the last category's exceeds its threshold.

    Row-local: a whole text is read once, null counts as empty, and repeated rows are judged alike.
    """
    names, limit = [k.name for k in chain], chain[-1].threshold
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [probabilities(own, batch.column(1)[i].as_py() or "") for i in range(len(batch))]
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array([f[-1] > limit for f in found], pa.bool_())], names=["id", *names, "rejected"]
            )

    schema = ", ".join(["id long", *(f"`{n}` double" for n in names), "rejected boolean"])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, schema)


def clean(docs: DataFrame, chain: list[Link], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    limit = chain[-1].threshold

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([probabilities(own, t or "")[-1] > limit for t in texts])

    return docs.where(~rejected(F.col(text_col)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities along the chain and the verdict."""
    docs = table(spark, sf_dir, "documents")
    chain = trained(docs, table(spark, sf_dir, "labels"))
    found = judged(docs, chain)
    return found.select(F.col("id").alias("doc_id"), F.round("low_quality", 6).alias("low_quality"), F.round("toxic", 6).alias("toxic"), "rejected")
