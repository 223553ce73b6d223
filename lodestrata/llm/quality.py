"""Quality classifier by co-training.

Two classifiers see a document from two sides: its text (shape of words, punctuation, repetition, common words and
hashed word endings), and its metadata (source, language, recorded length). Both start from the labelled documents.
In each round both score all unlabelled documents, and each one's surest labels teach the other. At the end each is calibrated on held-out labels (Platt scaling), and a logistic combination of the two calibrated log-odds
scores every document.

The labelled sample is bounded: at most `max_labelled` documents, the ones with the smallest hash of their id, whose
feature rows (0.6 kB each) come to the driver, and with them each view's surest rows of a round, `per_round` times as many. The
unlabelled documents are all scored in every round, and every document at the end.

A document is rejected when its probability of good quality is below the threshold, which is set on the held-out
labels so that at most `max_loss` of the good ones are lost. Documents with conflicting labels don't train. With no
labels of either class nothing is rejected (probability 0.5). Null texts, sources and languages are values of their
own; repeated rows get equal scores; an empty table gives an empty result. Other columns stay in `accepted`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.store import written

MAX_LABELLED = 10_000
ROUNDS = 4
#: Documents that a view teaches the other in a round, as a share of the labelled ones.
PER_ROUND = 0.02
#: Tasks whose surest rows meet in one.
GROUP_TASKS = 64
HASHED = 64
META = 64

#: Common words of four languages.
COMMON = frozenset("the of and to in a is that for it with as was on are be by this from at or an have not de la le les et des en un une du que qui est dans pour par sur au avec il el los las y del se por con para una su lo al der die und das den von zu mit ist im ein eine dem nicht auf für als es auch sich".split())

_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_PUNCT = re.compile(r"[^\w\s]")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")


def text_features(text: str | None) -> np.ndarray:
    """Features of the whole text, each in a small range."""
    out = np.zeros(20 + HASHED)
    text = text or ""
    tokens = text.split()
    if not tokens:
        out[0] = 1.0
        return out
    n, chars = len(tokens), len(text)
    words = _WORD.findall(text)
    m = max(1, len(words))
    lower = [w.lower() for w in words]
    symbols = len(_SYMBOL.findall(text))
    punct = len(_PUNCT.findall(text))
    lines = text.split("\n")
    count = Counter(lower)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    shape = (
        0.0,
        np.log1p(n) / 10,
        sum(map(len, words)) / m / 10,
        upper / m,
        sum(map(count.__getitem__, COMMON & count.keys())) / m,
        symbols / n,
        punct / n,
        text.count("!") / n,
        text.count("|") / n,
        len(_DIGIT.findall(text)) / chars,
        len(count) / m,
        count.most_common(1)[0][1] / m if count else 0.0,
        len(set(lines)) / len(lines),
        min(1.0, n / len(lines) / 100),
        text.count(".") / n,
        text.count(",") / n,
        sum(t[:1].isupper() for t in tokens) / n,
        len(words) / n,
        sum(len(w) > 15 for w in words) / m,
        sum(len(w) == 1 for w in words) / m,
    )
    out[: len(shape)] = np.minimum(shape, 5.0)
    for w, k in count.items():
        out[20 + zlib.crc32(w[-3:].encode("utf-8", "surrogatepass")) % HASHED] += k
    out[20:] = np.sqrt(out[20:] / m)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(META + 4)
    for kind, value in (("s", source), ("l", lang)):
        out[zlib.crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % META] = 1.0
    length = np.log1p(max(0.0, float(n_chars or 0))) / 10
    out[META:] = (n_chars is None, length, length * length, length**3)
    return out


class Logistic:
    """L2-regularised logistic regression by Newton steps."""

    def __init__(self, l2: float = 1.0):
        self.l2 = l2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], self.l2)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (p - y)) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -30, 30)


@dataclass
class Model:
    """The two views, their combination, and the threshold below which a document is rejected."""

    text: Logistic | None = None
    meta: Logistic | None = None
    both: Logistic | None = None
    calibrated: tuple[Logistic, Logistic] | None = None
    threshold: float = 0.0

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.both is None:
            return np.full(len(text), 0.5)
        views = np.c_[self.calibrated[0].margin(self.text.margin(text)[:, None]), self.calibrated[1].margin(self.meta.margin(meta)[:, None])]
        return 1 / (1 + np.exp(-self.both.margin(views)))


def split(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two views of feature rows: the first `width` features, and the rest."""
    x = np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1).astype(float)
    return x[:, :width], x[:, width:]


class Confident:
    """The rows that each view is surest of, for each label: at most `count` of a label, none below `sure`.

    Equal rows count once; ties go to the smaller row. It can be fed rows in any order and any number of parts.
    """

    def __init__(self, learned: list[Logistic], width: int, sure: float, counts: tuple[int, int], skip: list[set[bytes]]):
        self.learned, self.width, self.sure, self.counts, self.skip = learned, width, sure, counts, skip
        self.best: dict[tuple[int, int], dict[bytes, float]] = {(k, label): {} for k in (0, 1) for label in (0, 1)}

    def feed(self, rows: list[bytes]) -> Confident:
        rows = list(dict.fromkeys(rows))
        for k, view in enumerate(split(rows, self.width) if rows else ()):
            p = 1 / (1 + np.exp(-self.learned[k].margin(view)))
            for label, score in ((1, p), (0, 1 - p)):
                self.keep((k, label), {rows[i]: float(score[i]) for i in np.flatnonzero(score >= self.sure) if rows[i] not in self.skip[1 - k]})
        return self

    def keep(self, key: tuple[int, int], found: dict[bytes, float]) -> None:
        both = self.best[key] | found
        if len(both) > self.counts[key[1]]:
            both = dict(sorted(both.items(), key=lambda x: (-x[1], x[0]))[: self.counts[key[1]]])
        self.best[key] = both


def from_rows(pool: list[bytes]) -> Callable[[Confident], Confident]:
    """A proposer for a pool in memory."""
    return lambda asked: asked.feed(pool)


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, propose: Callable[[Confident], Confident], *, rounds: int = ROUNDS, per_round: float = PER_ROUND, sure: float = 0.98, max_loss: float = 0.01) -> Model:
    """Every fourth labelled row is held out for calibration; rows come in a fixed order.

    In each round `propose` lets both views score every unlabelled row; each view's surest rows, `per_round` times
    the labelled ones and shared by the classes as these are, then teach the other view. A row teaches a view once.
    """
    model = Model()
    held = np.arange(len(y)) % 4 == 3
    fit = ~held
    if len(set(y[fit].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        return model
    #: Pseudo-labels that each view has been given by the other.
    given: list[dict[bytes, float]] = [{}, {}]
    views, width = (text, meta), text.shape[1]

    def train(k: int) -> Logistic:
        rows = sorted(given[k])
        x = np.r_[views[k][fit], split(rows, width)[k]] if rows else views[k][fit]
        labels = np.r_[y[fit], [given[k][r] for r in rows]]
        return Logistic().fit(x, labels, np.r_[np.ones(fit.sum()), np.full(len(rows), 0.3)])

    base = y[fit].mean()
    n = per_round * fit.sum()
    counts = (max(1, int(n * (1 - base))), max(1, int(n * base)))
    for _ in range(rounds):
        asked = propose(Confident([train(0), train(1)], width, sure, counts, [set(g) for g in given]))
        for (k, label), rows in asked.best.items():
            for row in sorted(rows):
                given[1 - k].setdefault(row, float(label))
    model.text, model.meta = train(0), train(1)
    margins = [model.text.margin(text[held])[:, None], model.meta.margin(meta[held])[:, None]]
    model.calibrated = (Logistic(0.1).fit(margins[0], y[held]), Logistic(0.1).fit(margins[1], y[held]))
    model.both = Logistic(1.0).fit(np.c_[model.calibrated[0].margin(margins[0]), model.calibrated[1].margin(margins[1])], y[held])
    p = model.probability(text[held], meta[held])
    model.threshold = min(0.5, float(np.quantile(p[y[held] == 1], max_loss)) - 1e-9)
    return model


def feature_row(text: str | None, source: str | None, lang: str | None, n_chars: float | None) -> bytes:
    return np.r_[text_features(text), meta_features(source, lang, n_chars)].astype("<f4").tobytes()


def _rows_of(text: pa.Array, source: pa.Array, lang: pa.Array, n: pa.Array) -> list[bytes]:
    return [feature_row(t.as_py(), a, b, c) for t, a, b, c in zip(text, source.to_pylist(), lang.to_pylist(), n.to_pylist())]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_rows_of(*batch.columns[1:]), pa.binary())], names=["doc_id", "x"])


def _columns(docs: DataFrame, text_col: str, source_col: str, lang_col: str, length_col: str) -> list:
    return [F.col(text_col).cast("string"), F.col(source_col).cast("string"), F.col(lang_col).cast("string"), F.col(length_col).cast("double")]


def prepared(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars", label_col: str = "quality") -> DataFrame:
    """doc_id, x (features), y, labelled of every row of docs, written once: texts are read once, for fitting and scoring."""
    known = labels.where(f"{label_col} IS NOT NULL AND {id_col} IS NOT NULL").groupBy(F.col(id_col).cast("long").alias("of")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    known = written(known.select("of", F.when(F.col("low") == F.col("high"), F.col("low").cast("double")).alias("y")), "quality-labels")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(n) for c, n in zip(_columns(docs, text_col, source_col, lang_col, length_col), ("text", "source", "lang", "n"))))
    found = rows.mapInArrow(_features, "doc_id long, x binary")
    return written(found.join(known, found["doc_id"] == known["of"], "left").select("doc_id", "x", "y", F.col("of").isNotNull().alias("labelled")), "quality-features")


def _proposals(asked: Confident):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Confident(asked.learned, asked.width, asked.sure, asked.counts, asked.skip)
        for batch in batches:
            own.feed(batch.column(0).to_pylist())
        out = list({row for rows in own.best.values() for row in rows})
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["x"])

    return run


def from_table(pool: DataFrame) -> Callable[[Confident], Confident]:
    """A proposer for a table of rows x: each task keeps its surest rows, groups of tasks theirs, the driver those of all."""

    def propose(asked: Confident) -> Confident:
        found = pool.select("x").mapInArrow(_proposals(asked), "x binary")
        parts = len(pool.inputFiles()) // GROUP_TASKS
        while parts:
            found = found.repartition(parts).mapInArrow(_proposals(asked), "x binary")
            parts //= GROUP_TASKS
        return asked.feed(found.toArrow()["x"].to_pylist())

    return propose


def fit_prepared(table: DataFrame, *, max_labelled: int = MAX_LABELLED, **options) -> Model:
    """Learn from `max_labelled` labelled rows, chosen by hash of their ids, and all the unlabelled ones."""
    ids = table.where("y IS NOT NULL").select("doc_id", "y").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = written(ids, "quality-sample").select(F.col("doc_id").alias("of"))
    sample = table.join(F.broadcast(chosen), table["doc_id"] == chosen["of"]).groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).toArrow()
    if not sample.num_rows:
        return Model()
    # Equal rows are interchangeable, so sorting by the features makes the order, and the model, the same each time.
    pairs = sorted(zip(sample["x"].to_pylist(), sample["y"].to_pylist()))
    t, m = split([x for x, _ in pairs], 20 + HASHED)
    y = np.array([label for _, label in pairs])
    mixed = np.random.default_rng(5).permutation(len(y))
    return cotrain(t[mixed], m[mixed], y[mixed], from_table(table.where("NOT labelled")), **options)


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, **columns: str) -> Model:
    return fit_prepared(prepared(docs, labels, **columns), max_labelled=max_labelled, rounds=rounds)


def scores_prepared(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, probability of good quality, accepted of every row of a prepared table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = model.probability(*split(batch.column(1).to_pylist(), 20 + HASHED))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= model.threshold)], names=["doc_id", "probability", "accepted"])

    return table.select("doc_id", "x").mapInArrow(run, "doc_id long, probability double, accepted boolean")


def scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars") -> DataFrame:
    """doc_id, probability of good quality, accepted of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_columns(docs, text_col, source_col, lang_col, length_col))
    return scores_prepared(rows.mapInArrow(_features, "doc_id long, x binary"), model)


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars") -> DataFrame:
    """The rows of docs that the model accepts, all columns as they are; one pass, no shuffle."""
    names = docs.columns
    places = [names.index(c) for c in (text_col, source_col, lang_col, length_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = model.probability(*split(_rows_of(*(batch.column(i) for i in places)), 20 + HASHED))
            yield batch.filter(pa.array(p >= model.threshold))

    return docs.mapInArrow(run, docs.schema)
