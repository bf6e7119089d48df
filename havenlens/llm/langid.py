"""Language identification in two steps: the family first, then linear support vector machines between its languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from havenlens.llm.common import slices, texts

UNKNOWN = "und"
#: Languages by family. One that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "baltic": ("lt", "lv"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

#: Trigram buckets, and the most labelled rows per language that a model is fitted on.
BUCKETS = 4096
SAMPLE_PER_LANGUAGE = 400

#: ASCII letters in lower case; bytes of longer characters as they are; all else a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(text: bytes) -> np.ndarray:
    """Square roots of hashed byte trigram counts of the whole text, at length one. All zero if there is no letter."""
    a = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    code = code[(a[1:-1] != 32)]
    counts = np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    length = np.sqrt(max(1, len(code)))
    return np.sqrt(counts, dtype=np.float32) / np.float32(length)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


@dataclass(frozen=True)
class Model:
    """Weights of one machine per family against the others, and of one per pair of languages in a family."""

    families: tuple[str, ...]
    languages: dict[str, tuple[str, ...]]
    family_weights: np.ndarray
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row of features, and how sure: the family's certainty times that within it."""
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = x @ self.family_weights.T
        best = margins.argmax(axis=1)
        top = _certainty(margins[np.arange(len(x)), best]) if len(self.families) > 1 else np.ones(len(x))
        found, score = np.empty(len(x), object), np.zeros(len(x))
        for place, family in enumerate(self.families):
            rows = np.flatnonzero(best == place)
            found[rows], score[rows] = self._within(family, x[rows])
        return found.tolist(), top * score

    def _within(self, family: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        langs = self.languages[family]
        if len(langs) == 1:
            return np.full(len(x), langs[0], object), np.ones(len(x))
        votes, sure = np.zeros((len(x), len(langs))), np.zeros((len(x), len(langs)))
        for i, j in combinations(range(len(langs)), 2):
            margin = x @ self.pair_weights[langs[i], langs[j]]
            votes[:, i] += margin >= 0
            votes[:, j] += margin < 0
            sure[:, i] += _certainty(margin)
            sure[:, j] += _certainty(-margin)
        sure /= len(langs) - 1
        best = (votes + sure / 2).argmax(axis=1)  # most duels won; ties to the larger margins
        return np.array(langs, object)[best], sure[np.arange(len(x)), best]


def _certainty(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))


def _svm(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent in a fixed order of rows."""
    y = np.where(positive, 1.0, -1.0)
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    share = cost * len(x) / (2 * np.where(positive, max(1, positive.sum()), max(1, (~positive).sum())))  # rare sides weigh more
    norm = np.einsum("ij,ij->i", x, x) + 1 / (2 * share)
    for turn in range(rounds):
        for i in np.random.default_rng(turn).permutation(len(x)):
            step = (y[i] * (x[i] @ weights) - 1 + alpha[i] / (2 * share[i])) / norm[i]
            new = max(0.0, alpha[i] - step)
            weights += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return weights.astype(np.float32)


def fit_rows(x: np.ndarray, langs: list[str]) -> Model:
    """A model from features and languages of labelled rows. No rows give a model that knows no language."""
    known = sorted(set(langs))
    by_family: dict[str, list[str]] = {}
    for lang in known:
        by_family.setdefault(_FAMILY_OF.get(lang.split("-")[0].lower(), f"own:{lang}"), []).append(lang)
    families = tuple(sorted(by_family))
    x, labels = np.hstack([x, np.ones((len(x), 1), np.float32)]), np.array(langs, object)
    member = {f: np.isin(labels, by_family[f]) for f in families}
    family_weights = np.stack([_svm(x, member[f]) for f in families]) if families else np.zeros((0, BUCKETS + 1))
    pairs = {}
    for langs_ in by_family.values():
        for a, b in combinations(langs_, 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            pairs[a, b] = _svm(x[rows], labels[rows] == a)
    return Model(families, {f: tuple(by_family[f]) for f in families}, family_weights, pairs)


def fit(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on at most `per_language` labelled rows of each language for which `may_learn` holds, chosen by a hash of the id.

    What comes to the driver is a fixed number of floats per chosen row, so it is bounded by languages × per_language.
    """
    def first(*by: str) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy("hash", "doc_id"))

    labelled = docs.where(may_learn & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("hash"))
    # the smallest hashes of each language: of each of 64 ranges first, so that no task gets what all tasks have left of it
    some = labelled.withColumn("range", F.shiftrightunsigned("hash", 58)).withColumn("nth", first("lang", "range"))
    some = some.where(F.col("nth") <= per_language).withColumn("nth", first("lang"))
    chosen = some.where(F.col("nth") <= per_language).select("doc_id").distinct()
    sample = (
        docs.where(may_learn & F.col(lang_col).isNotNull())
        .select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.lang", "row.text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(lang, features(t).tobytes()) for lang, t in zip(batch["lang"].to_pylist(), texts(batch["text"]))
                    if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "x"])

    rows = sorted((r.lang, bytes(r.x)) for r in sample.mapInArrow(vectors, "lang string, x binary").collect())
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), BUCKETS)
    return fit_rows(x, [r[0] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text, without a shuffle; other columns are never looked at.

    A text that is null or has no letter is `und` with score 0, as is every text under a model that knows no language.
    Rows with equal ids are told one by one; an empty table gives no rows.
    """
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        _predictor(model, ["doc_id"]), f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is given a language with at least that score.

    A text with a letter always gets a language that the model knows, also if it is written in another one, and a score
    above 0. So with the default only texts without a letter (UNKNOWN) go, or all if the model knows no language.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"))
    told = rows.mapInArrow(
        _predictor(model, ["row"], text_col), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")


def _predictor(model: Model, passed: list[str], inside: str | None = None):
    """Passes columns on with the language of the column text, or of the field `inside` of the column row."""
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "row" if inside else "text", 1 << 20):
            found, scores = [], []
            contents = texts(batch["row"].field(inside) if inside else batch["text"])
            for start in range(0, len(contents), 256):
                part = contents[start:start + 256]
                langs, score = model.predict(np.stack([features(t) for t in part]))
                worded = [has_letter(t) for t in part]
                found += [lang if w else UNKNOWN for lang, w in zip(langs, worded)]
                scores += [float(s) if w else 0.0 for s, w in zip(score, worded)]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in passed], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*passed, "lang_pred", "score"])

    return predict
