"""Language identification in two steps: the family, then the language among its relatives."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlog.llm.common import fresh, own_name

# Families of language codes. A code that isn't listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
}
UNDETERMINED = "und"
CELLS = 8192  # hashed letter trigrams
NO_LETTERS = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Frequencies of hashed byte trigrams of the lower-case words, square roots taken, at length 1."""
    raw = np.frombuffer(f" {NO_LETTERS.sub(' ', text.lower())} ".encode(), np.uint8).astype(np.uint32)
    cells = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    counts = np.sqrt(np.bincount(cells, minlength=CELLS)).astype(np.float32)
    return counts / max(float(np.sqrt(counts @ counts)), 1e-9)


class Rows:
    """Sparse rows side by side: ``cells`` and ``values`` of row i start at starts[i]. No row is empty."""

    def __init__(self, cells: list[np.ndarray], values: list[np.ndarray]):
        lengths = np.array([len(c) for c in cells])
        self.starts = np.cumsum(lengths) - lengths
        self.cells, self.values = np.concatenate(cells), np.concatenate(values)
        self.row = np.repeat(np.arange(len(cells), dtype=np.int32), lengths)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * w[self.cells], self.starts)

    def summed(self, weights: np.ndarray) -> np.ndarray:
        """The sum of all rows, each times its weight."""
        return np.bincount(self.cells, self.values * weights[self.row], CELLS).astype(np.float32)


def support_vectors(x: Rows, y: np.ndarray, rounds: int = 60, penalty: float = 1e-4) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, classes weighed alike, by accelerated descent."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    weight = np.where(y == 0, 0, share).astype(np.float32)  # rows of neither class take no part
    w = ahead = np.zeros(CELLS, np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * x.times(ahead)).astype(np.float32)
        step = ahead + 0.9 * (x.summed(weight * slack * y) - penalty * ahead)
        ahead = step + t / (t + 3) * (step - w)
        w = step
    return w


@dataclass
class Model:
    """``families``: name -> languages; weights of one machine per family and per pair of relatives."""

    families: dict[str, list[str]] = field(default_factory=dict)
    by_family: dict[str, np.ndarray] = field(default_factory=dict)
    by_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fitted(cls, x: Rows, langs: list[str]) -> Model:
        model = cls()
        for lang in sorted(set(langs)):
            model.families.setdefault(FAMILIES.get(lang, lang), []).append(lang)
        kin = np.array([FAMILIES.get(lang, lang) for lang in langs], object)
        own = np.array(langs, object)
        if len(model.families) > 1:
            for family in model.families:
                model.by_family[family] = support_vectors(x, np.where(kin == family, 1, -1).astype(np.float32))
        for members in model.families.values():
            for a, b in combinations(members, 2):
                side = np.where(own == a, 1, np.where(own == b, -1, 0)).astype(np.float32)
                model.by_pair[a, b] = support_vectors(x, side)
        return model

    def predict(self, text: str) -> tuple[str, float]:
        """The language and a score in 0..1: how clearly the family leads, times how clearly the language does."""
        if not self.families:
            return UNDETERMINED, 0.0
        x = trigrams(text)
        lead = math.inf
        family = next(iter(self.families))
        if self.by_family:
            margins = sorted(((float(x @ w), f) for f, w in self.by_family.items()), key=lambda m: (-m[0], m[1]))
            family, lead = margins[0][1], margins[0][0] - margins[1][0]
        members = self.families[family]
        won = dict.fromkeys(members, (0, 0.0))
        closest = dict.fromkeys(members, math.inf)
        for a, b in combinations(members, 2):
            margin = float(x @ self.by_pair[a, b])
            for lang, m in ((a, margin), (b, -margin)):
                won[lang] = won[lang][0] + (m > 0), won[lang][1] + m
                closest[lang] = min(closest[lang], m)
        best = max(members, key=lambda lang: won[lang])
        return best, _sure(lead) * _sure(closest[best])


def _sure(margin: float) -> float:
    return 1.0 if math.isinf(margin) else 1 / (1 + math.exp(-4 * max(-50.0, margin)))


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 500) -> Model:
    """A model from a sample of about ``rows_per_language`` rows of each language, chosen by a hash of the id.

    Rows count per language over the whole table; the sampled rows' trigram frequencies, not their texts, are brought
    to the driver: at most CELLS numbers a row. Rows without text, letters, language or id aren't used. An empty table
    gives a model that determines nothing.
    """
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & has_letters(F.col("text")))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, rows_per_language / n)])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / F.lit(float(1 << 53))

    @F.arrow_udf("cells array<int>, values array<float>")
    def features(texts: pa.Array) -> pa.Array:
        found = [trigrams(t.as_py()) for t in texts]
        cells = [np.flatnonzero(x).astype(np.int32) for x in found]
        values = [x[c] for x, c in zip(found, cells, strict=True)]
        columns = [pa.array(cells, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        return pa.StructArray.from_arrays(columns, ["cells", "values"])

    sample = rows.where(draw < share[F.col("lang")]).select("lang", draw.alias("draw"), features("text").alias("x"))
    got = sample.select("lang", "draw", "x.cells", "x.values").toArrow().sort_by([("lang", "ascending"), ("draw", "ascending")])
    if not len(got):
        return Model()
    x = Rows(*([v.values.to_numpy() for v in got[c]] for c in ("cells", "values")))
    return Model.fitted(x, got["lang"].to_pylist())


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with language and score of each whole text; no shuffle.

    NULL texts and texts without letters are ``und`` with score 0. Texts are read whole, however long: each is counted into
    CELLS numbers. A tie of families or of languages goes to the first by name. Existing columns named as the outputs
    are replaced.
    """
    # Plain dictionaries and arrays: unlike functions, broadcasts don't carry code to executors without the package.
    shared = docs.sparkSession.sparkContext.broadcast((model.families, model.by_family, model.by_pair))

    @F.arrow_udf("lang string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = Model(*shared.value)
        for texts in batches:
            found = [(UNDETERMINED, 0.0) if (s := t.as_py()) is None else fitted.predict(s) for t in texts]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.StructArray.from_arrays(columns, ["lang", "score"])

    # Texts without letters go as NULL. A filter on the result must not call the function once more, in workers of its own.
    judged = predicted.asNondeterministic()(F.when(has_letters(F.col(text)), F.col(text)))
    kept = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    both = fresh(docs, "_judged")
    return docs.withColumn(both, judged).select(*kept, F.col(both)["lang"].alias(lang), F.col(both)["score"].alias(score))


def with_known_language(docs: DataFrame, model: Model, text: str = "text", lang: str | None = None) -> DataFrame:
    """The documents that have a language; those that are undetermined go. Columns stay as they are, but where the column
    ``lang`` is given and NULL, it gets the predicted language."""
    found, score = fresh(docs, "_lang"), fresh(docs, "_score")
    known = predict(docs, model, text, found, score).where(F.col(found) != UNDETERMINED)
    if lang is not None:
        lang = own_name(docs, lang)
        known = known.withColumn(lang, F.coalesce(lang, found))
    return known.select(*docs.columns)
