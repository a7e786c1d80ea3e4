"""Language identification in two levels: the family first, then one-versus-one linear SVMs inside it.

Features are hashed counts of the byte pairs and triples inside words, square-rooted and scaled to length one. A linear
support vector machine against the rest is trained for each family, and one for each pair of languages of a family.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, lean, small_batches

DIMS, SLAB = 4096, 1 << 20
LETTER = re.compile(r"[^\W\d_]")
# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "es fr it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi bn ur mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv mg",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Bytes that part words: all of ASCII but letters.
BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Counts by hashed pair or triple over the whole text; every slab of it, with the two bytes before."""
    raw = text.lower().encode().translate(BLANKS)
    out = np.zeros(DIMS, np.int64)
    for at in range(0, len(raw), SLAB):
        slab = np.frombuffer(b" " + raw[at : at + SLAB] + b" " if at == 0 else raw[at - 2 : at + SLAB], np.uint8).astype(np.uint32)
        pair = slab[:-1] * 257 + slab[1:]
        inner = (slab[:-1] != 32) & (slab[1:] != 32)
        triple = pair[:-1] * 263 + slab[2:]
        word = (slab[1:-1] != 32) & ((slab[:-2] != 32) | (slab[2:] != 32))
        for code in (pair[inner], triple[word] + np.uint32(1 << 26)):
            out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts.astype(np.float32))
    return root / max(float(np.sqrt((root * root).sum())), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear SVM (squared hinge) by accelerated gradient steps, classes weighted alike."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, rate = w.copy(), np.float32(1 / (4 + strength))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead)).astype(np.float32)
        step = ahead - rate * (strength * ahead - 2 * (x.T @ (weight * y * slack)))
        ahead = step + np.float32(k / (k + 3)) * (step - w)
        w = step
    return w[:-1], float(w[-1])


class Model:
    """families: the learned languages by family; tops: a family's SVM; pairs: an SVM for two languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(FAMILY_OF.get(lang.split("-")[0].lower(), lang), []).append(lang)
        lang_of = np.array(langs)
        family_of = np.array([next(f for f, x in self.families.items() if lang in x) for lang in langs]) if langs else np.array([])
        sign = lambda mask: np.where(mask, 1, -1).astype(np.float32)
        several = len(self.families) > 1
        self.tops = {f: svm(x, sign(family_of == f)) for f in self.families} if several else {}
        self.pairs = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                two = (lang_of == a) | (lang_of == b)
                self.pairs[a, b] = svm(x[two], sign(lang_of[two] == a))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not LETTER.search(text):
            return "und", 0.0
        x = scaled(features(text))
        if not x.any():  # letters, but no two bytes of a word together
            x = np.zeros(DIMS, np.float32)
        score = 1.0
        if self.tops:
            margins = sorted(((float(x @ w) + b, f) for f, (w, b) in self.tops.items()), reverse=True)
            family = margins[0][1]
            score = 1 / (1 + float(np.exp(-2 * (margins[0][0] - margins[1][0]))))
        else:
            family = next(iter(self.families))
        members = self.families[family]
        if len(members) == 1:
            return members[0], score
        votes = dict.fromkeys(members, 0)
        total = dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            w, offset = self.pairs[a, b]
            margin = float(x @ w) + offset
            votes[a if margin >= 0 else b] += 1
            total[a] += margin
            total[b] -= margin
        best = max(members, key=lambda m: (votes[m], total[m]))
        return best, score / (1 + float(np.exp(-4 * total[best] / (len(members) - 1))))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 400, most_languages: int = 200, seed: int = 17) -> Model:
    """A model from a sample of the labelled rows: about per_language texts of each of the most_languages commonest languages.

    Those bounds are the only thing that is sampled or left out: what is learned is a classifier of fixed size. Copies of a
    text count once, so that a language of few texts, each however often, is learned from all of them.
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("_text"), F.col(f"`{lang_col}`").cast("string").alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.approx_count_distinct(F.xxhash64("_text")).alias("n")).orderBy(F.desc("n"), "_lang").limit(most_languages).collect()}
    if not sizes:
        return Model(np.zeros((0, DIMS), np.float32), [])
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("_lang") == lang, F.lit(1.1 * per_language / n)).otherwise(share)
    place = F.pmod(F.xxhash64("_text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at, value = [], [], []
            for text, lang in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist()):
                if LETTER.search(text):
                    counts = features(text)
                    full = np.flatnonzero(counts)
                    langs.append(lang)
                    at.append(full.astype(np.uint16).tobytes())
                    value.append(counts[full].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["lang", "at", "value"])

    sample = rows.where(place < share).mapInArrow(lean(measured), "lang string, at binary, value binary").distinct().collect()
    sample.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["value"])))
    x = np.zeros((len(sample), DIMS), np.float32)
    for k, r in enumerate(sample):
        counts = np.zeros(DIMS, np.float32)
        counts[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.uint32)
        x[k] = scaled(counts)
    return Model(x, [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language of every whole text and a score from 0 to 1.

    Only the text is looked at. A null text or one without a letter is `und` with score 0, and so is every text if nothing
    was learned. Ties go to the language first in the alphabet; rows are taken one by one, so repeats agree and empty tables
    give none. Other columns are carried along; an old column of an output's name is replaced.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (lang_out, score_out)]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)], F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column("_text")]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names[:-1], "_lang", "_score"])

    schema = ", ".join([*(f"c{k} {rows.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(rest))), "_lang string, _score double"])
    out = rows.mapInArrow(lean(run), schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(rest)], F.col("_lang").alias(lang_out), F.col("_score").alias(score_out))


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", id_remainder(F.col("doc_id"), 3) == 1)
    model = fit(docs.where("NOT held_out AND lang IS NOT NULL"))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
