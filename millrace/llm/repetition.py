"""Quality rule by repetition: maximal repeated word sequences found with suffix arrays.

The suffix array of a group of texts is built by prefix doubling that re-sorts only suffixes not yet told apart. The ranks of
every doubling give the longest common prefix of neighbours in the array, whose intervals are the maximal repeats; their
spans are united for the covered share of a text, and the longest is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

SYMBOLS = "#*$%&|<>"
#: Words of the texts whose suffix array is built at once; a longer text has its own.
GROUP = 40_000


def doubling(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... entries until all differ; equal rank, equal entries.

    The last ranks are the inverse of the suffix array.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    head = np.r_[True, ids[order[1:]] != ids[order[:-1]]]
    at = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = at
    levels = [rank]
    size = np.diff(np.r_[np.flatnonzero(head), n])
    active = order[np.repeat(size, size) > 1]
    h = 1
    while len(active):
        rank = levels[-1]
        mine, next_ = rank[active], rank[np.minimum(active + h, n)]
        order = np.lexsort((next_, mine))
        active, mine, next_ = active[order], mine[order], next_[order]
        old = np.r_[True, mine[1:] != mine[:-1]]
        new = old | np.r_[True, next_[1:] != next_[:-1]]
        k = np.arange(len(active))
        place = mine + np.maximum.accumulate(np.where(new, k, 0)) - np.maximum.accumulate(np.where(old, k, 0))
        rank = rank.copy()
        rank[active] = place
        levels.append(rank)
        size = np.diff(np.r_[np.flatnonzero(new), len(active)])
        active = active[np.repeat(size, size) > 1]
        h *= 2
    return levels


def longest_repeats(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, length) of the longest repeat that starts at each position, where it has `least` entries or more."""
    n = len(levels[0]) - 1
    suffixes = np.argsort(levels[-1][:n])
    a, b = suffixes[:-1], suffixes[1:]
    sure = min(least.bit_length() - 1, len(levels) - 1)  # 2 ** sure <= least
    if 2**sure <= least:
        same = levels[sure][a] == levels[sure][b]
        a, b = a[same], b[same]
    common = np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        common += np.where(levels[t][np.minimum(a + common, n)] == levels[t][np.minimum(b + common, n)], 1 << t, 0)
    long = common >= least
    at, length = np.r_[a[long], b[long]], np.r_[common[long], common[long]]
    best = np.zeros(n, np.int64)
    np.maximum.at(best, at, length)
    at = np.flatnonzero(best)
    return at, best[at]


def covered(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], least: int) -> list[tuple[int, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat) of each text."""
    ids: list[int] = []
    ends, rows = [], []
    for text in texts:
        known: dict[bytes, int] = {}
        words = text.encode().split()
        first = len(ids)
        ids += [known.setdefault(w, first + len(known)) for w in words]
        ends.append(len(ids))
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")] if "\n" in text else [""]
        blank = sum(text.count(c) for c in " \t\n\r\x0b\x0c")
        rows.append((len(words), len(text) - blank, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines))))
    n = len(ids)
    if not n:
        return [(*r, 0, 0, 0) for r in rows]
    ends_at = np.array(ends)
    text_of = np.searchsorted(ends_at, np.arange(n), side="right")
    levels = doubling(np.array(ids, np.int64))
    triples = np.zeros(n, bool)
    if len(levels) > 1:
        pair = levels[1]
        at = np.arange(n - 2) if n > 2 else np.empty(0, np.int64)
        at = at[at + 2 < ends_at[text_of[at]]]
        repeated = np.bincount(pair[:n], minlength=n)[pair[at]] > 1
        at = at[repeated]
        _, back, times = np.unique(pair[at] * (n + 1) + levels[0][at + 2], return_inverse=True, return_counts=True)
        at = at[times[back] > 1]
        triples = covered(n, at, np.full(len(at), 3))
    at, length = longest_repeats(levels, least)
    spans = covered(n, at, length)
    per = lambda mask: np.bincount(text_of, mask, len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text_of[at], length)
    return [(*r, *x) for r, x in zip(rows, zip(per(triples).tolist(), per(spans).tolist(), longest.tolist()))]


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]


def _measure(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, group, held = [], [], 0
            for text in batch.column("_text"):
                text = text.as_py() or ""
                group.append(text)
                held += len(text)
                if held > 6 * GROUP:
                    rows += measure(group, least)
                    group, held = [], 0
            rows += measure(group, least) if group else []
            cols = list(zip(*rows)) or [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(list(c), pa.int64()) for c in cols)], ["_id", *NAMES])

    return lean(run)


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 8, most_covered: float = 0.3, most_words: int = 60) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat, base_failed, kept).

    Words lie between ASCII white space. n_covered counts the words inside repeats of `least` words or more, longest_repeat
    the words of the longest one (0: none). base_failed: under 50 words, or over half of them in repeated three-word windows.
    kept: not base_failed, at most `most_covered` of the words covered and no repeat of over `most_words` words. A null or
    empty text has no words and fails; repeated rows are measured each; empty tables give none; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    out = rows.mapInArrow(_measure(least), f"_id {rows.schema['_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in NAMES))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    fine = (F.col("n_covered") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= most_words)
    return out.withColumn("kept", ~F.col("base_failed") & fine).withColumnRenamed("_id", id_col)


def op10_repetition(spark, sf_dir: str) -> DataFrame:
    return repetition(spark.read.parquet(f"{sf_dir}/documents.parquet"))
