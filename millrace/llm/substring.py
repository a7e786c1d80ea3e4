"""Substring de-duplication against a log-structured index of window fingerprints.

A window is `WINDOW` consecutive words. Its fingerprint has two parts: the smallest hash of the `GRAM`-word runs inside it
(equal windows choose the same one, and neighbouring windows mostly share it, so it is stored once for several windows) and
a 64-bit check value of all its words. The index keeps sorted, immutable runs of the fingerprints seen so far and where each
was seen first, cut into ranges of the hash. A batch's fingerprints are sorted into the same ranges and merge-joined with
the runs range by range; what is new becomes another run, and runs are compacted into one when there are too many. Hits are
verified: the words of a repeated span are compared, by a 128-bit digest, with those of the span it repeats. Should they ever
differ, all is done again with other hashes, so that the result is that of the word sequences themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import count as counted

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, lean, small_batches, stored

WINDOW, GRAM = 20, 6
#: Windows that a map task holds at a time, and bytes of stored input to a hash range.
HELD, RANGE_BYTES = 1 << 18, 2 << 20
#: Words to a piece of a span that is verified, cut at multiples of it in the earlier text.
PIECE = 256
MIX, STEP, SPREAD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
#: Kinds of rows that meet in a range: fingerprints of the batch, spans already known to repeat, fingerprints of a run.
NEW, SPAN, RUN = 0, 1, 2
#: A document is its id and 32 bits of a hash of its text: rows that share an id and not the text are told apart (should that
#: hash not do it, spans of one would be cut from the other and not hold there, and a further try has another hash).
UNIT = {"doc": np.int64, "copy": np.int32, "start": np.int32, "count": np.int32, "anchor": np.uint64, "check": np.uint64}
REPEAT = {"doc": np.int64, "copy": np.int32, "start": np.int32, "count": np.int32, "old_doc": np.int64, "old_copy": np.int32, "old_start": np.int32}
COLUMNS = list(dict.fromkeys([*UNIT, *REPEAT]))
ROW = "kind int, range int, " + ", ".join(f"{c} binary" for c in COLUMNS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * SPREAD
    return x ^ (x >> np.uint64(31))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of every k consecutive entries, built from halves."""
    if k == 1:
        return h
    half = k // 2
    front, back = _rolled(h, half), _rolled(h, k - half)
    step = np.uint64(pow(int(STEP), k - half, 1 << 64))
    return front[: len(h) - k + 1] * step + back[half:]


def fingerprints(words: list[bytes], seed: int = 0, check_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, check) of every window; empty where there are fewer than WINDOW words."""
    if len(words) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    hash64 = xxhash.xxh64_intdigest
    h = np.array([hash64(w, seed) for w in words], np.uint64)
    grams = _mixed(_rolled(h, GRAM))
    anchor = _mixed(np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).min(axis=1))  # else ranges of small hashes fill
    return anchor, _mixed(_rolled(h, WINDOW)) & np.uint64((1 << 64) - (1 << (64 - check_bits)))


class Windows:
    """Windows in the order in which they were seen: of the runs first, then by document and start."""

    def __init__(self, doc: np.ndarray, copy: np.ndarray, start: np.ndarray, anchor: np.ndarray, check: np.ndarray) -> None:
        self.doc, self.copy, self.start, self.anchor, self.check = doc, copy, start, anchor, check

    @staticmethod
    def of_units(doc, copy, start, count, anchor, check, old) -> tuple[Windows, np.ndarray]:
        order = np.lexsort((start, copy, doc, ~old))
        begin = (np.cumsum(count, dtype=np.int64) - count)[order]
        count = count[order].astype(np.int64)
        spread = lambda x: np.repeat(x[order], count)
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return Windows(spread(doc), spread(copy), (spread(start) + within).astype(np.int32), spread(anchor), check[np.repeat(begin, count) + within]), spread(old)

    def heads(self) -> np.ndarray:
        """The place of the first window with the same fingerprint, for each."""
        order = np.argsort(self.check, kind="stable")
        check, anchor = self.check[order], self.anchor[order]
        if ((check[1:] == check[:-1]) & (anchor[1:] != anchor[:-1])).any():
            order = np.lexsort((self.check, self.anchor))
            check, anchor = self.check[order], self.anchor[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (check[1:] != check[:-1])
        head = np.empty(len(order), np.int64)
        head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        return head

    def later(self, head: np.ndarray) -> np.ndarray:
        return (self.doc != self.doc[head]) | (self.copy != self.copy[head]) | (self.start != self.start[head])

    def repeats(self, gone: np.ndarray, head: np.ndarray) -> list[np.ndarray]:
        """Runs of windows of one document that repeat a run of another, as the columns of REPEAT."""
        at, old = np.flatnonzero(gone), head[gone]
        doc, copy, start = self.doc[at], self.copy[at], self.start[at]
        old_doc, old_copy, old_start = self.doc[old], self.copy[old], self.start[old]
        new = np.ones(len(at), bool)
        step = lambda x, by: x[1:] != x[:-1] + by
        new[1:] = step(doc, 0) | step(copy, 0) | step(start, 1) | step(old_doc, 0) | step(old_copy, 0) | step(old_start, 1)
        cut = np.flatnonzero(new)
        return [doc[cut], copy[cut], start[cut], np.diff(np.r_[cut, len(at)]).astype(np.int32), old_doc[cut], old_copy[cut], old_start[cut]]

    def units(self, which: np.ndarray, ranges: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Columns of UNIT, sorted by range and anchor, and the range of each: neighbouring windows of one anchor are a unit."""
        at = np.flatnonzero(which)
        doc, copy, start, anchor, check, ranges = self.doc[at], self.copy[at], self.start[at], self.anchor[at], self.check[at], ranges[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] != start[:-1] + 1) | (ranges[1:] != ranges[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.r_[begin, len(at)])
        order = np.lexsort((anchor[begin], ranges[begin]))
        begin, count = begin[order], count[order]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return [doc[begin], copy[begin], start[begin], count.astype(np.int32), anchor[begin], check[np.repeat(begin, count) + within]], ranges[begin]


def _row(kind: int, range_: int, **columns: np.ndarray) -> tuple:
    return (kind, range_, *(columns[c].tobytes() if c in columns else b"" for c in COLUMNS))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * len(COLUMNS)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["kind", "range", *COLUMNS])


def _ranges(windows: Windows, bits: int, hot: np.ndarray) -> np.ndarray:
    """The range of every window: by its anchor, or, at an anchor known to be frequent, by its check."""
    key = np.where(np.isin(windows.anchor, hot), _mixed(windows.check), windows.anchor) if len(hot) else windows.anchor
    return (key >> np.uint64(64 - bits)).astype(np.int32)


def _map(bits: int, seed: int, check_bits: int, hot: np.ndarray):
    """Fingerprints of a task's documents, a row for each range; of a window that repeats here only the first is sent on."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: x[:2])
        length = np.array([len(x[2]) for x in held])
        start = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        doc, copy = (np.repeat(np.array([x[k] for x in held], kind), length) for k, kind in ((0, np.int64), (1, np.int32)))
        windows = Windows(doc, copy, start.astype(np.int32), *(np.concatenate([x[k] for x in held]) for k in (2, 3)))
        head = windows.heads()
        rows, later = [], windows.later(head)
        if later.any():
            rows.append(_row(SPAN, held[0][0] % (1 << bits), **dict(zip(REPEAT, windows.repeats(later, head)))))
        units, ranges = windows.units(head == np.arange(len(head)), _ranges(windows, bits, hot))
        cut = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
        at = np.r_[0, np.cumsum(units[3])]
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(ranges)]):
            columns = [*(x[lo:hi] for x in units[:5]), units[5][at[lo] : at[hi]]]
            rows.append(_row(NEW, int(ranges[lo]), **dict(zip(UNIT, columns))))
            if len(rows) == 64:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i, copy, text in zip(batch.column("_id").to_pylist(), batch.column("_copy").to_pylist(), batch.column("_text")):
                found = fingerprints((text.as_py() or "").encode().split(), seed, check_bits)
                if len(found[0]):
                    held.append((i, copy, *found))
                    n += len(found[0])
                if n >= HELD:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return lean(run)


def _columns(table: pa.Table, kind: int, types: dict[str, type]) -> list[np.ndarray]:
    part = table.filter(pa.compute.equal(table["kind"], kind))
    return [np.frombuffer(b"".join(part[c].to_pylist()), t) for c, t in types.items()]


def _merge(keep: bool):
    """Merge-join of a range: the batch's fingerprints with the runs', both sorted. Rows out: repeated spans, a new run."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        at = table["range"][0].as_py()
        new, run_ = _columns(table, NEW, UNIT), _columns(table, RUN, UNIT)
        old = np.r_[np.ones(len(run_[0]), bool), np.zeros(len(new[0]), bool)]
        windows, old = Windows.of_units(*(np.concatenate(x) for x in zip(run_, new)), old)
        head = windows.heads()
        gone = windows.later(head) & ~old
        spans = [np.concatenate(x) for x in zip(windows.repeats(gone, head), _columns(table, SPAN, REPEAT))]
        rows = [_row(SPAN, at, **dict(zip(REPEAT, spans)))] if len(spans[0]) else []
        first = (head == np.arange(len(head))) & ~old
        if keep and first.any():
            rows.append(_row(RUN, at, **dict(zip(UNIT, windows.units(first, np.zeros(len(head), np.int32))[0]))))
        give_back()
        return pa.Table.from_batches([_batch(rows)] if rows else [], schema=_batch([_row(0, 0)]).schema)

    return run


def _compacted(table: pa.Table) -> pa.Table:
    """One run of several: no fingerprint is in two of them."""
    import pyarrow.compute  # noqa: F401

    units = _columns(table, RUN, UNIT)
    order = np.argsort(units[4], kind="stable")
    begin, count = (np.cumsum(units[3], dtype=np.int64) - units[3])[order], units[3][order].astype(np.int64)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    columns = [*(x[order] for x in units[:5]), units[5][np.repeat(begin, count) + within]]
    return pa.Table.from_batches([_batch([_row(RUN, table["range"][0].as_py(), **dict(zip(UNIT, columns)))])])


def hot_anchors(docs: DataFrame, seed: int = 0, sample_docs: int = 20_000, least: int = 8, most: int = 4096) -> np.ndarray:
    """Anchors frequent in a sample of about sample_docs rows of (_id, _copy, _text): their windows are dealt by check.

    That settles only in which range windows meet, never which of them repeat.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64(F.lit(seed + 77), "_id", "_copy"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("_text"):
                anchor, check = fingerprints((text.as_py() or "").encode().split(), seed)
                new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else []
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), pa.array(check[new].view(np.int64))], ["anchor", "check"])

    # Windows that are equal are one wherever they stand: only different ones make an anchor's range large.
    seen = sample.mapInArrow(lean(run), "anchor long, check long").distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    found = seen.where(F.col("n") >= least).orderBy(F.desc("n"), "anchor").limit(most).collect()
    return np.array(sorted(r["anchor"] for r in found), np.int64).view(np.uint64)


class FingerprintIndex:
    """Sorted runs of what earlier batches held, in the shared folder; `fanout` runs at most before they are compacted.

    save() notes where the runs are and how they were made; open() goes on with them in another session.
    """

    def __init__(self, spark: SparkSession, bits: int, fanout: int = 3, seed: int = 0, check_bits: int = 64, hot: np.ndarray | None = None) -> None:
        self.spark, self.bits, self.fanout, self.seed, self.check_bits = spark, bits, fanout, seed, check_bits
        self.hot = np.empty(0, np.uint64) if hot is None else hot
        self.runs: list[DataFrame] = []
        self.compactions = 0

    def insert(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """batch: (_id, _copy, _text). Returns a stored table of the spans of windows that also start earlier, here or in an
        earlier batch, and where: the columns of REPEAT.

        keep=False leaves the batch out of the index, for a batch after which none follows.
        """
        rows = batch.mapInArrow(_map(self.bits, self.seed, self.check_bits, self.hot), ROW)
        for run in self.runs:
            rows = rows.union(run)
        met = stored(rows.groupBy("range").applyInArrow(_merge(keep), ROW), "run")
        spans = stored(span_rows(met), "spans")
        if keep:
            self.runs.append(self._run(met._stored_at))
            if len(self.runs) > self.fanout:
                self.compact()
        else:
            discard(met)
        return spans

    def _run(self, path: str) -> DataFrame:
        run = self.spark.read.schema(ROW).parquet(path).where(f"kind = {RUN}")
        run._stored_at = path
        return run

    def compact(self) -> None:
        rows = self.runs[0]
        for run in self.runs[1:]:
            rows = rows.union(run)
        whole = stored(rows.groupBy("range").applyInArrow(_compacted, ROW), "run")
        self.drop()
        self.runs = [whole]
        self.compactions += 1

    def drop(self) -> None:
        """Remove the runs' files."""
        for run in self.runs:
            discard(run)
        self.runs = []

    def save(self, path: str) -> None:
        note = [(self.bits, self.fanout, self.seed, self.check_bits, self.hot.view(np.int64).tolist(), [r._stored_at for r in self.runs])]
        self.spark.createDataFrame(note, "bits int, fanout int, seed int, check_bits int, hot array<long>, runs array<string>").write.mode("overwrite").parquet(path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> FingerprintIndex:
        note = spark.read.parquet(path).first()
        index = FingerprintIndex(spark, note["bits"], note["fanout"], note["seed"], note["check_bits"], np.array(note["hot"], np.int64).view(np.uint64))
        index.runs = [index._run(at) for at in note["runs"]]
        return index


def span_rows(met: DataFrame) -> DataFrame:
    """The spans in the merged ranges, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in REPEAT.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], list(REPEAT))

    return met.where(f"kind = {SPAN}").mapInArrow(run, ", ".join(f"{c} {'bigint' if t is np.int64 else 'int'}" for c, t in REPEAT.items()))


def whole_spans(spans: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A document's spans in order, those that go on from each other in both texts as one; ranges cut them up."""
    order = np.lexsort((spans["old_start"], spans["old_copy"], spans["old_doc"], spans["start"]))
    spans = {c: x[order] for c, x in spans.items()}
    start, count, old = spans["start"].astype(np.int64), spans["count"].astype(np.int64), spans["old_start"].astype(np.int64)
    new = np.ones(len(start), bool)
    goes_on = (start[1:] == start[:-1] + count[:-1]) & (old[1:] == old[:-1] + count[:-1])
    new[1:] = ~goes_on | (spans["old_doc"][1:] != spans["old_doc"][:-1]) | (spans["old_copy"][1:] != spans["old_copy"][:-1])
    cut = np.flatnonzero(new)
    return {"start": start[cut], "count": np.add.reduceat(count, cut) if len(cut) else count, "old_doc": spans["old_doc"][cut], "old_copy": spans["old_copy"][cut], "old_start": old[cut]}


def kept_words(words: list[bytes], starts: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The words that no window of these spans covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + WINDOW - 1, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def claims(words: list[bytes], spans: dict[str, np.ndarray]) -> list[dict]:
    """What must stand in the earlier texts: pieces of the spans, by place there and digest."""
    out = []
    for start, count, doc, copy, old in zip(*(spans[c].tolist() for c in ("start", "count", "old_doc", "old_copy", "old_start"))):
        end = old + count + WINDOW - 1
        at = old
        while at < end:
            to = min(end, (at // PIECE + 1) * PIECE)
            out.append({"doc": doc, "copy": copy, "start": at, "words": to - at, "digest": _digest(words[start + at - old : start + to - old])})
            at = to
    return out


CLAIMS = "array<struct<doc: bigint, copy: int, start: int, words: int, digest: binary>>"
CLAIM_TYPE = pa.list_(pa.struct([("doc", pa.int64()), ("copy", pa.int32()), ("start", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())]))


def _cut(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, out, claimed = [], [], [], []
            found = batch.column("_spans")
            at, flat = found.offsets.to_pylist(), found.values
            flat = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in list(REPEAT)[2:]}
            for k, text in enumerate(batch.column("_text")):
                text = text.as_py()
                words = (text or "").encode().split()
                kept, claim = words, []
                if at[k + 1] > at[k] and found[k].is_valid:
                    spans = whole_spans({c: x[at[k] : at[k + 1]] for c, x in flat.items()})
                    kept, claim = kept_words(words, spans["start"], spans["count"]), claims(words, spans)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                claimed.append(claim)
                if digest:
                    out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                else:
                    out.append(b" ".join(kept).decode() if claim else text)
            rest = [k for k in range(batch.num_columns) if batch.schema.names[k] not in ("_text", "_spans")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(claimed, CLAIM_TYPE)], [*(batch.schema.names[k] for k in rest), "_out", "_words", "_removed", "_claims"])

    return lean(run)


def _unmet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Claims that do not hold."""
    for batch in batches:
        wrong = []
        for text, claimed in zip(batch.column("_text"), batch.column("_claimed").to_pylist()):
            words = (text.as_py() or "").encode().split()
            wrong += [c["start"] for c in claimed if _digest(words[c["start"] : c["start"] + c["words"]]) != c["digest"]]
        yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.int32())], ["start"])


def _verified(known: DataFrame, cut: DataFrame) -> bool:
    """Whether the words of every removed span are those of the earlier text."""
    each = cut.select(F.explode("_claims").alias("c")).select("c.*").distinct()
    each = each.groupBy(F.col("doc").alias("_doc"), F.col("copy").alias("_of")).agg(F.collect_list(F.struct("start", "words", "digest")).alias("_claimed"))
    met = known.join(each, (known._id == each._doc) & (known._copy == each._of)).select("_text", "_claimed")
    return met.mapInArrow(lean(_unmet), "start int").count() == 0


def range_bits(docs: DataFrame, text_col: str) -> int:
    """Bits of the hash by which runs are cut, so that a range stays small whatever the input's size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # no estimate: a source of unknown size, or a join
        size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 1
    return max(6, min(30, math.ceil(math.log2(max(size, 1) / RANGE_BYTES))))


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts: tuple[float, ...] = (0.02, 0.04, 0.08, 0.16), fanout: int = 3, digest: bool = False, check_bits: int = 64
) -> DataFrame:
    """docs with every word removed that lies in a window which also starts earlier: at a smaller id, or before in its row.

    The batches are ranges of the id, cut at these quantiles and taken in order, each against the runs of those before; more
    than `fanout` runs are compacted. Columns: docs' own, with the text column replaced by the kept words joined by one space
    (a row that loses nothing keeps its text as it is), then _words and _removed. digest=True returns _out, the SHA-256 of
    the kept words joined by one space, in place of the text. check_bits narrows the check of a first try; after hits that
    did not hold, a further try has other hashes and all 64 bits.
    A null text has no words and stays null; texts of under 20 words have no window and stay. Rows that share id and text are
    one document twice: they are not earlier than each other. Rows that share an id but not the text are documents of their
    own, in the order of a hash of the text. Rows without id are neither cut nor looked at. Empty tables give none; other
    columns are carried along, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rest = [c for c in docs.columns if c != text_col]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)], F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text"))
    known = rows.where("_id IS NOT NULL").select("_id", "_text")
    at = sorted(set(known.approxQuantile("_id", list(cuts), 0.01))) if cuts else []
    bits = range_bits(docs, text_col)
    schema = ", ".join([*(f"c{k} {rows.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(rest))), f"_out string, _words long, _removed long, _claims {CLAIMS}"])
    for seed in counted():
        copy = (F.xxhash64(F.lit(seed), "_text") % F.lit(1 << 31)).cast("int")
        known, rows = known.withColumn("_copy", copy), rows.withColumn("_copy", copy)
        index = FingerprintIndex(spark, bits, fanout, seed, check_bits if seed == 0 else 64, hot_anchors(known, seed))
        found = []
        for k, (lo, hi) in enumerate(zip([None, *at], [*at, None])):
            part = known if lo is None else known.where(F.col("_id") > int(lo))
            part = part if hi is None else part.where(F.col("_id") <= int(hi))
            found.append(index.insert(part, keep=k < len(at)))
        index.drop()
        each = found[0]
        for more in found[1:]:
            each = each.union(more)
        spans = each.groupBy(F.col("doc").alias("_doc"), F.col("copy").alias("_of")).agg(F.collect_list(F.struct(*list(REPEAT)[2:])).alias("_spans"))
        joined = rows.join(spans, (rows._id == spans._doc) & (rows._copy == spans._of), "left").drop("_id", "_copy", "_doc", "_of")
        out = stored(joined.mapInArrow(_cut(digest), schema), "substring")
        for x in found:
            discard(x)
        if _verified(known, out):
            break
        discard(out)
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(rest)]
    if digest:
        return out.select(*back, "_out", "_words", "_removed")
    back.insert(docs.columns.index(text_col), F.col("_out").alias(text_col))
    return out.select(*back, "_words", "_removed")


def op5_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs, digest=True)
    return out.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_out").alias("kept_sha256"))
