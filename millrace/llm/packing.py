"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are dealt at random into groups of bounded size that are packed apart, so packing needs one pass and no global sort.
What a document holds beyond full sequences is an item; items go, longest first, into the first bin with room, which the
tree of largest remaining capacities finds in logarithmic time.
"""

from __future__ import annotations

import json
import math
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer(path: str | None):
    """text -> ids, as the tokenizers library gives them for this file without special tokens; kept for the worker's life.

    Where the file's merges are in the order of their ids, the same merges are run by tiktoken, which gives the same ids
    several times faster; texts that hold an added token's string, and other files, go to the library itself.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    cache = sys.modules.setdefault("_millrace_tokenizers", types.ModuleType("_millrace_tokenizers")).__dict__
    if path not in cache:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        slow = lambda text: whole.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        fast = _by_ranks(spec, added)
        cache[path] = slow if fast is None else lambda text: slow(text) if any(t in text for t in added) else fast(text)
    return cache[path]


def _by_ranks(spec: dict, added: list[str]):
    model, first = spec["model"], spec.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        return None
    import tiktoken
    from public_tokenizers import PATTERN

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others from 256 on
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ids = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merged != sorted(merged) or set(ids.values()) != set(range(len(ids))):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in ids.items()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Bins:
    """Remaining capacities under a tournament tree: the first bin with room for an item in O(log bins)."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def put(self, length: int) -> tuple[int, int]:
        """(bin, room that was left there)."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < length:
                k += 1
        room = tree[k]
        tree[k] = room - length
        bin_ = k - self.leaves
        while k > 1:
            k //= 2
            tree[k] = max(tree[2 * k], tree[2 * k + 1])
        return bin_, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item of at most `capacity`; ties keep their order."""
    bins = Bins(len(lengths), capacity)
    bin_, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        bin_[k], room = bins.put(n)
        offset[k] = capacity - room
    return bin_, offset


def _pieces(path: str | None, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            rows = []
            for i, group, text in zip(batch.column("_id").to_pylist(), batch.column("_group").to_pylist(), batch.column("_text")):
                text = text.as_py()
                ids = np.array([*(encode(text) if text else ()), end_id], "<u4")
                rows += [(i, at, len(cut := ids[at : at + size]), zlib.crc32(cut.tobytes()), len(ids), group) for at in range(0, len(ids), size)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_group"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [()] * 6)], names)

    return lean(run)


def _pack(size: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending"), ("ids_crc32", "ascending")])
        length = table["length"].to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        full = length == size
        sequence[full] = np.arange(full.sum())
        bin_, offset[~full] = first_fit_decreasing(length[~full], size)
        sequence[~full] = bin_ + full.sum()
        group = table["_group"][0].as_py()
        return table.drop_columns("_group").append_column("sequence_id", pa.array((group << 32) + sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, path: str | None = None, group_docs: int = 2048, seed: int = 5) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    A document is its text's ids, then end_id; null and empty texts are the end alone. Full pieces of `size` ids are
    sequences of their own; the rest of each document is packed whole, in groups of about group_docs documents (a hash of id
    and text deals them, and of rows without id their place in the table). sequence_id is the group, times 2**32, plus the sequence's place.
    crc32 is over the piece's ids as little-endian unsigned 32-bit numbers. Very long texts only make more full pieces,
    repeated rows are packed each, empty tables give none, and other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    groups = max(1, math.ceil(docs.count() / group_docs))
    nameless = F.when(F.col("_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "_id", "_text", nameless), F.lit(groups)))
    pieces = rows.mapInArrow(_pieces(path, size, end_id), f"{PIECE}, _group long")
    return pieces.groupBy("_group").applyInArrow(_pack(size), f"{PIECE}, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
