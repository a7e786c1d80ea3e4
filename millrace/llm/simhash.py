"""SimHash near-duplicates found with pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to many reference fingerprints. By the triangle inequality two
fingerprints at most k bits apart differ by at most k in every coordinate of that table, so pairs with a larger difference
anywhere are discarded before the fingerprints themselves are compared. Which rows of the table meet is settled by agreement
on bits. For few differing bits that is without loss: k of them touch at most k blocks, so of k + 2 blocks some two agree.
For a similarity, whose bits are too many for that, fingerprints are longer and tables of sampled bits are as many as
bring every pair at that similarity together with a stated probability. What they link are candidates only: within each
component of candidates the whole shingle sets are compared, and only pairs that have the similarity are links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, discard, lean, pair_blocks, small_batches, stored

BITS = 64
GOLDEN, MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every run of `shingle` lower-case words joined by a space; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hash64 = xxhash.xxh64_intdigest
    return np.array([hash64(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def fingerprint(text: bytes, shingle: int, words: int = 1) -> bytes:
    """64 bits a word; a bit is set if it is set in over half of the hashes. No words: all zero.

    The first 64 bits are those of the hashes themselves, further ones those of the hashes mixed anew.
    """
    return folded(shingle_hashes(text, shingle), words)


def folded(hashes: np.ndarray, words: int) -> bytes:
    ones = np.zeros(BITS * words, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        wide = np.empty((len(part), words), "<u8")
        wide[:, 0] = part
        for w in range(1, words):
            x = part + GOLDEN * np.uint64(w)
            x = (x ^ (x >> np.uint64(30))) * MIX
            x = (x ^ (x >> np.uint64(27))) * SPREAD
            wide[:, w] = x ^ (x >> np.uint64(31))
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def references(count: int, words: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, (count, words), dtype=np.uint64)


def distances(fingerprints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The pivot table: a row of distances for each fingerprint, in a byte each (clipping brings none further apart)."""
    return np.stack([np.minimum(np.bitwise_count(fingerprints ^ r).sum(axis=1, dtype=np.int16), 255) for r in refs], axis=1).astype(np.uint8)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode(), shingle))


def set_key(hashes: np.ndarray, words: int) -> bytes:
    """The fingerprint of a shingle set and a 128-bit digest of it: sets of one fingerprint need not be equal."""
    return folded(hashes, words) + xxhash.xxh3_128_digest(hashes.tobytes())


def _fingerprints(shingle: int, words: int, sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sets:
                found = [set_key(shingle_set(x.as_py(), shingle), words) for x in batch.column("_text")]
            else:
                found = [fingerprint((x.as_py() or "").encode(), shingle, words) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.binary())], ["id", "fp"])

    return lean(run)


def linked(fps: np.ndarray, table: np.ndarray, chunk: np.ndarray, same: bool, most: int) -> Iterator[tuple[int, int]]:
    """Pairs at most `most` bits apart: by the table's coordinates first, then by the fingerprints."""
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.abs(table[i + 1 :] - table[i]).max(axis=1) <= most) + i + 1
        near = near[np.bitwise_count(fps[near] ^ fps[i]).sum(axis=1, dtype=np.int64) <= most]
        for j in near.tolist() if same else near[chunk[near] != chunk[i]].tolist():
            yield i, j


def spanning(fps: np.ndarray, table: np.ndarray, chunk: np.ndarray, same: bool, most: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links: members of one tree are not looked at one by one."""
    tree = np.arange(len(fps))
    for i in range(len(fps) - 1):
        other = np.flatnonzero(tree[i + 1 :] != tree[i]) + i + 1
        near = other[np.abs(table[other] - table[i]).max(axis=1, initial=0) <= most]
        near = near[np.bitwise_count(fps[near] ^ fps[i]).sum(axis=1, dtype=np.int64) <= most]
        near = near if same else near[chunk[near] != chunk[i]]
        while len(near):
            yield i, int(near[0])
            tree[tree == tree[near[0]]] = tree[i]
            near = near[tree[near] != tree[i]]


def _pairs(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within blocks that begin at `at`; blocks of one size at a time."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        begin = at[size == n][:, None]
        left.append((begin + i).ravel())
        right.append((begin + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _links(most: int, n_refs: int, words: int, small: int = 24):
    """Links of blocks, reduced to (node, smallest node of its tree) over all that a task finds.

    Tables that see the same group give the same rows, so a large group stays a star and not a forest for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            members = batch.column("members")
            at, flat = members.offsets.to_numpy().astype(np.int64), members.values
            node, chunk = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("node", "chunk"))
            fp = np.frombuffer(b"".join(flat.field("fp").to_pylist()), np.uint64).reshape(-1, words)
            table = np.frombuffer(b"".join(flat.field("pivots").to_pylist()), np.uint8).reshape(-1, n_refs).astype(np.int16)
            same = batch.column("lo").to_numpy() == batch.column("hi").to_numpy()
            size = np.diff(at)
            few = (size <= small) & same
            i, j = _pairs(at[:-1][few], size[few])
            near = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1, initial=0) <= most)
            i, j = i[near], j[near]
            near = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= most
            for x, y in zip(node[i[near]].tolist(), node[j[near]].tolist()):
                forest.join(x, y)
            for k in np.flatnonzero(~few).tolist():
                lo, hi = at[k], at[k + 1]
                mine = node[lo:hi].tolist()
                for x, y in spanning(fp[lo:hi], table[lo:hi], chunk[lo:hi], bool(same[k]), most):
                    forest.join(mine[x], mine[y])
        edges = [(x, top) for x in list(forest.up) if (top := forest.root(x)) != x]
        for k in range(0, len(edges), 50_000):
            part = edges[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.int64()), pa.array([e[1] for e in part], pa.int64())], ["a", "b"])

    return lean(run)


def _tabled(refs: np.ndarray, masks: np.ndarray | None, bits: np.ndarray | None):
    """Adds to rows (fp, node) the pivot table and the keys under which fingerprints meet: masked, or sampled bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x[: 8 * refs.shape[1]] for x in batch.column("fp").to_pylist()]
            raw = np.frombuffer(b"".join(own), np.uint8).reshape(batch.num_rows, 8 * refs.shape[1])
            fps = raw.view(np.uint64)
            if masks is not None:
                keys = (fps & masks[None, :]).view(np.int64)
            else:
                one = np.unpackbits(raw, axis=1, bitorder="little")
                keys = np.stack([one[:, b] @ (1 << np.arange(len(b), dtype=np.int64)) for b in bits], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column("node"), pa.array([x.tobytes() for x in distances(fps, refs)], pa.binary()), flat], ["fp", "node", "pivots", "keys"])

    return lean(run)


def _sets(shingle: int, words: int):
    """(component, node, set) of the candidates' texts; of rows that share an id only the one whose set is the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for component, node, key, text in zip(*(batch.column(c).to_pylist() for c in ("component", "node", "fp", "_text"))):
                hashes = shingle_set(text, shingle)
                if set_key(hashes, words) == key:
                    out.append((component, node, hashes.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["component", "node", "set"])

    return lean(run)


def similar(sets: list[np.ndarray], chunk: np.ndarray, same: bool, least: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is `least` or more."""
    size = np.array([len(x) for x in sets])
    at = np.cumsum(size) - size
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    tree, mine = np.arange(len(sets)), np.zeros(len(values), np.int32)
    for i in range(len(sets) - 1):
        other = np.flatnonzero((tree[i + 1 :] != tree[i]) & (size[i + 1 :] > 0)) + i + 1
        small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
        other = other[small >= least * large - 1e-9]
        other = other if same else other[chunk[other] != chunk[i]]
        if not len(other):
            continue
        mine[flat[at[i] : at[i] + size[i]]] = 1
        n = size[other]
        begin = np.cumsum(n) - n
        place = np.repeat(at[other] - begin, n) + np.arange(int(n.sum()))
        common = np.add.reduceat(mine[flat[place]], begin)
        mine[flat[at[i] : at[i] + size[i]]] = 0
        near = other[common >= least * (size[i] + n - common) - 1e-9]
        while len(near):
            yield i, int(near[0])
            tree[tree == tree[near[0]]] = tree[i]
            near = near[tree[near] != tree[i]]


def _similar(least: float):
    """Links of blocks of sets, as (node, smallest node of its tree) over all that a task finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for members, lo, hi in zip(batch.column("members"), batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
                node, chunk = (members.values.field(k).to_numpy(zero_copy_only=False) for k in ("node", "chunk"))
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.values.field("set")]
                for x, y in similar(sets, chunk, lo == hi, least):
                    forest.join(int(node[x]), int(node[y]))
        edges = [(x, top) for x in list(forest.up) if (top := forest.root(x)) != x]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return lean(run)


def _verified(rows: DataFrame, nodes: DataFrame, labels: DataFrame, shingle: int, words: int, least: float, cap: int) -> DataFrame:
    """Components of the links at `least` within the components of candidates; sets are made of the candidates' texts alone."""
    named = nodes.join(labels, "node").select("node", "fp", "component")
    texts = rows.join(named, rows._id == named.node).select("component", "node", "fp", "_text")
    sets = texts.mapInArrow(_sets(shingle, words), "component long, node long, set binary").dropDuplicates(["component", "node", "set"])
    sets = stored(sets, "simhash-sets")
    blocks = pair_blocks(sets, ["component"], ["node", "set"], "node", cap, apart=True)
    edges = blocks.select("members", "lo", "hi").mapInArrow(_similar(least), "a long, b long")
    verified = components(edges, "simhash-verified")
    discard(sets)
    return verified


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most_bits: int | None = None, least: float = 0.8, found: float = 0.99, words: int = 4, n_refs: int | None = None, cap: int = 2048, seed: int = 7) -> DataFrame:
    """(id, fp, component) of every row: near-duplicates are linked, transitively; component is the smallest id reachable.

    With most_bits, 64-bit fingerprints link at most so many bits apart, every pair of them. Else `least` is the Jaccard
    similarity that the shingle sets of linked rows have: fingerprints of the sets have 64 * words bits and are candidates up
    to the distance expected at that similarity plus four standard deviations, a pair at it meets with the probability
    `found`, and sets that candidates connect are compared whole.

    fp is the fingerprint, little-endian. A null or empty text has fingerprint 0 and is linked like any other; ties and
    repeated rows share a fingerprint and a component. A row without id keeps its fingerprint's component but cannot be its
    smallest id (null if no row there has an id). Empty tables give no rows; other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    words = words if most_bits is None else 1
    n_refs = n_refs or (8 if most_bits is None else 24)  # at the distances of a similarity, more discard no more
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    texts = rows
    rows = stored(rows.mapInArrow(_fingerprints(shingle, words, most_bits is None), "id long, fp binary"), "simhash-rows")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("node")), "simhash-fingerprints")
    masks = bits = None
    if most_bits is not None:
        n_blocks = most_bits + 2
        cuts = [round(BITS * k / n_blocks) for k in range(n_blocks + 1)]
        block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
        masks = np.array([x | y for x, y in combinations(block, 2)], np.uint64)
        most = most_bits
    else:
        apart = math.acos(2 * least / (1 + least)) / math.pi  # share of bits that differ at that similarity
        n_bits = BITS * words
        most = int(n_bits * apart + 4 * math.sqrt(n_bits * apart * (1 - apart)))
        sampled = min(30, max(8, math.ceil(math.log2(nodes.count() + 1)) - 1))
        tables = max(1, math.ceil(math.log(1 - found) / math.log(1 - (1 - apart) ** sampled)))
        draw = np.random.default_rng(seed)
        bits = np.stack([draw.choice(n_bits, sampled, replace=False) for _ in range(tables)])
    tabled = nodes.where("node IS NOT NULL").mapInArrow(_tabled(references(n_refs, words, seed), masks, bits), "fp binary, node long, pivots binary, keys array<long>")
    tabled = stored(tabled, "simhash-tables")
    members = tabled.select(F.posexplode("keys").alias("t", "key"), "node", "fp", "pivots")
    blocks = pair_blocks(members, ["t", "key"], ["node", "fp", "pivots"], "node", cap)
    edges = blocks.select("members", "lo", "hi").mapInArrow(_links(most, n_refs, words), "a long, b long")
    labels = components(edges, "simhash")
    discard(tabled)
    if most_bits is None:
        candidates, labels = labels, _verified(texts, nodes, labels, shingle, words, least, cap // 4)
        discard(candidates)
    top = nodes.join(labels, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component"))
    top = stored(top, "simhash-top")
    discard(labels)
    discard(nodes)
    return rows.join(top, rows.fp == top._fp).select("id", F.substring("fp", 1, 8 * words).alias("fp"), "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that stay: of each group of near duplicates the one with the smallest id, and rows without id.

    Of rows that share the smallest id all stay: they are one document.
    """
    gone = simhash_components(docs, id_col, **how).where("id IS NOT NULL AND component <> id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, most_bits=4)
    big_endian = F.lower(F.concat(*[F.substring(F.hex("fp"), 15 - 2 * k, 2) for k in range(8)]))
    return found.select(F.col("id").alias("doc_id"), big_endian.alias("fingerprint"), F.col("component").alias("component_id"))
