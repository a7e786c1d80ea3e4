"""Embedding near-duplicates by a forest of random-projection trees with spill.

Every tree splits the vectors by random projections, again and again; a vector close to a split goes both ways. Vectors that
share a leaf of any tree, and a label, are compared exactly. The trees are fitted on a bounded sample and are small,
however many vectors there are; every vector is sent down every tree. A pair that meets in several leaves is counted in the first of them only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, lean, pair_blocks, small_batches, stored


class Tree:
    """One random direction for each level. The upper levels, where the sample has enough in a node, have a threshold and a
    margin for each node; all nodes of a lower level share the split of the whole sample, so a tree's size is bounded by the
    sample's, however deep it is."""

    def __init__(self, sample: np.ndarray, levels: int, spill: float, seed: int, least: int = 16) -> None:
        draw = np.random.default_rng(seed)
        self.directions = draw.standard_normal((levels, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=1, keepdims=True)
        self.cuts: list[np.ndarray] = []
        self.margins: list[np.ndarray] = []
        node = np.zeros(len(sample), np.int64)
        for level, direction in enumerate(self.directions):
            p = sample @ direction
            mean, width = (p.mean(), p.std()) if len(p) else (0.0, 1.0)
            own = 1 << level if (least << level) <= len(sample) else 1
            cut, margin = np.full(own, mean), np.full(own, spill * width)
            if own > 1 or level == 0:
                order = np.argsort(node, kind="stable")
                at = np.searchsorted(node[order], np.arange(own + 1))
                for k in range(own):
                    mine = p[order[at[k] : at[k + 1]]]
                    if len(mine) >= least:  # else the split of all: the sample says nothing closer
                        cut[k], margin[k] = np.quantile(mine, draw.uniform(0.4, 0.6)), spill * mine.std()
                node = 2 * node + (p > cut[node])
            self.cuts.append(cut)
            self.margins.append(margin)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every row, once for each leaf that it reaches."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for direction, cuts, margins in zip(self.directions, self.cuts, self.margins):
            place = node if len(cuts) > 1 else np.zeros(len(node), np.int64)
            off = (x @ direction)[row] - cuts[place]
            right = off > 0
            both = np.abs(off) <= margins[place]
            row, node = np.r_[row, row[both]], np.r_[2 * node + right, 2 * node[both] + ~right[both]]
        return row, node


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what links with nothing."""
    out: list[np.ndarray | None] = []
    for x in column.to_pylist():
        v = np.array(x, np.float64) if x and None not in x else None
        norm = float(np.sqrt(v @ v)) if v is not None and np.isfinite(v).all() else 0.0
        if not np.isfinite(norm) and v is not None:  # too large to square
            v = v / np.abs(v).max()
            norm = float(np.sqrt(v @ v))
        elif 0 < norm < 1e-150 or norm == 0 and v is not None and np.isfinite(v).all() and v.any():
            v = v / np.abs(v).max()
            norm = float(np.sqrt(v @ v))
        out.append(v / norm if norm > 0 else None)
    return out


def _route(trees: list[Tree], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = vectors(batch.column("vector"))
            ok = [k for k, v in enumerate(units) if v is not None]
            codes: list[list[int]] = [[] for _ in ok]
            fit = [k for k, v in enumerate(ok) if len(units[v]) == dims]
            if fit:
                x = np.array([units[ok[k]] for k in fit])
                for t, tree in enumerate(trees):
                    for r, leaf in zip(*(a.tolist() for a in tree.leaves(x))):
                        codes[fit[r]].append((t << 40) | leaf)
            part = batch.take(pa.array(ok, pa.int64()))
            packed = [units[k].tobytes() for k in ok]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("label"), part.column("copies"), pa.array(packed, pa.binary()), pa.array([sorted(c) or [-1] for c in codes], pa.list_(pa.int64()))], ["node", "label", "copies", "unit", "codes"])

    return run


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric adjacency matrix."""
    left, edges = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            near = np.flatnonzero(linked[i] & left)
            left[near] = False
            edges += [(i, j) for j in near.tolist()]
            queue += near.tolist()
    return edges


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = [], [], []
            for code, lo, hi, members in zip(batch.column("code").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), batch.column("members")):
                members = members.values
                node, copies, chunk = (members.field(k).to_numpy(zero_copy_only=False) for k in ("node", "copies", "chunk"))
                units = np.frombuffer(b"".join(members.field("unit").to_pylist())).reshape(len(node), -1)
                linked = units @ units.T >= least
                np.fill_diagonal(linked, False)
                if lo != hi:
                    linked &= chunk[:, None] != chunk[None, :]
                if not linked.any():
                    continue
                some = np.flatnonzero(linked.any(axis=1))
                linked, node, copies = linked[np.ix_(some, some)], node[some], copies[some]
                codes = members.field("codes")
                earlier = [[c for c in codes[k].as_py() if c < code] for k in some.tolist()]
                place: dict[int, int] = {}
                at = [(k, place.setdefault(c, len(place))) for k, cs in enumerate(earlier) for c in cs]
                if at:
                    met = np.zeros((len(some), len(place)), np.float32)
                    met[tuple(np.array(at).T)] = 1
                    linked &= met @ met.T == 0
                links = linked @ copies
                for k in np.flatnonzero(links).tolist():
                    a.append(int(node[k]))
                    b.append(None)
                    n.append(int(links[k]))
                for i, j in spanning(linked):
                    a.append(int(node[i]))
                    b.append(int(node[j]))
                    n.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return run


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, n_trees: int = 8, spill: float = 0.15, leaf_rows: int = 160, sample_rows: int = 8192, cap: int = 256, seed: int = 23
) -> DataFrame:
    """(id, n_links, component) of every row: vectors of one label at a cosine of `least` or more are linked.

    The forest is fitted on about sample_rows distinct vectors (a bound on its memory, whatever the input) and every vector is
    routed; a leaf of any size is compared completely, in blocks. n_links counts the other rows linked directly, equal vectors
    included. Vectors that are null, empty, zero or hold null or non-finite components, null labels and null ids link with
    nothing: n_links 0, component the row's own id. Equal vectors of a label are one class and stay linked; rows that share
    an id count each. Only vectors of equal length are compared. Empty tables give none; other columns are not read.
    """
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.col(f"`{label_col}`").cast("string").alias("label"))
    usable = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    classes = stored(usable.groupBy("label", "vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "forest-classes")
    total = classes.count()
    share = min(1.0, sample_rows / max(total, 1))
    place = F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    picked = [v for v in vectors(pa.array([r["vector"] for r in classes.where(place).select("vector").limit(2 * sample_rows).collect()])) if v is not None] if total else []
    lengths = [len(v) for v in picked]
    dims = max(sorted(set(lengths)), key=lengths.count, default=1)
    sample = np.array([v for v in picked if len(v) == dims]).reshape(-1, dims)
    sample = sample[np.lexsort(sample.T)] if len(sample) else sample
    levels = max(0, math.ceil(math.log2(max(total, 1) / leaf_rows)))
    trees = [Tree(sample, levels, spill, seed + t) for t in range(n_trees)]
    # An equal vector may have several ids of copies: the smallest names its class; two classes never share one with unique ids.
    vector_type = classes.schema["vector"].dataType.simpleString()
    routed = classes.mapInArrow(lean(_route(trees, dims)), "node long, label string, copies long, unit binary, codes array<long>")
    routed = stored(routed, "forest-routed")
    members = routed.withColumn("code", F.explode("codes")).withColumn("width", F.length("unit"))
    blocks = pair_blocks(members, ["label", "width", "code"], ["node", "copies", "unit", "codes"], "node", cap)
    found = stored(blocks.select("code", "lo", "hi", "members").mapInArrow(lean(_compare(least)), "a long, b long, n long"), "forest-links")
    labels = components(found.where("b IS NOT NULL").select("a", "b"), "forest")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    valid = routed.select("node", "label").withColumn("valid", F.lit(True))
    by_class = classes.join(valid, ["node", "label"], "left").join(links, "node", "left").join(labels, "node", "left")
    n_links = F.when(F.col("valid"), F.coalesce("n", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    by_class = by_class.select(F.col("label").alias("_label"), F.col("vector").cast(vector_type).alias("_vector"), n_links.alias("n_links"), F.when(F.col("valid"), F.coalesce("component", "node")).alias("component"))
    by_class = stored(by_class, "forest-by-class")
    for x in (classes, routed, found, labels):
        discard(x)
    out = rows.join(by_class, (rows.label == by_class._label) & (rows.vector == by_class._vector) & rows.id.isNotNull(), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def op8_forest(spark, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
