"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors of one label are compared in tiles. Unit vectors are turned into the basis of
principal components, largest first. A cosine of t or more means a distance of at most
sqrt(2 - 2t), so only vectors whose leading coordinates differ by no more than that can
link: a grid of this width deals vectors to cells, and a cell meets itself and half of its
neighbours. The grid has two axes, or up to four where cells of fewer would fill many tiles.
Cells are split into tiles of bounded size, which spreads a label or a cell that holds a
third of all rows over as many tasks as it needs.

In a tile the products of the leading dimensions are summed first. The rest of a product
is at most the product of the two suffix norms (Cauchy and Schwarz), and a pair is given up
as soon as sum and bound together cannot reach the threshold. Those that remain are decided
by the cosine of the given components in double precision.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import connected_components, discard, materialize
from docstrata.llm.tiles import tile_result

TILE = 1024
SLACK = 1e-9  # of the bounds, for rounding in the turned basis
AXES = 4  # of the grid at most; a cell meets 3 ** axes others
CROWDED = 4  # tiles that a row's cell fills on average before the grid gets one more axis
MAX_BASES = 16  # dimensions that get a basis of their own
MAX_PCA = 1024  # dimensions up to which the basis is fitted; beyond it the given one is used


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows, each scaled so that its largest component is near 1."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    # By a power of two, which is exact, so that no square of a double overflows or vanishes.
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])


def principal_axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the orthogonal basis of the second moments of all its unit vectors.

    Partial sums are made where the rows are and added by a grouped sum; dim * (dim + 1) / 2
    numbers for each dimension come to the driver, whatever the number of vectors, for the
    MAX_BASES most frequent dimensions. Vectors of others are compared in the given basis.
    """
    often = reps.where(F.col("dim") <= MAX_PCA).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MAX_BASES)
    fit = [r["dim"] for r in often.collect()]

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                x = _matrix(batch.column("embedding").filter(pa.array(dims == dim)))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, m in sums.items():
            upper = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(upper[0]), dim, np.int32)), pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(m[upper])],
                names=["dim", "i", "v"],
            )

    fitted = reps.where(F.col("dim").isin(fit)).select("dim", "embedding").mapInArrow(moments, "dim int, i int, v double")
    found: dict[int, dict[int, float]] = {}
    for row in fitted.groupBy("dim", "i").agg(F.sum("v").alias("v")).toLocalIterator():
        found.setdefault(row["dim"], {})[row["i"]] = row["v"]
    axes = {}
    for dim, values in found.items():
        m = np.zeros((dim, dim))
        upper = np.triu_indices(dim)
        m[upper] = [values[i] for i in range(len(upper[0]))]
        m = m + m.T - np.diag(np.diag(m))
        axes[dim] = np.linalg.eigh(m)[1][:, ::-1]
    return axes


def pairs_within(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (unit vectors in the turned basis) with cosine >= threshold."""
    dim = a.shape[1]
    cuts = [c for c in (4, 8, 16, 32, 64, 128, 256, 512) if c < dim] + [dim]
    tail = lambda x: np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]))
    rest_a, rest_b = tail(a), tail(b)
    i = j = None
    done, total = 0, None
    for cut in cuts:
        if i is None:
            part = a[:, done:cut] @ b[:, done:cut].T
            total = part if total is None else total + part
            bound = total + np.multiply.outer(rest_a[:, cut], rest_b[:, cut]) if cut < dim else total
            alive = bound >= threshold - SLACK
            if alive.mean() < 0.1 or cut == dim:
                i, j = np.nonzero(alive)
                total = total[i, j]
        elif len(i):
            total = total + np.einsum("ij,ij->i", a[i, done:cut], b[j, done:cut])
            bound = total + rest_a[i, cut] * rest_b[j, cut] if cut < dim else total
            alive = bound >= threshold - SLACK
            i, j, total = i[alive], j[alive], total[alive]
        done = cut
    exact = np.empty(len(i))
    for lo in range(0, len(i), 100_000):
        x, y = raw_a[i[lo : lo + 100_000]], raw_b[j[lo : lo + 100_000]]
        exact[lo : lo + 100_000] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    hit = exact >= threshold
    return i[hit], j[hit]


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null, their embeddings have one length and
    cosine >= threshold in double precision. A vector that is null, empty or zero, or holds
    a null or non-finite component, and a row without vec_id link with nothing: n_links 0,
    component_id its own vec_id, kept true. Equal vectors are one class, compared once; each
    row of a class links with all others of it. Repeated rows count as further vectors.
    component_id is the smallest vec_id that links lead to; kept says it is the row's own.
    Labels may have any type that can be compared, components any finite size. Rows of one
    vec_id with different vectors are further vectors, each with its own links and component.
    Other columns are not read; an empty table gives an empty result.
    """
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn("sound", sound)
    keyed = rows.select(
        "vec_id",
        F.when(F.col("sound"), F.col("embedding")).alias("embedding"),
        "label",
        F.when(F.col("sound"), F.xxhash64("label", "embedding")).alias("h1"),
        F.when(F.col("sound"), F.xxhash64(F.lit("second"), "embedding", "label")).alias("h2"),
    )
    classes = keyed.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    label = dict(rows.dtypes)["label"]
    reps = materialize(classes.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    axes = principal_axes(reps)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    here = [f"c{k}" for k in range(AXES)]

    def turn(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            cells = np.zeros((len(dims), AXES), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.column("embedding").take(pa.array(at)))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                lead = (x @ axes[dim][:, :AXES]) if dim in axes else x[:, :AXES]
                cells[at, : lead.shape[1]] = np.floor(lead / width)
            for k, name in enumerate(here):
                batch = batch.append_column(name, pa.array(cells[:, k]))
            yield batch

    kinds = "embedding array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "embedding array<double>"
    shape = f"node long, n long, label {label}, {kinds}, dim int, {', '.join(f'{c} int' for c in here)}"
    dealt = materialize(reps.select("node", "n", "label", F.col("embedding").cast(kinds.split()[1]).alias("embedding"), "dim").mapInArrow(turn, shape), "cells")
    dealt_table = dealt
    filled = materialize(dealt.groupBy("label", "dim", *here).agg(F.count("*").alias("m")), "filled")
    for used in range(2, AXES + 1):
        own = filled.groupBy("label", "dim", *here[:used]).agg(F.sum("m").alias("m"))
        tiles = own.agg(F.sum(F.col("m") * F.ceil(F.col("m") / tile)) / F.sum("m")).first()[0]  # one row
        if (tiles or 0) <= CROWDED:
            break
    dealt = dealt.withColumns({c: F.lit(0) for c in here[used:]})
    there = [f"d{k}" for k in range(AXES)]
    cell = ["label", "dim", *here]
    sizes = dealt.groupBy(*cell).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    sizes = materialize(sizes, "sizes")
    # A cell meets itself and half of its neighbours: those whose first step is upward.
    steps = [s for s in itertools.product((-1, 0, 1), repeat=used) if s >= (0,) * used]
    step = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps)))
    moved = [(F.col(c) + (F.get("step", F.lit(k)) if k < used else 0)).alias(t) for k, (c, t) in enumerate(zip(here, there, strict=True))]
    forward = sizes.withColumn("step", step).select(*cell, "parts", *moved)
    other = sizes.select("label", "dim", *(F.col(c).alias(t) for c, t in zip(here, there, strict=True)), F.col("parts").alias("parts2"))
    meets = forward.join(other, ["label", "dim", *there])
    same = F.struct(*here) == F.struct(*there)
    from_left = meets.select(*cell, "parts", F.struct(*here, *there, F.lit(0).alias("side"), same.alias("same"), F.col("parts2").alias("others")).alias("meet"))
    from_right = meets.where(~same).select(
        "label", "dim", *(F.col(t).alias(c) for c, t in zip(here, there, strict=True)), F.col("parts2").alias("parts"),
        F.struct(*here, *there, F.lit(1).alias("side"), same.alias("same"), F.col("parts").alias("others")).alias("meet"),
    )
    plan = from_left.unionByName(from_right).groupBy(*cell).agg(F.first("parts").alias("parts"), F.collect_list("meet").alias("meets"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    sent = (
        dealt.join(plan, cell)
        .withColumn("own", own)
        .withColumn("meet", F.explode("meets"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("meet.others") - 1)))
        .select(
            "label", "dim", *(f"meet.{c}" for c in (*here, *there)),
            F.when(F.col("meet.same"), F.least("own", "part")).when(F.col("meet.side") == 0, F.col("own")).otherwise(F.col("part")).alias("p"),
            F.when(F.col("meet.same"), F.greatest("own", "part")).when(F.col("meet.side") == 0, F.col("part")).otherwise(F.col("own")).alias("q"),
            F.when(F.col("meet.same"), (F.col("own") > F.col("part")).cast("int")).otherwise(F.col("meet.side")).alias("side"),
            F.col("meet.same").alias("same"), "node", "n", "embedding",
        )
    )

    def compare(table: pa.Table) -> pa.Table:
        raw = _matrix(table.column("embedding").combine_chunks())
        side = np.asarray(table.column("side"))
        ids, weight = np.asarray(table.column("node")), np.asarray(table.column("n"))
        alone = bool(table.column("same")[0].as_py()) and table.column("p")[0].as_py() == table.column("q")[0].as_py()
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        dim = raw.shape[1]
        turned = unit @ axes[dim] if dim in axes else unit
        left = np.arange(len(side)) if alone else np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        i, j = pairs_within(turned[left], turned[right], raw[left], raw[right], threshold)
        if alone:
            i, j = i[i < j], j[i < j]
        node, links, root = tile_result(ids, weight, left[i], right[j])
        return pa.table({"node": node, "links": links, "root": root})

    keys = ["label", "dim", *here, *there, "p", "q"]
    found = materialize(sent.groupBy(*keys).applyInArrow(compare, "node long, links long, root long"), "links")
    discard(dealt_table, filled, sizes)
    names = reps.select("node", "h1", "h2", "rep", "n")
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(names.select("node", "rep"), "node")
    # A component is named by the smallest vec_id of its nodes.
    comps = materialize(comps.select("node", "component", "rep"), "components")
    named = comps.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(comps.join(named, "component"), "node").select("node", "links", "component_id")
    answers = materialize(
        names.join(linked, "node", "left").select(
            "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component")
        ),
        "answers",
    )
    discard(reps, found, comps)
    component = F.coalesce("component", "vec_id")
    return keyed.select("vec_id", "h1", "h2").join(answers, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
