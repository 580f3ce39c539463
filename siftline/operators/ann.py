"""Approximate nearest neighbours: two-level cells, a few of them probed, exact scores.

Base vectors are assigned to cells around fine pivots, which are grouped under coarse pivots; both are
a bounded sample of the base. A vector looks for its cell among the fine pivots of its nearest coarse
groups only, so assigning costs about the square root of the number of cells. A query visits the
``probes`` nearest cells of as many groups as it takes, and every row there is scored exactly: results
are right in order and score, but rows of other cells are missed. ``recall`` measures how many. How many
cells that takes depends on the vectors and grows with their number where they have no clusters, so unless
a caller fixes ``probes`` it is measured: the true neighbours of ``ASKED`` queries are found by brute force,
and as many cells are probed as hold ``least`` of them.

Neither queries nor base rows are copied: base rows are written once in the order of their cells, in files
of bounded size, and a task takes the queries of one file and reads the files in which their cells lie. So no
task grows with the data; equal base vectors beyond the first ``k`` by id do not take part, as they cannot be
among anyone's ``k`` best.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.blocks import matrix, read_blocks, write_blocks
from siftline.operators.knn import _distances, _matrix, _prepare, nearest
from siftline.operators.ranking import first_per_group
from siftline.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_ROWS = 1024
MOST_CELLS = 4096  # pivots on the driver
BLOCK = 4096
HELD = 1 << 20  # rows found, in a task
ASKED = 256  # queries whose neighbours are found by brute force
LEAST = 0.95


class Cells:
    """Fine pivots under coarse ones."""

    def __init__(self, pivots: np.ndarray, groups: int | None = None):
        self.pivots = pivots
        groups = groups or max(1, int(np.sqrt(len(pivots))))
        self.coarse = pivots[:: max(1, len(pivots) // groups)][:groups]
        near = _distances(pivots, self.coarse).argmin(1)
        self.members = [np.flatnonzero(near == g) for g in range(len(self.coarse))]

    def nearest(self, x: np.ndarray, n: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``n`` nearest cells of each row and their distances, among the ``wide`` nearest groups (-1 and inf beyond)."""
        wide = min(wide, len(self.coarse))
        far = _distances(x, self.coarse)
        groups = np.argsort(far, 1, kind="stable")[:, :wide]
        cells, dist = np.full((len(x), n), -1), np.full((len(x), n), np.inf)
        for g in np.unique(groups):
            own, inside = np.flatnonzero((groups == g).any(1)), self.members[g]
            if not len(inside):
                continue
            d = _distances(x[own], self.pivots[inside])
            every = np.concatenate([dist[own], d], 1)
            names = np.concatenate([cells[own], np.broadcast_to(inside, d.shape)], 1)
            order = np.argsort(every, 1, kind="stable")[:, :n]
            dist[own], cells[own] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
        return cells, dist


def probes_needed(cells: Cells, queries: DataFrame, placed: DataFrame, k: int, least: float) -> int:
    """In how many of its nearest cells a query finds ``least`` of its ``k`` nearest base rows, itself left out.

    ``queries``: (id, vec), of which ``ASKED`` are compared with every row of ``placed`` (id, vec, cell).
    """
    some = queries.orderBy(F.md5(F.col("id").cast("string")), "id").limit(ASKED).collect()
    if not some:
        return 1
    x = np.array([r["vec"] for r in some], dtype=np.float64)

    def nearest(batches):
        for pdf in batches:
            d = _distances(x, _matrix(pdf["vec"]))
            at = np.argsort(d, 1, kind="stable")[:, : k + 1]
            yield pd.DataFrame({
                "q": np.repeat(np.arange(len(x), dtype="int32"), at.shape[1]), "neighbour": pdf["id"].to_numpy()[at.ravel()],
                "cell": pdf["cell"].to_numpy()[at.ravel()], "distance": np.take_along_axis(d, at, 1).ravel()})

    id_type = placed.schema["id"].dataType.simpleString()
    near = placed.mapInPandas(nearest, f"q int, neighbour {id_type}, cell int, distance double")
    near = first_per_group(near, ["q"], ["distance", "neighbour"], k + 1).orderBy("q", "distance", "neighbour").toPandas()  # (k + 1) * ASKED rows
    near = near[near["neighbour"].to_numpy() != np.array([r["id"] for r in some], dtype=object)[near["q"]]].groupby("q").head(k)
    rank = _distances(x, cells.pivots).argsort(1, kind="stable").argsort(1)[near["q"], near["cell"]]
    return int(np.sort(rank)[max(0, int(np.ceil(least * len(rank))) - 1)]) + 1 if len(rank) else 1


def best_rows(x: np.ndarray, asks: np.ndarray, files: list[str], k: int, block: int):
    """(q, neighbour, distance) frames of the ``k`` nearest rows to each row of ``x`` in the cells it asks for.

    ``files``: (id, vec, cell) in the order of cells and ids, read one after the other. What is held between
    them is the best so far and at most ``HELD`` rows found since.
    """
    wanted, bound, found, n = np.flatnonzero(asks.any(0)), np.full(len(x), np.inf), [], 0

    def best() -> pd.DataFrame:
        rows = pd.concat(found).sort_values(["q", "distance", "neighbour"]).groupby("q").head(k).reset_index(drop=True)
        full = rows.groupby("q")["distance"].agg(["size", "max"])
        full = full[full["size"] >= k]
        bound[full.index.to_numpy()] = full["max"].to_numpy()
        return rows

    for uri in files:
        for b in read_blocks(uri, block, ("cell", wanted)):
            ids, cell, y = b.column("id").to_pandas().to_numpy(), b.column("cell").to_numpy(), matrix(b.column("vec"), b.num_rows)
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            for start, end in zip(starts, np.append(starts[1:], len(cell))):
                own = np.flatnonzero(asks[:, cell[start]])
                if not len(own):
                    continue
                for qi, bi, exact in nearest(x[own], y[start:end], bound[own], k):
                    found.append(pd.DataFrame({"q": own[qi], "neighbour": ids[start + bi], "distance": exact}))
                    n += len(qi)
                if n > HELD:
                    found, n = [best()], 0
    if found:
        yield best()


def approx_join(
    queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", probes: int | None = None, cell_rows: int = CELL_ROWS,
    exclude_self: bool = False, block: int = BLOCK, least: float = LEAST,
) -> DataFrame:
    """(id, neighbour, distance, similarity): about the ``k`` nearest base rows of each query row.

    ``queries`` and ``base``: (id, vec). As ``knn.knn_join`` but for rows in cells that are not probed.
    With as many probes as there are cells the result is exact; without a number of probes it is measured.
    """
    want = k + 1 if exclude_self else k
    q_all, b_all = _prepare(queries, metric, None), _prepare(base, metric, None)
    b = cut(first_per_group(b_all.withColumn("key", F.xxhash64("vec")), ["vec"], ["id"], want).drop("key", "part"))
    n = b.count()
    id_type = b.schema["id"].dataType.simpleString()
    wanted = min(MOST_CELLS, max(1, n // cell_rows))
    sample = b.orderBy(F.md5(F.col("id").cast("string")), "id").limit(wanted).select("vec").collect()  # MOST_CELLS rows at most
    if not sample:
        return queries.sparkSession.createDataFrame([], f"id {queries.schema['id'].dataType.simpleString()}, neighbour {id_type}, distance double, similarity double")
    cells = Cells(np.array([r["vec"] for r in sample], dtype=np.float64))

    def assign(batches):
        for pdf in batches:
            yield pdf.assign(cell=cells.nearest(_matrix(pdf["vec"]), 1, 2)[0][:, 0].astype("int32"))

    placed = cut(b.mapInPandas(assign, f"id {id_type}, vec array<double>, cell int"))
    wide = len(cells.coarse) if probes is None else max(2, probes)  # ranks are measured among all cells
    probes = probes_needed(cells, q_all.select("id", "vec"), placed, k, least) if probes is None else probes

    asked = cut(q_all.withColumn("qid", F.xxhash64("vec")).groupBy("vec").agg(F.min("qid").alias("qid")))
    held = write_blocks(placed, ["cell", "id"], n, block, "cells")
    files = write_blocks(asked, ["qid"], asked.count(), block, "cell-queries")

    def visit(batches):
        """The queries of one file meet the rows of their cells, file by file."""
        for i in (i for pdf in batches for i in pdf["id"]):
            for b in read_blocks(files[i], block):
                x, qid = matrix(b.column("vec"), b.num_rows), b.column("qid").to_numpy()
                own = cells.nearest(x, probes, wide)[0]
                asks = np.zeros((len(x), len(cells.pivots)), dtype=bool)
                asks[np.nonzero(own >= 0)[0], own[own >= 0]] = True
                for found in best_rows(x, asks, held, want, block):
                    yield pd.DataFrame({"qid": qid[found["q"]], "neighbour": found["neighbour"], "distance": found["distance"]})

    spark = queries.sparkSession
    near = spark.range(0, len(files), 1, max(1, len(files))).mapInPandas(visit, f"qid bigint, neighbour {id_type}, distance double")
    pairs = q_all.select("id", F.xxhash64("vec").alias("qid")).join(near.hint("merge"), "qid").drop("qid")  # its size cannot be told from the number of files
    if exclude_self:
        pairs = first_per_group(pairs.where(F.col("id") != F.col("neighbour")), ["id"], ["distance", "neighbour"], k)
    sim = 1 - F.col("distance") * F.col("distance") / 2 if metric == "cosine" else F.lit(None).cast("double")
    return pairs.select("id", "neighbour", "distance", sim.alias("similarity"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact (id, neighbour) pairs were found. Measure it on a sample of queries."""
    hit = exact.select("id", "neighbour").join(found.select("id", "neighbour", F.lit(1).alias("_hit")), ["id", "neighbour"], "left")
    return hit.agg(F.count("*").alias("n"), F.count("_hit").alias("found"), (F.count("_hit") / F.count("*")).alias("recall"))
