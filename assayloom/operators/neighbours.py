"""Exact nearest neighbours of every row of a table, in bounded blocks.

A kd-tree over a bounded sample cuts the table into cells, and cells of more than ``block`` rows into parts. Every
row looks through its own block first. The distance of its k-th neighbour there then decides which cells it has to
meet: those whose bounding box is not farther away. Cells that lie side by side form a host of many blocks, and a row
is sent once to every host that has such a cell, so what is sent does not grow with the number of blocks. The result
does not depend on the tree or the block size, only the work does: few hosts are met in few dimensions, most of them
where all distances are alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.session import stage_table

BLOCK_ROWS = 5_000
#: Bounds of the tree that the driver holds: leaves, sampled rows per leaf, and sampled numbers.
MOST_CELLS, SAMPLE_PER_CELL, SAMPLE_NUMBERS = 1_024, 32, 4_000_000
#: Rows of a host at most, hosts that a smaller table has, and hosts' rows in a chunk of the rows that visit a host.
HOST_ROWS, LEAST_HOSTS, VISITORS = 16_384, 8, 4
SLACK = 1e-9

NEAR = "array<struct<d:double,h:bigint,rid:bigint>>"


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, width))


def closest(
    x: np.ndarray, rid: np.ndarray, bound: np.ndarray, pool: np.ndarray, pool_rid: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``x``: places in ``pool`` of its k nearest rows but itself, and their squared distances.

    ``pool`` is in tie order; rows farther than ``bound`` are left out. A matrix product finds candidates with a
    margin for rounding, and their distances are taken from differences, so they are alike in every block.
    """
    norms = (pool * pool).sum(1)
    last = k - 1 + int(np.unique(pool_rid, return_counts=True)[1].max(initial=0))  # rows with the own id are passed over
    for start in range(0, len(x), 256):
        part = x[start : start + 256]
        own = (part * part).sum(1)
        rough = own[:, None] - 2 * part @ pool.T + norms[None, :]
        kth = np.partition(rough, last, axis=1)[:, last] if len(pool) > last else np.full(len(part), np.inf)
        limit = np.minimum(kth, bound[start : start + 256]) + SLACK * (own + norms.max(initial=0.0))
        for i in range(len(part)):
            near = np.flatnonzero(rough[i] <= limit[i])
            near = near[pool_rid[near] != rid[start + i]]
            d = ((pool[near] - part[i]) ** 2).sum(1)
            order = np.argsort(d, kind="stable")[:k]
            keep = order[d[order] <= bound[start + i]]
            yield near[keep], d[keep]


def kd_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split feature and cut of every inner node, children of node n at 2n + 1 and 2n + 2.

    A node is cut at the median of the feature that spreads most; nodes without spread send all rows left.
    """
    feature, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
    rows = {0: sample}
    for node in range(2**depth - 1):
        own = rows.pop(node)
        if len(own) > 1 and np.ptp(own, axis=0).max() > 0:
            feature[node] = int(np.argmax(np.ptp(own, axis=0)))
            values = own[:, feature[node]]
            cut[node] = np.median(values)
            if not (values > cut[node]).any():
                cut[node] = values[values < cut[node]].max()
        left = own[:, feature[node]] <= cut[node]
        rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
    return feature, cut


def cells_of(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), int)
    places = np.arange(len(x))
    while len(feature) and node.size and node[0] < len(feature):
        node = 2 * node + 1 + (x[places, feature[node]] > cut[node])
    return node


def blocked(rows: DataFrame, block: int, n: int, width: int) -> DataFrame:
    """Adds ``cell`` and ``part`` to (rid, h, v, ...): a block is a part of a cell, with about ``block`` rows at most.

    Parts are cut by hash, so a cell of copies is spread evenly.
    """
    depth = max(0, int(np.ceil(np.log2(min(MOST_CELLS, max(1, n / block))))))
    if depth == 0:
        return rows.select("*", F.lit(0).alias("cell"), F.lit(1).alias("parts"), F.lit(0).alias("part"))
    size = max(2, min(SAMPLE_PER_CELL * 2**depth, SAMPLE_NUMBERS // max(1, width)))
    sample = _matrix(pd.Series([r.v for r in rows.orderBy("h", "rid").select("v").limit(size).collect()]), width)
    feature, cut = kd_tree(sample, depth)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(cells_of(_matrix(v, width), feature, cut))

    placed = rows.withColumn("cell", cell("v"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    # One row per leaf of a tree of at most MOST_CELLS leaves.
    joined = placed.join(F.broadcast(parts), "cell")
    return joined.withColumn("part", F.pmod(F.xxhash64("h", "rid"), F.col("parts")).cast("int"))


def host_rows(block: int, n: int) -> int:
    return max(block, min(HOST_ROWS, -(-n // LEAST_HOSTS)))


def hosts_of(cells: Sequence[tuple[int, int]], block: int, n: int) -> dict[int, tuple[int, int]]:
    """(first host, number of hosts) of every cell of (cell, rows): cells in order share a host, large ones have several."""
    most = host_rows(block, n)
    out, host, held = {}, -1, most
    for cell, rows in sorted(cells):
        if rows > most:
            out[cell] = (host + 1, -(-rows // most))
            host, held = host + out[cell][1], most
            continue
        if held + rows > most:
            host, held = host + 1, 0
        out[cell], held = (host, 1), held + rows
    return out


def nearest(rows: DataFrame, k: int, n: int, width: int, block: int = BLOCK_ROWS) -> DataFrame:
    """(rid, near) of every row of (rid, h, v): its k nearest other rows by distance, then ``h``, then ``rid``.

    ``rid`` tells rows apart, ``h`` orders ties; vectors have ``width`` finite numbers and ``n`` is their count.
    ``near`` holds squared distances, and all other rows if there are fewer than k. An empty table gives no rows.
    """
    placed = blocked(rows.select("rid", "h", "v"), block, n, width)

    def own_block(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["h", "rid"], kind="stable")
        x, rid, h = _matrix(batch["v"], width), batch["rid"].to_numpy(), batch["h"].to_numpy()
        found = [
            [(float(dist), int(h[p]), int(rid[p])) for p, dist in zip(at, d)]
            for at, d in closest(x, rid, np.full(len(x), np.inf), x, rid, k)
        ]
        out = batch[["rid", "h", "v", "cell", "part"]].assign(near=found, n=None, lo=None, hi=None)
        box = out.iloc[:1].assign(rid=None, h=None, v=None, near=None, n=len(x), lo=[x.min(0).tolist()], hi=[x.max(0).tolist()])
        return pd.concat([out.astype({"rid": "Int64", "h": "Int64"}), box.astype({"rid": "Int64", "h": "Int64"})])

    schema = f"rid bigint, h bigint, v array<double>, cell int, part int, near {NEAR}, n bigint, lo array<double>, hi array<double>"
    first = placed.groupBy("cell", "part").applyInPandas(own_block, schema)
    if n <= block:
        return first.where("rid IS NOT NULL").select("rid", "near")
    first = stage_table(first, "neighbours")

    def cell_box(batch: pd.DataFrame) -> pd.DataFrame:
        lo, hi = _matrix(batch["lo"], width).min(0), _matrix(batch["hi"], width).max(0)
        return batch.iloc[:1][["cell"]].assign(n=int(batch["n"].sum()), lo=[lo.tolist()], hi=[hi.tolist()])

    boxes = first.where("rid IS NULL").groupBy("cell").applyInPandas(cell_box, "cell int, n bigint, lo array<double>, hi array<double>").collect()
    at = hosts_of([(b.cell, b.n) for b in boxes], block, n)
    # One row per leaf of a tree of at most MOST_CELLS leaves.
    houses = rows.sparkSession.createDataFrame([(c, f, many) for c, (f, many) in at.items()], "cell int, first int, many int")
    found = first.where("rid IS NOT NULL").drop("lo", "hi", "n").join(F.broadcast(houses), "cell")
    found = found.withColumn("host", F.col("first") + F.pmod("part", "many").cast("int"))
    bound = F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))["d"]).otherwise(F.lit(float("inf")))
    limits: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in sorted(boxes, key=lambda b: b.cell):
        limits.setdefault(at[b.cell], []).append((np.array(b.lo), np.array(b.hi)))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, far = _matrix(batch["v"], width), batch["bound"].to_numpy()
            reach = far + SLACK * ((x * x).sum(1) + 1)
            batch = batch.assign(bound=far * (1 + SLACK))
            for (host, many), cells in limits.items():
                going = np.zeros(len(x), bool)
                for lo, hi in cells:
                    rest = np.flatnonzero(~going)
                    some = x[rest]
                    going[rest] = (np.maximum(0, np.maximum(lo - some, some - hi)) ** 2).sum(1) <= reach[rest]
                for one in range(host, host + many if going.any() else host):
                    yield batch[going].assign(host=one)

    # A row is sent to its own host too, whose answer takes the place of its own block's.
    sent = stage_table(found.select("rid", "v", bound.alias("bound")).mapInPandas(visits, "rid bigint, v array<double>, bound double, host int"), "visits")
    chunks = sent.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / (VISITORS * host_rows(block, n))).cast("int").alias("chunks"))
    guests = sent.join(F.broadcast(chunks), "host").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    hosts = found.select("rid", "h", "v", "host").join(F.broadcast(chunks), "host")
    hosts = hosts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def look(guest: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        host = host.sort_values(["h", "rid"], kind="stable")
        pool, rid, h = _matrix(host["v"], width), host["rid"].to_numpy(), host["h"].to_numpy()
        met = closest(_matrix(guest["v"], width), guest["rid"].to_numpy(), guest["bound"].to_numpy(), pool, rid, k)
        out = [(int(g), [(float(dist), int(h[p]), int(rid[p])) for p, dist in zip(at, d)]) for g, (at, d) in zip(guest["rid"], met)]
        return pd.DataFrame(out, columns=["rid", "near"])

    by = ["host", "chunk"]
    more = guests.drop("chunks").groupBy(*by).cogroup(hosts.drop("chunks").groupBy(*by)).applyInPandas(look, f"rid bigint, near {NEAR}")
    return more.groupBy("rid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
