"""Most similar items by cosine, with blocks of items that cannot be among them left unread.

Unit vectors obey the triangle inequality by angle. Every item belongs to the cell of its nearest pivot, and
a cell's items, in order of their angle to the pivot, are packed into blocks. From a query's angle to the
pivot and a block's range of angles follows the highest score an item of the block can have. A query first
scores the blocks of highest bound that hold ``k`` items; afterwards only those whose bound reaches its
``k``-th score. There queries go in groups to spans of blocks, a group once to a span, however many cells a span
has. Pivots and cells are at most ``CELLS``; blocks, queries and their pairs stay distributed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdeck.session import scratch_path, stored

#: Pivots at most, items of a block, queries scored against a block at once, queries that go round the cells.
CELLS = 1_024
BLOCK = 4_096
QUERIES = 1_024
#: Items of a span and queries that meet it in one task, about; queries of a group, parts of all queries at least.
SPAN = 32_768
GROUP = 4_096
PARTS = 16
FEW = 512
#: Angles are rounded: bounds give way by this much.
SLACK = 1e-7
ZERO = -1


def unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _units(vectors: pd.Series) -> np.ndarray:
    return unit_rows(np.stack(vectors.to_numpy()).astype("float64"))


def _matrix(data: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(data)).reshape(-1, width)


def keep_best(kept, ids, items, sims, k, query_id, item_id):
    """The ``k`` best of ``kept`` and of the scores ``sims`` (a row for each item, a column for each query)."""
    sims = np.round(sims, 9)
    if len(items) > k:
        # All items at or above the k-th value, so that ties are settled by id below.
        row, col = np.nonzero(sims >= np.partition(sims, len(items) - k, axis=0)[len(items) - k])
    else:
        row, col = (a.ravel() for a in np.indices(sims.shape))
    fresh = pd.DataFrame({query_id: np.asarray(ids)[col], item_id: items[row], "score": sims[row, col]})
    pool = fresh if kept is None else pd.concat([kept, fresh], ignore_index=True)
    pool = pool.sort_values([query_id, "score", item_id], ascending=[True, False, True])
    return pool.groupby(query_id, sort=False).head(k)


@dataclass
class CosineCells:
    """Items in cells and blocks: ``blocks`` has a row for each block, ``bounds`` its ``cell, block, n,
    low, high`` alone, ``cells`` (on the driver) the same for each cell, in the order of ``pivots``."""

    blocks: DataFrame
    bounds: DataFrame
    cells: pd.DataFrame
    pivots: np.ndarray
    item_id: str

    @property
    def total(self) -> int:
        return int(self.cells["n"].sum())


def cosine_cells(
    items: DataFrame, item_id: str = "vec_id", vector: str = "embedding", cells: int | None = None, block: int = BLOCK
) -> CosineCells:
    """Sort ``items`` into cells and write their blocks to the scratch folder, a folder for each cell.

    Pivots are the items of smallest hash: the square root of their number, or ``cells``. Null vectors take
    no part; a zero vector has score 0 with any other and a cell of its own.
    """
    given = items.select(item_id, vector).filter(F.col(vector).isNotNull())
    count = cells or min(CELLS, int(np.ceil(np.sqrt(given.count()))))
    drawn = given.orderBy(F.xxhash64(item_id), item_id).limit(count).select(vector).collect()
    pivots = unit_rows(np.array([r[0] for r in drawn], dtype="float64").reshape(len(drawn), -1 if drawn else 0))
    pivots = np.unique(pivots[np.any(pivots != 0, axis=1)], axis=0)
    kind = items.schema[item_id].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            units = _units(batch[vector])
            cell, angle = np.full(len(units), ZERO), np.zeros(len(units))
            if len(pivots):
                near = units @ pivots.T
                best = near.argmax(axis=1)
                some = np.any(units != 0, axis=1)
                cell = np.where(some, best, ZERO)
                angle = np.where(some, np.arccos(np.clip(near[np.arange(len(near)), best], -1, 1)), 0.0)
            yield pd.DataFrame({"cell": cell, "angle": angle, "id": batch[item_id], "unit": [u.tobytes() for u in units]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            held = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            full = [own.iloc[at : at + block] for _, own in held.groupby("cell") for at in range(0, len(own), block)]
            for g in full[:-1]:
                yield packed(g)
            rest = full[-1] if full else None
        if rest is not None:
            yield packed(rest)

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        row = (int(g["cell"].iloc[0]), len(g), g["angle"].min(), g["angle"].max(), list(g["id"]), b"".join(g["unit"]))
        return pd.DataFrame([row], columns=["cell", "n", "low", "high", "ids", "units"])

    placed = given.mapInPandas(place, f"cell int, angle double, id {kind}, unit binary")
    order = ["cell", "angle", "id"]
    blocks = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = blocks.mapInPandas(pack, f"cell int, n long, low double, high double, ids array<{kind}>, units binary")
    path = scratch_path(items.sparkSession, "cosine-cells")
    blocks.withColumn("block", F.monotonically_increasing_id()).write.partitionBy("cell").parquet(path)
    schema = f"n long, low double, high double, ids array<{kind}>, units binary, block long, cell int"
    read = items.sparkSession.read.schema(schema).parquet(path)
    bounds = read.select("cell", "block", "n", "low", "high")
    whole = bounds.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return CosineCells(read, bounds, whole.toPandas().sort_values("cell", ignore_index=True), pivots, item_id)


def _tops(units: np.ndarray, pivots: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of queries to the pivots of cells, and the highest score that an item of a cell or block can have."""
    inner = cell != ZERO
    angle = np.zeros((len(units), len(cell)))
    angle[:, inner] = np.arccos(np.clip(units @ pivots[cell[inner]].T, -1, 1)) if inner.any() else 0.0
    top = np.cos(np.clip(np.maximum(low - angle, angle - high) - SLACK, 0, np.pi))
    top[:, ~inner] = 0.0
    top[~np.any(units != 0, axis=1)] = 0.0
    return angle, top


def _cells_for(index: CosineCells, k: int, query_id: str):
    """Of every query the cells whose bound reaches ``floor``, or without one the cells of highest bound that
    hold ``k`` items, with the query's angle to the pivot."""
    cells, pivots = index.cells, index.pivots

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, low, high, n = (cells[c].to_numpy() for c in ("cell", "low", "high", "n"))
        for batch in batches:
            if not len(batch) or not len(number):
                continue
            units = _matrix(batch["unit"].tolist(), pivots.shape[1] if len(pivots) else len(batch["unit"].iloc[0]) // 8)
            angle, top = _tops(units, pivots, number, low, high)
            if "floor" in batch:
                row, col = np.nonzero(top >= batch["floor"].to_numpy()[:, None])
            else:
                order = np.argsort(-top, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1) - n[order]
                row, at = np.nonzero(held < k)
                col = order[row, at]
            own = batch[query_id].to_numpy()[row]
            yield pd.DataFrame({query_id: own, "cell": number[col], "angle": angle[row, col], "zero": ~np.any(units != 0, axis=1)[row]})

    return run


def _with_bounds(pairs: DataFrame, index: CosineCells) -> DataFrame:
    """Blocks of the cells of ``pairs``, and the highest score that an item of theirs can have."""
    apart = F.greatest(F.col("low") - F.col("angle"), F.col("angle") - F.col("high")) - SLACK
    flat = (F.col("cell") == ZERO) | F.col("zero")
    return pairs.join(index.bounds, "cell").withColumn("top", F.when(flat, F.lit(0.0)).otherwise(F.cos(F.greatest(apart, F.lit(0.0)))))


def _scored(pairs: DataFrame, units: DataFrame, index: CosineCells, k: int, query_id: str, schema: str) -> DataFrame:
    """The ``k`` best of every query in every block it is paired with, ``QUERIES`` of them at a time."""
    crowd = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts"))
    dealt = pairs.select(query_id, "block").join(units, query_id).join(crowd, "block")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(query_id), F.col("parts")))
    asked = dealt.groupBy("block", "part").agg(F.collect_list(query_id).alias("queries"), F.collect_list("unit").alias("asked"))
    # At most CELLS of them; folders of other cells are not read.
    needed = [r[0] for r in pairs.select("cell").distinct().collect()]
    blocks = index.blocks.filter(F.col("cell").isin(needed)).select("block", "ids", "units")
    item_id = index.item_id

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for queries, own, ids, data in zip(batch["queries"], batch["asked"], batch["ids"], batch["units"], strict=True):
                matrix = np.frombuffer(data).reshape(len(ids), -1)
                sims = matrix @ _matrix(list(own), matrix.shape[1]).T
                yield keep_best(None, list(queries), np.asarray(ids), sims, k, query_id, item_id)

    return asked.join(blocks, "block").select("queries", "asked", "ids", "units").mapInPandas(best, schema)


def _grouped(asked: DataFrame, index: CosineCells, query_id: str) -> DataFrame:
    """``(part, ids, floors, asked)``: queries near one pivot as one row, ``GROUP`` of them at most."""
    pivots = index.pivots
    kind = asked.schema[query_id].dataType.simpleString()

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                units = _matrix(batch["unit"].tolist(), len(batch["unit"].iloc[0]) // 8)
                yield batch.assign(near=(units @ pivots.T).argmax(axis=1) if len(pivots) else 0)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), GROUP):
                g = batch.iloc[at : at + GROUP]
                yield pd.DataFrame([(list(g[query_id]), g["floor"].to_numpy().tobytes(), b"".join(g["unit"]))], columns=["ids", "floors", "asked"])

    placed = asked.mapInPandas(near, f"{query_id} {kind}, unit binary, floor double, near long")
    ordered = placed.repartitionByRange("near", query_id).sortWithinPartitions("near", query_id)
    return ordered.mapInPandas(pack, f"ids array<{kind}>, floors binary, asked binary")


def _scored_in_spans(asked: DataFrame, index: CosineCells, k: int, query_id: str, schema: str) -> DataFrame:
    """The ``k`` best of every query of ``(query_id, unit, floor)`` in every span of blocks that may hold an item
    which reaches ``floor``. A task holds one span and one part of the queries that need it."""
    cells, pivots, item_id = index.cells, index.pivots, index.item_id
    parts = max(PARTS, -(-asked.count() // SPAN))
    # One narrow row for each block.
    through = F.sum("n").over(Window.orderBy("cell", "block").rowsBetween(Window.unboundedPreceding, 0))
    spans = stored(index.bounds.withColumn("span", ((through - 1) / SPAN).cast("long")).select("cell", "block", "span"), "cosine-spans")
    # A row for each cell.
    reach = spans.groupBy("cell").agg(F.min("span").alias("first"), F.max("span").alias("last")).toPandas().set_index("cell")
    kind = asked.schema[query_id].dataType.simpleString()

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, low, high = (cells[c].to_numpy() for c in ("cell", "low", "high"))
        for batch in batches:
            for ids, floors, data in zip(batch["ids"], batch["floors"], batch["asked"], strict=True):
                units = np.frombuffer(data).reshape(len(ids), -1)
                wanted = (_tops(units, pivots, number, low, high)[1] >= np.frombuffer(floors)[:, None]).any(axis=0)
                found = reach.loc[number[wanted]]
                part = zlib.crc32(data) % parts
                for span in sorted({x for a, b in zip(found["first"], found["last"]) for x in range(a, b + 1)}):
                    yield pd.DataFrame([(span, part, ids, floors, data)], columns=["span", "part", "ids", "floors", "asked"])

    sent = _grouped(asked, index, query_id).mapInPandas(send, f"span long, part long, ids array<{kind}>, floors binary, asked binary")
    blocks = index.blocks.join(spans, ["cell", "block"]).select("span", "cell", "low", "high", "ids", "units")
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def best(groups: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({query_id: [], item_id: [], "score": []})]
        cell, low, high = (blocks[c].to_numpy() for c in ("cell", "low", "high"))
        for ids, floors, data in zip(groups["ids"], groups["floors"], groups["asked"], strict=True) if len(blocks) else ():
            units, floor = np.frombuffer(data).reshape(len(ids), -1), np.frombuffer(floors).copy()
            top = _tops(units, pivots, cell, low, high)[1]
            kept, held = [], 0
            for at, (own, item_data) in enumerate(zip(blocks["ids"], blocks["units"], strict=True)):
                asking = np.flatnonzero(top[:, at] >= floor)
                if not len(asking):
                    continue
                sims = np.frombuffer(item_data).reshape(len(own), -1) @ units[asking].T
                # The floor gives way by more than what rounding can add.
                row, col = np.nonzero(sims >= floor[asking])
                kept.append(pd.DataFrame({"q": asking[col], item_id: np.asarray(own)[row], "score": np.round(sims[row, col], 9)}))
                held += len(row)
                if held > 4 * k * len(ids):
                    kept, held = _raise_floor(kept, floor, k, item_id)
            if kept:
                (pool,), _ = _raise_floor(kept, floor, k, item_id)
                out.append(pd.DataFrame({query_id: np.asarray(ids)[pool["q"]], item_id: pool[item_id], "score": pool["score"]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    keys = ["span", "part"]
    return sent.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(best, schema)


def _raise_floor(kept: list[pd.DataFrame], floor: np.ndarray, k: int, item_id: str) -> tuple[list[pd.DataFrame], int]:
    """The ``k`` best of each query; ``floor`` rises to the ``k``-th score of those that have as many."""
    pool = pd.concat(kept, ignore_index=True).sort_values(["q", "score", item_id], ascending=[True, False, True])
    pool = pool[pool.groupby("q", sort=False).cumcount() < k]
    full = pool.groupby("q", sort=False)["score"].agg(["size", "min"])
    full = full[full["size"] >= k]
    floor[full.index] = np.maximum(floor[full.index], full["min"] - 1e-9)
    return [pool], len(pool)


def nearest_in_cells(queries: DataFrame, index: CosineCells, k: int, query_id: str = "query_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``(query_id, rank, item_id, score)`` of the ``k`` most similar items, and ``(query_id, scored)``, the
    number of items whose score was worked out. Query ids are distinct; null vectors have no rows."""
    kind = queries.schema[query_id].dataType.simpleString()
    item_kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"{query_id} {kind}, {index.item_id} {item_kind}, score double"

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({query_id: batch[query_id], "unit": [u.tobytes() for u in _units(batch[vector])]})

    given = queries.select(query_id, vector).filter(F.col(vector).isNotNull())
    units = stored(given.mapInPandas(unit, f"{query_id} {kind}, unit binary"), "cosine-queries")
    cells_of = _cells_for(index, k, query_id)
    pair = f"{query_id} {kind}, cell int, angle double, zero boolean"
    order = Window.partitionBy(query_id).orderBy(F.desc("top"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = _with_bounds(units.mapInPandas(cells_of, pair), index)
    first = first.withColumn("_held", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("_held") < k)
    first = stored(first.select(query_id, "cell", "block", "n"), "cosine-first")
    rank = Window.partitionBy(query_id).orderBy(F.desc("score"), index.item_id)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)

    found = stored(ranked(_scored(first, units, index, k, query_id, schema)).drop("rank"), "cosine-found")
    reach = found.groupBy(query_id).agg(F.when(F.count("*") >= k, F.min("score") - 1e-9).alias("floor"))
    asked = units.join(reach, query_id, "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    asked = stored(asked, "cosine-asked")
    # The first blocks are scored again with the others: their bounds reach the floor as well.
    best = ranked(_scored_in_spans(asked, index, k, query_id, schema))
    more = _with_bounds(asked.mapInPandas(cells_of, pair), index).join(asked.select(query_id, "floor"), query_id).filter("top >= floor")
    more = more.select(query_id, "cell", "block", "n").join(first, [query_id, "block"], "left_anti")
    tally = first.unionByName(more.select(first.columns)).groupBy(query_id).agg(F.sum("n").alias("scored"))
    return best, tally


def cosine_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_id: str = "query_id",
    item_id: str = "vec_id",
    vector: str = "embedding",
    few: int = FEW,
) -> DataFrame:
    """The ``k`` most similar items per query: ``(query_id, rank, item_id, score)``.

    Up to ``few`` queries go to every task, which scores its items in one pass and keeps its own ``k`` best;
    more are looked up in the items' cells. Scores are rounded to 9 digits, equal ones rank by item id.
    """
    rows = queries.select(query_id, vector).filter(F.col(vector).isNotNull()).limit(few + 1).collect()
    if len(rows) > few:
        return nearest_in_cells(queries, cosine_cells(items, item_id, vector), k, query_id, vector)[0]
    schema = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {item_id} " + (
        f"{items.schema[item_id].dataType.simpleString()}, score double"
    )
    given = items.select(item_id, vector).filter(F.col(vector).isNotNull())
    found = given.mapInPandas(_best_of(rows, k, query_id, item_id, vector), schema)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), item_id)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best_of(rows: list, k: int, query_id: str, item_id: str, vector: str):
    ids = [r[0] for r in rows]
    unit = unit_rows(np.array([r[1] for r in rows], dtype="float64")) if rows else None

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            if len(batch) and ids:
                kept = keep_best(kept, ids, batch[item_id].to_numpy(), _units(batch[vector]) @ unit.T, k, query_id, item_id)
        if kept is not None:
            yield kept

    return best
