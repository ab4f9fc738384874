"""Prefix trie of conversations, with subtree totals by centroid decomposition of its parent edges.

A node is a sequence of turns that some conversation begins with. Every conversation has one node at each
depth, so a node is named by its smallest member and its depth, and the members' turns are the paths of the
trie: the ancestor of a node at some depth is found by one look-up in its smallest member's path.

A component is a connected part of the trie. Its centroid, the deepest node with at least half of the
component below it (itself included), is taken out; the total of that part is added to every node on the
path from the centroid to the component's top. What is left, the part above and one part for each child, are
components of at most half the size. Components of over ``MOST`` nodes are split so by joins, all in one
round, with as many rounds as halvings are needed; smaller ones are decomposed to the end in a task, many
together, as arrays. A path of any length and a node with any number of children take the same steps.

Positions and running digests are counted in ranges of the sorted turns, and what stands before a range is
added afterwards, so a conversation of any length is spread over tasks. Texts are not moved: turns travel as
digests and sizes. Member lists are joined to text in ranges and hashed as a stream.

Turns are in order of ``turn``, null first, then of their digest. A null role or text is empty. Rows with a
null conversation id are left out; repeated rows are turns of their own. An empty table has no trie, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdeck.llm.common import pieces_of, stored

#: Nodes of a component that is decomposed in one task.
MOST = 4_000
#: Member ids joined to one text.
IDS = 4_096
LANES = ["lane0", "lane1", "lane2", "lane3"]


def _running(group: int, sums: list[int]):
    """Adds to rows sorted by the column ``group`` their task, their number in the group and running sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, np.zeros(len(sums) + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(group).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            sizes = np.diff(np.append(change, len(groups)))
            first = np.where(np.arange(len(groups)) < sizes[0], groups[0] == last, False)
            columns = []
            for k, x in enumerate([np.ones(len(groups), np.int64), *(batch.column(i).to_numpy() for i in sums)]):
                total = np.cumsum(x)
                columns.append(total - np.repeat(total[change] - x[change], sizes) + first * carried[k])
            last, carried = groups[-1], np.array([c[-1] for c in columns])
            more = [pa.array(np.full(len(groups), part)), *map(pa.array, columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", *(f"r{k}" for k in range(len(more) - 1))])

    return run


def running(df: DataFrame, group: str, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """``df`` with ``at``, the number of a row in its group (from 1), and ``sums`` as running sums up to it."""
    added = ["r0", *(f"r{k + 1}" for k in range(len(sums)))]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "part long", *(f"{r} long" for r in added)])
    ordered = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    work = _running(df.columns.index(group), [df.columns.index(s) for s in sums])
    own = stored(ordered.mapInArrow(work, schema), name)
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(group, "part").agg(*(F.max(r).alias(r) for r in added))
    totals = totals.select(group, "part", *(F.sum(r).over(before).alias(f"b{r}") for r in added)).filter("br0 is not null")
    # Only the first group of a range can go on from one before: a row for each range at most.
    found = own.join(F.broadcast(totals), [group, "part"], "left")
    final = {r: F.col(r) + F.coalesce(F.col(f"b{r}"), F.lit(0)) for r in added}
    rest = [c for c in df.columns if c not in sums]
    return found.select(*rest, final["r0"].alias("at"), *(final[r].alias(s) for r, s in zip(added[1:], sums, strict=True)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, digest, n_bytes``: every turn's number in its conversation, digest and size of text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.substring(F.unhex(F.sha2(told, 256)), 1, 16).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    return running(turns.filter("conv_id is not null"), "conv_id", order, [], "trie-turns").drop("turn")


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: ``(conv_id, depth, digest, n_bytes)`` of the
    rebuilt turns, and ``(conv_id, length)`` of every conversation.

    ``c`` takes the first ``crc32(c) % heads`` turns from conversation ``c - c % family`` (all of them if it
    has fewer, none if there is no such one) in place of as many of its own."""
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    bases = sizes.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = sizes.select("conv_id", "size", taken.alias("taken"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    convs = convs.join(bases, "base", "left").withColumn("kept", F.least("taken", F.coalesce("base_size", F.lit(0))))
    convs = stored(convs.withColumn("length", F.col("kept") + F.greatest(F.col("size") - F.col("taken"), F.lit(0))), "trie-convs")
    starts = turns.filter((F.col("conv_id") % family == 0) & (F.col("at") < heads)).withColumnRenamed("conv_id", "base")
    head = convs.join(starts, "base").filter("at <= kept").select("conv_id", F.col("at").alias("depth"), "digest", "n_bytes")
    own = turns.filter(F.col("at") > taken).join(convs.select("conv_id", "kept"), "conv_id")
    own = own.select("conv_id", (F.col("at") - taken + F.col("kept")).alias("depth"), "digest", "n_bytes")
    return head.unionByName(own), convs.select("conv_id", "length")


def _lanes() -> list[Column]:
    """Four 32-bit parts of two hashes of a turn's digest at its depth; their sums stand for a prefix."""
    both = [F.xxhash64(F.lit(k), F.col("digest"), F.col("depth")) for k in (1, 2)]
    low = F.lit(0xFFFFFFFF).cast("long")
    parts = [x for h in both for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(low))]
    return [p.alias(n) for p, n in zip(parts, LANES, strict=True)]


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, key, above, n_bytes, length``: the digest of every prefix of every conversation and
    of the prefix one turn shorter; the empty prefix has depth 0."""
    own = [F.col(f"own{k}") for k in range(4)]
    given = turns.select("conv_id", "depth", "n_bytes", *_lanes())
    given = given.withColumns({f"own{k}": F.col(n) for k, n in enumerate(LANES)})
    summed = running(given, "conv_id", [F.col("depth")], LANES, "trie-prefixes")

    def key(parts: list[Column]) -> Column:
        low = F.lit(0xFFFFFFFF).cast("long")
        return F.unhex(F.concat(*(F.lpad(F.hex(p.bitwiseAND(low)), 8, "0") for p in parts)))

    sums = [F.col(n) for n in LANES]
    found = summed.select("conv_id", "depth", key(sums).alias("key"), key([s - o for s, o in zip(sums, own, strict=True)]).alias("above"), "n_bytes")
    root = key([F.lit(0).cast("long")] * 4)
    empty = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("n_bytes"))
    return found.withColumn("depth", F.col("depth").cast("long")).unionByName(empty).join(convs, "conv_id")


def member_digests(ends: DataFrame) -> DataFrame:
    """``node, depth, ends_sha256``: SHA-256 of the ``conv_id`` of each node in ascending order, comma-joined."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            change = (frame[["node", "depth"]] != frame[["node", "depth"]].shift()).any(axis=1).cumsum()
            block = frame.groupby([change, np.arange(len(frame)) // IDS], sort=False)
            first = block.first().reset_index(drop=True)
            first["ids"] = [",".join(map(str, x)) for _, x in block["conv_id"]]
            yield pa.RecordBatch.from_pandas(first[["node", "depth", "conv_id", "ids"]], preserve_index=False)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for node, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (node, depth) == now:
                    digest.update(b"," + ids.encode())
                else:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (node, depth), hashlib.sha256(ids.encode())
            yield _rows(done)
        if now:
            yield _rows([(*now, digest.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "depth", "ends_sha256"])

    order = ["node", "depth", "conv_id"]
    ranges = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ranges.mapInArrow(joined, "node long, depth long, conv_id long, ids string")
    blocks = blocks.repartition("node", "depth").sortWithinPartitions(*order)
    return blocks.mapInArrow(hashed, "node long, depth long, ends_sha256 string")


def forest_totals(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a row for each node) over every node's subtree, by centroid decomposition of all
    trees at once. ``parent`` is -1 and ``depth`` 0 at the top of a tree."""
    n = len(parent)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    size = np.ones(n, np.int64)
    for level in levels[:0:-1]:
        np.add.at(size, parent[level], size[level])
    # Numbers in depth-first order: a subtree is a stretch of them.
    pre, children = np.zeros(n, np.int64), np.lexsort((np.arange(n), parent))
    run = np.cumsum(size[children]) - size[children]
    starts = np.append(True, parent[children][1:] != parent[children][:-1])
    offset = np.empty(n, np.int64)
    offset[children] = run - np.maximum.accumulate(np.where(starts, run, 0))
    pre[levels[0]] = offset[levels[0]]
    for level in levels[1:]:
        pre[level] = pre[parent[level]] + 1 + offset[level]
    child_key = np.sort(parent * n + pre)
    by_pre = np.empty(n, np.int64)
    by_pre[pre] = np.arange(n)

    top = np.arange(n)
    for level in levels[1:]:
        top[level] = top[parent[level]]
    sums, now, alive = values.copy(), size.copy(), np.arange(n)
    while alive.size:
        own = top[alive]
        half = alive[2 * now[alive] >= now[own]]  # a path from each top; the deepest is the centroid
        centre = np.empty(n, np.int64)
        half = half[np.argsort(depth[half], kind="stable")]
        centre[top[half]] = half
        c = centre[own]
        below = (pre[c] <= pre[alive]) & (pre[alive] < pre[c] + size[c])
        total = np.zeros_like(values)
        np.add.at(total, own[below], values[alive[below]])
        path = (pre[alive] < pre[c]) & (pre[c] < pre[alive] + size[alive])
        sums[alive[path]] += total[own[path]]
        middle = np.unique(c)
        part = now[c[path]]
        now[alive[path]] -= part
        sums[middle] += total[top[middle]] - values[middle]
        under = below & (alive != c)
        v = alive[under]
        found = np.searchsorted(child_key, c[under] * n + pre[v], "right") - 1
        top[v] = by_pre[child_key[found] - c[under] * n]
        alive = alive[alive != c]
    return sums


def _totals_in_task(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.reset_index(drop=True)
    places = pd.Series(frame.index, index=pd.MultiIndex.from_frame(frame[["node", "depth"]]))
    is_top = (frame["node"] == frame["top"]) & (frame["depth"] == frame["top_depth"])
    parent = np.full(len(frame), -1, np.int64)
    inner = np.flatnonzero(~is_top)
    wanted = pd.MultiIndex.from_arrays([frame["parent"].to_numpy()[inner].astype(np.int64), frame["depth"].to_numpy()[inner] - 1])
    parent[inner] = places.reindex(wanted).to_numpy()
    sums = forest_totals(parent, (frame["depth"] - frame["top_depth"]).to_numpy(), frame[["value0", "value1"]].to_numpy(np.int64))
    return pd.DataFrame({"node": frame["node"], "depth": frame["depth"], "sum0": sums[:, 0], "sum1": sums[:, 1]})


def _subtree_sizes(paths: DataFrame) -> DataFrame:
    """``node, depth, size``: nodes of each subtree. A node is counted at its smallest member alone: from
    some depth on, all nodes of a conversation have it as their smallest."""
    own = paths.filter("node = conv_id").groupBy("conv_id").agg(F.min("depth").alias("from"))
    below = F.col("length") - F.greatest("from", "depth") + 1
    return paths.join(own, "conv_id").groupBy("node", "depth").agg(F.sum(below).alias("size"))


def subtree_totals(nodes: DataFrame, paths: DataFrame, most: int = MOST) -> DataFrame:
    """``node, depth, sum0, sum1``: ``value0`` and ``value1`` of ``nodes (node, depth, parent, value0,
    value1)`` summed over every subtree. ``paths`` has ``conv_id, depth, node, length``: each conversation's nodes."""
    n = nodes.count()
    if n == 0:
        return nodes.select("node", "depth", F.col("value0").alias("sum0"), F.col("value1").alias("sum1"))
    root = nodes.filter("parent is null").select("node").first()[0]
    rows = nodes.select("node", "depth", "parent", "value0", "value1").withColumns({"top": F.lit(root), "top_depth": F.lit(0).cast("long")})
    small, told = [], []
    if n > most:
        sizes = _subtree_sizes(paths)
        rows = stored(rows.join(sizes, ["node", "depth"]), "trie-open")
        steps = paths.select("conv_id", "depth", "node").join(
            paths.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("node").alias("next")), ["conv_id", "depth"], "left"
        )
        steps = stored(steps, "trie-steps")
        while True:
            done, rows, adds = _split(rows, steps, most)
            small.append(done.drop("size"))
            if rows is None:
                break
            told.append(adds)
    else:
        small.append(rows)
    pieces = pieces_of(n, most)
    left = reduce(DataFrame.unionByName, small).withColumn("_task", F.pmod(F.xxhash64("top", "top_depth"), F.lit(pieces)))
    inner = left.groupBy("_task").applyInPandas(_totals_in_task, "node long, depth long, sum0 long, sum1 long")
    if not told:
        return inner
    return reduce(DataFrame.unionByName, [inner, *told]).groupBy("node", "depth").agg(F.sum("sum0").alias("sum0"), F.sum("sum1").alias("sum1"))


def _split(rows: DataFrame, steps: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """One round: rows of components of at most ``most`` nodes; the rows of what is left of the others
    without their centroids; and the totals that go to centroids and the nodes on their paths to the top."""
    of = ["top", "top_depth"]
    # Each of these components has over ``most`` nodes, so there is less than one for ``most`` nodes of the
    # trie, and the tables of their sizes, centroids and totals that are broadcast are bounded by that.
    large = stored(rows.groupBy(*of).agg(F.max("size").alias("total")).filter(F.col("total") > most), "trie-large")
    done = rows.join(F.broadcast(large), of, "left_anti")
    if large.limit(1).count() == 0:
        return done, None, None
    halves = rows.join(F.broadcast(large), of).filter(2 * F.col("size") >= F.col("total"))
    centres = halves.groupBy(*of).agg(F.min_by(F.struct("node", "depth", "size"), "size").alias("c"))
    centres = stored(centres.select(*of, F.col("c.node").alias("centre"), F.col("c.depth").alias("centre_depth"), F.col("c.size").alias("centre_size")), "trie-centres")
    split = rows.join(F.broadcast(centres), of)
    # Below: the row's path has the centroid at its depth, and the child to which the row now belongs next.
    passed = steps.select(F.col("conv_id").alias("node"), F.col("depth").alias("centre_depth"), F.col("node").alias("there"), "next")
    split = split.join(passed, ["node", "centre_depth"], "left")
    # Above: the row is on the path of the centroid.
    path = F.broadcast(centres).join(steps.select("conv_id", "depth", F.col("node").alias("above")), F.col("centre") == F.col("conv_id"))
    path = path.filter("depth < centre_depth and depth >= top_depth").select(F.col("above").alias("node"), "depth", F.lit(True).alias("on_path"))
    split = split.join(path, ["node", "depth"], "left")
    is_centre = (F.col("node") == F.col("centre")) & (F.col("depth") == F.col("centre_depth"))
    below = (F.col("depth") > F.col("centre_depth")) & F.col("there").eqNullSafe(F.col("centre"))
    split = split.withColumn("where", F.when(is_centre, "centre").when(below, "below").when(F.col("on_path"), "path").otherwise("other"))
    split = stored(split, "trie-split")
    totals = split.filter("where in ('centre', 'below')").groupBy(*of).agg(F.sum("value0").alias("sum0"), F.sum("value1").alias("sum1"))
    adds = split.filter("where in ('centre', 'path')").select("node", "depth", *of).join(F.broadcast(totals), of)
    under = F.col("where") == "below"
    rest = split.filter("where <> 'centre'").select(
        "node", "depth", "parent", "value0", "value1",
        F.when(under, F.col("next")).otherwise(F.col("top")).alias("top"),
        F.when(under, F.col("centre_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        (F.col("size") - F.when(F.col("where") == "path", F.col("centre_size")).otherwise(0)).alias("size"),
    )
    return done, rest, stored(adds.select("node", "depth", "sum0", "sum1"), "trie-adds")


def prefix_trie(turns: DataFrame, convs: DataFrame, most: int = MOST) -> DataFrame:
    """A row for each node of the trie of ``turns (conv_id, depth, digest, n_bytes)`` and ``convs (conv_id,
    length)``: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    found = stored(prefixes(turns, convs), "trie-paths")
    keyed = found.groupBy("depth", "key").agg(
        F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.min("above").alias("above"), F.max("n_bytes").alias("n_bytes")
    )
    keyed = stored(keyed, "trie-nodes")
    above = keyed.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("above"), F.col("node").alias("parent"))
    children = keyed.filter("above is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = keyed.join(children, ["depth", "key"], "left").join(above, ["depth", "above"], "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumns({"value0": (F.col("n_children") == 0).cast("long"), "value1": (F.col("n_convs") - 1) * F.col("n_bytes")})
    nodes = stored(nodes.drop("above", "n_bytes"), "trie-linked")
    paths = stored(found.join(keyed.select("depth", "key", "node"), ["depth", "key"]).select("conv_id", "depth", "node", "length"), "trie-members")
    totals = subtree_totals(nodes, paths, most).withColumnsRenamed({"sum0": "n_leaves", "sum1": "saved_tokens"})
    ends = member_digests(paths.filter("depth = length"))
    nodes = nodes.select("node", "depth", "parent", "n_convs", "n_children").join(totals, ["node", "depth"]).join(ends, ["node", "depth"], "left")
    return nodes.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
