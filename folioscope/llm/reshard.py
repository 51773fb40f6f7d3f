"""Minimum-cost-flow resharding: from old shards to new ones, moving the fewest bytes.

Rows lie in old shards; a block is the file of one size class (half an octave)
of an old shard.  New shards get capacities of rows at most one apart.  The
flow sends each block's rows to new shards: staying costs nothing, moving costs
the block's bytes per row.  A move costs the same whatever its target, so moved
rows pass one pool in the network.  Size classes do not overlap, so each shard
gives away its smallest blocks; of a block that is split the smallest rows
move.  The bytes moved are therefore the fewest that the capacities allow.

``rewrite`` writes the affected files only: the blocks that move, wholly or in
part.  All others stay where they are.  Rows carry their texts through the
placement and are not joined by id, so rows without id or of a repeated id are
placed and written like any other.

Only blocks' counts reach the driver (old shards times size classes, whatever
the corpus).  Positions are counted in parts of blocks, narrow in size; a size
that very many rows have is dealt out over more.

Edge cases: a null or empty text has size 16; repeated rows have a slot each;
a null id is a row like any other; a null old shard holds rows that all move;
an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, HOT_SHARE, Scratch

OLD_SHARDS = 32
NEW_SHARDS = 40
#: A size that more rows have (or a thousandth of all, if that is more) is dealt over several parts of a block.
PART_ROWS = 50_000
OVERHEAD = 16


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, float]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a greatest flow of least cost.

    Successive shortest paths with potentials; costs are not negative.
    """
    to, left, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, capacity, c in arcs:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        left += [capacity, 0]
        cost += [c, -c]
    potential = [0.0] * n
    while True:
        far, via = [float("inf")] * n, [-1] * n
        far[source] = 0.0
        heap = [(0.0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                if left[e]:
                    now = d + cost[e] + potential[a] - potential[to[e]]
                    if now < far[to[e]] - 1e-9:
                        far[to[e]], via[to[e]] = now, e
                        heapq.heappush(heap, (now, to[e]))
        if via[sink] < 0:
            return left[1::2]
        reach = far[sink]
        potential = [p + min(d, reach) for p, d in zip(potential, far)]
        amount, b = None, sink
        while b != source:
            amount = left[via[b]] if amount is None else min(amount, left[via[b]])
            b = to[via[b] ^ 1]
        b = sink
        while b != source:
            left[via[b]] -= amount
            left[via[b] ^ 1] += amount
            b = to[via[b] ^ 1]


def capacities(total: int, shards: int) -> list[int]:
    """Rows of each new shard, at most one apart."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def solve(blocks: list[tuple[int, int, int, int]], shards: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Block transfers that move the fewest bytes.

    ``blocks`` are (old shard, size class, rows, bytes).  For each block, from
    its smallest row on, (new shard, rows); rows that stay come last.  As a move
    costs the same whatever its target, moved rows pass one pool, which keeps
    the network small.
    """
    blocks = sorted(blocks)
    room = capacities(sum(b[2] for b in blocks), shards)
    pool, first = len(blocks), len(blocks) + 1
    source, sink = first + shards, first + shards + 1
    arcs: list[tuple[int, int, int, float]] = []
    stay, move = {}, {}
    for k, (old, _, rows, size) in enumerate(blocks):
        arcs.append((source, k, rows, 0.0))
        if 0 <= old < shards:
            stay[k] = len(arcs)
            arcs.append((k, first + old, rows, 0.0))
        move[k] = len(arcs)
        arcs.append((k, pool, rows, size / rows))
    into = []
    for j in range(shards):
        into.append(len(arcs))
        arcs.append((pool, first + j, room[j], 0.0))
        arcs.append((first + j, sink, room[j], 0.0))
    flow = min_cost_flow(sink + 1, arcs, source, sink)
    free = [[j, flow[e]] for j, e in enumerate(into) if flow[e]]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, (old, size_class, _, _) in enumerate(blocks):
        parts = []
        moved = flow[move[k]]
        while moved:
            j, n = free[-1]
            taken = min(n, moved)
            parts.append((j, taken))
            moved -= taken
            free[-1][1] -= taken
            if not free[-1][1]:
                free.pop()
        if k in stay and flow[stay[k]]:
            parts.append((old, flow[stay[k]]))
        out[old, size_class] = parts
    return out


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, and a fixed overhead for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def old_shard(id_col: str, shards: int = OLD_SHARDS) -> Column:
    """Where a row lies before: the layout that is resharded unless a column says otherwise."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(shards)).cast("int")


_OWN = ["_old", "_class", "_fine", "_rank", "_salt"]


def _keyed(rows: DataFrame, size_col: str, old_col: str) -> DataFrame:
    """rows with their block: the old shard and the size class."""
    fine = F.floor(128 * F.log2(F.greatest(F.col(size_col), F.lit(1)).cast("double"))).cast("int")
    return rows.withColumns({"_old": F.coalesce(F.col(old_col), F.lit(-1)).cast("int"), "_class": F.floor(fine / 64).cast("int"), "_fine": fine})


def _parted(keyed: DataFrame, size_col: str, hot: dict[int, int]) -> DataFrame:
    """keyed with its parts in the order of sizes; rows of a hot size are dealt over as many as are given."""
    rank, salt = F.lit(0), F.lit(0)
    for size, parts in sorted(hot.items()):
        here = F.col(size_col) == size
        rank = rank + F.when(F.col(size_col) > size, 2).when(here, 1).otherwise(0)
        salt = F.when(here, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(salt)
    return keyed.withColumns({"_rank": rank, "_salt": salt})


def _numbered(scratch: Scratch, parted: DataFrame, plan: list, size_col: str, id_col: str) -> DataFrame:
    """parted, a written table, with ``shard`` and ``slot`` by each row's position in its block."""
    counts = scratch.cut(parted.groupBy(*_OWN).agg(F.count(F.lit(1)).alias("_n")), "counts")
    plan_rows = parted.sparkSession.createDataFrame(plan, "_old int, _class int, _spans array<struct<a: long, b: long, shard: int, slot: long>>")
    before = "sum(_n) over (partition by _old, _class order by _fine, _rank, _salt rows between unbounded preceding and current row) - _n"
    starts = scratch.cut(counts.withColumn("_start", F.expr(before)).join(F.broadcast(plan_rows), ["_old", "_class"]).select(*_OWN, "_start", "_spans"), "starts")
    if starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    number = F.expr(f"row_number() over (partition by {', '.join(_OWN)} order by `{size_col}`, `{id_col}`)")
    placed = parted.withColumn("_row", number).join(starts, _OWN).withColumn("_at", F.col("_start") + F.col("_row") - 1)
    placed = placed.withColumn("_span", F.expr("filter(_spans, s -> s.a <= _at and _at < s.b)[0]"))
    return placed.withColumns({"shard": F.col("_span.shard"), "slot": F.col("_span.slot") + F.col("_at") - F.col("_span.a")}).drop(*_OWN, "_row", "_start", "_spans", "_at", "_span")


def _planned(scratch: Scratch, keyed: DataFrame, size_col: str, shards: int) -> tuple[list, dict[int, int]]:
    """Each block's spans of positions with shard and first slot, and the parts of hot sizes."""
    blocks = [tuple(r) for r in keyed.groupBy("_old", "_class").agg(F.count(F.lit(1)), F.sum(size_col)).collect()]
    n = sum(b[2] for b in blocks)
    most = max(PART_ROWS, n // HOT_SHARE)
    hot = {r[0]: -(-r[1] // most) for r in keyed.groupBy(size_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()}
    plan, filled = [], [0] * shards
    for (old, klass), targets in solve(blocks, shards).items():
        start, spans = 0, []
        for j, taken in targets:
            spans.append((start, start + taken, j, filled[j]))
            start += taken
            filled[j] += taken
        plan.append((old, klass, spans))
    return plan, hot


def assign(rows: DataFrame, id_col: str = "doc_id", size_col: str = "size", old_col: str = "old_shard", shards: int = NEW_SHARDS) -> DataFrame:
    """rows with ``shard`` and ``slot``, slots of a shard counting from 0 without gaps."""
    scratch = Scratch(rows.sparkSession, "reshard")
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = scratch.cut(_keyed(rows.select(*kept), size_col, old_col), "keyed")
    plan, hot = _planned(scratch, keyed, size_col, shards)
    parted = scratch.cut(_parted(keyed, size_col, hot), "parted") if hot else _parted(keyed, size_col, hot)
    return _numbered(scratch, parted, plan, size_col, id_col)


def rewrite(rows: DataFrame, path: str, payload: tuple[str, ...] = ("text",), id_col: str = "doc_id", size_col: str = "size", old_col: str = "old_shard", shards: int = NEW_SHARDS) -> tuple[DataFrame, DataFrame]:
    """Places the rows and writes the affected files below ``path``: (rows that stay in their files, rows read back from there).

    ``rows`` is read more than once, so it must give the same rows each time.
    Both have the columns of rows, ``shard`` and ``slot``; rows that stay come without the ``payload`` columns.
    """
    scratch = Scratch(rows.sparkSession, "reshard")
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = _keyed(rows.select(*kept), size_col, old_col)
    slim = scratch.cut(keyed.drop(*payload), "keyed")
    plan, hot = _planned(scratch, slim, size_col, shards)
    moves = [(old, klass) for old, klass, spans in plan if any(j != old for _, _, j, _ in spans)]
    affected = rows.sparkSession.createDataFrame(moves, "_old int, _class int")
    at = ["_old", "_class"]
    whole = scratch.cut(_parted(keyed.join(F.broadcast(affected), at, "left_semi"), size_col, hot), "affected")
    left = scratch.cut(_parted(slim.join(F.broadcast(affected), at, "left_anti"), size_col, hot), "staying")
    moved = _numbered(scratch, whole, plan, size_col, id_col)
    moved.repartition("shard", F.pmod(F.col("slot"), F.lit(8))).write.partitionBy("shard").parquet(path)
    schema = T.StructType([f for f in moved.schema if f.name != "shard"] + [T.StructField("shard", T.IntegerType())])
    written = rows.sparkSession.read.schema(schema).parquet(path).select(*kept, "shard", "slot")
    return _numbered(scratch, left, plan, size_col, id_col), written
