"""Exact top-k search (13): the k highest integer inner products of every query, by distributed histogram selection.

Components become floor(256 * x). Vectors are packed into tiles, rows of up to some thousand vectors, written once.
Every pass scores everything: a candidate tile meets each tile of queries, in groups that one task streams. Per query
a pass counts the scores in the query's interval in BINS bins of equal width, tasks emit the bins from the
top down to their own kth score (a kth score of all rows can't lie below), sums over tasks say in which bin the kth score of all
rows lies, and that bin is the next interval, until bins hold one score. The last pass keeps what reaches the kth
score; of these each task keeps its k best by score, then smaller id, and so does the ranking of all that is left.

Scale: n queries against m rows cost n * m products; what is shuffled a pass is the tiles, each candidate tile once a tile of QUERIES queries and each
query tile once a group of candidate tiles. A task holds one query tile with its histograms (QUERIES * BINS counts) and one candidate tile.
Passes: the logarithm of the range of scores to the base BINS. Nothing goes through the driver but whether intervals are left.

Defined results: vectors that are null or hold null or non-finite components (or such whose 256-fold is) take no part; vectors of different lengths aren't
scored, and those without components score 0. The query's own row is left out, another row of its id isn't;
each row of a repeated id is a candidate, and a query. Rows with a null id are candidates, after others of their score. A query with fewer
candidates has them all. Scores beyond 64 bits stay at the ends of a long. Other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.shared import Scratch
from caselight.session import ship_package

SCALE = 256
#: Queries in a tile, components in a candidate tile, candidates in a group, and bins of a histogram.
QUERIES = 2048
TILE_VALUES = 1 << 19
GROUP = 16_384
BINS = 1024
#: Scores held at once.
SCORES = 1 << 21
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

_TILES = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("size", pa.int64()), ("ids", pa.binary()), ("named", pa.binary()), ("x", pa.binary()), ("wide", pa.bool_()), ("peak", pa.float64()), ("query", pa.bool_())])
_TILES_DDL = "tile long, dim int, size long, ids binary, named binary, x binary, wide boolean, peak double, query boolean"


def _tiles(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column) -> DataFrame:
    """Rows of tiles: ids, which are named, quantised components; a query's row is in a query tile also, under the same number and place."""

    def pack(first: int, ids: np.ndarray, named: np.ndarray, x: np.ndarray, query: bool, places: np.ndarray) -> list:
        wide = bool(len(x)) and bool(x.size) and float(np.abs(x).max()) >= 1 << 31
        ints = x.astype("<f8") if wide else x.astype("<i4")
        peak = float(np.abs(x).max()) if x.size else 0.0
        numbers = np.stack([first + places, ids], 1).astype("<i8")
        return [first, x.shape[1], len(ids), numbers.tobytes(), named.tobytes(), ints.tobytes(), wide, peak, query]

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, column, query = batch.column(0), batch.column(1), batch.column(2)
            named = np.array(ids.is_valid().to_numpy(zero_copy_only=False), np.uint8)
            ids = ids.fill_null(0).to_numpy()
            query = query.fill_null(False).to_numpy(zero_copy_only=False)
            dims = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
            # Lists of one length, whole and finite, become one matrix.
            for dim in np.unique(dims[dims >= 0]).tolist():
                at = np.flatnonzero(dims == dim)
                flat = column.take(pa.array(at)).flatten()
                x = np.floor(SCALE * flat.fill_null(float("nan")).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), dim))
                good = np.isfinite(x).all(1)
                x, at = x[good], at[good]
                step = max(1, min(QUERIES, TILE_VALUES // max(dim, 1)))
                out = []
                for i in range(0, len(at), step):
                    rows = at[i : i + step]
                    out.append(pack(first, ids[rows], named[rows], x[i : i + step], False, np.arange(len(rows))))
                    if (q := np.flatnonzero(query[rows])).size:
                        out.append(pack(first, ids[rows[q]], named[rows[q]], x[i + q], True, q))
                    first += 1 << 20
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TILES, strict=True)], schema=_TILES)

    ship_package(vectors.sparkSession)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).mapInArrow(run, _TILES_DDL)


def _gathered(queries: DataFrame) -> DataFrame:
    """Query tiles put together, up to QUERIES queries of one length a row; they were cut by where their rows lay."""

    def run(batches):
        held: dict[int, list] = {}

        def out(rows: list) -> pa.RecordBatch:
            wide = any(r["wide"] for r in rows)
            x = b"".join(r["x"] if r["wide"] == wide else np.frombuffer(r["x"], "<i4").astype("<f8").tobytes() for r in rows)
            values = [rows[0]["tile"], rows[0]["dim"], sum(r["size"] for r in rows), b"".join(r["ids"] for r in rows), b"".join(r["named"] for r in rows), x, wide, max(r["peak"] for r in rows), True]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _TILES, strict=True)], schema=_TILES)

        for batch in batches:
            for r in batch.to_pylist():
                rows = held.setdefault(r["dim"], [])
                if rows and sum(x["size"] for x in rows) + r["size"] > QUERIES:
                    yield out(rows)
                    rows.clear()
                rows.append(r)
        for rows in held.values():
            if rows:
                yield out(rows)

    return queries.mapInArrow(run, _TILES_DDL)


class _Tile:
    """A tile as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda c: batch.column(c)[i].as_py()
        self.n, dim = get("size"), get("dim")
        numbers = np.frombuffer(get("ids"), "<i8").reshape(self.n, 2)
        self.rows, self.ids = numbers[:, 0], numbers[:, 1]
        self.named = np.frombuffer(get("named"), np.uint8).astype(bool)
        self.x = np.frombuffer(get("x"), "<f8" if get("wide") else "<i4").reshape(self.n, dim).astype(np.float64)
        self.peak = get("peak")


def _scores(q: _Tile, x: np.ndarray, peak: float) -> np.ndarray:
    """Exact inner products: in doubles where every sum fits their 53 bits, else in whole numbers of any size, held to 64 bits."""
    if q.peak * peak * max(x.shape[1], 1) < 2.0**53:
        return (q.x @ x.T).astype(np.int64)
    a, b = ([[int(v) for v in row] for row in m.tolist()] for m in (q.x, x))
    return np.array([[min(max(sum(map(int.__mul__, u, v)), _LOW), _HIGH) for v in b] for u in a], np.int64).reshape(len(a), len(b))


def _met(tiles: DataFrame, queries: DataFrame, groups: int) -> Callable[[DataFrame], DataFrame]:
    """For the states of the queries (dim, q, state), the rows of both kinds of tiles by (dim, query tile, group), query tiles first."""
    columns = ["size", "ids", "named", "x", "wide", "peak"]
    numbers = F.broadcast(queries.select("dim", F.col("tile").alias("q")))  # 12 bytes for QUERIES queries
    right = tiles.where("not query").select("*", F.pmod(F.xxhash64("tile"), F.lit(groups).cast("long")).alias("g")).join(numbers, "dim").select("dim", "q", "g", F.lit(1).alias("kind"), *columns, F.lit(None).cast("binary").alias("state"))

    def of(states: DataFrame) -> DataFrame:
        left = queries.withColumnRenamed("tile", "q").join(states, ["dim", "q"]).select("dim", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(0).alias("kind"), *columns, "state")
        return left.unionByName(right).repartition("dim", "q", "g").sortWithinPartitions("dim", "q", "g", "kind")

    return of


def _streamed(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Calls work(query tile, its state, number) at each new key and its result with each candidate tile (in parts of SCORES scores), then without one."""
    key, take = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column("kind")[i].as_py() == 0:
                if take:
                    yield from take(None, None, None)
                key = batch.column("q")[i].as_py()
                q = _Tile(batch, i)
                take = work(q, np.frombuffer(batch.column("state")[i].as_py(), "<i8").reshape(q.n, -1), key, batch.column("dim")[i].as_py())
            else:
                c = _Tile(batch, i)
                step = max(1, SCORES // max(q.n, 1))
                for j in range(0, c.n, step):
                    part = slice(j, j + step)
                    s = _scores(q, c.x[part], c.peak)
                    yield from take(s, q.rows[:, None] != c.rows[None, part], (c.ids[part], c.named[part]))
    if take:
        yield from take(None, None, None)


def _histograms(met: DataFrame) -> DataFrame:
    """dim, q, place, bin (0 holds the highest scores), n: of each query tile's queries, the bins down to a task's own kth score of the interval."""
    schema = pa.schema([("dim", pa.int32()), ("q", pa.int64()), ("place", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches):
        def work(q: _Tile, state: np.ndarray, number: int, dim: int):
            high, width, need = state[:, 0, None], state[:, 1, None], state[:, 2]
            wide = np.maximum(width, 1).astype(np.uint64)
            count = np.zeros((q.n, BINS), np.int64)
            base = np.arange(q.n)[:, None] * BINS

            def take(s, other, _):
                if s is not None:
                    # Distances from the top as unsigned numbers: the whole range of a long fits.
                    far = (high.view(np.uint64) - s.view(np.uint64)) // wide
                    inside = other & (s <= high) & (far < BINS) & (width > 0)
                    count.ravel()[:] += np.bincount((far.astype(np.int64) + base)[inside], minlength=count.size)
                    return
                seen = np.cumsum(count, 1)
                sent = (count > 0) & (seen - count < need[:, None])
                place, at = np.nonzero(sent)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), dim, np.int32)), pa.array(np.full(len(place), number)), pa.array(place.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(count[sent])], schema=schema)

            return take

        yield from _streamed(batches, work)

    return met.mapInArrow(run, "dim int, q long, place int, bin int, n long").groupBy("dim", "q", "place", "bin").agg(F.sum("n").alias("n"))


def _best(met: DataFrame, k: int) -> DataFrame:
    """row, query_id, vec_id, score: in each task the k best of each query that reach its kth score."""
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        def work(q: _Tile, state: np.ndarray, number: int, dim: int):
            least = state[:, 0, None]
            held: list[tuple[np.ndarray, ...]] = []

            def take(s, other, c):
                if s is not None:
                    at, j = np.nonzero(other & (s >= least))
                    held.append((at, s[at, j], c[0][j], c[1][j]))
                    at, s, ids, named = map(np.concatenate, zip(*held, strict=True))
                    # Scores descending: ~s reverses longs without overflow.
                    order = np.lexsort((ids, ~named, ~s, at))
                    at = at[order]
                    rank = np.arange(len(at)) - np.searchsorted(at, at)
                    order = order[rank < k]
                    held[:] = [(at[rank < k], s[order], ids[order], named[order])]
                    return
                if held:
                    at, s, ids, named = held[0]
                    yield pa.RecordBatch.from_arrays([pa.array(q.rows[at]), pa.array(q.ids[at]), pa.array(ids, mask=~named), pa.array(s)], schema=schema)

            return take

        yield from _streamed(batches, work)

    return met.mapInArrow(run, "row long, query_id long, vec_id long, score long")


def _states(table: DataFrame, *columns: str) -> DataFrame:
    """dim, q, state: the columns of each query tile's queries, by place, as longs; at most QUERIES rows a tile."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        raw = np.stack([t.column(c).to_numpy() for c in columns], 1).astype("<i8").tobytes()
        return pa.table({"dim": t.column("dim")[:1], "q": t.column("q")[:1], "state": pa.array([raw], pa.binary())})

    return table.select("dim", "q", "place", *columns).groupBy("dim", "q").applyInArrow(pack, "dim int, q long, state binary")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of each query, ties to the smaller id."""
    with Scratch(vectors.sparkSession) as scratch:
        tiles = scratch.write(_tiles(vectors, id_col, vector_col, is_query))
        size = tiles.groupBy("query").agg(F.sum("size")).collect()
        rows, asked = (next((n for query, n in size if query is kind), 0) for kind in (False, True))
        queries = scratch.write(_gathered(tiles.where("query").repartition(-(-asked // QUERIES) or 1)))
        met = _met(tiles, queries, -(-rows // GROUP) or 1)
        live = scratch.write(_first_intervals(tiles, queries, k))
        while live.where("width > 0").limit(1).count():
            live, old = scratch.write(_narrowed(live, _histograms(met(_states(live, "high", "width", "need"))))), live
            scratch.drop(old)
        order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        best = _best(met(_states(live, "high")), k).withColumn("rank", F.row_number().over(order))
        out = scratch.write(best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        scratch.keep_only(out)
        return out


def _first_intervals(tiles: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """dim, q, place, high, width, need: an interval of BINS bins that holds every score of the query; its kth score is the need-th in it."""
    peaks = tiles.where("not query").groupBy("dim").agg(F.max("peak").alias("most"))
    reach = F.col("peak") * F.col("most") * F.col("dim") * 1.001 + 1
    far = reach >= float(1 << 62)
    high, low = F.when(far, F.lit(_HIGH)).otherwise(reach.cast("long")), F.when(far, F.lit(_LOW)).otherwise(-reach.cast("long"))
    ends = queries.join(peaks, "dim").select("dim", F.col("tile").alias("q"), "size", high.alias("high"), low.alias("low"))
    width = F.ceil((F.col("high").cast("decimal(20,0)") - F.col("low") + 1) / BINS).cast("long")
    return ends.select("dim", "q", F.explode(F.sequence(F.lit(0), F.col("size").cast("int") - 1)).alias("place"), "high", width.alias("width"), F.lit(k).cast("long").alias("need"))


def _narrowed(live: DataFrame, counts: DataFrame) -> DataFrame:
    """The intervals after a pass: the bin with the kth score; width 0 once high is that score, or the lowest of all where there is no kth."""
    place = ["dim", "q", "place"]
    seen = F.sum("n").over(Window.partitionBy(*place).orderBy("bin"))
    cut = counts.withColumn("seen", seen).join(live, place).where("seen >= need and seen - n < need").select(*place, "bin", (F.col("seen") - F.col("n")).alias("before"))
    top = (F.col("high").cast("decimal(20,0)") - F.col("bin").cast("decimal(20,0)") * F.col("width")).cast("long")
    high = F.when(F.col("width") == 0, F.col("high")).when(F.col("bin").isNotNull(), top).otherwise(F.lit(_LOW))
    width = F.when(F.col("bin").isNotNull() & (F.col("width") > 1), F.ceil(F.col("width") / BINS)).otherwise(F.lit(0)).cast("long")
    return live.join(cut, place, "left").select(*place, high.alias("high"), width.alias("width"), (F.col("need") - F.coalesce("before", F.lit(0))).alias("need"))
