"""Approximate nearest neighbours by multiprobe p-stable hashing.

The largest inner product becomes the smallest distance by one more component that makes all rows equally long. A table hashes a
row by the cells of a few random projections. A query visits its own cell and perturbed ones, in the order of their
estimated success: the less far the borders that a perturbation crosses, the earlier; the order is laid out once for all queries by
the expected distances of sorted borders and mapped to each query by its own. Candidates of all tables are merged and ranked by
the exact inner product in double precision.

1. A few queries are answered by brute force over all rows. For several widths of a cell the probes are counted after which these queries'
   neighbours are met as often as wanted; the width whose probes read the fewest rows of a sample is taken. Cells grow until that many are met: in cells
   as wide as all projections every row is one perturbation away.
2. Rows, once for each table, are range-sorted by group (the cells of the first projections), cell and id, so that parts are even however many rows a
   cell has, and each part is written as a file of arrays.
3. A query goes to the files of those groups that its probes touch, by an equi-join on the group, and there looks its cells up. A task takes a few
   queries through FILES files that lie side by side and keeps their best rows, so that results are not as many as files.
4. Queries that met fewer rows than they ask for, as in small or sparse tables, go through tables with cells so wide that they meet every row.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import load_arrays, save_arrays
from .common import fresh_dir, leaving_nothing, stored
from .vectors import matrix, usable, with_size

#: Rows of a file; files that a task looks through, and queries that it answers on them.
ROWS, FILES, QUERIES = 8192, 64, 128
TABLES, PROJECTIONS = 4, 8
#: Widths of a cell, in standard deviations of a projection, that are tried together; wider ones follow if none suffices.
WIDTHS = (1.2, 1.6, 2.0, 2.6)
#: Queries that are audited, rows by which the share that is read is estimated, and the share of the audited queries' neighbours that must be met.
AUDITED, SAMPLE, WANTED = 64, 2048, 0.94
#: Cells this wide hold all projections of unit vectors, in doubles, within one perturbation.
WIDEST = 24.0


def probe_order(k: int) -> np.ndarray:
    """Sets of perturbations in the order of their expected score, as rows of 0 and 1 over 2k borders sorted by distance.

    Of the borders' distances, in units of a cell, the j-th smallest has the expected square j(j+1) / 4(k+1)(k+2) for j <= k, and by symmetry
    for the others; border j and border 2k+1-j belong to one projection and never go together.
    """
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    back = k + 1 - j  # of borders k+1 to 2k
    far = 1 - back / (k + 1) + back * (back + 1) / (4 * (k + 1) * (k + 2))
    expected = np.concatenate([near, far])
    choice = np.array(list(itertools.product((0, 1, 2), repeat=k)), np.int8)
    sets = np.hstack([choice == 1, (choice == 2)[:, ::-1]]).astype(np.int8)
    return sets[np.argsort(sets @ expected, kind="stable")]


@dataclass(frozen=True)
class Hashing:
    """Tables for vectors of one length. scale: the largest norm. probes: sets of perturbations that a query visits; coarse: projections that name a group."""

    dims: int
    scale: float
    width: float = 1.0
    probes: int = 1
    coarse: int = 1
    tables: int = TABLES
    k: int = PROJECTIONS
    seed: int = 11

    def lines(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Projections and shifts of a table, and odd factors that make one number of a cell."""
        rng = np.random.default_rng((self.seed, self.dims, t))
        return rng.normal(size=(self.dims + 1, self.k)), rng.uniform(0, 1, self.k), rng.integers(1, 2**62, self.k) * 2 + 1

    def rows(self, x: np.ndarray, t: int) -> np.ndarray:
        """The cells of rows, by projection."""
        lines, shift, _ = self.lines(t)
        x = x / self.scale
        rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))
        return np.floor((x @ lines[:-1] + rest[:, None] * lines[-1]) / self.width + shift).astype(np.int64)

    def queries(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells of queries, by projection, and each one's borders by distance: twice the projection, plus 1 for the upper one."""
        lines, shift, _ = self.lines(t)
        place = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ lines[:-1] / self.width + shift
        cell = np.floor(place)
        inside = place - cell
        border = np.argsort(np.hstack([inside, 1 - inside]), axis=1, kind="stable")
        return cell.astype(np.int64), border % self.k * 2 + border // self.k

    def moves(self, border: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """What each set of perturbations adds to each coordinate of a query's cell: query, set, projection."""
        place = np.argsort(border, axis=1)  # of each border in the query's order
        return sets.T[place[:, 1::2]].transpose(0, 2, 1) - sets.T[place[:, 0::2]].transpose(0, 2, 1)

    def group(self, cells: np.ndarray, t: int) -> np.ndarray:
        return cells[..., : self.coarse] @ self.lines(t)[2][: self.coarse]

    def key(self, cells: np.ndarray, t: int) -> np.ndarray:
        return cells @ self.lines(t)[2]


def probes_needed(h: Hashing, queries: np.ndarray, rows: list[np.ndarray], sets: np.ndarray) -> list[np.ndarray]:
    """For each query the number of probes after which each of its rows is met in some table; one more than there are sets if never."""
    never, out = len(sets) + 1, [np.full(len(r), len(sets) + 1) for r in rows]
    for t in range(h.tables):
        cell, border = h.queries(queries, t)
        factor = h.lines(t)[2]
        for q, r in enumerate(rows):
            keys = h.key(cell[q], t) + h.moves(border[q : q + 1], sets)[0].astype(np.int64) @ factor
            order = np.argsort(keys, kind="stable")
            mine = h.key(h.rows(r, t), t)
            at = order[np.minimum(np.searchsorted(keys[order], mine), len(keys) - 1)]
            out[q] = np.minimum(out[q], np.where(keys[at] == mine, at + 1, never))
    return out


def fitted(h: Hashing, queries: np.ndarray, neighbours: list[np.ndarray], some: np.ndarray) -> tuple[Hashing, dict]:
    """h with the width and probes that meet WANTED of the neighbours and read least, and what that is expected to find and to read."""
    sets = probe_order(h.k)
    widths, best = WIDTHS, None
    while best is None:
        for width in widths:
            tried = replace(h, width=width)
            need = np.sort(np.concatenate([np.zeros(0, int), *probes_needed(tried, queries, neighbours, sets)]))
            probes = int(need[int(np.ceil(WANTED * len(need))) - 1]) if len(need) else 1
            if probes <= len(sets):
                read = float(np.mean([(n <= probes).mean() for n in probes_needed(tried, queries[:16], [some] * len(queries[:16]), sets[:probes])])) if len(queries) and len(some) else 0.0
                if best is None or read < best[1]["read"]:
                    best = replace(tried, probes=probes), {"width": width, "probes": probes, "recall": float((need <= probes).mean()) if len(need) else 1.0, "read": read}
        widths = tuple(w * 2 for w in widths[-1:])
    return best


def _best(ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` largest scores above minus infinity, ties to the smaller id."""
    k = np.flatnonzero(score > -np.inf)
    if len(k) > top:
        k = k[score[k] >= np.partition(score[k], len(k) - top)[len(k) - top]]
    return k[np.lexsort((ids[k], -score[k]))[:top]]


def _best_ids(ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Like _best, of ids that stand more than once the best place only."""
    most = 2 * top
    while True:
        k = _best(ids, score, most)
        first = np.sort(np.unique(ids[k], return_index=True)[1])
        if len(first) >= top or len(k) < most:
            return k[first[:top]]
        most *= 4


def _found(found: list[tuple[int, np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
    ids = np.repeat(np.array([q for q, _, _ in found], np.int64), [len(r) for _, r, _ in found])
    return {"query_id": pa.array(ids), "vec_id": pa.array(np.concatenate([np.zeros(0, np.int64), *(r for _, r, _ in found)])), "score": pa.array(np.concatenate([np.zeros(0), *(s for _, _, s in found)]))}


def neighbours_of(good: DataFrame, ids: np.ndarray, queries: np.ndarray, top: int) -> list[np.ndarray]:
    """The vectors of the `top` rows of largest inner product of each of a few queries, by one pass over all rows; each task gives `top` rows a query at most."""

    def task(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros((0, queries.shape[1])))] * len(queries)
        for batch in batches:
            row_ids, v = batch.column(0).to_numpy(), matrix(batch.column(1))
            scores = queries @ v.T
            for q, s in enumerate(scores):
                s[row_ids == ids[q]] = -np.inf
                k = _best_ids(row_ids, s, top)
                of, x = np.concatenate([held[q][0], row_ids[k]]), np.concatenate([held[q][1], v[k]])
                k = _best_ids(of, x @ queries[q], top)
                held[q] = of[k], x[k]
        for q, (of, x) in enumerate(held):
            if len(of):
                yield pa.RecordBatch.from_pydict({"q": pa.array([q] * len(of), pa.int32()), "vec_id": pa.array(of), "score": pa.array(x @ queries[q]), "v": pa.array(list(x), pa.list_(pa.float64()))})

    each = good.select("vec_id", "v").mapInArrow(task, "q int, vec_id long, score double, v array<double>")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    once = each.groupBy("q", "vec_id").agg(F.max(F.struct("score", "v")).alias("best")).select("q", "vec_id", "best.*")
    rows = once.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).select("q", "v").collect()
    return [np.array([r["v"] for r in rows if r["q"] == q]).reshape(-1, queries.shape[1]) for q in range(len(queries))]


def write_tables(good: DataFrame, h: Hashing, n: int, folder: str) -> DataFrame:
    """Writes all rows, once for each table, as files below folder; gives t, grp, file, stretch (of FILES parts side by side) of each group that a file has rows of."""

    def deal(batches):
        for batch in batches:
            v = matrix(batch.column(1))
            for t in range(h.tables if len(v) else 0):
                cells = h.rows(v, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(h.group(cells, t)), pa.array(h.key(cells, t)), batch.column(0), batch.column(1)], ["t", "grp", "key", "vec_id", "v"])

    def write(batches):
        number, held, size = 0, [], 0

        def flush():
            nonlocal number, held, size
            t, grp, key, ids = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4))
            v = np.concatenate([matrix(b.column(4)) for b in held])
            name = f"rows-{TaskContext.get().partitionId():06d}-{number:04d}"
            slim = v.astype(np.float32)
            save_arrays(folder, name, {"t": t, "grp": grp, "key": key, "ids": ids, "v": slim if (slim == v).all() else v})
            groups = sorted(set(zip(t.tolist(), grp.tolist(), strict=True)))
            number, held, size = number + 1, [], 0
            stretch = [TaskContext.get().partitionId() // FILES] * len(groups)
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in groups], pa.int32()), pa.array([g[1] for g in groups], pa.int64()), pa.array([name] * len(groups)), pa.array(stretch, pa.int32())], ["t", "grp", "file", "stretch"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(batch.slice(at, ROWS))
                size += held[-1].num_rows
                if size >= ROWS:
                    yield flush()
        if held and size:
            yield flush()

    dealt = good.select("vec_id", "v").mapInArrow(deal, "t int, grp long, key long, vec_id long, v array<double>")
    parts = max(1, -(-n * h.tables // ROWS))
    spread = F.xxhash64("vec_id")
    return dealt.repartitionByRange(parts, "t", "grp", "key", spread).sortWithinPartitions("t", "grp", "key", "vec_id").mapInArrow(leaving_nothing(write), "t int, grp long, file string, stretch int")


def _visits(asked: DataFrame, h: Hashing) -> DataFrame:
    """t, grp, vec_id, v: each group that a query's probes touch."""

    def task(batches):
        sets = probe_order(h.k)[: h.probes]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v = matrix(part.column(1))
                for t in range(h.tables):
                    cell, border = h.queries(v, t)
                    moved = h.moves(border, sets)[..., : h.coarse].astype(np.int64)
                    groups = moved @ h.lines(t)[2][: h.coarse] + h.group(cell, t)[:, None]
                    each = [np.unique(g) for g in groups]
                    of = np.repeat(np.arange(len(v)), [len(g) for g in each])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), t, np.int32)), pa.array(np.concatenate(each)), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of))], ["t", "grp", "vec_id", "v"])

    return asked.select("vec_id", "v").mapInArrow(task, "t int, grp long, vec_id long, v array<double>")


def search_file(file: dict[str, np.ndarray], h: Hashing, sets: np.ndarray, asked: dict[int, np.ndarray], ids: np.ndarray, queries: np.ndarray, top: int) -> tuple[list, int]:
    """[(query id, row ids, scores)] of the rows of a file that queries meet, and how many they are. asked: numbers of the queries of each table."""
    met = np.zeros((len(queries), len(file["ids"])), bool)
    for t, which in asked.items():
        mine = np.flatnonzero(file["t"] == t)
        keys, of = np.unique(file["key"][mine], return_inverse=True)
        groups = np.unique(file["grp"][mine])
        factor = h.lines(t)[2]
        for at in range(0, len(which), 64):
            few = which[at : at + 64]
            cell, border = h.queries(queries[few], t)
            moves = h.moves(border, sets).astype(np.int64)
            # Only probes that lead to the file's groups are looked up.
            q, p = np.nonzero(np.isin(moves[..., : h.coarse] @ factor[: h.coarse] + h.group(cell, t)[:, None], groups))
            key = h.key(cell, t)[q] + moves[q, p] @ factor
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            good = keys[place] == key
            hit = np.zeros((len(few), len(keys)), bool)
            hit[q[good], place[good]] = True
            met[few[:, None], mine] |= hit[:, of]
    out = []
    for at in range(0, len(queries), 64):
        part = slice(at, min(at + 64, len(queries)))
        any_met = np.flatnonzero(met[part].any(0))
        row_ids = file["ids"][any_met]
        exact = queries[part] @ file["v"][any_met].astype(np.float64).T
        exact[~met[part][:, any_met] | (ids[part][:, None] == row_ids[None, :])] = -np.inf
        for i, s in enumerate(exact):
            k = _best_ids(row_ids, s, top)  # a file of several tables has a row more than once
            if len(k):
                out.append((ids[at + i], row_ids[k], s[k]))
    return out, int(met.sum())


def _search(good: DataFrame, dims: int, n: int, norm: float, every: int, top: int, report: list | None) -> DataFrame:
    """query_id, vec_id, score of the rows found for all queries on vectors of one length."""
    asked = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    drawn = lambda df, salt, most: df.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(salt)), "vec_id").limit(most).collect()
    audited, some = drawn(asked, 5, AUDITED), drawn(good, 6, SAMPLE)
    queries = np.array([r["v"] for r in audited]).reshape(-1, dims)
    truth = neighbours_of(good, np.array([r["vec_id"] for r in audited], np.int64), queries, top)
    coarse = min(PROJECTIONS, max(1, int(np.ceil(np.log(max(n / ROWS, 1)) / np.log(4)))))
    h, expected = fitted(Hashing(dims, norm, coarse=coarse), queries, truth, np.array([r["v"] for r in some]).reshape(-1, dims))
    if report is not None:
        report.append({"dims": dims, "rows": n, **expected})
    found = stored(_pass(good, asked, h, n, top), "lsh-found")
    met = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("k"))
    few = asked.join(met, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("k", F.lit(0)) < min(top, n - 1)).select("vec_id", "v")
    few = stored(few, "lsh-few")
    if few.isEmpty():
        return found
    return found.union(_pass(good, few, replace(h, width=WIDEST, probes=3**h.k, tables=1), n, top))


def _pass(good: DataFrame, asked: DataFrame, h: Hashing, n: int, top: int) -> DataFrame:
    """query_id, vec_id, score of the best rows of each file that queries go to."""
    spark = good.sparkSession
    folder = fresh_dir(spark, "lsh")
    files = stored(write_tables(good, h, n, folder), "lsh-files")
    visits = _visits(asked, h).join(files, ["t", "grp"])
    # A query once for each stretch of files, with the tables that it has in each.
    jobs = visits.groupBy("stretch", "vec_id").agg(F.collect_set(F.struct("file", "t")).alias("files"), F.first("v").alias("v"))
    jobs = stored(jobs.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)).cast("int")), "lsh-jobs")
    sizes = jobs.groupBy("stretch").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    jobs = jobs.join(sizes, "stretch").withColumn("part", F.pmod("part", "parts"))

    def block(table: pa.Table) -> pa.Table:
        ids, v, sets = table.column("vec_id").to_numpy(), matrix(table.column("v")), probe_order(h.k)[: h.probes]
        wanted: dict[str, dict[int, list[int]]] = {}
        for i, files in enumerate(table.column("files").to_pylist()):
            for x in files:
                wanted.setdefault(x["file"], {}).setdefault(x["t"], []).append(i)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for name in sorted(wanted):
            asking = np.unique(np.concatenate([np.array(x) for x in wanted[name].values()]))
            place = {t: np.searchsorted(asking, sorted(x)) for t, x in sorted(wanted[name].items())}
            for q, of, score in search_file(load_arrays(folder, name), h, sets, place, ids[asking], v[asking], top)[0]:
                if q in best:
                    of, score = np.concatenate([best[q][0], of]), np.concatenate([best[q][1], score])
                    k = _best_ids(of, score, top)
                    of, score = of[k], score[k]
                best[q] = of, score
        return pa.table(_found([(q, *found) for q, found in best.items()]))

    # A number of partitions, so that small rows are not taken for little work.
    dealt = jobs.repartition(max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "stretch", "part")
    return dealt.groupBy("stretch", "part").applyInArrow(block, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, *, vector: str = "embedding", every: int = 20, top: int = 20, report: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` rows of largest inner product found for each row whose vec_id is divisible by `every`.

    A query's own row is left out, by vec_id; ties go to the smaller vec_id. Vectors that are null, zero or hold null or
    non-finite components take no part, and neither do rows without vec_id; only vectors of one length are compared, and each length has tables of its own.
    Rows that repeat a vec_id are one candidate, with the best of their scores; as a query such an id has the smallest of its vectors. Without rows the
    result is empty; other columns are ignored. report: gets what the audit expects, for each length of vectors.
    """
    good = with_size(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col(vector))), "v")
    good = stored(good, "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for r in good.groupBy("dims").agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.col("vec_id") % every == 0).alias("asked")).orderBy("dims").collect():
        if r["asked"] and r["n"] > 1:
            found = found.union(_search(good.where(F.col("dims") == r["dims"]), r["dims"], r["n"], r["norm"], every, top, report))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
