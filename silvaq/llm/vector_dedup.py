"""Embedding near-dedup with small-world graphs.

Equal vectors of a label become one first. The rest is dealt to shards. Each shard's graph is built once, by the task that also looks for the
links inside the shard, and written to the shared folder. Then every other shard's vectors query it: a task takes the files of two shards, and
nothing but their names is shuffled. Each pair of shards meets once, as a link holds both ways.

In each task the beam widens until an audit passes: queries for which links were found, and others drawn at random, are answered by brute force until
enough true links were seen (a vector's likeness to itself is none), and the search must have found nearly all of these. Every link is verified by the
cosine in double precision. A task returns sums and one link per vector to the smallest of the vectors it hangs together with there, never
pairs; components are the union of those.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import load_arrays, save_arrays
from .common import fresh_dir, release, stored
from .components import components
from .hnsw import Graph
from .vectors import matrix, usable, with_size

#: Vectors of a shard.
SHARD = 8192
#: The first beam; queries that are audited at a time; true links that an audit asks for, or else queries; the share of links that must be found.
BEAM, AUDITED, LINKS, MOST, WANTED = 48, 64, 64, 512, 0.995
#: Single precision finds; what is this much below the threshold is verified too.
SLACK = 1e-5
#: Links up to which they are kept as pairs while components are made.
SPARSE = 1 << 21


def roots_of(met: np.ndarray, same: bool) -> np.ndarray:
    """The smallest place in each one's component. met[i, j]: query i meets row j; rows have the places before those of queries, or are the same (same)."""
    n_queries, n_rows = met.shape
    n = n_rows if same else n_rows + n_queries
    shift = 0 if same else n_rows
    label = np.arange(n)
    few = np.count_nonzero(met) <= SPARSE
    if few:
        i, j = np.nonzero(met)
        a, b = np.concatenate([i + shift, j]), np.concatenate([j, i + shift])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        heads = a[first]
    while True:
        least = label.copy()
        if few:
            if len(heads):
                least[heads] = np.minimum(least[heads], np.minimum.reduceat(label[b], first))
        else:
            for at in range(0, n_queries, 512):
                part, mine = met[at : at + 512], slice(shift + at, shift + min(at + 512, n_queries))
                least[mine] = np.minimum(least[mine], np.where(part, label[:n_rows], n).min(1))
                least[:n_rows] = np.minimum(least[:n_rows], np.where(part, label[mine][:, None], n).min(0))
        new = label.copy()
        np.minimum.at(new, label, least)  # a component's root follows the smallest that any of it meets
        new = np.minimum(new, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def link_shard(graph: Graph, rows: np.ndarray, queries: np.ndarray | None, least: float, seed: int = 0) -> tuple[np.ndarray, dict]:
    """Which rows of cosine `least` or more the graph finds for each query (None: each row; a row does not meet itself), and what the audit did.

    rows, queries: unit vectors in double precision.
    """
    same = queries is None
    q = rows if same else queries
    beam, audit = min(BEAM, max(1, len(rows))), {}
    while True:
        met = np.zeros((len(q), len(rows)), bool)
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            for i, f in enumerate(graph.within(part.astype(np.float32), least - SLACK, beam)):
                met[at + i, f[rows[f] @ part[i] >= least]] = True
        if same:  # a link found from one side holds for both
            np.fill_diagonal(met, False)
            met |= met.T
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(q))
        first = order[met.any(1)[order]][:AUDITED]
        order = np.concatenate([first, order[~np.isin(order, first)]])
        true = hit = at = 0
        while at < min(len(order), MOST) and (true < LINKS or at < 2 * AUDITED):
            some = order[at : at + AUDITED]
            exact = q[some] @ rows.T >= least
            if same:
                exact[np.arange(len(some)), some] = False
            true, hit, at = true + int(exact.sum()), hit + int((exact & met[some]).sum()), at + len(some)
        audit = {"beam": beam, "audited": at, "links": true, "found": hit}
        if hit >= WANTED * true or beam >= len(rows):
            return met, audit
        beam = min(beam * 2, len(rows))


@functools.lru_cache(maxsize=2)
def _shard(folder: str, name: str) -> tuple[Graph, dict[str, np.ndarray]]:
    """A shard's graph and arrays, mapped; a worker keeps the last ones."""
    a = load_arrays(folder, name)
    return Graph.from_arrays(a), a


RESULT = "rep long, links long, root long, audited long, true_links long, found_links long"


def _result(reps: np.ndarray, counts: np.ndarray, roots: np.ndarray, audit: dict) -> pa.RecordBatch:
    """Rows of those that have a link, and one row of the audit, without rep."""
    k = np.flatnonzero(counts)
    none = [None] * len(k)
    return pa.RecordBatch.from_arrays(
        [pa.array([*reps[k].tolist(), None], pa.int64()), pa.array([*counts[k].tolist(), None], pa.int64()), pa.array([*reps[roots[k]].tolist(), None], pa.int64()), *(pa.array([*none, audit[x]], pa.int64()) for x in ("audited", "links", "found"))],
        ["rep", "links", "root", "audited", "true_links", "found_links"],
    )


def dedup(vectors: DataFrame, *, vector: str = "embedding", label: str = "label", least: float = 0.93, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Two rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is `least` or more.
    Vectors that are null, zero or hold null or non-finite components link with nothing; neither do vectors of different
    lengths, nor rows without vec_id or label. component_id: the smallest vec_id that links reach; kept: whether it is the row's own.
    Rows that repeat a vec_id are rows like any other and share its fate. Without rows the result is empty; other columns are ignored.
    report: gets how many queries were audited, their true links, and how many of these were found.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("raw"))
    base = base.withColumn("v", F.when(usable(F.col("raw")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("raw").cast("array<double>"))).drop("raw")
    base = stored(with_size(base, "v"), "vectors")
    good = base.where(F.col("v").isNotNull())
    # Vectors are numbered once, as they are written: repeated ids have numbers of their own.
    one = good.groupBy("label", "dims", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("m"))
    one = stored(one.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    sizes = one.groupBy("label", "dims").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    shards = one.join(sizes, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("shards")).cast("int")).select("label", "dims", "shard", "rep", "m", "v")
    folder = fresh_dir(spark, "graphs")
    name_of = F.concat_ws("-", F.lit("shard"), F.md5(F.concat_ws("/", F.col("label").cast("string"), "dims").cast("binary")), F.col("shard").cast("string"))

    def build(table: pa.Table) -> pa.Table:
        v, rep, m = matrix(table.column("v")), table.column("rep").to_numpy(), table.column("m").to_numpy()
        order = np.argsort(rep, kind="stable")
        v, rep, m = v[order], rep[order], m[order]
        v = v / np.abs(v).max(1, keepdims=True)
        v = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        graph = Graph(v)
        met, audit = link_shard(graph, v, None, least)
        save_arrays(folder, table.column("file")[0].as_py(), graph.arrays() | {"unit": v, "rep": rep, "m": m})
        return pa.Table.from_batches([_result(rep, np.array([m[row].sum() for row in met], np.int64), roots_of(met, True), audit)])

    # A number of partitions, so that small rows are not taken for little work.
    tasks = 4 * spark.sparkContext.defaultParallelism
    at_home = stored(shards.withColumn("file", name_of).repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file").groupBy("file").applyInArrow(build, RESULT), "home")
    manifest = sizes.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(shards.select("label", "dims", "shard").distinct(), ["label", "dims", "shard"]).withColumn("file", name_of)
    lower, upper = manifest.select("label", "dims", F.col("shard").alias("a"), F.col("file").alias("rows")), manifest.select("label", "dims", F.col("shard").alias("b"), F.col("file").alias("queries"))
    jobs = stored(lower.join(upper, ["label", "dims"]).where("a < b").select("rows", "queries"), "graph-jobs")

    def meet(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                graph, x = _shard(folder, a)
                y = load_arrays(folder, b)
                met, audit = link_shard(graph, x["unit"], y["unit"], least)
                counts = np.concatenate([y["m"] @ met, met @ x["m"]])
                yield _result(np.concatenate([x["rep"], y["rep"]]), counts, roots_of(met, False), audit)
        _shard.cache_clear()
        release()

    n_jobs = jobs.count()
    abroad = jobs.repartition(max(1, min(n_jobs, 8 * tasks)), "rows", "queries").sortWithinPartitions("rows").mapInArrow(meet, RESULT)
    met = stored(at_home.union(abroad), "met") if n_jobs else at_home
    if report is not None:
        found = met.agg(*[F.sum(c).alias(c) for c in ("audited", "true_links", "found_links")]).first()
        report |= found.asDict()
    met = met.where(F.col("rep").isNotNull())
    roots = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    of = one.join(counts, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    names = of.groupBy("root").agg(F.min("least_id").alias("component"))
    copies = of.join(names, "root").select("label", "dims", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component")
    linked = good.select("vec_id", "label", "dims", "v").join(copies, ["label", "dims", "v"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = base.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same of `dedup` by plain SQL: every pair of vectors of a label is compared.
ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
both_ways AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM both_ways GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.x LEFT JOIN n ON e.vec_id = n.x
"""
