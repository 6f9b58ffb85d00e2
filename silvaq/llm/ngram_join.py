"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

1. A sketch of document frequencies, of fixed size, is counted over all documents: a number of documents for each range of
   shingle hashes. Any order that is the same everywhere serves prefix filtering; this one puts shingles of rare ranges first.
2. Documents with equal sets (two 64-bit fingerprints tell them) become one node, which gets a number. A node's prefix is so long that two nodes
   above the threshold share a shingle of their prefixes. The suffix filter is one of histograms: a node keeps the sizes of 64 parts of
   its set, cut at fixed pivots, and the sum of their differences bounds from below what two sets do not share.
3. Nodes that share a prefix shingle are first compared with one leader, the node where the shingle stands foremost: the centre
   of a group of near copies. What that links need not be compared again for the sake of components, so that a large group costs as many pairs as
   it has nodes.
4. All other pairs with a common prefix shingle, that no link joins yet, pass the filters and are verified on their texts. A shingle of many
   nodes is dealt out: one side of its pairs in parts of SIDE nodes, each of which meets the other side.
5. Links make components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, WORD, cut, fresh_dir, leaving_nothing, remove, stored, stored_at
from .components import components
from .shingles import fingerprint, shingle_hashes

#: Ranges of the sketch, and parts in which it travels.
RANGES, BLOCKS = 1 << 20, 64
#: Sketches that are summed at once.
FAN = 64
PARTS = 64
#: Slots of the filter for documents whose text verification needs.
SLOTS = 8388593
#: What stands for a null doc_id in joins, beside a flag.
NO_ID = -(2**63)
#: Nodes of a part of one shingle's nodes.
SIDE = 8192


def _range_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Documents by range of shingle hashes; RANGES counts, whatever the input's size."""
    size = RANGES // BLOCKS

    def count(batches):
        counts, held, n = np.zeros(RANGES, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(_range_of(shingle_hashes(text.as_py(), width)))
                n += len(held[-1])
                if n > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=RANGES)
                    held, n = [], 0
        counts += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=RANGES)
        if counts.any():
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int64()), "block": pa.array(range(BLOCKS), pa.int32()), "counts": [counts[i * size : (i + 1) * size].astype(np.uint32).tobytes() for i in range(BLOCKS)]})

    def add(key, table):
        total = np.zeros(size, np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint32)
        return pa.table({"task": pa.array([table["task"][0].as_py()], pa.int64()), "block": pa.array([key[0].as_py()], pa.int32()), "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    schema = "task long, block int, counts binary"
    found = docs.select("text").mapInArrow(count, schema)
    for fan in (FAN, FAN * FAN, FAN**3):  # sums of sums, so that no group grows with the number of tasks
        found = found.groupBy("block", (F.col("task") / fan).cast("long").alias("group")).applyInArrow(add, schema)
    out = np.zeros(RANGES, np.uint32)
    for r in found.collect():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counts"], np.uint32)
    return out


def _need(n: int, share: int) -> int:
    """The least overlap with any set that a set of n has at the threshold."""
    return -(-share * n // 100)


def overlap(n: Column, m: Column, share: int) -> Column:
    """The least overlap of sets of sizes n and m at the threshold."""
    return F.ceil((F.lit(share) * (n + m)) / F.lit(float(100 + share)) - F.lit(1e-9)).cast("int")


def mark_of(text: Column) -> Column:
    """What tells texts apart that share a doc_id."""
    return F.unhex(F.md5(text.cast("binary")))


def prepare(docs: DataFrame, width: int, share: int) -> DataFrame:
    """doc_id, mark (of the text), print0, print1, n, parts, prefix of each row; the fingerprints are null for a document without words."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch(docs, width))

    def task(batches):
        seen = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                prints, sizes, parts, prefixes = [], [], [], []
                for text in part.column(2):
                    u = shingle_hashes(text.as_py(), width)
                    n = len(u)
                    r = seen[_range_of(u)]
                    keep = n - _need(n, share) + 1 if n else 0
                    if keep < n:
                        rare = np.argpartition(r, keep - 1)
                        able = np.flatnonzero(r <= r[rare[keep - 1]])
                    else:
                        able = np.arange(n)
                    order = able[np.lexsort((u[able], r[able]))][:keep]
                    prints.append(fingerprint(u) if n else (None, None))
                    sizes.append(n)
                    parts.append(np.minimum(np.bincount((u >> np.uint64(6) & np.uint64(63)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes())
                    prefixes.append(u[order].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(p, pa.int64()) for p in zip(*prints, strict=True)), pa.array(sizes, pa.int32()), pa.array(parts, pa.binary()), lists],
                    ["doc_id", "mark", "print0", "print1", "n", "parts", "prefix"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of(F.col("text")).alias("mark"), "text")
    return slim.mapInArrow(leaving_nothing(task), "doc_id long, mark binary, print0 long, print1 long, n int, parts binary, prefix array<long>")


def _close(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """Pairs (x, y) of nodes that pass the suffix filter, with a document of each (dx, mx and dy, my)."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("parts").alias(f"p{s}"), F.col("doc").alias(f"d{s}"), F.col("mark").alias(f"m{s}"))
    known = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "px", "py", "dx", "mx", "dy", "my")

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            nx, ny = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            px, py = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for i in (4, 5))
            most = nx + ny - 2 * -(-share * (nx + ny) // (100 + share))
            yield batch.filter(pa.array(np.abs(px - py).sum(1) <= most)).select(["x", "y", "dx", "mx", "dy", "my"])

    return known.mapInArrow(leaving_nothing(task), "x long, y long, dx long, mx binary, dy long, my binary")


def verify(pairs: DataFrame, docs: DataFrame, width: int, share: int) -> DataFrame:
    """The pairs (x, y, dx, mx, dy, my) whose sets, taken from the texts, reach the threshold: a, b, overlap; stored."""
    spark = docs.sparkSession
    folders = [fresh_dir(spark, name) for name in ("pairs", "texts")]
    pairs = stored_at(pairs, folders[0])
    slot = lambda mark: F.pmod(F.xxhash64(mark), F.lit(SLOTS))
    # A filter of at most SLOTS / 64 rows, whatever the number of documents: too many only let more texts pass.
    wanted = pairs.select(slot("mx").alias("s")).union(pairs.select(slot("my").alias("s")))
    slots = wanted.groupBy((F.col("s") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(s % 64 AS INT)))").alias("bits"))
    keyed = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), mark_of(F.col("text")).alias("m"), "text").withColumn("s", slot("m"))
    passed = keyed.join(F.broadcast(slots), (F.col("s") / 64).cast("int") == F.col("w")).where(F.expr("shiftright(bits, CAST(s % 64 AS INT)) & 1 = 1"))
    texts = stored_at(passed.groupBy("d", "m").agg(F.first("text").alias("text")), folders[1])  # rows that repeat id and text: one
    first = pairs.join(texts.select(F.col("d").alias("dx"), F.col("m").alias("mx"), F.col("text").alias("tx")), ["dx", "mx"]).select("x", "y", "tx", "dy", "my")
    whole = first.join(texts.select(F.col("d").alias("dy"), F.col("m").alias("my"), F.col("text").alias("ty")), ["dy", "my"]).select("x", "y", "tx", "ty")

    def compare(batches):
        last = None, None
        for batch in batches:
            out = []
            for x, y, tx, ty in zip(*(batch.column(i) for i in range(4)), strict=True):
                x, y, ty = x.as_py(), y.as_py(), ty.as_py()
                if last[0] != y:
                    last = y, shingle_hashes(ty, width)
                u, v = shingle_hashes(tx.as_py(), width), last[1]
                both = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * both >= share * (len(u) + len(v) - both):
                    out.append((x, y, both))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["a", "b", "overlap"])

    found = stored(whole.mapInArrow(leaving_nothing(compare), "a long, b long, overlap int"), "links")
    for folder in folders:
        remove(spark, folder)
    return found


def links(docs: DataFrame, rows: DataFrame, *, width: int, share: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, links between them). every: all links; otherwise as many as components need."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "mark")).alias("least")
    nodes = rows.where(F.col("print0").isNotNull()).groupBy("print0", "print1").agg(least, F.first("n").alias("n"), F.first("parts").alias("parts"), F.first("prefix").alias("prefix"))
    # Numbers are drawn once, as the nodes are written.
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "print0", "print1", "n", "parts", "prefix", "least.*"), "nodes")
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    at = F.struct("pos", "n", "node")
    leaders = entries.groupBy("gram").agg(F.min(at).alias("lead"), F.count("*").alias("shared")).where("shared > 1")
    common = stored(entries.join(leaders, "gram").select("gram", "node", "n", "pos", "lead", "shared"), "common")
    slim = nodes.select("node", "n", "parts", "doc", "mark", "nameless", "print0", "print1")

    def fits(na, ia, nb, ib):
        most = F.least(na - ia, nb - ib)
        return (100 * F.least(na, nb) >= share * F.greatest(na, nb)) & (most >= overlap(na, nb, share))

    linked = None
    if not every:
        led = common.where(F.col("node") != F.col("lead.node")).where(fits(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
        pairs = led.select(F.col("node").alias("x"), F.col("lead.node").alias("y")).distinct()
        linked = verify(_close(pairs, slim, share), docs, width, share)
        roots = components(linked)
        common = common.join(roots.select("node", F.col("root").alias("r")), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")
        lead = roots.select(F.col("node").alias("leader"), F.col("root").alias("r"))
        common = common.withColumn("leader", F.col("lead.node")).join(lead, "leader", "left").withColumn("apart", F.col("root") != F.coalesce("r", "leader")).drop("r", "lead", "leader")
        # A shingle all of whose nodes are one component by now has nothing left to compare.
        live = common.where("apart").select("gram").distinct()
        common = stored(common.join(live, "gram"), "apart")
    else:
        common = common.withColumn("root", F.col("node")).withColumn("apart", F.lit(True)).drop("lead")
    parts = F.ceil(F.col("shared") / SIDE).cast("int")
    short = common.where(F.col("n") - F.col("pos") >= overlap(F.col("n"), F.col("n"), share))  # places where a set can meet one of its size or larger
    a = short.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).select("gram", "part", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "root", "apart")])
    b = common.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("gram", "part", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "root", "apart")])
    rule = (F.struct("n_a", "node_a") < F.struct("n_b", "node_b")) & (F.col("root_a") != F.col("root_b")) & fits(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"))
    met = a.where("apart_a").join(b, ["gram", "part"]).where(rule).select(F.col("node_a").alias("x"), F.col("node_b").alias("y"))
    if not every:
        met = met.union(a.where("NOT apart_a").join(b.where("apart_b"), ["gram", "part"]).where(rule).select("node_a", "node_b"))
    more = verify(_close(met.distinct(), slim, share), docs, width, share)
    return slim, more if linked is None else linked.union(more)


def group(docs: DataFrame, *, width: int = 3, share: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of each row.

    Two documents link when 100 * intersection >= share * union of their shingle sets; component_id is the smallest doc_id that
    links reach. A null text or one without words is empty, links with nothing and is its own component. Rows with equal sets link,
    repeated rows too. A null doc_id takes part in links but gives no component its name; component_id is null if no row of a component
    has an id. Without rows the result is empty; other columns are ignored.
    """
    rows = stored(prepare(docs, width, share), "shingled")
    nodes, found = links(docs, rows, width=width, share=share)
    roots = components(found.select("a", "b"))
    named = cut(nodes.join(roots, "node", "left").select("print0", "print1", F.coalesce("root", "node").alias("root"), F.when(~F.col("nameless"), F.col("doc")).alias("doc")))
    names = named.groupBy("root").agg(F.min("doc").alias("component"))
    of = named.join(names, "root").select("print0", "print1", "component")
    out = rows.select("doc_id", "n", "print0", "print1").join(of, ["print0", "print1"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("print0").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def distinct(docs: DataFrame, *, width: int = 3, share: int = 90, nameless: bool = False) -> DataFrame:
    """docs with one row of each group that links join, the one of the smallest doc_id; documents without words (null or empty texts among them) all stay.

    Groups are told by their texts, so texts that share a doc_id do not displace each other. Of a group's rows that repeat its smallest doc_id
    the one of the smallest digest of its text stays, and of those that repeat both one by a hash of its columns. nameless: groups no row of which
    has a doc_id keep a row too; otherwise they go. Without rows the result is empty; other columns come along, whatever their names.
    """
    rows = stored(prepare(docs, width, share), "shingled")
    nodes, found = links(docs, rows, width=width, share=share)
    roots = components(found.select("a", "b"))
    best = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("nameless", "doc", "mark")).alias("least"))
    if not nameless:
        best = best.where("NOT least.nameless")
    kept = best.select(F.col("least.nameless").alias("z"), F.col("least.doc").alias("d"), F.col("least.mark").alias("m"))
    whole = docs.select(F.struct("*").alias("row"))
    wordy = F.coalesce(F.col("row.text"), F.lit("")).rlike(WORD)
    keyed = whole.where(wordy).select(F.col("row.doc_id").isNull().alias("z"), F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("d"), mark_of(F.col("row.text")).alias("m"), "row")
    # Rows that repeat id and text first, where they are read: many copies are few by the time they meet.
    one = keyed.groupBy("z", "d", "m").agg(F.min_by("row", F.xxhash64("row")).alias("row")).join(kept, ["z", "d", "m"], "left_semi")
    return one.select("row.*").union(whole.where(~wordy).select("row.*"))


#: The same of `group` by plain SQL: every pair of sets that share a shingle is counted.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS grams FROM t),
e AS MATERIALIZED (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, c.component_id FROM s JOIN c ON s.doc_id = c.x
"""
