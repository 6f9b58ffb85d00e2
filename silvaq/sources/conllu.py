"""CoNLL-U in and out. Parsing and normalisation are Column expressions over one sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, span
from . import postings

#: Sentences of a shard, and tokens of the longest sentence that is searched.
SHARD, LONGEST = 500_000, 256
#: What tokens have besides their place.
TOKEN = ("form", "form_norm", "lemma", "lemma_norm", "upos", "feats", "tags", "out", "into")
FIELDS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
# How documents are marked in the input, by a one-word sentence or by comments.
MARK, OPEN, CLOSE = "####FIPBANK-BEGIN-MARKER:", "###C:<doc", "###C:</doc"
NO_STRINGS = "array<string>"
EDGE = "array<struct<gov:int,dep:int,dtype:string,basic:boolean>>"


def numbered(df: DataFrame, name: str = "pos") -> DataFrame:
    """df with the place of each row in the order of its partitions, from 0. A count of each partition comes first; no row moves."""
    marked = df.withColumn("_id", F.monotonically_increasing_id())
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = marked.groupBy(part.cast("int").alias("_part")).count().orderBy("_part").collect()  # a row for each partition
    starts, total = [], 0
    for r in counts:
        starts.append((r["_part"], total))
        total += r["count"]
    table = df.sparkSession.createDataFrame(starts, "_part int, _start long")  # as many rows as tasks, which the driver keeps anyway
    return marked.withColumn("_part", part.cast("int")).join(F.broadcast(table), "_part").withColumn(name, F.col("_start") + row).drop("_id", "_part", "_start")


def read_blocks(spark: SparkSession, paths, *, most: int = 0, skip: int = 0, shard_size: int = SHARD, prefix: str = "trees") -> DataFrame:
    """shard, graph_id, block: the sentences of CoNLL-U files, as text, in their order.

    Sentences end at lines that are empty or blank; lines may end with carriage returns. most (0: all) counts before skip: most - skip sentences are
    left, as the first ones go. Files with carriage returns are told by their first lines, so that they are read in pieces, too.
    """
    start = spark.read.option("lineSep", "\n").text(paths).limit(20).collect()
    returns = bool(start) and all(r["value"].endswith("\r") for r in start)
    text = spark.read.option("lineSep", "\n\r\n" if returns else "\n\n").text(paths)
    # Comments without a sentence belong to the next one, so blocks are numbered first and sentences then.
    return cut_shards(numbered(sentences_of(text)), most=most, skip=skip, shard_size=shard_size, prefix=prefix)


def sentences_of(text: DataFrame) -> DataFrame:
    """block: the sentences of pieces of text (value), cut at blank lines, without carriage returns."""
    each = text.select(F.explode(F.split(F.regexp_replace("value", "\r", ""), r"\n[ \t\f\x0B]*(?=\n)")).alias("block"))
    return each.where(F.col("block").rlike(r"\S")).select(F.regexp_replace("block", r"^\n+|\n+$", "").alias("block"))


def cut_shards(blocks: DataFrame, *, most: int = 0, skip: int = 0, shard_size: int = SHARD, prefix: str = "trees") -> DataFrame:
    """pos, block -> shard, graph_id, block; after max and skip. graph_id begins at 0 in each shard."""
    if most:
        blocks = blocks.where(F.col("pos") < most)
    if skip:
        blocks = blocks.where(F.col("pos") >= skip)
    at = F.col("pos") - skip
    return blocks.select(F.format_string(f"{prefix}_%05d", F.floor(at / shard_size)).alias("shard"), (at % shard_size).alias("graph_id"), "block")


def parse(block: Column) -> Column:
    """struct<comments, lines, rows>: rows as arrays of fields; multi-word ranges are left out."""
    plain = F.when(F.contains(block, F.lit("\r")), F.regexp_replace(block, "\r", "")).otherwise(block)

    def parts(lines: Column) -> Column:
        cut = F.transform(F.filter(lines, lambda x: ~x.startswith("#")), lambda x: F.split(x, "\t"))
        rows = F.filter(cut, lambda r: r[0].rlike(r"^\d+$") | r[0].contains("."))
        return F.struct(F.filter(lines, lambda x: x.startswith("#")).alias("comments"), lines.alias("all"), rows.alias("rows"))

    return let(F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != ""), parts)


def misplaced_comment(lines: Column) -> Column:
    """Whether a comment follows a token line."""
    first = F.coalesce(F.array_position(F.transform(lines, lambda x: ~x.startswith("#")), F.lit(True)), F.lit(0))
    return (first > 0) & F.exists(F.slice(lines, F.greatest(first.cast("int"), F.lit(1)), F.size(lines)), lambda x: x.startswith("#"))


def tags_of(upos: Column, feats: Column) -> Column:
    """The tags of a token: its part of speech, its features, and the categories of these."""
    own = F.when(upos != "_", F.array(upos)).otherwise(F.array().cast(NO_STRINGS))
    items = F.when(feats != "_", F.split(feats, r"\|")).otherwise(F.array().cast(NO_STRINGS))
    parts = F.flatten(F.transform(items, lambda f: F.when(f.contains("="), F.array(f, F.substring_index(f, "=", 1))).otherwise(F.array(f))))
    return F.array_distinct(F.concat(own, parts))


def form_norm(form: Column) -> Column:
    """The lower-cased form, where it differs."""
    low = F.lower(form)
    return F.when(low != form, low)


def lemma_norm(lemma: Column) -> Column:
    low = F.translate(F.lower(lemma), "#-", "")
    return F.when(low != lemma, low)


def token(idx: Column, form: Column, lemma: Column, upos: Column, feats: Column, fields=TOKEN) -> list[Column]:
    """idx and those of the fields that are not edges."""
    made = [
        form.alias("form"), form_norm(form).alias("form_norm"), lemma.alias("lemma"), lemma_norm(lemma).alias("lemma_norm"), upos.alias("upos"), feats.alias("feats"), tags_of(upos, feats).alias("tags")
    ]
    return [idx.cast("int").alias("idx"), *[c for n, c in zip(TOKEN, made, strict=False) if n in fields]]


def link(tokens: Column, edges: Column, fields=TOKEN) -> Column:
    """tokens with their edges both ways, from an array of (gov, dep, dtype, basic). fields: those that are made.

    Edges are first dealt to groups of neighbouring tokens, as many as a square root of their number, so that a token looks at its group's edges only.
    """
    names = ("idx", *[n for n in TOKEN if n in fields and n not in ("out", "into")])
    sides = [(name, mine, far) for name, mine, far in (("out", "gov", "dep"), ("into", "dep", "gov")) if name in fields]
    width = F.greatest(F.ceil(F.sqrt(F.size(tokens))).cast("int"), F.lit(1))
    group = lambda place, w: F.floor(place / w).cast("int")

    def dealt(w: Column) -> Column:
        of = lambda mine: F.transform(span(F.lit(0), group(F.size(tokens), w)), lambda g: F.filter(edges, lambda e: (e[mine] >= g * w) & (e[mine] < (g + 1) * w)))
        return F.struct(w.alias("w"), *[of(mine).alias(name) for name, mine, _ in sides])

    def one(x: Column, d: Column) -> Column:
        side = lambda name, mine, far: F.transform(F.filter(F.get(d[name], group(x["idx"], d["w"])), lambda e: e[mine] == x["idx"]), lambda e: F.struct(e[far].alias("u"), e["dtype"].alias("d"), e["basic"].alias("basic")))
        return F.struct(*[x[n].alias(n) for n in names], *[side(*s).alias(s[0]) for s in sides])

    return let(let(width, dealt), lambda d: F.transform(tokens, lambda x: one(x, d)))


#: What sentences have besides their number of tokens.
PARTS = ("comments", "lines", "tokens", "edges")


def graphs(blocks: DataFrame, parts=PARTS, fields=TOKEN) -> DataFrame:
    """shard, graph_id, n, comments, lines, tokens, edges of each sentence (block) with tokens. parts, and fields of tokens besides idx: those that are made; all are checked.

    Null nodes (ids such as 5.1) count as words and get the feature Nullnode=Nullnode; heads and DEPS are renumbered. Basic
    edges go under their relation, with _ as -; DEPS edges under theirs, only where the token has a head, and those from 0 are left out. A head that is no
    row's id, a row without ten fields and a comment behind a token are errors.
    """
    at = F.concat("shard", F.lit("/"), F.col("graph_id").cast("string"), F.lit(": "))

    def one(r: Column, i: Column) -> Column:
        null = r[0].contains(".")
        feats = F.when(~null, r[5]).when(r[5] == "_", F.lit("Nullnode=Nullnode")).otherwise(F.concat(r[5], F.lit("|Nullnode=Nullnode")))
        return F.struct(*token(i, r[1], r[2], r[3], feats, fields))

    def edges_of(p: Column, ids: Column) -> Column:
        def place(ref: Column) -> Column:
            found = F.array_position(ids, ref).cast("int") - 1
            return F.when(found >= 0, found).otherwise(F.raise_error(F.concat(at, F.lit("no row has the id "), ref)).cast("int"))

        has_head = lambda r: ~r[6].isin("_", "0")
        edge = lambda gov, dep, name, basic: F.struct(gov.alias("gov"), dep.cast("int").alias("dep"), F.translate(name, "_", "-").alias("dtype"), F.lit(basic).alias("basic"))
        basic = lambda r, i: F.array(edge(place(r[6]), i, r[7], True))
        extra = lambda r, i: F.transform(F.filter(F.split(r[8], r"\|"), lambda d: (r[8] != "_") & ~d.startswith("0:")), lambda d: edge(place(F.substring_index(d, ":", 1)), i, F.regexp_replace(d, "^[^:]*:", ""), False))
        return F.flatten(F.transform(p["rows"], lambda r, i: F.when(has_head(r), F.concat(basic(r, i), extra(r, i))).otherwise(F.array().cast(EDGE))))

    def sentence(p: Column) -> Column:
        wrong = F.when(misplaced_comment(p["all"]), "a comment follows a token").when(F.exists(p["rows"], lambda r: F.size(r) != 10), "a row has not ten fields")
        made = {
            "comments": lambda e: p["comments"], "lines": lambda e: F.transform(p["rows"], lambda r: F.array_join(r, "\t")),
            "tokens": lambda e: let(F.transform(p["rows"], one), lambda t: link(t, e, fields)), "edges": lambda e: e,
        }
        # Counted, so that heads are checked where no part asks for edges.
        whole = lambda e: F.when(F.size(e) >= 0, F.struct(F.size(p["rows"]).alias("n"), *[make(e).alias(n) for n, make in made.items() if n in parts]))
        good = let(F.transform(p["rows"], lambda r: r[0]), lambda ids: let(edges_of(p, ids), whole))
        return F.when(wrong.isNull(), good).otherwise(F.raise_error(F.concat(at, wrong)))

    # One expression, exploded: as columns, parts would be computed wherever they are used.
    found = F.filter(F.transform(F.array(parse(F.col("block"))), sentence), lambda s: s["n"] > 0)
    return blocks.select("shard", "graph_id", F.explode(found).alias("s")).select("shard", "graph_id", "s.*")


def searchable(sentences: DataFrame) -> DataFrame:
    """Sentences that are not too long to search; ids do not close up."""
    return sentences.where(F.col("n") <= LONGEST)


def with_documents(blocks: DataFrame) -> DataFrame:
    """Carries document marks forward: adds url and the comments that name a sentence's place, and drops the sentences that are only marks.

    A sentence of one word ####FIPBANK-BEGIN-MARKER:<url> begins a document; so does the comment ###C:<doc ... url="...">, and ###C:</doc ends it.
    blocks: shard, graph_id, block, at most a shard's worth in each shard. graph_id closes up over the marks; counts begin anew in each shard.
    """
    p = blocks.select("*", F.explode(F.array(parse(F.col("block")))).alias("_p"))
    word = F.when(F.size("_p.rows") == 1, F.get(F.get("_p.rows", F.lit(0)), F.lit(1)))
    mark = F.when(word.startswith(MARK), F.regexp_replace(word, "^[^:]*:", ""))
    p = p.withColumn("_mark", mark)
    opens = F.filter("_p.comments", lambda c: c.startswith(CLOSE) | (c.startswith(OPEN) & c.rlike('url="')))
    last = F.get(opens, F.size(opens) - 1)
    change = F.when(F.col("_mark").isNotNull(), F.col("_mark")).when(F.size(opens) > 0, F.when(last.startswith(CLOSE), F.lit("")).otherwise(F.regexp_extract(last, 'url="(.*?)"', 1)))
    order = Window.partitionBy("shard").orderBy("graph_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("_url", F.last(change, ignorenulls=True).over(order)).withColumn("url", F.when(F.col("_url") != "", F.col("_url")))
    is_mark = F.col("_mark").isNotNull().cast("int")
    p = p.withColumn("_doc", F.sum(is_mark).over(order) - 1)
    inside = Window.partitionBy("shard", "_doc").orderBy("graph_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sentence = (F.col("_mark").isNull() & (F.size("_p.rows") > 0)).cast("int")
    p = p.withColumn("_sent", F.sum(sentence).over(inside) - 1).withColumn("_new", F.sum(sentence).over(order) - 1)
    p = p.where(F.col("_mark").isNull() & (F.size("_p.rows") > 0))
    own = F.array(F.concat(F.lit("# URL: "), F.col("url")), F.format_string("# DOC/SENT: %d/%d", F.col("_doc"), F.col("_sent")))
    more = F.when(F.col("url").isNotNull(), own).otherwise(F.array().cast(NO_STRINGS))
    return p.select("shard", F.col("_new").alias("graph_id"), "block", "url", F.concat("_p.comments", more).alias("comments"), F.col("_doc").alias("doc"), F.col("_sent").alias("sent"))


def write_index(sentences: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes an index: sentences for searching, by shard; their texts (if there) apart, so that matching reads none; postings, by kind, in files sorted by
    term with a bloom filter of terms, so that a term's postings are found without reading others'; and symbols.

    Postings and symbols are made from what has been written, not from the input again.
    """
    spark = sentences.sparkSession
    searchable(sentences).drop("lines", "comments", "edges").write.mode(mode).partitionBy("shard").parquet(f"{path}/graphs")
    if "lines" in sentences.columns:
        sentences.select("shard", "graph_id", "comments", "lines").write.mode(mode).partitionBy("shard").parquet(f"{path}/text")
    graphs = spark.read.parquet(f"{path}/graphs")
    found = postings.postings(graphs).withColumn("shard", F.col("shard").cast("string"))
    ordered = found.sortWithinPartitions("kind", "term", "norm", "shard", "graph_id")  # each file by term; nothing is shuffled
    ordered.write.mode(mode).partitionBy("kind").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    postings.symbols(graphs).coalesce(1).write.mode(mode).parquet(f"{path}/symbols")


def to_conllu(lines: Column, comments: Column) -> Column:
    return F.concat(F.array_join(F.concat(comments, lines), "\n"), F.lit("\n"))

