"""What queries move and write: nothing that grows faster than the tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from silvaq import catalogue
from silvaq.engine import Engine
from silvaq.functions import validation
from silvaq.functions.arrays import before
from silvaq.sources import conllu, fixtures

TEXTS = ["x aaaa x b c", "the Of #a-B the ccccc dddddd eeeeeee ff", "", " ", "A-b  aaaa aaaa bbbbb", " ".join(["w" * (i % 9) for i in range(256)]), " ".join(["x"] * 257)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("growth")
    rows = [(i, "\n".join(TEXTS[i:] + TEXTS[:i]), "a") for i in range(len(TEXTS))] + [(99, None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


TEXT_PATTERNS = [name for name, (graphs, _, _) in catalogue.PATTERNS.items() if graphs == "text"]


@pytest.mark.parametrize("name", [*TEXT_PATTERNS, *catalogue.BRACKETED, "custom_query", "api_retmax"])
def test_searches_of_lines_write_and_deal_out_nothing(spark, sf_dir, name, monkeypatch):
    def index(*_):
        raise AssertionError("an index was written")

    monkeypatch.setattr(catalogue, "index", index)
    shown = plan(catalogue.queries()[name](spark, sf_dir))
    assert "Join" not in shown and shown.count("Exchange") == shown.count("REPARTITION")  # few pieces of input are dealt out once


@pytest.mark.parametrize("name", TEXT_PATTERNS)
def test_lines_are_searched_as_the_same_tokens_stored(spark, sf_dir, name):
    _, pattern, options = catalogue.PATTERNS[name]
    stored = Engine(fixtures.text_heaps(spark, sf_dir)).hits(pattern, **options)
    assert sorted(stored.collect()) == sorted(catalogue.queries()[name](spark, sf_dir).collect())


def test_patterns_together_are_as_those_alone(spark, sf_dir):
    engine = Engine(fixtures.text_lines(spark, sf_dir), source=fixtures.text_source)
    patterns = {"a": "NOUN >nsubj _", "b": "_ {max_tree_len=9}", "c": "_ >!amod _"}
    found = engine.together(patterns).collect()
    for name, pattern in patterns.items():
        assert sorted((r.graph_id, tok) for r in found for tok in r[name]) == sorted(map(tuple, engine.hits(pattern).collect()))
    assert {r.graph_id: r.toks for r in engine.grouped("NOUN").collect()} == {r.graph_id: r.toks for r in engine.grouped(lambda e: e.hits("NOUN")).collect()}


CHECKS = ["rows", "surface", "sentence_issues", "field_issues", "repaired", "features", "spans"]


@pytest.mark.parametrize("name", CHECKS)
def test_checks_deal_out_no_rows(spark, sf_dir, name):
    shown = plan(catalogue.queries()[f"conllu_{name}"](spark, sf_dir))
    assert "Join" not in shown and shown.count("Exchange") == shown.count("REPARTITION")


@pytest.mark.parametrize("name", ["field_issues", "sentence_issues", "repaired", "features", "dependencies"])
def test_checks_of_blocks_are_those_of_rows(spark, name):
    row = "\t".join
    blocks = [
        "# c\n1-2\tMW" + "\t_" * 8 + "\n1\ta\ta\tX\t_\tA=1|B=2,3\t0\tr\t2:x|0:y|9:z\t_\n2\tb\tb\tX\t_\tbad\t7\tr\tno\t_\n2\tc\tc\tX\t_\t_\t1\tr\t1:y|1:y\t_",
        "\n".join(row([str(i), "w", "w", "X", "_", "_", "0" if i == 1 else str(i - 1), "d", f"{i - 1}:d" if i > 1 else "_", "_"]) for i in range(1, 40)),
        "1.1\tn\tn\tX\n2-1\tm\tm\tX\nx\ty\n1  spaced out here _ _ 2 d 1.1:e",
        "# nothing",
    ]
    b = spark.createDataFrame(list(enumerate(blocks)), "graph_id long, block string")
    check = getattr(validation, name)
    found = sorted(map(tuple, check(b).collect()), key=str)
    assert found and found == sorted(map(tuple, check(validation.rows(b)).collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 16, 17, 1000, 20_000])
def test_sums_before(spark, n):
    values = [i % 7 for i in range(n)]
    found = spark.createDataFrame([(values,)], "v array<int>").select(before(F.col("v")).alias("b")).first().b
    assert found == [0, *itertools.accumulate(values)][:n]


@pytest.mark.parametrize("name", ["conllu_scan", "hits_conllu"])
def test_conllu_is_read_and_annotated_where_it_is(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(catalogue, "index", None)
    shown = plan(catalogue.queries()[name](spark, sf_dir))
    assert "Join" not in shown and shown.count("Exchange") == shown.count("REPARTITION")


def test_edges_of_long_sentences_are_linked(spark):
    n = 150
    heads = {i: (i * 7) % n for i in range(n)}
    tokens = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(*conllu.token(i, F.lit("f"), F.lit("l"), F.lit("X"), F.lit("_"))))
    edges = F.array(*[F.struct(F.lit(h).alias("gov"), F.lit(d).alias("dep"), F.lit(str(d)).alias("dtype"), F.lit(True).alias("basic")) for d, h in heads.items()])
    found = spark.range(1).select(conllu.link(tokens, edges).alias("t")).first().t
    assert [x.idx for x in found] == list(range(n)) and [[e.u for e in x.into] for x in found] == [[heads[i]] for i in range(n)]
    assert [[(e.u, e.d) for e in x.out] for x in found] == [[(d, str(d)) for d, h in heads.items() if h == i] for i in range(n)]


def test_heads_are_checked_where_no_part_asks_for_edges(spark):
    bad = spark.createDataFrame([("s", 0, "1\ta\ta\tN\t_\t_\t9\tx\t_\t_")], "shard string, graph_id long, block string")
    with pytest.raises(Exception, match="no row has"):
        conllu.graphs(bad, ("lines",)).collect()


def test_flat_tokens_are_those_of_sentences(spark, sf_dir):
    rows = lambda df: sorted(df.select("graph_id", *sorted(set(df.columns) - {"graph_id"})).collect(), key=str)
    found, want = fixtures.flat_lines(fixtures.text_lines(spark, sf_dir)), fixtures.flat(fixtures.text_heaps(spark, sf_dir))
    assert all(rows(f) == rows(w) for f, w in zip(found, want, strict=True))
    r = spark.createDataFrame([(1, 0, "ORDER", "Status=O", -1, "root"), (1, 1, "ITEM", "_", 0, "N"), (2, 0, "ORDER", "Status=F", -1, "root")], "graph_id long, tok int, upos string, feat string, head int, deprel string")
    found, want = fixtures.flat_rows(r), fixtures.flat(fixtures._nest(r))
    assert all(rows(f) == rows(w) for f, w in zip(found, want, strict=True))


@pytest.mark.parametrize("name", ["dep_nested", "plus", "dep_other_dir"])
def test_joins_bring_no_sentence_together(spark, sf_dir, name):
    shown = plan(catalogue.queries()[f"{name}_by_joins"](spark, sf_dir))
    assert "collect_list" not in shown and "struct(" not in shown and "lambda" not in shown


def test_postings_of_one_kind_write_no_index(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalogue, "index", None)
    found = catalogue.queries()["postings_lemma"](spark, sf_dir)
    words = [line.lower().split(" ") for line in TEXTS[:-1]]
    assert {(r.term, r.norm): (r.sentences, r.occurrences) for r in found.collect()}[("aaaa", 0)] == (7 * sum("aaaa" in w for w in words), 7 * sum(w.count("aaaa") for w in words))
