"""Reading, normalising, indexing and checking CoNLL-U; the catalog."""

import pytest

from silvaq import corpora
from silvaq.engine import Engine
from silvaq.functions import validation
from silvaq.sources import conllu, postings
from silvaq.streaming import ingest

TREE = """# text
1-2\tMW\t_\t_\t_\t_\t_\t_\t_\t_
1\tDogs\tDog#s\tNOUN\t_\tCase=Nom|Odd\t2\tn_s\t2.1:e_x|0:root\t_
2\trun\trun\tVERB\t_\t_\t0\troot\t1:back\t_
2.1\tnull\tnull\tX\t_\t_\t_\t_\t1:lost\t_
3\t.\t.\t_\t_\t_\t2.1\tpunct\t_\t_"""


def rows(spark, *blocks):
    return spark.createDataFrame([("s", i, b) for i, b in enumerate(blocks)], "shard string, graph_id long, block string")


def test_normalisation(spark):
    g = conllu.graphs(rows(spark, TREE)).first()
    assert g.n == 4 and g.comments == ["# text"] and len(g.lines) == 4
    t = g.tokens
    assert t[0].form_norm == "dogs" and t[0].lemma_norm == "dogs" and t[1].form_norm is None
    assert t[0].tags == ["NOUN", "Case=Nom", "Case", "Odd"] and t[2].tags == ["X", "Nullnode=Nullnode", "Nullnode"] and t[3].tags == []
    assert {(e.gov, e.dep, e.dtype, e.basic) for e in g.edges} == {(1, 0, "n-s", True), (2, 0, "e-x", False), (2, 3, "punct", True)}


@pytest.mark.parametrize("bad", ["1\ta\ta\tN\t_\t_\t9\tx\t_\t_", "1\ta\ta", "1\ta\ta\tN\t_\t_\t0\troot\t_\t_\n# late"])
def test_wrong_input_fails(spark, bad):
    with pytest.raises(Exception, match="no row has|ten fields|follows a token"):
        conllu.graphs(rows(spark, bad)).collect()


def test_reader_shards_and_index(spark, tmp_path):
    one = "1\tw{}\tw\tN\t_\t_\t0\troot\t_\t_"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.conllu").write_text("\n\n".join(one.format(i) for i in range(7)) + "\n\n")
    read = conllu.read_blocks(spark, str(tmp_path / "in"), most=6, skip=1, shard_size=3)
    assert [(r.shard, r.graph_id, r.block.split("\t")[1]) for r in read.orderBy("shard", "graph_id").collect()] == [("trees_00000", 0, "w1"), ("trees_00000", 1, "w2"), ("trees_00000", 2, "w3"), ("trees_00001", 0, "w4"), ("trees_00001", 1, "w5")]
    conllu.write_index(conllu.graphs(read).drop("edges"), str(tmp_path / "index"))
    engine = Engine.load(spark, [str(tmp_path / "index")], shards=["trees_00001"])
    assert engine.hits("N", require_edge=False).count() == 2
    q = ingest.follow(spark, str(tmp_path / "in"), str(tmp_path / "live"), str(tmp_path / "state"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "live" / "batch=00000000" / "graphs")).count() == 7


def test_length_limit(spark):
    long = "\n".join(f"{i}\tw\tw\tN\t_\t_\t0\troot\t_\t_" for i in range(1, 258))
    g = conllu.searchable(conllu.graphs(rows(spark, long, long.rsplit("\n", 1)[0])))
    assert [r.n for r in g.collect()] == [256]


def test_documents(spark):
    w = "1\t{}\t_\tX\t_\t_\t0\troot\t_\t_"
    found = conllu.with_documents(rows(spark, w.format("a"), w.format("####FIPBANK-BEGIN-MARKER:http://u"), w.format("b"), '###C:<doc id="1" url="v">\n' + w.format("c"), "###C:</doc>\n" + w.format("d"))).orderBy("graph_id").collect()
    assert [(r.graph_id, r.url) for r in found] == [(0, None), (1, "http://u"), (2, "v"), (3, None)]
    assert found[1].comments == ["# URL: http://u", "# DOC/SENT: 0/0"]


def test_symbols_and_postings(spark):
    g = conllu.graphs(rows(spark, TREE))
    s = {(r.symbol, r.s_type, r.full_form): r.cnt for r in postings.symbols(g).collect()}
    assert s[("Nom", "VAL", "Case=Nom")] == 1 and s[("Odd", "CAT=VAL", None)] == 1 and ("anyrel", "DTYPE", None) not in s
    p = {(r.kind, r.term, r.norm): r.positions for r in postings.postings(g).collect()}
    assert p[("token", "dogs", 1)] == [0] and p[("rel", "anyrel", 0)] == [1, 2] and p[("tag", "Case", 0)] == [0]


def test_checks(spark):
    bad = "1\ta\ta\tN\t_\tB=1|A=2\t7\tx\t1:y|0:z\t_\n1\tb\tb\tN\t_\t_\t0\troot\t_\t_"
    r = validation.rows(rows(spark, bad))
    assert {x.issue for x in validation.sentence_issues(r).collect()} == {"repeated id", "words out of sequence", "unknown head"}
    assert {x.issue for x in validation.field_issues(r).collect()} == {"feats order", "deps order"}
    assert [(x.id, x.head) for x in validation.repaired(r).collect()] == [("1", "_")]


def test_catalog():
    files = {"/c/*": ["/c/UD_Fi", "/c/UD_En"], "/x": ["/x"]}
    listing = lambda p: files.get(p, [])
    c = corpora.load({"X": {"paths": "/x /none", "name": "ex"}, "wildcard_\\1-v1": {"pathglob": "/c/*", "pathre": "/c/UD_(.*)", "name": "\\1 (v1)"}}, listing)
    assert sorted(c) == ["En-v1", "Fi-v1", "X"] and c["Fi-v1"].name == "Fi (v1)" and c["X"].shards == ["/x"]
    assert [x.id for x in corpora.groups(c, [{"name": "all", "corpora": ".*-v1 X"}])["all"]] == ["En-v1", "Fi-v1", "X"]
    assert [x.id for x in corpora.find(c, ["ex", "Fi-v1", "no"])] == ["X", "Fi-v1"]


def test_reader_ends_sentences_at_blank_lines(spark, tmp_path):
    """Carriage returns, blank lines with spaces in them, several in a row, none at the end."""
    one = "1\tw{}\tw\tN\t_\t_\t0\troot\t_\t_"
    (tmp_path / "a.conllu").write_bytes("\r\n\r\n".join(one.format(i) for i in range(4)).encode())
    (tmp_path / "b.conllu").write_text("\n" + one.format(4) + "\n \t\n" + one.format(5) + "\n\n\n" + one.format(6) + "\n  \n\n")
    for name, want in (("a", ["w0", "w1", "w2", "w3"]), ("b", ["w4", "w5", "w6"])):
        blocks = conllu.read_blocks(spark, str(tmp_path / f"{name}.conllu"))
        assert [r.block.split("\t")[1] for r in blocks.orderBy("graph_id").collect()] == want
        assert [t.form for r in conllu.graphs(blocks).orderBy("graph_id").collect() for t in r.tokens] == want
    both = conllu.read_blocks(spark, [str(tmp_path / "a.conllu"), str(tmp_path / "b.conllu")])
    assert conllu.graphs(both).count() == 7


def test_written_index_prunes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FREQUENT", 1.0)
    one = "1\t{0}\t{0}\tN\t_\tCase=Nom\t0\troot\t_\t_\n2\tb\tb\tV\t_\t_\t1\tx\t_\t_"
    g = conllu.graphs(rows(spark, *[one.format(w) for w in ("Dog", "dog", "cat", "Dog")]))
    conllu.write_index(g, str(tmp_path / "i"))
    engine = Engine.load(spark, [str(tmp_path / "i")])
    assert engine.symbols.values == {"Nom": "Case=Nom"} and {r.kind for r in engine.index.select("kind").distinct().collect()} == set(postings.ALL)
    ids = lambda *a, **k: sorted(r.graph_id for r in engine.hits(*a, **k).collect())
    assert ids('"Dog" >x V') == [0, 3] and ids('"dog"', insensitive=True) == [0, 1, 3] and ids("dog & Nom") == [1]
    assert ids('"Dog"') == ids('"Dog"', pruned=False) and ids("!N") == [0, 1, 2, 3]
    plan = engine.hits('"Dog" >x V')._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(term,Dog)" in plan and "kind" in plan.split("PartitionFilters: [", 1)[1]
    with pytest.raises(ValueError):
        Engine(engine.graphs).hits("N", pruned=True)
    assert "# graph id: 1" in engine.search("dog").collect()[0].block
    assert [(n, df.count()) for n, df in engine.batch(["all", "[dep Dog [x b]]", "[dep nothing]"], limit=1)] == [("all", 1), ("all", 0)]
