"""The web service, what trees are drawn from, and closures over edges."""

import json
import random
import threading
from wsgiref.simple_server import WSGIRequestHandler, make_server

import pytest
from pyspark.sql import functions as F

from silvaq import service
from silvaq.functions import display
from silvaq.operators import subtrees
from silvaq.sources import conllu

ONE = "# a\n1\t{0}\t{0}\tN\t_\t_\t2\tx\t_\t_\n2\tb\tb\tV\t_\t_\t0\troot\t_\t_"


@pytest.fixture(scope="module")
def app(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("served")
    rows = [("s1" if i < 2 else "s2", i, ONE.format(w)) for i, w in enumerate(("Dog", "dog", "cat"))]
    conllu.write_index(conllu.graphs(spark.createDataFrame(rows, "shard string, graph_id long, block string")), f"{path}/pets")
    return service.Service(spark, {"P": {"name": "Pets", "paths": f"{path}/pets"}, "S": {"name": "Half", "paths": f"{path}/pets/graphs/shard=s1"}}, [{"name": "all", "corpora": "P S"}])


def get(app, query="", path="/"):
    seen = {}
    body = app({"PATH_INFO": path, "QUERY_STRING": query}, lambda status, headers: seen.update(status=status, headers=dict(headers)))
    return seen["status"], seen["headers"], b"".join(body).decode()


def test_requests(app):
    assert json.loads(get(app, path="/metadata")[2]) == {"corpus_groups": [{"name": "all", "corpora": [["P", "Pets"], ["S", "Half"]]}]}
    assert get(app)[0] == "200 OK" and "retmax" in get(app)[2] and get(app, path="/x")[0] == "404 Not Found"
    marks = lambda q: get(app, q)[2].count("# hittoken")
    assert marks("search=V&db=P") == 3 and marks("search=V&db=Half") == 2 and marks("search=V&db=P,Half&retmax=1") == 1
    assert marks("search=%22dog%22&db=P") == 1 and marks("search=%22dog%22&db=P&i") == 2 and marks("search=%22dog%22&db=P&case=False") == 2
    assert "# context-after: dog b" in get(app, "search=%22Dog%22&db=P&context=1")[2] and marks("search=V&db=P&shuffle") == 3
    assert get(app, "search=V&db=P&dl")[1]["Content-Disposition"].endswith("conllu")
    assert get(app, "search=V+%3E&db=P")[2].startswith("# Error in query") and get(app, "search=V&db=none")[2].startswith("# No such")
    assert get(app, "search=V&db=P&context=x")[0] == "400 Bad Request"


def test_client(app):
    class Quiet(WSGIRequestHandler):
        def log_message(self, *_):
            pass

    with make_server("127.0.0.1", 0, app, handler_class=Quiet) as server:
        threading.Thread(target=server.handle_request, daemon=True).start()
        lines = list(service.ask(f"http://127.0.0.1:{server.server_port}/", '"cat"', "P", retmax=5))
    assert "# graph id: 2" in lines and lines[-2].startswith("2\tb")


DRAWN = """# visual-style 2 bgColor:red
# visual-style nodes bgColor:blue
# visual-style nodes fgColor:white
# visual-style arcs green
# visual-style 2 1 x color:black
# visual-style 1 pink
# sentence-label one
# sentence-label two
1-2\tABcd\t_\t_\t_\t_\t_\t_\t_\t_
1\tAB\tab\tN\tNN\tCase=Nom,Acc\t2\tx\t3:y\tM=1
2\tcd\tcd\tV\t_\t_\t0\troot\t_\t_
2.1\tnone\t_\t_\t_\t_\t_\t_\t_\t_
3\tאב\t_\tX\t_\t_\t2\tz\t_\t_"""


def test_drawing(spark):
    b = spark.createDataFrame([(7, DRAWN)], "graph_id long, block string")
    table = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    assert table(display.text(b)) == [("AB cd בא\nABcd בא",)]
    assert table(display.entities(b)) == [("1", "N", 0, 2), ("2", "V", 3, 5), ("3", "X", 6, 8)]
    assert table(display.attributes(b)) == [("1", "Case", "Acc"), ("1", "Case", "Nom")]
    assert table(display.relations(b)) == [("2", "1", "x"), ("2", "3", "z"), ("3", "1", "y")]
    assert table(display.notes(b)) == [("1", "Lemma: ab"), ("1", "Misc: M=1"), ("1", "Postag: NN"), ("2", "Lemma: cd"), ("3", "Lemma: _")]
    assert table(display.labels(b)) == [("two",)]
    assert table(display.resolved_styles(b)) == [
        ("1", "bgColor", "pink"), ("1", "fgColor", "white"), ("2", "bgColor", "red"), ("2", "fgColor", "white"), ("2 1 x", "color", "black"),
        ("2 3 z", "color", "green"), ("3", "bgColor", "blue"), ("3", "fgColor", "white"), ("3 1 y", "color", "green"),
    ]
    plain = b.select("graph_id", F.lit("1\ta\ta\tN\t_\t_\t0\troot\t_\t_").alias("block"))
    assert table(display.relations(plain)) == table(display.resolved_styles(plain)) == table(display.labels(plain)) == []


def test_closures(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        n = rng.randint(1, 12)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 14))]  # cycles among them
        rows.append((i, n, edges, sorted(rng.sample(range(n), rng.randint(0, min(n, 2))))))
    df = spark.createDataFrame(rows, "i int, n int, edges array<struct<gov:int,dep:int>>, chosen array<int>")
    e = F.col("edges")
    got = df.select("i", subtrees.descendants(e, F.col("chosen"), F.col("n")).alias("below"), subtrees.children(e, F.col("chosen")).alias("next"), subtrees.neighbours(F.col("n"), 2, 3).alias("near"), subtrees.add_edge(e, F.lit(0), F.lit(0)).alias("more")).collect()
    for r in got:
        _, n, edges, chosen = rows[r.i]
        below, new = set(chosen), set(chosen)
        while new:
            new = {d for g, d in edges if g in new} - below
            below |= new
        assert r.below == sorted(below) and r.next == sorted({d for g, d in edges if g in chosen}) and {tuple(x) for x in r.more} == {*edges, (0, 0)}
        assert r.near == [[u for u in range(n) if 2 <= abs(u - t) <= 3] for t in range(n)]
