"""Patterns: reading, and both compilers against a plain evaluator of sets."""

import random

import pytest

from silvaq.engine import Engine
from silvaq.plans import ast, bracketed
from silvaq.plans.parser import parse
from silvaq.plans.prune import levels, required
from silvaq.plans.resolve import Symbols, resolve
from silvaq.sources import conllu, postings

READ = {
    "A & B >d C & D": "(where (and A B) [governs d (and C D)])",
    "A|B&C": "(or A (and B C))",
    "!A&B": "(and (not A) B)",
    "A + B >d C": "(plus A (where B [governs d C]))",
    "A + B (>d|>e) C": "(where (plus A B) [governs d or governs e C])",
    "A . B >d C": "(where A [near 1..1@R B] [governs d C])",
    "A . B . C": "(where A [near 1..1@R (where B [near 1..1@R C])])",
    "^A >d B": "(where A [no near 1..1@L _] [governs d B])",
    "A >d B $": "(where (where A [governs d B]) [no near 1..1@R _])",
    "A . B $": "(where A [near 1..1@R (where B [no near 1..1@R _])])",
    "^A $": "(where (where A [no near 1..1@R _]) [no near 1..1@L _])",
    "A -> B == C": "(equal (subset A B) C)",
    "(A >d B) >e C": "(where A [governs d B] [governs e C])",
    "A !!>d B": "(where A [no governs d B])",
    '"_" >!d@R L=x': "(where _ [governs other than d@R L=x])",
    "A >lin_2:3@R a.b": "(where A [near 2..3@R a.b])",
}


@pytest.mark.parametrize("text", READ)
def test_reading(text):
    assert ast.show(parse(text)) == READ[text]


@pytest.mark.parametrize("text", ["", "A (", "A >d B . C", "A >a|b", "A >lin_:3 B", "A >!lin B", "A\n", "A (!>d&>e) B", "A >d"])
def test_errors(text):
    with pytest.raises(ast.ExpressionError):
        parse(text)


def test_comments_go_to_their_set():
    assert parse("A >d B {max_tree_len=3}").comments == ["max_tree_len=3"]
    assert parse("A + B {max_tree_len=3}").comments == []


def test_required_terms():
    assert required(parse("A|B >d (C !>e D) !>f G")) == [("rel", "d"), ("tag", "C")]
    assert required(parse("(!A & B) <!d _ >x&>y L=z")) == [("tag", "B"), ("rel", "anyrel"), ("rel", "x"), ("rel", "y"), ("lemma", "z")]


def test_bare_words():
    symbols = Symbols({"NOUN"}, {"Nom": "Case=Nom"})
    assert ast.show(resolve(parse("NOUN & Nom > word"), symbols)) == '(where (and NOUN Case=Nom) [governs any "word"])'


CONSTRUCTIONS = {
    "[dep NP-Nom [amod big] [_ VP]]": '(where (and NOUN Nom) [governs amod "big"] [governs any VERB])',
    "[dep a b]": '(or (where "a" [near 1..1@R "b"]) (where "b" [near 1..1@L "a"]))',
    "[x  a]": '"a"',
    "[dep Cl [obj [dep a]]]": None,
    "[dep Cl [obj _]]": "(where VERB [governs nsubj _] [governs obj _])",
    "[dep [nsubj@L a [dep b c]] VP]": '(where VERB [governs nsubj@L (where "a" [governs any (or (where "b" [near 1..1@R "c"]) (where "c" [near 1..1@L "b"]))])])',
}


@pytest.mark.parametrize("text", CONSTRUCTIONS)
def test_constructions(text):
    if CONSTRUCTIONS[text] is None:
        with pytest.raises(ValueError):
            bracketed.tree(text)
    else:
        assert ast.show(bracketed.tree(text)) == CONSTRUCTIONS[text]


@pytest.mark.parametrize("text", ["", "a", "[dep]", "[dep a", "[dep a] b", "[ [x a]]", "[dep a]]", "[dep a b [x c]]"])
def test_wrong_constructions(text):
    with pytest.raises(ValueError):
        bracketed.tree(text)


def test_batches_of_constructions():
    assert [(n, ast.show(t)) for n, t in bracketed.read_batch(["one", "[dep a]", "", "[dep VP]", "two", "three", "[dep b]"])] == [("one", '"a"'), ("one", "VERB"), ("three", '"b"')]


def test_levels_of_a_plan():
    got = levels(parse("A|B >d (C !>e D)"))
    assert got[0][:2] == (2, True) and (2, False, "D") in got and (2, True, "C") in got and (1, True, "governs d") in got and got[-1][:2] == (0, True)


# A plain evaluator.


def related(s, r, t):
    n = len(s["form"])
    match r:
        case ast.Edge(other=True):
            return related(s, ast.Edge(r.governs, None), t) - related(s, ast.Edge(r.governs, r.name, r.side), t)
        case ast.Edge():
            hit = {(d if r.governs else g) for g, d, name, basic in s["edges"] if (g if r.governs else d) == t and (basic if r.name is None else name == r.name)}
        case ast.Linear():
            hit = {u for u in range(n) if abs(u - t) >= r.first and (r.last is None or abs(u - t) <= r.last)}
        case ast.Both():
            return related(s, r.left, t) & related(s, r.right, t)
        case ast.Either():
            return related(s, r.left, t) | related(s, r.right, t)
    return {u for u in hit if r.side is None or (u < t if r.side == "L" else u > t)}


def choice(sets, used=()):
    return not sets or any(u not in used and choice(sets[1:], (*used, u)) for u in sets[0])


def plain(s, node):
    every = set(range(len(s["form"])))
    match node:
        case ast.AnyToken():
            return every
        case ast.Form(word=w):
            return {i for i in every if s["form"][i] == w}
        case ast.Tag(name=t):
            return {i for i in every if s["upos"][i] == t}
        case ast.And():
            return plain(s, node.left) & plain(s, node.right)
        case ast.Or():
            return plain(s, node.left) | plain(s, node.right)
        case ast.Not():
            return every - plain(s, node.node)
        case ast.Plus():
            a, b = plain(s, node.left), plain(s, node.right)
            return a | b if a and b else set()
        case ast.Equal():
            a, b = plain(s, node.left), plain(s, node.right)
            return a if a == b else set()
        case ast.Subset():
            a, b = plain(s, node.left), plain(s, node.right)
            return a if a <= b else set()
        case ast.Restricted():
            out = set()
            for t in plain(s, node.head):
                no = all(not related(s, r.relation, t) & plain(s, x) for r, x in node.restrictions if isinstance(r, ast.Without))
                if no and choice([related(s, r, t) & plain(s, x) for r, x in node.restrictions if not isinstance(r, ast.Without)]):
                    out.add(t)
            return out


def random_sentences(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        size = rng.randint(1, 9)
        root = rng.randrange(size)
        heads = [-1 if i == root else rng.choice([j for j in range(size) if j != i]) for i in range(size)]
        names = [rng.choice("abc") for _ in range(size)]
        extra = [(rng.randrange(size), i, rng.choice("abc")) for i in range(size) if heads[i] >= 0 and rng.random() < 0.2]
        out.append({"form": [rng.choice("xyz") for _ in range(size)], "upos": [rng.choice(["N", "V", "A"]) for _ in range(size)], "heads": heads, "names": names, "extra": extra,
                    "edges": [(h, i, names[i], True) for i, h in enumerate(heads) if h >= 0] + [(g, d, x, False) for g, d, x in extra]})
    return out


def block(s):
    rows = []
    for i, form in enumerate(s["form"]):
        deps = "|".join(f"{g + 1}:{x}" for g, d, x in s["extra"] if d == i) or "_"
        rows.append("\t".join([str(i + 1), form, form, s["upos"][i], "_", "_", str(s["heads"][i] + 1), s["names"][i], deps, "_"]))
    return "\n".join(rows)


EXPRESSIONS = [
    "_", "N", "!N|V", "N >a V", "N <a@L V", "_ >!a _", "_ <!@R _", "N >a&>b _", "_ >a|<b@R A", "N !>a _", "_ >a _ >a _", "_ > N > _ > V", "N > (V > A) !<b (A|V)", "N . V", "^ N", "V $",
    "N + (V >a _)", "(N >a _) == (_ <b _)", "N -> (_ > _)", "N >lin_2:3@L V", "_ >lin_2: A", "(N + V) > (A -> (_ < _))", "_ {max_tree_len=5}", "N {min_tree_len=4}", '"x" & !"y" >lin_3 (N == V)', "!(N >a _)",
]


def test_compilers_agree_with_plain_sets(spark):
    sentences = random_sentences(150, 5)
    blocks = spark.createDataFrame([("s", i, block(s)) for i, s in enumerate(sentences)], "shard string, graph_id long, block string")
    engine = Engine(conllu.graphs(blocks).drop("edges").cache())
    engine.index = postings.postings(engine.graphs).cache()
    for i, text in enumerate(EXPRESSIONS):
        tree = parse(text)
        keep = [c for c in tree.comments]
        want = {(g, t) for g, s in enumerate(sentences) if not keep or (len(s["form"]) < 5 if "max" in keep[0] else len(s["form"]) > 4) for t in plain(s, tree)}
        ways = [{"how": "nested"}] + ([{"how": "relational"}] if i % 3 == 0 else []) + ([{"pruned": False}, {"pruned": True, "insensitive": True}] if i % 4 == 0 else [])
        for way in ways:
            got = {(r.graph_id, r.tok) for r in engine.hits(text, require_edge=False, **way).collect()}
            assert got == want, (text, way)


def test_identities(spark):
    sentences = random_sentences(80, 9)
    engine = Engine(conllu.graphs(spark.createDataFrame([("s", i, block(s)) for i, s in enumerate(sentences)], "shard string, graph_id long, block string")).cache())
    hits = lambda text: {(r.graph_id, r.tok) for r in engine.hits(text, require_edge=False).collect()}
    assert hits("!(N & V)") == hits("!N | !V")
    assert hits("N -> N") == hits("N + N") == hits("!(!N)") == hits("N")
    assert hits("N >a V >a V") <= hits("N >a V")
    assert hits("(N >a@L V) | (N >a@R V)") == hits("N >a V")


def test_search_output(spark):
    blocks = spark.createDataFrame([("s", 0, "# one\n1\tA\ta\tN\t_\t_\t2\tx\t_\t_\n2\tB\tb\tV\t_\t_\t0\troot\t_\t_"), ("s", 1, "1\tC\tc\tV\t_\t_\t0\troot\t_\t_")], "shard string, graph_id long, block string")
    g = conllu.graphs(blocks)
    engine = Engine(g.select("shard", "graph_id", "n", "tokens"), g.select("shard", "graph_id", "comments", "lines"))
    out = engine.search("V > _", context=1).collect()
    assert len(out) == 1
    assert out[0].block.split("\n")[:4] == ["# db-name: s", "# graph id: 0", "# visual-style\t2\tbgColor:lightgreen", "# hittoken:\t2\tB\tb\tV\t_\t_\t0\troot\t_\t_"]
    assert "# context-hit: A B\n# context-after: C\n1\tA" in out[0].block
    assert engine.explain("V > _") == "(where V [governs any _])"
    assert engine.hits("V").count() == 2 and engine.hits("_").count() == 2
    assert engine.hits('"a"').count() == 0 and engine.hits('"a"', insensitive=True).count() == 1
    assert "Exchange" not in engine.explain("V > _", "formatted")
