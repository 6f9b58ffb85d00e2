"""The pipeline's stages on a small corpus."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(300):
        t = [rng.choice(words) for _ in range(30)]
        y = int(i % 4 == 0)
        if y:
            t[3:3] = ["vileword", "vileword"]
        rows.append((i, " ".join(t), "en", f"s{i % 3}", 0))
        labels.append((i, 1, y))
    rows += [(900, rows[1][1], "en", "s1", 0), (901, ' '.join(reversed(rows[2][1].split())) + ' token = "abcdef0123456789"', "en", "s1", 0), (902, None, "en", "s1", 0), (903, "", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {i for i, _, y in labels if y}
    one = stages["ngram_join"](spark, clean, str(tmp_path)).cache()
    assert {r.doc_id for r in clean.collect()} - {r.doc_id for r in one.collect()} == {900}
    hidden = stages["secrets"](spark, one, str(tmp_path)).cache()
    assert {r.doc_id: r.text for r in hidden.collect()}[901].endswith(' [secret]"') and hidden.count() == one.count() and hidden.columns == docs.columns
    mixed = stages["mixing"](spark, hidden, str(tmp_path))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in hidden.collect()}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(last) == mixed.count() and all(r.round_trip for r in last)


def test_near_copies(spark):
    """Copies whose 5-word Jaccard is 0.8 to 0.9 go, one just below 0.8 stays."""
    rng = random.Random(4)
    base, other = ([f"w{rng.randrange(10**9)}" for _ in range(n)] for n in (100, 200))
    more = [f"x{i}" for i in range(25)]
    changed = [f"y{i}" if i in (40, 80, 120, 160) else w for i, w in enumerate(other)]
    rows = [(1, base), (2, base + more[:20]), (3, base + more), (10, other), (11, changed)]  # of 5-grams: 96/116, 96/121, 176/216
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, "").collect()}
    assert kept == {1, 10}  # 3 hangs together with 1 by way of 2: 116/121
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs.where("doc_id <> 2"), "").collect()}
    assert kept == {1, 3, 10}


def test_null_and_repeated_ids_keep_each_group(spark):
    rng = random.Random(6)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c), (3, ""), (3, e), (4, None), (4, ""), (None, " "), (None, e + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, "").collect()]
    want = [(None, a), (None, b), (1, c), (1, d), (3, ""), (3, e), (4, None), (4, ""), (None, " ")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_and_columns(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, rows that repeat, and columns whose names the operators use."""
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    names = ["score", "row", "key", "mark", "every", "ends", "silvaq_assign", "position", "node", "part", "n"]
    rows = [(i, text(40), "s0") for i in range(30)]
    rows += [(None, text(30), "s1"), (None, text(30), None), (5, text(30), "s1"), (5, rows[5][1], "s0"), (40, None, "s0"), (41, "", "s1"), (42, " \n", None), (43, text(60_000), "s1"), (44, "z" * 300_000, "s0")]
    rows += [rows[7]] * 3
    full = [(i, t, "en", s, 1, *["clash"] * len(names)) for i, t, s in rows]
    spark.createDataFrame(full, SCHEMA + "".join(f", `{n}` string" for n in names)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns and all(r[n] == "clash" for r in docs.collect() for n in names)
        seen[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert seen["toxicity"] == sorted(((i, t) for i, t, _ in rows), key=repr)
    once = {(i, t) for i, t, _ in rows}
    assert seen["ngram_join"] == seen["secrets"] == sorted(once, key=repr)
    assert set(seen["mixing"]) <= {(i, t) for i, t in once if t and t.strip()}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(last) == len(seen["mixing"]) and all(r.round_trip for r in last)
