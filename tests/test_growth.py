"""What work grows with: scans, plans and passes of the queries that larger tables made slow."""

import hashlib

from pyspark.sql import functions as F

from millrace import views as V
from millrace.operators import extraction as X
from millrace.operators import model_store as MS
from millrace.operators import models as M
from millrace.operators import payloads as P
from millrace.operators import reviews as R
from millrace.operators import statistics as S
from millrace.plans import QUERIES
from millrace.plans import job_queries as J
from millrace.plans import score_queries as C
from millrace.views import ASPECTS, aspect_scores

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_training_rows_read_the_lines_three_times_and_build_no_map(spark):
    plan = _plan(J._training(spark, SF))
    assert sum("Relation" in line and "l_partkey" in line for line in plan.splitlines()) == 3
    assert "map(" not in plan


def test_aspect_aggregates_know_missing_and_null_entries(spark):
    rows = spark.createDataFrame([("a", {"x": 2.0, "y": None}, 0.5), ("a", {"x": 4.0}, 0.5), ("a", {"x": 9.0, "y": 9.0}, 0.1)], "k string, scores map<string,double>, confidence double")
    (row,) = X.aspect_aggregates(rows, "k", ("x", "y")).collect()
    assert (row.x_mean, row.x_rate, row.y_mean, row.y_rate) == (3.0, 1.0, None, 0.0)
    flat = rows.select("k", "confidence", *(F.col("scores")[a].alias(a) for a in "xy"))
    assert X.aspect_aggregates(flat, "k", ("x", "y"), None).collect() == [row]
    parts = [X.aspect_aggregates(aspect_scores(spark, SF, flat=f), "product_uid", ASPECTS, s) for f, s in ((False, "scores"), (True, None))]
    assert "map(" in _plan(parts[0]) and "map(" not in _plan(parts[1])
    assert sorted(parts[0].collect()) == sorted(parts[1].collect())


def test_fingerprint_of_values(spark):
    rows = [("x", None, 1.5), (None, "x", 2.5), ("y", "z", None)]
    print_ = lambda r: S.values_fingerprint(spark.createDataFrame(r, "a string, b string, c double"), ["a", "b", "c"]).first()
    assert print_(rows) == print_(rows[::-1]) != print_([(None, "x", 1.5), ("x", None, 2.5), ("y", "z", None)])
    assert print_([("x", None, 1.5)]) != print_([(None, "x", 1.5)])


def test_payloads_are_read_once(spark):
    plan = _plan(QUERIES["json_validate_coerce"](spark, SF))
    assert plan.count("$.scores") == 1 and plan.count("try_variant_get") < 30
    texts = ['{"scores":{"a":{"score":12,"evidence":"\\t yes "},"b":null,"c":[1]},"confidence":null}', '{"scores":{"a":{"score":{"value":3},"evidence":"abc"}}}', '{"scores":"{}"}', "[1]", "1", "{", None]
    rows = P.coerced(P.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t"), "parsed", ("a", "b", "c"))
    assert rows.columns == ["i", "t", "parsed", "scores", "confidence", "n_coerced", "rejected"]
    out = rows.orderBy("i").select(F.col("scores")["a"]["score"], F.col("scores")["a"]["evidence"], "confidence", "n_coerced", "rejected").collect()
    assert [tuple(r) for r in out[:2]] == [(10.0, "yes", 0.5, 3, None), (None, None, 0.5, 1, None)]
    assert [tuple(r)[2:] for r in out[2:]] == [(0.5, 0, e) for e in ("no_scores", "not_an_object", "not_an_object", "not_json", "not_json")]


def test_samples_are_collected_without_another_sort(spark):
    same = [("a", i, t) for i, t in enumerate(["x y z", "x\ty\nz", "x y z", "X Y Z", "", None, "q r s"])]
    many = [("b", i, f"w{i} v{i}" if i % 2 else "one two three") for i in range(100)]
    rows = spark.createDataFrame(same + many, "k string, u long, t string")
    out = R.near_duplicates(rows, "k", "u", "t")
    assert "collect_list" not in "".join(line for line in _plan(out).splitlines() if "Aggregate" in line)
    taken = [t for _, _, t in sorted(many, key=lambda r: hashlib.md5(f"42|{r[1]}".encode()).hexdigest())[:60]]
    assert {r.k: r.dup_share for r in out.collect()} == {"a": 3 / 7, "b": taken.count("one two three") / 60}


def test_training_rows_come_of_lines_that_are_read_once(spark, tmp_path):
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp, l_quantity double, l_returnflag string, l_linestatus string, l_discount double"
    line = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("*", "l_partkey % 5 = 0 as unsure").withColumn("l_discount", F.expr("if(unsure, 0.01, l_discount)"))
    line.select(*(c.split()[0] for c in schema.split(", "))).write.parquet(f"{tmp_path}/lineitem.parquet")  # a fifth of the products have no confident review
    spark.read.parquet(f"{SF}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    once, thrice = J.training_rows(spark, str(tmp_path)), J._training(spark, str(tmp_path))
    assert once.columns == thrice.columns and "lineitem" not in "".join(once.inputFiles())
    got, want = ({r.product_uid: r.asDict() for r in rows.collect()} for rows in (once, thrice))
    assert got.keys() == want.keys() and any(r["utility"] is None for r in want.values()) and any(r["utility"] is not None for r in want.values())
    near = lambda a, b: a == b or (None not in (a, b) and abs(a - b) < 1e-9)
    assert all(near(v, want[k][c]) if not isinstance(v, str) else v == want[k][c] for k, r in got.items() for c, v in r.items())
    lines = C.profiled_products(spark, str(tmp_path))
    assert C._category_means(spark, str(tmp_path), lines).count() == C._category_means(spark, str(tmp_path)).count() > 0


def test_sets_of_columns_share_folds_and_trees_see_no_constant_indicator(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "cast(id % 7 as double) as a", "if(id % 4 = 0, null, cast(id % 11 as double)) as b", "cast(id % 7 * 3 + id % 11 as double) as y")
    assert M.gappy(df, ["a", "b"]) == ["b"] and M.gappy(df.withColumn("b", F.lit(None).cast("double")), ["a", "b"]) == []
    assert M.vectors(df, ["a", "b"], ["b"]).first().features.size == 3
    written, folded = [], M.folded
    monkeypatch.setattr(M, "folded", lambda *args: written.append(1) or folded(*args))
    sets = M.out_of_fold_sets(df, "id", "y", {"both": ["a", "b"], "one": ["a"]}, 3, 5)
    assert len(written) == 1
    for name, columns in (("both", ["a", "b"]), ("one", ["a"])):
        ready = folded(df, "id", columns, 3)  # with all indicators
        want = {r.id: (r.fold, r.prediction) for r in M._fitted(ready, "y", "boosted_trees", 3, 5)[0].collect()}
        assert {r.id: (r.fold, r.prediction) for r in sets[name].collect()} == want and len(want) == 300


def test_stored_trees_keep_the_indicators_of_columns_with_gaps_only(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "cast(id % 7 as double) as a", "if(id % 4 = 0, null, cast(id % 11 as double)) as b", "cast(id % 5 as double) as c", "cast(id % 7 * 3 + id % 11 as double) as y")
    MS.train(df, f"file://{tmp_path}/m", "id", "y", ["a", "b", "c"], rounds=5)
    model = MS.load(spark, f"file://{tmp_path}/m", ["a", "b", "c"])
    assert model.marked == ("b",) and model.model.numFeatures == 4
    ready = M.vectors(df, ["a", "b", "c"]).withColumn("validation", F.expr("pmod(xxhash64(md5(concat_ws('|', 'v', id))), 10) = 0"))
    whole = M.learners("y", 5)["boosted_trees"].fit(ready)  # with all indicators
    want = {r.id: r.prediction for r in whole.transform(ready).collect()}
    assert {r.id: r.p for r in model.predict(df, "p").collect()} == want
    parts = model.explain(df, ["id"]).collect()
    assert len(parts) == 300 and all(abs(r.a + r.b + r.c + r.base - want[r.id]) < 1e-9 for r in parts) and any(r.b for r in parts)
    assert "marked" in spark.read.json(f"file://{tmp_path}/m/manifest").columns


def test_batch_predict_reads_the_lines_once_and_joins_no_explanations(spark, monkeypatch):
    read, table = [], V.table
    monkeypatch.setattr(V, "table", lambda spark, sf_dir, name: read.append(name) or table(spark, sf_dir, name))
    predicted = J.predicted
    monkeypatch.setattr(J, "predicted", lambda specs, models, key: read.append(specs) or predicted(specs, models, key))
    out = QUERIES["batch_predict"](spark, SF)
    *names, specs = read
    assert names.count("lineitem") == 1
    assert _plan(out).count("Join ") == _plan(specs).count("Join ")
    assert sum("Join Inner, (category" in line and "rightHint=(strategy=broadcast)" in line for line in _plan(specs).splitlines()) == 2  # rows of categories, so products are not dealt by category or by a task
    assert out.columns == ["product_uid", "category", "viability", "full_model", "category_mean", "success_p75", "grade", "model_version", "top_risks", "top_strengths"]
