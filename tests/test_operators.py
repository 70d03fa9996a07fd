"""Edge cases of the operators on small frames, leakage and determinism."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import parse, vectors
from cohortloom.operators import calibration, cohorts, experiments, labels, matrix, metrics, models, resampling, shift, splits
from cohortloom.streaming.votes import windowed_counts


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_strict_parsing_refuses_what_is_unsure(spark):
    df = spark.createDataFrame([("true",), (" 1 ",), ("False",), ("1.0",), ("",), (None,), ("yes",)], "t string")
    assert [r[0] for r in df.select(parse.strict_bool(F.col("t"))).collect()] == [True, True, False, None, None, None, None]
    assert [r[0] for r in df.select(parse.strict_bool(F.col("t"), trim=False)).collect()][1] is None
    ids = spark.createDataFrame([("2.0",), ("2.5",), ("x",), (None,)], "t string")
    assert [r[0] for r in ids.select(parse.integral(F.col("t"))).collect()] == [2, None, None, None]


def test_qc_and_normalisation_of_cells_without_counts(spark):
    counts = spark.createDataFrame([("a", "g1", 1.0), ("a", "MT-1", 9.0), ("b", "g1", 2.0), ("b", "g2", 2.0), ("c", "g1", 0.0)], "cell_id string, gene string, value double")
    assert rows(matrix.qc_filter(counts, 1, 1), "cell_id", "gene") == [("b", "g1"), ("b", "g2")]
    out = {(r["cell_id"], r["gene"]): r["value"] for r in matrix.log_normalize(counts).collect()}
    assert out["c", "g1"] == 0.0 and math.isclose(out["b", "g1"], math.log1p(5000))


def test_statistics_ignore_held_out_rows(spark):
    cells = spark.range(20).select(F.col("id").alias("cell_id"), (F.col("id") < 12).alias("train"))
    value = F.when(F.col("train"), F.col("cell_id").cast("double"))
    clean = cells.select("cell_id", F.lit("g").alias("gene"), F.coalesce(value, F.lit(1.0)).alias("value"))
    broken = cells.select("cell_id", F.lit("g").alias("gene"), F.coalesce(value, F.lit(1e6)).alias("value"))
    train = cells.where("train")
    assert rows(matrix.gene_stats(clean, train), "mean", "std") == rows(matrix.gene_stats(broken, train), "mean", "std")


def test_scaling_counts_absent_values_as_zero(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    expr = spark.createDataFrame([("a", "g", 2.0)], "cell_id string, gene string, value double")
    out = rows(matrix.scale(expr, cells, matrix.gene_stats(expr, cells)), "cell_id", "value")
    assert out == [("a", 1.0), ("b", -1.0)]


def test_markers_replace_the_last_genes_in_order(spark):
    expr = spark.createDataFrame([(c, f"g{k}", float((c * (k + 1)) % 7)) for c in range(12) for k in range(9)], "cell_id int, gene string, value double")
    plain = {r[0] for r in matrix.highly_variable(expr, 4).collect()}
    marker = sorted({f"g{k}" for k in range(9)} - plain)[0]
    forced = {r[0] for r in matrix.highly_variable(expr, 4, [marker]).collect()}
    assert forced == plain - {max(plain)} | {marker}


def test_orders_do_not_depend_on_partitions(spark):
    s = spark.range(100).select(F.concat(F.lit("s"), "id").alias("subject_id"), (F.col("id") % 3).alias("label"))
    for f in (lambda x: splits.train_val_test(x, 0.6, 0.2, 1), lambda x: splits.grouped_folds(x, 5, 1), lambda x: splits.cap_rows(x, "label", "subject_id", 4, 1)):
        a, b = f(s.repartition(1)), f(s.repartition(17))
        assert rows(a, *a.columns) == rows(b, *b.columns)


def test_small_classes_are_pooled_and_none_lost(spark):
    s = spark.createDataFrame([(f"s{i}", 0 if i < 19 else 1 if i == 19 else None) for i in range(24)], "subject_id string, label int")
    out = splits.train_val_test(s, 0.7, 0.15, 3)
    assert out.count() == 24
    per = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert per[0, "test"] >= 1 and per[0, "val"] >= 1 and sum(v for (k, _), v in per.items() if k is None) == 4


def test_fingerprint_follows_content_alone(spark):
    s = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    one = splits.fingerprint(s.repartition(3), "x", "a", "b").first()[0]
    assert one == splits.fingerprint(s.orderBy(F.desc("a")), "x", "a", "b").first()[0]
    assert one != splits.fingerprint(s.where("a <> 4"), "x", "a", "b").first()[0] and one != splits.fingerprint(s, "y", "a", "b").first()[0]


def test_verified_subjects_need_every_title(spark):
    df = spark.createDataFrame([("a", "Patient 1"), ("b", "patient_2")], "sample_id string, title string")
    assert rows(labels.verified_subjects(df), "subject_id", "subject_id_verified") == [("patient_1", True), ("patient_2", True)]
    for other in ("patient 1", None):
        bad = df.unionAll(spark.createDataFrame([("c", other)], df.schema))
        assert {r["subject_id_verified"] for r in labels.verified_subjects(bad).collect()} == {False}


def test_orthologs_one_to_one(spark):
    pairs = spark.createDataFrame([("m1", "h1"), ("m2", "h2"), ("m3", "h3"), ("m3", "h4"), ("m4", "h5"), ("m5", "h5"), ("m6", "h6"), ("m6", "h6"), ("", "h7")], "mouse_gene string, human_gene string")
    assert rows(labels.ortholog_map(pairs), "mouse_gene", "human_gene") == [("m1", "h1"), ("m2", "h2")]
    assert ("m3", "h3") in rows(labels.ortholog_map(pairs, "keep_best"), "mouse_gene", "human_gene")


def test_policies_fail_closed(spark):
    cells = spark.createDataFrame([(1, False), (2, True)], "cell_id int, is_pseudo_bulk boolean")
    for policy in ("single_cell_only", "bulk_only", "multimodal"):
        with pytest.raises(cohorts.ContractError):
            cohorts.assert_rows_match_policy(cells, policy)
    assert cohorts.assert_rows_match_policy(cells.where("is_pseudo_bulk"), "bulk_only").count() == 1


def test_one_class_has_no_ranking(spark):
    p = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.9), ("b", 1, 0.5), ("b", 0, 0.5)], "g string, y_true int, y_prob double")
    assert rows(metrics.ranking_metrics(p, ["g"]), "g", "auroc") == [("a", None), ("b", 0.5)]
    assert metrics.at_threshold(p.where("g = 'a'"), 0.5).first()["sensitivity"] is None


def test_bins_follow_the_double_edges(spark):
    p = spark.createDataFrame([(0.3,), (0.30000000000000004,), (1.0,), (0.0,), (0.7,)], "p double")
    assert [r[0] for r in p.select(metrics.bin_index(F.col("p"))).collect()] == [2, 3, 9, 0, 6]


def test_thresholds(spark):
    p = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "y_true int, y_prob double")
    assert calibration.select_threshold(p).first()["threshold"] == 0.4
    assert calibration.select_threshold(p.where("y_true = 1")).first()["threshold"] == 0.5


def test_calibrators(spark):
    p = spark.createDataFrame([(int(i % 10 < i // 20), i / 200) for i in range(200)], "y_true int, y_prob double")
    iso = calibration.fit_calibrator(p)
    assert iso.method == "isotonic"
    got = [r["y_prob"] for r in iso.apply(p.withColumn("k", F.col("y_prob"))).orderBy("k").collect()]
    assert got == sorted(got) and 0 <= got[0] <= got[-1] <= 1
    assert calibration.fit_calibrator(p.limit(30)).method in ("sigmoid", "none") and calibration.fit_calibrator(p.where("y_true = 1")).method == "none"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [True, False, True], [False, False, False])], "x array<double>, m array<boolean>, n array<boolean>")
    r = df.select(vectors.softmax(F.col("x")).alias("s"), vectors.masked_softmax(F.col("x"), F.col("m")).alias("m"), vectors.masked_softmax(F.col("x"), F.col("n")).alias("n")).first()
    assert math.isclose(sum(r["s"]), 1) and math.isclose(sum(r["m"]), 1) and r["m"][1] == 0 and r["n"] == [0, 0, 0]
    assert math.isclose(df.select(vectors.binary_entropy(F.lit(0.5))).first()[0], math.log(2))


def test_out_of_fold_rows_are_predicted_once(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(60).select(F.col("id").alias("subject_id"), (F.col("id") % 2).cast("double").alias("y_true"), (F.col("id") % 3).alias("fold"), array_to_vector(F.array((F.col("id") % 2 + F.rand(1)).cast("double"), F.rand(2))).alias("features"))
    out = models.out_of_fold(df, "logistic")
    assert out.count() == 60 and out.select("subject_id").distinct().count() == 60
    assert splits.oof_problems(df, out.select("subject_id", F.col("y_prob").alias("p"), "fold", F.col("fold").alias("subject_fold"))).count() == 0
    assert metrics.ranking_metrics(out).first()["auroc"] > 0.8
    assert models.fit_candidate(df.where("y_true = 1"), "logistic").predict(df).select("y_prob").distinct().collect()[0][0] == 1.0
    assert len(models.nested_selection(df, "logistic")) == 3


def test_bootstrap_of_one_row_is_undefined(spark):
    one = spark.createDataFrame([(1, 2.0)], "k int, v double")
    assert resampling.bootstrap_mean(one, "k", "v", 10, 1).first()["mean"] is None


def test_distance_of_a_source_from_itself(spark):
    pts = spark.createDataFrame([(1, "a", [0.0, 1.0]), (2, "a", [2.0, 0.0]), (3, "b", [0.0, 1.0]), (4, "b", [2.0, 0.0])], "id int, source string, x array<double>")
    assert abs(shift.energy_distance(pts, "a", "b").first()[0]) < 1e-5 and abs(shift.mmd(pts, "a", "b").first()["mmd"]) < 1e-9
    assert abs(shift.coral_distances(pts.select("source", "x"), 2).first()["distance"]) < 1e-12


def test_streamed_windows_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "a" if h % 2 else "b", float(h)) for h in range(8)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "2 hours")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("windows"), "start", "event_type", "n") == rows(windowed_counts(events, "2 hours"), "start", "event_type", "n")


def test_attention_gradient_and_training(spark):
    import numpy as np

    from cohortloom.operators import mil

    r = np.random.default_rng(1)
    bags = [(f"b{i}", [float(a) for a in r.normal(size=3) + ([3.0, 0, 0] if i % 2 and k == 0 else [0, 0, 0])]) for i in range(16) for k in range(1 + i % 4)]
    cells, y = spark.createDataFrame(bags, "subject_id string, x array<double>"), spark.createDataFrame([(f"b{i}", float(i % 2) if i < 15 else None) for i in range(16)], "subject_id string, y double")
    model = mil.GatedAttention.start(3, 2, seed=4)
    model.c = np.array([0.3, -0.2, 0.1])

    def loss(m):
        p = {x["subject_id"]: x["y_prob"] for x in mil.predict(cells, m).collect()}
        return -np.mean([np.log(p[f"b{i}"] if i % 2 else 1 - p[f"b{i}"]) for i in range(15)])

    g, flat = mil.gradient(cells, y, model), model.flat()
    for k in (0, 7, 12, 14, 16, 17):
        step = np.zeros_like(flat)
        step[k] = 1e-5
        assert math.isclose(g[k], (loss(model.with_flat(flat + step)) - loss(model.with_flat(flat - step))) / 2e-5, abs_tol=1e-6)
    assert np.allclose(g, mil.gradient(cells.repartition(7), y, model))
    fitted = mil.fit(cells, y, 3, hidden=2, rounds=12, rate=0.3)
    p = {x["subject_id"]: x["y_prob"] for x in mil.predict(cells, fitted).collect()}
    assert np.mean([(p[f"b{i}"] >= 0.5) == bool(i % 2) for i in range(15)]) > 0.8
    assert mil.dropout_report(cells, fitted, 3, 0.3).count() == 16


def test_bags_hold_whole_vectors(spark):
    from cohortloom.plans import lookups
    from cohortloom.plans.views import table

    data = "/root/testdata/sf0.001"
    bags, _ = lookups._bags(spark, data)
    whole = table(spark, data, "embeddings").selectExpr("sum(aggregate(embedding, 0D, (s, x) -> s + x * 8)) as total", "min(size(embedding)) as n").first()
    got = bags.selectExpr("sum(aggregate(x, 0D, (s, x) -> s + x)) as total", "min(size(x)) as n", "max(size(x)) as most").first()
    assert got["n"] == got["most"] == whole["n"] == lookups.DIMENSIONS and got["total"] == pytest.approx(whole["total"])


def test_a_frozen_policy_judges_once(spark):
    p = spark.createDataFrame([(int(i % 10 < i // 20), i / 200, "a") for i in range(200)], "y_true int, y_prob double, source string")
    one, two = calibration.freeze(p, method="none"), calibration.freeze(p, method="none")
    assert one.fingerprint == two.fingerprint != calibration.freeze(p, "balanced_accuracy", "isotonic").fingerprint
    assert one.evaluate(p).first()["threshold"] == one.threshold
    with pytest.raises(cohorts.ContractError):
        one.evaluate(p)


def test_curves_over_ranges_equal_one_window(spark, monkeypatch):
    p = spark.createDataFrame([(i % 3 % 2, ((i * 37) % 101) / 101, f"s{i % 2}") for i in range(300)] + [(1, 0.0, "s0"), (0, 1.0, "s0")], "y_true int, y_prob double, source string")
    columns = ("source", "t", "p", "q", "tp", "fp", "pos", "neg")
    fine = rows(metrics.curve(p, ["source"]), *columns)
    for n in (1, 4):
        monkeypatch.setattr(metrics, "RANGES", n)
        assert rows(metrics.curve(p, ["source"]), *columns) == fine


def test_covariances_do_not_depend_on_partitions(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x = 1e6 + r.normal(size=(40, 5))
    df = spark.createDataFrame([("a" if i < 39 else "b", [float(v) for v in row]) for i, row in enumerate(x)], "source string, x array<double>")
    want = np.cov(x[:39].T)
    for n in (1, 7):
        got = {(c["source"], c["g"], c["h"]): c["cov"] for c in shift.covariances(df.repartition(n)).collect()}
        assert all(math.isclose(got["a", g, h], want[g, h], abs_tol=1e-7) for g in range(5) for h in range(g, 5)) and got["b", 0, 1] == 0


def test_statistics_of_large_values_keep_their_variance(spark):
    cells = spark.range(4).select(F.col("id").alias("cell_id"))
    expr = cells.select("cell_id", F.lit("g").alias("gene"), (1e9 + F.col("cell_id") % 2).alias("value"))
    assert math.isclose(matrix.gene_stats(expr, cells).first()["std"], 0.5, rel_tol=1e-6)
    assert math.isclose(matrix.gene_stats(expr.where("cell_id < 2"), cells).first()["mean"], (2e9 + 1) / 4)


def test_gates_and_names(spark):
    from cohortloom.operators import experiments

    with pytest.raises(cohorts.ContractError):
        experiments.require_inductive(True, "folds")
    experiments.require_inductive(False, "folds")
    assert models.candidate_kind(" RF ", 2, False) == "random_forest"
    for bad in (("none such", 2, True), ("module_attention", 2, False), ("centroid", 3, True)):
        with pytest.raises(cohorts.ContractError):
            models.candidate_kind(*bad)


def test_dispersions_by_hand(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = np.log1p(r.gamma(2.0, np.linspace(0.1, 6, 30)[:, None], size=(30, 50)))
    df = spark.createDataFrame([(c, f"g{g:02d}", float(x[g, c])) for g in range(30) for c in range(50)], "cell_id int, gene string, value double")
    raw = np.expm1(x)
    m, d = np.log1p(raw.mean(axis=1)), np.log(raw.var(axis=1, ddof=1) / raw.mean(axis=1))
    place = np.maximum(0, np.ceil((m - m.min()) / (m.max() - m.min()) * 20) - 1).clip(max=19)
    want = {f"g{g:02d}": 1.0 if (place == place[g]).sum() == 1 else (d[g] - d[place == place[g]].mean()) / d[place == place[g]].std(ddof=1) for g in range(30)}
    got = {q["gene"]: q["z"] for q in matrix.dispersions(df).collect()}
    assert all(math.isclose(got[g], z, abs_tol=1e-6) for g, z in want.items())


def test_rows_that_do_not_say_what_they_are_violate_every_policy(spark):
    cells = spark.createDataFrame([(1, None), (2, False)], "cell_id int, is_pseudo_bulk boolean")
    assert rows(cohorts.policy_violations(cells), "policy", "n_violations", "admitted") == [("bulk_only", 2, False), ("single_cell_only", 1, False)]
    for policy in ("single_cell_only", "bulk_only"):
        with pytest.raises(cohorts.ContractError):
            cohorts.assert_rows_match_policy(cells.where("cell_id = 1"), policy)


def test_prediction_refuses_the_whole_table_for_one_bad_row(spark):
    import numpy as np

    from cohortloom.operators import inference, mil

    schema = "subject_id string, cell_id long, x array<double>, cell_type_id int, is_pseudo_bulk boolean, modality string"
    good = [("a", 1, [1.0, 0.0], 0, False, "single_cell"), ("a", 2, [0.0, 3.0], 1, False, "single_cell"), ("b", 3, [2.0, 2.0], 1, False, "single_cell")]
    model = mil.GatedAttention(np.array([[0.5, -1.0]]), np.array([[1.0, 0.0]]), np.array([2.0]), np.array([1.0, -1.0]), 0.5)
    cells = spark.createDataFrame(good, schema)
    e = [np.exp(2 * np.tanh(0.5 * x - y) / (1 + np.exp(-x))) for x, y in ((1, 0), (0, 3))]
    want = 1 / (1 + np.exp(-((e[0] * 1 - e[1] * 3) / sum(e) + 0.5)))
    got = {r["subject_id"]: r for r in inference.predict_subjects(cells, model, "single_cell_only", 2, diagnostic=True).collect()}
    assert math.isclose(got["a"]["y_prob"], want) and math.isclose(got["b"]["y_prob"], 1 / (1 + np.exp(-0.5))) and got["a"]["n_cells"] == 2 and got["b"]["diagnostic"]
    top = inference.most_attended(cells, model, 1).where("subject_id = 'a'").first()
    assert top["cell_id"] == 1 and math.isclose(top["weight"], e[0] / sum(e))
    bad = {"no_provenance": ("c", 4, [1.0, 1.0], 0, None, "single_cell"), "policy": ("c", 4, [1.0, 1.0], 0, True, "single_cell"), "modality": ("c", 4, [1.0, 1.0], 0, False, None), "cell_type": ("c", 4, [1.0, 1.0], 2, False, "single_cell"),
           "length": ("c", 4, None, 0, False, "single_cell"), "not_finite": ("c", 4, [1.0, None], 0, False, "single_cell"), "placeholder": (None, 4, [1.0, 1.0], 0, False, "single_cell")}
    for problem, row in bad.items():
        mixed = spark.createDataFrame([*good, row], schema)
        assert rows(inference.input_problems(mixed, "single_cell_only", 2, 2), "problem", "n") == [(problem, 1)]
        with pytest.raises(cohorts.ContractError):
            inference.predict_subjects(mixed, model, "single_cell_only", 2)
    with pytest.raises(cohorts.ContractError):
        inference.input_problems(cells, "multimodal", 2, 2)
    assert inference.input_problems(cells.limit(0), "single_cell_only", 2, 2).count() == 0


def test_unknown_strategies_are_refused(spark):
    for candidate, strategy in (("logistic", "none such"), ("none such", "erm"), (None, "erm")):
        with pytest.raises(cohorts.ContractError):
            models.applied_strategies(spark.createDataFrame([(candidate, strategy)], "candidate string, strategy string"))


def test_numbers_by_ranges_equal_those_of_one_window(spark):
    ids = [-(2**60), -5, 0, 1, 2, 3, 1000, 1001, 2**60, 2**60 + 1]
    df = spark.createDataFrame([(g, i) for g in "ab" for i in ids[: 10 if g == "a" else 4]], "g string, id long")
    assert [r["k"] for r in sorted(splits.ordered(df, "id", ["g"]).collect())] == [*range(10), *range(4)]
    assert splits.ordered(df.limit(0), "id", ["g"]).count() == 0
    texts = df.withColumn("id", F.col("id").cast("string"))
    assert sorted(r["k"] for r in splits.ordered(texts, "id", ["g"]).where("g = 'a'").collect()) == list(range(10))
    lone = spark.createDataFrame([("a", 7)], "g string, id long")
    assert rows(splits.ordered(lone, "id", ["g"]), "k") == [(0,)]


@pytest.mark.parametrize("kind", models.BY_CLASS)
def test_groups_apart_equal_one_model_each(spark, kind):
    from pyspark.ml.functions import array_to_vector

    r = np.random.default_rng(5)
    rows = [(i, f"src{i % 3}", i % 2, i % 4 // 2 + i % 3, float(i % 3 == 2 or i % 5 == 0) if i % 2 else float(i % 3 == 0), r.normal(size=3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "subject_id int, source string, seed int, fold int, y_true double, x array<double>").withColumn("features", array_to_vector("x"))

    def one_by_one(part, by):
        out = {}
        for at in sorted({row[by] for row in part.collect()}):
            fitted = models.fit_candidate(part.where(F.col(by) != at), kind).predict(part.where(F.col(by) == at))
            out |= {row["subject_id"]: (row["y_prob"], row["y_pred"]) for row in fitted.collect()}
        return out

    def same(got, want):
        got = [(row["subject_id"], row["y_prob"], row["y_pred"]) for row in got.collect()]
        assert len(got) == len(want) and all(p == pytest.approx(want[i][0], abs=1e-12) and q == want[i][1] for i, p, q in got)

    same(models.apart(df, kind, "fold", ("seed",)), one_by_one(df.where("seed = 0"), "fold") | one_by_one(df.where("seed = 1"), "fold"))
    same(models.apart(df, kind, "source"), one_by_one(df, "source"))
    lone = df.where("source <> 'src1'").withColumn("y_true", (F.col("source") == "src0").cast("double"))  # what each may see is of one class
    same(models.out_of_fold(lone.withColumn("fold", (F.col("source") == "src0").cast("int")), kind), one_by_one(lone, "source"))


def test_repeats_read_features_once_to_predict(spark, tmp_path):
    """However many repeats and folds: a union of as many joins had one task read its part of each."""
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(80).select(F.col("id").alias("subject_id"), F.lit("a").alias("source"), (F.col("id") % 2).cast("double").alias("y_true"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("x"))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows").withColumn("features", array_to_vector("x"))
    out = experiments.repeated_out_of_fold(rows, "centroid", 4, [1, 2, 3])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert sum("FileScan" in line and "x#" in line.split("Batched")[0] for line in plan.splitlines()) == 1
    got = out.groupBy("seed", "fold").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("d")).collect()
    assert len(got) == 12 and all(r["n"] == r["d"] == 20 for r in got)
    with pytest.raises(cohorts.ContractError):
        models.out_of_fold(rows.withColumn("fold", F.lit(0)), "centroid")
