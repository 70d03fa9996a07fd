"""Readers of raw formats and immutable results, on files made here."""

import gzip
import threading

import pytest
from pyspark.sql import functions as F

from cohortloom.operators.cohorts import ContractError
from cohortloom.operators.texts import modules_from_gmt
from cohortloom.sources import artifacts, catalog, geo, matrixmarket


def test_matrixmarket(spark, tmp_path):
    p = tmp_path / "m.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real general\n% c\n3 2 3\n1 1 5\n3 2 3\n2 1 0.5\n")
    assert sorted(map(tuple, matrixmarket.triples(spark, str(p)).collect())) == [(0, 0, 5.0), (1, 0, 0.5), (2, 1, 3.0)]
    assert matrixmarket.size_of(spark, str(p)) == (3, 2, 3)
    (tmp_path / "b.tsv").write_text("barcode\nA\nB\n")
    (tmp_path / "g.tsv").write_text("e1\tG1\ne2\tG2\ne3\tG3\n")
    b, g = matrixmarket.id_list(spark, str(tmp_path / "b.tsv"), 2), matrixmarket.id_list(spark, str(tmp_path / "g.tsv"), 3, symbols=True)
    out = matrixmarket.cells_by_genes(matrixmarket.triples(spark, str(p)), (3, 2, 3), b, g)
    assert sorted(map(tuple, out.collect())) == [("A", "G1", 5.0), ("A", "G2", 0.5), ("B", "G3", 3.0)]
    p.write_text("1 1 5\n")
    with pytest.raises(ContractError):
        matrixmarket.triples(spark, str(p))
    with pytest.raises(ContractError):
        matrixmarket.id_list(spark, str(tmp_path / "g.tsv"), 7)


def test_series_matrix(spark, tmp_path):
    p = tmp_path / "s.txt.gz"
    with gzip.open(p, "wt") as f:
        f.write('!Sample_title\t"patient 1"\t"patient 2"\n!Sample_geo_accession\t"GSM1"\t"GSM2"\n!Sample_characteristics_ch1\t"Smoking: never"\t"smoking: current: daily"\n'
                '!Sample_characteristics_ch1\t"age: 4"\t"nothing"\n!series_matrix_table_begin\n"ID_REF"\t"GSM1"\t"GSM2"\n"p1"\t1.5\t2\n"p2"\tnull\t3\n!series_matrix_table_end\n')  # fmt: skip
    samples, meta = geo.sample_metadata(spark, str(p))
    assert sorted((r["sample_id"], r["title"]) for r in samples.collect()) == [("GSM1", "patient 1"), ("GSM2", "patient 2")]
    assert sorted(map(tuple, meta.select("key", "pos", "value").collect())) == [("smoking", 0, "never"), ("smoking", 1, "current: daily")]
    assert sorted((r["probe"], r["pos"], r["value"]) for r in geo.series_matrix(spark, str(p)).where("value is not null").collect()) == [("p1", 0, 1.5), ("p1", 1, 2.0), ("p2", 1, 3.0)]
    (tmp_path / "none.txt").write_text("!Sample_title\tx\n")
    with pytest.raises(ContractError):
        geo.series_matrix(spark, str(tmp_path / "none.txt"))


def test_annotation_and_star_counts(spark, tmp_path):
    (tmp_path / "a.annot").write_text("^x\n!platform_table_begin\nID\tGene symbol\np1\tA\np2\t \np1\tB\n!platform_table_end\n")
    assert [tuple(r) for r in geo.probe_symbols(spark, str(tmp_path / "a.annot")).collect()] == [("p1", "B")]
    (tmp_path / "c.tsv.gz").write_text("# v\ngene_id\tgene_name\ttpm_unstranded\nN_unmapped\t\t4\nENSG1.5\tA\t2.5\n")
    out = geo.star_counts(spark, str(tmp_path / "c.tsv.gz")).select("gene", "value").collect()
    assert [tuple(r) for r in out] == [("ENSG1", 2.5)]


def test_wide_matrix_and_sidecar(spark, tmp_path):
    (tmp_path / "m.csv").write_text("gene,s1,s.2\nG1,1,2\nG2,3,x\n")
    long = geo.wide_matrix(spark, str(tmp_path / "m.csv"))
    assert {(r["gene"], r["sample_id"]): r["value"] for r in long.collect()} == {("G1", "s1"): 1.0, ("G1", "s.2"): 2.0, ("G2", "s1"): 3.0, ("G2", "s.2"): None}
    side = spark.createDataFrame([("s1", "vape", False)], "sample_id string, smoke_type string, smoke_type_known boolean")
    assert sorted((r["sample_id"], r["smoke_type"], r["smoke_type_known"], r["subject_id"]) for r in geo.with_sidecar(long, side, "cigarette").collect()) == [("s.2", "cigarette", True, "s.2"), ("s1", "vape", False, "s1")]
    head = "sample_id,smoke_type,smoke_type_known,subject_id,subject_id_verified\n"
    for body, good in (("s1,vape,True,p,1\n", True), ("s1,vape,False,p,1\n", False), ("s1,vape,1.0,p,1\n", False)):
        (tmp_path / "meta.csv").write_text(head + body)
        if good:
            assert geo.load_labelled_matrix(spark, str(tmp_path / "m.csv"), str(tmp_path / "meta.csv"))[1].count() == 1
        else:
            with pytest.raises(ContractError):
                geo.load_labelled_matrix(spark, str(tmp_path / "m.csv"), str(tmp_path / "meta.csv"))


def test_gmt(spark):
    lines = spark.createDataFrame([("M\td\tA\tB\tA",), ("N\td",), ("O\td\t",)], "value string")
    assert sorted(map(tuple, modules_from_gmt(lines).collect())) == [("M", "A"), ("M", "B")]


def test_artifacts_detect_changes(spark, tmp_path):
    path = tmp_path / "r.json"
    artifacts.write_json(path, {"b": 1, "a": [1, 2]})
    assert artifacts.read_json(path) == {"a": [1, 2], "b": 1}
    path.write_text(path.read_text().replace("1", "3", 1))
    with pytest.raises(ContractError):
        artifacts.read_json(path)
    cells = spark.range(10).select(F.col("id").alias("cell_id"), F.lit("s").alias("source"), F.lit(False).alias("is_pseudo_bulk"))
    artifacts.export_cells(cells, str(tmp_path / "out"), "single_cell_only")
    assert artifacts.load_cells(spark, str(tmp_path / "out")).count() == 10
    cells.where("cell_id < 3").write.mode("append").partitionBy("source").parquet(str(tmp_path / "out/cells"))
    with pytest.raises(ContractError):
        artifacts.load_cells(spark, str(tmp_path / "out"))


def test_publication_and_guard(tmp_path):
    with pytest.raises(ContractError):
        artifacts.publish(tmp_path / "p.json", {"a": {"file_path": 1}}, ["a"])
    artifacts.publish(tmp_path / "p.json", {"a": 1, "b": 2}, ["a"])
    with pytest.raises(FileExistsError):
        artifacts.publish(tmp_path / "p.json", {"a": 1}, ["a"])
    got, guard = [], artifacts.FrozenTestGuard(tmp_path / "g")

    def take(name):
        try:
            guard.acquire(name)
            got.append(name)
        except ContractError:
            pass

    threads = [threading.Thread(target=take, args=(str(k),)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == 1
    guard.close(got[0], "completed")
    with pytest.raises(ContractError):
        guard.close(got[0], "failed")


def test_catalog_reads_what_is_there(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 3 2\n1 1 5\n2 3 1\n")
    (tmp_path / "b.tsv").write_text("A\nB\nC\n")
    (tmp_path / "g.tsv").write_text("e1\tG1\ne2\tG2\n")
    at = {"kind": "single_cell", "matrix": str(tmp_path / "m.mtx"), "barcodes": str(tmp_path / "b.tsv"), "genes": str(tmp_path / "g.tsv"), "n_barcodes": 3, "n_genes": 2, "species": "mouse"}
    out = catalog.load_all(spark, {"x": at, "gone": at | {"matrix": str(tmp_path / "none.mtx")}}, mode="mouse_only")
    expr, cells = out["x"]
    assert list(out) == ["x"] and sorted(map(tuple, expr.collect())) == [("A", "G1", 5.0), ("C", "G2", 1.0)] and cells.count() == 3
    with pytest.raises(ContractError):
        catalog.load_all(spark, {"x": at})
    with pytest.raises(ContractError):
        catalog.load_all(spark, {"gone": at | {"matrix": str(tmp_path / "none.mtx")}}, mode="mouse_only")
    with pytest.raises(ContractError):
        catalog.require_real_subjects(spark.createDataFrame([("Unknown ",)], "subject_id string"))
    sums = catalog.checksums(spark, [at["matrix"], str(tmp_path / "none")])
    assert len(sums[at["matrix"]]) == 64 and sums[str(tmp_path / "none")] is None
    with pytest.raises(ContractError):
        catalog.Entry("a", "x", "rat", "open").validate()


def test_bundles_and_reports(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    from cohortloom.operators import models

    rows = spark.range(40).select(F.col("id").alias("subject_id"), (F.col("id") % 2).cast("double").alias("y_true"), array_to_vector(F.array((F.col("id") % 2).cast("double"), F.rand(1))).alias("features"))
    fitted = models.fit_candidate(rows, "logistic")
    artifact = spark.createDataFrame([("g1", 0.5)], "gene string, mean double")
    artifacts.write_bundle(fitted.model, str(tmp_path / "b"), artifact, spark)
    model, again = artifacts.load_bundle(spark, str(tmp_path / "b"))
    assert again.count() == 1 and model.transform(rows).where("prediction = y_true").count() == 40
    part = next((tmp_path / "b/model").rglob("part-*"))
    part.with_name(f".{part.name}.crc").unlink()
    part.write_text("changed")
    with pytest.raises(ContractError):
        artifacts.load_bundle(spark, str(tmp_path / "b"))
    artifacts.write_report(tmp_path / "r.md", "Report", {"panel": artifact})
    assert "| g1 | 0.5 |" in (tmp_path / "r.md").read_text()


def test_fold_artifacts_belong_to_their_subjects(spark, tmp_path):
    artifact = spark.createDataFrame([("g1", 0.5), ("g2", 1.5)], "gene string, mean double")
    train, val = (spark.createDataFrame([(s,) for s in x], "subject_id string") for x in (["a", "b"], ["c"]))
    artifacts.save_fold(artifact, str(tmp_path), 1, train, val)
    assert artifacts.load_fold(spark, str(tmp_path), 1, train.unionAll(train), val).count() == 2
    with pytest.raises(ContractError, match="other train"):
        artifacts.load_fold(spark, str(tmp_path), 1, val)
    with pytest.raises(ContractError, match="incomplete"):
        artifacts.load_fold(spark, str(tmp_path), "2_1")
    (tmp_path / "preprocessing/fold_01/manifest.json").unlink()
    with pytest.raises(ContractError, match="incomplete"):
        artifacts.load_fold(spark, str(tmp_path), 1)


def test_evidence_runs_are_written_once_and_checked(tmp_path):
    artifacts.write_run(tmp_path, "run-1", {"metrics.json": {"auroc": 0.7}, "sub/rows.json": [1, 2]})
    assert artifacts.validate_run(tmp_path, "run-1")["status"] == "complete" and artifacts.list_runs(tmp_path) == ["run-1"]
    for name, files in (("run-1", {}), ("run-2", {"../x.json": 1}), ("a/b", {})):
        with pytest.raises(ContractError):
            artifacts.write_run(tmp_path, name, files)
    (tmp_path / "run-1/extra.json").write_text("{}")
    with pytest.raises(ContractError, match="extra"):
        artifacts.validate_run(tmp_path, "run-1")
    (tmp_path / "run-1/extra.json").unlink()
    (tmp_path / "run-1/metrics.json").write_text('{"auroc":0.9}')
    with pytest.raises(ContractError, match="differ"):
        artifacts.validate_run(tmp_path, "run-1")


def test_publication_looks_at_values_and_keys(tmp_path):
    report = {"summary": {"auroc": 0.7, "note": "from GSM123456"}, "fine": [1]}
    with pytest.raises(ContractError, match="note"):
        artifacts.publish(tmp_path / "p.json", report, ["summary"])
    artifacts.publish(tmp_path / "p.json", report, ["fine"])
    assert artifacts.read_json(tmp_path / "p.json") == {"fine": [1]}


def test_table_reports(spark, tmp_path):
    df = spark.createDataFrame([("all", 0.7), ("without a", 0.6)], "arm string, metric double")
    artifacts.write_table_report(tmp_path / "r.json", df, ["arm", "metric"])
    assert artifacts.read_json(tmp_path / "r.json")["rows"] == [["all", 0.7], ["without a", 0.6]]
    for kw in ({"required": ["change"]}, {"required": [], "most": 1}):
        with pytest.raises(ContractError):
            artifacts.write_table_report(tmp_path / "q.json", df, **kw)


def test_one_matrix_for_each_sample(spark, tmp_path):
    for name, body in (("GSM1_Con", "2 1 2\n1 1 5\n2 1 1\n"), ("GSM2_E-cigs", "2 2 2\n1 1 3\n2 2 4\n")):
        (tmp_path / f"{name}_matrix.mtx").write_text("%%MatrixMarket matrix coordinate real general\n" + body)
    (tmp_path / "b1").write_text("AA\n")
    (tmp_path / "b2").write_text("AA\nBB\n")
    (tmp_path / "g").write_text("e1\tG1\ne2\tG2\n")
    (tmp_path / "h").write_text("e1\tG1\ne3\tG3\n")
    one = lambda n, b, g, k: {"matrix": str(tmp_path / n), "barcodes": str(tmp_path / b), "genes": str(tmp_path / g), "n_barcodes": k, "n_genes": 2}
    expr, cells = catalog.conditions(spark, {"samples": [one("GSM1_Con_matrix.mtx", "b1", "g", 1), one("GSM2_E-cigs_matrix.mtx", "b2", "h", 2)]})
    assert sorted(map(tuple, expr.collect())) == [("GSM1_Con_AA", "G1", 5.0), ("GSM1_Con_AA", "G2", 1.0), ("GSM2_E-cigs_AA", "G1", 3.0), ("GSM2_E-cigs_BB", "G3", 4.0)]
    assert sorted((c["cell_id"], c["subject_id"], c["smoke_type"]) for c in cells.collect()) == [("GSM1_Con_AA", "mouse::GSM1", "unexposed"), ("GSM2_E-cigs_AA", "mouse::GSM2", "vape"), ("GSM2_E-cigs_BB", "mouse::GSM2", "vape")]


def test_three_field_samples_follow_by_place(spark, tmp_path):
    series, matrix = tmp_path / "s.txt", tmp_path / "m.txt"
    series.write_text('!Sample_title\t"a"\t"b"\t"c"\n!Sample_geo_accession\t"X1"\t"X2"\t"X3"\n!Sample_characteristics_ch1\t"cannabis group: Cannabis"\t"cannabis group: none"\t"cannabis group: cannabis"\n!Sample_characteristics_ch1\t"cigarette: never"\t"cigarette: never"\t"cigarette: Current"\n!Sample_characteristics_ch1\t"vape: no"\t"vape: no"\t"vape: no"\n')
    matrix.write_text("gene sample1 sample2 sample3\nENSG1.4  1 2   3\nENSG2.1 0 x 9\n")
    expr, samples = geo.three_field_microarray(spark, str(series), str(matrix))
    assert sorted((r["sample_id"], r["smoke_type"], r["smoke_type_known"]) for r in samples.collect()) == [("X1", "cannabis", True), ("X2", "unexposed", True), ("X3", "dual_use", True)]
    assert sorted(map(tuple, expr.collect()), key=repr) == sorted([("ENSG1", "X1", 1.0), ("ENSG1", "X2", 2.0), ("ENSG1", "X3", 3.0), ("ENSG2", "X1", 0.0), ("ENSG2", "X2", None), ("ENSG2", "X3", 9.0)], key=repr)
    matrix.write_text("gene sample1\nENSG1 1\n")
    with pytest.raises(ContractError, match="lists 3"):
        geo.three_field_microarray(spark, str(series), str(matrix))
    series.write_text('!Sample_geo_accession\t"X1"\n')
    _, samples = geo.three_field_microarray(spark, str(series), str(matrix))
    assert [(r["smoke_type"], r["smoke_type_known"]) for r in samples.collect()] == [("unknown", False)]


def test_gated_loading(spark, tmp_path):
    (tmp_path / "m.csv").write_text("gene,s1,s2\ng1,1,2\n")
    (tmp_path / "side.csv").write_text("sample_id,subject_id,outcome\ns1,p1,1\ns2,p2,0\n")
    at = {"csv": str(tmp_path / "m.csv"), "sidecar": str(tmp_path / "side.csv"), "smoke_type": "cigarette"}
    assert catalog.load_bulk(spark, at) is None and catalog.load_bulk(spark, at, enabled=True)[1].count() == 2
    with pytest.raises(ContractError):
        catalog.load_bulk(spark, at, enabled=True, trainable=True)
    expr, rows = geo.load_outcome_matrix(spark, at["csv"], at["sidecar"])
    assert expr.count() == 2 and sorted(r["outcome"] for r in rows.collect()) == [0, 1]
    (tmp_path / "side.csv").write_text("sample_id,subject_id,outcome\ns1,p1,1\ns2,p2,maybe\n")
    with pytest.raises(ContractError, match="malformed"):
        geo.load_outcome_matrix(spark, at["csv"], at["sidecar"])
    geo.require_columns(spark, at["sidecar"], ["outcome"])
    with pytest.raises(ContractError, match="lacks"):
        geo.require_columns(spark, at["sidecar"], ["candx"])
    (tmp_path / "c.json").write_text('{"seed": 3}')
    assert catalog.load_config(str(tmp_path / "c.json")) == catalog.load_config({"seed": 3})


def test_a_missing_side_file_is_an_error(spark, tmp_path):
    (tmp_path / "m.csv").write_text("gene,s1\ng1,1\n")
    at = {"kind": "microarray", "csv": str(tmp_path / "m.csv"), "sidecar": str(tmp_path / "none.csv"), "smoke_type": "vape"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        catalog.load_all(spark, {"a": at}, "bulk_only")
    with pytest.raises(ContractError, match="no source"):
        catalog.load_all(spark, {"a": at | {"csv": str(tmp_path / "gone.csv")}}, "bulk_only")


@pytest.mark.parametrize("layout", ["plain", "star"])
def test_count_folder(spark, tmp_path, layout):
    head = "# model\ngene_id\tgene_name\ttpm_unstranded\n" if layout == "star" else ""
    row = (lambda g, v: f"{g}\tname\t{v}\n") if layout == "star" else (lambda g, v: f"{g}\t{v}\n")
    stats = row("N_unmapped" if layout == "star" else "__no_feature", 9)
    for name, genes in {"f1": [("G1.2", 5), ("G2.1", 0.5)], "f2": [("G1.3", 7)], "f3": [("G2.1", 1)], "odd": [("G9.1", 3)]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "counts.tsv").write_text(head + stats + "".join(row(*g) for g in genes))
        (tmp_path / name / "annotations.txt").write_text(head + row("G1.1", 100))
    sheet = "file_id,sample_type,case_id\nf1,Primary Tumor,c1\nf2,Solid Tissue Normal,c1\nf3,Solid Tissue Normal,\ngone,Primary Tumor,c9\n"
    (tmp_path / "file_meta.csv").write_text(sheet)
    at = {"kind": "count_folder", "folder": str(tmp_path), "layout": layout}
    (expr, cells), = catalog.load_all(spark, {"tcga": at}, policy="bulk_only").values()
    assert sorted(map(tuple, expr.collect())) == [("f1", "G1", 5.0), ("f1", "G2", 0.5), ("f2", "G1", 7.0), ("f3", "G2", 1.0)]
    got = {r["cell_id"]: (r["subject_id"], r["smoke_type"], r["smoke_type_known"], r["malignancy"], r["is_pseudo_bulk"]) for r in cells.collect()}
    assert got == {"f1": ("c1", "unknown", False, 1.0, True), "f2": ("c1", "unknown", False, 0.0, True), "f3": ("f3", "unknown", False, 0.0, True)}
    assert sorted(map(tuple, catalog.subject_outcomes(cells).collect())) == [("c1", 1), ("f3", 0)]
    with pytest.raises(ContractError):
        catalog.load_all(spark, {"tcga": at})  # bulk rows under the policy of single cells
    (tmp_path / "file_meta.csv").write_text(sheet + "f1,Primary Tumor,c2\n")
    with pytest.raises(ContractError, match="twice"):
        catalog.count_folder(spark, at)[1].collect()
    (tmp_path / "file_meta.csv").write_text("file_id,sample_type,case_id\ngone,x,y\n")
    with pytest.raises(ContractError, match="no count file"):
        catalog.count_folder(spark, at)
    (tmp_path / "file_meta.csv").write_text("file_id,case_id\n")
    with pytest.raises(ContractError, match="sample_type"):
        catalog.count_folder(spark, at)
    assert {"conditions", "three_fields"} <= set(catalog.READERS) == set(catalog.MAIN)


def test_disease_metadata_and_trial_outcomes(spark, tmp_path):
    table = tmp_path / "meta.txt.gz"
    head = "CellBarcode_Identity\tSubject_Identity\tDisease_Identity\tCellType_Category\n"
    table.write_bytes(gzip.compress((head + '"b1"\t"s1"\t" copd"\t"Epithelial"\nb2\ts2\tControl\tImmune\nb3\ts3\tIPF\tImmune\nb4\ts4\t\t\n').encode()))
    got = {r["cell_id"]: r for r in geo.disease_metadata(spark, str(table)).collect()}
    assert {k: (r["weak_smoke_proxy_known"], r["weak_smoke_proxy_type"], r["weak_smoke_proxy_value"]) for k, r in got.items()} == {"b1": (True, "COPD_diagnosis", "cigarette")} | {b: (False, None, None) for b in ("b2", "b3", "b4")}
    assert all(r["smoke_type"] == "unknown" and r["smoke_type_known"] is False for r in got.values()) and got["b2"]["subject_id"] == "s2"
    (tmp_path / "two.tsv").write_text(head + "b1\ts1\tCOPD\tx\nb1\ts2\tCOPD\tx\n")
    (tmp_path / "bad.tsv").write_text("CellBarcode_Identity\tSubject_Identity\n")
    for name in ("two.tsv", "bad.tsv"):
        with pytest.raises(ContractError):
            geo.disease_metadata(spark, str(tmp_path / name))
    (tmp_path / "prsn.csv").write_text("pid,candx\n1,1\n2,0\n3,\n4,1.0\n5,x\n")
    assert sorted(map(tuple, geo.trial_outcomes(spark, str(tmp_path / "prsn.csv")).collect())) == [("1", 1), ("2", 0), ("4", 1)]
    (tmp_path / "prsn.csv").write_text("pid,other\n1,1\n")
    assert geo.trial_outcomes(spark, str(tmp_path / "prsn.csv")).count() == 0


def test_predictions_are_written_once_and_whole(spark, tmp_path):
    subjects = spark.createDataFrame([("a",), ("b",)], "subject_id string")
    schema = "subject_id string, p double, fold int, subject_fold int"
    good = spark.createDataFrame([("a", 0.2, 0, 0), ("b", 0.9, 1, 1)], schema)
    manifest = artifacts.write_predictions(subjects, good, str(tmp_path / "oof"))
    assert artifacts.verify_frame(spark, str(tmp_path / "oof"), ["subject_id"], manifest).count() == 2
    for rows in ([("a", 0.2, 0, 0)], [("a", 0.2, 0, 0)] * 2 + [("b", 0.9, 1, 1)], [("a", 0.2, 0, 0), ("b", 0.9, 0, 1)], [("a", 0.2, 0, 0), ("b", float("nan"), 1, 1)], [("a", 0.2, 0, 0), ("b", 0.9, 1, 1), ("c", 0.5, 0, 0)]):
        with pytest.raises(ContractError):
            artifacts.write_predictions(subjects, spark.createDataFrame(rows, schema), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()
    with pytest.raises(Exception, match="exists"):
        artifacts.write_predictions(subjects, good, str(tmp_path / "oof"))
