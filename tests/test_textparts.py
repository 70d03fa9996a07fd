"""The data source for line formats: parts of any size give what one task reads."""

import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F

from cohortloom.sources import matrixmarket, textparts


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    textparts.register(spark)


def entries(n=400):
    r = random.Random(3)
    seen = {(r.randint(1, 60), r.randint(1, 40)): r.choice(("1", "2.5", "-3e2")) for _ in range(n)}
    return [(a, b, v) for (a, b), v in seen.items()]


def load(spark, path, layout, part=None, **options):
    reader = spark.read.format("textparts").option("layout", layout).options(**options)
    return (reader.option("part_bytes", part) if part else reader).load(str(path))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_matrixmarket_in_parts(spark, tmp_path, end):
    rows = entries()
    rows += [(60, 40, str(len(rows) + 1))] if not any(x[:2] == (60, 40) for x in rows) else []
    rows[-1] = (60, 40, str(len(rows)))  # an entry that looks like the size line
    text = end.join(["%%MatrixMarket matrix coordinate real general", "% " + "comment " * 20, "", f"60 40 {len(rows)}", *(f"{a} {b} {v}" for a, b, v in rows), "% tail", ""])
    plain, packed = tmp_path / "m.mtx", tmp_path / "m.mtx.gz"
    plain.write_bytes(text.encode())
    packed.write_bytes(gzip.compress(text.encode()))
    want = sorted((a - 1, b - 1, float(v)) for a, b, v in rows)
    assert textparts.size_of(str(plain)) == (60, 40, len(rows)) == textparts.size_of(str(packed))
    for part in (None, 1000, 97):
        df = load(spark, plain, "matrixmarket", part)
        assert sorted(map(tuple, df.collect())) == want
        assert df.rdd.getNumPartitions() == (1 if part is None else -(-len(text) // part))
    assert sorted(map(tuple, load(spark, packed, "matrixmarket", 100).collect())) == want
    assert sorted((r["row"], r["col"], r["val"]) for r in matrixmarket.triples(spark, str(plain)).collect()) == want


def test_pushed_bounds(spark, tmp_path):
    rows = entries()
    path = tmp_path / "m.mtx"
    path.write_text("\n".join(["%%MatrixMarket matrix coordinate real general", f"60 40 {len(rows)}", *(f"{a} {b} {v}" for a, b, v in rows)]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = load(spark, path, "matrixmarket", 500, pushdown="true").where("col >= 5 and col < 9 and row > 3 and val > 0")
        assert sorted(map(tuple, df.collect())) == sorted((a - 1, b - 1, float(v)) for a, b, v in rows if 5 <= b - 1 < 9 and a - 1 > 3 and float(v) > 0)
        assert load(spark, path, "matrixmarket", 500, pushdown="true").where("col = 7 and col = 8").count() == 0
        bounds = textparts.PushingReader({"path": str(path), "layout": "matrixmarket"})
        from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

        rest = list(bounds.pushFilters([GreaterThan(("row",), 3), EqualTo(("col",), 7), IsNotNull(("col",)), GreaterThan(("val",), 0.0)]))
        assert bounds.bounds == {"row": (4, float("inf")), "col": (7, 7)} and [type(f).__name__ for f in rest] == ["IsNotNull", "GreaterThan"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_lines_of_a_folder(spark, tmp_path):
    texts = {"a.txt": "one\n\ntwo\r\nthree", "b.txt": "x" * 5000 + "\n" + "é" * 300 + "\n", "c.bz2": "packed\nlines\n", "d.txt": ""}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(bz2.compress(t.encode()) if name == "c.bz2" else t.encode())
    (tmp_path / "_SUCCESS").write_text("no")
    want = sorted((name, line) for name, t in texts.items() for line in t.replace("\r", "").removesuffix("\n").split("\n") if t)
    for part in (None, 7, 64):
        got = load(spark, tmp_path, "lines", part).select(F.element_at(F.split("file", "/"), -1).alias("f"), "line", "begins_at").collect()
        assert sorted((r["f"], r["line"]) for r in got) == want and len({(r["f"], r["begins_at"]) for r in got}) == len(want)


def test_star_counts_of_a_folder(spark, tmp_path):
    head = "# model\ngene_id\tgene_name\tunstranded\ttpm_unstranded\n"
    (tmp_path / "s1.tsv").write_text(head + "N_unmapped\t\t5\t\nENSG01.3\tA\t7\t0.5\nENSG02.1\tB\t0\t\n")
    (tmp_path / "s2.tsv").write_text(head.replace("unstranded\ttpm_unstranded", "tpm_unstranded\tunstranded") + "ENSG01.9\tA\t2.5\t1\n")
    for part in (None, 20):
        got = load(spark, tmp_path, "star_counts", part).collect()
        assert sorted((r["file"].split("/")[-1], r["gene"], r["value"]) for r in got) == [("s1.tsv", "ENSG01", 0.5), ("s1.tsv", "ENSG02", None), ("s2.tsv", "ENSG01", 2.5)]


def test_broken_files_are_refused(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("1 2 3\n")
    (tmp_path / "t.tsv").write_text("gene\tother\n")
    for layout, name in (("matrixmarket", "m.mtx"), ("star_counts", "t.tsv"), ("lines", "none"), ("odd", "m.mtx")):
        with pytest.raises(Exception, match="no MatrixMarket|no column|none|no layout"):
            load(spark, tmp_path / name, layout).collect()
