"""Every registered query with SQL gives DuckDB's rows on the smallest driver tables."""

import collections
import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from cohortloom import registry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rel = db.execute(registry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


#: Rows of the queries without SQL, as (columns, rows or a table that gives as many), and a column of probabilities.
SHAPES = {
    "c1_sigmoid": ({"subject_id", "y_true", "calibrated"}, None, "calibrated"), "e2_bulk_classification": ({"sensitivity", "specificity", "auroc", "n"}, 1, "auroc"),
    "e4_calibrated_evaluation": ({"threshold", "auroc", "ece"}, 1, "auroc"), "n6_batch_centring": ({"id", "source", "x"}, 40, None), "u2_logistic": ({"subject_id", "fold", "y_prob"}, "embeddings", "y_prob"),
    "u2_random_forest": ({"subject_id", "y_prob", "y_pred"}, None, "y_prob"), "u5_attention_training": ({"subject_id", "y_prob"}, None, "y_prob"), "x6_source_predictability": ({"accuracy", "baseline"}, 1, "accuracy"),
    "n10_scaled_logistic": ({"subject_id", "fold", "y_true", "y_prob"}, "embeddings", "y_prob"), "r7_capped_batches": ({"batch", "i", "label", "subject_id", "cell_id"}, 1000, None), "r8_capped_source_batches": ({"batch", "n", "most_of_a_subject"}, 17, None),
    "u8_source_invariant_training": ({"strategy", "loss_after", "mmd_after"}, 5, None)}

#: What the rows of such queries must show beside their form: that something was learned, and how draws are bound. Labels of the vectors are drawn at random, so held-out rows are ranked by chance.
VALUES = {
    "n10_scaled_logistic": lambda rows: 0.4 < auroc(rows) < 0.6 and {r["fold"] for r in rows} == {0, 1, 2} and len({r["y_prob"] for r in rows}) > 400, "u2_logistic": lambda rows: 0.4 < auroc(rows) < 0.6 and len({r["subject_id"] for r in rows}) == len(rows) and len({r["y_prob"] for r in rows}) > 400,
    "u2_random_forest": lambda rows: len({r["y_prob"] for r in rows}) > 10, "c1_sigmoid": lambda rows: len({round(r["calibrated"], 9) for r in rows}) > 10, "u5_attention_training": lambda rows: len({round(r["y_prob"], 9) for r in rows}) > 10,
    "x6_source_predictability": lambda rows: rows[0]["accuracy"] != rows[0]["baseline"], "r8_capped_source_batches": lambda rows: sum(r["n"] for r in rows) == 1000 and max(r["most_of_a_subject"] for r in rows) <= 6,
    "r7_capped_batches": lambda rows: max(collections.Counter((r["batch"], r["subject_id"]) for r in rows).values()) == 6 and len({(r["batch"], r["cell_id"]) for r in rows}) == 1000,
    "u8_source_invariant_training": lambda rows: all(r["loss_after"] < r["loss_before"] for r in rows) and min(rows, key=lambda r: r["mmd_after"])["strategy"] == "mmd"}


def auroc(rows):
    pos, neg = [r["y_prob"] for r in rows if r["y_true"] == 1], [r["y_prob"] for r in rows if r["y_true"] == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_shapes(spark, db, name):
    columns, n, share = SHAPES[name]
    rows = registry.queries()[name](spark, DATA).collect()
    assert rows and columns <= set(rows[0].asDict())
    if n is not None:
        assert len(rows) == (n if isinstance(n, int) else db.execute(f"select count(*) from {n}").fetchone()[0])
    if share:
        assert all(r[share] is None or 0 <= r[share] <= 1 for r in rows) and any(r[share] is not None for r in rows)
    assert VALUES.get(name, lambda _: True)(rows)
