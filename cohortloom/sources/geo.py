"""GEO and GDC text formats: series matrices, annotation tables, star counts, sample sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.cohorts import ContractError
from cohortloom.operators.texts import characteristics, strip_version


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, line by line; gzip works. line_no grows with the place in the file, with gaps where the file is split."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", r"\r$", "").alias("value"))


def _between(lines: DataFrame, begin: str, end: str) -> DataFrame:
    marks = lines.agg(F.min(F.when(F.lower(F.trim("value")) == begin, F.col("line_no"))).alias("a"), F.min(F.when(F.lower(F.trim("value")) == end, F.col("line_no"))).alias("b"))
    return lines.join(F.broadcast(marks)).where((F.col("line_no") > F.col("a")) & (F.col("line_no") < F.coalesce("b", F.lit(1 << 62)))).select("line_no", "value")


def _unquoted(x):
    return F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', ""))


def sample_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((pos, sample_id, title), (key, pos, value)) of a series matrix. Titles are null unless there is one for each sample."""
    lines = numbered_lines(spark, path)
    cells = F.transform(F.slice(F.split("value", "\t"), 2, 1 << 30), _unquoted)
    ids = lines.where(F.col("value").startswith("!Sample_geo_accession")).select(F.posexplode(cells).alias("pos", "sample_id"))
    n = ids.count()
    titles = lines.where(F.col("value").startswith("!Sample_title")).select(cells.alias("t")).where(F.size("t") == n).select(F.posexplode("t").alias("pos", "title"))
    meta = lines.where(F.col("value").startswith("!Sample_characteristics_ch1")).select("line_no", F.posexplode(cells).alias("pos", "cell"))
    return ids.join(titles, "pos", "left"), characteristics(meta, n)


def series_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(probe, pos, value) of the table between its markers; without one it is an error."""
    body = _between(numbered_lines(spark, path), "!series_matrix_table_begin", "!series_matrix_table_end")
    first = body.agg(F.min("line_no")).first()[0]
    if first is None:
        raise ContractError(f"{path} has no series matrix")
    f = F.split("value", "\t")
    rows = body.where(F.col("line_no") > first).select(_unquoted(F.get(f, F.lit(0))).alias("probe"), F.posexplode(F.slice(f, 2, 1 << 30)).alias("pos", "v"))
    return rows.select("probe", "pos", F.trim("v").try_cast("double").alias("value"))


def probe_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(probe, symbol) of an annotation table; blank symbols go, of a probe's symbols the last holds."""
    body = _between(numbered_lines(spark, path), "!platform_table_begin", "!platform_table_end")
    first = body.agg(F.min_by("value", "line_no")).first()[0]
    if first is None:
        raise ContractError(f"{path} has no platform table")
    names = [x.strip().strip('"').lower() for x in first.split("\t")]
    at = next((names.index(x) for x in ("gene symbol", "gene_symbol", "symbol") if x in names), None)
    if at is None or "id" not in names:
        raise ContractError(f"{path} has no id and symbol columns")
    f = F.split("value", "\t", -1)
    rows = body.where(F.col("value") != first).select("line_no", F.trim(F.get(f, F.lit(names.index("id")))).alias("probe"), F.trim(F.get(f, F.lit(at))).alias("symbol"))
    return rows.where("symbol <> ''").groupBy("probe").agg(F.max_by("symbol", "line_no").alias("symbol"))


def star_counts(spark: SparkSession, path: str, value: str = "tpm_unstranded") -> DataFrame:
    """(file, gene, value) of star count tables, plain text whatever the name's end: comments and N_ rows go, versions are cut."""
    lines = spark.read.option("pathGlobFilter", "*").format("binaryFile").load(path)
    rows = lines.select(F.col("path").alias("file"), F.posexplode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("line_no", "line")).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    f = F.split("line", "\t")
    heads = rows.groupBy("file").agg(F.min_by("line", "line_no").alias("head"))
    at = F.array_position(F.split("head", "\t"), value)
    named = rows.join(heads, "file").where("line <> head")
    return named.select("file", F.get(f, F.lit(0)).alias("gene"), F.get(f, at.cast("int") - 1).try_cast("double").alias("value")).where(~F.col("gene").startswith("N_")).withColumn("gene", strip_version(F.col("gene")))


def wide_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(gene, sample_id, value) of a table with a column for each sample, read as text and unpivoted."""
    wide = spark.read.csv(path, header=True, sep=sep)
    gene, samples = wide.columns[0], wide.columns[1:]
    long = wide.unpivot(F.col(f"`{gene}`").alias("gene"), [F.col(f"`{c}`") for c in samples], "sample_id", "value")
    return long.select("gene", "sample_id", F.col("value").try_cast("double").alias("value"))


def with_sidecar(expr: DataFrame, sidecar: DataFrame, smoke_type: str) -> DataFrame:
    """Samples with the sidecar's columns: an unmatched sample has the given smoke type, is known and is its own subject."""
    samples = expr.select("sample_id").distinct()
    have = set(sidecar.columns)
    col = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    joined = samples.join(sidecar, "sample_id", "left")
    return joined.select("sample_id", F.coalesce(col("smoke_type", "string"), F.lit(smoke_type)).alias("smoke_type"), F.coalesce(col("smoke_type_known", "boolean"), F.lit(True)).alias("smoke_type_known"), F.coalesce(col("subject_id", "string"), F.col("sample_id")).alias("subject_id"), F.lit(True).alias("is_pseudo_bulk"))


def load_labelled_matrix(spark: SparkSession, csv: str, meta: str) -> tuple[DataFrame, DataFrame]:
    """(expression, samples): the sidecar must have the five columns, strictly boolean flags and some known label."""
    from cohortloom.functions.parse import strict_bool

    need = ("sample_id", "smoke_type", "smoke_type_known", "subject_id", "subject_id_verified")
    side = spark.read.csv(meta, header=True)
    if missing := [c for c in need if c not in side.columns]:
        raise ContractError(f"{meta} lacks {missing}")
    flags = side.select(*(strict_bool(F.col(c), trim=False).alias(c) if c in ("smoke_type_known", "subject_id_verified") else F.col(c) for c in need))
    bad = flags.agg(F.count_if(F.col("smoke_type_known").isNull() | F.col("subject_id_verified").isNull()).alias("bad"), F.count_if("smoke_type_known").alias("known")).first()
    if bad["bad"] or not bad["known"]:
        raise ContractError(f"{meta}: {bad['bad']} flags are malformed, {bad['known']} labels are known")
    return wide_matrix(spark, csv), flags


def three_field_microarray(spark: SparkSession, series: str, matrix: str) -> tuple[DataFrame, DataFrame]:
    """(expression, samples) of a matrix whose columns follow the series matrix's samples by place, split at white space.

    Samples are classed by their characteristics "cannabis group", "cigarette" and "vape"; without any characteristics nothing is
    known of them. Another number of columns than of samples is an error; versions of gene ids are cut.
    """
    from cohortloom.operators.labels import three_field_class

    ids, meta = sample_metadata(spark, series)
    lines = numbered_lines(spark, matrix).where(F.trim("value") != "")
    f = F.split(F.trim("value"), r"\s+")
    head = lines.orderBy("line_no").limit(2).select(F.size(f).alias("n"), "line_no").collect()
    n = ids.count()
    if len(head) < 2 or head[1]["n"] != n + 1:
        raise ContractError(f"{matrix} has {head[1]['n'] - 1 if len(head) > 1 else 0} samples, {series} lists {n}")
    body = lines.where(F.col("line_no") > head[0]["line_no"])
    long = body.select(strip_version(F.get(f, F.lit(0))).alias("gene"), F.posexplode(F.slice(f, 2, n)).alias("pos", "v"))
    expr = long.join(F.broadcast(ids.select("pos", "sample_id")), "pos").select("gene", "sample_id", F.col("v").try_cast("double").alias("value"))
    pick = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    fields = meta.groupBy("pos").agg(pick("cannabis group").alias("cannabis"), pick("cigarette").alias("cigarette"), pick("vape").alias("vape"))
    joined = ids.join(fields, "pos", "left").join(F.broadcast(meta.agg(F.count("*").alias("n_meta"))))
    known = F.col("n_meta") > 0
    label = F.when(known, three_field_class(F.col("cannabis"), F.col("cigarette"), F.col("vape"))).otherwise("unknown")
    return expr, joined.select("sample_id", label.alias("smoke_type"), known.alias("smoke_type_known"))


def load_outcome_matrix(spark: SparkSession, csv: str, meta: str) -> tuple[DataFrame, DataFrame]:
    """(expression, samples) with a vital status: sample_id, subject_id and a strictly parsed outcome are required, and both outcomes must occur."""
    from cohortloom.functions.parse import integral

    side = spark.read.csv(meta, header=True)
    if missing := [c for c in ("sample_id", "subject_id", "outcome") if c not in side.columns]:
        raise ContractError(f"{meta} lacks {missing}")
    rows = side.select("sample_id", "subject_id", integral(F.col("outcome")).alias("outcome"), F.col("outcome").isNotNull().alias("_given"))
    seen = rows.agg(F.count_if(F.col("_given") & (F.col("outcome").isNull() | ~F.col("outcome").isin(0, 1))).alias("bad"), F.count_distinct("outcome").alias("k"), F.count_distinct("subject_id").alias("subjects"), F.count("*").alias("n")).first()
    if seen["bad"] or seen["k"] != 2:
        raise ContractError(f"{meta}: {seen['bad']} outcomes are malformed, {seen['k']} of two occur")
    return wide_matrix(spark, csv), rows.drop("_given")


def require_columns(spark: SparkSession, path: str, needed: list[str]) -> None:
    """An error unless a table with a header is there and has the columns; its rows are not read."""
    if missing := [c for c in needed if c not in spark.read.csv(path, header=True).columns]:
        raise ContractError(f"{path} lacks {missing}")


#: Columns of a per-cell disease table, and what a diagnosis stands for as a proxy (fixed values).
DISEASE_COLUMNS = {"CellBarcode_Identity": "cell_id", "Subject_Identity": "subject_id", "Disease_Identity": "disease", "CellType_Category": "cell_type"}
PROXY = {"disease": "COPD", "type": "COPD_diagnosis", "value": "cigarette"}


def disease_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, subject_id, disease, cell_type, smoke_type, smoke_type_known, weak_smoke_proxy_known, weak_smoke_proxy_type, weak_smoke_proxy_value) of a per-cell table.

    A diagnosis is no record of exposure: nobody's smoking is known, and a COPD diagnosis, in whatever case, is a weak proxy that takes part only where it is asked
    for. Controls are controls of the disease, not people who never smoked. A barcode that comes twice, or a missing column, is an error.
    """
    from cohortloom.operators.cohorts import require_none

    table = spark.read.csv(path, header=True, sep="\t", quote='"')
    if missing := [c for c in DISEASE_COLUMNS if c not in table.columns]:
        raise ContractError(f"{path} lacks {missing}")
    rows = table.select(*(F.col(c).alias(n) for c, n in DISEASE_COLUMNS.items()))
    require_none(rows.groupBy("cell_id").agg(F.count("*").alias("n")), F.col("n") > 1, "barcodes that come twice")
    proxy = F.coalesce(F.upper(F.trim("disease")) == PROXY["disease"], F.lit(False))
    return rows.select("*", F.lit("unknown").alias("smoke_type"), F.lit(False).alias("smoke_type_known"), proxy.alias("weak_smoke_proxy_known"), F.when(proxy, PROXY["type"]).alias("weak_smoke_proxy_type"), F.when(proxy, PROXY["value"]).alias("weak_smoke_proxy_value"))


def trial_outcomes(spark: SparkSession, path: str, subject: str = "pid", flag: str = "candx") -> DataFrame:
    """(subject_id, outcome): 1 where the flag is 1, 0 where it is another number. A subject without one has no row, nor has any where the column is missing: unknown is never negative."""
    table = spark.read.csv(path, header=True)
    if subject not in table.columns:
        raise ContractError(f"{path} lacks {subject}")
    value = F.trim(F.col(flag)).try_cast("double") if flag in table.columns else F.lit(None).cast("double")
    return table.select(F.col(subject).alias("subject_id"), value.alias("v")).where("v is not null").select("subject_id", (F.col("v") == 1).cast("int").alias("outcome"))
