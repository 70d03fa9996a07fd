"""Operators on long measurement matrices (cell, gene, value) and the cells' metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Target sum of a cell's normalised counts.
TARGET = 1e4


def qc_filter(counts: DataFrame, min_genes: int = 200, min_cells: int = 3, max_pct_mito: float = 20.0, mito: str = "MT-") -> DataFrame:
    """Cells with enough genes and little mitochondrial share, then genes seen in enough of the cells that are left."""
    seen = counts.where("value > 0")
    per_cell = seen.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.when(F.col("gene").startswith(mito), F.col("value")).otherwise(0.0)).alias("mito"))
    good = per_cell.where((F.col("n") >= min_genes) & (100 * F.col("mito") / F.col("total") <= max_pct_mito)).select("cell_id")
    kept = counts.join(good, "cell_id", "left_semi")
    genes = kept.where("value > 0").groupBy("gene").count().where(F.col("count") >= min_cells).select("gene")
    return kept.join(genes, "gene", "left_semi").select(*counts.columns)


def log_normalize(counts: DataFrame, target: float = TARGET) -> DataFrame:
    """ln(1 + value * target / the cell's sum); a cell whose sum is 0 keeps zeros."""
    sums = counts.groupBy("cell_id").agg(F.sum("value").alias("total"))
    return counts.join(sums, "cell_id").withColumn("value", F.when(F.col("total") > 0, F.log1p(F.col("value") * target / F.col("total"))).otherwise(0.0)).drop("total")


def gene_stats(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """(gene, mean, std) over all of `cells`: absent values count as zeros, deviations are of the population, and 0 becomes 1.

    Variances come from those of the values that are there, corrected for the absent ones, so large means cancel nothing out.
    """
    n = cells.select("cell_id").distinct().agg(F.count("*").alias("n"))
    there = expr.join(cells.select("cell_id").distinct(), "cell_id", "left_semi").groupBy("gene").agg(F.count("value").alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    share = F.col("k") / F.col("n")
    std = F.sqrt(share * F.col("v") + share * (1 - share) * F.col("m") * F.col("m"))
    return there.join(F.broadcast(n)).select("gene", (share * F.col("m")).alias("mean"), F.when(std < 1e-12, 1.0).otherwise(std).alias("std"))


def top_variance(expr: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """The n genes of largest population variance over `cells`; ties go to the smaller name."""
    return gene_stats(expr, cells).select("gene", (F.col("std") * F.col("std")).alias("variance")).orderBy(F.desc(F.round("variance", 9)), "gene").limit(n)


def dispersions(expr: DataFrame, bins: int = 20, by: list[str] = ()) -> DataFrame:
    """(by, gene, z): dispersion of each gene, normalised within bins of equal width of the mean (right-closed, as the lowest is).

    expr holds log-normalised values; means and sample variances are of exp(value) - 1, and the logarithm of their ratio is
    compared with its bin. A bin with one gene gives 1; a gene that does not vary has no dispersion.
    """
    by = list(by)
    m = expr.groupBy(*by, "gene").agg(F.avg(F.expm1("value")).alias("mean"), F.var_samp(F.expm1("value")).alias("var"))
    ratio = F.col("var") / F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    m = m.select(*by, "gene", F.round(F.log1p("mean"), 9).alias("m"), F.when(ratio > 0, F.log(ratio)).alias("d"))
    edges = m.groupBy(*by).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    m = m.join(F.broadcast(edges), by) if by else m.join(F.broadcast(edges))
    place = F.ceil((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) - 1
    m = m.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0), F.least(F.lit(bins - 1), place))).otherwise(0))
    w = Window.partitionBy(*by, "bin")
    z = F.when(F.count("d").over(w) == 1, F.when(F.col("d").isNotNull(), 1.0)).otherwise((F.col("d") - F.avg("d").over(w)) / F.nullif(F.stddev_samp("d").over(w), F.lit(0.0)))
    return m.withColumn("z", z).select(*by, "gene", "z")


def highly_variable(expr: DataFrame, n: int, markers: list[str] = (), bins: int = 20, batch: str | None = None) -> DataFrame:
    """The n genes of largest normalised dispersion, ties in gene order.

    With a batch column genes are ranked within each batch; those that are among the n of more batches come first, then those
    of larger mean dispersion. Markers that the panel lacks replace its last genes in gene order that are no markers.
    """
    if batch is None:
        order = dispersions(expr, bins).select("gene", F.lit(1).alias("k"), F.round("z", 6).alias("z"))
    else:
        own = F.row_number().over(Window.partitionBy(batch).orderBy(F.desc_nulls_last(F.round("z", 6)), "gene"))
        order = dispersions(expr, bins, [batch]).withColumn("r", own).groupBy("gene").agg(F.count_if((F.col("r") <= n) & F.col("z").isNotNull()).alias("k"), F.round(F.avg("z"), 6).alias("z"))
    ranked = order.orderBy(F.desc("k"), F.desc_nulls_last("z"), "gene").limit(n).select("gene").withColumn("marker", F.col("gene").isin(list(markers)) if markers else F.lit(False))
    if not markers:
        return ranked.select("gene")
    wanted = expr.select("gene").distinct().where(F.col("gene").isin(list(markers)))
    missing = wanted.join(ranked, "gene", "left_anti")
    order = F.row_number().over(Window.orderBy(F.asc("marker"), F.desc("gene")))  # the panel: n rows
    kept = ranked.withColumn("from_end", order).join(F.broadcast(missing.agg(F.count("*").alias("k")))).where(F.col("marker") | (F.col("from_end") > F.col("k")))
    return kept.select("gene").unionAll(missing)


def scale(expr: DataFrame, cells: DataFrame, stats: DataFrame, most: float = 10.0) -> DataFrame:
    """(cell_id, gene, value): (value - mean) / std, clipped, for every cell and every gene of stats; absent values are zeros before scaling.

    A cell's values of the panel are gathered in one map (the panel bounds it), and the panel is laid out against it: one
    shuffle of what is there, none of the dense grid. (cell_id, gene) comes once.
    """
    panel = stats.agg(F.collect_list(F.struct("gene", "mean", "std")).alias("panel"))
    there = expr.join(F.broadcast(stats.select("gene")), "gene", "left_semi").groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene", "value"))).alias("has"))
    laid = cells.select("cell_id").distinct().join(there, "cell_id", "left").join(F.broadcast(panel)).select("cell_id", "has", F.explode("panel").alias("g"))
    value = (F.coalesce(F.try_element_at("has", F.col("g.gene")), F.lit(0.0)) - F.col("g.mean")) / F.col("g.std")
    return laid.select("cell_id", F.col("g.gene").alias("gene"), F.greatest(F.lit(-most), F.least(F.lit(most), value)).alias("value"))


def subject_gene_features(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """(subject_id, gene, mean, std): per subject, with population deviations."""
    rows = expr.join(cells.select("cell_id", "subject_id"), "cell_id")
    return rows.groupBy("subject_id", "gene").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def cell_type_shares(cells: DataFrame, n_types: int) -> DataFrame:
    """(subject_id, cell_type_id, share) over a fixed range of types."""
    counts = cells.groupBy("subject_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("cell_type_id") == k).alias(f"t{k}") for k in range(n_types)))
    types = F.explode(F.array(*(F.struct(F.lit(k).alias("cell_type_id"), (F.col(f"t{k}") / F.col("n")).alias("share")) for k in range(n_types))))
    return counts.select("subject_id", types.alias("t")).select("subject_id", "t.cell_type_id", "t.share")


def majority(rows: DataFrame, by: str, column: str) -> DataFrame:
    """(by, column): the most frequent value, ties to the smallest; nulls don't vote."""
    return rows.groupBy(by).agg(F.mode(column, True).alias(column))


def shared_genes(panels: DataFrame) -> DataFrame:
    """Genes of (source, gene) that every source has."""
    n = panels.agg(F.count_distinct("source").alias("n"))
    return panels.groupBy("gene").agg(F.count_distinct("source").alias("k")).join(F.broadcast(n)).where("k = n").select("gene")


def project_panel(expr: DataFrame, cells: DataFrame, panel: DataFrame) -> DataFrame:
    """(cell_id, gene, value) on the panel's genes for every cell; genes that a cell lacks are 0."""
    grid = cells.select("cell_id").distinct().join(F.broadcast(panel.select("gene").distinct()))
    return grid.join(expr.select("cell_id", "gene", "value"), ["cell_id", "gene"], "left").select("cell_id", "gene", F.coalesce("value", F.lit(0.0)).alias("value"))


def compare_panels(fitted: DataFrame, given: DataFrame) -> DataFrame:
    """One row: n_missing, n_unexpected, n_duplicate and coverage of the genes `given` against those fitted."""
    mine, theirs = fitted.select("gene").distinct().withColumn("a", F.lit(1)), given.groupBy("gene").agg(F.count("*").alias("b"))
    both = mine.join(theirs, "gene", "full")
    return both.agg(
        F.count_if(F.col("b").isNull()).alias("n_missing"), F.count_if(F.col("a").isNull()).alias("n_unexpected"), F.count_if(F.col("b") > 1).alias("n_duplicate"),
        (F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("a")).alias("coverage"))


def mean_by_symbol(expr: DataFrame, probes: DataFrame) -> DataFrame:
    """(sample_id, symbol, value): the mean over a symbol's probes; probes without symbol are dropped, of a probe's symbols the last holds."""
    last = probes.where(F.trim("symbol") != "").groupBy("probe").agg(F.max_by("symbol", "line_no").alias("symbol"))
    return expr.join(last, "probe").groupBy("sample_id", "symbol").agg(F.avg("value").alias("value"))


def merge_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of (cell_id, gene, value) on the genes that all share, with `source` and `batch` (source_i by position)."""
    tagged = None
    for i, (name, df) in enumerate(sources.items()):
        part = df.select("cell_id", "gene", "value", F.lit(name).alias("source"), F.lit(f"source_{i}").alias("batch"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.join(F.broadcast(shared_genes(tagged.select("source", "gene"))), "gene", "left_semi").select("cell_id", "gene", "value", "source", "batch")


def harmonize_genes(expr: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename genes by (gene, symbol); unmapped ones go, and repeats of a symbol within a cell get suffixes -1, -2, ..."""
    named = expr.join(mapping.select("gene", "symbol"), "gene")
    k = F.row_number().over(Window.partitionBy("cell_id", "symbol").orderBy("gene")) - 1
    return named.withColumn("k", k).select("cell_id", F.when(F.col("k") == 0, F.col("symbol")).otherwise(F.concat("symbol", F.lit("-"), F.col("k").cast("string"))).alias("gene"), "value")


def detect_platform(genes: DataFrame, order: str = "pos") -> DataFrame:
    """One row: affymetrix or ensembl if all of the first 20 ids have its form, else unknown."""
    first = genes.orderBy(order).limit(20)
    affy, ensembl = F.col("gene").rlike(r"(?i)^\d+(_[a-z]+)?_at$"), F.col("gene").rlike(r"^ENSG\d+(\.\d+)?$")
    return first.agg(F.when(F.every(affy), "affymetrix").when(F.every(ensembl), "ensembl").otherwise("unknown").alias("platform"))


def outcome_max(outcomes: DataFrame) -> DataFrame:
    """One outcome a subject: any positive wins, unknown only where nothing is known."""
    return outcomes.groupBy(F.col("subject_id").cast("string").alias("subject_id")).agg(F.max("outcome").alias("outcome"))


def subject_bags(cells: DataFrame, outcomes: DataFrame, min_cells: int = 50) -> DataFrame:
    """(subject_id, n_cells, source, outcome, outcome_known) of subjects with enough cells; an unmatched outcome is null, never 0."""
    bags = cells.groupBy("subject_id").agg(F.count("*").alias("n_cells"), F.mode("source", True).alias("source")).where(F.col("n_cells") >= min_cells)
    return bags.join(outcomes, "subject_id", "left").withColumn("outcome_known", F.col("outcome").isNotNull())


def pooled(expr: DataFrame, cells: DataFrame, how: str = "mean") -> DataFrame:
    """Mean or max pooling of the cells of each subject: (subject_id, gene, value)."""
    rows = expr.join(cells.select("cell_id", "subject_id"), "cell_id")
    return rows.groupBy("subject_id", "gene").agg((F.avg if how == "mean" else F.max)("value").alias("value"))


def attention_pool(expr: DataFrame, scores: DataFrame) -> DataFrame:
    """(subject_id, gene, value): means weighted by the softmax of (cell_id, subject_id, score) within each subject."""
    top = scores.groupBy("subject_id").agg(F.max("score").alias("top"))
    e = scores.join(top, "subject_id").select("cell_id", "subject_id", F.exp(F.col("score") - F.col("top")).alias("e"))
    norm = e.groupBy("subject_id").agg(F.sum("e").alias("s"))
    weights = e.join(norm, "subject_id").select("cell_id", "subject_id", (F.col("e") / F.col("s")).alias("w"))
    return expr.join(weights, "cell_id").groupBy("subject_id", "gene").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def module_scores(expr: DataFrame, modules: DataFrame) -> DataFrame:
    """(cell_id, module, score): the mean of a module's genes in a cell; modules is (module, gene)."""
    return expr.join(F.broadcast(modules.distinct()), "gene").groupBy("cell_id", "module").agg(F.avg("value").alias("score"))


def module_coverage(modules: DataFrame, panel: DataFrame, min_genes: int = 3) -> DataFrame:
    """(module, n_genes, n_covered, usable): how much of each module is on the panel."""
    known = modules.distinct().join(panel.select("gene").distinct().withColumn("on", F.lit(1)), "gene", "left")
    return known.groupBy("module").agg(F.count("*").alias("n_genes"), F.count("on").alias("n_covered"), (F.count("on") >= min_genes).alias("usable"))


def synthetic_modules(genes: DataFrame, n_modules: int, size: int, order: Column) -> DataFrame:
    """(module, gene): for each of n_modules the first `size` genes by `order`, a draw over module and gene."""
    grid = genes.select("gene").distinct().select("gene", F.explode(F.sequence(F.lit(0), F.lit(n_modules - 1))).alias("module"))
    return grid.withColumn("k", F.row_number().over(Window.partitionBy("module").orderBy(order, "gene"))).where(F.col("k") <= size).select("module", "gene")
