"""Labels with explicit unknown states, identities and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.parse import integral

#: Name to class id (fixed values); other names are class 5.
SMOKE_IDS = {"cigarette": 0, "vape": 1, "ecig": 1, "e-cig": 1, "cigar": 2, "cannabis": 3, "weed": 3, "dual_use": 4, "dual": 4, "unexposed": 5, "never": 5, "control": 5}
#: Patterns in the order in which they are tried (fixed values).
UNEXPOSED, CIGARETTE = r"(?i)\bnever\b|\bnon-?smoker\b|\bcontrol\b", r"(?i)\bcurrent\b|\bsmoker\b|\bever\b|\bcigarette\b"
#: States that supervise.
SUPERVISED = ("known_positive", "known_negative")


def smoke_status(text: Column) -> Column:
    """unexposed, cigarette or unknown; the unexposed patterns come first, as 'never smoker' has both."""
    return F.when(text.rlike(UNEXPOSED), "unexposed").when(text.rlike(CIGARETTE), "cigarette").otherwise("unknown")


def smoke_id(name: Column, default: int = 5) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in SMOKE_IDS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(name))), F.lit(default)).cast("int")


def stamp_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add the columns that are missing; fill nulls of those that are there."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def verified_subjects(samples: DataFrame, title: str = "title", sample: str = "sample_id", pattern: str = r"(?i)patient[_\s]?(\d+)") -> DataFrame:
    """Adds subject_id and subject_id_verified: numbers from the titles if all match and none repeats, else each sample's own id, unverified."""
    number = F.regexp_extract(F.coalesce(F.col(title), F.lit("")), pattern, 1)
    gate = samples.agg((F.every(number != "") & (F.count_distinct(number) == F.count("*"))).alias("subject_id_verified"))
    both = samples.join(F.broadcast(gate))
    return both.withColumn("subject_id", F.when(F.col("subject_id_verified"), F.concat(F.lit("patient_"), number)).otherwise(F.col(sample).cast("string")))


def clinical_smoking(cigarette: Column, cigar: Column) -> Column:
    """Codes 1 and 2 of cigarette use, 1 of cigar use; both: dual_use; neither: null, which is unknown and not negative."""
    a, b = F.coalesce(integral(cigarette).isin(1, 2), F.lit(False)), F.coalesce(integral(cigar) == 1, F.lit(False))
    return F.when(a & b, "dual_use").when(a, "cigarette").when(b, "cigar")


def three_field_class(cannabis: Column, cigarette: Column, vape: Column) -> Column:
    """Class of (cannabis, cigarette, vape) answers."""
    c, g, v = F.lower(F.trim(cannabis)).startswith("cannabis"), F.lower(F.trim(cigarette)).isin("current", "former"), F.lower(F.trim(vape)) == "yes"
    c, g, v = (F.coalesce(x, F.lit(False)) for x in (c, g, v))
    return F.when(c & (g | v), "dual_use").when(c, "cannabis").when(g, "cigarette").when(v, "vape").otherwise("unexposed")


def weak_proxy(df: DataFrame, enabled: bool = False) -> DataFrame:
    """By default nothing; enabled, a known proxy value becomes the label and counts as known."""
    if not enabled:
        return df
    use = F.col("proxy_known") & ~F.col("known")
    return df.withColumns({"label": F.when(use, F.col("proxy_value")).otherwise(F.col("label")), "known": F.col("known") | use})


def transfer_labels(cells: DataFrame, records: DataFrame, on: str, value: str, order: str) -> DataFrame:
    """Left join of the last record of each id; matched rows take its value and become known, others keep what they have."""
    last = records.groupBy(on).agg(F.max_by(value, order).alias("_value"))
    joined = cells.join(last, on, "left")
    return joined.withColumns({"label": F.coalesce("_value", "label"), "known": F.col("known") | F.col("_value").isNotNull()}).drop("_value")


def rare_classes(subjects: DataFrame, targets: list, least: int = 3) -> DataFrame:
    """(label, n, rare) of the target classes that occur: rare below `least` distinct subjects."""
    n = subjects.where(F.col("label").isin(targets)).groupBy("label").agg(F.count_distinct("subject_id").alias("n"))
    return n.withColumn("rare", F.col("n") < least)


def apply_rare_policy(subjects: DataFrame, targets: list, policy: str, into: object = None, least: int = 3) -> DataFrame:
    """keep, merge (into another class) or exclude rows of rare target classes."""
    if policy == "keep":
        return subjects
    rare = rare_classes(subjects, targets, least).where("rare").select("label", F.lit(True).alias("rare"))
    marked = subjects.join(F.broadcast(rare), "label", "left")
    if policy == "exclude":
        return marked.where("rare is null").drop("rare")
    return marked.withColumn("label", F.when(F.col("rare"), F.lit(into)).otherwise(F.col("label"))).drop("rare")


def effective_mapping(classes: DataFrame, dropped: list) -> DataFrame:
    """(label, effective): the remaining ids renumbered from 0 in order."""
    left = classes.where(~F.col("label").isin(dropped)).select("label").distinct()
    return left.withColumn("effective", F.row_number().over(Window.orderBy("label")) - 1)  # a row a class


def ortholog_map(pairs: DataFrame, policy: str = "one_to_one_only") -> DataFrame:
    """(mouse_gene, human_gene) by policy; blank names are dropped. A human gene in two rows, even equal ones, is not one to one."""
    rows = pairs.where((F.trim("mouse_gene") != "") & (F.trim("human_gene") != ""))
    if policy != "one_to_one_only":
        return rows.groupBy("mouse_gene").agg(F.min("human_gene").alias("human_gene"))
    human = rows.groupBy("human_gene").agg(F.count("*").alias("n"))
    mouse = rows.groupBy("mouse_gene").agg(F.count_distinct("human_gene").alias("k"), F.min("human_gene").alias("human_gene"))
    return mouse.where("k = 1").join(human.where("n = 1"), "human_gene").select("mouse_gene", "human_gene")


def map_names(df: DataFrame, names: DataFrame, column: str, default: object = None) -> DataFrame:
    """Look `column` up in (name, id): unmatched rows are dropped, or take the default."""
    joined = df.join(F.broadcast(names.select(F.col("name").alias(column), "id")), column, "inner" if default is None else "left")
    return joined if default is None else joined.withColumn("id", F.coalesce("id", F.lit(default)))


def unknown_to_null(label: str = "label", known: str = "known") -> Column:
    return F.when(F.col(known), F.col(label))


def exclusion_cascade(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds `reason`: the first that holds, null where none does."""
    out = F.when(reasons[0][1], reasons[0][0])
    for name, holds in reasons[1:]:
        out = out.when(holds, name)
    return rows.withColumn("reason", out)


def exclusion_counts(rows: DataFrame) -> DataFrame:
    """(reason, n), 'included' for rows without reason."""
    return rows.groupBy(F.coalesce("reason", F.lit("included")).alias("reason")).agg(F.count("*").alias("n"))


def repeated(key: str) -> Column:
    """Whether the key occurs more than once: every copy counts as repeated."""
    return F.count("*").over(Window.partitionBy(key)) > 1


def label_quality(rows: DataFrame, split: str = "split") -> DataFrame:
    """(split, n, n_known, n_unknown, n_weak), and a row `all`, in one pass over grouping sets."""
    total = rows.rollup(split).agg(F.grouping(split).alias("_all"), F.count("*").alias("n"), F.count_if("known").alias("n_known"), F.count_if(~F.col("known")).alias("n_unknown"), F.count_if("weak").alias("n_weak"))
    return total.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(split)).alias(split), "n", "n_known", "n_unknown", "n_weak")
