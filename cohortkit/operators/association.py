"""Tests of association between each variable and the binary outcome.

Sufficient statistics are Spark aggregates (per-group count/mean/variance for
Welch; value x label counts for chi-square and Fisher). Tail probabilities are
evaluated last, on one row per variable.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from cohortkit.functions.columns import qcol
from cohortkit.functions.formatting import significance_stars
from cohortkit.functions.special import (chi2_sf, chi2_sf_udf, fisher_two_sided, fisher_udf, t_two_sided,
                                         t_two_sided_udf)
from cohortkit.operators.profile import ALL_GROUP, describe_by_group, long_values  # noqa: F401
from cohortkit.session import checkpoint_dir
from cohortkit.spec import CATEGORICAL_MAX_DISTINCT, CohortSpec

TEST_T = "t-test"
TEST_FISHER = "fisher-exact"
TEST_CHI2 = "chi-square"
FISHER_MIN_CELL = 5


def contingency(df: DataFrame, spec: CohortSpec, variables) -> DataFrame:
    """Long contingency table (variable, value, label, n) for the listed variables.

    One scan; the (variable, value, label) aggregate is combined map-side, so
    the shuffle carries at most partitions x cells rows.
    """
    lv = long_values(df, variables, extra=(spec.label,))
    return (lv.filter(F.col(spec.label).isNotNull())
            .groupBy("variable", "value", F.col(spec.label).alias("label"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def _table_shape(cont: DataFrame) -> DataFrame:
    """Per variable: r, c, N, observed cells, min cell over the full r x c grid,
    and chi-square (with Yates' correction when dof = 1)."""
    rt = cont.groupBy("variable", "value").agg(F.sum("n").alias("row_n"))
    ct = cont.groupBy("variable", "label").agg(F.sum("n").alias("col_n"))
    # cell, row and column totals meet in equi-joins (distributed by key, no single task)
    # products of counts are taken in double: four totals overflow a bigint from about 10^5 rows
    cells = (cont.withColumn("n", F.col("n").cast("double"))
             .join(rt.withColumn("row_n", F.col("row_n").cast("double")), ["variable", "value"])
             .join(ct.withColumn("col_n", F.col("col_n").cast("double")), ["variable", "label"]))
    tot = cont.groupBy("variable").agg(
        F.sum("n").cast("double").alias("nn"),
        F.count_distinct("value").alias("r"), F.count_distinct("label").alias("c"),
        F.count(F.lit(1)).alias("cells"), F.min("n").alias("min_nonzero"),
        F.min("value").alias("vmin"), F.min("label").alias("lmin"))
    cells = cells.join(tot, "variable").withColumn("E", F.col("row_n") * F.col("col_n") / F.col("nn"))
    # 2x2 cells in canonical order (lowest value / label first) from plain
    # aggregates: no window, so no task ever holds all cells of a variable
    v1, l1 = F.col("value") == F.col("vmin"), F.col("label") == F.col("lmin")
    agg = cells.groupBy("variable").agg(
        F.first("nn").alias("nn"), F.first("r").alias("r"), F.first("c").alias("c"),
        F.first("cells").alias("cells"), F.first("min_nonzero").alias("min_nonzero"),
        F.sum(F.col("n") * F.col("n") / F.col("E")).alias("sum_o2_e"),
        F.sum(F.when(v1 & l1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(v1 & ~l1, F.col("n")).otherwise(0)).alias("b"),
        F.sum(F.when(~v1 & l1, F.col("n")).otherwise(0)).alias("c2"),
        F.sum(F.when(~v1 & ~l1, F.col("n")).otherwise(0)).alias("d"),
    )
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    min_cell = F.when(F.col("cells") < F.col("r") * F.col("c"), F.lit(0)).otherwise(F.col("min_nonzero"))
    r1, c1 = F.col("a") + F.col("b"), F.col("a") + F.col("c2")
    r2, c2 = F.col("c2") + F.col("d"), F.col("b") + F.col("d")
    dev = F.abs(F.col("a") - r1 * c1 / F.col("nn"))
    yates = (F.pow(F.greatest(dev - 0.5, F.lit(0.0)), 2) * F.pow(F.col("nn"), 3)
             / (r1 * r2 * c1 * c2))
    chi2 = F.when(dof == 0, F.lit(0.0)).when(dof == 1, yates).otherwise(F.col("sum_o2_e") - F.col("nn"))
    return agg.select("variable", F.col("nn").cast("bigint").alias("n"), "r", "c",
                      dof.cast("int").alias("dof"), min_cell.cast("bigint").alias("min_cell"),
                      F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"),
                      F.col("c2").cast("bigint").alias("c_"), F.col("d").cast("bigint").alias("d"),
                      F.greatest(chi2, F.lit(0.0)).alias("statistic"))


def chi_square_test(cont: DataFrame) -> DataFrame:
    """chi-square test of independence per variable.

    Yates' continuity correction when dof = 1; dof = 0 gives statistic 0, p 1.
    Schema: variable, statistic, dof, p_value.
    """
    shape = _table_shape(cont)
    return shape.select("variable", "statistic", "dof",
                        chi2_sf_udf(F.col("statistic"), F.col("dof").cast("double")).alias("p_value"))


def fisher_exact_test(cont: DataFrame) -> DataFrame:
    """Two-sided Fisher exact test for variables with a 2 x 2 table.

    Schema: variable, a, b, c, d, p_value (cells in value/label order)."""
    shape = _table_shape(cont).filter((F.col("r") == 2) & (F.col("c") == 2))
    return shape.select("variable", "a", "b", F.col("c_").alias("c"), "d",
                        fisher_udf(F.col("a").cast("double"), F.col("b").cast("double"),
                                   F.col("c_").cast("double"), F.col("d").cast("double")).alias("p_value"))


def welch_from_profile(profile: DataFrame, spec: CohortSpec) -> DataFrame:
    """Welch's unequal-variance t-test from the grouped profile table.

    Schema: variable, t, dof, p_value (NULL when a group is empty or a
    variance is undefined)."""
    g = profile.filter(F.col("grp").isin(spec.positive, spec.negative))
    p = g.groupBy("variable").agg(
        F.max(F.when(F.col("grp") == spec.positive, F.col("count"))).alias("n1"),
        F.max(F.when(F.col("grp") == spec.positive, F.col("mean"))).alias("m1"),
        F.max(F.when(F.col("grp") == spec.positive, F.col("std"))).alias("s1"),
        F.max(F.when(F.col("grp") == spec.negative, F.col("count"))).alias("n2"),
        F.max(F.when(F.col("grp") == spec.negative, F.col("mean"))).alias("m2"),
        F.max(F.when(F.col("grp") == spec.negative, F.col("std"))).alias("s2"))
    v1 = F.try_divide(F.col("s1") * F.col("s1"), F.col("n1").cast("double"))
    v2 = F.try_divide(F.col("s2") * F.col("s2"), F.col("n2").cast("double"))
    se2 = v1 + v2
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(se2))
    dof = F.try_divide(se2 * se2, F.try_divide(v1 * v1, F.col("n1") - 1.0) + F.try_divide(v2 * v2, F.col("n2") - 1.0))
    ok = (F.col("n1") > 0) & (F.col("n2") > 0)
    out = p.select("variable", F.when(ok, t).alias("t"), F.when(ok, dof).alias("dof"))
    return out.withColumn("p_value", t_two_sided_udf(F.col("t"), F.col("dof")))


def welch_t_test(df: DataFrame, spec: CohortSpec, variables=None) -> DataFrame:
    """Welch's t-test of each numeric variable between the outcome groups."""
    return welch_from_profile(describe_by_group(df, spec, variables), spec)


PROFILE_SCHEMA = ("grp string, variable string, min double, max double, mean double, std double, "
                  "count bigint, missing bigint, missing_ratio double")
SCREEN_SCHEMA = "variable string, p_value double, test_type string, significant boolean, significance_level string"


def local_profile(df: DataFrame, spec: CohortSpec, variables=None) -> DataFrame:
    """The grouped profile as a small local table: 3 x p rows reach the driver, and no later use scans again."""
    rows = describe_by_group(df, spec, variables).collect()
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], PROFILE_SCHEMA)


def small_tables(df: DataFrame, spec: CohortSpec, variables, limit: int = CATEGORICAL_MAX_DISTINCT) -> dict:
    """{variable: {(value, label): n}} of variables with at most ``limit`` distinct values, exact; None for others.

    One scan. A task counts a variable's (value, label) cells until it has seen
    more than ``limit`` values, then says so and counts it no further; so at most
    (limit + 1) values a variable leave a task, however many there are. Labels other
    than the two outcomes are one label, None; they count as values, not in tests.
    """
    variables = list(variables)
    outcome = F.when(qcol(spec.label).isin(spec.positive, spec.negative), qcol(spec.label).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict = {i: Counter() for i in range(len(variables))}
        wide = set()
        for batch in batches:
            for i in [i for i in cells if i not in wide]:
                pairs = pa.table([batch.column(i + 1), batch.column(0)], names=["value", "label"])
                pairs = pairs.filter(pc.is_valid(pairs.column("value")))
                for r in pairs.group_by(["value", "label"]).aggregate([([], "count_all")]).slice(0, 3 * limit + 4).to_pylist():
                    cells[i][str(r["value"]), r["label"]] += r["count_all"]
                if len({v for v, _ in cells[i]}) > limit:
                    wide.add(i)
                    cells[i].clear()
        rows = [(i, None, None, 0) for i in wide] + [(i, v, g, n) for i, of in cells.items() for (v, g), n in of.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("ord", "value", "label", "n"), r)) for r in rows], pa.schema(
            [("ord", pa.int32()), ("value", pa.string()), ("label", pa.string()), ("n", pa.int64())]))

    checkpoint_dir(df.sparkSession)
    # numbers travel as they are; only a table's few values become text, and only to be told apart
    plain = [qcol(c) if isinstance(df.schema[c].dataType, (NumericType, StringType)) else qcol(c).cast("string") for c in variables]
    counted = df.select(outcome.alias("label"), *[x.alias(f"v{i}") for i, x in enumerate(plain)])
    merged = (counted.mapInArrow(run, "ord int, value string, label string, n bigint")
              .groupBy("ord", "value", "label").agg(F.sum("n").alias("n")).checkpoint())
    # a marker has no value; tables of several tasks can pass the limit together
    sizes = merged.groupBy("ord").agg(F.count_if(F.col("value").isNull()).alias("wide"), F.count_distinct("value").alias("k"))
    small = [r["ord"] for r in sizes.collect() if not r["wide"] and r["k"] <= limit]
    kept = {variables[i]: {} for i in small}
    for r in merged.filter(F.col("ord").isin(small)).collect() if small else []:  # at most 3 x limit cells a variable
        kept[variables[r["ord"]]][r["value"], r["label"]] = r["n"]
    return kept


def contingency_test(cells: dict) -> tuple[float, str] | None:
    """(p, test) of one small table {(value, label): n}: Fisher for a 2 x 2 table with a cell below 5, else chi-square."""
    cells = {at: n for at, n in cells.items() if at[1] is not None}
    if not cells:
        return None
    values, labels = sorted({v for v, _ in cells}), sorted({g for _, g in cells})
    full = [[cells.get((v, g), 0) for g in labels] for v in values]
    n = float(sum(map(sum, full)))
    rows, columns = [sum(r) for r in full], [sum(c) for c in zip(*full)]
    dof = (len(values) - 1) * (len(labels) - 1)
    if len(values) == len(labels) == 2 and min(map(min, full)) < FISHER_MIN_CELL:
        return fisher_two_sided(*full[0], *full[1]), TEST_FISHER
    if dof == 0:
        statistic = 0.0
    elif dof == 1:
        off = abs(full[0][0] - rows[0] * columns[0] / n)
        statistic = max(off - 0.5, 0.0) ** 2 * n**3 / (float(rows[0]) * rows[1] * columns[0] * columns[1])
    else:
        statistic = sum(float(x) * x / (r * c / n) for row, r in zip(full, rows) for x, c in zip(row, columns)) - n
    return chi2_sf(max(statistic, 0.0), float(dof)), TEST_CHI2


def association_screen(df: DataFrame, spec: CohortSpec, alpha: float = 0.05, variables=None,
                       profile: DataFrame | None = None) -> DataFrame:
    """Test every structured variable and rank by p (NULLs last, then name).

    Dispatch: forced-categorical or 2..10 distinct values -> contingency test
    (Fisher when the table is 2 x 2 and some observed cell < 5, else
    chi-square); other numeric columns -> Welch t-test; remaining columns ->
    chi-square. Variables without any value are skipped.

    Scans: the grouped profile (skipped when ``profile`` is given), and
    ``small_tables``, which tells exactly which variables have few values and
    holds their counts. Variables with many values that are categorical all the
    same are counted and tested as Spark aggregates. Per-variable numbers and the
    cells of small tables reach the driver.
    Schema: variable, p_value, test_type, significant, significance_level.
    """
    variables = list(variables or spec.variables)
    spark = df.sparkSession
    if profile is None:
        profile = local_profile(df, spec, variables)
    by_group: dict = {}
    for r in profile.collect():  # three rows a variable
        by_group.setdefault(r["variable"], {})[r["grp"]] = r
    present = [v for v in variables if v in by_group and ALL_GROUP in by_group[v] and by_group[v][ALL_GROUP]["count"] > 0]
    numeric = {v for v in variables if isinstance(df.schema[v].dataType, NumericType)}
    tables = small_tables(df, spec, present) if present else {}
    found, wide = [], []
    for v in present:
        few = v in tables and (v in spec.categorical or len({x for x, _ in tables[v]}) >= 2)
        if few or (v in tables and v not in numeric):
            test = contingency_test(tables[v])
            if test is not None:
                found.append((v, *test))
        elif v in spec.categorical or v not in numeric:
            wide.append(v)
        else:
            found.append((v, _welch_p(by_group[v].get(spec.positive), by_group[v].get(spec.negative)), TEST_T))
    res = spark.createDataFrame(found, "variable string, p_value double, test_type string")
    if wide:
        shape = _table_shape(contingency(df.filter(qcol(spec.label).isin(spec.positive, spec.negative)), spec, wide))
        use_fisher = (F.col("min_cell") < FISHER_MIN_CELL) & (F.col("r") == 2) & (F.col("c") == 2)
        # Python UDFs run for every row whatever the condition around them: rows not asked for get no input
        exact = [F.when(use_fisher, F.col(c).cast("double")) for c in ("a", "b", "c_", "d")]
        usual = F.when(~use_fisher, F.col("statistic"))
        res = res.unionByName(shape.select(
            "variable", F.when(use_fisher, fisher_udf(*exact)).otherwise(chi2_sf_udf(usual, F.col("dof").cast("double"))).alias("p_value"),
            F.when(use_fisher, TEST_FISHER).otherwise(TEST_CHI2).alias("test_type")))
    p = F.col("p_value")
    return (res.select("variable", p.alias("p_value"), "test_type",
                       F.coalesce(p < alpha, F.lit(False)).alias("significant"),
                       significance_stars(p).alias("significance_level"))
            .orderBy(p.asc_nulls_last(), "variable"))


def _welch_p(one, other) -> float | None:
    """Welch's p from two profile rows; None when a group is empty or a variance undefined."""
    if one is None or other is None or not one["count"] or not other["count"] or None in (one["std"], other["std"]):
        return None
    v1, v2 = one["std"] ** 2 / one["count"], other["std"] ** 2 / other["count"]
    if v1 + v2 <= 0:
        return None
    parts = sum(v * v / (r["count"] - 1) for v, r in ((v1, one), (v2, other)) if r["count"] > 1)
    return t_two_sided((one["mean"] - other["mean"]) / (v1 + v2) ** 0.5, (v1 + v2) ** 2 / parts) if parts > 0 else None


def significant_variables(screen: DataFrame) -> DataFrame:
    """The significant rows of a screen, by p."""
    return screen.filter("significant").select("variable", "p_value", "significance_level", "test_type") \
        .orderBy(F.col("p_value").asc_nulls_last(), "variable")


def cohens_d(profile: DataFrame, spec: CohortSpec) -> DataFrame:
    """Standardised mean difference (case - control) / pooled SD."""
    g = profile.filter(F.col("grp").isin(spec.positive, spec.negative))
    p = g.groupBy("variable").agg(
        F.max(F.when(F.col("grp") == spec.positive, F.col("count"))).alias("n1"),
        F.max(F.when(F.col("grp") == spec.positive, F.col("mean"))).alias("m1"),
        F.max(F.when(F.col("grp") == spec.positive, F.col("std"))).alias("s1"),
        F.max(F.when(F.col("grp") == spec.negative, F.col("count"))).alias("n2"),
        F.max(F.when(F.col("grp") == spec.negative, F.col("mean"))).alias("m2"),
        F.max(F.when(F.col("grp") == spec.negative, F.col("std"))).alias("s2"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("s1") * F.col("s1") + (F.col("n2") - 1) * F.col("s2") * F.col("s2"),
                                 (F.col("n1") + F.col("n2") - 2).cast("double")))
    return p.select("variable", F.try_divide(F.col("m1") - F.col("m2"), pooled).alias("cohens_d"))


def p_adjust(screen: DataFrame, p_col: str = "p_value") -> DataFrame:
    """Bonferroni and Benjamini-Hochberg adjusted p-values.

    Runs on the screen table (one row per variable), so the un-partitioned
    windows below see at most p rows.
    """
    p = F.col(p_col)
    tested = screen.filter(p.isNotNull())
    m = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = tested.withColumn("__m", m).withColumn(
        "__rank", F.row_number().over(Window.orderBy(p, "variable")))
    bh_raw = p * F.col("__m") / F.col("__rank")
    down = Window.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adj = (ranked.withColumn("p_bonferroni", F.least(p * F.col("__m"), F.lit(1.0)))
           .withColumn("p_bh", F.least(F.min(bh_raw).over(down), F.lit(1.0)))
           .drop("__m", "__rank"))
    untested = screen.filter(p.isNull()).withColumn("p_bonferroni", F.lit(None).cast("double")) \
        .withColumn("p_bh", F.lit(None).cast("double"))
    return adj.unionByName(untested).orderBy(p.asc_nulls_last(), "variable")
