"""Registered queries over the driver tables, and their DuckDB oracles.

Each query takes (spark, sf_dir) and returns a DataFrame that reads whole
tables. Computed doubles are rounded to 6 decimals on both sides so that
summation order does not decide the comparison.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from cohortkit.functions.columns import NUMBER_PATTERN
from cohortkit.functions.formatting import format_mean_sd, format_p_value, pct, significance_stars
from cohortkit.functions.hashing import hash_hex_sql, uniform, uniform_sql
from cohortkit.functions.special import t_two_sided_sql
from cohortkit.operators import association as assoc
from cohortkit.operators import balance as BA
from cohortkit.operators import clean, profile
from cohortkit.operators import evaluate as EV
from cohortkit.operators import exact_tree as ET
from cohortkit.operators import features as FE
from cohortkit.operators import forest as FO
from cohortkit.operators import importance as IM
from cohortkit.operators import neighbours as NB
from cohortkit.operators import network as NN
from cohortkit.operators import reduce as RD
from cohortkit.operators import split as S
from cohortkit.operators import text as TX
from cohortkit.operators.calibration import fit_sigmoid
from cohortkit.operators.features import FEATURE_SETS
from cohortkit.plans import oracle as O
from cohortkit.plans.cohort import categorical_report, cohort_summary
from cohortkit.session import checkpoint_dir, stage_path
from cohortkit.sources import (bucket_count, read_bucketed, read_feature_table, write_bucketed, write_csv_report,
                               write_feature_table, write_labels, write_result_tables)
from cohortkit.spec import DEFAULT_NA_TOKENS, SHEET_NA_TOKENS, CohortSpec
from cohortkit.spec import LINEITEM_COHORT as LI

DIGITS = 6
QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column (and normalise -0.0)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append((F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


# --- lineitem as a cohort ----------------------------------------------------

LI_KEEP = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
           "l_returnflag", "l_linestatus"]
LI_NUMERIC = list(LI.numeric)
LI_VARS = LI.variables
LI_CLEAN_SQL = O.clean_select(LI, "lineitem", LI_KEEP)


def lineitem_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem after the load step (NA tokens, coercion, range and zero rules)."""
    raw = table(spark, sf_dir, "lineitem").select(*LI_KEEP)
    return clean.clean_cohort(raw, LI)


@register("range_clean", O.rounded(LI_CLEAN_SQL, LI_NUMERIC))
def q_range_clean(spark, sf_dir):
    return rounded(lineitem_cohort(spark, sf_dir))


@register("describe_by_group", O.rounded(
    f"WITH li AS ({LI_CLEAN_SQL}) {O.profile_sql(LI, 'li', LI_NUMERIC, LI_VARS)}",
    ["min", "max", "mean", "std", "missing_ratio"]))
def q_describe_by_group(spark, sf_dir):
    return rounded(profile.describe_by_group(lineitem_cohort(spark, sf_dir), LI))


@register("welch_t_test", O.rounded(
    f"""WITH li AS ({LI_CLEAN_SQL}), {O.welch_sql_ctes(LI, 'li', LI_NUMERIC)}
    SELECT w.variable, w.t, w.dof, wp.p AS p_value FROM w JOIN wp USING (variable)""",
    ["t", "dof", "p_value"]))
def q_welch(spark, sf_dir):
    return rounded(assoc.welch_t_test(lineitem_cohort(spark, sf_dir), LI, LI_NUMERIC))


@register("chi_square_large_2x2", O.rounded("""WITH t AS (SELECT
        count(*) FILTER (l_quantity > 25 AND l_linestatus = 'F')::DOUBLE AS a,
        count(*) FILTER (l_quantity > 25 AND l_linestatus = 'O')::DOUBLE AS b,
        count(*) FILTER (l_quantity <= 25 AND l_linestatus = 'F')::DOUBLE AS c,
        count(*) FILTER (l_quantity <= 25 AND l_linestatus = 'O')::DOUBLE AS d FROM lineitem)
    SELECT 'heavy' AS variable, (a + b + c + d) * pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2)
           / ((a + b) * (c + d) * (a + c) * (b + d)) AS statistic, 1::INT AS dof FROM t""", ["statistic"]))
def q_chi2_large(spark, sf_dir):
    """A balanced 2 x 2 table over all rows: the totals' product exceeds a bigint."""
    df = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_quantity") > 25).cast("string").alias("heavy"))
    return rounded(assoc.chi_square_test(assoc.contingency(df, LI, ["heavy"])).drop("p_value"))


@register("chi_square_test", O.rounded(
    f"""WITH li AS ({LI_CLEAN_SQL}), {O.contingency_ctes(LI, 'li', ['l_discount', 'l_tax', 'l_returnflag'])}
    SELECT s.variable, s.statistic, s.dof, chip.p AS p_value FROM shape s JOIN chip USING (variable)""",
    ["statistic", "p_value"]))
def q_chi2(spark, sf_dir):
    df = lineitem_cohort(spark, sf_dir)
    cont = assoc.contingency(df, LI, ["l_discount", "l_tax", "l_returnflag"])
    return rounded(assoc.chi_square_test(cont))


@register("association_screen", O.rounded(
    f"""WITH li AS ({LI_CLEAN_SQL}), {O.screen_ctes(LI, 'li', LI_VARS, LI_NUMERIC)}
    SELECT * FROM screen""", ["p_value"]))
def q_screen(spark, sf_dir):
    return rounded(assoc.association_screen(lineitem_cohort(spark, sf_dir), LI))


def _summary_sql() -> str:
    prof = O.profile_sql(LI, "li", LI_NUMERIC, LI_VARS)
    pos, neg = O.lit(LI.positive), O.lit(LI.negative)

    def msd(g):
        return (f"CASE WHEN max(mean) FILTER (WHERE grp = {g}) IS NULL THEN 'no data' ELSE "
                f"printf('%.2f (%.2f)', max(mean) FILTER (WHERE grp = {g}), max(std) FILTER (WHERE grp = {g})) END")
    return f"""WITH li AS ({LI_CLEAN_SQL}), {O.screen_ctes(LI, 'li', LI_VARS, LI_NUMERIC)},
      prof AS ({prof}),
      wide AS (SELECT variable, {msd("'all'")} AS total_mean_sd, {msd(pos)} AS case_mean_sd,
                      {msd(neg)} AS control_mean_sd,
                      coalesce(max(count) FILTER (WHERE grp = 'all'), 0)::INTEGER AS total_n,
                      coalesce(max(count) FILTER (WHERE grp = {pos}), 0)::INTEGER AS case_n,
                      coalesce(max(count) FILTER (WHERE grp = {neg}), 0)::INTEGER AS control_n
               FROM prof GROUP BY variable)
    SELECT wide.variable, total_mean_sd, case_mean_sd, control_mean_sd, screen.p_value,
           coalesce(screen.test_type, 'untested') AS test_type, total_n, case_n, control_n
    FROM wide LEFT JOIN screen USING (variable)"""


@register("cohort_summary", O.rounded(_summary_sql(), ["p_value"]))
def q_cohort_summary(spark, sf_dir):
    df = lineitem_cohort(spark, sf_dir)
    prof = assoc.local_profile(df, LI)  # one scan; 3 x p rows to the driver
    screen = assoc.association_screen(df, LI, profile=prof)
    return rounded(cohort_summary(prof, screen, LI))


# --- ingest -------------------------------------------------------------------

def _na_sql(col: str) -> str:
    toks = ", ".join(O.lit(t) for t in dict.fromkeys(SHEET_NA_TOKENS + DEFAULT_NA_TOKENS))
    return f"CASE WHEN {col} IN ({toks}) THEN NULL ELSE {col} END"


@register("read_na_tokens", f"""SELECT doc_id, {_na_sql('text')} AS text, {_na_sql('lang')} AS lang,
    {_na_sql('source')} AS source, n_chars FROM documents""")
def q_read_na_tokens(spark, sf_dir):
    return clean.read_na_tokens(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


# Cells of documents that hold a missing-value token: one document in eight by id.
_NA_CELLS = ("N/A", "", " ", "NULL", "nan", "None", "n/a", "-")


_NA_CELLS_SQL = ("SELECT doc_id, CASE doc_id % 64 " + " ".join(f"WHEN {8 * i} THEN {O.lit(t)}" for i, t in enumerate(_NA_CELLS))
                 + " ELSE text END AS text, lang FROM documents")


@register("read_na_tokens_hits", f"SELECT doc_id, {_na_sql('text')} AS text, {_na_sql('lang')} AS lang FROM ({_NA_CELLS_SQL})")
def q_read_na_tokens_hits(spark, sf_dir):
    """The token rule on cells where it applies."""
    text = F.col("text")
    for i, token in enumerate(_NA_CELLS):
        text = F.when(F.col("doc_id") % 64 == 8 * i, token).otherwise(text)
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "lang")
    return clean.read_na_tokens(docs)


@register("drop_columns_if_present", "SELECT * EXCLUDE (l_shipdate) FROM lineitem")
def q_drop_columns(spark, sf_dir):
    return clean.drop_columns_if_present(table(spark, sf_dir, "lineitem"), LI.drop)


@register("select_structured_columns", O.rounded(
    f"SELECT {', '.join(LI_VARS)} FROM ({LI_CLEAN_SQL})", LI_NUMERIC))
def q_select_structured(spark, sf_dir):
    df = lineitem_cohort(spark, sf_dir)
    keep = [c for c in df.columns if c in LI_VARS]
    return rounded(df.select(*keep))


def _coerce_sql(expr: str) -> str:
    s = f"trim(CAST({expr} AS VARCHAR))"
    return (f"CASE WHEN regexp_full_match({s}, '{NUMBER_PATTERN[1:-1]}') "
            f"THEN TRY_CAST({s} AS DOUBLE) END")


@register("coerce_numeric", O.rounded(f"""SELECT event_id, {_coerce_sql('props')} AS props,
    {_coerce_sql('event_type')} AS event_type, {_coerce_sql('CAST(value AS VARCHAR)')} AS value_text,
    {_coerce_sql('CAST(user_id AS VARCHAR)')} AS user_text FROM events""",
    ["props", "event_type", "value_text", "user_text"]))
def q_coerce_numeric(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", "props", "event_type", F.col("value").cast("string").alias("value_text"),
        F.col("user_id").cast("string").alias("user_text"))
    return rounded(clean.coerce_numeric(ev, ["props", "event_type", "value_text", "user_text"]))


@register("zero_invalid", O.rounded(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0.0 THEN l_tax END AS l_tax FROM lineitem", ["l_tax"]))
def q_zero_invalid(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return rounded(clean.zero_invalid(df, ["l_tax"]))


def _audit_sql() -> str:
    parts = []
    for i, c in enumerate(list(LI.ranges) + [z for z in LI.zero_invalid if z not in LI.ranges]):
        conds = []
        if c in LI.ranges:
            lo, hi = LI.ranges[c]
            conds += [f"{c} >= {float(lo)!r}", f"{c} <= {float(hi)!r}"]
        if c in LI.zero_invalid:
            conds.append(f"{c} <> 0.0")
        keep = " AND ".join(conds)
        parts.append(f"""SELECT {O.lit(c)} AS variable, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS n_missing,
            count(*) FILTER (WHERE {c} IS NOT NULL AND NOT ({keep}))::BIGINT AS n_removed,
            count(*) FILTER (WHERE {c} IS NULL OR NOT ({keep}))::BIGINT AS n_missing_after FROM lineitem""")
    return " UNION ALL ".join(parts)


@register("cleaning_audit", _audit_sql())
def q_cleaning_audit(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(*LI_KEEP)
    return clean.cleaning_audit(clean.coerce_numeric(raw, LI_NUMERIC), LI)


@register("audit_totals", f"""SELECT sum(n_missing)::BIGINT AS total_missing, sum(n_removed)::BIGINT AS total_removed,
    sum(n_missing_after)::BIGINT AS total_missing_after,
    sum(n_missing) + sum(n_removed) = sum(n_missing_after) AS identity_holds FROM ({_audit_sql()})""")
def q_audit_totals(spark, sf_dir):
    return clean.audit_totals(q_cleaning_audit(spark, sf_dir))


# --- filters and formatting ---------------------------------------------------

@register("filter_by_label", O.rounded(f"SELECT * FROM ({LI_CLEAN_SQL}) WHERE l_linestatus = 'F'", LI_NUMERIC))
def q_filter_by_label(spark, sf_dir):
    return rounded(lineitem_cohort(spark, sf_dir).filter(F.col(LI.label) == LI.positive))


@register("drop_missing", f"""SELECT 'l_quantity' AS variable, l_linestatus AS label, count(l_quantity)::BIGINT AS n_present
    FROM ({LI_CLEAN_SQL}) WHERE l_quantity IS NOT NULL GROUP BY ALL""")
def q_drop_missing(spark, sf_dir):
    df = lineitem_cohort(spark, sf_dir).filter(F.col("l_quantity").isNotNull())
    return df.groupBy(F.lit("l_quantity").alias("variable"), F.col(LI.label).alias("label")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_present"))


@register("null_guard", f"""WITH li AS ({LI_CLEAN_SQL}), p AS ({O.profile_sql(LI, 'li', LI_NUMERIC, LI_VARS)})
    SELECT variable FROM p WHERE grp = 'all' AND count > 0""")
def q_null_guard(spark, sf_dir):
    prof = profile.describe_by_group(lineitem_cohort(spark, sf_dir), LI)
    return prof.filter((F.col("grp") == profile.ALL_GROUP) & (F.col("count") > 0)).select("variable")


_SCREEN_SQL = f"WITH li AS ({LI_CLEAN_SQL}), {O.screen_ctes(LI, 'li', LI_VARS, LI_NUMERIC)}"


@register("filter_significant", O.rounded(f"{_SCREEN_SQL} SELECT * FROM screen WHERE significant", ["p_value"]))
def q_filter_significant(spark, sf_dir):
    return rounded(assoc.association_screen(lineitem_cohort(spark, sf_dir), LI).filter("significant"))


@register("significant_variables", O.rounded(
    f"{_SCREEN_SQL} SELECT variable, p_value, significance_level, test_type FROM screen WHERE significant", ["p_value"]))
def q_significant_variables(spark, sf_dir):
    return rounded(assoc.significant_variables(assoc.association_screen(lineitem_cohort(spark, sf_dir), LI)))


@register("format_p_value", f"""{_SCREEN_SQL} SELECT variable,
    CASE WHEN p_value IS NULL OR isnan(p_value) THEN 'N/A' WHEN p_value < 0.001 THEN '<0.001'
         ELSE printf('%.3f', p_value) END AS p_text, significance_level FROM screen""")
def q_format_p_value(spark, sf_dir):
    s = assoc.association_screen(lineitem_cohort(spark, sf_dir), LI)
    return s.select("variable", format_p_value(F.col("p_value")).alias("p_text"), "significance_level")


@register("significance_stars", O.rounded(f"""SELECT o_orderkey, p,
    CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars
    FROM (SELECT o_orderkey, {uniform_sql(42, 'o_orderkey')} * 0.1 AS p FROM orders)""", ["p"]))
def q_significance_stars(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (uniform(42, F.col("o_orderkey")) * 0.1).alias("p"))
    return rounded(o.select("o_orderkey", "p", significance_stars(F.col("p")).alias("stars")))


@register("format_mean_sd", """SELECT o_orderpriority, printf('%.2f (%.2f)', avg(o_totalprice), stddev_samp(o_totalprice)) AS mean_sd
    FROM orders GROUP BY ALL""")
def q_format_mean_sd(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"))
    return o.select("o_orderpriority", format_mean_sd(F.col("m"), F.col("s")).alias("mean_sd"))


@register("pct_ratio", O.rounded("""SELECT o_orderstatus, count(*)::BIGINT AS n,
    round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS pct FROM orders GROUP BY ALL""", ["pct"]))
def q_pct_ratio(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    counts = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the per-class table (one row per class)
    return rounded(counts.select("o_orderstatus", "n", pct(F.col("n"), total).alias("pct")))


# --- profiling ----------------------------------------------------------------

@register("describe_numeric", O.rounded(f"""WITH li AS ({LI_CLEAN_SQL})
    SELECT * FROM ({O.profile_sql(LI, 'li', LI_NUMERIC, LI_VARS)}) WHERE grp = 'all'""",
    ["min", "max", "mean", "std", "missing_ratio"]))
def q_describe_numeric(spark, sf_dir):
    return rounded(profile.describe_numeric(lineitem_cohort(spark, sf_dir), LI_VARS))


@register("cohort_basic_info", O.rounded(f"""SELECT count(*)::BIGINT AS total_samples,
    count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS n_case, count(*) FILTER (WHERE l_linestatus = 'O')::BIGINT AS n_control,
    array_to_string(list_sort(list_distinct(list(l_linestatus))), ',') AS labels,
    round(count(*) FILTER (WHERE l_linestatus = 'F') * 100.0 / count(*), 2) AS case_pct,
    round(count(*) FILTER (WHERE l_linestatus = 'O') * 1.0 / count(*) FILTER (WHERE l_linestatus = 'F'), 2) AS ratio_control_case
    FROM ({LI_CLEAN_SQL})""", ["case_pct", "ratio_control_case"]))
def q_cohort_basic_info(spark, sf_dir):
    info = profile.cohort_basic_info(lineitem_cohort(spark, sf_dir), LI)
    return rounded(info.withColumn("labels", F.concat_ws(",", "labels")))


@register("value_counts", "SELECT o_orderpriority AS value, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def q_value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@register("class_balance", "SELECT toxic AS label, count(*)::BIGINT AS n FROM labels GROUP BY ALL")
def q_class_balance(spark, sf_dir):
    return profile.class_balance(table(spark, sf_dir, "labels"), "toxic")


@register("crosstab", "SELECT l_returnflag AS value, l_linestatus AS label, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def q_crosstab(spark, sf_dir):
    return profile.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@register("crosstab_margins", """SELECT l_returnflag AS value, l_linestatus AS label, count(*)::BIGINT AS n,
    grouping(l_returnflag) = 1 AS value_total, grouping(l_linestatus) = 1 AS label_total
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def q_crosstab_margins(spark, sf_dir):
    return profile.crosstab_margins(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@register("crosstab_row_pct", O.rounded("""SELECT l_returnflag AS value, l_linestatus AS label, count(*)::BIGINT AS n,
    count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY l_returnflag) AS pct FROM lineitem
    GROUP BY l_returnflag, l_linestatus""", ["pct"]))
def q_crosstab_row_pct(spark, sf_dir):
    return rounded(profile.crosstab_row_pct(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))


@register("within_group_distribution", O.rounded(f"""WITH li AS ({LI_CLEAN_SQL}),
    t AS (SELECT l_linestatus AS label, count(*) AS group_n FROM li WHERE l_linestatus IN ('F', 'O') GROUP BY ALL)
    SELECT c.label, c.value, c.n, t.group_n, c.n * 100.0 / t.group_n AS pct
    FROM (SELECT l_linestatus AS label, l_discount AS value, count(*)::BIGINT AS n FROM li
          WHERE l_linestatus IN ('F', 'O') AND l_discount IS NOT NULL GROUP BY ALL) c JOIN t USING (label)""",
    ["value", "pct"]))
def q_within_group(spark, sf_dir):
    return rounded(profile.within_group_distribution(lineitem_cohort(spark, sf_dir), "l_discount", LI))


@register("distinct_count", f"""SELECT variable, k::BIGINT AS n_distinct, k > 20 AS above_limit
    FROM ({' UNION ALL '.join(f"SELECT '{v}' AS variable, count(DISTINCT {v}) AS k FROM ({LI_CLEAN_SQL})" for v in LI_VARS)})""")
def q_distinct_count(spark, sf_dir):
    return profile.distinct_count(lineitem_cohort(spark, sf_dir), LI_VARS)


@register("variable_kind", f"""WITH li AS ({LI_CLEAN_SQL}), {O.kinds_ctes(LI, 'li', LI_VARS, LI_NUMERIC)}
    SELECT variable, nd::BIGINT AS n_distinct, kind FROM kinds""")
def q_variable_kind(spark, sf_dir):
    return profile.variable_kind(lineitem_cohort(spark, sf_dir), LI)


@register("median_iqr", O.rounded(f"""SELECT * FROM ({' UNION ALL '.join(
    f"SELECT '{v}' AS variable, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median, quantile_cont({v}, 0.75) AS q3, quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) AS iqr FROM ({LI_CLEAN_SQL})"
    for v in LI_NUMERIC)})""", ["q1", "median", "q3", "iqr"]))
def q_median_iqr(spark, sf_dir):
    return rounded(profile.median_iqr(lineitem_cohort(spark, sf_dir), LI_NUMERIC))


# --- tests of association -----------------------------------------------------


LABELS_COHORT = CohortSpec(label="toxic_label", positive="Y", negative="N", categorical=("quality",), id_col="doc_id")


def labels_cohort(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id", "quality", F.when(F.col("toxic") == 1, "Y").otherwise("N").alias("toxic_label"))


_LABELS_SQL = "SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'Y' ELSE 'N' END AS toxic_label FROM labels"


@register("fisher_exact_test", O.rounded(f"""WITH lb AS ({_LABELS_SQL}), {O.contingency_ctes(LABELS_COHORT, 'lb', ['quality'])}
    SELECT s.variable, s.a::BIGINT AS a, s.b::BIGINT AS b, s.c_::BIGINT AS c, s.d::BIGINT AS d, fp.p AS p_value
    FROM shape s JOIN fp USING (variable)""", ["p_value"]))
def q_fisher(spark, sf_dir):
    cont = assoc.contingency(labels_cohort(spark, sf_dir), LABELS_COHORT, ["quality"])
    return rounded(assoc.fisher_exact_test(cont))


@register("association_test", O.rounded(f"""WITH lb AS ({_LABELS_SQL}), {O.screen_ctes(LABELS_COHORT, 'lb', ['quality'], [])}
    SELECT variable, p_value, test_type FROM screen""", ["p_value"]))
def q_association_test(spark, sf_dir):
    s = assoc.association_screen(labels_cohort(spark, sf_dir), LABELS_COHORT, variables=["quality"])
    return rounded(s.select("variable", "p_value", "test_type"))


# --- a cohort where the rules fire: documents by quality -------------------------
# Capitals and marks differ between the classes, `empty` has no value, and `odd`
# has so few rows that a cell of its 2 x 2 table falls below five.


DOCS_COHORT = CohortSpec(label="outcome", positive="Y", negative="N", numeric=("n_chars", "capitals", "empty"),
                         categorical=("lang", "toxic", "marked", "odd"), id_col="doc_id")
_DOCS_NUMERIC = list(DOCS_COHORT.numeric)
_DOCS_SQL = """SELECT doc_id, n_chars::DOUBLE AS n_chars, NULL::DOUBLE AS empty, lang, toxic,
    len(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / nullif(len(text), 0) AS capitals,
    contains(text, '!')::INTEGER AS marked, (doc_id % 61 = 0)::INTEGER AS odd,
    CASE WHEN quality = 1 THEN 'Y' ELSE 'N' END AS outcome FROM documents JOIN labels USING (doc_id)"""
_DOCS_SCREEN_SQL = f"WITH dc AS ({_DOCS_SQL}), {O.screen_ctes(DOCS_COHORT, 'dc', DOCS_COHORT.variables, _DOCS_NUMERIC)}"


def docs_cohort(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", F.col("n_chars").cast("double"), F.lit(None).cast("double").alias("empty"), "lang", "toxic",
                       F.try_divide(F.length(F.regexp_replace("text", "[^A-Z]", "")), F.length("text")).alias("capitals"),
                       F.contains("text", F.lit("!")).cast("int").alias("marked"),
                       (F.col("doc_id") % 61 == 0).cast("int").alias("odd"),
                       F.when(F.col("quality") == 1, "Y").otherwise("N").alias("outcome"))


@register("association_screen_documents", O.rounded(f"{_DOCS_SCREEN_SQL} SELECT * FROM screen", ["p_value"]))
def q_screen_documents(spark, sf_dir):
    return rounded(assoc.association_screen(docs_cohort(spark, sf_dir), DOCS_COHORT))


@register("filter_significant_documents", O.rounded(f"{_DOCS_SCREEN_SQL} SELECT * FROM screen WHERE significant", ["p_value"]))
def q_filter_significant_documents(spark, sf_dir):
    return rounded(assoc.association_screen(docs_cohort(spark, sf_dir), DOCS_COHORT).filter("significant"))


@register("sort_nulls_last", O.rounded(f"""{_DOCS_SCREEN_SQL} SELECT variable, p_value,
    (row_number() OVER (ORDER BY p_value ASC NULLS LAST, variable))::INTEGER AS position
    FROM (SELECT variable, p_value FROM screen UNION ALL SELECT 'empty', NULL)""", ["p_value"]))
def q_sort_nulls_last(spark, sf_dir):
    """The screen's order as a column, with a variable that could not be tested."""
    df = docs_cohort(spark, sf_dir)
    prof = assoc.local_profile(df, DOCS_COHORT)
    names = prof.select("variable").distinct()
    p = names.join(F.broadcast(assoc.association_screen(df, DOCS_COHORT, profile=prof)), "variable", "left")  # one row a variable
    order = Window.orderBy(F.col("p_value").asc_nulls_last(), "variable")
    return rounded(p.select("variable", "p_value", F.row_number().over(order).alias("position")))


@register("significant_variables_documents", O.rounded(
    f"{_DOCS_SCREEN_SQL} SELECT variable, p_value, significance_level, test_type FROM screen WHERE significant", ["p_value"]))
def q_significant_documents(spark, sf_dir):
    return rounded(assoc.significant_variables(assoc.association_screen(docs_cohort(spark, sf_dir), DOCS_COHORT)))


@register("null_guard_documents", f"""WITH dc AS ({_DOCS_SQL}), p AS ({O.profile_sql(DOCS_COHORT, 'dc', _DOCS_NUMERIC, DOCS_COHORT.variables)})
    SELECT variable FROM p WHERE grp = 'all' AND count > 0""")
def q_null_guard_documents(spark, sf_dir):
    prof = profile.describe_by_group(docs_cohort(spark, sf_dir), DOCS_COHORT)
    return prof.filter((F.col("grp") == profile.ALL_GROUP) & (F.col("count") > 0)).select("variable")


@register("left_join_with_default_documents", O.rounded(f"""{_DOCS_SCREEN_SQL}
    SELECT v.variable, coalesce(s.p_value, 1.0) AS p_value, coalesce(s.test_type, 'untested') AS test_type
    FROM (VALUES {', '.join(f"({O.lit(v)})" for v in DOCS_COHORT.variables)}) v(variable) LEFT JOIN screen s USING (variable)""",
    ["p_value"]))
def q_left_join_documents(spark, sf_dir):
    """Variables without any value have no test and take the defaults."""
    df = docs_cohort(spark, sf_dir)
    names = profile.describe_by_group(df, DOCS_COHORT).select("variable").distinct()
    tests = assoc.association_screen(df, DOCS_COHORT)  # one row per variable: bounded broadcast
    return rounded(names.join(F.broadcast(tests), "variable", "left").select(
        "variable", F.coalesce("p_value", F.lit(1.0)).alias("p_value"),
        F.coalesce("test_type", F.lit("untested")).alias("test_type")))


@register("sex_crosstab_report", O.rounded(f"""WITH li AS ({LI_CLEAN_SQL}), {O.screen_ctes(LI, 'li', ['l_returnflag'], [])},
    xt AS (SELECT l_returnflag AS value, l_linestatus AS label, count(*)::BIGINT AS n,
                  count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY l_returnflag) AS pct
           FROM li WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY l_returnflag, l_linestatus)
    SELECT xt.*, screen.p_value, screen.test_type, screen.significance_level FROM xt, screen""", ["pct", "p_value"]))
def q_sex_crosstab_report(spark, sf_dir):
    return rounded(categorical_report(lineitem_cohort(spark, sf_dir), LI, "l_returnflag"))


@register("cohens_d", O.rounded(f"""WITH li AS ({LI_CLEAN_SQL}), gs AS ({O.group_stats_sql(LI, 'li', LI_NUMERIC)})
    SELECT variable, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS cohens_d FROM gs""", ["cohens_d"]))
def q_cohens_d(spark, sf_dir):
    prof = profile.describe_by_group(lineitem_cohort(spark, sf_dir), LI, LI_NUMERIC)
    return rounded(assoc.cohens_d(prof, LI))


@register("p_adjust", O.rounded(f"""{_SCREEN_SQL},
    r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, variable) AS rk FROM screen WHERE p_value IS NOT NULL)
    SELECT variable, p_value, test_type, significant, significance_level, least(p_value * m, 1.0) AS p_bonferroni,
           least(min(p_value * m / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS p_bh
    FROM r UNION ALL SELECT *, NULL, NULL FROM screen WHERE p_value IS NULL""", ["p_value", "p_bonferroni", "p_bh"]))
def q_p_adjust(spark, sf_dir):
    return rounded(assoc.p_adjust(assoc.association_screen(lineitem_cohort(spark, sf_dir), LI)))


# --- split, folds, encoding ---------------------------------------------------


def _split_sql(table_: str, label: str, key: str, seed: int = 42, test_size_num: int = 1, test_size_den: int = 3) -> str:
    return f"""(WITH c AS (SELECT {label} AS lab, count(*)::BIGINT AS n FROM {table_} GROUP BY ALL),
      t AS (SELECT sum(n)::BIGINT AS total,
                   sum(n)::BIGINT - ceil(sum(n)::DOUBLE * ({test_size_num}::DOUBLE / {test_size_den}::DOUBLE))::BIGINT AS n_train FROM c),
      a AS (SELECT c.lab, c.n, (c.n * t.n_train) // t.total AS base, (c.n * t.n_train) % t.total AS rem, t.n_train FROM c, t),
      b AS (SELECT lab, n, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, lab) <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS k_train FROM a),
      r AS (SELECT src.*, row_number() OVER (PARTITION BY {label} ORDER BY {hash_hex_sql(seed, key)}, {key}) AS rk FROM {table_} AS src)
    SELECT r.* EXCLUDE (rk), CASE WHEN r.rk <= b.n - b.k_train THEN 'test' ELSE 'train' END AS split
    FROM r JOIN b ON r.{label} = b.lab)"""


def _kfold_sql(rel: str, label: str, key: str, k: int = 10, seed: int = 42) -> str:
    return f"""(WITH c AS (SELECT {label} AS lab, count(*) AS n FROM {rel} GROUP BY ALL),
      o AS (SELECT lab, coalesce(sum(n) OVER (ORDER BY lab ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c),
      r AS (SELECT x.*, row_number() OVER (PARTITION BY {label} ORDER BY {hash_hex_sql(seed, "'fold'", key)}, {key}) AS rk FROM {rel} x)
    SELECT r.* EXCLUDE (rk), ((o.off + r.rk - 1) % {k})::INTEGER AS fold FROM r JOIN o ON r.{label} = o.lab)"""


def orders_split(spark, sf_dir, counts=None):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return S.stratified_split(o, "o_orderstatus", "o_orderkey", 1 / 3, 42, counts=counts)


_ORDERS_SPLIT_SQL = _split_sql("(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)", "o_orderstatus", "o_orderkey")


@register("stratified_split", O.rounded(f"SELECT * FROM {_ORDERS_SPLIT_SQL}", ["o_totalprice"]))
def q_stratified_split(spark, sf_dir):
    return rounded(orders_split(spark, sf_dir))


def orders_train_folds(spark, sf_dir):
    """(train rows with folds, test rows, class counts): one counting job in all."""
    counts = S.class_counts(table(spark, sf_dir, "orders"), "o_orderstatus")
    train_n, test_n = S.split_sizes(counts, 1 / 3)
    sp = orders_split(spark, sf_dir, counts)
    train = S.stratified_kfold(sp.filter(F.col("split") == "train"), "o_orderstatus", "o_orderkey", 10, 42,
                               counts=train_n)
    return train, sp.filter(F.col("split") == "test"), train_n, test_n


@register("stratified_kfold", f"""SELECT o_orderkey, o_orderstatus, fold FROM
    {_kfold_sql(f"(SELECT * FROM {_ORDERS_SPLIT_SQL} WHERE split = 'train')", 'o_orderstatus', 'o_orderkey')}""")
def q_stratified_kfold(spark, sf_dir):
    train, _, _, _ = orders_train_folds(spark, sf_dir)
    return train.select("o_orderkey", "o_orderstatus", "fold")


@register("fold_sizes", f"""SELECT fold, o_orderstatus, count(*)::BIGINT AS n FROM
    {_kfold_sql(f"(SELECT * FROM {_ORDERS_SPLIT_SQL} WHERE split = 'train')", 'o_orderstatus', 'o_orderkey')} GROUP BY ALL""")
def q_fold_sizes(spark, sf_dir):
    folds = q_stratified_kfold(spark, sf_dir)
    return folds.groupBy("fold", "o_orderstatus").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("label_encode", """SELECT o_orderkey, o_orderstatus, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS label_code FROM orders""")
def q_label_encode(spark, sf_dir):
    sp = orders_split(spark, sf_dir)
    model = S.label_encoder(sp.filter("split = 'train'"), sp.filter("split = 'test'"), "o_orderstatus")
    return S.label_encode(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), model)


@register("write_labels", """SELECT o_orderkey, o_orderstatus AS label, code FROM orders JOIN
    (SELECT o_orderstatus, (row_number() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS code
     FROM (SELECT DISTINCT o_orderstatus FROM orders)) USING (o_orderstatus)""")
def q_write_labels(spark, sf_dir):
    """Labels encoded by an encoder that was written and loaded again, next to the written codes; rows where both agree."""
    from pyspark.ml.feature import StringIndexerModel
    sp = orders_split(spark, sf_dir)
    model = S.label_encoder(sp.filter("split = 'train'"), sp.filter("split = 'test'"), "o_orderstatus")
    path = stage_path(spark, "queries", "labels", uuid.uuid4().hex[:8])
    write_labels(S.label_encode(sp.select("o_orderkey", "o_orderstatus"), model), model, path)
    written = spark.read.parquet(f"{path}/labels").withColumnRenamed("label_code", "code")
    again = S.label_encode(written, StringIndexerModel.load(f"{path}/encoder"))
    return again.filter(F.col("label_code") == F.col("code")).select("o_orderkey", F.col("o_orderstatus").alias("label"), "code")


@register("write_result_tables", """SELECT kind, o_orderstatus AS label, count(*)::BIGINT AS n
    FROM orders, (VALUES ('parquet'), ('csv')) k(kind) GROUP BY ALL""")
def q_write_result_tables(spark, sf_dir):
    """A result table written as a Parquet sheet and as a one-file CSV report, both read back."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    path = stage_path(spark, "queries", "results", uuid.uuid4().hex[:8])
    write_result_tables({"class_ratio": counts, "not_a_table": None}, path)
    write_csv_report(counts, f"{path}/report")
    report = spark.read.option("header", True).schema("label string, n bigint").csv(f"{path}/report")
    sheets = [(k, df) for k, df in (("parquet", spark.read.parquet(f"{path}/class_ratio")), ("csv", report))]
    both = [df.select(F.lit(k).alias("kind"), "label", "n") for k, df in sheets]
    return both[0].unionByName(both[1])


@register("label_map", "SELECT o_orderstatus AS label, (row_number() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS code FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def q_label_map(spark, sf_dir):
    sp = orders_split(spark, sf_dir)
    model = S.label_encoder(sp.filter("split = 'train'"), sp.filter("split = 'test'"), "o_orderstatus")
    return S.label_map(model)


@register("union_distinct_labels", "SELECT DISTINCT o_orderstatus AS label FROM orders")
def q_union_distinct_labels(spark, sf_dir):
    sp = orders_split(spark, sf_dir)
    return S.union_distinct_labels(sp.filter("split = 'train'"), sp.filter("split = 'test'"), "o_orderstatus")


@register("separate_target", "SELECT o_orderkey, o_custkey, o_totalprice, split FROM " + _ORDERS_SPLIT_SQL)
def q_separate_target(spark, sf_dir):
    features, _ = S.separate_target(orders_split(spark, sf_dir), "o_orderstatus")
    return features


@register("temporal_split_null_times", """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events),
    n AS (SELECT count(ts) AS n FROM e),
    o AS (SELECT ts, row_number() OVER (ORDER BY ts) AS rn FROM e WHERE ts IS NOT NULL),
    cut AS (SELECT o.ts FROM o, n WHERE o.rn = n.n - ceil(n.n::DOUBLE * (1::DOUBLE / 3::DOUBLE))::BIGINT + 1)
    SELECT e.event_id, CASE WHEN e.ts >= cut.ts THEN 'test' ELSE 'train' END AS split FROM e, cut""")
def q_temporal_split_nulls(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"))
    return S.temporal_split(ev, "ts", 1 / 3).select("event_id", "split")


@register("temporal_split", """WITH n AS (SELECT count(*) AS n FROM events),
    o AS (SELECT ts, row_number() OVER (ORDER BY ts) AS rn FROM events),
    cut AS (SELECT o.ts FROM o, n WHERE o.rn = n.n - ceil(n.n::DOUBLE * (1::DOUBLE / 3::DOUBLE))::BIGINT + 1)
    SELECT e.event_id, CASE WHEN e.ts < cut.ts THEN 'train' ELSE 'test' END AS split FROM events e, cut""")
def q_temporal_split(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    return S.temporal_split(ev, "ts", 1 / 3).select("event_id", "split")


# --- numeric features ----------------------------------------------------------


ORDERS_RANGES = {"o_totalprice": (10000, 400000)}
_ORDERS_CLEAN_SPLIT_SQL = f"""(SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_orderstatus, split,
    CASE WHEN o_totalprice >= 10000.0 AND o_totalprice <= 400000.0 THEN o_totalprice END AS o_totalprice
    FROM {_ORDERS_SPLIT_SQL})"""


def orders_clean_split(spark, sf_dir):
    sp = orders_split(spark, sf_dir).withColumn("o_custkey", F.col("o_custkey").cast("double"))
    return clean.range_clean(sp, ORDERS_RANGES)


def _once(df):
    """df written to the shared folder, so that fitting and transforming split the rows once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@register("zscore_fit_transform", O.rounded(f"""WITH d AS {_ORDERS_CLEAN_SPLIT_SQL},
    st AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(o_custkey) AS m2, stddev_pop(o_custkey) AS s2
           FROM d WHERE split = 'train')
    SELECT o_orderkey, split, (o_totalprice - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1.0 END AS o_totalprice,
           (o_custkey - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1.0 END AS o_custkey FROM d, st""", ["o_totalprice", "o_custkey"]))
def q_zscore(spark, sf_dir):
    d = _once(orders_clean_split(spark, sf_dir).select("o_orderkey", "split", "o_totalprice", "o_custkey"))
    scaler = FE.fit_zscore(d.filter("split = 'train'"), ["o_totalprice", "o_custkey"])
    return rounded(scaler.transform(d))


@register("median_impute", O.rounded(f"""WITH d AS {_ORDERS_CLEAN_SPLIT_SQL},
    st AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM d WHERE split = 'train')
    SELECT o_orderkey, split, coalesce(o_totalprice, med) AS o_totalprice FROM d, st""", ["o_totalprice"]))
def q_median_impute(spark, sf_dir):
    d = _once(orders_clean_split(spark, sf_dir).select("o_orderkey", "split", "o_totalprice"))
    imp, _ = FE.fit_median_imputer(d.filter("split = 'train'"), ["o_totalprice"])
    return rounded(imp.transform(d))


@register("has_missing", f"""SELECT split, bool_or(o_totalprice IS NULL) AS has_missing FROM {_ORDERS_CLEAN_SPLIT_SQL} GROUP BY ALL""")
def q_has_missing(spark, sf_dir):
    d = _once(orders_clean_split(spark, sf_dir).select("split", "o_totalprice"))
    rows = [(s, FE.has_missing(d.filter(F.col("split") == s), ["o_totalprice"])) for s in ("train", "test")]
    return spark.createDataFrame(rows, "split string, has_missing boolean")


_ASSEMBLE_SQL = O.rounded("""SELECT doc_id, pos, value FROM (
    SELECT l.doc_id, unnest([l.quality::DOUBLE, l.toxic::DOUBLE, d.n_chars::DOUBLE]) AS value,
           unnest([0, 1, 2]) AS pos FROM labels l JOIN documents d USING (doc_id))""", ["value"])


@register("assemble_features", _ASSEMBLE_SQL)
def q_assemble(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double"), F.col("toxic").cast("double"))
    doc = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double"))
    out = FE.assemble_features({"labels": lab, "documents": doc}, "doc_id", "features", ["quality", "toxic", "n_chars"])
    return rounded(out.select("doc_id", F.posexplode(vector_to_array("features")).alias("pos", "value")))


@register("assemble_features_bucketed", _ASSEMBLE_SQL)
def q_assemble_bucketed(spark, sf_dir):
    """The same blocks as bucketed stage tables, which meet without a shuffle."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double"), F.col("toxic").cast("double"))
    doc = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double"))
    blocks, run, buckets = {}, uuid.uuid4().hex[:8], bucket_count(doc.count())
    for name, block in (("labels", lab), ("documents", doc)):
        write_bucketed(block, f"block_{name}_{run}", "doc_id", buckets)
        blocks[name] = read_bucketed(spark, f"block_{name}_{run}", ["doc_id"])
    out = FE.assemble_features(blocks, "doc_id", "features", ["quality", "toxic", "n_chars"])
    return rounded(out.select("doc_id", F.posexplode(vector_to_array("features")).alias("pos", "value")))


@register("left_join_with_default", O.rounded(f"""WITH li AS ({LI_CLEAN_SQL}), {O.screen_ctes(LI, 'li', LI_VARS, LI_NUMERIC)},
    prof AS ({O.profile_sql(LI, 'li', LI_NUMERIC, LI_VARS)})
    SELECT p.variable, coalesce(s.p_value, 1.0) AS p_value, coalesce(s.test_type, 'untested') AS test_type
    FROM (SELECT DISTINCT variable FROM prof) p LEFT JOIN (SELECT * FROM screen WHERE test_type <> 'fisher-exact') s USING (variable)""",
    ["p_value"]))
def q_left_join_default(spark, sf_dir):
    df = lineitem_cohort(spark, sf_dir)
    prof = profile.describe_by_group(df, LI)
    screen = assoc.association_screen(df, LI, profile=prof).filter(F.col("test_type") != assoc.TEST_FISHER)
    names = prof.select("variable").distinct()
    # the screen is one row per variable: bounded broadcast
    j = names.join(F.broadcast(screen), "variable", "left")
    return rounded(j.select("variable", F.coalesce("p_value", F.lit(1.0)).alias("p_value"),
                            F.coalesce("test_type", F.lit("untested")).alias("test_type")))


# --- metrics on a score table of the study's shape ------------------------------
# A load fixture for the metric operators, not predictions of a model: every
# train row of orders has one score per (feature set, model) in its CV fold,
# every test row one in the hold-out; scores are md5-derived so both engines
# build the same table. Label: o_orderstatus = 'F'. The queries on predictions
# of fitted models are below (predict_score to run_study).


_SETS = list(FEATURE_SETS)
_MODELS = list(EV.MODEL_ORDER)


def study_predictions(spark, sf_dir, seed: int = 42):
    train, test, _, _ = orders_train_folds(spark, sf_dir)
    rows = train.unionByName(test.withColumn("fold", F.lit(-1)))
    cfg = F.array(*[F.struct(F.lit(fs).alias("feature_set"), F.lit(m).alias("model"), F.lit(mi).alias("mi"))
                    for fs in _SETS for mi, m in enumerate(_MODELS)])
    x = rows.select(F.col("o_orderkey").alias("row_id"), "split", "fold",
                    (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.inline(cfg))
    u = uniform(seed, F.col("feature_set"), F.col("model"), F.col("row_id"))
    raw = F.lit(0.7) * u + F.lit(0.3) * F.col("label").cast("double") * (F.col("mi") + 1).cast("double") / F.lit(7.0)
    score = F.floor(raw * F.lit(1000.0)).cast("double") / F.lit(1000.0)
    return x.withColumn("score", score).withColumn("pred", (F.col("score") >= 0.5).cast("int")).drop("mi")


def _pred_sql(seed: int = 42) -> str:
    sets = ", ".join(f"({O.lit(fs)})" for fs in _SETS)
    models = ", ".join(f"({O.lit(m)}, {i})" for i, m in enumerate(_MODELS))
    rows = f"""(SELECT o_orderkey, o_orderstatus, split, fold FROM
        {_kfold_sql(f"(SELECT * FROM {_ORDERS_SPLIT_SQL} WHERE split = 'train')", 'o_orderstatus', 'o_orderkey')}
        UNION ALL SELECT o_orderkey, o_orderstatus, split, -1 AS fold FROM {_ORDERS_SPLIT_SQL} WHERE split = 'test')"""
    u = uniform_sql(seed, "fs.feature_set", "ms.model", "r.o_orderkey")
    raw = (f"0.7::DOUBLE * {u} + 0.3::DOUBLE * (r.o_orderstatus = 'F')::INTEGER::DOUBLE * "
           f"(ms.mi + 1)::DOUBLE / 7.0::DOUBLE")
    return f"""(SELECT fs.feature_set, ms.model, r.split, r.fold, r.o_orderkey AS row_id,
                  (r.o_orderstatus = 'F')::INTEGER AS label,
                  floor(({raw}) * 1000.0::DOUBLE) / 1000.0::DOUBLE AS score
           FROM {rows} r, (VALUES {sets}) fs(feature_set), (VALUES {models}) ms(model, mi))"""


def _pred_full_sql(seed: int = 42) -> str:
    return f"(SELECT *, (score >= 0.5)::INTEGER AS pred FROM {_pred_sql(seed)})"


_G = "feature_set, model, split, fold"


def _auc_sql(pred: str) -> str:
    return f"""(WITH dist AS (SELECT {_G}, score, count(*) FILTER (WHERE label = 1) AS pos,
                               count(*) FILTER (WHERE label = 0) AS neg FROM {pred} GROUP BY ALL),
         c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {_G} ORDER BY score
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM dist)
    SELECT {_G}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                      THEN sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg))::DOUBLE END AS AUC
    FROM c GROUP BY ALL)"""


def _prf_sql(pred: str) -> str:
    return f"""(WITH c AS (SELECT {_G}, count(*) FILTER (WHERE pred = 1 AND label = 1) AS tp,
                    count(*) FILTER (WHERE pred = 1 AND label = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND label = 1) AS fn,
                    count(*) FILTER (WHERE pred = 0 AND label = 0) AS tn FROM {pred} GROUP BY ALL)
    SELECT {_G}, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision,
           coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall,
           coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0.0) AS f1,
           (tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0) AS accuracy FROM c)"""


def _fold_metrics_sql(seed: int = 42) -> str:
    p = _pred_full_sql(seed)
    return f"(SELECT * FROM {_auc_sql(p)} JOIN {_prf_sql(p)} USING (feature_set, model, split, fold))"


def max_group_rows(spark, sf_dir) -> int:
    """Upper bound of rows (hence distinct scores) in one predictions group:
    the hold-out split, or the largest class-balanced fold."""
    counts = S.class_counts(table(spark, sf_dir, "orders"), "o_orderstatus")
    train_n, test_n = S.split_sizes(counts, 1 / 3)
    return max(sum(test_n.values()), -(-sum(train_n.values()) // 10))


@register("metric_auc", O.rounded(f"SELECT * FROM {_auc_sql(_pred_full_sql())}", ["AUC"]))
def q_metric_auc(spark, sf_dir):
    return rounded(EV.roc_auc(study_predictions(spark, sf_dir), max_group_scores=max_group_rows(spark, sf_dir)))


@register("metric_precision_recall_f1", O.rounded(f"SELECT * FROM {_prf_sql(_pred_full_sql())}",
                                                  ["precision", "recall", "f1", "accuracy"]))
def q_metric_prf(spark, sf_dir):
    return rounded(EV.classification_metrics(study_predictions(spark, sf_dir)))


def _cv_sql(seed=42) -> str:
    aggs = ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in EV.METRICS)
    return f"(SELECT feature_set, model, {aggs} FROM {_fold_metrics_sql(seed)} WHERE split = 'train' GROUP BY ALL)"


_CV_COLS = [f"{m}_{s}" for m in EV.METRICS for s in ("mean", "std")]


def study_fold_metrics(spark, sf_dir, seed=42):
    return EV.evaluate(study_predictions(spark, sf_dir, seed), max_group_scores=max_group_rows(spark, sf_dir))


def study_cv(spark, sf_dir, seed=42):
    return EV.cv_aggregate(study_fold_metrics(spark, sf_dir, seed).filter(F.col("split") == "train"))


def study_test(spark, sf_dir, seed=42):
    return EV.evaluate(study_predictions(spark, sf_dir, seed).filter(F.col("split") == "test"),
                       ["feature_set", "model"], max_group_scores=max_group_rows(spark, sf_dir))


def _test_sql(seed=42) -> str:
    p = f"(SELECT * FROM {_pred_full_sql(seed)} WHERE split = 'test')"
    return f"""(SELECT feature_set, model, AUC, precision, recall, f1, accuracy FROM {_auc_sql(p)}
               JOIN {_prf_sql(p)} USING (feature_set, model, split, fold))"""


@register("cv_aggregate", O.rounded(f"SELECT * FROM {_cv_sql()}", _CV_COLS))
def q_cv_aggregate(spark, sf_dir):
    return rounded(study_cv(spark, sf_dir))


@register("best_model", O.rounded(f"""SELECT feature_set, model, AUC_mean FROM (
    SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY AUC_mean DESC NULLS LAST,
        list_position({[m for m in _MODELS]}, model)) AS rn FROM {_cv_sql()}) WHERE rn = 1""", ["AUC_mean"]))
def q_best_model(spark, sf_dir):
    return rounded(EV.best_model(study_cv(spark, sf_dir), "AUC_mean").select("feature_set", "model", "AUC_mean"))


@register("cv_summary_table", f"""SELECT feature_set, model, {', '.join(
    f"printf('%.3f ± %.3f', {m}_mean, {m}_std) AS {m}" for m in EV.METRICS)} FROM {_cv_sql()}""")
def q_cv_summary(spark, sf_dir):
    return EV.cv_summary_table(study_cv(spark, sf_dir))


@register("round_metrics", O.rounded(f"""SELECT feature_set, model, {', '.join(
    f"round({m}, 4) AS {m}" for m in EV.METRICS)} FROM {_test_sql()}""", list(EV.METRICS)))
def q_round_metrics(spark, sf_dir):
    return rounded(EV.test_summary_table(study_test(spark, sf_dir)))


@register("ablation_cross_join", O.rounded(f"""WITH g AS (SELECT * FROM (VALUES {', '.join(f"({O.lit(fs)}, {i})" for i, fs in enumerate(_SETS + ['unknown-set']))}) s(feature_set, set_order),
    (VALUES {', '.join(f"({O.lit(m)}, {j})" for j, m in enumerate(_MODELS))}) m(model, model_order))
    SELECT g.*, t.AUC, t.precision, t.recall, t.f1, t.accuracy,
           CASE WHEN t.AUC IS NOT NULL THEN 'ok' ELSE 'failed' END AS status
    FROM g LEFT JOIN {_test_sql()} t USING (feature_set, model)""", ["AUC", "precision", "recall", "f1", "accuracy"]))
def q_ablation(spark, sf_dir):
    grid = EV.run_grid(_SETS + ["unknown-set"], _MODELS)
    return rounded(EV.with_status(grid, study_test(spark, sf_dir)))


@register("compare_studies", O.rounded(f"""SELECT feature_set, model, {', '.join(
    f"b.{m} AS {m}_base, o.{m} AS {m}_opt, o.{m} - b.{m} AS {m}_delta" for m in EV.METRICS)}
    FROM {_test_sql(42)} b FULL OUTER JOIN {_test_sql(43)} o USING (feature_set, model)""",
    [f"{m}_{s}" for m in EV.METRICS for s in ("base", "opt", "delta")]))
def q_compare_studies(spark, sf_dir):
    return rounded(EV.compare_studies(study_test(spark, sf_dir, 42), study_test(spark, sf_dir, 43)))


# --- rebalancing on embeddings (label 0 = minority class 1) ---------------------


_EMB_SQL = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, (label = 0)::INTEGER AS y FROM embeddings)"


def embeddings_binary(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"),
                    (F.col("label") == 0).cast("int").alias("y"))


def _knn_sql(rel: str, k: int) -> str:
    return f"""(SELECT id, nn_id, dist, nn_rank FROM (
        SELECT a.id, b.id AS nn_id, list_distance(a.v, b.v) AS dist,
               row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS nn_rank
        FROM {rel} a JOIN {rel} b ON a.id <> b.id) WHERE nn_rank <= {k})"""


@register("knn_exact", "SELECT id, nn_id, nn_rank::INTEGER AS nn_rank FROM " + _knn_sql(f"(SELECT * FROM {_EMB_SQL} WHERE y = 1)", BA.SMOTE_K))
def q_knn(spark, sf_dir):
    m = embeddings_binary(spark, sf_dir).filter("y = 1")
    return BA.knn(m, "id", "v", BA.SMOTE_K).select("id", "nn_id", "nn_rank")


@register("knn_cells", "SELECT id, nn_id, nn_rank::INTEGER AS nn_rank FROM " + _knn_sql(_EMB_SQL, BA.SMOTE_K))
def q_knn_cells(spark, sf_dir):
    """Neighbours of all vectors, with cells of about 64 rows."""
    return BA.knn(embeddings_binary(spark, sf_dir), "id", "v", BA.SMOTE_K, cell_rows=64).select("id", "nn_id", "nn_rank")


@register("knn_work")
def q_knn_work(spark, sf_dir):
    """Share of the full comparison that cells of about 64 rows leave."""
    return NB.knn_work(embeddings_binary(spark, sf_dir), "id", "v", 1, cell_rows=64)


def _tomek_ctes(rel: str) -> str:
    """Every distance is computed once; ties of the nearest go to the smallest id."""
    return f"""d AS MATERIALIZED (SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS dist
                                  FROM {rel} a JOIN {rel} b ON a.id <> b.id),
    shortest AS MATERIALIZED (SELECT id, min(dist) AS dist FROM d GROUP BY id),
    nearest AS MATERIALIZED (SELECT d.id, min(d.other) AS nn_id FROM d JOIN shortest USING (id, dist) GROUP BY d.id),
    links AS (SELECT a.id AS a_id, b.id AS b_id FROM nearest a JOIN nearest b ON a.nn_id = b.id AND b.nn_id = a.id
              JOIN {rel} ea ON ea.id = a.id JOIN {rel} eb ON eb.id = b.id WHERE ea.y <> eb.y AND a.id < b.id)"""


@register("tomek_links", f"WITH e AS MATERIALIZED {_EMB_SQL}, {_tomek_ctes('e')} SELECT * FROM links")
def q_tomek(spark, sf_dir):
    return BA.tomek_links(embeddings_binary(spark, sf_dir), "id", "v", "y")


def _smote_sql(seed: int = 42, k: int = BA.SMOTE_K) -> str:
    return f"""WITH e AS {_EMB_SQL}, m AS (SELECT * FROM e WHERE y = 1),
    c AS (SELECT count(*) FILTER (WHERE y = 1) AS n_min, count(*) FILTER (WHERE y = 0) - count(*) FILTER (WHERE y = 1) AS n_syn FROM e),
    nn AS {_knn_sql('m', k)},
    rk AS (SELECT id AS base_id, v AS x, row_number() OVER (ORDER BY {hash_hex_sql(seed, 'id')}, id) AS base_rank FROM m),
    s AS (SELECT g.i, (g.i % c.n_min) + 1 AS base_rank,
                 (('0x' || substr({hash_hex_sql(seed, "'nn'", 'g.i')}, 1, 8))::BIGINT % {k}) + 1 AS nn_rank,
                 {uniform_sql(seed, "'u'", 'g.i')} AS u
          FROM c, generate_series(0, c.n_syn - 1) AS g(i)),
    j AS (SELECT s.i, s.u, rk.base_id, rk.x, nn.nn_id, mm.v AS yv FROM s JOIN rk USING (base_rank)
          JOIN nn ON nn.id = rk.base_id AND nn.nn_rank = s.nn_rank JOIN m mm ON mm.id = nn.nn_id)"""


@register("smote_oversample", O.rounded(f"""{_smote_sql()}
    SELECT -(j.i + 1) AS id, j.base_id, j.nn_id, j.u, (p.pos - 1)::INTEGER AS pos, j.x[p.pos] + j.u * (j.yv[p.pos] - j.x[p.pos]) AS value
    FROM j, generate_series(1, len(j.x)) AS p(pos)""", ["u", "value"]))
def q_smote(spark, sf_dir):
    syn = BA.smote_oversample(embeddings_binary(spark, sf_dir), "id", "v", "y", minority=1)
    return rounded(syn.select("id", "base_id", "nn_id", "u", F.posexplode("v").alias("pos", "value")))


@register("class_balance_after_smote", f"""{_smote_sql()}
    SELECT y AS label, count(*)::BIGINT AS n FROM (SELECT y FROM e UNION ALL SELECT 1 AS y FROM j) GROUP BY ALL""")
def q_class_balance_after(spark, sf_dir):
    res = BA.smote_resample(embeddings_binary(spark, sf_dir), "id", "v", "y", minority=1)
    return profile.class_balance(res, "y")


@register("class_weight_balanced", O.rounded("""SELECT doc_id, toxic, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY toxic)) AS weight
    FROM labels""", ["weight"]))
def q_class_weight(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return rounded(BA.class_weight_balanced(lab, "toxic"))


# --- feature importance on the lineitem cohort --------------------------------


def _mi_sql() -> str:
    parts = " UNION ALL ".join(f"""SELECT '{v}' AS variable, l_linestatus AS y,
        CASE WHEN r.hi{i} = r.lo{i} THEN 0 ELSE least(floor(({v} - r.lo{i}) / (r.hi{i} - r.lo{i}) * 10), 9) END AS bin
        FROM li, r WHERE {v} IS NOT NULL""" for i, v in enumerate(LI_NUMERIC))
    ranges = ", ".join(f"min({v}) AS lo{i}, max({v}) AS hi{i}" for i, v in enumerate(LI_NUMERIC))
    return f"""WITH li AS (SELECT * FROM ({LI_CLEAN_SQL}) WHERE l_linestatus IN ('F', 'O')),
      r AS (SELECT {ranges} FROM li),
      cells AS (SELECT variable, bin, y, count(*) AS n FROM ({parts}) GROUP BY ALL),
      c AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS nn, sum(n) OVER (PARTITION BY variable, bin) AS nb,
                   sum(n) OVER (PARTITION BY variable, y) AS ny FROM cells)
    SELECT variable, sum((n / nn) * ln((n * nn) / (nb * ny))) AS mutual_information FROM c GROUP BY variable"""


@register("importance_mutual_information", O.rounded(_mi_sql(), ["mutual_information"]))
def q_mi(spark, sf_dir):
    return rounded(IM.mutual_information(lineitem_cohort(spark, sf_dir), LI, LI_NUMERIC))


def _mi_quantile_sql() -> str:
    at = ", ".join(f"{j / 10}" for j in range(1, 10))
    parts = " UNION ALL ".join(f"""SELECT '{v}' AS variable, l_linestatus AS y,
        len(list_filter(list_distinct(q.c{i}), lambda c: c < {v}::DOUBLE)) AS bin FROM li, q WHERE {v} IS NOT NULL"""
                               for i, v in enumerate(LI_NUMERIC))
    cuts = ", ".join(f"quantile_cont({v}::DOUBLE, [{at}]) AS c{i}" for i, v in enumerate(LI_NUMERIC))
    return f"""WITH li AS (SELECT * FROM ({LI_CLEAN_SQL}) WHERE l_linestatus IN ('F', 'O')),
      q AS (SELECT {cuts} FROM li), cells AS (SELECT variable, bin, y, count(*) AS n FROM ({parts}) GROUP BY ALL),
      c AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS nn, sum(n) OVER (PARTITION BY variable, bin) AS nb,
                   sum(n) OVER (PARTITION BY variable, y) AS ny FROM cells)
    SELECT variable, sum((n / nn) * ln((n * nn) / (nb * ny))) AS mutual_information FROM c GROUP BY variable"""


@register("importance_mutual_information_quantile", O.rounded(_mi_quantile_sql(), ["mutual_information"]))
def q_mi_quantile(spark, sf_dir):
    return rounded(IM.mutual_information(lineitem_cohort(spark, sf_dir), LI, LI_NUMERIC, cut_at="quantile"))


def _f_sql() -> str:
    return f"""WITH li AS ({LI_CLEAN_SQL}), gs AS ({O.group_stats_sql(LI, 'li', LI_NUMERIC)}),
      f AS (SELECT variable, n1 + n2 AS n,
              (n1 * power(m1 - (n1 * m1 + n2 * m2) / (n1 + n2), 2) + n2 * power(m2 - (n1 * m1 + n2 * m2) / (n1 + n2), 2))
              / ((n1 - 1) * v1 + (n2 - 1) * v2) * (n1 + n2 - 2) AS f_statistic FROM gs),
      ft AS (SELECT variable, sqrt(f_statistic) AS t, (n - 2)::DOUBLE AS dof FROM f),
      fp AS {t_two_sided_sql('ft', 'variable', 't', 'dof')}
    SELECT f.variable, f.f_statistic, fp.p AS f_p_value FROM f JOIN fp USING (variable)"""


@register("importance_f_statistic", O.rounded(_f_sql(), ["f_statistic", "f_p_value"]))
def q_f_stat(spark, sf_dir):
    prof = profile.describe_by_group(lineitem_cohort(spark, sf_dir), LI, LI_NUMERIC)
    return rounded(IM.f_statistic(prof, LI))


def _corr_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, corr({v}, y) AS r, count({v}) AS n FROM li" for v in LI_NUMERIC)
    return f"""WITH li AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM ({LI_CLEAN_SQL})
                        WHERE l_linestatus IN ('F', 'O')),
      c AS ({parts}),
      ct AS (SELECT variable, r * sqrt((n - 2.0) / (1.0 - r * r)) AS t, (n - 2)::DOUBLE AS dof FROM c),
      cp AS {t_two_sided_sql('ct', 'variable', 't', 'dof')}
    SELECT c.variable, c.r AS correlation, cp.p AS corr_p_value FROM c JOIN cp USING (variable)"""


@register("importance_correlation", O.rounded(_corr_sql(), ["correlation", "corr_p_value"]))
def q_corr(spark, sf_dir):
    return rounded(IM.correlation(lineitem_cohort(spark, sf_dir), LI, LI_NUMERIC))


@register("importance_comparison", O.rounded(f"""WITH mi AS ({_mi_sql()}), fs AS ({_f_sql()}), co AS ({_corr_sql()})
    SELECT variable, 0.0::DOUBLE AS rf_importance, coalesce(mutual_information, 0.0) AS mutual_information,
           coalesce(f_statistic, 0.0) AS f_statistic, coalesce(correlation, 0.0) AS correlation,
           coalesce(f_p_value, 1.0) AS f_p_value, coalesce(corr_p_value, 1.0) AS corr_p_value
    FROM mi LEFT JOIN fs USING (variable) LEFT JOIN co USING (variable)""",
    ["rf_importance", "mutual_information", "f_statistic", "correlation", "f_p_value", "corr_p_value"]))
def q_importance_comparison(spark, sf_dir):
    return rounded(IM.importance_table(lineitem_cohort(spark, sf_dir), LI, LI_NUMERIC))


def fitted_forest(df):
    """(forest, feature names) on the imputed measurements of the lineitem cohort."""
    wide = FE.wide_columns(df, LI_NUMERIC)
    imp, kept = FE.fit_median_imputer(df, LI_NUMERIC, wide)
    x = imp.transform(df).withColumn("label", (F.col(LI.label) == LI.positive).cast("double"))
    return FO.fit_cell_forest(x, kept, n_trees=50, max_depth=10, seed=42, wide=wide), kept


@register("importance_comparison_forest", O.rounded(f"""WITH mi AS ({_mi_sql()}), fs AS ({_f_sql()}), co AS ({_corr_sql()})
    SELECT variable, mutual_information, f_statistic, correlation, f_p_value, corr_p_value,
           true AS rf_within_0_1, 1.0::DOUBLE AS rf_total
    FROM mi LEFT JOIN fs USING (variable) LEFT JOIN co USING (variable)""",
    ["mutual_information", "f_statistic", "correlation", "f_p_value", "corr_p_value"]))
def q_importance_comparison_forest(spark, sf_dir):
    """All four measures; the forest's column is shown by what holds for any forest (each share within 0..1, sum 1)."""
    df = lineitem_cohort(spark, sf_dir)
    forest, kept = fitted_forest(df)
    shares = IM.random_forest_importance(forest, kept)
    out = IM.importance_table(df, LI, LI_NUMERIC, rf=shares)
    return rounded(out.withColumn("rf_within_0_1", F.col("rf_importance").between(0, 1) & (F.col("rf_importance") > 0))
                   .withColumn("rf_total", F.sum("rf_importance").over(Window.partitionBy())).drop("rf_importance"))


@register("rank_features", O.rounded(f"""SELECT variable, mutual_information,
    (row_number() OVER (ORDER BY mutual_information DESC, variable))::INTEGER AS rank FROM ({_mi_sql()})""", ["mutual_information"]))
def q_rank_features(spark, sf_dir):
    return rounded(IM.rank_features(IM.mutual_information(lineitem_cohort(spark, sf_dir), LI, LI_NUMERIC),
                                    "mutual_information"))


@register("importance_dataset_info", f"""SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS n_positive,
    round(count(*) FILTER (WHERE l_linestatus = 'F') * 100.0 / count(*), 2) AS positive_pct, {len(LI_NUMERIC)} AS n_features FROM lineitem""")
def q_dataset_info(spark, sf_dir):
    return IM.dataset_info(lineitem_cohort(spark, sf_dir), LI, len(LI_NUMERIC))


def _split_folds_sql(rel: str, label: str, key: str, k: int = 10, seed: int = 42) -> str:
    return f"""(WITH c AS (SELECT {label} AS lab, count(*)::BIGINT AS n FROM {rel} GROUP BY ALL),
      t AS (SELECT sum(n)::BIGINT AS total,
                   sum(n)::BIGINT - ceil(sum(n)::DOUBLE * (1::DOUBLE / 3::DOUBLE))::BIGINT AS n_train FROM c),
      a AS (SELECT c.lab, c.n, (c.n * t.n_train) // t.total AS base, (c.n * t.n_train) % t.total AS rem, t.n_train FROM c, t),
      b AS (SELECT lab, n, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, lab) <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS k_train FROM a),
      o AS (SELECT lab, n - k_train AS k_test,
                   coalesce(sum(k_train) OVER (ORDER BY lab ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM b),
      r AS (SELECT src.*, row_number() OVER (PARTITION BY {label} ORDER BY {hash_hex_sql(seed, key)}, {key}) AS rk FROM {rel} AS src)
    SELECT r.* EXCLUDE (rk), CASE WHEN r.rk <= o.k_test THEN 'test' ELSE 'train' END AS split,
           (CASE WHEN r.rk <= o.k_test THEN -1 ELSE (o.off + r.rk - o.k_test - 1) % {k} END)::INTEGER AS fold
    FROM r JOIN o ON r.{label} = o.lab)"""


# --- a fitted study: logistic regression on the structured set ------------------
# run_study fits ten folds and the refit (scaler, imputer and classifier on each
# fold's own training rows) and writes their predictions; the oracle fits the
# same models by Newton steps. The solver runs to 1e-12, so that both agree.


_FITTED_SETS, _FITTED_MODELS = ["a-x"], ["LR"]


def _fitted_config():
    from cohortkit.plans.study import StudyConfig
    return StudyConfig(variant="optimised", feature_sets=_FITTED_SETS, models=_FITTED_MODELS, tol=1e-12)


def fitted_study(spark, sf_dir):
    from cohortkit.plans import study as ST
    return ST.run_study(spark, ST.document_study_table(spark, sf_dir), _fitted_config())


def _fitted_sql() -> str:
    rel = r"""(SELECT doc_id AS row_id, n_chars::DOUBLE AS n_chars,
        len(string_split_regex(trim(text), '[ \t\n\x0B\f\r]+'))::DOUBLE AS n_words,
        len(string_split(text, chr(10)))::DOUBLE AS n_lines, quality::DOUBLE AS quality, toxic::INTEGER AS label
        FROM documents JOIN labels USING (doc_id))"""
    ctes = O.logistic_ctes(_split_folds_sql(rel, "label", "row_id"), ["n_chars", "n_words", "n_lines", "quality"], 10)
    return f"""(WITH {ctes}
    SELECT 'a-x' AS feature_set, 'LR' AS model, split, fold, row_id, label, score, (score > 0.5)::INTEGER AS pred FROM scored)"""


def _fitted_metrics_sql() -> str:
    return f"(WITH pr AS MATERIALIZED {_fitted_sql()} SELECT * FROM {_auc_sql('pr')} JOIN {_prf_sql('pr')} USING ({_G}))"


@register("predict_score", O.rounded(f"SELECT * FROM {_fitted_sql()}", ["score"], 4))
def q_predict_score(spark, sf_dir):
    """Scores of fitted models: every train row by the model that did not see its fold, test rows by the refit."""
    return rounded(fitted_study(spark, sf_dir)["predictions"], 4)


_METRIC_COLS = ["AUC", "precision", "recall", "f1", "accuracy"]


@register("cross_validate_fold", O.rounded(f"SELECT * FROM {_fitted_metrics_sql()}", _METRIC_COLS))
def q_cross_validate_fold(spark, sf_dir):
    """10 fold fits + refit of LR on the structured set; fold metrics."""
    return rounded(fitted_study(spark, sf_dir)["fold_metrics"])


@register("holdout_evaluate", O.rounded(
    f"SELECT feature_set, model, {', '.join(_METRIC_COLS)} FROM {_fitted_metrics_sql()} WHERE split = 'test'", _METRIC_COLS))
def q_holdout(spark, sf_dir):
    return rounded(fitted_study(spark, sf_dir)["test_results"].select("feature_set", "model", *_METRIC_COLS))


@register("run_study", O.rounded(f"""SELECT feature_set, model, {', '.join(
    f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std" for m in EV.METRICS)}, 'ok' AS status
    FROM {_fitted_metrics_sql()} WHERE split = 'train' GROUP BY ALL""", _CV_COLS))
def q_run_study(spark, sf_dir):
    return rounded(fitted_study(spark, sf_dir)["cv_results"].select("feature_set", "model", *_CV_COLS, "status"))


@register("batch_score_reloaded", O.rounded(
    f"SELECT row_id, label, pred, score FROM {_fitted_sql()} WHERE split = 'test'", ["score"], 4))
def q_batch_score_reloaded(spark, sf_dir):
    """The saved refit of the study, loaded again, on the test rows."""
    from cohortkit.plans import study as ST
    tab, cfg = ST.document_study_table(spark, sf_dir), _fitted_config()
    feats, _, _ = ST.prepare_features(tab, cfg)
    path = f"{ST.run_study(spark, tab, cfg)['out_dir']}/models/a_x_LR"
    scored = ST.batch_score(spark, path, feats.filter("split = 'test'"))
    return rounded(scored.select("row_id", "label", "pred", "score"), 4)


# --- models, study, persistence (invariant checks only: no SQL oracle) --------


def _study(spark, sf_dir, variant="optimised"):
    from cohortkit.plans import study as ST
    cfg = ST.StudyConfig(variant=variant)
    tab = ST.document_study_table(spark, sf_dir)
    feats, _, _ = ST.prepare_features(tab, cfg)
    parts = max(1, -(-tab.count() // 100_000))
    return ST, cfg, feats.repartition(parts, "row_id").cache()


def _model_query(name):
    def q(spark, sf_dir):
        ST, cfg, feats = _study(spark, sf_dir)
        counts = ST.fold_class_counts(feats)
        m = ST.fit_pipeline(feats.filter("split = 'train'"), "a-y", name, cfg, counts.get(-1))
        return ST._predict(m, feats.filter("split = 'test'"), "a-y", name, "test", -1)
    q.__name__ = f"q_model_{name.lower()}"
    return q


for _m in EV.MODEL_ORDER:
    register(f"model_{_m.lower()}")(_model_query(_m))


# --- networks: the first pass recomputed in SQL, and a whole training -------------

_NET_LAYERS, _NET_ALPHA = (64, 8, 1), 0.001


def network_rows(spark, sf_dir):
    """One fit on all vectors: label 0 against the rest."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.lit(None).cast("int").alias("fit"), F.lit(0).alias("fold"),
        F.lit("train").alias("split"), (F.col("label") == 0).cast("double").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"))


def _first_step_sql() -> str:
    d, h, _ = _NET_LAYERS

    def u(layer, i, j):
        return f"(2 * {uniform_sql(42, O.lit('w'), layer, i, j)} - 1) * sqrt(6.0::DOUBLE / ({(d + h, h + 1)[int(layer)]}))"
    return f"""WITH e AS MATERIALIZED (SELECT vec_id, (label = 0)::INTEGER AS y, embedding::DOUBLE[] || [1.0::DOUBLE] AS x
        FROM embeddings WHERE {uniform_sql(42, O.lit('val'), 'vec_id')} >= 0.1),
      w AS MATERIALIZED (SELECT i, j, {u('0', 'i', 'j')} AS w FROM range({d + 1}) a(i), range({h}) b(j)),
      v AS MATERIALIZED (SELECT i, {u('1', 'i', '0')} AS v FROM range({h + 1}) a(i)),
      flat AS MATERIALIZED (SELECT vec_id, unnest(range({d + 1})) AS i, unnest(x) AS x FROM e),
      hid AS MATERIALIZED (SELECT vec_id, j, sum(x * w) AS h FROM flat JOIN w USING (i) GROUP BY vec_id, j),
      outp AS MATERIALIZED (SELECT vec_id, y, z, 1 / (1 + exp(-z)) - y AS delta FROM e JOIN (
        SELECT vec_id, sum(greatest(h, 0) * v) + (SELECT v FROM v WHERE i = {h}) AS z
        FROM hid JOIN v ON v.i = hid.j GROUP BY vec_id) USING (vec_id)),
      n AS (SELECT count(*)::DOUBLE AS n FROM e),
      loss AS (SELECT avg(ln(1 + exp(z)) - y * z) + {_NET_ALPHA} / (2 * max(n.n)) * (
        (SELECT sum(w * w) FROM w WHERE i < {d}) + (SELECT sum(v * v) FROM v WHERE i < {h})) AS loss FROM outp, n),
      g AS (SELECT 0 AS layer, flat.i AS i, hid.j AS j, sum(delta * v.v * (h > 0)::INTEGER * x) AS g
            FROM flat JOIN hid USING (vec_id) JOIN outp USING (vec_id) JOIN v ON v.i = hid.j GROUP BY flat.i, hid.j
            UNION ALL
            SELECT 1, j, 0, sum(delta * greatest(h, 0)) FROM hid JOIN outp USING (vec_id) GROUP BY j
            UNION ALL SELECT 1, {h}, 0, sum(delta) FROM outp)
      SELECT g.layer::INTEGER AS layer, g.i::INTEGER AS "row", g.j::INTEGER AS "column", loss,
             (g.g + CASE WHEN g.layer = 0 AND g.i < {d} THEN {_NET_ALPHA} * w.w
                         WHEN g.layer = 1 AND g.i < {h} THEN {_NET_ALPHA} * v.v ELSE 0 END) / n.n AS gradient
      FROM g CROSS JOIN loss CROSS JOIN n LEFT JOIN w ON g.layer = 0 AND w.i = g.i AND w.j = g.j
      LEFT JOIN v ON g.layer = 1 AND v.i = g.i"""


@register("network_first_step", O.rounded(_first_step_sql(), ["loss", "gradient"]))
def q_network_first_step(spark, sf_dir):
    """Loss and gradient of a network at its starting weights, back-propagated over all vectors."""
    loss, gradient = NN.first_step(network_rows(spark, sf_dir), list(_NET_LAYERS), _NET_ALPHA)
    return rounded(spark.createDataFrame([(*at, loss, g) for at, g in gradient.items()],
                                         "layer int, row int, column int, loss double, gradient double"))


@register("network_training")
def q_network_training(spark, sf_dir):
    """Training of the same network until its validation share stops gaining."""
    net = NN.fit_networks(network_rows(spark, sf_dir), [-1], list(_NET_LAYERS), {}, _NET_ALPHA, 300)[-1]
    rows = [(i, float(loss), float(score), i == net.best_epoch) for i, (loss, score) in enumerate(net.curve)]
    return rounded(spark.createDataFrame(rows, "epoch int, loss double, validation_accuracy double, kept boolean"))


# --- trees over all distinct values: the first levels searched again in SQL -------

_TREE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _tree_sql() -> str:
    rows = "SELECT (l_linestatus = 'F')::INTEGER AS y, " + ", ".join(_TREE_COLUMNS) + " FROM lineitem"
    pick = " ".join(f'WHEN {j} THEN {c}' for j, c in enumerate(_TREE_COLUMNS))

    def level(name: str, source: str) -> str:
        side = "coalesce(({0} * {0} + {1} * {1}) / nullif({0} + {1}, 0), 0)".format
        return f"""{name} AS MATERIALIZED (
          SELECT node, arg_min("column", (-gain, "column", cut)) AS "column", arg_min(cut, (-gain, "column", cut)) AS cut,
                 max(gain) AS gain, max(t0 + t1) AS n
          FROM (SELECT *, value / 2 + next / 2 AS cut, {side('l0', 'l1')} + {side('(t0 - l0)', '(t1 - l1)')} AS gain
                FROM (SELECT node, "column", value, lead(value) OVER w AS next, sum(n0) OVER (w ROWS UNBOUNDED PRECEDING) AS l0,
                             sum(n1) OVER (w ROWS UNBOUNDED PRECEDING) AS l1, sum(n0) OVER (PARTITION BY node, "column") AS t0,
                             sum(n1) OVER (PARTITION BY node, "column") AS t1
                      FROM (SELECT node, "column", value, sum(1 - y)::DOUBLE AS n0, sum(y)::DOUBLE AS n1
                            FROM (SELECT node, y, unnest([{', '.join(str(j) for j in range(len(_TREE_COLUMNS)))}]) AS "column",
                                         unnest([{', '.join(c + '::DOUBLE' for c in _TREE_COLUMNS)}]) AS value FROM {source})
                            GROUP BY ALL)
                      WINDOW w AS (PARTITION BY node, "column" ORDER BY value))
                WHERE next IS NOT NULL) GROUP BY node)"""
    return f"""WITH r0 AS (SELECT 0 AS node, * FROM ({rows})), {level('s0', 'r0')},
      r1 AS (SELECT CASE WHEN (CASE "column" {pick} END) <= cut THEN 1 ELSE 2 END AS node, y, {', '.join(_TREE_COLUMNS)}
             FROM r0 JOIN s0 USING (node)), {level('s1', 'r1')}
      SELECT node::INTEGER AS node, "column"::INTEGER AS "column", cut, 1 - gain / n AS gini
      FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1)"""


@register("exact_tree_levels", O.rounded(_tree_sql(), ["cut", "gini"], 9))
def q_exact_tree_levels(spark, sf_dir):
    """Column, cut and gini of the first two levels of a tree on lineitem."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.array(*[F.col(c).cast("double") for c in _TREE_COLUMNS]).alias("x"),
        (F.col("l_linestatus") == "F").cast("double").alias("label"), F.lit(1.0).alias("weight"))
    t = ET.grow_tree(rows, 2)
    found = [(n, c, t.cut[n], 1 - t.gain[n] / (t.zero[n] + t.one[n])) for n, c in enumerate(t.column) if c >= 0]
    return rounded(spark.createDataFrame(found, "node int, column int, cut double, gini double"), 9)


@register("model_dt_exact")
def q_model_dt_exact(spark, sf_dir):
    """The study's tree without bins, on the structured set; scores of the test rows."""
    from cohortkit.plans import study as ST
    cfg = ST.StudyConfig(variant="optimised", feature_sets=["a-x"], exact_trees=True)
    feats, _, _ = ST.prepare_features(ST.document_study_table(spark, sf_dir), cfg)
    m = ST.fit_pipeline(feats.filter("split = 'train'"), "a-x", "DT", cfg)
    return ST._predict(m, feats.filter("split = 'test'"), "a-x", "DT", "test", -1)


@register("sigmoid_calibration", O.rounded(O.sigmoid_sql(
    "(SELECT embedding[1]::DOUBLE * 6 - embedding[2]::DOUBLE * 3 - 1 AS f, (label < 3)::INTEGER AS y FROM embeddings)"),
    ["a", "b"]))
def q_sigmoid_calibration(spark, sf_dir):
    """The two parameters of the sigmoid for decision values of a fixed plane."""
    v = F.col("embedding").cast("array<double>")
    margins = table(spark, sf_dir, "embeddings").select((v[0] * 6 - v[1] * 3 - 1).alias("margin"),
                                                        (F.col("label") < 3).cast("int").alias("label"))
    return rounded(spark.createDataFrame([fit_sigmoid(margins)], "a double, b double"))


@register("batch_score")
def q_batch_score(spark, sf_dir):
    """Fit, save, load and score: the loaded pipeline must reproduce the scores."""
    ST, cfg, feats = _study(spark, sf_dir)
    counts = ST.fold_class_counts(feats)
    m = ST.fit_pipeline(feats.filter("split = 'train'"), "a-x,z", "LR", cfg, counts.get(-1))
    path = stage_path(spark, "queries", "models", uuid.uuid4().hex[:8], "a_x_z_LR")
    m.write().overwrite().save(path)
    test = feats.filter("split = 'test'")
    return ST.batch_score(spark, path, test).select("row_id", "label", "pred", "score")


@register("importance_random_forest")
def q_rf_importance(spark, sf_dir):
    forest, kept = fitted_forest(lineitem_cohort(spark, sf_dir))
    return IM.random_forest_importance(forest, kept)


@register("pca_reduce")
def q_pca_reduce(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model, _ = RD.fit_pca(e, "v", "pca", RD.PCA_COMPONENTS)
    return model.transform(e).select("vec_id", F.posexplode(vector_to_array("pca")).alias("component", "value"))


@register("explained_variance")
def q_explained_variance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    _, var = RD.fit_pca(e, "v", "pca", RD.PCA_COMPONENTS)
    n = e.count()
    return spark.createDataFrame([("embedding", RD.PCA_COMPONENTS, var, n)],
                                 "feature string, n_components int, variance_ratio double, n_rows bigint")


@register("pca_total_variance", O.rounded("""SELECT sum(v) AS total_variance, 0.0::DOUBLE AS largest_mean, max(n)::BIGINT AS n_rows
    FROM (SELECT var_samp(x) AS v, count(*) AS n FROM (
        SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos)""",
    ["total_variance", "largest_mean"]))
def q_pca_total_variance(spark, sf_dir):
    """All components together keep the variance of the vectors, and each is centred."""
    e = table(spark, sf_dir, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    width = len(e.first()["v"])
    model, _ = RD.fit_pca(e, "v", "pca", width)
    per = (model.transform(e).select(F.posexplode(vector_to_array("pca")).alias("component", "x")).groupBy("component")
           .agg(F.var_samp("x").alias("v"), F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")))
    return rounded(per.agg(F.sum("v").alias("total_variance"), F.max(F.abs("m")).alias("largest_mean"),
                           F.max("n").alias("n_rows")))


WIDE_PCA_K = 8


@register("pca_wide", O.rounded(f"""SELECT c.component, t.n_rows, t.total_variance, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS residual
    FROM (SELECT unnest(range({WIDE_PCA_K}))::INTEGER AS component) c, (SELECT sum(v) AS total_variance, max(n)::BIGINT AS n_rows
        FROM (SELECT var_samp(x) AS v, count(*) AS n FROM (
            SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
            GROUP BY pos)) t""", ["total_variance", "mean", "residual"]))
def q_pca_wide(spark, sf_dir):
    """Axes fitted without the covariance matrix, held against it: each projection is centred, and its
    covariances with the columns are its variance times its axis (residual against the largest variance)."""
    e = table(spark, sf_dir, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model, _ = RD.fit_pca(e, "v", "pca", WIDE_PCA_K, wide=0)
    axes = model.stages[1].pc.toArray() * model.stages[2].getScalingVec().toArray()
    of = F.array(*[F.array(*[F.lit(float(x)) for x in axes[:, j]]) for j in range(WIDE_PCA_K)])
    both = (model.transform(e).select(vector_to_array("v").alias("v"), F.posexplode(vector_to_array("pca")).alias("component", "p"))
            .select("component", "p", F.posexplode("v").alias("pos", "x")))
    cells = both.groupBy("component", "pos").agg(
        F.covar_samp("x", "p").alias("c"), F.var_samp("p").alias("variance"), F.var_samp("x").alias("spread"),
        F.avg("p").alias("mean"), F.count(F.lit(1)).alias("n"))  # components x columns
    off = F.col("c") - F.col("variance") * of[F.col("component")][F.col("pos")]
    per = cells.groupBy("component").agg(
        F.max("n").alias("n_rows"), F.sum("spread").alias("total_variance"), F.max("mean").alias("mean"),
        F.sqrt(F.sum(off * off)).alias("off"))
    largest = float(model.stages[1].explainedVariance[0]) * F.col("total_variance")
    return rounded(per.select("component", "n_rows", "total_variance", "mean", (F.col("off") / largest).alias("residual")))


@register("pca_report")
def q_pca_report(spark, sf_dir):
    """PCA of both text columns of the study (fit on train, applied to both splits)."""
    from cohortkit.plans import study as ST
    tab = ST.document_study_table(spark, sf_dir)
    train, test = tab.filter("split = 'train'"), tab.filter("split = 'test'")
    cfgs = []
    for col in ST.TEXT_COLUMNS:
        enc = TX.fit_text_encoder(train, col, f"{col}_vec")
        cfgs.append({"name": col, "train": enc.transform(train), "test": enc.transform(test),
                     "input_col": f"{col}_vec", "k": RD.PCA_COMPONENTS})
    return RD.pca_report(RD.pca_batch(cfgs))


@register("embed_text")
def q_embed_text(spark, sf_dir):
    """Whole-text hashing/IDF vectors of documents: width and non-zero count per row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = TX.embed_text(d, "text", "vec")
    arr = vector_to_array("vec")
    return out.select("doc_id", F.size(arr).alias("width"),
                      F.size(F.filter(arr, lambda x: x != 0)).alias("non_zero"))


@register("smote_tomek", f"""{_smote_sql()},
    r AS MATERIALIZED (SELECT id, v, y FROM e UNION ALL
        SELECT -(j.i + 1) AS id, [j.x[p] + j.u * (j.yv[p] - j.x[p]) FOR p IN generate_series(1, len(j.x))] AS v, 1 AS y FROM j),
    {_tomek_ctes('r')}
    SELECT y AS label, count(*)::BIGINT AS n FROM r
    WHERE id NOT IN (SELECT a_id FROM links UNION ALL SELECT b_id FROM links) GROUP BY ALL""")
def q_smote_tomek(spark, sf_dir):
    res = BA.smote_tomek(embeddings_binary(spark, sf_dir), "id", "v", "y", minority=1)
    return profile.class_balance(res, "y")


# --- stage hand-off ------------------------------------------------------------

@register("read_feature_table", O.rounded(f"""WITH d AS {_ORDERS_CLEAN_SPLIT_SQL},
    st AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1 FROM d WHERE split = 'train')
    SELECT o_orderkey, split, (o_totalprice - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1.0 END AS o_totalprice FROM d, st""",
    ["o_totalprice"]))
def q_feature_table_roundtrip(spark, sf_dir):
    """Scaled features written partitioned by split to the stage folder, then read back."""
    d = orders_clean_split(spark, sf_dir).select("o_orderkey", "split", "o_totalprice")
    scaled = FE.fit_zscore(d.filter("split = 'train'"), ["o_totalprice"]).transform(d)
    path = stage_path(spark, "queries", "features", uuid.uuid4().hex[:8])
    write_feature_table(scaled, path, key="o_orderkey")
    return rounded(read_feature_table(spark, path, required=["o_orderkey", "o_totalprice"])
                   .select("o_orderkey", "split", "o_totalprice"))


@register("split_and_folds", "SELECT * FROM " + _split_folds_sql(
    "(SELECT o_orderkey, o_orderstatus FROM orders)", "o_orderstatus", "o_orderkey"))
def q_split_and_folds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.split_and_folds(o, "o_orderstatus", "o_orderkey", 1 / 3, 10, 42)
