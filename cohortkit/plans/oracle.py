"""DuckDB SQL twins of the registered queries (the correctness oracle).

These render plain SQL from the same cohort specs so that the oracle and the
Spark plans agree on rules without sharing code paths.
"""

from __future__ import annotations

from cohortkit.functions.special import chi2_sf_sql, fisher_sql, t_two_sided_sql
from cohortkit.spec import CATEGORICAL_MAX_DISTINCT, CohortSpec


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def rounded(inner: str, double_cols, digits: int = 6) -> str:
    """Wrap a query, rounding the named double columns (and turning -0.0 into 0.0)."""
    if not double_cols:
        return inner
    rep = ", ".join(f"round({q(c)}, {digits}) + 0.0 AS {q(c)}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS _r"


def clean_select(spec: CohortSpec, table: str, keep) -> str:
    """SELECT applying the range and zero rules of ``spec`` to ``table``."""
    cols = []
    for c in keep:
        if c in spec.ranges or c in spec.zero_invalid:
            conds = []
            if c in spec.ranges:
                lo, hi = spec.ranges[c]
                conds += [f"{q(c)} >= {float(lo)!r}", f"{q(c)} <= {float(hi)!r}"]
            if c in spec.zero_invalid:
                conds.append(f"{q(c)} <> 0.0")
            cols.append(f"CASE WHEN {' AND '.join(conds)} THEN CAST({q(c)} AS DOUBLE) END AS {q(c)}")
        elif c in spec.numeric:
            cols.append(f"CASE WHEN NOT isnan(CAST({q(c)} AS DOUBLE)) THEN CAST({q(c)} AS DOUBLE) END AS {q(c)}")
        else:
            cols.append(q(c))
    return f"SELECT {', '.join(cols)} FROM {table}"


def profile_sql(spec: CohortSpec, rel: str, numeric_vars, all_vars) -> str:
    """grp, variable, min, max, mean, std, count, missing, missing_ratio."""
    parts = []
    for grp_expr, where in (("'all'", "TRUE"),
                            (f"{q(spec.label)}", f"{q(spec.label)} IN ({lit(spec.positive)}, {lit(spec.negative)})")):
        for v in all_vars:
            x = q(v)
            if v in numeric_vars:
                stats = f"min({x})::DOUBLE, max({x})::DOUBLE, avg({x}), stddev_samp({x})"
            else:
                stats = "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
            parts.append(
                f"SELECT {grp_expr} AS grp, {lit(v)} AS variable, {stats}, count({x})::BIGINT, "
                f"(count(*) - count({x}))::BIGINT, (count(*) - count({x})) * 100.0 / count(*) "
                f"FROM {rel} WHERE {where} GROUP BY ALL")
    body = " UNION ALL ".join(parts)
    return (f"SELECT grp, variable, col2 AS min, col3 AS max, col4 AS mean, col5 AS std, col6 AS count, "
            f"col7 AS missing, col8 AS missing_ratio FROM ({body}) AS _p(grp, variable, col2, col3, col4, col5, col6, col7, col8)")


def group_stats_sql(spec: CohortSpec, rel: str, variables) -> str:
    """variable, n1, m1, v1, n2, m2, v2 per numeric variable."""
    pos, neg, y = lit(spec.positive), lit(spec.negative), q(spec.label)
    parts = [f"""SELECT {lit(v)} AS variable,
        count({q(v)}) FILTER (WHERE {y} = {pos}) AS n1, avg({q(v)}) FILTER (WHERE {y} = {pos}) AS m1,
        var_samp({q(v)}) FILTER (WHERE {y} = {pos}) AS v1,
        count({q(v)}) FILTER (WHERE {y} = {neg}) AS n2, avg({q(v)}) FILTER (WHERE {y} = {neg}) AS m2,
        var_samp({q(v)}) FILTER (WHERE {y} = {neg}) AS v2 FROM {rel}""" for v in variables]
    if not parts:
        return ("SELECT NULL::VARCHAR AS variable, 0::BIGINT AS n1, 0.0 AS m1, 0.0 AS v1, "
                "0::BIGINT AS n2, 0.0 AS m2, 0.0 AS v2 WHERE false")
    return " UNION ALL ".join(parts)


def welch_sql_ctes(spec: CohortSpec, rel: str, variables) -> str:
    """CTE text defining gs, w (variable, t, dof) and wp (variable, p)."""
    return f"""gs AS ({group_stats_sql(spec, rel, variables)}),
    w AS (SELECT variable,
            CASE WHEN n1 > 0 AND n2 > 0 AND (v1/n1 + v2/n2) > 0 THEN (m1 - m2) / sqrt(v1/n1 + v2/n2) END AS t,
            CASE WHEN n1 > 0 AND n2 > 0 AND (v1/n1 + v2/n2) > 0 THEN power(v1/n1 + v2/n2, 2) /
                 (power(v1/n1, 2) / (n1 - 1) + power(v2/n2, 2) / (n2 - 1)) END AS dof FROM gs),
    wp AS {t_two_sided_sql('w', 'variable', 't', 'dof')}"""


def contingency_ctes(spec: CohortSpec, rel: str, variables) -> str:
    """CTEs: cont(variable, value, label, n) and shape(variable, n, r, c, dof, min_cell, a, b, c_, d, statistic)."""
    y = q(spec.label)
    lv = " UNION ALL ".join(
        f"SELECT {lit(v)} AS variable, CAST({q(v)} AS VARCHAR) AS value, {y} AS label FROM {rel} "
        f"WHERE {q(v)} IS NOT NULL AND {y} IN ({lit(spec.positive)}, {lit(spec.negative)})" for v in variables)
    return f"""cont AS (SELECT variable, value, label, count(*)::BIGINT AS n FROM ({lv}) GROUP BY ALL),
    rt AS (SELECT variable, value, sum(n) AS row_n FROM cont GROUP BY ALL),
    ct AS (SELECT variable, label, sum(n) AS col_n FROM cont GROUP BY ALL),
    tt AS (SELECT variable, sum(n)::DOUBLE AS nn, count(DISTINCT value) AS r, count(DISTINCT label) AS c,
                  count(*) AS cells, min(n) AS min_nz FROM cont GROUP BY ALL),
    cells AS (SELECT cont.*, row_n, col_n, nn, r, c, cells, min_nz, row_n * col_n / nn AS e,
                     dense_rank() OVER (PARTITION BY cont.variable ORDER BY value) AS vi,
                     dense_rank() OVER (PARTITION BY cont.variable ORDER BY label) AS li
              FROM cont JOIN rt USING (variable, value) JOIN ct USING (variable, label) JOIN tt USING (variable)),
    shape0 AS (SELECT variable, any_value(nn) AS nn, any_value(r) AS r, any_value(c) AS c,
                      any_value(cells) AS cells, any_value(min_nz) AS min_nz,
                      sum(n * n / e) AS so2e,
                      sum(CASE WHEN vi = 1 AND li = 1 THEN n ELSE 0 END)::DOUBLE AS a,
                      sum(CASE WHEN vi = 1 AND li = 2 THEN n ELSE 0 END)::DOUBLE AS b,
                      sum(CASE WHEN vi = 2 AND li = 1 THEN n ELSE 0 END)::DOUBLE AS c_,
                      sum(CASE WHEN vi = 2 AND li = 2 THEN n ELSE 0 END)::DOUBLE AS d
               FROM cells GROUP BY variable),
    shape AS (SELECT variable, nn::BIGINT AS n, r, c, ((r - 1) * (c - 1))::INTEGER AS dof,
                     (CASE WHEN cells < r * c THEN 0 ELSE min_nz END)::BIGINT AS min_cell, a, b, c_, d,
                     greatest(0.0, CASE WHEN (r - 1) * (c - 1) = 0 THEN 0.0
                          WHEN (r - 1) * (c - 1) = 1 THEN
                               power(greatest(abs(a - (a + b) * (a + c_) / nn) - 0.5, 0.0), 2) * power(nn, 3)
                               / ((a + b) * (c_ + d) * (a + c_) * (b + d))
                          ELSE so2e - nn END) AS statistic
              FROM shape0),
    chip AS {chi2_sf_sql('shape', 'variable', 'statistic', 'dof')},
    fp AS {fisher_sql("(SELECT * FROM shape WHERE r = 2 AND c = 2)", 'variable', 'a', 'b', 'c_', 'd')}"""


def kinds_ctes(spec: CohortSpec, rel: str, variables, numeric_vars) -> str:
    """CTE kinds(variable, nd, present, kind)."""
    nd = " UNION ALL ".join(f"SELECT {lit(v)} AS variable, count(DISTINCT {q(v)}) AS nd, count({q(v)}) AS nn FROM {rel}"
                            for v in variables)
    forced = ", ".join(lit(c) for c in spec.categorical) or "NULL"
    nums = ", ".join(lit(c) for c in numeric_vars) or "NULL"
    k = CATEGORICAL_MAX_DISTINCT
    return f"""nd AS ({nd}),
    kinds AS (SELECT variable, nd, nn > 0 AS present,
                CASE WHEN variable IN ({forced}) OR (nd >= 2 AND nd <= {k}) THEN 'categorical'
                     WHEN variable IN ({nums}) THEN 'numeric' ELSE 'other' END AS kind FROM nd)"""


def screen_ctes(spec: CohortSpec, rel: str, variables, numeric_vars, alpha: float = 0.05) -> str:
    """CTEs up to screen(variable, p_value, test_type, significant, significance_level)."""
    return f"""{kinds_ctes(spec, rel, variables, numeric_vars)},
    {welch_sql_ctes(spec, rel, [v for v in variables if v in numeric_vars])},
    {contingency_ctes(spec, rel, variables)},
    tests AS (
      SELECT k.variable, wp.p AS p_value, 't-test' AS test_type FROM kinds k JOIN wp USING (variable)
        WHERE k.present AND k.kind = 'numeric'
      UNION ALL
      SELECT k.variable,
             CASE WHEN s.min_cell < 5 AND s.r = 2 AND s.c = 2 THEN fp.p ELSE chip.p END,
             CASE WHEN s.min_cell < 5 AND s.r = 2 AND s.c = 2 THEN 'fisher-exact' ELSE 'chi-square' END
        FROM kinds k JOIN shape s USING (variable) JOIN chip USING (variable) LEFT JOIN fp USING (variable)
        WHERE k.present AND k.kind <> 'numeric'),
    screen AS (SELECT variable, p_value, test_type, coalesce(p_value < {alpha}, false) AS significant,
                 CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**'
                      WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS significance_level FROM tests)"""


def logistic_ctes(study: str, features, folds: int, steps: int = 10) -> str:
    """CTEs ending in `scored` (fit, split, fold, row_id, label, score): one weighted ridge
    logistic regression per held-out fold (fit = fold) and one on the whole training split
    (fit = -1), by Newton steps with a Cholesky solve; one recursive body holds the step.

    Features are standardised on the fit's own training rows, classes weigh n / (2 n_c), and
    the penalty is 1/(2n) on the weights (not on the intercept). `study` has row_id, label,
    split, fold and the features.
    """
    d = len(features)
    xs = ["1.0"] + [f"z{j}" for j in range(1, d + 1)]
    scale = ", ".join(f"avg({c}) AS m{j}, stddev_pop({c}) AS s{j}" for j, c in enumerate(features, 1))
    z = ", ".join(f"(t.{c} - m{j}) / CASE WHEN s{j} > 0 THEN s{j} ELSE 1.0 END AS z{j}" for j, c in enumerate(features, 1))
    odds = " + ".join(["b0"] + [f"b{j} * z{j}" for j in range(1, d + 1)])
    penalty = lambda j, by: f" + {by} / max(n)" if j else ""
    grad = ", ".join(f"sum(w * (p - label) * {x}) / sum(w){penalty(j, f'max(b{j})')} AS g{j}" for j, x in enumerate(xs))
    hess = ", ".join(f"sum(w * p * (1 - p) * {xs[i]} * {xs[j]}) / sum(w){penalty(j, '1.0') if i == j else ''} AS h{i}_{j}"
                     for i in range(d + 1) for j in range(i + 1))
    keep = ", ".join(f"max(b{j}) AS b{j}" for j in range(d + 1))
    # L L' = H, L u = g, L' v = u, one column a subquery
    solved = (f"(SELECT step, fit, {keep}, {grad}, {hess} FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS p FROM zt "
              f"JOIN newton USING (fit) WHERE step < {steps}) GROUP BY step, fit)")
    for j in range(d + 1):
        def rest(i):
            return "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        below = "".join(f", (h{i}_{j}{rest(i)}) / l{j}_{j} AS l{i}_{j}" for i in range(j + 1, d + 1))
        solved = f"(SELECT *, sqrt(h{j}_{j}{rest(j)}) AS l{j}_{j} FROM {solved})"
        solved = (f"(SELECT *, (g{j}{''.join(f' - l{j}_{k} * u{k}' for k in range(j))}) / l{j}_{j} AS u{j}{below} "
                  f"FROM {solved})")
    for j in range(d, -1, -1):
        solved = (f"(SELECT *, (u{j}{''.join(f' - l{k}_{j} * v{k}' for k in range(j + 1, d + 1))}) / l{j}_{j} AS v{j} "
                  f"FROM {solved})")
    ctes = [
        f"RECURSIVE study AS MATERIALIZED (SELECT * FROM {study})",
        f"fits AS (SELECT range::INTEGER AS fit FROM range(-1, {folds}))",
        "tr AS (SELECT fit, s.* FROM study s, fits WHERE s.split = 'train' AND s.fold <> fit)",
        f"sc AS MATERIALIZED (SELECT fit, {scale} FROM tr GROUP BY fit)",
        f"zt AS MATERIALIZED (SELECT t.fit, t.label, {z}, count(*) OVER (PARTITION BY t.fit)::DOUBLE AS n, "
        "count(*) OVER (PARTITION BY t.fit) / (2.0 * count(*) OVER (PARTITION BY t.fit, t.label)) AS w "
        "FROM tr t JOIN sc USING (fit))",
        f"newton AS (SELECT 0 AS step, fit, {', '.join(f'0.0::DOUBLE AS b{j}' for j in range(d + 1))} FROM fits UNION ALL "
        f"SELECT step + 1, fit, {', '.join(f'b{j} - v{j}' for j in range(d + 1))} FROM {solved})",
        f"fitted AS MATERIALIZED (SELECT * FROM newton WHERE step = {steps})"]
    ctes.append(
        f"scored AS MATERIALIZED (SELECT fit, split, fold, row_id, label, 1 / (1 + exp(-({odds}))) AS score FROM "
        f"(SELECT fits.fit, t.split, t.fold, t.row_id, t.label, {z} FROM study t JOIN fits "
        "ON (t.split = 'train' AND t.fold = fits.fit) OR (t.split = 'test' AND fits.fit = -1) "
        f"JOIN sc ON sc.fit = fits.fit) JOIN fitted USING (fit))")
    return ", ".join(ctes)


def sigmoid_sql(margins: str, steps: int = 12) -> str:
    """Rows (a, b) of the sigmoid fitted on `margins` (f, y) by Newton steps in one recursive body."""
    return f"""WITH RECURSIVE m AS MATERIALIZED (SELECT f, CASE WHEN y = 1 THEN (n1 + 1.0) / (n1 + 2.0) ELSE 1.0 / (n0 + 2.0) END AS t, n0, n1
        FROM (SELECT f, y, sum((y = 1)::INTEGER) OVER ()::DOUBLE AS n1, sum((y <> 1)::INTEGER) OVER ()::DOUBLE AS n0 FROM {margins})),
      s AS (SELECT 0 AS step, 0.0::DOUBLE AS a, ln((max(n0) + 1) / (max(n1) + 1)) AS b FROM m
        UNION ALL
        SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
        FROM (SELECT step, a, b, avg(f * (t - p)) AS ga, avg(t - p) AS gb, avg(f * f * p * (1 - p)) AS haa,
                     avg(f * p * (1 - p)) AS hab, avg(p * (1 - p)) AS hbb
              FROM (SELECT step, a, b, f, t, 1 / (1 + exp(a * f + b)) AS p FROM m CROSS JOIN s WHERE step < {steps})
              GROUP BY step, a, b))
      SELECT a, b FROM s WHERE step = {steps}"""
