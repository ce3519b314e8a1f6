"""The reference's own input shape: a raw sheet of strings with NA tokens,
22 structured columns (names with '-'), two dropped columns, two text columns
and a Y/N outcome, through read -> clean -> audit -> cohort report."""

import numpy as np
from pyspark.sql import functions as F

from cohortkit.operators import clean
from cohortkit.plans.retrain import describe_cohort
from cohortkit.sources import read_sheet
from cohortkit.spec import SEPSIS_SHEET, SHEET_STRUCTURED_COLUMNS

TOKENS = ["", "NA", "N/A", "na", "n/a", "None", " "]


def _sheet(tmp_path, n=240, seed=3):
    rng = np.random.default_rng(seed)
    cols = list(SHEET_STRUCTURED_COLUMNS) + ["PCT", "Hs-CRP", "diagnosis", "chief", "isSepsis"]
    lines = [",".join(cols)]
    for i in range(n):
        row = []
        for c in SHEET_STRUCTURED_COLUMNS:
            if rng.random() < 0.1:
                row.append(TOKENS[i % len(TOKENS)])
            elif c == "SEX":
                row.append(str(int(rng.integers(0, 2))))
            elif c == "BT":
                row.append(f"{rng.normal(37, 4):.1f}")  # some outside 30..45
            elif c == "WBC":
                row.append("0" if i % 17 == 0 else f"{rng.gamma(2, 5):.2f}")  # zero is invalid
            else:
                row.append(f"{rng.normal(100, 30):.2f}")
        row += ["1.0", "2.0", "" if i % 9 == 0 else f"dx {i % 5}", f"fever {i % 7}", "Y" if i % 5 == 0 else "N"]
        lines.append(",".join(row))
    p = tmp_path / "sheet.csv"
    p.write_text("\n".join(lines) + "\n")
    return str(p), cols


def test_sheet_to_report(spark, tmp_path):
    path, cols = _sheet(tmp_path)
    raw = read_sheet(spark, path, columns=cols)
    cleaned = clean.clean_cohort(raw, SEPSIS_SHEET)
    assert "PCT" not in cleaned.columns and "Hs-CRP" not in cleaned.columns
    assert dict(cleaned.dtypes)["T-Bil"] == "double" and dict(cleaned.dtypes)["chief"] == "string"
    assert dict(cleaned.dtypes)["SEX"] == "double"  # every non-text column is coerced, as the reference does
    # audit: missing before + removed = missing after, per row and in total
    coerced = clean.coerce_numeric(clean.drop_columns_if_present(raw, SEPSIS_SHEET.drop),
                                   list(SEPSIS_SHEET.numeric) + list(SEPSIS_SHEET.categorical))
    audit = clean.cleaning_audit(coerced, SEPSIS_SHEET).collect()
    assert len(audit) == 17 and all(r.n_missing + r.n_removed == r.n_missing_after for r in audit)
    removed = {r.variable: r.n_removed for r in audit}
    assert removed["BT"] > 0 and removed["WBC"] > 0
    rep = describe_cohort(cleaned, SEPSIS_SHEET, str(tmp_path / "out"))
    summary = rep["summary"].collect()
    assert [r.variable for r in summary] == SEPSIS_SHEET.variables
    screen = {r.variable: r.test_type for r in rep["screen"].collect()}
    assert screen["SEX"] in ("chi-square", "fisher-exact") and screen["AGE"] == "t-test"
    info = rep["basic_info"].first()
    assert info.total_samples == 240 and info.n_case == 48 and list(info.labels) == ["N", "Y"]
    assert rep["overall_stats"].filter(F.col("variable") == "T-Bil").count() == 1
    sex = [r for r in summary if r.variable == "SEX"][0]
    assert sex.total_mean_sd != "no data"
    assert (tmp_path / "out" / "summary").exists()
