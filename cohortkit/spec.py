"""Cohort specification: which columns are measurements, text, label, and the
plausible-range rules used by the cleaning operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CohortSpec:
    """Describes one cohort table.

    label          binary outcome column (string values)
    positive       label value of the case group (reference: ``'Y'``)
    negative       label value of the control group (reference: ``'N'``)
    numeric        measurement columns (coerced to double)
    categorical    columns always tested as categorical (reference: ``SEX``)
    text           free-text columns, never coerced
    ranges         column -> (min, max), inclusive plausible range
    zero_invalid   columns where 0 is not a plausible value
    drop           columns removed on load when present
    id_col         stable row key (Spark has no row order)
    passthrough    columns kept as they are on load (keys, string-valued
                   categoricals); every other non-text column is coerced to
                   double, as the reference loader does
    """

    label: str
    positive: str = "Y"
    negative: str = "N"
    numeric: tuple = ()
    categorical: tuple = ()
    text: tuple = ()
    ranges: dict = field(default_factory=dict)
    zero_invalid: tuple = ()
    drop: tuple = ()
    id_col: str | None = "row_id"
    passthrough: tuple = ()

    @property
    def variables(self) -> list[str]:
        """Structured variables in declared order (numeric first, then categorical)."""
        out = list(self.numeric)
        out += [c for c in self.categorical if c not in out]
        return out

    @property
    def groups(self) -> tuple[str, str]:
        return self.positive, self.negative


# ---------------------------------------------------------------------------
# Fixed values of the reference study (must stay equal for parity).
# Missing-value tokens added to the default NA set on read.
SHEET_NA_TOKENS = ("", " ", "N/A", "NA", "na", "n/a", "None")
# pandas' default NA strings, which the sheet reader applies as well.
DEFAULT_NA_TOKENS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                     "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                     "n/a", "nan", "null", "")
# Columns dropped on load.
SHEET_DROP_COLUMNS = ("PCT", "Hs-CRP")
# Text columns and outcome.
SHEET_TEXT_COLUMNS = ("diagnosis", "chief")
SHEET_LABEL = "isSepsis"
# Inclusive plausible ranges.
SHEET_RANGES = {
    "BT": (30, 45),
    "MAP": (10, 300),
    "SBP": (40, 300),
    "DBP": (20, 200),
    "BMI": (10, 100),
    "Height": (50, 250),
    "Weight": (10, 300),
    "WBC": (0.1, 300),
    "PLT": (1, 2000),
    "Crea": (0.1, 100),
    "T-Bil": (0.1, 50),
    "Lymph": (0.1, 99),
    "Segment": (0.1, 99),
    "PT": (5, 200),
    "BOXY": (0, 1000),
    "Pluse": (30, 250),
    "LOS": (0, 10000),
}
# Columns where a zero is treated as invalid.
SHEET_ZERO_INVALID = ("Weight", "WBC", "PLT", "Crea", "T-Bil", "Lymph",
                      "Segment", "PT", "BMI", "SBP", "DBP", "MAP")
# Structured columns in model order.
SHEET_STRUCTURED_COLUMNS = ("AGE", "SEX", "Height", "Weight", "BMI", "LOS", "BT", "Pluse",
                            "SBP", "DBP", "RR", "MAP", "BOXY", "WBC", "Crea", "PLT", "T-Bil",
                            "Lymph", "Segment", "PT", "Urine_Volumn", "GCS")
# Always-categorical variables.
SHEET_CATEGORICAL = ("SEX",)
# Variables with at most this many distinct values (and at least two) are categorical.
CATEGORICAL_MAX_DISTINCT = 10
# ---------------------------------------------------------------------------

SEPSIS_SHEET = CohortSpec(
    label=SHEET_LABEL, positive="Y", negative="N",
    numeric=tuple(c for c in SHEET_STRUCTURED_COLUMNS if c not in SHEET_CATEGORICAL),
    categorical=SHEET_CATEGORICAL, text=SHEET_TEXT_COLUMNS,
    ranges=SHEET_RANGES, zero_invalid=SHEET_ZERO_INVALID, drop=SHEET_DROP_COLUMNS,
)

# The driver's lineitem table as a cohort: shipped lines (F) are the cases.
LINEITEM_COHORT = CohortSpec(
    label="l_linestatus", positive="F", negative="O",
    numeric=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    categorical=("l_returnflag",),
    ranges={"l_quantity": (5, 45), "l_extendedprice": (1000, 90000), "l_discount": (0.01, 0.09)},
    zero_invalid=("l_tax",),
    drop=("l_comment", "l_shipdate"),
    id_col=None,
    passthrough=("l_orderkey", "l_linenumber", "l_returnflag"),
)
