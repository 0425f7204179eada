"""Column roles and the fixed vocabulary of A/E results."""

# ---- Fixed values: results must carry exactly these names, labels and bounds. ----

MEASURES = ("MAC", "MOC", "MEC", "MAF", "MEF")
COMMON_DIMENSIONS = ("Gender", "Smoker", "Risk_Class", "Product_Group", "Study_Year")

NEVER_GROUPED = ("Policy_Number", "MAC", "MOC", "MEC", "MAF", "MEF", "COLA")
RAW_NUMERICS = ("Face_Amount", "Issue_Age", "Age", "Duration")

SUMS = ("Sum_MAC", "Sum_MOC", "Sum_MEC", "Sum_MAF", "Sum_MEF")
RATIOS = ("AE_Ratio_Count", "AE_Ratio_Amount")
INTERVALS = (
    "AE_Count_CI_Lower",
    "AE_Count_CI_Upper",
    "AE_Amount_CI_Lower",
    "AE_Amount_CI_Upper",
)
SUMMARY_COLUMNS = ("Dimensions", *SUMS, *RATIOS, *INTERVALS)
SORT_COLUMNS = (*RATIOS, *SUMS)

MEASURE_CHOICES = ("count", "amount", "both")
DEFAULT_TOP_N = 20
PACKET_ROWS = 20

LABEL_SEPARATOR = " | "
NULL_KEY_TEXT = "nan"

MISSING_LABEL = "Missing"
OUT_OF_RANGE_LABEL = "Out of Range"
OTHER_LABEL = "Other"
DEFAULT_AGE_BAND = "Issue_Age_Band"
DEFAULT_AGE_BANDS = 4
BAND_STRATEGIES = ("equal-width", "quantile", "custom")

PACKET_SCHEMA_VERSION = "ai_ae_packet.v1"

# ---- End of fixed values. ----

ALWAYS_NUMERICAL = (*MEASURES, "Face_Amount", "Issue_Age", "Age")
CATEGORICAL_LIMIT = 20


def default_sort(measure: str) -> str:
    """Ratio that orders a summary when the caller names no column."""
    if measure not in MEASURE_CHOICES:
        raise ValueError(f"Unknown measure {measure!r}; choose one of {MEASURE_CHOICES}.")
    return RATIOS[0] if measure == "count" else RATIOS[1]


def check_sort(column: str) -> str:
    if column not in SORT_COLUMNS:
        raise ValueError(f"Cannot sort by {column!r}; choose one of {SORT_COLUMNS}.")
    return column


def row_limit(n: int, most: int | None = None) -> int:
    """A requested number of rows; refused below 1 or above what the result may hold."""
    if n < 1:
        raise ValueError(f"At least one row must be asked for, not {n}.")
    if most is not None and n > most:
        raise ValueError(f"At most {most} rows may be asked for, not {n}.")
    return int(n)
