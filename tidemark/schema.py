"""Table schemas (as DDL) and value domains of the lakehouse layers."""

from __future__ import annotations

FREQUENCIES = ("D", "W", "M", "Q", "Y")
ACCUMULATIONS = ("none", "ytd", "since_start")
NATURES = ("stock", "flow", "rate", "price", "unclassified")
METHODS = ("last", "sum", "mean")


#: One long fact table: ``date`` equals ``period_end``, ``dims`` is a JSON object with sorted keys.
OBSERVATION = ("series_id string, source string, date date, period_start date, period_end date, value double, freq string, unit string, dims string, source_file string")
SERIES = (
    "series_id string, source string, code string, name string, category string, description string, unit string, freq string, tags array<string>, accumulation string, is_cumulative boolean, "
    "nature string, nature_reviewed boolean, alignment_override string"
)
ALIGNED = (
    "series_id string, source string, date date, period_start date, period_end date, value double, unit string, dims string, source_freq string, aligned_freq string, alignment_method string, is_imputed boolean"
)
CATALOG = ("table_name string, layer string, source_path string, description string")
LINEAGE = ("gold_table string, gold_column string, source_series string, source_filter string, transformation string, unit string")
EMBEDDED = ("series_id string, name string, category string, unit string, freq string, semantic_text string, embedding array<float>")


class ContractError(ValueError):
    """Data or a request breaks a contract; ``code`` names which one."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
