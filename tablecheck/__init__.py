"""Data-quality contracts and profiles for tables, as lazy Spark DataFrames."""

from tablecheck.operators.bitmaps import distinct_counts
from tablecheck.operators.duplicates import duplicate_rows
from tablecheck.operators.frequency import top_values
from tablecheck.operators.quantiles import order_statistics, quartiles
from tablecheck.operators.rules import (
    CountCheck,
    Param,
    RowCheck,
    Rule,
    RuleError,
    SurplusCheck,
    TableCheck,
    catalogue,
    get_rule,
    param_errors,
    register_rule,
    rule_ids,
    unregister_rule,
)
from tablecheck.operators.sampling import (
    ProfilingLoad,
    hash_sample,
    profiling_load,
    uniform_sample,
)
from tablecheck.operators.schema import SchemaDriftError, fingerprint, schema_diff, snapshot
from tablecheck.plans.contract import (
    ContractNotApprovedError,
    blocking_failures,
    contract_rules,
    run_contract,
)
from tablecheck.plans.profile import (
    ProfileReport,
    profile,
    profile_columns,
    profile_table,
    redact,
)
from tablecheck.plans.report import report_rows, summary
from tablecheck.plans.score import expected_issues, issue_status, score
from tablecheck.plans.suggest import draft_contract, suggest_rules
from tablecheck.plans.violations import violating_rows
from tablecheck.sources.csv_ranges import load_csv_ranges
from tablecheck.sources.files import load_csv, load_parquet, load_table
from tablecheck.sources.footers import estimate_file_rows, footer_statistics, load_file_profiling
from tablecheck.sources.jdbc import estimate_row_count, load_jdbc, load_profiling
from tablecheck.sources.tables import estimate_table_rows, load_table_profiling

__all__ = [name for name in dir() if not name.startswith("_")]
