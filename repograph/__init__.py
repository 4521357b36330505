"""repograph: structural maps of many source repositories, computed with Spark.

Entry points: ``Facts`` (extraction plan over ``files``/``commits`` tables),
``run_gate`` (narrative verification), ``read_checkouts`` / ``commit_log_rows`` /
``read_narrative`` (sources), ``facts_records`` / ``write_facts`` (sink).
"""
from repograph.plans.extract import Facts
from repograph.plans.gate import run_gate
from repograph.sources.files import read_checkouts, read_files_table
from repograph.sources.gitlog import commit_log_rows
from repograph.sources.narrative import read_narrative
from repograph.sources.sinks import facts_records, write_facts

__all__ = ["Facts", "run_gate", "read_checkouts", "read_files_table", "commit_log_rows",
           "read_narrative", "facts_records", "write_facts"]
