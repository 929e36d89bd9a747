"""The library's entry points, over DataFrames, without the command line.

Files are rows (path, source); what parse_files() makes of them is what the
detectors compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestar.functions.paths import component_id, in_scope, is_ignored, language, matches_filters
from lodestar.operators.changes import api_changes, by_file, diff_entities, diff_files, diff_symbols, of_file, renamed_files
from lodestar.operators.clones import bundle_timeline, clone_drift, clone_groups, clone_members, component_compare, component_rollup, component_timeline, exact_clones, structural_clones
from lodestar.operators.linescan import file_metrics, text_metrics
from lodestar.plans.report import analyze, analyze_repo, clone_rows, entity_changes, render, save
from lodestar.sources.git import changed_files, files_at, report_bundles, tracked_files, working_tree
from lodestar.sources.git_source import register
from lodestar.sources.parse import entities, fingerprints, parse_files, symbols
from lodestar.streaming.timeline import follow, saved_components, timeline

__all__ = [
    "analyze", "analyze_repo", "api_changes", "build_report", "bundle_timeline", "build_report_with_context", "build_report_with_renames", "by_file", "changed_files", "clone_drift", "clone_groups", "clone_members", "clone_rows", "component_compare", "component_id",
    "component_rollup", "component_timeline", "detect_clone_drifts", "detect_exact_clone_groups", "detect_symbol_changes", "detect_symbol_changes_with_renames", "diff_entities", "diff_files", "diff_symbols", "entities", "entity_changes", "exact_clones",
    "file_metrics", "files_at", "fingerprints", "follow", "in_scope", "is_ignored", "language", "matches_filters", "of_file", "parse_files", "register", "render", "renamed_files", "report_bundles", "save", "saved_components", "structural_clones", "symbols", "text_metrics", "timeline", "tracked_files", "working_tree",
]


def build_report(base_files: DataFrame, head_files: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report without renames."""
    none = base_files.sparkSession.createDataFrame([], "from_path string, to_path string")
    return analyze(base_files, head_files, none)


def build_report_with_renames(base_files: DataFrame, head_files: DataFrame, renames: DataFrame) -> dict[str, DataFrame]:
    return analyze(base_files, head_files, renames)


def build_report_with_context(base_ref: str, head_ref: str, base_files: DataFrame, head_files: DataFrame, renames: DataFrame) -> dict:
    """As build_report_with_renames(), with the names of the revisions."""
    return {"base_ref": base_ref, "head_ref": head_ref, "tables": analyze(base_files, head_files, renames)}


def detect_symbol_changes(base_symbols: DataFrame, head_symbols: DataFrame) -> DataFrame:
    return diff_symbols(base_symbols, head_symbols)


def detect_symbol_changes_with_renames(base_symbols: DataFrame, head_symbols: DataFrame, renames: DataFrame) -> DataFrame:
    return diff_symbols(base_symbols, head_symbols, renames)


def detect_exact_clone_groups(files: DataFrame) -> DataFrame:
    """Groups of files (path, lexical_hash) with the same tokens."""
    return clone_groups(files, "lexical_hash")


def detect_clone_drifts(base: DataFrame, head: DataFrame) -> DataFrame:
    return clone_drift(base, head)
