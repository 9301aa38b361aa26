"""Explicit schemas of the stored tables; nothing in the engine infers a schema."""

from __future__ import annotations

EVIDENCE = "struct<path: string, line: int, excerpt: string, normalized_path: string, path_exists: boolean, path_scope: string>"
ACTOR = "struct<kind: string, name: string, runtime: string, model: string, key: string, label: string>"
WORKTREE = (
    "struct<available: boolean, is_git_repo: boolean, branch: string, head_sha: string, dirty_files: int, staged_files: int, "
    "untracked_files: int, ahead: int, behind: int, dirty_paths: array<string>>"
)

TABLES = {
    "workspaces": "workspace_id string, name string, root_path string, latest_scan_at timestamp, created_at timestamp, updated_at timestamp",
    "issues": (
        "workspace_id string, bug_id string, title string, severity string, issue_status string, source string, source_doc string, doc_status string, "
        f"code_status string, summary string, impact string, evidence array<{EVIDENCE}>, verification_evidence array<{EVIDENCE}>, "
        "tests_added array<string>, tests_passed array<string>, drift_flags array<string>, labels array<string>, notes string, verified_at string, "
        "verified_by string, needs_followup boolean, review_ready_count int, review_ready_runs array<string>, fingerprint string, updated_at timestamp"
    ),
    "signals": (
        "workspace_id string, signal_id string, kind string, severity string, title string, summary string, file_path string, line int, "
        f"evidence array<{EVIDENCE}>, tags array<string>, fingerprint string, promoted_bug_id string, created_at timestamp"
    ),
    "activity": (
        "activity_id string, workspace_id string, entity_type string, entity_id string, action string, summary string, "
        f"actor {ACTOR}, issue_id string, run_id string, details string, created_at timestamp"
    ),
    "runs": (
        "run_id string, workspace_id string, issue_id string, runtime string, model string, status string, title string, prompt string, "
        "command array<string>, command_preview string, log_path string, output_path string, created_at timestamp, started_at timestamp, "
        f"completed_at timestamp, exit_code int, pid int, error string, eval_scenario_id string, eval_replay_batch_id string, worktree {WORKTREE}, "
        "guidance_paths array<string>, summary string"
    ),
    "run_metrics": (
        "run_id string, workspace_id string, input_tokens bigint, output_tokens bigint, estimated_cost double, duration_ms bigint, model string, "
        "runtime string, calculated_at timestamp"
    ),
    "fixes": (
        f"fix_id string, workspace_id string, issue_id string, status string, summary string, how string, actor {ACTOR}, run_id string, "
        f"session_id string, changed_files array<string>, tests_run array<string>, worktree {WORKTREE}, notes string, updated_at timestamp, recorded_at timestamp"
    ),
    "run_reviews": f"review_id string, workspace_id string, run_id string, issue_id string, disposition string, actor {ACTOR}, notes string, created_at timestamp",
    "findings": (
        "finding_id string, workspace_id string, issue_id string, scanner string, source string, severity string, status string, title string, "
        "summary string, rule_id string, location_path string, location_line int, cwe_ids array<string>, cve_ids array<string>, "
        "references array<string>, evidence array<string>, threat_model_ids array<string>, raw_payload string, created_at timestamp, updated_at timestamp"
    ),
    "coverage_results": (
        "result_id string, workspace_id string, run_id string, issue_id string, line_coverage double, branch_coverage double, function_coverage double, "
        "lines_covered int, lines_total int, branches_covered int, branches_total int, files_covered int, files_total int, "
        "uncovered_files array<string>, format string, raw_report_path string, created_at timestamp"
    ),
    "changes": "path string, status string, scope string, previous_path string, staged boolean, unstaged boolean",
    "saved_views": (
        "view_id string, workspace_id string, name string, query string, severities array<string>, statuses array<string>, sources array<string>, "
        "labels array<string>, drift_only boolean, needs_followup boolean, review_ready_only boolean, created_at timestamp, updated_at timestamp"
    ),
    "symbols": "workspace_id string, path string, symbol string, kind string, line_start int, line_end int, scope string, language string",
}
