"""The whole scan: corpus and git facts in, scored findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sievebase.operators import (
    api_surface, dataflow, dependencies, forensics, hygiene, line_rules, performance, quality, scoring,
)
from sievebase.plans.analyzers import (
    Branch, GitFacts, GitHistory, IncompleteScan, Inputs, branch_of, run_branches, whole_findings,
)
from sievebase.session import materialize
from sievebase.sources.corpus import kept_files

__all__ = ["GitFacts", "GitHistory", "IncompleteScan", "materialize", "merge_analyzers", "run_scan", "scan_status"]

FILE_LOCAL = (
    line_rules.rule_findings, *quality.FILE_LOCAL, *performance.FILE_LOCAL, *hygiene.FILE_LOCAL,
    api_surface.endpoint_findings, forensics.entropy_findings,
)


def branches(git: GitFacts | None) -> list[Branch]:
    """All analyzers. The text is read for the file-local ones together, for duplicate blocks, imports and facts of flows,
    and once to set the files aside that are read by name; checks of whole repositories read paths only."""
    whole = {
        "intra_file_flows": lambda x: dataflow.file_flows(x.facts),
        "cross_file_flows": lambda x: dataflow.call_flows(x.facts, x.calls),
        "property_taint": lambda x: dataflow.property_flows(x.facts),
        "duplicate_blocks": lambda x: quality.duplicate_blocks(x.files),
        "circular_imports": lambda x: quality.circular_imports(x.files, x.imports),
        "missing_lockfile": lambda x: dependencies.missing_lockfile(x.files),
        **{op.__name__: lambda x, op=op: op(x.named) for op in dependencies.MANIFEST_OPS},
        "repo_presence_checks": lambda x: hygiene.repo_presence_checks(x.files),
        "env_files": lambda x: hygiene.env_files(x.named),
        "deep_paths": lambda x: hygiene.deep_paths(x.files),
        "ineffective_gitignore": lambda x: hygiene.ineffective_gitignore(x.named, x.files),
        "committed_artifacts": lambda x: hygiene.committed_artifacts(x.files),
        "oversize_and_binary": lambda x: hygiene.oversize_and_binary(x.paths),
        "git_config_exposure": lambda x: forensics.git_config_exposure(x.special),
        "hook_forensics": lambda x: forensics.hook_forensics(x.special),
        "submodule_risks": lambda x: forensics.submodule_risks(x.special),
    }
    if git is not None:
        whole |= {
            "dangling_blob_secrets": lambda x: forensics.dangling_blob_secrets(x.git.objects),
            "unreachable_sensitive_commits": lambda x: forensics.unreachable_sensitive_commits(x.git.objects),
            "large_pack_objects": lambda x: forensics.large_pack_objects(x.git.objects),
            "reflog_sensitive_messages": lambda x: forensics.reflog_sensitive_messages(x.git.reflog),
            "stash_secrets": lambda x: forensics.stash_secrets(x.git.stashes),
        }
        if git.history is None:
            whole["object_secret_scan"] = lambda x: forensics.object_secret_scan(x.git.objects)
        else:
            whole["history_secret_scan"] = lambda x: forensics.history_secret_scan(*x.git.history, materialize)
    return [Branch(local=tuple(map(branch_of, FILE_LOCAL))), *[Branch(whole=one) for one in whole.items()]]


def _analyzed(corpus: DataFrame, git: GitFacts | None, calls: str) -> tuple[DataFrame, DataFrame]:
    return run_branches(branches(git), Inputs(corpus, git, calls))


def merge_analyzers(corpus: DataFrame, git: GitFacts | None = None, calls: str = "identifier") -> DataFrame:
    """Findings of all analyzers, stored. ``calls`` is how calls between files are found (``dataflow.cross_file_flows``).

    Raises ``IncompleteScan`` if an analyzer failed: findings without its own would look like a clean repository.
    """
    return whole_findings(branches(git), Inputs(corpus, git, calls))


def scan_status(corpus: DataFrame, git: GitFacts | None = None, calls: str = "identifier") -> DataFrame:
    """What became of each analyzer: its number of findings, and a row with the error per repository where it failed."""
    return _analyzed(corpus, git, calls)[1]


def run_scan(corpus: DataFrame, git: GitFacts | None = None, blame: DataFrame | None = None, calls: str = "identifier") -> DataFrame:
    """Merged findings, scored, attributed and correlated; written once, as the marts read them several times.

    No scan is stored, and no mart made, if an analyzer failed (``IncompleteScan``).
    """
    findings = merge_analyzers(corpus, git, calls)
    scored = scoring.confidence_score(findings, kept_files(corpus))
    if blame is not None:
        scored = scoring.blame_attribution(scored, blame)
    return materialize(scoring.attack_chains(materialize(scored, "scored")), "scan")
