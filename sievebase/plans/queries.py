"""Registered queries: each operator over the whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebase.functions import findings as fi
from sievebase.functions.text import explode_lines
from sievebase.functions.versions import compare
from sievebase.operators import advisories, api_surface, dataflow, dependencies, forensics, history, hygiene, line_history, line_rules, performance
from sievebase.operators import quality, quota, scoring, sliced
from sievebase.plans import scan
from sievebase.session import scratch_dir
from sievebase.sources import corpus, slices, stored_table, tables
from sievebase.streaming import runner, scan_events

Query = Callable[[SparkSession, str], DataFrame]


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.kept_files(tables.code_corpus(spark, sf))


def on_files(op: Callable[[DataFrame], DataFrame], *cols: str) -> Query:
    """Run a file operator over the kept files and project."""
    return lambda spark, sf: op(kept(spark, sf)).select(*(cols or fi.CORE))


def on_security(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: op(line_rules.security_rule_scan(kept(spark, sf)))


def corpus_queries() -> dict[str, Query]:
    listing = tables.file_listing
    return {
        "corpus_files": lambda s, d: corpus.describe_files(listing(s, d)),
        "corpus_filter": lambda s, d: corpus.with_skip_reason(listing(s, d)).select(
            "repo", "file_path", "size_bytes", "skip_reason"
        ),
        "language_classify": lambda s, d: corpus.classify_languages(listing(s, d)),
        "corpus_lines": on_files(explode_lines, "repo", "file_path", "line_number", "line"),
        "corpus_stats": lambda s, d: corpus.corpus_stats(listing(s, d)),
        "repo_url_normalize": lambda s, d: corpus.normalize_repo_urls(tables.repo_urls(s, d)),
        "security_rule_scan": on_files(line_rules.security_rule_scan, *fi.CORE, "suggestion"),
        "rule_hit_rollup": on_security(line_rules.rule_hit_rollup),
        "secret_family_rollup": on_security(line_rules.secret_family_rollup),
        "batch_fix_bundle": on_security(line_rules.batch_fix_bundle),
    }


def local(*analyzers) -> Query:
    """File-local analyzers over the kept files, one pass."""
    return on_files(lambda files: fi.emit(files, *analyzers))


def quality_queries() -> dict[str, Query]:
    out = {a.__name__: local(a) for a in quality.FILE_LOCAL}
    out["method_metrics"] = on_files(
        quality.method_metrics, "repo", "file_path", "name", "line_number", "length", "complexity"
    )
    out["duplicate_blocks"] = on_files(quality.duplicate_blocks, *fi.CORE, "file_count", "description")
    out["circular_imports"] = on_files(
        lambda f: quality.circular_imports(f, scan.materialize(quality.imports(f), "imports")), *fi.CORE, "description"
    )
    return out


SLICE_LINES = 40  # short, so that most files of the tables are cut


def sliced_queries() -> dict[str, Query]:
    """Walks over files that are cut into slices; the rows are those of the whole files."""
    def on_slices(op: Callable[[DataFrame], DataFrame], *cols: str) -> Query:
        return lambda s, d: op(scan.materialize(slices.slices_of(kept(s, d), SLICE_LINES), "slices")).select(*cols)

    return {
        "method_metrics_sliced": on_slices(
            lambda x: sliced.method_metrics(x, scan.materialize), "repo", "file_path", "name", "line_number", "length", "complexity"
        ),
        "loop_context_sliced": on_slices(
            lambda x: sliced.loop_context(x, scan.materialize), "repo", "file_path", "line_number", "in_loop", "in_loop_after"
        ),
        "nesting_depth_sliced": on_slices(sliced.nesting_depth, *fi.CORE),
    }


def performance_queries() -> dict[str, Query]:
    out = {a.__name__: local(a) for a in (*performance.LOOP_CHECKS, *performance.LINE_CHECKS)}
    out["large_allocation"] = on_files(
        lambda f: fi.emit(f, performance.large_allocation), *fi.CORE, "description"
    )
    out["loop_context"] = on_files(
        performance.loop_context, "repo", "file_path", "line_number", "in_loop", "in_loop_after"
    )
    return out


def version_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Version texts derived from the line items, with their comparison."""
    li, flag = tables.read(spark, sf, "lineitem"), F.col("l_returnflag")

    def text(*parts) -> F.Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    a = F.concat(
        text(F.col("l_linenumber"), ".", F.col("l_partkey") % 12, ".", F.col("l_suppkey") % 4),
        F.when(flag == "R", "-rc.1").otherwise(""),
    )
    b = F.concat(
        text(F.col("l_linenumber") % 5, ".", F.col("l_quantity").cast("int") % 12),
        F.when(flag == "A", ".0").when(flag == "N", ".x.2").otherwise(""),
    )
    return li.select(a.alias("a"), b.alias("b")).distinct().withColumn("cmp", compare(F.col("a"), F.col("b")))


def dependency_queries() -> dict[str, Query]:
    out = {op.__name__: on_files(op) for op in dependencies.FILE_OPS}
    out["duplicate_json_keys"] = on_files(dependencies.duplicate_json_keys, *fi.CORE, "description")
    out["advisory_staleness"] = lambda s, d: dependencies.advisory_staleness(kept(s, d), "2025-06-01")
    out["semver_compare"] = version_pairs
    out["vulnerable_packages"] = lambda s, d: advisories.vulnerable_packages(kept(s, d), tables.advisories(s, d)).select(*fi.CORE, "advisory_id", "ecosystem", "description")
    return out


def hygiene_queries() -> dict[str, Query]:
    out = {a.__name__: local(a) for a in hygiene.FILE_LOCAL}
    out.update({op.__name__: on_files(op) for op in hygiene.FILE_OPS})
    out["oversize_and_binary"] = lambda s, d: hygiene.oversize_and_binary(tables.file_listing(s, d)).select(*fi.CORE)
    endpoint = ["repo", "file_path", "line_number", "framework", "method", "route"]
    out["api_endpoints"] = on_files(api_surface.api_endpoints, *endpoint)
    out["endpoint_protection"] = on_files(
        api_surface.endpoint_protection, *endpoint, "has_auth", "has_validation", "has_rate_limit"
    )
    for op in (api_surface.unprotected_endpoints, api_surface.unvalidated_endpoints, api_surface.unlimited_mutations):
        out[op.__name__] = on_files(op)
    out["api_surface_summary"] = lambda s, d: api_surface.api_surface_summary(
        fi.emit(kept(s, d), api_surface.endpoint_findings)
    )
    return out


def dataflow_queries() -> dict[str, Query]:
    hit = ["repo", "file_path", "line_number"]
    flow = [*fi.CORE, "data_flow_trace", "sink_line"]
    return {
        "taint_sources": on_files(dataflow.taint_sources, *hit, "rule", "expr", "label", "var"),
        "taint_sinks": on_files(dataflow.taint_sinks, *hit, "rule", "kind", "weakness"),
        "sanitizer_lines": on_files(dataflow.sanitizer_lines, *hit),
        "function_index": on_files(dataflow.function_index, *hit, "name"),
        "intra_file_flows": on_files(dataflow.intra_file_flows, *flow, "via_call"),
        "flows_via_local_call": on_files(dataflow.flows_via_local_call, *flow, "via_call"),
        "cross_file_flows": on_files(dataflow.cross_file_flows, *flow, "target_file", "function_name"),
        "cross_file_flows_substring": on_files(
            lambda files: dataflow.cross_file_flows(files, calls="substring"), *flow, "target_file", "function_name"
        ),
        "property_taint": on_files(dataflow.property_taint, *flow, "property"),
    }


def on_table(op: Callable[[DataFrame], DataFrame], table: Query, *extra: str) -> Query:
    return lambda spark, sf: op(table(spark, sf)).select(*fi.CORE, *extra)


def forensics_queries() -> dict[str, Query]:
    objects, corpus_ = tables.git_objects, tables.code_corpus
    return {
        "dangling_blob_secrets": on_table(forensics.dangling_blob_secrets, objects, "commit_hash"),
        "unreachable_sensitive_commits": on_table(forensics.unreachable_sensitive_commits, objects),
        "reflog_sensitive_messages": on_table(
            forensics.reflog_sensitive_messages, tables.reflog, "commit_hash", "commit_date"
        ),
        "stash_secrets": on_table(forensics.stash_secrets, tables.stashes, "commit_hash"),
        "git_config_exposure": on_table(forensics.git_config_exposure, corpus_, "description"),
        "hook_forensics": on_table(forensics.hook_forensics, corpus_),
        "submodule_risks": on_table(forensics.submodule_risks, corpus_),
        "high_entropy_tokens": on_files(forensics.high_entropy_tokens, *fi.CORE, "token", "bits"),
        "object_secret_scan": on_table(forensics.object_secret_scan, objects, "commit_hash", "uses"),
        "history_secret_scan": lambda s, d: forensics.history_secret_scan(*git_history(s, d), scan.materialize).select(*fi.CORE, "commit_hash", "uses"),
        "added_lines": added_lines,
        "commit_dates": lambda s, d: line_history.commit_dates(tables.git_commits(s, d), scan.materialize),
        "large_pack_objects": on_table(forensics.large_pack_objects, objects, "description"),
    }


def git_history(spark: SparkSession, sf: str) -> scan.GitHistory:
    """Commits, changes and blobs; the versions behind the last two are stored, as both are read more than once."""
    versions = scan.materialize(tables.git_versions(spark, sf), "versions")
    return scan.GitHistory(tables.git_commits(spark, sf), tables.git_changes(versions), tables.git_blobs(versions))


def added_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All lines that commits added, with a hash of each."""
    history = git_history(spark, sf)
    added = line_history.added_lines(*history).select("repo", "commit", "file_path", F.col("new_blob").alias("blob"), F.explode("added").alias("n"))
    lines = history.blobs.dropDuplicates(["repo", "blob"]).select("repo", "blob", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    return added.join(lines, ["repo", "blob", "n"]).select("repo", "commit", "file_path", (F.col("n") + 1).alias("line_number"), F.md5("line").alias("line_md5"))


def git_facts(spark: SparkSession, sf: str) -> scan.GitFacts:
    return scan.GitFacts(tables.git_objects(spark, sf), tables.reflog(spark, sf), tables.stashes(spark, sf), git_history(spark, sf))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return scan.merge_analyzers(tables.code_corpus(spark, sf), git_facts(spark, sf))


_scans: dict[tuple, DataFrame] = {}


def full_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All analyzers over all files and git facts, then confidence, blame and chains.

    The scan is stored once per session and input; all marts read the stored one.
    """
    inputs = tuple(sorted(f for t in ("documents", "events") for f in tables.read(spark, sf, t).inputFiles()))
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""), inputs)
    if key not in _scans:
        _scans[key] = scan.run_scan(tables.code_corpus(spark, sf), git_facts(spark, sf), tables.line_blame(spark, sf))
    return _scans[key]


def _confidence(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.confidence_score(merged(spark, sf), kept(spark, sf)).select(*fi.CORE)


def _with_double(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


def scoring_queries() -> dict[str, Query]:
    attribution = [*fi.CORE, "commit_hash", "author", "author_email", "commit_message", "commit_date", "introduced_by"]
    return {
        "merge_analyzers": lambda s, d: merged(s, d).select(*fi.CORE, "reachability_status"),
        "confidence_score": _confidence,
        "scan_status": lambda s, d: scan.scan_status(tables.code_corpus(s, d), git_facts(s, d)),
        "full_scan": lambda s, d: full_scan(s, d).select(*fi.CORE, "reachability_status", "commit_hash", "introduced_by"),
        "blame_attribution": lambda s, d: full_scan(s, d).select(*attribution),
        "attack_chains": lambda s, d: full_scan(s, d).select(*fi.CORE, "reachability_status"),
        "health_score": lambda s, d: scoring.health_score(full_scan(s, d)),
        "tech_debt": lambda s, d: _with_double(scoring.tech_debt(tables.issues(s, d), "scan_id"), "dollars"),
        "file_risk": lambda s, d: scoring.file_risk(full_scan(s, d)),
        "distinct_critical_titles": lambda s, d: scoring.distinct_critical_titles(full_scan(s, d)),
        "action_plan": lambda s, d: _with_double(scoring.action_plan(tables.issues(s, d), "scan_id"), "dollar_cost"),
        "confidence_bands": lambda s, d: scoring.confidence_bands(tables.issues(s, d)),
        "action_plan_files": lambda s, d: scoring.action_plan_files(
            tables.issues(s, d), scoring.action_plan(tables.issues(s, d), "scan_id"), "scan_id"
        ),
        "analysis_summary": lambda s, d: scoring.analysis_summary(full_scan(s, d), kept(s, d)),
    }


def stored_delete(s: SparkSession, d: str) -> DataFrame:
    """Scans of a stored table after the users of one plan were removed from it."""
    table = stored_table.StoredTable.create(tables.scans(s, d), scratch_dir(s, "scans"), "user_id")
    stored_table.delete_users([table], tables.users(s, d).filter(F.col("plan_type") == "TEAM"))
    return table.read()


def stored_upsert(s: SparkSession, d: str) -> DataFrame:
    """Users of a stored table after sign-ins were merged into it."""
    users = tables.users(s, d).select("user_id", "email", "plan_type", "last_login")
    table = stored_table.StoredTable.create(users, scratch_dir(s, "users"), "user_id")
    stored_table.upsert_users(table, tables.logins(s, d), "2025-06-01 00:00:00")
    return table.read()


def history_queries() -> dict[str, Query]:
    sc, iss, us = tables.scans, tables.issues, tables.users

    def on_scans(op, *args) -> Query:
        return lambda s, d: op(sc(s, d), *args)

    def on_issues(op, *args) -> Query:
        return lambda s, d: op(iss(s, d), *args)

    def both(op, *args) -> Query:
        return lambda s, d: op(sc(s, d), iss(s, d), *args)

    def pairs(s: SparkSession, d: str) -> DataFrame:
        return history.latest_two_scans(sc(s, d))

    def owned(s: SparkSession, d: str) -> DataFrame:
        owner = F.when(F.col("scan_id") % 37 == 0, None).when(F.col("scan_id") % 41 == 0, "").otherwise(
            F.col("user_id").cast("string")
        )
        return sc(s, d).withColumn("owner", owner)

    def jobs(s: SparkSession, d: str) -> DataFrame:
        price, key = F.col("o_totalprice"), F.col("o_orderkey")
        return tables.read(s, d, "orders").select(
            key.alias("scan_id"), F.floor(price * 7).alias("size_kb"), F.floor(price * (key % 3)).alias("duration_ms"),
            F.col("o_orderdate").alias("created_at"),
        )

    local_store = lambda s, d: sc(s, d).filter(F.col("scan_id") % 3 != 0)
    remote_store = lambda s, d: sc(s, d).withColumn("health_score", F.lit(1))
    return {
        "scan_state_json": on_issues(history.scan_state_json),
        "parsed_results": lambda s, d: history.parse_results(history.result_documents(sc(s, d), iss(s, d))),
        "delete_user_keys": lambda s, d: history.cascade_delete(tables.api_keys(s, d), us(s, d).filter(F.col("plan_type") == "TEAM")),
        "clear_user_history": on_scans(history.clear_history, 7),
        "delete_scan": on_scans(history.delete_scan, 33, 7),
        "findings_csv_export": on_issues(history.findings_csv_export),
        "user_export": on_scans(history.user_export),
        "recent_completed": lambda s, d: history.recent_completed(local_store(s, d), remote_store(s, d)),
        "scan_history": on_scans(history.scan_history),
        "repo_cards": both(history.repo_cards),
        "user_scan_stats": lambda s, d: _with_double(history.user_scan_stats(sc(s, d), iss(s, d)), "debt_dollars"),
        "admin_stats": lambda s, d: history.admin_stats(sc(s, d), iss(s, d), us(s, d), tables.api_keys(s, d)),
        "admin_users": lambda s, d: history.admin_users(us(s, d), sc(s, d), "Customer#0"),
        "admin_scans_page": both(history.admin_scans_page, "repo_1", "completed", 3, 50, "score", False),
        "activity_feed": lambda s, d: history.activity_feed(sc(s, d), us(s, d)),
        "notifications": on_scans(history.notifications, "1998-01-01 00:00:00", "2001-01-01 00:00:00"),
        "repo_search_sort": lambda s, d: history.repo_search_sort(
            history.repo_cards(sc(s, d), iss(s, d)), "repo_2", "Name", True
        ),
        "latest_two_scans": pairs,
        "scan_diff": lambda s, d: history.scan_diff(pairs(s, d), iss(s, d)),
        "scan_diff_summary": lambda s, d: history.scan_diff_summary(pairs(s, d), sc(s, d), iss(s, d)),
        "score_trend": on_scans(history.score_trend),
        "top_affected_files": on_issues(history.top_affected_files),
        "severity_category_matrix": on_issues(history.severity_category_matrix),
        "report_sections": on_issues(history.report_sections),
        "monthly_quota": lambda s, d: history.monthly_quota(sc(s, d), us(s, d)),
        "monthly_rejections": lambda s, d: history.monthly_rejections(sc(s, d), us(s, d)),
        "plan_quota": lambda s, d: quota.plan_quota(tables.scan_requests(s, d), tables.quota_users(s, d), scan.materialize),
        "quota_rejections": lambda s, d: quota.quota_rejections(tables.scan_requests(s, d), tables.quota_users(s, d), scan.materialize),
        "cascade_delete": lambda s, d: history.cascade_delete(sc(s, d), us(s, d).filter(F.col("plan_type") == "TEAM")),
        "user_upsert": lambda s, d: history.user_upsert(us(s, d), tables.logins(s, d), "2025-06-01 00:00:00"),
        "stored_cascade_delete": stored_delete,
        "stored_user_upsert": stored_upsert,
        "owner_filter": lambda s, d: history.owner_filter(owned(s, d), "7"),
        "api_key_listing": lambda s, d: history.api_key_listing(tables.api_keys(s, d)),
        "fix_progress": lambda s, d: history.fix_progress(iss(s, d), iss(s, d).filter(F.col("severity") == "Info")),
        "size_eta_labels": lambda s, d: history.size_eta_labels(jobs(s, d), "1998-08-02 12:00:30"),
        "team_members": lambda s, d: history.team_members(tables.teams(s, d), us(s, d)),
    }


def stream_queries() -> dict[str, Query]:
    """Streams drained to the end of their input; times are given in microseconds."""
    def events(s: SparkSession, d: str) -> DataFrame:
        return tables.scan_events(runner.read_table(s, d, "events"))

    def us(df: DataFrame, **cols: str) -> DataFrame:
        for new, old in cols.items():
            df = df.withColumn(new, F.unix_micros(old)).drop(old)
        return df

    def latest(s: SparkSession, d: str) -> DataFrame:
        changes = runner.drain_update(scan_events.latest_status(events(s, d)), "latest")
        return us(runner.latest_rows(changes, "scan_id"), ts_us="ts")

    def throttle(s: SparkSession, d: str) -> DataFrame:
        stream = tables.scan_events(runner.read_table(s, d, "events", max_bytes=1 << 30))
        # The table has no order of time: events wait as long as its whole span, so none is late in any cut into micro-batches.
        ts = F.col("ts").cast("timestamp")
        span = tables.scan_events(tables.read(s, d, "events")).agg(F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts)) + 1).first()[0] or 1
        rows = runner.drain_closed(stream, lambda e: scan_events.progress_throttle(e, 86400.0, f"{span} seconds"), "ts", "throttle")
        return us(rows, ts_us="ts").select("event_id", "scan_id", "status", "ts_us")

    def rule_scan(s: SparkSession, d: str) -> DataFrame:
        files = corpus.kept_files(tables.corpus_from(runner.read_table(s, d, "documents")))
        return runner.drain_append(line_rules.security_rule_scan(files), "rules").select(*fi.CORE)

    def windows(slide: str | None) -> Query:
        def run(s: SparkSession, d: str) -> DataFrame:
            stream = scan_events.status_windows(events(s, d), "1 day", slide)
            rows = runner.latest_rows(runner.drain_update(stream, "windows"), "window_start", "window_end", "status")
            return us(rows, window_start_us="window_start", window_end_us="window_end")

        return run

    def sessions(s: SparkSession, d: str) -> DataFrame:
        return us(runner.drain_append(scan_events.scan_sessions(events(s, d)), "sessions"), start_us="session_start", end_us="session_end")

    def intervals(s: SparkSession, d: str) -> DataFrame:
        start, end = scan_events.interval_bounds(F.col("ts"), F.col("value"))
        return tables.read(s, d, "events").select("event_id", F.col("user_id").alias("client"), start.alias("start_us"), end.alias("end_us"))

    return {
        "stream_latest_status": latest,
        "stream_progress_throttle": throttle,
        "stream_orphan_scans": lambda s, d: runner.drain_append(scan_events.orphan_scans(events(s, d), 21600), "orphans"),
        "stream_rule_scan": rule_scan,
        "stream_status_windows": windows(None),
        "stream_status_sliding": windows("6 hours"),
        "stream_scan_sessions": sessions,
        "stream_dedup": lambda s, d: runner.drain_append(scan_events.dedup(events(s, d), "scan_id", "status"), "dedup"),
        "concurrent_scans": lambda s, d: scan_events.concurrent_scans(intervals(s, d)),
    }


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for group in (corpus_queries, quality_queries, sliced_queries, performance_queries, dependency_queries, hygiene_queries, dataflow_queries, forensics_queries, scoring_queries, history_queries, stream_queries):
        out.update(group())
    return out
