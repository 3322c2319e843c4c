"""Dashboards over scans, issues and users.

Every "per user" or "per scan" answer is given for all users or scans at once.
Issues are reduced per scan before they meet the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievebase.functions.labels import age_label, duration_label, eta_label, size_label
from sievebase.operators.scoring import debt_hours, severity_count
from sievebase.rules.confidence import HOURLY_RATE


def _newest() -> list[Column]:
    return [F.desc("created_at"), F.desc("scan_id")]


def _first(df: DataFrame, by: str | list[str], n: int, *order: Column) -> DataFrame:
    keys = [by] if isinstance(by, str) else by
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def _completed(scans: DataFrame) -> DataFrame:
    return scans.filter(F.col("status") == "COMPLETED")


def _name() -> Column:
    return F.coalesce(F.nullif("repository_name", F.lit("")), F.col("scan_id").cast("string"))


def _score() -> Column:
    return F.coalesce("health_score", F.lit(0))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("scan_id").agg(
        F.count("*").alias("total_issues"), severity_count("Critical").alias("critical"),
        severity_count("Warning").alias("warning"), severity_count("Info").alias("info"),
    )


def with_counts(scans: DataFrame, issues: DataFrame) -> DataFrame:
    counts = issue_counts(issues)
    joined = scans.join(counts, "scan_id", "left")
    return joined.select(*scans.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "scan_id"])


# ---- JSON, exports -------------------------------------------------------------

ISSUE_JSON = T.StructType(
    [
        T.StructField("severity", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("file_path", T.StringType()), T.StructField("line_number", T.IntegerType()),
    ]
)
RESULT_JSON = T.StructType(
    [T.StructField("score", T.IntegerType()), T.StructField("issues", T.ArrayType(ISSUE_JSON))]
)


def issue_documents(issues: DataFrame) -> DataFrame:
    """One JSON document per finding; a scan's findings are never gathered."""
    return issues.select("scan_id", F.to_json(F.struct(*ISSUE_JSON.fieldNames())).alias("document"))


def parse_issue_documents(documents: DataFrame) -> DataFrame:
    return documents.select("scan_id", F.from_json("document", ISSUE_JSON).alias("i")).select("scan_id", "i.*")


def result_documents(scans: DataFrame, issues: DataFrame) -> DataFrame:
    """Scan states whose ``result`` is one nested document of the score and the findings of the scan.

    A document holds the findings of one scan, as a stored state does; use
    ``issue_documents`` where a scan may have more than a row can hold.
    """
    nested = issues.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct(*ISSUE_JSON.fieldNames()))).alias("issues"))
    return scans.join(nested, "scan_id").select("scan_id", F.to_json(F.struct(F.col("health_score").alias("score"), "issues")).alias("result"))


def parse_results(states: DataFrame) -> DataFrame:
    """Findings of stored scan states whose ``result`` holds one nested document."""
    parsed = states.select("scan_id", F.from_json("result", RESULT_JSON).alias("r"))
    return parsed.select("scan_id", F.col("r.score").alias("score"), F.inline("r.issues"))


def scan_state_json(issues: DataFrame) -> DataFrame:
    """Write findings as JSON, read them back and count them per scan."""
    return issue_counts(parse_issue_documents(issue_documents(issues)))


def csv_field(text: Column) -> Column:
    """Quotes doubled; a leading sign that a spreadsheet would run is disarmed."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""'))
    return F.when(doubled.rlike("^[=+\\-@]"), F.concat(F.lit("'"), doubled)).otherwise(doubled)


CSV_HEADER = "Severity,Category,Title,File,Line,Confidence,Suggestion"


def findings_csv_export(issues: DataFrame) -> DataFrame:
    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    line = F.concat_ws(
        ",",
        quoted(F.col("severity")), quoted(F.col("category")), quoted(csv_field(F.col("title"))),
        quoted(csv_field(F.col("file_path"))), F.col("line_number").cast("string"), F.col("confidence_score").cast("string"),
        quoted(csv_field(F.replace("suggestion", F.lit("\n"), F.lit(" ")))),
    )
    return issues.select("scan_id", line.alias("csv_line"))


def user_export(scans: DataFrame) -> DataFrame:
    """Scans of every user, newest first, one JSON line each with the user's count.

    The lines are range-sorted, so a user with a third of all scans is spread
    over many tasks and never gathered into one document.
    """
    totals = scans.groupBy("user_id").agg(F.count("*").alias("total_scans"))
    document = F.to_json(
        F.struct("scan_id", "status", "health_score", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    )
    return (
        scans.join(totals, "user_id").orderBy("user_id", *_newest())
        .select("user_id", "total_scans", document.alias("scan_json"))
    )


# ---- history -------------------------------------------------------------------

def recent_completed(local: DataFrame, remote: DataFrame, n: int = 10, by: str = "user_id") -> DataFrame:
    """Newest completed scans per user from two stores; the local row wins."""
    cols = local.columns
    both = [
        _first(_completed(store), by, n, *_newest()).select(*cols, F.lit(priority).alias("store"))
        for priority, store in enumerate((local, remote))
    ]
    row = F.struct("store", *[c for c in cols if c not in (by, "scan_id")])
    once = (
        both[0].unionByName(both[1]).groupBy(by, "scan_id").agg(F.min_by(row, "store").alias("r")).select(by, "scan_id", "r.*")
    )
    return _first(once, by, n, *_newest()).select(*cols, "store", "rank")


def scan_history(scans: DataFrame, n: int = 10) -> DataFrame:
    recent = _first(_completed(scans), "user_id", n, *_newest())
    return recent.select("user_id", "scan_id", _name().alias("repository_name"), _score().alias("score"), "status", "created_at", "rank")


def repo_cards(scans: DataFrame, issues: DataFrame, n: int = 10) -> DataFrame:
    recent = _first(_completed(scans), "user_id", n, *_newest()).drop("rank")
    tier = F.when(_score() >= 80, "HEALTHY").when(_score() >= 50, "NOMINAL").otherwise("CRITICAL")
    return with_counts(recent, issues).select(
        "user_id", "scan_id", _name().alias("name"), _score().alias("coverage"), tier.alias("tier"),
        F.col("critical").alias("critical_count"), F.col("warning").alias("warning_count"), "created_at",
    )


def user_scan_stats(scans: DataFrame, issues: DataFrame, n: int = 100) -> DataFrame:
    """Over a user's newest scans; the mean score is an integer division."""
    recent = with_counts(_first(_completed(scans), "user_id", n, *_newest()).drop("rank"), issues)
    sums = recent.groupBy("user_id").agg(
        F.count("*").alias("total_scans"), F.sum(_score()).alias("scores"), F.sum("total_issues").alias("total_issues"),
        F.sum("critical").alias("critical_issues"), F.sum("warning").alias("w"), F.sum("info").alias("i"),
    ).withColumn("hours", debt_hours(F.col("critical_issues"), F.col("w"), F.col("i")))
    return sums.select(
        "user_id", "total_scans", F.expr("scores div total_scans").alias("avg_score"), "total_issues", "critical_issues",
        F.floor("hours").alias("debt_hours"), (F.col("hours") * HOURLY_RATE).cast("decimal(18,2)").alias("debt_dollars"),
    )


def admin_stats(scans: DataFrame, issues: DataFrame, users: DataFrame, keys: DataFrame) -> DataFrame:
    """System totals: one small aggregate per table, summed up side by side."""
    done = _completed(scans)
    counted = issues.join(done.select("scan_id"), "scan_id", "left_semi")
    names = [
        "total_users", "total_scans", "total_api_keys", "total_critical", "total_issues", "total_repos", "score_sum", "completed_scans",
    ]
    parts = [
        users.agg(F.count("*").alias("total_users")),
        scans.agg(F.count("*").alias("total_scans")),
        keys.agg(F.count("*").alias("total_api_keys")),
        counted.agg(severity_count("Critical").alias("total_critical"), F.count("*").alias("total_issues")),
        done.agg(
            F.countDistinct("repository_name").alias("total_repos"), F.sum(_score()).alias("score_sum"), F.count("*").alias("completed_scans")
        ),
    ]
    rows = [p.select(*[F.col(c) if c in p.columns else F.lit(0).cast("bigint").alias(c) for c in names]) for p in parts]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    total = union.agg(*[F.sum(c).alias(c) for c in names])
    mean = F.when(F.col("completed_scans") > 0, F.expr("score_sum div completed_scans")).otherwise(0)
    return total.select(*[c for c in names if c != "score_sum"], mean.cast("bigint").alias("avg_health_score"))


USER_ORDERS = {"last_login": "last_login", "plan": "plan_type", "scans": "total_scans", "email": "email"}


def admin_users(users: DataFrame, scans: DataFrame, search: str = "", sort: str = "last_login", ascending: bool = False) -> DataFrame:
    """Users with their scan counts, searched by e-mail or name."""
    wanted = search.lower()
    found = users.filter(F.lower("email").contains(wanted) | F.lower("display_name").contains(wanted)) if wanted else users
    counts = scans.groupBy("user_id").agg(F.count("*").alias("n"))
    col = USER_ORDERS[sort]
    return (
        found.join(counts, "user_id", "left")
        .select(*users.columns, F.coalesce("n", F.lit(0)).alias("total_scans"))
        .orderBy(F.asc(col) if ascending else F.desc(col), "user_id")
    )


SCAN_ORDERS = {"repositoryname": "repository_name", "status": "status", "score": "health_score", "createdat": "created_at"}


def admin_scans_page(
    scans: DataFrame, issues: DataFrame, search: str = "", status: str = "", page: int = 1, size: int = 20,
    sort_by: str = "", ascending: bool = False,
) -> DataFrame:
    """One page of the searched and sorted scans, with the number of all hits."""
    hits = scans
    if search.strip():
        s = search.lower()
        hits = hits.filter(F.lower(F.col("scan_id").cast("string")).contains(s) | F.lower("repository_name").contains(s))
    if status.strip():
        hits = hits.filter(F.col("status") == status.upper())
    col = SCAN_ORDERS.get(sort_by.lower(), "created_at")
    order = F.asc(col) if ascending and sort_by else F.desc(col)
    rows = hits.orderBy(order, "scan_id").offset((page - 1) * size).limit(size)
    # The page is small; its rows keep their place, as joins don't keep the order.
    place = F.row_number().over(Window.orderBy(order, "scan_id")) + (page - 1) * size
    total = hits.agg(F.count("*"))
    return with_counts(rows.withColumn("position", place), issues).orderBy("position").select(
        "position", "scan_id", "status", "repository_name", "user_id", "created_at", _score().alias("score"),
        "total_issues", F.col("critical").alias("critical_issues"), total.scalar().alias("total"),
    )


def activity_feed(scans: DataFrame, users: DataFrame) -> DataFrame:
    """The newest ten scans and five sign-ins, newest first."""
    icon = F.when(F.col("status") == "COMPLETED", "check_circle").when(F.col("status") == "FAILED", "error").otherwise("sync")
    recent = scans.orderBy(*_newest()).limit(10).select(
        F.lit("SCAN").alias("type"), icon.alias("icon"), F.concat(_name(), F.lit(" — "), "status").alias("message"),
        F.col("created_at").alias("timestamp"), F.col("health_score").alias("score"),
    )
    logged = users.orderBy(F.desc("last_login"), "user_id").limit(5).select(
        F.lit("USER").alias("type"), F.lit("person").alias("icon"), F.concat(F.lit("User logged in: "), "email").alias("message"),
        F.col("last_login").alias("timestamp"), F.lit(0).alias("score"),
    )
    return recent.unionByName(logged).orderBy(F.desc("timestamp"), "message").limit(20)


def notifications(scans: DataFrame, last_read: str, as_of: str, n: int = 5) -> DataFrame:
    """Per user: one note per recent scan, one more if its score is below 80, and the monthly note."""
    recent = _first(_completed(scans), "user_id", n, *_newest())
    name = _name()

    def note(kind: str, message: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), message.alias("message"), at.alias("created_at"))

    at = F.col("created_at")
    notes = F.array_compact(
        F.array(
            note("complete", F.concat(F.lit("Scan complete — "), name, F.lit(" scored "), _score().cast("string")), at),
            F.when(_score() < 80, note("critical", F.concat(F.lit("New critical issue found in "), name), at + F.expr("interval 1 minute"))),
        )
    )
    listed = recent.select("user_id", F.col("scan_id").cast("string").alias("scan_id"), F.inline(notes))
    monthly = listed.select("user_id").distinct().select(
        "user_id", F.lit("report").alias("scan_id"), F.lit("report").alias("kind"),
        F.lit("Monthly code health report ready").alias("message"),
        (F.lit(as_of).cast("timestamp_ntz") - F.expr("interval 1 day")).alias("created_at"),
    )
    return listed.unionByName(monthly).withColumn("is_unread", F.col("created_at") > F.lit(last_read).cast("timestamp_ntz"))


CARD_ORDERS = {"Name": "name", "Coverage": "coverage", "Time": "created_at"}


def repo_search_sort(cards: DataFrame, search: str = "", sort: str = "Time", ascending: bool = False) -> DataFrame:
    s = search.lower()
    hits = cards.filter(F.lower("name").contains(s) | F.lower(F.col("scan_id").cast("string")).contains(s)) if s.strip() else cards
    col = CARD_ORDERS.get(sort, "created_at")
    return hits.orderBy(F.asc(col) if ascending else F.desc(col), "scan_id")


def latest_two_scans(scans: DataFrame, by: str = "repository_name") -> DataFrame:
    """Newest and second newest completed scan, where there are two."""
    two = _first(_completed(scans).filter(F.col(by) != ""), by, 2, *_newest())
    return (
        two.groupBy(by)
        .agg(
            F.max(F.when(F.col("rank") == 2, F.col("scan_id"))).alias("scan_a"),
            F.max(F.when(F.col("rank") == 1, F.col("scan_id"))).alias("scan_b"),
        )
        .filter(F.col("scan_a").isNotNull())
    )


def scan_diff(pairs: DataFrame, issues: DataFrame, by: str = "repository_name") -> DataFrame:
    """Findings (file and title) gone from the older or new in the newer scan."""
    def keys(side: str) -> DataFrame:
        return pairs.select(by, F.col(side).alias("scan_id")).join(issues, "scan_id").select(by, "file_path", "title").distinct()

    a, b, on = keys("scan_a"), keys("scan_b"), [by, "file_path", "title"]
    gone = a.join(b, on, "left_anti").withColumn("change", F.lit("fixed"))
    new = b.join(a, on, "left_anti").withColumn("change", F.lit("new"))
    return gone.unionByName(new)


def scan_diff_summary(pairs: DataFrame, scans: DataFrame, issues: DataFrame, by: str = "repository_name") -> DataFrame:
    """Changes of score and counts between the two scans, with fixed and new findings."""
    def side(name: str) -> DataFrame:
        state = with_counts(pairs.select(by, F.col(name).alias("scan_id")).join(scans.select("scan_id", "health_score"), "scan_id"), issues)
        return state.select(by, _score().alias(name + "_score"), F.col("critical").alias(name + "_critical"), F.col("warning").alias(name + "_warning"))

    changes = scan_diff(pairs, issues, by).groupBy(by).agg(
        F.count(F.when(F.col("change") == "fixed", 1)).alias("fixed"), F.count(F.when(F.col("change") == "new", 1)).alias("new")
    )
    return side("scan_a").join(side("scan_b"), by).join(changes, by, "left").select(
        by,
        *[(F.col(f"scan_b_{m}") - F.col(f"scan_a_{m}")).alias(f"{m}_delta") for m in ("score", "critical", "warning")],
        F.coalesce("fixed", F.lit(0)).alias("fixed_count"), F.coalesce("new", F.lit(0)).alias("new_count"),
    )


def score_trend(scans: DataFrame, n: int = 5, by: str = "repository_name") -> DataFrame:
    """Points of the last scores on a 100 by 40 canvas, if there are two or more."""
    last = _first(_completed(scans).filter(F.col(by) != ""), by, n, *_newest())
    size = last.groupBy(by).agg(F.count("*").alias("n"))
    i = F.col("n") - F.col("rank")
    return last.join(size, by).filter(F.col("n") >= 2).select(
        by, "scan_id", i.alias("i"), (F.lit(100.0) / (F.col("n") - 1) * i).alias("x"), (F.lit(40) - _score() * 0.4).alias("y")
    )


def top_affected_files(issues: DataFrame, n: int = 10) -> DataFrame:
    """Files with most findings per scan and their share, rounded half to even."""
    files = issues.filter(F.col("file_path") != "").groupBy("scan_id", "file_path").agg(F.count("*").alias("findings"))
    total = issues.groupBy("scan_id").agg(F.count("*").alias("total"))
    top = _first(files, "scan_id", n, F.desc("findings"), F.asc("file_path"))
    share = F.bround(F.col("findings") / F.col("total") * 100).cast("int")
    return top.join(total, "scan_id").select("scan_id", "file_path", "findings", share.alias("percentage"), "rank")


def severity_category_matrix(issues: DataFrame) -> DataFrame:
    """Counts by severity and category with all margins, in one pass."""
    def shown(c: str) -> Column:
        return F.when(F.col(f"all_{c}") == 1, "ALL").otherwise(F.col(c)).alias(c)

    counts = issues.cube("severity", "category").agg(
        F.count("*").alias("findings"), F.grouping("severity").alias("all_severity"), F.grouping("category").alias("all_category")
    )
    return counts.select(shown("severity"), shown("category"), "findings")


def report_sections(issues: DataFrame, suggestions: int = 10, criticals: int = 5) -> DataFrame:
    """Sections of a scan report. Whole sections carry a sort key, cut ones a rank."""
    first = F.when(F.col("severity") == "Critical", 0).otherwise(1)
    place = [F.asc("file_path"), F.asc("line_number"), F.asc("title"), F.asc("severity")]
    cols = ["scan_id", "severity", "title", "file_path", "line_number"]

    def section(df: DataFrame, name: str, key: Column) -> DataFrame:
        return df.select(*cols, F.lit(name).alias("section"), key.cast("int").alias("position"))

    security = section(issues.filter(F.col("category") == "Security"), "security", first)
    debt = section(issues.filter(F.col("category").isin("Quality", "Performance")), "quality", F.lit(0))
    advice = section(
        _first(issues.filter(F.col("suggestion") != ""), "scan_id", suggestions, F.asc(first), *place), "suggestions", F.col("rank")
    )
    urgent = section(_first(issues.filter(F.col("severity") == "Critical"), "scan_id", criticals, *place), "criticals", F.col("rank"))
    return security.unionByName(debt).unionByName(advice).unionByName(urgent)


# ---- accounts ------------------------------------------------------------------

FREE_SCANS = 3


def _month() -> Column:
    return F.date_format("created_at", "yyyy-MM")


def monthly_quota(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Use of a quota by calendar months per user and month; -1 stands for no limit."""
    used = scans.groupBy("user_id", _month().alias("month")).agg(F.count("*").alias("used"))
    limit = F.when(F.col("plan_type") == "FREE", FREE_SCANS).otherwise(-1)
    return used.join(users.select("user_id", "plan_type"), "user_id").select(
        "user_id", "month", "plan_type", "used", limit.alias("scan_limit"),
        F.when(F.col("plan_type") == "FREE", F.greatest(F.lit(0), F.lit(FREE_SCANS) - F.col("used"))).otherwise(-1).alias("remaining"),
        F.greatest(F.lit(0), F.when(F.col("plan_type") == "FREE", F.col("used") - FREE_SCANS).otherwise(0)).alias("rejected"),
    )


def monthly_rejections(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Scans of free users past the third of a calendar month.

    Only the third scan of each (user, month) is ranked out; all later ones are
    found by comparing with it, so no month is sorted in one task.
    """
    free = scans.join(users.filter(F.col("plan_type") == "FREE").select("user_id"), "user_id", "left_semi").withColumn("month", _month())
    third = (
        _first(free, ["user_id", "month"], FREE_SCANS, F.asc("created_at"), F.asc("scan_id"))
        .filter(F.col("rank") == FREE_SCANS)
        .select("user_id", "month", F.struct("created_at", "scan_id").alias("third"))
    )
    later = free.join(third, ["user_id", "month"]).filter(F.struct("created_at", "scan_id") > F.col("third"))
    return later.select("user_id", "month", "scan_id", F.lit("monthly limit reached").alias("reason"))


def cascade_delete(owned: DataFrame, removed_users: DataFrame) -> DataFrame:
    """Rows that stay when users go with everything they own."""
    return owned.join(removed_users.select("user_id").distinct(), "user_id", "left_anti")


def clear_history(scans: DataFrame, user_id: int) -> DataFrame:
    """Scans that stay when one user's history is cleared; unowned scans stay."""
    return scans.filter(~F.coalesce(F.col("user_id") == user_id, F.lit(False)))


def delete_scan(scans: DataFrame, scan_id: int, user_id: int) -> DataFrame:
    """Remove one scan if it is unowned or owned by the user."""
    may = (F.col("scan_id") == scan_id) & (F.col("user_id").isNull() | (F.col("user_id") == user_id))
    return scans.filter(~F.coalesce(may, F.lit(False)))


def user_upsert(users: DataFrame, logins: DataFrame, as_of: str) -> DataFrame:
    """Merge sign-ins into the users: match on id, else on e-mail, else insert.

    ``logins`` has user_id, email and an order, login_no. Of an id's sign-ins only
    the last counts, and of an e-mail's as well. A stored user is changed once: by
    the sign-in with its id, else by the one with its e-mail.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    row = F.struct("user_id", "email", "login_no")
    last = logins.groupBy("user_id").agg(F.max_by(row, "login_no").alias("l")).select("l.*")
    last = last.groupBy("email").agg(F.max_by(row, "login_no").alias("l")).select("l.*")
    by_id = last.join(users.select("user_id", F.col("user_id").alias("old_id")), "user_id", "left")
    rest = by_id.filter(F.col("old_id").isNull()).drop("old_id")
    by_mail = rest.join(users.select("email", F.col("user_id").alias("old_id")), "email", "left")
    cols = ["user_id", "email", "old_id", "login_no"]
    matched = by_id.filter(F.col("old_id").isNotNull()).select(*cols, F.lit(1).alias("sure")).unionByName(by_mail.select(*cols, F.lit(0).alias("sure")))
    found, inserted = matched.filter(F.col("old_id").isNotNull()), matched.filter(F.col("old_id").isNull())
    best = F.struct("sure", "login_no")
    one = found.groupBy("old_id").agg(F.max_by(F.struct("user_id", "email"), best).alias("l")).select("old_id", "l.*")
    merged = users.select(F.col("user_id").alias("old_id"), F.col("email").alias("old_email"), "plan_type", "last_login").join(
        one.unionByName(inserted.select("old_id", "user_id", "email")), "old_id", "full_outer"
    )
    touched = F.col("user_id").isNotNull()
    return merged.select(
        F.coalesce("user_id", "old_id").alias("user_id"), F.coalesce("email", "old_email").alias("email"),
        F.coalesce("plan_type", F.lit("FREE")).alias("plan_type"), F.when(touched, now).otherwise(F.col("last_login")).alias("last_login"),
        F.when(~touched, "kept").when(F.col("old_email").isNull(), "inserted").otherwise("updated").alias("action"),
    )


def owner_filter(scans: DataFrame, user_id: str) -> DataFrame:
    owner = F.coalesce(F.col("owner"), F.lit(""))
    return scans.filter((owner == "") | (owner == user_id))


def api_key_listing(keys: DataFrame) -> DataFrame:
    """Keys of each user, newest first, without their value."""
    return keys.select("user_id", "key_id", "name", "created_at", "last_used").orderBy("user_id", F.desc("created_at"), F.desc("key_id"))


def fix_progress(issues: DataFrame, fixed: DataFrame) -> DataFrame:
    """Fixed places (file and line) per scan and their share of all findings."""
    place = ["scan_id", "file_path", "line_number"]
    done = issues.select(*place).join(fixed.select(*place), place, "left_semi").distinct().groupBy("scan_id").agg(F.count("*").alias("fixed_count"))
    total = issues.groupBy("scan_id").agg(F.count("*").alias("total"))
    return total.join(done, "scan_id", "left").select(
        "scan_id", "total", F.coalesce("fixed_count", F.lit(0)).alias("fixed_count"),
        F.expr("coalesce(fixed_count, 0) * 100 div greatest(1, total)").alias("percent"),
    )


def size_eta_labels(jobs: DataFrame, as_of: str) -> DataFrame:
    """``jobs`` has scan_id, size_kb, duration_ms and created_at."""
    return jobs.select(
        "scan_id", size_label(F.col("size_kb")).alias("size_label"), eta_label(F.col("size_kb")).alias("eta_label"),
        duration_label(F.col("duration_ms")).alias("duration_label"), age_label(F.col("created_at"), as_of).alias("age_label"),
    )


def team_members(teams: DataFrame, users: DataFrame) -> DataFrame:
    """Members of each team with the team's owner."""
    owners = users.select(F.col("user_id").alias("owner_id"), F.col("email").alias("owner_email"))
    role = F.when(F.col("user_id") == F.col("owner_id"), "owner").otherwise("member")
    return (
        users.join(teams, "team_id").join(owners, "owner_id")
        .select("team_name", "user_id", "email", role.alias("role"), "owner_email")
    )
