"""From findings to scored findings and to the marts built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievebase.functions.text import extension, let, split_lines
from sievebase.rules import confidence as rules


def severity_count(severity: str) -> Column:
    return F.count(F.when(F.col("severity") == severity, 1))


def debt_hours(critical: Column, warning: Column, info: Column) -> Column:
    return critical * rules.HOURS["Critical"] + warning * rules.HOURS["Warning"] + info * rules.HOURS["Info"]


# ---- confidence -------------------------------------------------------------

def line_facts(files: DataFrame) -> DataFrame:
    """Small facts per line, so that findings never meet the text itself.

    ``flags`` holds per line 1 if it is code and 2 if it can be executed;
    ``marks`` the lines with a block comment mark and whether they open one.
    """
    lead = r"^\s*"
    flags = F.transform(
        "ls",
        lambda l: F.when(
            l.rlike(lead + "(" + rules.COMMENT_START + "|" + rules.COMMENT_START_SPACED + ")")
            | F.regexp_replace(l, lead, "").rlike(rules.LOG_CALL), 0,
        ).otherwise(1)
        + F.when(
            ~l.rlike(r"\S") | l.rlike(lead + "(" + rules.COMMENT_START + "|" + rules.COMMENT_START_SPACED + r"\s*\S)"), 0
        ).otherwise(2),
    )
    marks = F.array_compact(
        F.transform(
            "ls",
            lambda l, i: F.when(
                l.contains("/*") | l.contains("*/"),
                F.struct((i + 1).alias("line"), (l.contains("/*") & ~l.contains("*/")).alias("opens")),
            ),
        )
    )
    with_lines = files.withColumn("ls", split_lines(F.col("content")))
    return with_lines.select("repo", "file_path", F.transform(flags, lambda x: x.cast("tinyint")).alias("flags"), marks.alias("marks"))


def _context_fits(path: Column) -> Column:
    ext = F.lower(extension(path))
    text = F.lower(F.concat_ws("\n", "title", "description"))
    fits = F.when(ext == "", True)
    for weakness, types in rules.CONTEXTS:
        fits = fits.when(text.contains(weakness.lower()), ext.isin(types))
    return fits.when(F.col("category").isin(rules.CATEGORIES), ext.isin(rules.CODE_TYPES)).otherwise(True)


def confidence_score(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Score findings that have none, and lower the doubtful ones to Info.

    Four factors: the line is code (40), the title is seen in more than one file
    of the repository (20), the line can be executed (20), the file type fits
    (20). A line or file that is not there counts in the finding's favour.
    """
    spread = (
        findings.groupBy("repo", F.lower("title").alias("low_title"))
        .agg((F.min("file_path") != F.max("file_path")).alias("many_files"))
    )
    facts = line_facts(files)
    n = F.col("line_number")
    known = F.col("flags").isNotNull() & (n > 0) & (n <= F.size("flags"))
    flag = F.get("flags", n - 1)
    mark = let(
        F.filter("marks", lambda m: (m["line"] < n) & (m["line"] >= n - rules.BLOCK_LOOKBACK)),
        lambda ms: F.try_element_at(ms, F.lit(-1))["opens"],
    )
    in_code = ~known | flag.bitwiseAND(F.lit(1).cast("tinyint")).cast("boolean")
    executable = ~known | (flag.bitwiseAND(F.lit(2).cast("tinyint")).cast("boolean") & ~F.coalesce(mark, F.lit(False)))
    points = (
        F.when(in_code, 40).otherwise(0) + F.when(F.col("many_files"), 20).otherwise(0)
        + F.when(executable, 20).otherwise(0) + F.when(_context_fits(F.col("file_path")), 20).otherwise(0)
    )
    unscored = F.col("confidence_score") == 0
    # Findings with a score stay as they are; however many, they are not shuffled.
    has_score = F.coalesce(~unscored, F.lit(True))
    scored = (
        findings.filter(~has_score).withColumn("low_title", F.lower("title"))
        .join(spread, ["repo", "low_title"], "left")
        .join(facts, ["repo", "file_path"], "left")
        .withColumn("points", points)
    )
    scored = scored.select(
        *[
            F.coalesce("points", "confidence_score").cast("int").alias(c) if c == "confidence_score"
            else F.when(F.col("points") < 40, "Info").otherwise(F.col("severity")).alias(c) if c == "severity"
            else F.col(c)
            for c in findings.columns
        ]
    )
    return findings.filter(has_score).unionByName(scored)


def blame_attribution(findings: DataFrame, blame: DataFrame) -> DataFrame:
    """Commit and author of the line of each finding, where they are known."""
    asked = (F.col("line_number") > 0) & (F.col("file_path") != "") & ~F.col("file_path").startswith(".git/")
    date = F.concat(F.from_unixtime("author_time", "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
    b = blame.select(
        "repo", "file_path", "line_number", F.col("hash").alias("b_hash"), F.col("author").alias("b_author"),
        F.col("author_email").alias("b_email"), date.alias("b_date"), F.col("summary").alias("b_summary"),
    )
    joined = findings.withColumn("line_key", F.when(asked, F.col("line_number"))).join(
        b.withColumnRenamed("line_number", "line_key"), ["repo", "file_path", "line_key"], "left"
    )
    hit = F.col("b_hash").isNotNull()
    return joined.select(
        *[c for c in findings.columns if c not in ("commit_hash", "commit_date")],
        F.coalesce("b_hash", "commit_hash").alias("commit_hash"),
        F.coalesce("b_date", "commit_date").alias("commit_date"),
        F.col("b_author").alias("author"), F.col("b_email").alias("author_email"), F.col("b_summary").alias("commit_message"),
        F.when(hit, F.concat("b_author", F.lit(" in "), F.substring("b_hash", 1, 7), F.lit(" ("), "b_date", F.lit(")"))).alias("introduced_by"),
    )


def attack_chains(findings: DataFrame) -> DataFrame:
    """Raise findings of a file that make each other worse.

    Only the open endpoints of a file are ranked, and only the files with an
    unchecked endpoint are joined to them; all other findings pass through, so a
    path that very many findings share is no partition of its own.
    """
    title, score = F.col("title"), F.col("confidence_score")
    open_api = F.coalesce(title == "Unprotected API Endpoint", F.lit(False))
    unchecked = findings.filter(title == "No Input Validation on Endpoint").select("repo", "file_path", F.lit(True).alias("_chained")).distinct()
    first = F.row_number().over(Window.partitionBy("repo", "file_path").orderBy("line_number", "description"))
    endpoints = findings.filter(open_api).withColumn("_first", first == 1).join(unchecked, ["repo", "file_path"], "left")
    endpoints = endpoints.select(*findings.columns, (F.col("_first") & F.coalesce("_chained", F.lit(False))).alias("_lead"))
    marked = findings.filter(~open_api).withColumn("_lead", F.lit(False)).unionByName(endpoints)
    lead = F.col("_lead")
    flow = F.col("data_flow_trace").isNotNull() & F.coalesce(F.col("severity") == "Warning", F.lit(False))
    secret = title.contains("Hardcoded") | title.contains("Secret")
    new = {
        "severity": F.when(lead | flow, "Critical").otherwise(F.col("severity")),
        "confidence_score": F.least(
            F.lit(100), score + F.when(lead, 15).otherwise(0) + F.when(flow & ~lead, 10).otherwise(0)
        ).cast("int"),
        "description": F.when(lead, F.concat("description", F.lit(" Its input is not checked either."))).otherwise(F.col("description")),
        "reachability_status": F.when(secret & (F.coalesce("reachability_status", F.lit("")) == ""), "Active").otherwise(F.col("reachability_status")),
    }
    return marked.select(*[new[c].alias(c) if c in new else F.col(c) for c in findings.columns])


# ---- marts --------------------------------------------------------------------

def health_score(findings: DataFrame) -> DataFrame:
    """Score of each repository: capped deductions, then bonuses, within 5 to 100."""
    def absent(condition: Column, bonus: int) -> Column:
        return F.when(F.bool_or(condition), 0).otherwise(bonus)

    title = F.col("title")
    counts = findings.groupBy("repo").agg(
        severity_count("Critical").alias("critical"), severity_count("Warning").alias("warning"),
        severity_count("Info").alias("info"),
        (
            absent(title == "No Tests Detected", 5) + absent(title == "No CI/CD Configuration", 3)
            + absent(title == "No README Found", 2) + absent(title == "No .gitignore File", 2)
            + absent(title.contains("Hardcoded") & (F.col("severity") == "Critical"), 5)
        ).alias("bonus"),
    )
    raw = (
        F.lit(100) - F.least(F.lit(40), F.col("critical") * 10) - F.least(F.lit(30), F.col("warning") * 3)
        - F.least(F.lit(10), F.col("info")) + F.col("bonus")
    )
    return counts.select("repo", "critical", "warning", "info", F.least(F.lit(100), F.greatest(F.lit(5), raw)).alias("health_score"))


def tech_debt(findings: DataFrame, by: str = "repo") -> DataFrame:
    hours = debt_hours(severity_count("Critical"), severity_count("Warning"), severity_count("Info"))
    return findings.groupBy(by).agg(hours.alias("hours")).select(
        by, "hours", (F.col("hours") * rules.HOURLY_RATE).cast("decimal(18,2)").alias("dollars"),
        F.ceil("hours").alias("hours_saved"),
    )


def file_risk(findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("repo", "file_path").agg(
        severity_count("Critical").alias("critical"), severity_count("Warning").alias("warning"), severity_count("Info").alias("info")
    )
    risk = F.col("critical") * 10 + F.col("warning") * 3 + F.col("info")
    tier = F.when(F.col("risk_score") >= 30, "CRITICAL").when(F.col("risk_score") >= 10, "WARNING").otherwise("LOW")
    return counts.withColumn("risk_score", risk).withColumn("risk_tier", tier)


def distinct_critical_titles(findings: DataFrame) -> DataFrame:
    return findings.filter((F.col("category") == "Security") & (F.col("severity") == "Critical")).select("repo", "title").distinct()


def action_plan(findings: DataFrame, by: str = "repo", top: int = 5) -> DataFrame:
    """The rules whose repair helps most, per repository or scan.

    Hours follow severity unless the effort says Low, Medium or High. The files
    of a rule are counted here and listed by ``action_plan_files``.
    """
    effort = F.lower(F.coalesce("effort_level", F.lit("")))
    hours = (
        F.when(effort.contains("low"), 0.5).when(effort.contains("medium"), 2.0).when(effort.contains("high"), 4.0)
        .when(F.col("severity") == "Critical", 4.0).when(F.col("severity") == "Warning", 1.5).otherwise(0.5)
    )
    rule = F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown Rule"))
    groups = findings.groupBy(by, rule.alias("rule_name")).agg(
        F.count("*").alias("instance_count"), F.countDistinct("file_path").alias("file_count"),
        F.sum(hours).alias("hours"), severity_count("Critical").alias("c"), severity_count("Warning").alias("w"),
        severity_count("Info").alias("i"),
    )
    impact = (F.col("c") * 10.0 + F.col("w") * 3.0) / F.log(F.col("hours") + 1.1)
    trust = (
        F.lit(80) + F.when(F.col("instance_count") < 5, 10).otherwise(0) - F.when(F.col("file_count") > 10, 15).otherwise(0)
        + F.when((F.col("i") > F.col("c")) & (F.col("i") > F.col("w")), 5).when(F.col("c") > 0, -10).otherwise(0)
    )
    items = groups.select(
        by, "rule_name", "instance_count", "file_count", F.bround("hours", 2).alias("estimated_hours"),
        F.bround(impact, 2).alias("score_impact"),
        F.bround((F.col("hours") * rules.HOURLY_RATE).cast("decimal(18,4)"), 2).cast("decimal(18,2)").alias("dollar_cost"),
        F.greatest(F.lit(40), F.least(F.lit(97), trust)).alias("fix_confidence"),
    )
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score_impact"), "rule_name"))
    return items.withColumn("rank", rank).filter(F.col("rank") <= top)


def action_plan_files(findings: DataFrame, plan: DataFrame, by: str = "repo") -> DataFrame:
    """Files of each planned rule, as rows."""
    rule = F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown Rule"))
    return (
        findings.select(by, rule.alias("rule_name"), "file_path").distinct()
        .join(plan.select(by, "rule_name"), [by, "rule_name"], "left_semi")
    )


def confidence_bands(findings: DataFrame) -> DataFrame:
    band = F.when(F.col("confidence_score") >= 80, "HIGH").when(F.col("confidence_score") >= 50, "MEDIUM").otherwise("LOW")
    return findings.groupBy(band.alias("band")).agg(F.count("*").alias("findings"))


def analysis_summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One sentence per repository with its main figures."""
    size = files.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum(F.size(split_lines(F.col("content")))).alias("lines")
    )
    def many(condition: Column, name: str) -> Column:
        return F.count(F.when(condition, 1)).alias(name)

    critical = F.col("severity") == "Critical"
    figures = findings.groupBy("repo").agg(
        F.min(F.when(critical, F.struct("file_path", "line_number", "title"))).alias("first_critical"),
        many(F.col("title").contains("Git History"), "history"),
        many(F.col("reachability_status").isin("DanglingBlob", "UnreachableCommit"), "lost"),
        many(F.col("data_flow_trace").isNotNull(), "flows"),
        many(F.col("category") == "ApiSurface", "api"),
        many(F.col("confidence_score") >= 80, "sure"),
        many(F.coalesce("commit_hash", F.lit("")) != "", "attributed"),
    )
    worst = (
        findings.filter(F.col("severity") == "Warning").groupBy("repo", "file_path").agg(F.count("*").alias("n"))
        .groupBy("repo").agg(F.min_by("file_path", F.struct(-F.col("n"), "file_path")).alias("worst_file"))
    )
    h = health_score(findings)
    hours = F.round(debt_hours(F.col("critical"), F.col("warning"), F.col("info"))).cast("bigint")
    label = F.when(F.col("health_score") >= 80, "Healthy").when(F.col("health_score") >= 50, "Needs Attention").otherwise("Critical")

    def said(condition: Column, template: str, *values) -> Column:
        return F.when(condition, F.format_string(template, *[F.col(v) if isinstance(v, str) else v for v in values]))

    sentence = F.concat_ws(
        " ",
        F.format_string("%s files with %s lines.", F.col("files"), F.format_number("lines", 0)),
        said(F.col("critical") > 0, "%s critical, first %s in %s.", "critical", F.col("first_critical.title"), F.col("first_critical.file_path")),
        said(F.col("warning") > 0, "%s warnings, most in %s.", "warning", "worst_file"),
        said(F.col("info") > 0, "%s notes.", "info"),
        said(F.col("history") > 0, "%s secrets in history.", "history"),
        said(F.col("lost") > 0, "%s in lost objects.", "lost"),
        said(F.col("flows") > 0, "%s proven flows.", "flows"),
        said(F.col("api") > 0, "%s on endpoints.", "api"),
        F.format_string("%s of high confidence.", F.col("sure")),
        said(F.col("attributed") > 0, "%s attributed.", "attributed"),
        F.format_string("Debt %sh. %s (%s/100).", hours, label, F.col("health_score")),
    )
    return (
        size.join(h, "repo").join(figures, "repo").join(worst, "repo", "left")
        .select("repo", "health_score", sentence.alias("summary"))
    )
