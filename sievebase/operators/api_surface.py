"""API endpoints and their protections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievebase.functions.findings import emit, finding, with_lines
from sievebase.functions.text import first_lines, let

# Route patterns by framework and the words that show a protection.
EXPRESS = r"""(?i)(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""
ASPNET = r"""\[Http(Get|Post|Put|Delete|Patch)(?:\s*\(\s*"([^"]*)"\s*\))?\]"""
DJANGO = r"""path\s*\(\s*['"]([^'"]+)['"]"""
FLASK = r"""(?i)@\w+\.route\s*\(\s*['"]([^'"]+)['"](?:.*?methods\s*=\s*\[([^\]]+)\])?"""
FASTAPI = r"""(?i)@\w+\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]"""
AUTH = (
    r"(?i)\b(requireAuth|authenticate|passport\.authenticate|jwt\.verify|verifyToken|isAuthenticated|isLoggedIn"
    r"|\[Authorize\]|@login_required|permission_required|IsAuthenticated|auth_required|protect|ensureAuth|AuthGuard"
    r"|RequireAuthorization|UseAuthentication|verifyJWT|checkAuth)\b"
)
VALIDATION = (
    r"(?i)\b(express-validator|joi\.validate|celebrate|validationResult|check\(|body\(|param\(|query\(|\[Required\]"
    r"|ModelState\.IsValid|FluentValidation|DataAnnotations|form\.is_valid|serializer\.is_valid|@Valid|@Validated"
    r"|zod\.object|yup\.object)\b"
)
RATE_LIMIT = (
    r"(?i)\b(rateLimit|express-rate-limit|rate_limit|throttle|EnableRateLimiting|UseRateLimiter|RateLimiter"
    r"|@throttle_classes|slowDown|bottleneck)\b"
)
LINES_BEFORE, LINES_AFTER = 29, 40
MUTATIONS = ["POST", "PUT", "DELETE", "PATCH"]
ROUTE_HINT = r"(?i)(?:app|router|@\w+)\.|\[Http|path\s*\("


def _route_hits(l: Column, n: Column) -> Column:
    def hit(pattern: str, framework: str, method: Column, route: Column) -> Column:
        return F.when(
            l.rlike(pattern),
            F.struct(
                n.alias("line_number"), F.lit(framework).alias("framework"),
                method.alias("method"), route.alias("route"),
            ),
        )

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(l, pattern, i)

    named = (group(ASPNET, 2) != "") | group(ASPNET, 0).contains("(")
    return F.array_compact(
        F.array(
            hit(EXPRESS, "Express.js", F.upper(group(EXPRESS, 1)), group(EXPRESS, 2)),
            hit(ASPNET, "ASP.NET", F.upper(group(ASPNET, 1)),
                F.when(named, group(ASPNET, 2)).otherwise("(controller default)")),
            hit(DJANGO, "Django", F.lit("ANY"), group(DJANGO, 1)),
            hit(FLASK, "Flask",
                F.when(group(FLASK, 2) == "", "GET").otherwise(F.upper(F.btrim(group(FLASK, 2), F.lit("'\" ")))),
                group(FLASK, 1)),
            hit(FASTAPI, "FastAPI", F.upper(group(FASTAPI, 1)), group(FASTAPI, 2)),
        )
    )


def _protected_routes() -> Column:
    """The endpoints of a file with the protections seen around them.

    Protections are looked up among the line numbers of the file itself: within
    29 lines before and 40 after, in the whole file for rate limits, and for
    access checks in the whole file too if it registers middleware.
    """
    content, lines = F.col("content"), F.col("ls")
    routes = F.flatten(F.transform(lines, lambda l, i: _route_hits(l, i + 1)))
    seen = F.struct(
        first_lines(F.transform(lines, lambda l: l.rlike(AUTH))).alias("auth"),
        first_lines(F.transform(lines, lambda l: l.rlike(VALIDATION))).alias("validation"),
        content.rlike(RATE_LIMIT).alias("rate_limit"),
        F.lower(content).contains("app.use(").alias("global_use"),
    )

    def around(at: Column, n: Column) -> Column:
        return F.exists(at, lambda k: (k >= n - LINES_BEFORE) & (k <= n + LINES_AFTER))

    def judge(r: Column, s: Column) -> Column:
        n = r["line_number"]
        return F.struct(
            *[r[c].alias(c) for c in ("line_number", "framework", "method", "route")],
            (around(s["auth"], n) | (s["global_use"] & (F.size(s["auth"]) > 0))).alias("has_auth"),
            around(s["validation"], n).alias("has_validation"), s["rate_limit"].alias("has_rate_limit"),
        )

    kind = (
        "array<struct<line_number:int,framework:string,method:string,route:string,"
        "has_auth:boolean,has_validation:boolean,has_rate_limit:boolean>>"
    )
    none = F.array().cast(kind)
    judged = let(
        routes,
        lambda rs: F.when(F.size(rs) > 0, let(seen, lambda s: F.transform(rs, lambda r: judge(r, s)))).otherwise(none),
    )
    return F.when(content.rlike(ROUTE_HINT), judged).otherwise(none)


def endpoint_protection(files: DataFrame) -> DataFrame:
    return with_lines(files).select("repo", "file_path", F.inline(_protected_routes()))


def api_endpoints(files: DataFrame) -> DataFrame:
    """One row per route rule hit; one line may hit two rules."""
    return endpoint_protection(files).select("repo", "file_path", "line_number", "framework", "method", "route")


def _api(e, severity: str, title: str, why: str, advice: str, effort: str, score: int) -> Column:
    described = F.concat(F.lit("Endpoint "), e("method"), F.lit(" "), e("route"), F.lit(why))
    return finding(e("line_number"), severity, "ApiSurface", title, described, advice, effort, score)


def _unprotected(e) -> Column:
    return F.when(~e("has_auth"), _api(
        e, "Warning", "Unprotected API Endpoint", " checks no caller.", "Check the caller before the handler.", "Medium", 75))


def _unvalidated(e) -> Column:
    return F.when(~e("has_validation"), _api(
        e, "Info", "No Input Validation on Endpoint", " checks no input.", "Check the input before use.", "Easy", 50))


def _unlimited(e) -> Column:
    return F.when(~e("has_rate_limit") & e("method").isin(MUTATIONS), _api(
        e, "Info", "No Rate Limiting on Mutating Endpoint", " may be called without limit.", "Limit the call rate.", "Easy", 45))


def _of(*checks):
    """An analyzer giving the findings of these checks for every endpoint of a file."""
    def analyzer() -> Column:
        return F.flatten(
            F.transform(_protected_routes(), lambda r: F.array_compact(F.array(*[c(lambda name: r[name]) for c in checks])))
        )

    return analyzer


def endpoint_findings() -> Column:
    return _of(_unprotected, _unvalidated, _unlimited)()


def unprotected_endpoints(files: DataFrame) -> DataFrame:
    return emit(files, _of(_unprotected))


def unvalidated_endpoints(files: DataFrame) -> DataFrame:
    return emit(files, _of(_unvalidated))


def unlimited_mutations(files: DataFrame) -> DataFrame:
    return emit(files, _of(_unlimited))


def api_surface_summary(findings: DataFrame) -> DataFrame:
    """Per repository: endpoints without access checks, validation and rate limits."""
    title = F.col("title")
    return (
        findings.filter(F.col("category") == "ApiSurface")
        .groupBy("repo")
        .agg(
            F.count(F.when(F.col("severity").isin("Warning", "Critical"), 1)).alias("unprotected"),
            F.count(F.when(title.contains("Validation"), 1)).alias("no_validation"),
            F.count(F.when(title.contains("Rate"), 1)).alias("no_rate_limit"),
            F.count("*").alias("findings"),
        )
    )
