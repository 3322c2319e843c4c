"""Tainted data flows from input sources to dangerous sinks.

One pass over the text finds sources, sinks, checks, definitions and mentions; all
that follows works on line numbers and names. "No sanitizer between" becomes an
equal number of checks before both lines, a running count, so that sources and sinks
meet on (file, segment between two checks) and only true pairs are made. Windows of
some lines after a source meet on ranges of that length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievebase.functions.findings import finding, with_lines
from sievebase.functions.pairs import each_pair
from sievebase.functions.ranges import with_next
from sievebase.functions.substrings import key, pieces
from sievebase.functions.text import first_lines, let
from sievebase.rules import taint
from sievebase.session import materialize

NAME_KEY = 16


def variable_name(match: Column) -> Column:
    """The name searched for after a source: its last part that may be a variable.

    The name comes from the source expression and not from the assigned
    variable; it is empty where no part is left, and then every line holds it.
    """
    parts = F.transform(F.split(match, r"[.\[\] ()]"), lambda p: F.btrim(p, F.lit("'\" \t")))
    named = F.filter(parts, lambda p: (F.length(p) > 1) & ~p.isin(taint.NOT_A_VARIABLE))
    return F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))


def assigned_name(line: Column) -> Column:
    """The variable on the left of an assignment, empty if there is none."""
    return F.regexp_extract(line, r"(\w+)\s*=(?!=)", 1)


def _sources(lines: Column, mode: str) -> Column:
    def hits(l: Column, i: Column) -> Column:
        return F.array_compact(
            F.array(
                *[
                    F.when(
                        l.rlike(pattern),
                        F.struct(
                            (i + 1).alias("line"), F.lit(r).alias("rule"),
                            F.regexp_extract(l, pattern, 0).alias("expr"), F.lit(label).alias("label"),
                            assigned_name(l).alias("assigned"),
                        ),
                    )
                    for r, (pattern, label) in enumerate(taint.SOURCES)
                ]
            )
        )

    found = F.flatten(F.transform(lines, hits))
    return F.transform(
        found,
        lambda s: F.struct(
            s["line"].alias("line"), s["rule"].alias("rule"), s["expr"].alias("expr"), s["label"].alias("label"),
            (variable_name(s["expr"]) if mode == "compat" else s["assigned"]).alias("var"),
        ),
    )


def _may_sink(text: Column) -> Column:
    """Every sink pattern needs one of these literals."""
    marks = ["(", ".innerHTML", "dangerouslySetInnerHTML", "v-html", "{{{", '"""']
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def _may_define(text: Column) -> Column:
    """Every definition and export needs one of these literals."""
    marks = ["(", "function", "class", "=>", "export"]
    return reduce(lambda a, b: a | b, [text.contains(m) for m in marks])


def _sinks(lines: Column) -> Column:
    kind = "array<struct<line:int,rule:int,kind:string,weakness:string>>"
    none = F.array().cast(kind)

    def hits(l: Column, i: Column) -> Column:
        return F.array_compact(
            F.array(
                *[
                    F.when(
                        l.rlike(pattern),
                        F.struct((i + 1).alias("line"), F.lit(r).alias("rule"), F.lit(name).alias("kind"), F.lit(weakness).alias("weakness")),
                    )
                    for r, (pattern, name, weakness) in enumerate(taint.SINKS)
                ]
            )
        )

    found = F.flatten(F.transform(lines, lambda l, i: F.when(_may_sink(l), hits(l, i)).otherwise(none)))
    return F.when(_may_sink(F.col("content")), found).otherwise(none)


def _checks(lines: Column) -> Column:
    return first_lines(F.transform(lines, lambda l: l.rlike(taint.SANITIZER)))


# The alternatives of taint.FUNCTION, each so that it takes time linear in the line: a run of word characters is read from
# its start only, and a modifier is tried once, as what a later one leads to the first one leads to as well.
_WORD = r"(?<!\w)(\w++)"
_MODIFIER = r"(?:public|private|protected|internal|static|async|export)\s+"
_NAMED = (
    r"function\s+(\w+)",
    _MODIFIER,
    _WORD + r"\s*+(?:=|:)\s*+(?:async\s++)?\(?:\s*+(?:\w++(?:,\s*+\w++)*+)?+\s*+\)\s*+=>",
    r"def\s+(\w++)\s*+\(",
    r"class\s+(\w+)",
)
_CALLED = r"(\s?)" + _WORD + r"\s*+\("
_LINE_END = "[\r\u0085\u2028\u2029]"


def defined_name(line: Column) -> Column:
    """What taint.FUNCTION captures of its first match on a line, null without a match."""

    def candidate(number: int, pattern: str) -> Column:
        at = F.regexp_instr(line, F.lit(pattern))
        if pattern != _MODIFIER:
            return F.when(at > 0, F.struct(at.alias("at"), F.lit(number).alias("number"), F.regexp_extract(line, pattern, 1).alias("name")))
        # The last word before the first bracket after the modifier. A keyword that it begins with is left out, unless white
        # space stands before the word: then the match begins there.
        rest = F.regexp_extract(line, rf"{_MODIFIER}((?s:.*))", 1)
        called = F.regexp_extract(rest, _CALLED, 2)
        short = F.regexp_replace(called, r"^(?:function|const|let|var)(?=\w)", "")
        name = F.when(F.regexp_extract(rest, _CALLED, 1) == "", short).otherwise(called)
        return F.when((at > 0) & (called != ""), F.struct(at.alias("at"), F.lit(number).alias("number"), name.alias("name")))

    first = F.array_min(F.array_compact(F.array(*[candidate(k, p) for k, p in enumerate(_NAMED)])))["name"]
    groups = range(1, taint.FUNCTION_GROUPS + 1)
    found = F.array_compact(F.array(*[F.nullif(F.regexp_extract(line, taint.FUNCTION, i), F.lit("")) for i in groups]))
    # Other line ends inside a line stop the pattern's dot; such lines are rare.
    odd = F.rtrim(line, F.lit("\r")).rlike(_LINE_END)
    return F.when(odd, F.get(found, 0)).otherwise(first)


def _definitions(lines: Column) -> Column:
    """Functions and classes with their line, exported names with line 0."""

    def define(l: Column, i: Column) -> Column:
        named = let(defined_name(l), lambda name: F.when(name.isNotNull(), F.struct(name.alias("name"), (i + 1).alias("line"))))
        return F.when(_may_define(l), named)

    defined = F.transform(lines, define)
    exported = F.transform(
        lines,
        lambda l: F.when(
            l.contains("export") & l.rlike(taint.EXPORT) & l.rlike(taint.EXPORTED_NAME),
            F.struct(F.regexp_extract(l, taint.EXPORTED_NAME, 1).alias("name"), F.lit(0).alias("line")),
        ),
    )
    return F.array_distinct(F.array_compact(F.concat(defined, exported)))


def taint_sources(files: DataFrame, mode: str = "compat") -> DataFrame:
    held = with_lines(files.filter(F.col("content").rlike(taint.SOURCE_HINT)))
    return held.select("repo", "file_path", F.inline(_sources(F.col("ls"), mode))).select(
        "repo", "file_path", F.col("line").alias("line_number"), "rule", "expr", "label", "var"
    )


def taint_sinks(files: DataFrame) -> DataFrame:
    return with_lines(files).select("repo", "file_path", F.inline(_sinks(F.col("ls")))).select(
        "repo", "file_path", F.col("line").alias("line_number"), "rule", "kind", "weakness"
    )


def sanitizer_lines(files: DataFrame) -> DataFrame:
    held = with_lines(files.filter(F.col("content").rlike(taint.SANITIZER)))
    return held.select("repo", "file_path", F.explode(_checks(F.col("ls"))).alias("line_number"))


def function_index(files: DataFrame) -> DataFrame:
    return with_lines(files).select("repo", "file_path", F.inline(_definitions(F.col("ls")))).select(
        "repo", "file_path", F.col("line").alias("line_number"), "name"
    )


# --- facts ------------------------------------------------------------------------------------

FILE = ["repo", "file_path"]
RANGE = 4096  # lines of a file that one key holds at most
SOURCE = "array<struct<line:int,rule:int,expr:string,label:string,var:string>>"


def _mentions(lines: Column, sources: Column, names: Column) -> Column:
    """Lines that hold the variable of a source: the variables, the least function name and, near a source, the identifiers."""

    def on_line(l: Column, i: Column, variables: Column) -> Column:
        near = F.exists(sources, lambda s: (s["line"] <= i) & (i < s["line"] + taint.CALL_WINDOW))
        return let(
            F.filter(variables, lambda v: F.contains(l, v)),
            lambda held: F.when(
                (F.size(held) > 0) & l.rlike(r"\S"),
                F.struct(
                    (i + 1).alias("line"), F.array_min(F.filter(names, lambda n: F.contains(l, n))).alias("name"), held.alias("vars"),
                    F.when(near, F.array_distinct(F.regexp_extract_all(l, F.lit(r"\w+"), F.lit(0)))).alias("words"),
                ),
            ),
        )

    return let(_variables(sources), lambda variables: F.array_compact(F.transform(lines, lambda l, i: on_line(l, i, variables))))


def _variables(sources: Column) -> Column:
    return F.array_distinct(F.transform(sources, lambda s: s["var"]))


def _stores(lines: Column, sources: Column) -> Column:
    """Lines that store the variable of a source in a property."""

    def on_line(l: Column, i: Column, variables: Column) -> Column:
        pattern = lambda v: F.concat(F.lit(r"(\w+\.\w+)\s*=\s*\Q"), v, F.lit(r"\E"))
        held = F.transform(variables, lambda v: F.struct((i + 1).alias("line"), v.alias("var"), F.call_function("regexp_extract", l, pattern(v), F.lit(1)).alias("property")))
        return F.when(l.rlike(r"\w\.\w+\s*="), F.filter(held, lambda x: x["property"] != "")).otherwise(F.array().cast("array<struct<line:int,var:string,property:string>>"))

    return let(_variables(sources), lambda variables: F.flatten(F.transform(lines, lambda l, i: on_line(l, i, variables))))


def flow_facts(files: DataFrame, mode: str = "compat") -> DataFrame:
    """What flows are made of, as arrays of line numbers and names per file: the only pass over the text.

    sources, sinks, checks, definitions; mentions of sources' variables; stores of them in properties; and per sink line the
    properties it holds.
    """
    lines, content = F.col("ls"), F.col("content")

    def facts(x: Column) -> Column:
        names = F.array_distinct(F.transform(x["definitions"], lambda d: d["name"]))
        stores = F.when(F.size(x["sources"]) > 0, _stores(lines, x["sources"]))
        mentions = F.when(F.size(x["sources"]) > 0, let(names, lambda n: _mentions(lines, x["sources"], n)))
        return let(
            F.struct(stores.alias("stores"), mentions.alias("mentions")),
            lambda y: F.struct(
                x["sources"].alias("sources"), x["sinks"].alias("sinks"), x["checks"].alias("checks"), x["definitions"].alias("definitions"),
                y["mentions"].alias("mentions"), y["stores"].alias("stores"), _uses(lines, x["sinks"], y["stores"]).alias("uses"),
            ),
        )

    found = F.when(content.rlike(taint.SOURCE_HINT), _sources(lines, mode)).otherwise(F.array().cast(SOURCE))
    row = F.struct(found.alias("sources"), _sinks(lines).alias("sinks"), _checks(lines).alias("checks"), _definitions(lines).alias("definitions"))
    return with_lines(files).select(*FILE, let(row, facts).alias("f")).select(*FILE, "f.*")


def _uses(lines: Column, sinks: Column, stores: Column) -> Column:
    """Sinks whose line holds a property that a source is stored in."""
    found = lambda properties: F.transform(
        sinks, lambda k: F.struct(k.alias("k"), F.filter(properties, lambda p: F.contains(F.get(lines, k["line"] - 1), p)).alias("properties"))
    )
    return F.when(F.size(stores) > 0, let(F.array_distinct(F.transform(stores, lambda s: s["property"])), lambda p: F.filter(found(p), lambda u: F.size(u["properties"]) > 0)))


def _table(facts: DataFrame, column: str) -> DataFrame:
    return facts.select(*FILE, F.inline(column))


def _first_of_line(hits: DataFrame) -> DataFrame:
    """The hit of the first rule on each line."""
    others = [c for c in hits.columns if c not in FILE]
    least = F.min(F.struct("line", "rule", *[c for c in others if c not in ("line", "rule")])).alias("h")
    return hits.groupBy(*FILE, "line").agg(least).select(*FILE, "h.*")


# --- ranges -----------------------------------------------------------------------------------


def with_segments(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Add ``seg``, the number of check lines before a row's ``line``: no check stands between two rows of one segment.

    Sums of ranges of RANGE lines come first, so a file of any length is many keys.
    """
    part = F.floor(F.col("line") / RANGE)
    marked = rows.withColumn("_check", F.lit(0)).unionByName(checks.select(*FILE, F.col("line_number").alias("line"), F.lit(1).alias("_check")), allowMissingColumns=True)
    marked = marked.withColumn("_part", part)
    before = Window.partitionBy(*FILE).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = marked.groupBy(*FILE, "_part").agg(F.sum("_check").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*FILE, "_part").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    summed = marked.withColumn("_inside", F.coalesce(F.sum("_check").over(inside), F.lit(0))).filter("_check = 0")
    return summed.join(ahead, [*FILE, "_part"]).withColumn("seg", F.col("_ahead") + F.col("_inside")).drop("_check", "_part", "_ahead", "_inside")


def _soon_after(rows: DataFrame, points: DataFrame, window: int) -> DataFrame:
    """Pairs of a row and a point ``at`` of the same file and variable, one to ``window`` lines after the row's line.

    Lines are cut into ranges of the window's length, of which a row reaches two.
    """
    near = F.floor((F.col("line") + 1) / window)
    left = rows.withColumn("_near", F.explode(F.array(near, near + 1)))
    right = points.withColumn("_near", F.floor(F.col("at") / window))
    return left.join(right, [*FILE, "var", "_near"]).filter((F.col("at") > F.col("line")) & (F.col("at") <= F.col("line") + window)).drop("_near")


def _where(file: str | Column, line: Column) -> Column:
    return F.concat(F.lit(" ("), file, F.lit(":"), line.cast("string"), F.lit(")"))


# --- flows ------------------------------------------------------------------------------------


def intra_file_flows(files: DataFrame, mode: str = "compat") -> DataFrame:
    return file_flows(materialize(flow_facts(files, mode), "facts"))


def file_flows(facts: DataFrame) -> DataFrame:
    """Source and later sink in one file with no sanitizer line from the source on.

    They meet on the segment between two checks. A flow that passes a call of a function of the same file before its sink
    is titled and scored as such. One flow is kept per source and sink line.
    """
    held = facts.filter((F.size("sources") > 0) & (F.size("sinks") > 0))
    checks = _checked_lines(held)
    sources = _first_of_line(_table(held, "sources"))
    calls = _table(held, "mentions").filter("name is not null").select(*FILE, "line", "name", F.explode("vars").alias("var"))
    marks = calls.select(*FILE, "var", "line", F.struct("line", "name").alias("mark"))
    sources = with_next(with_segments(sources, checks), marks, [*FILE, "var"], "line", F.floor(F.col("line") / RANGE), "call")
    sinks = with_segments(_first_of_line(_table(held, "sinks")), checks)
    sinks = sinks.select(*FILE, "seg", F.struct("line", "rule", "kind", "weakness").alias("k"))
    flows = sources.select(*FILE, "seg", F.struct("line", "expr").alias("s"), "call").join(sinks, [*FILE, "seg"]).filter("k.line > s.line")
    via = F.col("call").isNotNull() & (F.col("call.line") <= F.col("k.line"))
    path = F.col("file_path")
    trace = F.concat(
        "s.expr", _where(path, F.col("s.line")), F.lit(" -> "),
        F.when(via, F.concat("call.name", F.lit("()"), _where(path, F.col("call.line")), F.lit(" -> "))).otherwise(""),
        "k.kind", _where(path, F.col("k.line")),
    )
    tail = F.when(via, " — Taint Propagated Through Function Call").otherwise(" — Unsanitized Data Flow")
    return flows.select(
        "repo", "file_path",
        finding(
            F.col("s.line"), "Critical", "Security", F.concat(F.lit("Proven "), "k.weakness", tail),
            F.concat(F.lit("Flow: "), trace), "Check the input between source and sink.", "Medium",
            F.when(via, 92).otherwise(85), trace,
        ).alias("f"),
        F.col("k.line").alias("sink_line"), via.alias("via_call"),
    ).select("repo", "file_path", "f.*", "sink_line", "via_call")


def _checked_lines(facts: DataFrame) -> DataFrame:
    return facts.select(*FILE, F.explode("checks").alias("line_number"))


def flows_via_local_call(files: DataFrame, mode: str = "compat") -> DataFrame:
    return intra_file_flows(files, mode).filter(F.col("via_call"))


def cross_file_flows(files: DataFrame, mode: str = "compat", calls: str = "identifier") -> DataFrame:
    return call_flows(materialize(flow_facts(files, mode), "facts"), calls)


def _counted(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with the number of rows that share ``by``."""
    return rows.withColumn(name, F.count("*").over(Window.partitionBy(*by)))


def _asked_names(asked: DataFrame, names: DataFrame, calls_by: str) -> DataFrame:
    """Calls of the functions named: a row per source line and name, with the number of names of the line."""
    if calls_by == "identifier":
        held = asked.withColumnRenamed("word", "name").join(names, ["repo", "name"], "left_semi")
    else:
        words = asked.select("repo", "word").distinct().withColumn("key", F.explode(pieces(F.col("word"), NAME_KEY)))
        met = words.join(names.withColumn("key", key(F.col("name"), NAME_KEY)), ["repo", "key"])
        # The key is the whole name up to its width; longer names are checked on the identifier.
        met = met.filter((F.length("name") <= NAME_KEY) | F.contains("word", F.col("name"))).select("repo", "word", "name")
        held = asked.join(met, ["repo", "word"]).groupBy("repo", "src_file", "src_line", "name").agg(F.min("s").alias("s"))
    return _counted(held, ["repo", "src_file", "src_line"], "_names")


def call_flows(facts: DataFrame, calls_by: str) -> DataFrame:
    """A call near a source of a function defined in another file that reaches a sink.

    ``identifier``: the call line holds the function's name as a whole identifier;
    calls and definitions meet on (repo, name), one row per identifier of a line.
    ``substring``: the name may stand anywhere inside an identifier. Distinct identifiers
    and names meet on (repo, first letters of the name), an identifier gives its pieces,
    and longer names are then checked on it. A function reaches the sinks after it in its
    segment. Findings are as many as sources and sinks that meet on a name, and are dealt
    over tasks in pairs of blocks.
    """
    sources = _table(facts.filter(F.size("sources") > 0), "sources")
    mentions = _table(facts.filter(F.size("sources") > 0), "mentions").filter("words is not null")
    points = mentions.select(*FILE, F.col("line").alias("at"), "words", F.explode("vars").alias("var"))
    calls = _soon_after(sources, points, taint.CALL_WINDOW).select(
        "repo", F.col("file_path").alias("src_file"), F.col("line").alias("src_line"), F.col("at").alias("call_line"),
        F.col("rule").alias("src_rule"), "expr", F.explode("words").alias("word"),
    )
    # Of the calls of a name near a source the first is kept here, of its definitions before a sink the first below.
    asked = calls.groupBy("repo", "src_file", "src_line", "word").agg(F.min(F.struct("src_rule", "call_line", "expr")).alias("s"))

    able = facts.filter((F.size("definitions") > 0) & (F.size("sinks") > 0))
    checks = _checked_lines(able)
    defined = with_segments(_table(able, "definitions"), checks).select("repo", F.col("file_path").alias("def_file"), "name", F.col("line").alias("def_line"), "seg")
    # Exported names stand at line 0, and only functions with a sink after them in their segment count.
    sinks = with_segments(_table(able, "sinks"), checks).select("repo", F.col("file_path").alias("def_file"), "seg", F.struct("line", "rule", "kind", "weakness").alias("k"))
    last = sinks.groupBy("repo", "def_file", "seg").agg(F.max("k.line").alias("_last"))
    reach = defined.join(last, ["repo", "def_file", "seg"]).filter(F.col("_last") > F.col("def_line")).drop("_last")
    reach = materialize(reach, "reach")
    asked = materialize(_asked_names(asked, reach.select("repo", "name").distinct(), calls_by), "asked")
    wanted = reach.join(asked.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    reached = wanted.join(sinks, ["repo", "def_file", "seg"]).filter(F.col("k.line") > F.col("def_line"))
    first = F.struct("def_line", F.col("k.rule").alias("sink_rule"), F.col("k.kind").alias("kind"), F.col("k.weakness").alias("weakness"))
    reached = reached.groupBy("repo", "def_file", F.col("k.line").alias("sink_line"), "name").agg(F.min(first).alias("d"))
    reached = materialize(_counted(reached, ["repo", "def_file", "sink_line"], "_sink_names"), "reached")
    choice = F.struct("s.src_rule", "s.call_line", "name", "d.def_line", "d.sink_rule", "s.expr", "d.kind", "d.weakness").alias("c")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        pairs = each_pair(left, right, ["repo", "name"]).filter(F.col("src_file") != F.col("def_file"))
        return pairs.select("repo", F.col("src_file").alias("file_path"), "src_line", "def_file", "sink_line", choice, "_names", "_sink_names")

    # A source and a sink line that could meet on several names are compared; all others meet once, and their pairs, which are
    # as many as the findings, are not shuffled.
    once = met(asked, reached).filter((F.col("_names") == 1) | (F.col("_sink_names") == 1)).drop("_names", "_sink_names")
    several = met(asked.filter("_names > 1"), reached.filter("_sink_names > 1"))
    several = several.groupBy("repo", "file_path", "src_line", "def_file", "sink_line").agg(F.min("c").alias("c"))
    flows = once.unionByName(several)
    trace = F.concat(
        "c.expr", _where(F.col("file_path"), F.col("src_line")), F.lit(" -> "), "c.name", F.lit("()"),
        _where(F.col("def_file"), F.col("c.def_line")), F.lit(" -> "), "c.kind", _where(F.col("def_file"), F.col("sink_line")),
    )
    return flows.select(
        "repo", "file_path",
        finding(
            F.col("src_line"), "Critical", "Security", F.concat(F.lit("Cross-File "), "c.weakness", F.lit(" — Taint via Function Export")),
            F.concat(F.lit("Flow: "), trace), "Check the input where the function begins.", "Hard", 75, trace,
        ).alias("f"),
        F.col("def_file").alias("target_file"), "sink_line", F.col("c.name").alias("function_name"),
    ).select("repo", "file_path", "f.*", "target_file", "sink_line", "function_name")


def property_taint(files: DataFrame, mode: str = "compat") -> DataFrame:
    return property_flows(materialize(flow_facts(files, mode), "facts"))


def property_flows(facts: DataFrame) -> DataFrame:
    """Input stored in a property soon after its source and used in a sink."""
    held = facts.filter((F.size("uses") > 0))
    checks = _checked_lines(held)
    points = _table(held, "stores").withColumnRenamed("line", "at").distinct()
    stored = _soon_after(_table(held, "sources"), points, taint.PROPERTY_WINDOW)
    stored = stored.select(*FILE, F.col("line").alias("src_line"), F.col("rule").alias("rule"), F.col("at").alias("line"), "expr", "property")
    used = _table(held, "uses").select(*FILE, F.col("k.line").alias("line"), "k", F.explode("properties").alias("property"))
    used = with_segments(used, checks).select(*FILE, "seg", "property", "k")
    choice = F.struct(
        "src_line", "rule", F.col("line").alias("at"), F.col("k.rule").alias("sink_rule"),
        "expr", F.col("k.kind").alias("kind"), F.col("k.weakness").alias("weakness"),
    )
    flows = (
        with_segments(stored, checks).join(used, [*FILE, "property", "seg"]).filter("k.line >= line")
        .groupBy("repo", "file_path", "property", F.col("k.line").alias("sink_line"))
        .agg(F.min(choice).alias("c"))
    )
    path = F.col("file_path")
    trace = F.concat(
        "c.expr", _where(path, F.col("c.src_line")), F.lit(" -> "), "property", _where(path, F.col("c.at")),
        F.lit(" -> "), "c.kind", _where(path, F.col("sink_line")),
    )
    return flows.select(
        "repo", "file_path",
        finding(
            F.col("c.src_line"), "Critical", "Security", F.concat(F.lit("Property Taint "), "c.weakness"),
            F.concat(F.lit("Flow: "), trace), "Check the input before it is stored or used.", "Medium", 80, trace,
        ).alias("f"),
        "property", "sink_line",
    ).select("repo", "file_path", "f.*", "property", "sink_line")
