"""Column helpers for paths, lines and match positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks the start of a match while its line number is looked up; a control
# character that no pattern in the catalogues names.
MARK = "\u0001"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain column used inside a lambda may be inlined there and recomputed for
    every element; a lambda argument is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def sql_value(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(sql_value(v) for v in value) + ")"
    return "null" if value is None else str(value)


def constant_table(rows: list[tuple], names: list[str]) -> Column:
    """A small fixed table as one constant ``array<struct>`` column."""
    structs = (
        "named_struct(" + ", ".join(f"'{n}', {sql_value(v)}" for n, v in zip(names, row)) + ")" for row in rows
    )
    return F.expr("array(" + ", ".join(structs) + ")")


def constant_map(pairs: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_value(k)}, {sql_value(v)}" for k, v in pairs.items()) + ")")


def split_lines(content: Column) -> Column:
    """Lines of a text; a trailing newline gives a last empty line."""
    return F.split(content, "\n", -1)


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line with 1-based ``line_number``; only ``keep`` columns ride along."""
    cols = keep or ("repo", "file_path")
    return files.select(*cols, F.posexplode(split_lines(F.col("content"))).alias("pos", "line")).select(
        *cols, (F.col("pos") + 1).alias("line_number"), "line"
    )


def not_blank(line: Column) -> Column:
    return line.rlike(r"\S")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last dot suffix of the file name, case kept, empty when there is none."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last dot suffix."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def occurrences(text: Column, token: str) -> Column:
    """How often a one-character token occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))


def brace_delta(text: Column) -> Column:
    """Opening minus closing braces."""
    return occurrences(text, "{") - occurrences(text, "}")


def first_lines(flags: Column) -> Column:
    """1-based positions of the true entries of a boolean array."""
    return F.array_compact(F.transform(flags, lambda hit, i: F.when(hit, i + 1)))


def match_lines(content: Column, pattern: str, *needles: str, marked: str = MARK + "$0") -> Column:
    """Line number of the start of every match, one array entry per match.

    Each match is prefixed with a mark, the marked text is split into lines and
    the marks per line are counted, so the cost stays linear in the text. Texts
    without any of the ``needles``, of which every match holds one, are not searched.
    ``marked`` is what replaces a match, if the mark belongs inside it.
    """
    clean = F.translate(content, MARK, "\u0002")
    marked = F.split(F.regexp_replace(clean, pattern, marked), "\n", -1)
    per_line = F.transform(marked, lambda l, i: F.array_repeat(i + 1, occurrences(l, MARK)))
    near = reduce(lambda a, b: a | b, [content.contains(n) for n in needles])
    return F.when(near, F.flatten(per_line)).otherwise(
        F.array().cast("array<int>")
    )
