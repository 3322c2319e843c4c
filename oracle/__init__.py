"""DuckDB statements that compute the registered queries independently."""

from __future__ import annotations


def all_statements() -> dict[str, str]:
    from oracle import corpus, dataflow, dependencies, forensics, history, hygiene, performance, quality, scoring, streams

    out: dict[str, str] = {}
    for part in (corpus, quality, performance, dependencies, hygiene, dataflow, forensics, scoring, history, streams):
        out.update(part.statements())
    # Files cut into slices have the rows of whole ones.
    out |= {f"{name}_sliced": out[name] for name in ("method_metrics", "loop_context", "nesting_depth")}
    return out
