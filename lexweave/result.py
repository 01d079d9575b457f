"""Results with the options they were made with."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("status", "message", "node", "windowsize", "minfreq", "metric", "metrics", "top_n", "analysis_type")
NOT_METRICS = {"Node", "Collocate", "Frequency", "DocFrequency", "Period", "Group", "Rank"}


@dataclass
class Result:
    """A DataFrame and a note about it."""

    df: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)

    def metadata(self) -> dict[str, Any]:
        """The known keys of the note."""
        return {k: self.meta[k] for k in KEYS if k in self.meta}

    @property
    def metric(self) -> str:
        if "metric" in self.meta:
            return str(self.meta["metric"])
        if self.meta.get("metrics"):
            return ", ".join(map(str, self.meta["metrics"]))
        return "Unknown"

    def summary(self) -> str:
        m = self.meta
        return f"Analysis of '{m.get('node', 'Unknown')}' using {self.metric} (window={m.get('windowsize', '?')}, minfreq={m.get('minfreq', '?')})"

    def status(self) -> str:
        """``ok``, or ``empty`` if there are no rows (runs a small job)."""
        return "empty" if self.df.isEmpty() else "ok"

    def with_df(self, df: DataFrame, **notes: Any) -> Result:
        return Result(df, self.meta | notes)

    def show(self, n: int = 20) -> None:
        print(self.summary())
        self.df.show(n, truncate=False)


def metric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.name not in NOT_METRICS and f.dataType.typeName() == "double"]


def filter_scores(result: Result, min_score: float, metric: str | None = None) -> Result:
    """Rows whose score is at least ``min_score``; by default of the first metric column."""
    if metric is None:
        found = metric_columns(result.df)
        if not found:
            raise ValueError("no metric column")
        metric = found[0]
    if metric not in result.df.columns:
        raise ValueError(f"no column {metric!r}")
    return result.with_df(result.df.filter(F.col(metric) >= min_score), filtered=True, min_score_threshold=min_score, filter_column=metric)


def combine_results(results: list[Result]) -> Result:
    """All rows, columns by name, nulls where a result lacks one."""
    if not results:
        raise ValueError("nothing to combine")
    df = results[0].df
    for r in results[1:]:
        df = df.unionByName(r.df, allowMissingColumns=True)
    meta = dict(results[0].meta)
    meta |= {
        "combined_nodes": list(dict.fromkeys(r.meta["node"] for r in results if "node" in r.meta)),
        "combined_metrics": list(dict.fromkeys(r.metric for r in results if r.metric != "Unknown")),
        "n_sources": len(results),
    }
    return Result(df, meta)
