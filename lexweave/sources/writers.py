"""Exports: single files with their notes, concordances, graphs and batches of nodes."""

from __future__ import annotations

import csv
import json
import logging
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..operators.kwic import Concordance
from ..operators.network import Network
from ..result import Result
from .readers import read_nodes


def _rows_to_csv(df: DataFrame, path: Path, sep: str = ",", header: Iterable[str] = ()) -> None:
    """One file, a partition at a time through the driver; for tables that may be large use ``df.write``."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as f:
        for line in header:
            f.write(line + "\n")
        out = csv.writer(f, delimiter=sep, lineterminator="\n")
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if x is None else x for x in row])


def export_with_metadata(result: Result, path: str, format: str = "csv") -> str:
    """One file with the result's note: as ``# key: value`` lines before CSV, or in JSON as ``{metadata, columns, data}``."""
    target = Path(path).expanduser()
    if format == "csv":
        _rows_to_csv(result.df, target, header=[f"# {k}: {json.dumps(v, ensure_ascii=False, default=str)}" for k, v in result.meta.items()])
    elif format == "json":
        target.parent.mkdir(parents=True, exist_ok=True)
        rows = [r.asDict(recursive=True) for r in result.df.toLocalIterator()]
        target.write_text(json.dumps({"metadata": result.meta, "columns": result.df.columns, "data": rows}, ensure_ascii=False, default=str), encoding="utf-8")
    else:
        raise ValueError(f"format must be 'csv' or 'json': {format!r}")
    return str(target)


def write_with_metadata(result: Result, path: str, format: str = "parquet", mode: str = "errorifexists") -> str:
    """The same for results of any size: a folder that the tasks write, and a note ``_metadata.json`` as a table beside it."""
    result.df.write.format(format).mode(mode).save(path)
    spark = result.df.sparkSession
    spark.createDataFrame([(json.dumps(result.meta, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode(mode).text(f"{path.rstrip('/')}_metadata.json")
    return path


def export_kwic(conc: Concordance, path: str, format: str = "csv") -> str:
    """The lines as csv, tsv or xlsx (which has a sheet of statistics, and falls back to csv where it can't be written)."""
    target = Path(path).expanduser()
    if format == "xlsx":
        try:
            from openpyxl import Workbook
        except ImportError:
            logging.getLogger(__name__).warning("xlsx can't be written here; csv is written instead")
            return export_kwic(conc, str(target.with_suffix(".csv")), "csv")
        target.parent.mkdir(parents=True, exist_ok=True)
        book = Workbook()
        for sheet, df in ((book.active, conc.lines), (book.create_sheet("Statistics"), conc.statistics)):
            sheet.append(df.columns)
            for row in df.toLocalIterator():
                sheet.append(list(row))
        book.active.title = "Concordance"
        book.save(target)
    elif format in ("csv", "tsv"):
        _rows_to_csv(conc.lines, target, "," if format == "csv" else "\t")
    else:
        raise ValueError(f"format must be 'csv', 'tsv' or 'xlsx': {format!r}")
    return str(target)


def gephi_graph(network: Network, nodes_file: str, edges_file: str) -> tuple[str, str]:
    """Nodes (Id, Label and their figures) and edges as two CSV files."""
    spark = network.edges.sparkSession
    ids = spark.createDataFrame([(i + 1, n) for i, n in enumerate(network.nodes)], "Id long, Label string")
    nodes = ids.join(network.node_metrics.withColumnRenamed("Node", "Label"), "Label", "left").orderBy("Id")
    nodes = nodes.select("Id", "Label", *[c for c in nodes.columns if c not in ("Id", "Label")])
    _rows_to_csv(nodes, Path(nodes_file).expanduser())
    _rows_to_csv(network.edges, Path(edges_file).expanduser())
    return nodes_file, edges_file


def batch_process_corpus(corpus: Corpus, node_file: str, out_dir: str, metrics: Sequence[str] = ("PMI", "LogDice", "LLR"), windowsize: int = 5, minfreq: int = 5, batch_size: int = 100, top_n: int | None = 100) -> DataFrame:
    """Scores of all nodes of a file, written by batch as Parquet (``batch=N``) and, together, as ``all_batches_combined.csv``.

    A batch is one pass over the corpus whatever its number of nodes.
    """
    if batch_size <= 0:
        raise ValueError(f"batch_size must be positive: {batch_size}")
    nodes = corpus.nodes(read_nodes(corpus.spark, node_file))
    root = Path(out_dir).expanduser()
    path = f"{root}/batches"
    for i in range(0, len(nodes), batch_size):
        result = corpus.analyze_nodes(nodes[i : i + batch_size], list(metrics), windowsize, minfreq, top_n).df
        result.write.mode("overwrite").parquet(f"{path}/batch={i // batch_size + 1}")
    if not nodes:
        raise ValueError(f"no node in {node_file}")
    whole = corpus.spark.read.parquet(path)
    _rows_to_csv(whole.orderBy("batch", "Node", F.desc(list(metrics)[0]), "Collocate"), root / "all_batches_combined.csv")
    return whole
