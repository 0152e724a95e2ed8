"""A small HTML report of a run: bounded tables only."""

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(df: DataFrame, label: str, count: str, most: int = 30) -> list[tuple[str, int, int]]:
    """(label, count, width of 100) of the ``most`` largest rows."""
    rows = df.orderBy(F.desc(count), label).limit(most).collect()
    top = max((r[count] for r in rows), default=0)
    return [(str(r[label]), r[count], r[count] * 100 // top if top else 0) for r in rows]


def write_report(path: str, title: str, nodes: DataFrame, edges: DataFrame, metrics: DataFrame, most: int = 500) -> None:
    """Distributions of node types and relations, metrics, and the heaviest edges."""
    def block(name: str, rows: list[tuple]) -> str:
        body = "".join(f"<tr><td>{html.escape(a)}</td><td>{b}</td><td><div style='background:#48c;height:.8em;width:{w}px'></div></td></tr>" for a, b, w in rows)
        return f"<h2>{name}</h2><table>{body}</table>"

    kinds = bars(nodes.groupBy("group").agg(F.count("*").alias("n")), "group", "n")
    labels = bars(edges.groupBy("label").agg(F.sum("value").alias("n")), "label", "n")
    figures = "".join(f"<tr><td>{html.escape(r['metric'])}</td><td>{r['value']:g}</td></tr>" for r in metrics.limit(200).collect())
    heavy = "".join(f"<tr><td>{html.escape(r['from'])}</td><td>{html.escape(r['label'] or '')}</td><td>{html.escape(r['to'])}</td><td>{r['value']}</td></tr>" for r in edges.orderBy(F.desc("value"), "label", "from", "to").limit(most).collect())
    page = f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{block('Nodes', kinds)}{block('Relations', labels)}<h2>Metrics</h2><table>{figures}</table><h2>Edges</h2><table>{heavy}</table>"
    Path(path).write_text(page, encoding="utf-8")
