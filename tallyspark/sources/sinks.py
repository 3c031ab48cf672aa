"""Where results go: tables as Parquet and CSV, small ones as LaTeX and Markdown, JSON summaries, bundles."""

from __future__ import annotations

import json
import math
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table is fetched for a report.
REPORT_ROWS = 10_000
# The tables of a store, in the order that their exports are sorted by.
STORE = {
    "responses": ["id"], "chunks": ["id"], "summaries": ["level", "id"], "summary_inputs": ["summary_id", "input_id"], "assignments": ["chunk_id", "theme_id"], "unassigned": ["chunk_id"],
    "revisions": ["theme_id", "level", "position"], "paragraphs": ["theme_id", "position"],
}


def write_tables(tables: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("parquet", "csv")) -> dict[str, str]:
    """Each table below `folder`, named by its key.  CSV is one file: tables of a report are small."""
    out = {}
    for name, df in tables.items():
        for f in formats:
            path = f"{folder}/{f}/{name}"
            (df.coalesce(1).write.option("header", "true") if f == "csv" else df.write).mode("overwrite").format(f).save(path)
            out[f"{name}.{f}"] = path
    return out


def export_store(tables: dict[str, DataFrame], folder: str) -> None:
    """JSON lines of a store's tables, sorted by their keys."""
    for name, df in tables.items():
        df.orderBy(*[c for c in STORE.get(name, df.columns[:1]) if c in df.columns]).write.mode("errorifexists").json(f"{folder}/{name}")


def _rows(df: DataFrame) -> tuple[list[str], list[list]]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a table of over {REPORT_ROWS} rows is none for a report")
    return df.columns, [list(r) for r in rows]


def _said(x) -> str:
    return "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)


def latex(df: DataFrame) -> str:
    names, rows = _rows(df)
    safe = lambda s: "".join({"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}.get(c, c) for c in s)
    line = lambda cells: " & ".join(safe(_said(c)) for c in cells) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(names)}}}", r"\toprule", line(names), r"\midrule", *map(line, rows), r"\bottomrule", r"\end{tabular}", ""])


def markdown(df: DataFrame) -> str:
    names, rows = _rows(df)
    line = lambda cells: "| " + " | ".join(_said(c).replace("|", r"\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *map(line, rows), ""])


def html(df: DataFrame) -> str:
    from html import escape

    names, rows = _rows(df)
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape(_said(v))}</{tag}>" for v in values) + "</tr>"
    return "<table>\n" + "\n".join([cells("th", names), *[cells("td", r) for r in rows]]) + "\n</table>\n"


def strict(x):
    """A value for JSON: NaN and the infinities are null."""
    if isinstance(x, dict):
        return {str(k): strict(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [strict(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def write_json(value, path: str, exclusive: bool = False) -> None:
    """Written whole or not at all; `exclusive`: only if there is none."""
    target = Path(path)
    if exclusive and target.exists():
        raise FileExistsError(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(strict(value), f, ensure_ascii=False, allow_nan=False, indent=2, sort_keys=True)
    os.replace(temporary, target)


def publish(texts: dict[str, str], folder: str) -> list[str]:
    """Files that appear all together as far as a file system can: all are written aside, then renamed."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    staged = []
    for name, text in texts.items():
        handle, temporary = tempfile.mkstemp(dir=root)
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        staged.append((temporary, root / name))
    for temporary, target in staged:
        os.replace(temporary, target)
    return [str(t) for _, t in staged]


def bundle(folder: str, name: str = "analysis.zip") -> str:
    """A ZIP of all files below the folder, without itself."""
    root, out = Path(folder), Path(folder) / name
    out.unlink(missing_ok=True)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p != out:
                z.write(p, str(p.relative_to(root)))
    return str(out)


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, if no two rows have the same key."""
    if not df.groupBy(*keys).count().where(F.col("count") > 1).isEmpty():
        raise ValueError(f"rows with the same {', '.join(keys)}")
    return df
