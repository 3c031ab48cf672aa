"""Thin figures: bars and scatter plots of small tables as SVG, without a plotting library."""

from __future__ import annotations

import math
from collections.abc import Sequence
from html import escape
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, LEFT, LOW, TOP = 720, 420, 70, 90, 30
COLOURS = ["#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#777777"]
#: Rows of a figure that are drawn one by one, and cells of a grid, by width and height, that stand for more points.
MOST, GRID = 2_000, (120, 80)


def _page(title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11">'
    return "\n".join([head, f'<text x="{WIDTH / 2}" y="18" text-anchor="middle" font-size="14">{escape(title)}</text>', *body, "</svg>", ""])


def _scale(values: Sequence[float], low: float, high: float, log: bool = False):
    f = math.log10 if log else float
    a, b = min(map(f, values)), max(map(f, values))
    return (lambda v: low + (f(v) - a) / (b - a) * (high - low)) if b > a else (lambda v: (low + high) / 2)


def _ticks(a: float, b: float, log: bool = False) -> list[float]:
    if log:
        return [10.0**k for k in range(math.ceil(math.log10(a)), math.floor(math.log10(b)) + 1)] or [a, b]
    step = 10 ** math.floor(math.log10((b - a) / 4)) if b > a else 1
    step *= next(m for m in (1, 2, 5, 10) if (b - a) / (step * m) <= 6) if b > a else 1
    return [k * step for k in range(math.ceil(a / step), math.floor(b / step) + 1)]


#: Areas of the smallest and the largest bubble.
BUBBLES = (25.0, 220.0)


def bubble_sizes(values: Sequence[float | None]) -> list[float]:
    """Areas by the square root of values, a missing one as the median; equal values lie in the middle, none at all are smallest."""
    told = sorted(v for v in values if v is not None and math.isfinite(v))
    if not told:
        return [BUBBLES[0]] * len(values)
    root = lambda v: math.sqrt(max(0.0, v if v is not None and math.isfinite(v) else median(told)))
    roots = [root(v) for v in values]
    scale = _scale(roots, *BUBBLES)
    return [scale(r) for r in roots]


def leader(df: DataFrame, value: str, label: str) -> str | None:
    """The label of the largest value, of equal ones the first by name; what a text says of a table."""
    row = df.where(df[value].isNotNull()).agg(F.min(F.struct(-F.col(value), F.col(label).alias("label"))).alias("m")).first()
    return row.m.label if row.m else None


def bars(df: DataFrame, label: str, value: str, title: str, spread: str | None = None) -> str:
    """A bar for each row, with whiskers of `spread`; null values are left out, an empty table is a placeholder.  The title tells of bars beyond `MOST`."""
    told = df.where(df[value].isNotNull())
    rows = told.limit(MOST).collect()
    if len(rows) == MOST and (n := told.count()) > MOST:
        title = f"{title} (first {MOST} of {n})"
    if not rows:
        return _page(title, [f'<text x="{WIDTH / 2}" y="{HEIGHT / 2}" text-anchor="middle">no data</text>'])
    top = max(r[value] + ((r[spread] or 0) if spread else 0) for r in rows)
    y = _scale([0.0, max(top, 1e-9)], HEIGHT - LOW, TOP)
    width = (WIDTH - LEFT - 20) / len(rows)
    body = [f'<line x1="{LEFT}" x2="{WIDTH - 20}" y1="{y(t):.1f}" y2="{y(t):.1f}" stroke="#ddd"/><text x="{LEFT - 6}" y="{y(t) + 4:.1f}" text-anchor="end">{t:g}</text>' for t in _ticks(0, top)]
    for k, r in enumerate(rows):
        x, v = LEFT + width * (k + 0.15), r[value]
        body.append(f'<rect x="{x:.1f}" y="{y(v):.1f}" width="{width * 0.7:.1f}" height="{max(0, y(0) - y(v)):.1f}" fill="{COLOURS[0]}"><title>{escape(str(r[label]))}: {v:.3f}</title></rect>')
        if spread and r[spread] is not None:
            m = x + width * 0.35
            body.append(f'<line x1="{m:.1f}" x2="{m:.1f}" y1="{y(max(0, v - r[spread])):.1f}" y2="{y(v + r[spread]):.1f}" stroke="#222"/>')
        if len(rows) <= 60:
            body.append(f'<text transform="translate({x + width * 0.4:.1f},{HEIGHT - LOW + 12}) rotate(40)">{escape(str(r[label]))[:24]}</text>')
    return _page(title, body)


def scatter(df: DataFrame, x: str, y: str, title: str, group: str | None = None, log_x: bool = False) -> str:
    """A point for each row with both values (on a log axis, positive ones), coloured by group; of more than `MOST`, for each cell of a grid and group that has any."""
    told = df.where(df[x].isNotNull() & df[y].isNotNull() & (df[x] > 0 if log_x else F.lit(True))).select(x, y, *([group] if group else []))
    rows = told.limit(MOST + 1).collect()
    if len(rows) > MOST:
        bounds = told.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d")).first()
        line = (lambda c: F.log10(c)) if log_x else (lambda c: c)
        cell = lambda v, low, high, n: F.floor((v - low) / F.greatest(high - low, F.lit(1e-12)) * (n - 1))
        cells = [cell(line(F.col(x)), line(F.lit(bounds.a)), line(F.lit(bounds.b)), GRID[0]).alias("i"), cell(F.col(y), F.lit(bounds.c), F.lit(bounds.d), GRID[1]).alias("j")]
        rows = told.groupBy(*cells, *([group] if group else [])).agg(F.avg(x).alias(x), F.avg(y).alias(y)).collect()
    if not rows:
        return _page(title, [f'<text x="{WIDTH / 2}" y="{HEIGHT / 2}" text-anchor="middle">no data</text>'])
    xs, ys = [r[x] for r in rows], [r[y] for r in rows]
    px, py = _scale(xs, LEFT, WIDTH - 20, log_x), _scale(ys, HEIGHT - LOW, TOP)
    names = sorted({str(r[group]) for r in rows}) if group else []
    colour = lambda r: COLOURS[names.index(str(r[group])) % len(COLOURS)] if group else COLOURS[0]
    body = [f'<text x="{px(t):.1f}" y="{HEIGHT - LOW + 16}" text-anchor="middle">{t:g}</text>' for t in _ticks(min(xs), max(xs), log_x)]
    body += [f'<line x1="{LEFT}" x2="{WIDTH - 20}" y1="{py(t):.1f}" y2="{py(t):.1f}" stroke="#ddd"/><text x="{LEFT - 6}" y="{py(t) + 4:.1f}" text-anchor="end">{t:g}</text>' for t in _ticks(min(ys), max(ys))]
    body += [f'<circle cx="{px(r[x]):.1f}" cy="{py(r[y]):.1f}" r="4" fill="{colour(r)}" fill-opacity="0.7"/>' for r in rows]
    body += [f'<text x="{LEFT + 90 * (k % 7)}" y="{HEIGHT - 40 + 14 * (k // 7)}" fill="{COLOURS[k % len(COLOURS)]}">{escape(n)[:14]}</text>' for k, n in enumerate(names[:21])]
    body += [f'<text x="{(LEFT + WIDTH) / 2}" y="{HEIGHT - 56}" text-anchor="middle">{escape(x)}</text>', f'<text transform="translate(16,{HEIGHT / 2}) rotate(-90)" text-anchor="middle">{escape(y)}</text>']
    return _page(title, body)


def of_analysis(made: dict[str, DataFrame]) -> dict[str, str]:
    """The figures of an analysis, by file name; those whose tables are missing are left out."""
    wanted = {
        "01_input_strategies.svg": ("input_summary", lambda t: bars(t.orderBy("input_strategy"), "input_strategy", "mean_NRS", "Mean NRS by input strategy", "ci95_NRS")),
        "02_prompt_strategies.svg": ("prompt_summary", lambda t: bars(t.orderBy("prompt_strategy"), "prompt_strategy", "mean_NRS", "Mean NRS by prompt strategy", "ci95_NRS")),
        "03_failure_rates.svg": ("input_summary", lambda t: bars(t.orderBy("input_strategy"), "input_strategy", "failure_rate", "Failure rate by input strategy")),
        "04_models.svg": ("model_summary", lambda t: bars(t.orderBy(t.mean_NRS.desc()).limit(30), "model", "mean_NRS", "Best models")),
        "05_quality_and_runtime.svg": ("configuration_summary", lambda t: scatter(t, "mean_runtime_seconds", "mean_NRS", "Quality and runtime", "input_strategy", True)),
        "06_quality_and_size.svg": ("model_summary", lambda t: scatter(t, "parameters_b", "mean_NRS", "Quality and size", None, True)),
        "07_frontier.svg": ("pareto_frontier", lambda t: scatter(t, "mean_runtime_seconds", "mean_NRS", "Configurations that none beats", "input_strategy", True)),
        "08_size_bins.svg": ("size_bin_summary", lambda t: bars(t, "size_bin", "mean_NRS", "Mean NRS by size", "sd_NRS")),
        "09_quality_loss.svg": ("quality_loss", lambda t: bars(t, "threshold", "NRS_loss_vs_global_best", "Loss under a size limit")),
        "10_case_difficulty.svg": ("case_difficulty_ranking", lambda t: bars(t.orderBy("rank"), "case_study", "difficulty_score", "Difficulty of cases")),
        "11_case_stability.svg": ("case_stability_summary", lambda t: bars(t.orderBy("case_study"), "case_study", "stability_score", "Stability of cases")),
    }
    return {name: draw(made[table]) for name, (table, draw) in wanted.items() if table in made}
