"""Command line: analyze a folder or ZIP of run files, generate narratives from documents, reorganize Markdown, count words."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import functions as F

from tallyspark.functions.text import word_count
from tallyspark.operators.generation import Options, generate, reorganize
from tallyspark.operators.summaries import WEIGHTS
from tallyspark.plans import analysis
from tallyspark.session import session
from tallyspark.sources import documents, sinks
from tallyspark.sources.models import Served


def weights(text: str) -> dict[str, float]:
    """JSON, or five numbers in the order of the defaults."""
    if text.lstrip().startswith("{"):
        return {k: float(v) for k, v in json.loads(text).items()}
    values = [float(x) for x in text.split(",")]
    if len(values) != len(WEIGHTS):
        raise argparse.ArgumentTypeError(f"{len(WEIGHTS)} numbers are needed")
    return dict(zip(WEIGHTS, values, strict=True))


def read_pages(spark, paths: list[str]):
    pages = documents.pages(documents.discover(spark, paths))
    bad = pages.where("error IS NOT NULL").select("path", "error").limit(5).collect()
    if bad:
        raise SystemExit("\n".join(f"{r.path}: {r.error}" for r in bad))
    return pages


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallyspark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("source")
    a.add_argument("output")
    a.add_argument("--weights", type=weights, default=dict(WEIGHTS))
    a.add_argument("--input-order", type=lambda s: [x.strip() for x in s.split(",") if x.strip()])
    a.add_argument("--unzip-to", help="a folder that all executors can read")
    g = sub.add_parser("generate")
    g.add_argument("inputs", nargs="+")
    g.add_argument("--output", required=True)
    g.add_argument("--max-words", type=int)
    r = sub.add_parser("reorganize")
    r.add_argument("markdown")
    r.add_argument("--output", required=True)
    for p in (g, r):
        p.add_argument("--model", required=True)
        p.add_argument("--host")
    w = sub.add_parser("count-words")
    w.add_argument("inputs", nargs="+")
    o = parser.parse_args(argv)
    if o.command == "reorganize":
        sinks.publish({Path(o.output).name: reorganize(Served(o.model, o.host), Path(o.markdown).read_text(encoding="utf-8"))}, str(Path(o.output).parent))
        return
    spark = session()
    if o.command == "analyze":
        options = analysis.Options(weights=o.weights, **({"input_order": o.input_order} if o.input_order else {}))
        print(json.dumps(sinks.strict(analysis.run_analysis(spark, o.source, o.output, options, o.unzip_to)), ensure_ascii=False))
    elif o.command == "generate":
        texts = read_pages(spark, o.inputs).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
        numbered = texts.withColumn("doc_id", F.pmod(F.xxhash64("document_id"), F.lit(10**12)))
        run = generate(spark, Served(o.model, o.host), numbered, f"{o.output}/run", Options(max_words=o.max_words))
        titles = {t["id"]: t["title"] for t in run.themes}
        sinks.publish({f"{k}.md": f"# {titles[k]}\n\n{t}\n" for k, t in run.narratives.items()}, o.output)
    else:
        for row in read_pages(spark, o.inputs).groupBy("name").agg(F.sum(word_count(F.col("text"))).alias("words"), F.sum(F.length("text")).alias("characters")).orderBy("name").toLocalIterator():
            print(row.name, row.words, row.characters, sep="\t")


if __name__ == "__main__":
    main()
