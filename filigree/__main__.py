"""Command line: python -m filigree FOLDER build|ingest|search|answer|items|evaluate ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from filigree.plans.engine import Engine
from filigree.runtime import session
from filigree.settings import Settings
from filigree.sources import files


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="filigree")
    ap.add_argument("folder", help="tables of the engine")
    sub = ap.add_subparsers(dest="do", required=True)
    for name in ("build", "ingest"):
        p = sub.add_parser(name)
        p.add_argument("--manifest", required=True)
        p.add_argument("--texts", required=True)
    sub.choices["build"].add_argument("--companies")
    sub.choices["ingest"].add_argument("--files", nargs="*")
    sub.choices["ingest"].add_argument("--dry-run", action="store_true")
    for name in ("search", "answer"):
        sub.add_parser(name).add_argument("question")
    p = sub.add_parser("items")
    p.add_argument("--items", required=True)
    p.add_argument("--synthetic", type=int, default=10)
    p = sub.add_parser("evaluate")
    p.add_argument("--items", required=True)
    p.add_argument("--types", nargs="*")
    p.add_argument("--limit", type=int)
    p.add_argument("--no-judge", action="store_true")
    p.add_argument("--results", required=True)
    p.add_argument("--summary")
    a = ap.parse_args(argv)
    spark = session()
    engine = Engine(spark, a.folder, Settings.from_env(dotenv=".env"))
    if a.do in ("build", "ingest"):
        raw = files.whole_texts(spark, a.texts, files.manifest(spark, a.manifest))
        if a.do == "build":
            engine.build(raw, files.read_companies(spark, a.companies) if a.companies else None)
            engine.coverage().groupBy("form", "period_end_src", "status").count().show()
        elif a.dry_run:
            engine.chunked(raw, a.files).groupBy("file", "section").count().orderBy("file", "section").show(1000, False)
        else:
            print("embedded {}, deleted {}".format(*engine.ingest(raw, a.files)))
    elif a.do == "search":
        found = engine.retrieve([a.question])
        found.hits.select("ticker", "id", F.round("rrf", 5).alias("rrf"), "dense_rank", "bm25_rank", F.substr("text", F.lit(1), F.lit(160)).alias("text")).orderBy("ticker", "place").show(100, False)
        found.gaps.show(100, False)
    elif a.do == "answer":
        print(json.dumps(engine.answer([a.question])[0].first().asDict(), indent=1, ensure_ascii=False))
    elif a.do == "items":
        files.write_items(engine.eval_set(a.synthetic), a.items)
    else:
        from filigree.operators.evaluation import first_of_each

        items = files.read_items(spark, a.items)
        items = first_of_each(items, a.limit or 1 << 30, a.types)
        rows = engine.evaluate(items, not a.no_judge)
        files.write_results(rows, a.results, "overwrite")
        # the results are read back, for rows would ask the models again
        summary = engine.summary(files.read_results(spark, a.results, rows.schema))
        summary.show()
        if a.summary:
            files.write_summary(summary, a.summary)


if __name__ == "__main__":
    main()
