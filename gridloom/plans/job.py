"""Reconstruction as a command: pictures of one table's pages in, HTML and JSON out.

python -m gridloom.plans.job page1.png page2.png --base-url http://localhost:8000/v1
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.client import served
from gridloom.plans.reading import read_pages
from gridloom.plans.reconstruct import Plan, reconstruct
from gridloom.sources import files, pictures

#: Problems and flags that are printed.
SHOWN = 15


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom.plans.job", description=__doc__, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    p.add_argument("images", nargs="+", help="the pages of one table, in order")
    p.add_argument("--model", default="qwen3.6-35b-a3b-fp8")
    p.add_argument("--base-url", default="http://localhost:8000/v1")
    p.add_argument("--k", type=int, default=1, help="drafts to vote over")
    p.add_argument("--repair-rounds", type=int, default=1)
    p.add_argument("--consensus", type=int, default=1, help="reads of every page, each moved by a tenth of a tile")
    p.add_argument("--tile", type=int, default=1024)
    p.add_argument("--max-side", type=int, default=1536)
    p.add_argument("--no-schema", action="store_true")
    p.add_argument("--no-thinking", action="store_true")
    p.add_argument("--out", help="where the HTML goes; the JSON stands beside it")
    p.add_argument("--draw", action="store_true", help="also write the first page with the cells' boxes")
    return p


def pages_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, page, image) of one document's pictures, numbered in the order given."""
    at = F.create_map(*[v for i, p in enumerate(paths, 1) for v in (F.lit(Path(p).name), F.lit(i))])
    return files.images(spark, paths).select(F.lit("table").alias("doc_id"), at[F.element_at(F.split("path", "/"), -1)].alias("page"), "image")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, model: Callable | None = None, say: Callable[[str], None] = print) -> int:
    """0 when done, 2 if a picture is missing. spark and model are opened from the options unless given."""
    args = options().parse_args(argv)
    missing = [p for p in args.images if not Path(p).exists()]
    if missing:
        print(f"no such picture: {missing[0]}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("reconstruct").getOrCreate()
    model = model or served(args.model, args.base_url, max_side=args.max_side, thinking=not args.no_thinking)
    pages = pages_of(spark, args.images)
    read = read_pages(pages, model, tile=args.tile, offsets=tuple(int(i * args.tile * 0.1) for i in range(max(1, args.consensus))))
    plan = Plan(draw=model, schema=None if args.no_schema else model, drafts=args.k, rounds=args.repair_rounds)
    done = reconstruct(read, plan, pages).withColumn("payload", F.to_json("payload")).first()
    if done is None:
        say("nothing to read on the pages")
        return 0
    findings = done["findings"] or []
    say(f"repair rounds {done['repair_rounds']}, confidence {done['table_confidence']}")
    if done["hint"]:
        say(done["hint"])
    for severity, word in (("problem", "problems"), ("flag", "flags")):
        own = [f["message"] for f in findings if f["severity"] == severity]
        if own:
            say(f"{word} ({len(own)}):")
            for m in own[:SHOWN]:
                say(f"  - {m}")
    out = Path(args.out) if args.out else Path(args.images[0]).with_name(Path(args.images[0]).stem + "_reconstructed.html")
    out.write_text(done["html"])
    out.with_suffix(".json").write_text(done["payload"] or "{}")
    say(f"wrote {out} and {out.with_suffix('.json')}")
    if args.draw:
        from gridloom.functions.html import cells as html_cells  # noqa: PLC0415

        table = spark.createDataFrame([("table", done["html"])], "uid string, html string")
        drawn = pictures.with_cell_boxes(pages.where("page = 1").select(F.col("doc_id").alias("uid"), "image"), html_cells(table)).first()["image"]
        out.with_name(out.stem + "_boxes.png").write_bytes(pictures.png(pictures.array_of(drawn["data"], drawn["height"], drawn["width"], drawn["nChannels"])))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
