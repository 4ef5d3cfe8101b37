"""Redact office documents: python -m maskwright INPUT -o OUTPUT_FOLDER."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskwright import vocabulary as v
from maskwright.functions.fakes import Fakes
from maskwright.operators.detect import scan
from maskwright.operators.rewrite import collisions, edits_of, mapping
from maskwright.operators.walkers import read_names
from maskwright.sources import office


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input", help="a document, a folder or a glob")
    p.add_argument("-o", "--output", help="folder for the redacted documents")
    p.add_argument("--people", help="file of names of persons, one a line")
    p.add_argument("--organisations", help="file of names of organisations, one a line")
    p.add_argument("--no-gazetteer", action="store_true", help="patterns only")
    p.add_argument("--seed", default=v.SEED)
    p.add_argument("--emit-map", help="folder for the mapping as JSON lines; it re-identifies the data")
    p.add_argument("--summary", help="file for a JSON summary")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    if not a.output and not a.dry_run:
        p.error("an output folder is needed, or --dry-run")
    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    names = lambda path: read_names(spark, path) if path and not a.no_gazetteer else []
    files = office.read_files(spark, a.input)
    units = office.read_units(files).cache()
    spans = scan(units, names(a.people), names(a.organisations), "sequence").cache()
    by_type = {r["ptype"]: r["n"] for r in spans.groupBy("ptype").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).collect()}
    print(f"{units.count()} text blocks, {sum(by_type.values())} spans")
    for t, n in by_type.items():
        print(f"  {t:<16} {n}")
    if a.dry_run:
        return 0
    fakes = Fakes(a.seed)
    maps = mapping(spans, fakes).cache()
    clash = collisions(units, maps).select("fake").limit(5).collect()
    if clash:
        raise SystemExit(f"substitutes that stand in the source already: {[r['fake'] for r in clash]}; choose another seed")
    written = office.save(office.write_packages(files, edits_of(spans, maps, fakes)), a.output, a.input if os.path.isdir(a.input) else None)
    done = written.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed")).first()
    print(f"rewrote {done['changed']} text elements in {done['files']} documents")
    if a.emit_map:
        maps.select("ptype", "original", "fake").write.mode("overwrite").json(a.emit_map)
    if a.summary:
        summary = {"input": a.input, "output": a.output, "seed": a.seed, "gazetteer": not a.no_gazetteer, "spans_by_type": by_type, "unique_entities": maps.count(), "elements_rewritten": done["changed"]}
        with open(a.summary, "w", encoding="utf-8") as f:
            json.dump(summary, f, indent=2)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
