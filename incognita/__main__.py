"""Command line: pseudonymizes a text file, or restores one from its mapping."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize
from .operators import ner, rewrite
from .plans.pipeline import Engine
from .sources import lexicon, readers


def parse(argv: list[str] | None) -> argparse.Namespace:
    """The options."""
    p = argparse.ArgumentParser(prog="incognita", description=__doc__)
    p.add_argument("--input", required=True, help="text file to read, in UTF-8")
    p.add_argument("--output", required=True, help="text file to write")
    p.add_argument("--mapping", help="JSON file to write the aliases to")
    p.add_argument("--load-mapping", help="JSON file of an earlier run's aliases")
    p.add_argument("--rules", help="YAML file of rules in place of the shipped ones")
    p.add_argument("--more-rules", help="YAML file of rules beside the shipped ones")
    p.add_argument("--model", help="named-entity model: a transformer's name or folder, or module:function that loads one; patterns if not given")
    p.add_argument("--gazetteers", help="folder of CSV files in place of the shipped names")
    p.add_argument("--profile", default="faithful", choices=["faithful", "repaired"])
    p.add_argument("--log-level", default="INFO", choices=["DEBUG", "INFO", "WARNING"])
    p.add_argument("--depseudonymize", action="store_true", help="restore the input; needs --load-mapping")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    """Runs the command; 1 if a mapping is needed and not given."""
    o = parse(argv)
    logging.basicConfig(level=o.log_level)
    if o.depseudonymize and not o.load_mapping:
        logging.error("--depseudonymize needs --load-mapping")
        return 1
    spark = SparkSession.builder.appName("incognita").getOrCreate()
    docs = spark.createDataFrame([(0, Path(o.input).read_text(encoding="utf-8"))], "doc_id long, text string")
    known = readers.read_mapping(spark, str(Path(o.load_mapping).resolve())).collect() if o.load_mapping else []
    if o.depseudonymize:
        table = spark.createDataFrame([([tuple(r) for r in known],)], f"aliases {rewrite.ALIASES}")
        restored = docs.crossJoin(table).select(rewrite.restored(normalize(F.col("text")), F.col("aliases")).alias("t")).first().t
        Path(o.output).write_text(restored, encoding="utf-8")
        return 0
    gazetteers, exclusions = lexicon.GAZETTEERS, lexicon.EXCLUSIONS
    if o.gazetteers:
        table = readers.read_gazetteers(spark, str(Path(o.gazetteers).resolve()))
        gazetteers = table.where("gazetteer <> 'gazetteer_exclusions'")
        exclusions = [r["name"] for r in table.where("gazetteer = 'gazetteer_exclusions'").collect()]
    extra: dict[str, dict[str, list[str]]] = {}
    for path in (o.rules, o.more_rules):
        for family, categories in (readers.read_rules(Path(path).read_text(encoding="utf-8-sig")) if path else {}).items():
            for category, patterns in categories.items():
                extra.setdefault(family, {}).setdefault(category, []).extend(patterns)
    base: dict[str, int] = {}
    for r in known:
        base[r.prefix] = max(base.get(r.prefix, 0), r.n)
    forward = F.lit(json.dumps({r.original: r.alias for r in known}))
    backend = ner.model_backend(ner.loader(o.model)) if o.model else ner.heuristic
    stages: dict[str, Observation] = {}
    engine = Engine(profile=o.profile, extra=extra, shipped=not o.rules, gazetteers=gazetteers, exclusions=exclusions, backend=backend, watch=stages)
    done = engine.pseudonymized(docs, F.from_json(forward, "map<string,string>"), F.from_json(F.lit(json.dumps(base)), "map<string,bigint>")).collect()[0]
    Path(o.output).write_text(done.output, encoding="utf-8")
    for stage, observed in stages.items():
        logging.info("%s: %d entities", stage, observed.get["entities"])
    if o.mapping:
        rows = [*map(tuple, known), *((a.original, a.alias, a.prefix, a.n) for a in done.aliases)]
        entries = spark.createDataFrame([(0, *r) for r in rows], "doc_id long, original string, alias string, prefix string, n long")
        found = readers.mapping_json(entries, "doc_id").first()
        value = json.loads(found.value) if found else {"forward": {}, "reverse": {}, "counters": {}, "stats": {"total_entities": 0, "per_type": {}}}
        Path(o.mapping).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
