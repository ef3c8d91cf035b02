"""python -m lexmill.cli INPUT --output DIR [--seeds FILE] [--backends FILE] [--resynthesize DIR]: a run with
offline models, or with those that a YAML file of backends and passes (extract, name, seeds, write) names."""

from __future__ import annotations

import argparse
from pathlib import Path

from .plans import config, model_steps, models, pipeline
from .session import local_session
from .sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input", nargs="?", help="text files or a folder")
    p.add_argument("--output", default="vault")
    p.add_argument("--seeds")
    p.add_argument("--resynthesize", metavar="DIR")
    p.add_argument("--max-chunks", type=int, default=0)
    p.add_argument("--backends", metavar="YAML")
    p.add_argument("--strict-seeds", action="store_true")
    p.add_argument("--dead-letters", default="", metavar="DIR")
    p.add_argument("--min-facts", type=int, default=2)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session()
    offline = {"rule-extract": models.rule_extractor(), "rule-name": models.rule_namer(), "rule-seeds": models.rule_seeder(), "rule-write": models.Rule(lambda prompt: prompt.split("Statements:\n", 1)[-1], "rule-write")}
    passes = {"extract": offline["rule-extract"], "name": offline["rule-name"], "write": offline["rule-write"]}
    if args.backends:
        passes |= models.from_topology(config.load_topology(Path(args.backends).read_text(), config.load_env()), offline)
    if args.resynthesize:
        vault = readers.read_vault(spark, args.resynthesize, unsynthesized=True)
        pages = model_steps.resynthesized(vault, passes["write"])
        print(readers.write_vault(pages, args.output), "pages")
        return 0
    seeds = readers.read_seeds(spark, args.seeds) if args.seeds else None
    antonyms = readers.read_antonyms(spark, args.seeds) if args.seeds else []
    from .functions import vocab

    options = pipeline.Options(passes["extract"], passes["name"], seeder=passes.get("seeds"), strict_seeds=args.strict_seeds, dead_letters=args.dead_letters, max_chunks=args.max_chunks, min_publishable=args.min_facts, antonyms=[*vocab.ANTONYMS, *antonyms])
    out = pipeline.run(readers.read_documents(spark, args.input), options, seeds)
    pages = out["pages"].select("title", "markdown").unionByName(out["redirects"].select("title", "markdown"))
    print(readers.write_vault(pages, args.output), "pages")
    out["evaluation"].show(truncate=False)
    out["metrics"].orderBy("measure").show(100, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
