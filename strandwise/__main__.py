"""Jobs from the command line: ``python -m strandwise retrieve --dataset musique --out results/musique``.

Paths that aren't given are those of the set below ``--root``: ``<set>/data.json``, ``<set>/plan``, ``<set>/kg`` and
``<set>/out``.  Any field of ``Settings`` is an option, such as ``--relation_k 4``; ``--config`` names a file of them.
The session is the one that spark-submit or the environment sets up; model endpoints come from the environment.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields
from typing import Any

from strandwise.config import DATASETS, Settings, from_mapping, load_config

JOBS = ("plan", "extract", "retrieve", "evaluate")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandwise", description=__doc__.split("\n")[0])
    out.add_argument("job", choices=JOBS)
    out.add_argument("--root", default=".", help="folder that default paths lie below")
    for name in ("data", "plan", "kg", "out"):
        out.add_argument(f"--{name}", help=f"path; by default that of the set below --root ({name})")
    out.add_argument("--num_pages", type=int, help="pages to extract from, all by default")
    out.add_argument("--config", help="JSON or YAML file of settings")
    for f in fields(Settings):
        out.add_argument(f"--{f.name}", choices=DATASETS if f.name == "dataset" else None, help=f"default {f.default}")
    return out


def _value(text: str, like: Any) -> Any:
    """``text`` as a value of the kind of ``like``."""
    if isinstance(like, bool):
        return text.strip().lower() in ("1", "true", "yes")
    if isinstance(like, (int, float)):
        return type(like)(text)
    return tuple(x.strip() for x in text.split(",")) if isinstance(like, tuple) and like and isinstance(like[0], str) else text


def settings_of(args: argparse.Namespace) -> Settings:
    base = load_config(args.config) if args.config else Settings()
    given = {f.name: getattr(args, f.name) for f in fields(Settings) if getattr(args, f.name) is not None}
    # Numbers of samples and lists of k have forms of their own.
    changes = {k: v if k in ("num_samples", "recall_ks") else _value(v, getattr(base, k)) for k, v in given.items()}
    return from_mapping({f.name: getattr(base, f.name) for f in fields(Settings)} | changes)


def paths_of(args: argparse.Namespace, settings: Settings) -> dict[str, str]:
    own = f"{args.root}/{settings.dataset}"
    defaults = {"data": f"{own}/data.json", "plan": f"{own}/plan", "kg": f"{own}/kg", "out": f"{own}/out"}
    return {k: getattr(args, k) or v for k, v in defaults.items()}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    settings = settings_of(args)
    at = paths_of(args, settings)

    from pyspark.sql import SparkSession

    from strandwise.plans import jobs
    from strandwise.sources.json_sources import write_lines
    from strandwise.sources.llm_client import http_client

    spark = SparkSession.builder.appName(f"strandwise {args.job}").getOrCreate()
    if args.job == "plan":
        planned = jobs.run_planner(spark, at["data"], f"{at['plan']}_table", http_client, settings)
        write_lines(planned.orderBy("pos").drop("pos"), at["plan"])
    elif args.job == "extract":
        jobs.run_extraction(spark, at["data"].split(","), at["kg"], http_client, settings, args.num_pages)
    elif args.job == "retrieve":
        jobs.run_retrieval(spark, at["plan"], at["data"], at["kg"], at["out"], settings)
    else:
        jobs.run_evaluation(spark, f"{at['out']}/stage2", at["data"], at["out"], http_client, settings).show(truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
