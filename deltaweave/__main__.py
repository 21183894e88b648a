"""``python -m deltaweave --runner ShortestPath --graph_dir g --result_dir r``: options are the fields of `programs.Job`."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from .programs import NAMES, Job, execute


def parsed(arguments: list[str] | None = None) -> Job:
    parser = argparse.ArgumentParser(prog="deltaweave", description=__doc__)
    for f in dataclasses.fields(Job):
        kind = f.type.split(" ")[0]
        option = {"type": {"str": str, "int": int, "float": float}.get(kind, str)}
        if kind == "bool":
            option = {"action": argparse.BooleanOptionalAction}
        if f.name == "runner":
            parser.add_argument("--runner", required=True, choices=NAMES)
        else:
            parser.add_argument(f"--{f.name}", default=f.default, **option)
    return Job(**vars(parser.parse_args(arguments)))


def main(arguments: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("deltaweave").getOrCreate()
    result = execute(spark, parsed(arguments))
    last = result.metrics[-1] if result.metrics else {}
    print(f"rounds {result.rounds} settled {result.settled} " + " ".join(f"{k} {v}" for k, v in last.items() if k != "round"))


if __name__ == "__main__":
    main()
