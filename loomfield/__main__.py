"""python -m loomfield [--force] [-v] [-q] CONFIG [data|embed|index|serve]: run a configured pipeline, or one step of it; serve answers requests over its indices."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.config import SERVER, Config, Pipeline


def main() -> None:
    p = argparse.ArgumentParser(prog="loomfield")
    p.add_argument("--force", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("config")
    p.add_argument("step", nargs="?", choices=["data", "embed", "index", "serve"])
    a = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR" if a.quiet else "WARN")
    pipeline = Pipeline(spark, Config.load(a.config), a.force)
    if a.step == "serve":
        from .plans.server import Server, serve

        options = pipeline.config.server or SERVER
        with serve(Server.of(spark, pipeline.engines(), options), options["host"], int(options["port"])) as listening:
            listening.serve_forever()
        return
    for step in [a.step] if a.step else ["data", "embed", "index"]:
        getattr(pipeline, step)()


if __name__ == "__main__":
    main()
