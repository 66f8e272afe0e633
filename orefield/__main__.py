"""python -m orefield -p FILE (or -j FILE): a run from a parameter file."""

import argparse

from pyspark.sql import SparkSession

from .plans.run import run


def main() -> None:
    parser = argparse.ArgumentParser(prog="orefield")
    one = parser.add_mutually_exclusive_group(required=True)
    one.add_argument("-p", dest="path", help="parameter file")
    one.add_argument("-j", dest="path", help="parameter file of a joint run")
    problems, log = run(SparkSession.builder.appName("orefield").getOrCreate(), parser.parse_args().path)
    for row in log:
        print(" ".join(f"{k}={v:.6g}" for k, v in row.items()))
    for p in problems:
        print(p.name, "cells", p.value.size, "data", p.measured.size)


if __name__ == "__main__":
    main()
