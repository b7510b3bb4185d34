"""Count the log types of files with the default schema: python examples/parse_files.py PATH"""

import sys

from pyspark.sql import SparkSession

from timberline.operators.parse import logtype_counts
from timberline.plans.schema import DEFAULT, LogSchema
from timberline.sources import read_split


def main(path: str) -> None:
    spark = SparkSession.builder.appName("timberline").getOrCreate()
    events = read_split(spark, path, LogSchema.parse(DEFAULT), ("logtype",))
    logtype_counts(events).orderBy("n", ascending=False).show(50, truncate=120)


if __name__ == "__main__":
    main(*sys.argv[1:])
