"""python -m palimpsest STORE COMMAND [ARGUMENT ...]: a store's tools on the command line.

Arguments of tools are name=value (values as JSON where they are, else as text); `serve` answers JSON-RPC on lines.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from palimpsest import server
from palimpsest.sources import memories as source
from palimpsest.tools import StoreTools

#: Commands by other names than their tools.
SHORT = {"memory-map": "memory_map", "working-set": "working_set", "review-due": "review_due"}


def value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    if len(arguments) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tools = StoreTools(spark, source.open_store(spark, arguments[0]))
    name, rest = arguments[1], arguments[2:]
    if name == "serve":
        server.serve_lines(tools)
        return 0
    try:
        rows = tools.call(SHORT.get(name, name), **{k: value(v) for k, v in (a.split("=", 1) for a in rest)})
    except (KeyError, TypeError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    for line in rows.toJSON().take(server.MOST_ROWS):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
