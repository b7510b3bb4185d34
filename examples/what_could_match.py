"""The rules that a wildcard string could match, and its readings: python examples/what_could_match.py SCHEMA_FILE QUERY..."""

import sys

from timberline.plans.schema import LogSchema
from timberline.plans.wildcard import Interpreter, show


def main(schema_path: str, *queries: str) -> None:
    reader = Interpreter(LogSchema.from_file(schema_path))
    for query in queries:
        print(query, "could be", ", ".join(reader.type_names(query)) or "static text only")
        for tokens in reader.ordered(query):
            print("   ", show(tokens))


if __name__ == "__main__":
    main(*sys.argv[1:])
