"""Cut a text into events and show their log types: python examples/parse_text.py SCHEMA_FILE TEXT_FILE"""

import sys

from timberline.operators.kernel import Lexer, StreamParser
from timberline.plans.schema import LogSchema


def main(schema_path: str, text_path: str) -> None:
    lexer = Lexer(LogSchema.from_file(schema_path))
    parser = StreamParser(lexer)
    with open(text_path, "rb") as file:
        pieces = [*iter(lambda: file.read(1 << 16), b""), None]
    for piece in pieces:
        for base, data, event in parser.feed(piece or b"", piece is None):
            print(base + event.start, lexer.timestamp(data, event) or "-", "multi" if lexer.is_multiline(data, event) else "one", lexer.logtype(data, event).decode("utf-8", "replace").strip(), sep="\t")


if __name__ == "__main__":
    main(*sys.argv[1:])
