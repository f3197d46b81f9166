"""A small shell: python -m weft.repl [folder]. Statements end with a semicolon or a line's end."""

from __future__ import annotations

import sys
from itertools import chain

from pyspark.sql import SparkSession

from weft.errors import GraphError
from weft.session import Result, Session

HELP = "statements of the query language; HELP; EXIT"


def formatted(result: Result, page: int = 1000):
    """Lines of a text table, page by page with widths of their own, and of what was written. No row is left out."""
    if result.columns and result.df is not None:
        n, pages = 0, result.batches(page)
        for rows in chain([next(pages, [])], pages):
            body = [["null" if x is None else str(x) for x in r] for r in rows]
            widths = [max(map(len, column)) for column in zip(result.columns, *body, strict=True)]
            yield from ("  ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip() for row in ([result.columns] if not n else []) + body)
            n += len(body)
        yield f"{n} rows"
    yield from (f"{k}: {v}" for k, v in result.summary.items() if v)
    yield from result.profile
    yield from result.notifications


def serve(session: Session, source, out) -> None:
    for line in source:
        text = line.strip()
        word = text.rstrip(";").upper()
        if word in ("EXIT", "QUIT"):
            return
        if word == "HELP":
            print(HELP, file=out)
        elif text:
            try:
                for result in session.run(text):
                    for shown in formatted(result):
                        print(shown, file=out)
            except GraphError as e:
                print(e, file=out)


if __name__ == "__main__":
    serve(Session(SparkSession.builder.getOrCreate(), root=sys.argv[1] if len(sys.argv) > 1 else None), sys.stdin, sys.stdout)
