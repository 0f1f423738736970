"""A prompt for graph queries: ``python -m quiverlane [folder]``.

Queries end with a semicolon. ``.open folder`` opens the graphs kept there, ``.read file`` runs the
queries of a file, ``.help`` and ``.quit`` do what they say.
"""

from __future__ import annotations

import sys
from typing import Any, TextIO

from pyspark.sql import SparkSession

from quiverlane.lang.errors import QueryError
from quiverlane.session import Connection, connect

HELP = ".help            this text\n.open FOLDER     open the graphs kept in a folder\n.read FILE       run the queries of a file\n.quit            leave"


def table(rows: list[list[Any]]) -> str:
    """A header and rows in columns."""
    cells = [["null" if x is None else str(x) for x in row] for row in rows]
    widths = [max(map(len, column)) for column in zip(*cells)]
    lines = [" | ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])


class Prompt:
    def __init__(self, spark: SparkSession, folder: str | None = None, out: TextIO = sys.stdout) -> None:
        self.spark, self.out = spark, out
        self.connection: Connection = connect(spark, folder)
        self.pending = ""

    def run(self, text: str) -> None:
        try:
            for result in self.connection.run(text):
                if result is not None:
                    print(table(result.rows()), file=self.out)
        except QueryError as e:
            print(e, file=self.out)

    def line(self, line: str) -> bool:
        """Takes a line; False to leave."""
        if not self.pending and line.lstrip().startswith("."):
            command, _, rest = line.strip().partition(" ")
            if command == ".quit":
                return False
            if command == ".open":
                self.connection = connect(self.spark, rest.strip())
            elif command == ".read":
                with open(rest.strip(), encoding="utf-8") as f:
                    self.run(f.read())
            else:
                print(HELP if command == ".help" else f"{command} is no command; see .help", file=self.out)
            return True
        self.pending += line + "\n"
        if line.rstrip().endswith(";"):
            self.run(self.pending)
            self.pending = ""
        return True


def main() -> None:
    spark = SparkSession.builder.appName("quiverlane").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prompt = Prompt(spark, sys.argv[1] if len(sys.argv) > 1 else None)
    while True:
        try:
            line = input("... " if prompt.pending else "> ")
        except EOFError:
            return
        if not prompt.line(line):
            return


if __name__ == "__main__":
    main()
