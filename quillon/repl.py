"""The prompt: a menu to pick a database, then SQL with printed results."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterable, Iterator
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import Engine
from .sources import dsn as dsns

MENU = "1) connection string   2) guided   3) this session's tables   exit"


def rendered(frame: DataFrame) -> Iterator[list[str]]:
    """Rows as text, one partition at a time; a null is an empty text."""
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if frame.columns.count(c) == 1 else None for c in frame.columns]
    if all(c is not None for c in shown) and all(t in _PLAIN or t.startswith(("decimal", "varchar", "char", "interval")) for _, t in frame.dtypes):
        frame = frame.select(*shown)
    for row in frame.toLocalIterator():
        yield [_text(v) for v in row]


def _text(value: object) -> str:
    """A value as text; one that can't be shown is named by its type, and the rows after it go on."""
    try:
        return "" if value is None else str(value)
    except Exception as e:  # noqa: BLE001
        return f"<{type(value).__name__}: {type(e).__name__}>"


_PLAIN = {"string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz"}


def aligned(header: list[str], rows: Iterable[list[str]], out: TextIO, sample: int = 1000) -> int:
    """Prints a table, two blanks of padding and bars between columns; returns its rows.

    Widths come from the first rows, so a long result is printed as it arrives.
    """
    source = iter(rows)
    first = [row for _, row in zip(range(sample), source, strict=False)]
    widths = [max(len(c) for c in column) for column in zip(header, *first, strict=True)]
    line = lambda cells: " | ".join(c.ljust(w + 1) for c, w in zip(cells, widths, strict=True)).rstrip()
    print(line(header), file=out)
    count = 0
    for rows_now in (first, source):
        for row in rows_now:
            try:
                print(line(row), file=out)
            except ValueError as e:  # what the terminal can't show
                print(f"row skipped: {type(e).__name__}", file=out)
                continue
            count += 1
    return count


def show(frame: DataFrame, out: TextIO | None = None) -> int:
    """All rows of a frame, not the first twenty."""
    return aligned(frame.columns, rendered(frame), out or sys.stdout)


def _first_line(error: Exception) -> str:
    return next((line.strip() for line in str(error).splitlines() if line.strip()), type(error).__name__)


class Prompt:
    """Reads lines, answers each; /dc goes back to the menu, /q ends, an empty line is passed over."""

    def __init__(self, engine: Engine, read: Callable[[str], str] = input, out: TextIO | None = None, connect: Callable[[dsns.Dsn], object] | None = None):
        self.engine, self.read, self.out = engine, read, out or sys.stdout
        self.connect = connect or engine.connect

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def answer(self, text: str) -> None:
        """Runs one statement and prints rows and time, or the error."""
        began = time.perf_counter()
        try:
            count = show(self.engine.sql(text.rstrip(";")), self.out)
        except Exception as e:  # noqa: BLE001  an error ends the statement, not the prompt
            self.say(f"error: {_first_line(e)}")
            return
        self.say(f"[{count} rows in set ({time.perf_counter() - began:.3f} sec)]")

    def loop(self) -> bool:
        """Statements until /dc (True), or /q, Ctrl-C or the end of input (False)."""
        while True:
            try:
                line = self.read("sql> ").strip()
            except (EOFError, KeyboardInterrupt):
                return False
            if line == "/q":
                return False
            if line == "/dc":
                return True
            if line:
                self.answer(line)

    def _guided(self) -> dsns.Dsn:
        kind = ""
        while kind not in ("mysql", "postgres", "postgresql"):
            kind = self.read("type (mysql, postgres): ").strip().lower()
        ask = lambda what: self.read(f"{what}: ").strip()
        host, port, user, password = ask("host"), ask("port"), ask("user"), ask("password")
        return dsns.guided(kind, ask("database"), host, port, user, password)

    def run(self) -> None:
        while True:
            self.say(MENU)
            try:
                choice = self.read("> ").strip().lower()
                if choice in ("exit", "/q"):
                    return
                if choice == "1":
                    self.connect(dsns.lenient(self.read("connection string: ").strip()))
                elif choice == "2":
                    self.connect(self._guided())
                elif choice != "3":
                    continue
            except (EOFError, KeyboardInterrupt):
                return
            except Exception as e:  # noqa: BLE001  back to the menu
                self.say(f"connection failed: {_first_line(e)}")
                continue
            if not self.loop():
                return


def main() -> None:
    try:
        import os
        import readline

        history = os.path.expanduser("~/.quillon_history")
        if os.path.exists(history):
            readline.read_history_file(history)
        import atexit

        atexit.register(readline.write_history_file, history)
    except ImportError:
        pass
    Prompt(Engine()).run()


if __name__ == "__main__":
    main()
