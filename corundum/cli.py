"""Command line: ``shell [db]``, ``exec <db> <sql>``, ``version``, ``help``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame

from . import __version__
from .session import Engine, Prepared

HELP = """.help .quit .exit  .open PATH  .memory  .close  .tables  .schema [TABLE]  .stats
.prepare SQL  .bind INDEX VALUE  .execute        anything else is SQL"""


def show(result, out) -> None:
    if isinstance(result, DataFrame):
        print("\t".join(result.columns), file=out)
        for row in result.toLocalIterator():
            print("\t".join(_text(v) for v in row), file=out)
    else:
        print(f"{result.affected_rows} rows", file=out)


def _text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.2f}"
    return "<blob>" if isinstance(v, (bytes, bytearray)) else str(v)


class Shell:
    def __init__(self, engine: Engine | None, out=sys.stdout):
        self.engine, self.out = engine, out
        self.prepared: Prepared | None = None

    def run(self, line: str) -> bool:
        """False when the session ends."""
        word, _, rest = line.strip().partition(" ")
        say = lambda *x: print(*x, file=self.out)
        if not word:
            return True
        if word in (".quit", ".exit"):
            return False
        if word == ".help":
            say(HELP)
        elif word == ".open":
            self.engine = Engine.open(rest)
        elif word == ".memory":
            self.engine = Engine.open_memory()
        elif word == ".close":
            if self.engine:
                self.engine.close()
            self.engine = None
        elif not self.engine:
            say("no database is open")
        elif word == ".tables":
            say("\n".join(self.engine.tables()))
        elif word == ".schema":
            for name in [rest] if rest else self.engine.tables():
                say(f"{name}: {self.engine.schema(name).simpleString()}")
        elif word == ".stats":
            say(self.engine.stats())
        elif word == ".prepare":
            self.prepared = self.engine.prepare(rest)
            say(f"{self.prepared.count} parameters")
        elif word in (".bind", ".execute") and not self.prepared:
            say("nothing is prepared")
        elif word == ".bind":
            index, _, value = rest.partition(" ")
            self.prepared.bind(int(index), _value(value))
        elif word == ".execute":
            show(self.prepared.execute(), self.out)
        elif word.startswith("."):
            say(f"unknown command {word}")
        else:
            show(self.engine.sql(line), self.out)
        return True


def _value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return None if text.upper() == "NULL" else text.strip("'\"")


def main(args: list[str]) -> int:
    command = args[0] if args else "help"
    if command == "version":
        print(__version__)
    elif command == "exec" and len(args) == 3:
        show(Engine.open(args[1]).sql(args[2]), sys.stdout)
    elif command in ("shell", "interactive"):
        shell = Shell(Engine.open(args[1]) if len(args) > 1 else Engine.open_memory())
        for line in sys.stdin:
            try:
                if not shell.run(line):
                    break
            except Exception as e:  # a shell goes on after any error
                print(f"error: {str(e).splitlines()[0]}")
    else:
        print(__doc__)
        return int(command != "help")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
