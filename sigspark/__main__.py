"""Command line: an expression, a script, or an interactive loop.

    python -m sigspark '(+ 1 2)' -l dump.vcd
    python -m sigspark script -l dump.vcd
    python -m sigspark run script -c '(expression)'
    python -m sigspark repl
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sigspark.lang.builtins import TABLE
from sigspark.lang.interp import FORMS, SPECIAL, Interpreter
from sigspark.lang.reader import ReadError, read_all, show
from sigspark.lang.values import LangError
from sigspark.session import Session


def completions(run: Interpreter, part: str, most: int = 20) -> list[str]:
    """Names that contain part, for the interactive loop."""
    names = {*FORMS, *SPECIAL, *TABLE, *run.globals.names, *(n for t in run.session.traces.values() for n in t.names)}
    return sorted(n for n in names if part in n)[:most]


def script(run: Interpreter, text: str) -> int:
    """Evaluates each form and prints what is not nil; errors are reported and evaluation goes on."""
    status = 0
    for f in read_all(text):
        try:
            v = run.eval(f, run.globals)
            if v is not None:
                print(show(v))
        except (LangError, ReadError, LookupError) as e:
            status = 1
            print(f"error: {e}", file=sys.stderr)
    return status


def loop(run: Interpreter) -> int:
    try:
        import readline

        readline.set_completer(lambda part, i: (completions(run, part) + [None])[i])
        readline.parse_and_bind("tab: complete")
    except ImportError:
        pass
    while True:
        try:
            line = input("> ")
        except EOFError:
            return 0
        try:
            for f in read_all(line):
                print("=>", show(run.eval(f, run.globals)))
        except SystemExit:
            raise
        except Exception as e:
            print(f"error: {e}")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sigspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("input", nargs="*", help="an expression, a script's path, `run FILE` or `repl`")
    p.add_argument("-l", "--load", action="append", default=[], help="a trace to load first; again for more")
    p.add_argument("-c", "--code", help="an expression in place of the script")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("sigspark").getOrCreate()
    run = Interpreter(Session(spark))
    for i, path in enumerate(a.load):
        run.session.load(path, f"t{i}")
        run.globals.names[f"t{i}"] = path
    words = a.input[1:] if a.input[:1] == ["run"] else a.input
    if a.code:
        print("=>", show(run.run(a.code)))
        return 0
    if not words:
        p.print_help()
        return 0
    if words == ["repl"]:
        return loop(run)
    if words[0].lstrip()[:1] in ("(", "'"):
        print("=>", show(run.run(words[0])))
        return 0
    with open(words[0], encoding="utf-8") as f:
        return script(run, f.read())


if __name__ == "__main__":
    sys.exit(main())
