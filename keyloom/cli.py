"""Inspect and convert binary dictionaries: python -m keyloom.cli info|list|get|dump|search|validate|encode|decode FILE ..., or fixtures FOLDER"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keyloom.dictionary import Json
from keyloom.operators import lookup, search
from keyloom.schema import kind_name, text_of
from keyloom.sources import fixtures, trie

OK, USAGE, FAILED, MISSING = 0, 1, 2, 3


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="keyloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in (("info", ()), ("list", ()), ("get", ("key",)), ("dump", ()), ("search", ("prefix",)), ("validate", ()), ("encode", ("-o",)), ("decode", ("-o", "--pretty"))):
        command = commands.add_parser(name)
        command.add_argument("file")
        for argument in more:
            command.add_argument(argument, **({"action": "store_true"} if argument == "--pretty" else {}))
    commands.add_parser("fixtures").add_argument("file", metavar="folder")
    return parser


def _read(path: str) -> bytes:
    if path == "-":
        return sys.stdin.buffer.read()
    with open(path, "rb") as file:
        return file.read()


def _write(path: str | None, data: bytes) -> None:
    if path is None:
        sys.stdout.buffer.write(data)
    else:
        with open(path, "wb") as file:
            file.write(data)


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    try:
        options = _parser().parse_args(arguments)
    except SystemExit as stop:
        return OK if not stop.code else USAGE
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if options.command == "fixtures":
            print("\n".join(fixtures.write(options.file)))
            return OK
        content = _read(options.file)
        if options.command == "encode":
            _write(options.o, Json(spark).encode(content.decode()))
            return OK
        if options.command == "decode":
            trie.header(content)
            _write(options.o, Json(spark).decode(content, 2 if options.pretty else None).encode())
            return OK
        files = spark.createDataFrame([(options.file, content)], "dict_id string, content binary")
        if options.command == "validate":
            good = files.select(trie.valid(F.col("content"))).first()[0]
            print("valid" if good else "invalid")
            return OK if good else FAILED
        if options.command == "dump":
            print(files.select(trie.dump(F.col("content"))).first()[0])
        if options.command in ("dump", "info"):
            trie.header(content)
            for name, v in trie.headers(files).first().asDict().items():
                print(f"{name}: {v}")
            return OK
        trie.header(content)
        shown = trie.decode(files)
        if options.command == "get":
            found = lookup.get(shown, options.key)
        elif options.command == "search":
            found = search.prefix(shown, options.prefix)
        else:
            found = shown
        rows = search.scan(found).select("key", kind_name(F.col("tag")).alias("kind"), text_of().alias("text")).toLocalIterator()
        n = 0
        for n, row in enumerate(rows, 1):
            print(f"{row.key}\t{row.kind}\t{row.text}")
        return MISSING if options.command == "get" and not n else OK
    except (OSError, ValueError) as fault:
        print(f"keyloom: {options.file}: {fault}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
