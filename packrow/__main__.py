"""Command line: ``python -m packrow check OLD NEW``, ``sql FILE OUT``, ``format FILE``, ``export FILE FOLDER``, ``prefixed-id PREFIX TAG``.

``check`` compares schema files (OLD may be ``git:REF:PATH``) and exits 1 for blocking findings, 2 for errors.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from packrow.plans import breaking, sqlgen
from packrow.sources import schema_lang
from packrow.types import WireError


def _codecs(path: str):
    return list(schema_lang.codecs(schema_lang.parse_file_with_imports(path)).values())


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="packrow", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)
    c = sub.add_parser("check")
    c.add_argument("old")
    c.add_argument("new")
    c.add_argument("--config", help="JSON with category, except, include_docs, fail_on, severity_overrides")
    c.add_argument("--category", choices=["wire", "source"])
    for name, extra in (("sql", ["out"]), ("format", []), ("export", ["folder"])):
        q = sub.add_parser(name)
        q.add_argument("file")
        for e in extra:
            q.add_argument(e)
        q.add_argument("--check", action="store_true")
        q.add_argument("--prune", action="store_true")
    g = sub.add_parser("prefixed-id")
    g.add_argument("prefix")
    g.add_argument("tag", type=int)
    a = p.parse_args(args)
    try:
        if a.do == "check":
            given = json.loads(Path(a.config).read_text()) if a.config else {}
            config = breaking.Config(a.category or given.get("category", "source"), tuple(given.get("except", ())), given.get("include_docs", False), tuple(given.get("fail_on", ("error",))), given.get("severity_overrides", {}))
            old = breaking.baseline_from_git(*a.old.split(":", 2)[1:]) if a.old.startswith("git:") else schema_lang.parse_file_with_imports(a.old)
            found = breaking.check(old, schema_lang.parse_file_with_imports(a.new), config, a.new)
            for f in found:
                print(f"{f.severity}: {f.rule}: {f.message}")
            return breaking.exit_code(found, config)
        if a.do == "sql":
            return int(sqlgen.to_file(_codecs(a.file), a.out, a.check) and a.check)
        if a.do == "format":
            print(schema_lang.format_schema(schema_lang.parse_file(a.file)), end="")
        elif a.do == "export":
            changed = schema_lang.export(_codecs(a.file), a.folder, schema_lang.parse_file(a.file).name or "schema", a.check, a.prune)
            print("\n".join(changed))
            return int(bool(changed) and a.check)
        else:
            print(schema_lang.format_type(schema_lang.TypeDef(a.prefix.title() + "Id", "prefixed_id", params={"prefix": a.prefix, "tag": a.tag})))
        return 0
    except (WireError, OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
