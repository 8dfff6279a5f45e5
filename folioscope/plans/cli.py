"""folioscope setup | doctor | register | serve | search | consult | article | related"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from folioscope.functions.rules import LAW_KINDS
from folioscope.plans import index as plan
from folioscope.plans.service import Service, serve
from folioscope.session import session

SERVER = "folioscope"


def command() -> tuple[str, list[str]]:
    """How a client starts the server: by this interpreter, wherever it is called."""
    return sys.executable, ["-m", "folioscope.plans.cli", "serve"]


def stored(path: Path, text: str, dry: bool) -> None:
    if not dry:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def register_toml(path: Path, dry: bool) -> str:
    """Append the server's block to a TOML file unless it has one; returns what was, or would be, added."""
    before = path.read_text(encoding="utf-8") if path.exists() else ""
    name = f"mcp_servers.{SERVER}"
    if any(line.strip() == f"[{name}]" for line in before.splitlines()):
        return ""
    program, arguments = (json.dumps(x) for x in command())
    block = f"\n[{name}]\ncommand = {program}\nargs = {arguments}\n"
    stored(path, before + block, dry)
    return block


def register_json(path: Path, dry: bool) -> str:
    """Set the server's entry in a JSON file and leave the rest; a file that isn't a JSON object is replaced."""
    program, arguments = command()
    entry = {SERVER: {"command": program, "args": arguments}}
    try:
        before = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    except ValueError:
        before = {}
    before = before if isinstance(before, dict) else {}
    stored(path, json.dumps(before | {"mcpServers": before.get("mcpServers", {}) | entry}, ensure_ascii=False, indent=2), dry)
    return json.dumps(entry, ensure_ascii=False)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    ap.add_argument("--home", default=plan.home(), help="folder of the corpus (markdown/) and the index (index/)")
    sub = ap.add_subparsers(dest="do", required=True)
    for name in ("setup", "doctor", "serve"):
        sub.add_parser(name)
    p = sub.add_parser("register")
    p.add_argument("--toml", type=Path, action="append", default=[])
    p.add_argument("--json", type=Path, action="append", default=[])
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("search")
    p.add_argument("query", nargs="+")
    p.add_argument("--code")
    p.add_argument("--lexical", action="store_true")
    p.add_argument("-k", type=int, default=5)
    p.add_argument("--all-types", action="store_true")
    p = sub.add_parser("consult")
    p.add_argument("question", nargs="+")
    p.add_argument("--code")
    for name in ("article", "related"):
        p = sub.add_parser(name)
        p.add_argument("number")
        p.add_argument("--code", required=name == "related")
    a = ap.parse_args(argv)
    corpus, folder = f"{a.home}/markdown", f"{a.home}/index"
    if a.do == "register":
        for path in a.toml:
            print(path, register_toml(path, a.dry_run) or "is registered")
        for path in a.json:
            print(path, register_json(path, a.dry_run))
        return 0
    if a.do == "doctor":
        files = len(list(Path(corpus).glob("*.md")))
        print(f"home: {a.home}\ncorpus: {files or 'no'} files\nindex: {'there' if list(Path(folder).glob('state-*')) else 'missing, run setup'}\nserver: {' '.join([command()[0], *command()[1]])}")
        return 0
    spark = session()
    if a.do == "setup":
        row = plan.report(plan.build(spark, corpus, folder)).first()
        print(" ".join(f"{k}={v}" for k, v in row.asDict().items()))
        return 0
    service = Service(spark, plan.load(spark, folder))
    if a.do == "serve":
        serve(service)
    elif a.do == "search" and a.lexical:
        for r in service.lexical(" ".join(a.query), a.k, a.code):
            print(f"[{r['doc_type']}] {r['citation']}  {r['structure']}\n   {r['snippet']}")
    elif a.do == "search":
        hits = service.search(" ".join(a.query), a.code, types=None if a.all_types else LAW_KINDS)
        print(f"{len(hits)} hits")
        for r in hits:
            print(f"[{r['rama']}] {r['citation']}  {r['structure']}")
    elif a.do == "consult":
        print(service.sheet(" ".join(a.question), a.code))
    elif a.do == "article":
        for r in service.article(a.number, a.code) or [{"citation": "(sin resultados)", "vigente": True, "text": "", "reformas": ""}]:
            print(f"### {r['citation']}{'' if r['vigente'] else '   ⚠ DEROGADO'}\n{r['text']}\n{r['reformas']}")
    else:
        found = service.related(a.number, a.code)
        print(service.citation(a.number, a.code))
        for k, v in found.items():
            print(f"  {k}: {', '.join(v[:25]) or '—'}{' …' if len(v) > 25 else ''} ({len(v)})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
