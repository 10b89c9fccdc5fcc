"""Command line: match, union, nway, fof, convert, sync, list, describe, search, discover, adopt, drift, doctor, completion.

Exit codes: 0, 1 for errors of the library, 2 for wrong use, 130 when interrupted.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from .errors import MatchError
from .specs import FINDS, JOIN_TYPES, MATCHERS, MatchSpec


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skyzone", description="Match catalogues of positions on the sphere.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("match", "union", "nway", "fof"):
        own = sub.add_parser(name)
        own.add_argument("catalogues", nargs="+")
        own.add_argument("-o", "--output")
        own.add_argument("-r", "--radius", type=float, default=1.0, help="arcseconds")
        own.add_argument("--config")
        own.add_argument("--ids", help="id columns, one a catalogue, separated by commas")
        own.add_argument("--columns", help="columns of all catalogues to keep, separated by commas")
        own.add_argument("--set", action="append", default=[], metavar="OPTION=VALUE", help="an option of a side, such as ra_2=RAJ2000 or columns_1=id,mag")
        own.add_argument("--region", help="ra,dec,radius in degrees: only rows of the second and later catalogues within it")
        if name != "nway":
            own.add_argument("--matcher", choices=MATCHERS, default="sky")
            own.add_argument("--max-error", type=float, default=3.0)
            own.add_argument("--target-epoch", type=float)
        if name == "match":
            own.add_argument("--join", choices=JOIN_TYPES, default="1and2")
            own.add_argument("--find", choices=FINDS, default="best")
            own.add_argument("--where", help="SQL condition on matched rows")
            own.add_argument("--id-join", action="store_true", help="join on ids, not positions")
            own.add_argument("--probabilistic", action="store_true")
        if name == "union":
            own.add_argument("--star", action="store_true", help="every combination, not one partner a step")
        if name == "nway":
            own.add_argument("--cap", type=int, default=0)
            own.add_argument("--sigma", type=float, help="error in arcseconds where catalogues give none")
    own = sub.add_parser("convert")
    own.add_argument("input")
    own.add_argument("output")
    own = sub.add_parser("sync", help="copy a tiled tree, only what differs")
    own.add_argument("source")
    own.add_argument("targets", nargs="+")
    for name in ("list", "describe", "search", "discover", "adopt", "drift", "doctor", "completion"):
        own = sub.add_parser(name)
        own.add_argument("--config")
        if name == "describe":
            own.add_argument("name")
        if name == "search":
            own.add_argument("words", nargs="+")
        if name == "discover":
            own.add_argument("tables", help="a table (file) of a service's tables: table_name, description")
            own.add_argument("columns", help="a table of their columns: table_name, column_name, ucd")
            own.add_argument("--service", required=True)
            own.add_argument("--words", nargs="*", default=[])
        if name in ("adopt", "drift"):
            own.add_argument("--bundled", required=True, help="the registry to compare with")
        if name == "adopt":
            own.add_argument("names", nargs="+")
        if name == "drift":
            own.add_argument("--strict", action="store_true", help="fail on any difference")
        if name == "completion":
            own.add_argument("shell", choices=("bash", "zsh"))
    return p


def completion(shell: str) -> str:
    """A shell script that completes commands and their options."""
    commands = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    cases = "\n".join(f"    {name}) COMPREPLY=($(compgen -W '{' '.join(sorted(o for a in own._actions for o in a.option_strings))}' -- \"$cur\")); return;;" for name, own in sorted(commands.items()))
    head = "autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else ""
    return f"""{head}_skyzone() {{
  local cur="${{COMP_WORDS[COMP_CWORD]}}"
  if [ "$COMP_CWORD" -eq 1 ]; then COMPREPLY=($(compgen -W '{' '.join(sorted(commands))}' -- "$cur")); return; fi
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
}}
complete -o default -F _skyzone skyzone
"""


def doctor(registry: dict) -> list[tuple[str, bool, str]]:
    """(what, whether it is there, how) of what the library needs and what the registry names."""
    import importlib.util
    import shutil

    from .sources.storage import Storage, uri_of

    out = [("java", shutil.which("java") is not None, shutil.which("java") or "not on the path")]
    for name, needed in (("pyspark", True), ("pyarrow", True), ("pandas", True), ("numpy", True), ("yaml", False)):
        there = importlib.util.find_spec(name) is not None
        out.append((name, there or not needed, "there" if there else "missing" if needed else "missing; only registries need it"))
    for name, entry in sorted(registry["catalogues"].items()):
        try:
            there = Storage().exists(uri_of(entry["path"]))
            out.append((name, there, entry["path"]))
        except Exception as e:
            out.append((name, False, str(e)[:100]))
    return out


def registry_command(args, registry: dict, spark) -> int:
    """Commands about registries; each prints lines of names."""
    from .sources import config, files, tap

    if args.command == "search":
        for name, entry in sorted(registry["catalogues"].items()):
            if all(w.lower() in f"{name} {entry.get('description', '')}".lower() for w in args.words):
                print(f"{name}\t{entry.get('description', '')}")
    elif args.command == "discover":
        columns: dict[str, list] = {}
        found = tap.searched(files.read(spark, args.tables), args.words)
        wanted = files.read(spark, args.columns).join(found.select("table_name"), "table_name", "left_semi")
        for r in wanted.collect():
            columns.setdefault(r.table_name, []).append((r.column_name, r.ucd))
        for name in sorted(columns):
            try:
                print(name, *(f"{k}={v}" for k, v in sorted(tap.entry_of(name, args.service, columns[name]).items())), sep="\t")
            except MatchError as e:
                print(f"{name}\t{e}")
    else:
        bundled = config.load(args.bundled)
        if args.command == "drift":
            found = config.drift(bundled, registry)
            for name, how in found:
                print(f"{name}\t{how}")
            return int(any(how == "outdated" for _, how in found) or (args.strict and bool(found)))
        if not args.config:
            print("adopt needs --config, the registry to write", file=sys.stderr)
            return 2
        config.save(config.adopted(registry, bundled, args.names), args.config)
    return 0


def run(argv: list[str], spark=None) -> int:
    args = parser().parse_args(argv)
    from . import sides
    from .functions.geometry import cone
    from .operators import match as m
    from .operators import multi
    from .sources import config, files

    registry = config.load(*([args.config] if getattr(args, "config", None) else []))
    if args.command == "list":
        for name, entry in sorted(registry["catalogues"].items()):
            print(f"{name}\t{entry.get('description', '')}")
        return 0
    if args.command == "completion":
        print(completion(args.shell))
        return 0
    if args.command in ("search", "adopt", "drift"):
        return registry_command(args, registry, spark)
    if args.command in ("match", "union", "nway", "fof") and len(args.catalogues) < 2:
        print("at least two catalogues are needed", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("skyzone").getOrCreate()
    if args.command == "discover":
        return registry_command(args, registry, spark)
    if args.command == "doctor":
        found = doctor(registry)
        for what, well, how in found:
            print(f"{'ok' if well else 'BAD'}\t{what}\t{how}")
        return int(not all(well for _, well, _ in found))
    if args.command == "sync":
        from .sources import mirror

        reports = mirror.replicate(spark, args.source, args.targets)
        for root, r in reports.items():
            print(f"{root}\t{len(r.copied)} copied\t{len(r.kept)} kept\t{len(r.pruned)} pruned\t{len(r.failed)} failed")
        return int(any(r.failed for r in reports.values()))
    if args.command == "describe":
        c = config.resolve(spark, args.name, registry)
        for name, kind in c.df.dtypes:
            print(f"{name}\t{kind}")
        return 0
    if args.command == "convert":
        c = config.resolve(spark, args.input, registry).resolved() if args.output.endswith(".hats") else config.resolve(spark, args.input, registry)
        files.write(c.df, args.output, single=True, ra=c.ra, dec=c.dec)
        return 0
    ids = args.ids.split(",") if args.ids else [None] * len(args.catalogues)
    if len(ids) != len(args.catalogues):
        print("--ids must name one column a catalogue", file=sys.stderr)
        return 2
    given = dict(x.partition("=")[::2] for x in args.set)
    own = sides.overrides({**({"columns": args.columns} if args.columns else {}), **given}, len(args.catalogues))
    for k, i in enumerate(ids):
        if i:
            own[k].setdefault("id", i)
    for o in own:
        for role in ("epoch", "default_error"):
            if role in o:
                o[role] = float(o[role])
    spec = None if args.command == "nway" else MatchSpec(radius_arcsec=args.radius, matcher=args.matcher, max_error=args.max_error, target_epoch=args.target_epoch)
    cats = [config.resolve(spark, name, registry, **{k: v for k, v in o.items() if k != "columns"}) for name, o in zip(args.catalogues, own)]
    if args.region:
        ra, dec, radius = map(float, args.region.split(","))
        places = [c.resolved() for c in cats]
        cats = [cats[0], *(replace(c, df=cone(c.df, c.ra, c.dec, (ra, dec), radius)) for c in places[1:])]
    cats = [sides.projected(c, None if "columns" not in o else [x for x in o["columns"].split(",") if x in c.df.columns or not args.columns], spec) for c, o in zip(cats, own)]
    if args.command == "nway":
        out = multi.nway(cats, args.radius, cap=args.cap, default_sigma=args.sigma)
    else:
        if args.command == "fof":
            out = multi.friends_of_friends(cats, spec)
        elif args.command == "union":
            out = multi.star_union(cats, spec) if args.star else multi.chain(cats, spec, union=True, position=bool(args.output) and args.output.endswith(".hats"))
        elif args.id_join:
            if len(cats) != 2 or not args.ids:
                print("an id join needs two catalogues and --ids", file=sys.stderr)
                return 2
            out = m.id_join(cats[0].df, cats[1].df, ids[0], ids[1], args.join)
        else:
            spec = replace(spec, join_type=args.join, find=args.find, filter_expr=args.where, probabilistic=args.probabilistic)
            out = m.match(cats[0], cats[1], spec) if len(cats) == 2 else multi.chain(cats, spec)
    if args.output:
        c = cats[0].resolved()
        ra, dec = ("_union_ra", "_union_dec") if "_union_ra" in out.columns else (c.ra, c.dec)
        files.write(out, args.output, single=True, ra=ra, dec=dec)
    else:
        import csv

        w = csv.writer(sys.stdout)
        w.writerow(out.columns)
        for row in out.toLocalIterator():
            w.writerow(["" if v is None else v for v in row])
    return 0


def main() -> None:
    try:
        code = run(sys.argv[1:])
        from pyspark.sql import SparkSession

        from . import shared

        if SparkSession.getActiveSession():
            shared.clean(SparkSession.getActiveSession())
        sys.exit(code)
    except MatchError as e:
        print(f"error: {e}", file=sys.stderr)
        sys.exit(1)
    except KeyboardInterrupt:
        sys.exit(130)


if __name__ == "__main__":
    main()
