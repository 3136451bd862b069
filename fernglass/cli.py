"""Commands: embed, check, overview, search, list, get, serve. Exit codes: 0 done, 1 problems found, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys
import threading
from typing import Any

from fernglass import render
from fernglass.config import Config
from fernglass.errors import EngineError, InvalidRequest, StartupError, UsageError
from fernglass.operators.filters import Filter
from fernglass.sources.frontmatter import epoch_ms


class Once(argparse.Action):
    """A flag that takes one value: a second one is a mistake."""

    def __call__(self, parser, namespace, values, option_string=None):
        seen = namespace.__dict__.setdefault("_seen", set())
        if self.dest in seen:
            parser.error(f"{option_string} is given more than once")
        seen.add(self.dest)
        setattr(namespace, self.dest, True if self.nargs == 0 else values)


class Flag(Once):
    def __init__(self, option_strings, dest, **more):
        super().__init__(option_strings, dest, nargs=0, default=False, **more)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fernglass", allow_abbrev=False)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help, allow_abbrev=False)
        c.add_argument("--source", required=True, action=Once)
        c.add_argument("--target", action=Once)
        return c

    def filtered(c: argparse.ArgumentParser) -> None:
        c.add_argument("--tag", action="append", default=[])
        c.add_argument("--tag-any", action="append", default=[])
        c.add_argument("--dir", action=Once)
        c.add_argument("--since", action=Once, help="at or after an ISO date")
        c.add_argument("--json", action=Flag)

    command("embed", "bring stored chunks up to date").add_argument("--rechunk", action=Flag)
    command("check", "name every problem")
    filtered(command("overview", "counts and tags"))
    c = command("search", "ranked chunks")
    c.add_argument("query")
    c.add_argument("--mode", action=Once, choices=("hybrid", "semantic", "keyword"))
    c.add_argument("--limit", action=Once, type=int)
    c.add_argument("--expand", action=Once, type=int)
    c.add_argument("--min-score", action=Once, type=float)
    c.add_argument("--weight", action="append", default=[], metavar="NAME=NUMBER")
    filtered(c)
    c = command("list", "documents")
    c.add_argument("--sort", action=Once, choices=("path", "updated_at"), default="path")
    c.add_argument("--offset", action=Once, type=int, default=0)
    c.add_argument("--limit", action=Once, type=int, default=50)
    filtered(c)
    c = command("get", "a document or a section")
    c.add_argument("ref")
    c.add_argument("--json", action=Flag)
    c = command("serve", "answer over HTTP")
    c.add_argument("--port", action=Once, type=int, default=8080)
    c.add_argument("--host", action=Once, default="127.0.0.1", help="the address to listen on; beyond this machine there is no check of hosts")
    return p


def filter_of(a: argparse.Namespace) -> dict[str, Any]:
    out: dict[str, Any] = {"tags": a.tag, "tags_any": a.tag_any}
    if a.dir is not None:
        out["dir"] = a.dir
    if a.since is not None:
        try:
            out["updated_after"] = Filter.since(epoch_ms(a.since)).updated_after
        except ValueError as e:
            raise InvalidRequest(str(e)) from None
    return out


def weights_of(pairs: list[str]) -> dict[str, float]:
    out: dict[str, float] = {}
    for pair in pairs:
        name, sep, value = pair.rpartition("=")
        try:
            number = float(value)
        except ValueError:
            raise InvalidRequest(f"--weight {pair}: not NAME=NUMBER") from None
        if not sep or not name or name in out:
            raise InvalidRequest(f"--weight {pair}: not NAME=NUMBER, or given twice")
        out[name] = number
    return out


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("fernglass").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run(argv: list[str], spark=None, out=None, **engine_options: Any) -> int:
    from fernglass import engine as E

    out = out or sys.stdout
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    say = lambda s: print(s, file=out)
    try:
        config = Config.load({"source": a.source, **({"target": a.target} if a.target else {})})
        spark = spark or session()
        if a.command == "embed":
            report = E.embed(spark, config.source, config.target, engine_options.get("embedder"), rechunk=a.rechunk)
            say(json.dumps(report | {"failures": len(report["failures"])}))
            for path, reason in report["failures"]:
                say(f"{path}: {reason}")
            errors = E.markdown.load_errors(E.markdown.scan(spark, config.source, config.target)).collect()
            for r in errors:
                say(f"{r.path}: {r.reason}")
            return int(bool(report["failures"] or errors))
        if a.command == "check":
            found = E.check(spark, config.source, config.target)
            say(E.markdown.report(found) or "fresh")
            if found:
                say(f"{len({path for path, _ in found})} path(s) with problems")
            return int(bool(found))
        if a.command == "serve":
            return _serve(lambda: E.create_engine(spark, config.source, config.target, **engine_options), a.host, a.port, say)
        own = E.create_engine(spark, config.source, config.target, **engine_options)
        if a.command == "overview":
            result, show = own.overview(filter_of(a)), render.overview
        elif a.command == "list":
            result, show = own.list_documents({"filter": filter_of(a), "sort": a.sort, "offset": a.offset, "limit": a.limit}), render.listing
        elif a.command == "get":
            result, show = own.get_document(a.ref), render.document
        else:
            request = {"query": a.query, "filter": filter_of(a), "weights": weights_of(a.weight), "mode": a.mode, "limit": a.limit, "expand": a.expand, "min_score": a.min_score}
            result, show = own.search({k: v for k, v in request.items() if v is not None}), render.search
        say(json.dumps(result, ensure_ascii=False, default=str) if a.json else show(result))
        return 0
    except UsageError as e:
        say(f"usage: {e}")
        return 2
    except EngineError as e:
        say(f"{e.kind}: {e}")
        return 1


def _serve(create, host: str, port: int, say) -> int:
    """Listen first, so a taken port costs nothing; answer "not ready" until the engine is there."""
    from fernglass.http import own_names, serve

    state: dict[str, Any] = {"engine": None}
    try:
        server = serve(state, port, host)
    except OSError as e:
        raise StartupError(f"can't listen on {host}:{port}: {e}") from None
    say(f"listening on {host}:{server.server_address[1]}")
    if own_names(host) is None:
        say("others can reach this address; there is no authentication")
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        state["engine"] = create()
        say("ready")
        thread.join()
    except KeyboardInterrupt:
        pass
    finally:
        server.shutdown()
        server.server_close()
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
