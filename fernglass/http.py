"""The engine over HTTP: overview, search, listing, documents, health."""

from __future__ import annotations

import ipaddress
import json
import re
import socket
from collections.abc import Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

from fernglass.errors import STATUS, EngineError, InvalidRequest, NotFound, StartupError, UsageError

MOST_BODY = 1 << 20
LISTS = ("tag", "tag_any")
SINGLES = ("dir", "updated_after")
#: Bytes of a body that is too large which are still read, so that the client gets the answer.
DRAIN = 16 << 20
LOCAL = ("localhost", "127.0.0.1", "[::1]")


def canonical(host: str) -> str:
    """One spelling of a host name or address, in brackets if it is IPv6; 127.1 is 127.0.0.1."""
    name = host.lower().removeprefix("[").removesuffix("]").removesuffix(".")
    if ":" not in name and re.fullmatch(r"(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+)){0,3}", name):
        try:
            return socket.inet_ntoa(socket.inet_aton(name))
        except OSError:
            return name
    try:
        found = ipaddress.ip_address(name)
    except ValueError:
        return name
    return f"[{found}]" if found.version == 6 else str(found)


def own_names(host: str) -> tuple[str, ...] | None:
    """The names that a server bound to host answers to if that is this machine, None if others can reach it."""
    name = canonical(host)
    try:
        at = ipaddress.ip_address(name.strip("[]"))
        at = getattr(at, "ipv4_mapped", None) or at
        local = at.is_loopback
    except ValueError:
        local = name == "localhost"
    return tuple(dict.fromkeys((*LOCAL, name))) if local else None


def parameters(query: str, more: tuple[str, ...] = ()) -> dict[str, Any]:
    """Query parameters as a request; unknown ones, and single ones that are repeated, are errors."""
    filter: dict[str, Any] = {}
    out: dict[str, Any] = {}
    for name, value in parse_qsl(query, keep_blank_values=True):
        if name in LISTS:
            filter.setdefault("tags" if name == "tag" else "tags_any", []).append(value)
            continue
        if name not in SINGLES + more:
            raise InvalidRequest(f"unknown parameter {name}")
        to = filter if name in SINGLES else out
        if name in to:
            raise InvalidRequest(f"{name} is given twice")
        to[name] = numeric(name, value) if name in ("updated_after", "offset", "limit") else value
    return out | ({"filter": filter} if filter else {})


def numeric(name: str, value: str) -> int | float:
    if not re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", value):
        raise InvalidRequest(f"{name} must be a number")
    number = float(value)
    return int(number) if number.is_integer() else number


def host_of(header: str) -> str:
    """The Host header without its port."""
    return canonical(re.sub(r":\d*$", "", header) if header.count(":") == 1 or "]" in header else header)


def answer(engine: Any, method: str, target: str, body: bytes = b"", host: str = "localhost", names: Sequence[str] | None = LOCAL) -> tuple[int, dict[str, Any]]:
    """Status and JSON of one request; engine may be None while it starts."""
    try:
        if names is not None and host_of(host) not in names:
            raise UsageError("requests must name this machine as their host")
        parts = urlsplit(target)
        path = parts.path
        allowed = "POST" if path == "/search" else "GET"
        known = path in ("/healthz", "/readyz", "/overview", "/search", "/documents") or path.startswith("/documents/")
        if not known:
            raise NotFound(f"nothing at {path}")
        if method != allowed:
            return 405, {"error": {"kind": "usage", "message": f"{path} takes {allowed}"}}
        if path == "/healthz":
            return 200, {"status": "ok"}
        if engine is None:
            raise StartupError("the engine isn't ready")
        if path == "/readyz":
            return 200, {"status": "ready"}
        if path == "/overview":
            return 200, engine.overview(parameters(parts.query).get("filter"))
        if path == "/documents":
            return 200, engine.list_documents(parameters(parts.query, ("sort", "offset", "limit")))
        if path == "/search":
            if len(body) > MOST_BODY:
                raise InvalidRequest(f"a body holds {MOST_BODY} bytes at most")
            try:
                request = json.loads(body)
            except ValueError:
                raise InvalidRequest("the body must be JSON") from None
            return 200, engine.search(request)
        pairs = parse_qsl(parts.query, keep_blank_values=True)
        given = dict(pairs)
        if len(pairs) > len(given):
            raise InvalidRequest("full is given twice")
        if odd := set(given) - {"full"}:
            raise InvalidRequest(f"unknown parameter {sorted(odd)[0]}")
        return 200, engine.get_document(unquote(path[len("/documents/") :], errors="strict"), full=given.get("full") == "true")
    except EngineError as e:
        return STATUS[e.kind], {"error": {"kind": e.kind, "message": str(e)}}
    except UnicodeDecodeError:
        return 400, {"error": {"kind": "invalid_request", "message": "the reference isn't UTF-8"}}
    except Exception as e:
        return 500, {"error": {"kind": "internal", "message": type(e).__name__}}


def serve(state: dict[str, Any], port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that listens at once and answers from state["engine"] as soon as there is one; until then it isn't
    ready. One that only this machine reaches answers to this machine's names alone."""
    names = own_names(host)

    class Server(ThreadingHTTPServer):
        address_family = socket.AF_INET6 if ":" in host else socket.AF_INET
        daemon_threads = True

    class Handler(BaseHTTPRequestHandler):
        def reply(self) -> None:
            length = self.headers.get("Content-Length") or "0"
            size = int(length) if length.isdigit() else 0
            body = self.rfile.read(min(size, MOST_BODY + 1))
            left = size - len(body)
            while 0 < left <= DRAIN and (more := self.rfile.read(min(left, 1 << 16))):
                left -= len(more)
            self.close_connection = left > 0
            status, out = answer(state.get("engine"), self.command, self.path, body, self.headers.get("Host", ""), names)
            raw = json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            try:
                self.end_headers()
                self.wfile.write(raw)
            except (BrokenPipeError, ConnectionResetError):  # the client has left
                self.close_connection = True

        do_GET = do_POST = do_PUT = do_DELETE = reply

        def log_message(self, *args: Any) -> None:
            pass

    return Server((host.strip("[]"), port), Handler)
