"""The request API over HTTP: catalogue reads and algorithm runs, with the engine's error codes."""

from __future__ import annotations

import json
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from .engine import Engine
from .errors import BadRequest, CohortError, status_of
from .specs import TRANSFORMERS, Spec


def spec_dto(s: Spec) -> dict[str, Any]:
    """What a client needs to build a request: inputs, parameters with their labels and defaults, and the steps and flags that go with it."""
    inputs = {"data_model": {"required": True}, "datasets": {"required": True, "multiple": True}, "filter": {"required": False}, "y": asdict(s.y)}
    if s.x is not None:
        inputs["x"] = asdict(s.x)
    if s.validation:
        inputs["validation_datasets"] = {"required": True, "multiple": True}
    listed = lambda parameters: {k: {**asdict(p), "label": p.label or k} for k, p in parameters.items()}
    steps = [{"name": step, "parameters": listed(p)} for step, p in TRANSFORMERS.items()] if s.longitudinal else []
    return {"name": s.name, "label": s.label or s.name.replace("_", " ").capitalize(), "desc": s.desc, "inputdata": inputs, "parameters": listed(s.parameters), "preprocessing": steps, "flags": ["smpc"]}


def dispatch(engine: Engine, method: str, path: str, body: dict[str, Any] | None = None) -> tuple[int, Any]:
    """Status and JSON-ready answer of one call."""
    parts = [p for p in path.split("?")[0].split("/") if p]
    try:
        if method == "GET" and len(parts) == 1:
            if parts[0] == "healthcheck":
                from .sources.csv_models import healthcheck

                return 200, {"healthy": healthcheck(engine.spark)}
            if parts[0] == "algorithms":
                return 200, [spec_dto(engine.specs[n]) for n in engine.algorithms()]
            if parts[0] == "datasets":
                return 200, {m: engine.datasets(m) for m in engine.models}
            if parts[0] == "datasets_locations":
                return 200, {m: engine.locations(m) for m in engine.models}
            if parts[0] == "datasets_variables":
                return 200, {m: {d: list(engine.cdes_metadata(m)) for d in engine.datasets(m)} for m in engine.models}
            if parts[0] == "cdes_metadata":
                return 200, {m: {c: asdict(v) for c, v in engine.cdes_metadata(m).items()} for m in engine.models}
            if parts[0] == "data_models_attributes":
                return 200, {m: {"tags": list(v.tags), "properties": v.properties, "longitudinal": v.longitudinal} for m, v in engine.models.items()}
        if (method, parts) == ("POST", ["wla"]):
            engine.refresh()
            return 200, ""
        if (method, parts) == ("GET", ["flower", "input"]):
            return 200, engine.learner_input
        if (method, parts) == ("POST", ["flower", "result"]):
            engine.learner_result = body
            return 200, {"message": "Result set successfully"}
        if method == "POST" and len(parts) == 2 and parts[0] == "algorithms":
            if not isinstance(body, dict) or unknown_keys(body):
                raise BadRequest(f"The request body is not valid: {sorted(unknown_keys(body)) if isinstance(body, dict) else body!r}.")
            return 200, engine.run(parts[1], body)
        return 404, {"error": f"No such resource: {method} {path}"}
    except CohortError as error:
        return status_of(error), {"error": str(error)}


def unknown_keys(body: dict[str, Any]) -> set[str]:
    return set(body) - {"request_id", "inputdata", "parameters", "flags", "preprocessing"}


def serve(engine: Engine, port: int = 5000) -> ThreadingHTTPServer:
    """A server for the engine; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body: dict[str, Any] | None = None) -> None:
            status, out = dispatch(engine, self.command, self.path, body)
            data = json.dumps(out, default=float).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self._answer()

        def do_POST(self) -> None:  # noqa: N802
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                body = None
            self._answer(body)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer(("", port), Handler)
