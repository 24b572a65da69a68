"""Small programs for tests, in the notation P0, A0@1, R0@1, ret0 with field paths as P0[3]."""

from __future__ import annotations

import re

from rillgraph.plans.taint import Program

KINDS = {"P": 0, "recv": 1, "G": 2, "ret": 3, "byref": 4, "F": 5, "A": 6, "R": 7, "byrefrecv": 8}
_TOKEN = re.compile(r"^(P|A|R|ret|byref|recv|byrefrecv|G|F)(\d*)(?:@(\d+))?(?:\{([^}]*)\})?(?:\[([\d,]*)\])?$")


class Builder:
    def __init__(self):
        self.functions, self.vertices, self.edges, self.calls, self.targets, self.contracts = [], [], [], [], [], []

    def function(self, iid, flows=(), calls=(), sources=(), repo="r", has_flow=True, only=(), types=None, names=None):
        """flows: "P0->A0@0"; calls: dict per call site; only: vertices without edges."""
        ids: dict[str, int] = {}
        types, names = types or {}, names or {}

        def vertex(text):
            if text not in ids:
                kind, idx, cs, sym, path = _TOKEN.match(text).groups()
                ids[text] = len(ids)
                cell, _, assertion = (sym or "").partition(":")
                self.vertices.append((iid, ids[text], KINDS[kind], int(idx or 0), [int(x) for x in path.split(",")] if path else [], int(cs) if cs else -1, cell, cell, assertion, types.get(text, ""), names.get(text, [])))
            return ids[text]

        for f in flows:
            a, b = f.split("->")
            self.edges.append((iid, vertex(a), vertex(b)))
        for t in only:
            vertex(t)
        self.functions.append((iid, iid, repo, has_flow, list(sources)))
        for cs, c in enumerate(calls):
            self.calls.append((iid, cs, c.get("kind", 0), c.get("callee", ""), c.get("argc", 1), c.get("resultc", 0), c.get("recv", False), c.get("conf", 1.0), c.get("stream", 0), c.get("client", False), c.get("errors", 0)))
            self.targets += [(iid, cs, t) for t in c.get("targets", [])]
        return self

    def contract(self, iid, handler, kind=0, client=False, server=False, gql=(), params=()):
        self.contracts.append((iid, handler, kind, client, server, list(gql), list(params)))
        return self

    def build(self, spark) -> Program:
        frame = spark.createDataFrame
        return Program(
            frame(self.functions, "iid string, fqn string, repo string, has_flow boolean, source_params array<int>"),
            frame(self.vertices, "fn string, vid int, kind int, idx int, path array<int>, cs int, sym string, sym_name string, iface_type string, type string, field_names array<string>"),
            frame(self.edges, "fn string, src int, dst int"),
            frame(self.calls, "fn string, cs int, kind int, callee_fqn string, argc long, resultc long, recv boolean, dispatch_confidence double, stream_op int, stream_client boolean, error_results long"),
            frame(self.targets, "fn string, cs int, callee string"),
            frame(self.contracts, "iid string, handler string, kind int, client_streaming boolean, server_streaming boolean, gql_param_idx array<int>, request_params array<int>") if self.contracts else None,
        )
