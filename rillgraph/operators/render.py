"""Reports of findings as JSON, text or SARIF; a report is small and made on the driver."""

from __future__ import annotations

import json
from collections import Counter
from urllib.parse import quote

from pyspark.sql import DataFrame

KEY = ("repo", "fn", "class", "cs", "term_fn", "term_cs")


def rows(chains: DataFrame) -> list[dict]:
    """The findings in their one order."""
    return [r.asDict(recursive=True) for r in chains.orderBy(*[c for c in KEY if c in chains.columns]).collect()]


def as_json(found: list[dict]) -> str:
    return json.dumps(found, indent=2, sort_keys=True) + "\n"


def as_text(found: list[dict]) -> str:
    """A block per finding and a count per class."""
    out = []
    width = max((len(f["fn"]) for f in found), default=0)
    for k, f in enumerate(found, 1):
        out.append(f"{k}. {f['class']}  {f['fn'].ljust(width)} -> {f['term_fn']}  (site {f['term_cs']})")
        out += [f"     {h}" for h in f.get("hops") or []]
    counts = Counter(f["class"] for f in found)
    out += [f"{c}: {n}" for c, n in sorted(counts.items())] or ["no findings"]
    return "\n".join(out) + "\n"


def uri_escape(path: str) -> str:
    return quote(path, safe="/-._~!$&'()*+,;=:@")


def as_sarif(found: list[dict], severity, tool: str = "rillgraph", files: dict[str, tuple[str, int]] | None = None) -> str:
    """SARIF 2.1.0: a rule per class, a result per finding with its route as a code flow. files: fn -> (path, line)."""
    files = files or {}

    def place(fn: str, text: str) -> dict:
        path, line = files.get(fn, ("", 0))
        physical = {"physicalLocation": {"artifactLocation": {"uri": uri_escape(path), "uriBaseId": "SRCROOT"}, "region": {"startLine": max(1, line)}}} if path else {}
        return {**physical, "logicalLocations": [{"fullyQualifiedName": fn}], "message": {"text": text}}

    classes = sorted({f["class"] for f in found})
    results = []
    for f in found:
        hops = f.get("hops") or [f["fn"], f["term_fn"]]
        flow = [{"location": place(h.split("#")[0], h)} for h in hops]
        results.append({"ruleId": f["class"], "ruleIndex": classes.index(f["class"]), "level": severity(f["class"]), "message": {"text": f"{f['class']}: {f['fn']} reaches {f['term_fn']}"}, "locations": [place(f["fn"], "source")], "codeFlows": [{"threadFlows": [{"locations": flow}]}], "partialFingerprints": {"finding/v1": "|".join(str(f[k]) for k in KEY if k in f and k not in ("cs", "term_cs"))}})
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": c, "defaultConfiguration": {"level": severity(c)}} for c in classes]}}, "originalUriBaseIds": {"SRCROOT": {"description": {"text": "the root of the repository"}}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2) + "\n"


def gate(found: list[dict], fail_on: list[str], classes: set[str]) -> int:
    """3 if a finding is of a class in fail_on, else 0; 2 if a class is none of the policy's."""
    if set(fail_on) - classes:
        return 2
    return 3 if any(f["class"] in fail_on for f in found) else 0
