"""Policy files: TOML with sources, sinks, sanitizers, error_wrappers, propagators and severity."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.hashes import hash_bytes
from ..operators.policy import SCHEMA

SECTIONS = ("sources", "sinks", "sanitizers", "error_wrappers", "propagators")
SEVERITIES = ("error", "warning", "note")


class PolicyError(ValueError):
    pass


@dataclass
class Policy:
    rows: list[tuple]
    severity: dict[str, str]
    ignore_types: tuple[str, ...]
    digest: str

    def rules(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)

    def sink_classes(self) -> set[str]:
        return {r[2] for r in self.rows if r[0] == "sinks"}

    def severity_of(self, klass: str) -> str:
        return self.severity.get(klass, "warning")


def _ports(value, where: str) -> str:
    parts = value if isinstance(value, list) else [p.strip() for p in str(value).split(",")]
    for p in map(str, parts):
        if p not in ("return", "any", "args", "receiver", "none") and not p.isdigit():
            raise PolicyError(f"{where}: {p!r} is no port")
    return ",".join(map(str, parts))


def parse(text: str) -> Policy:
    """Raises PolicyError where a rule has no selector, a regex or port that is none, or `to` outside sources."""
    raw = tomllib.loads(text)
    rows = []
    for section in SECTIONS:
        for k, r in enumerate(raw.get(section, [])):
            label = r.get("selector") or r.get("selector_regex")
            where = f"[[{section}]] rule {label!r}"
            if label is None:
                raise PolicyError(f"{where}: needs selector or selector_regex")
            if r.get("selector_regex"):
                try:
                    re.compile(r["selector_regex"])
                except re.error as e:
                    raise PolicyError(f"{where}: {e}") from None
            if "to" in r and section not in ("sources", "propagators"):
                raise PolicyError(f"{where}: `to` applies to sources only")
            arg = "any"
            if section == "sources":
                arg = _ports(r.get("to", "return"), where)
            elif section == "propagators":
                arg = f"{_ports(r.get('from', 'any'), where)}>{_ports(r.get('to', 'return'), where)}"
            elif section == "sinks":
                arg = str(r.get("arg") or "any")
                if arg not in ("any", "args") and not arg.isdigit():
                    raise PolicyError(f"{where}: arg must be any, args or an index")
            rows.append((section, k, r.get("class") or r.get("kind") or "", r.get("selector"), r.get("selector_regex"), arg))
    for klass, s in raw.get("severity", {}).items():
        if s not in SEVERITIES:
            raise PolicyError(f"[severity] {klass!r}: expected one of {', '.join(SEVERITIES)}")
    return Policy(rows, dict(raw.get("severity", {})), tuple(raw.get("sink_ignore_arg_types", [])), hash_bytes(text.encode()))


def load(path: str) -> Policy:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
