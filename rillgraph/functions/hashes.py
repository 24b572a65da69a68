"""Length-prefixed hashing on the driver, equal to functions.scalars.hash_parts."""

from __future__ import annotations

import hashlib


def hash_bytes(*parts: bytes) -> str:
    return hashlib.sha256(b"".join(len(p).to_bytes(8, "little") + p for p in parts)).hexdigest()


def namespace(policy_digest: str, flags: dict[str, bool]) -> str:
    """The store's namespace: results of another policy or other options are never reused."""
    return hash_bytes(policy_digest.encode(), *[f"{k}={v}".encode() for k, v in sorted(flags.items())])
