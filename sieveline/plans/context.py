"""What identifies a scan: digests of its configuration and of its selection policy."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Iterable

from sieveline.operators.scan import Config


def policy_digest(parts: Iterable[bytes]) -> str:
    """SHA-256 over parts, each with its length in front."""
    digest = hashlib.sha256(b"sieveline/policy/v1")
    for part in parts:
        digest.update(len(part).to_bytes(8, "little") + part)
    return digest.hexdigest()


def configuration_id(config: Config) -> str:
    """Equal for configurations that find the same; a key counts by its digest only."""
    rules = [dataclasses.asdict(r) for r in config.compiled()]
    key = hashlib.sha256((config.fingerprint_key or "").encode()).hexdigest()
    flags = json.dumps([config.min_entropy, config.base64, key], sort_keys=True)
    return policy_digest([json.dumps(rules, sort_keys=True).encode(), flags.encode()])


def context(mode: str, roots: list[str], config: Config, policy: Iterable[bytes] = ()) -> dict:
    """The scan context that a baseline belongs to."""
    return {"mode": mode, "roots": sorted(roots), "engine_configuration_id": configuration_id(config), "selection_policy_id": policy_digest([str(config.max_bytes).encode(), *policy])}
