"""Opaque cursors and node ids: base64 of JSON."""

from __future__ import annotations

import base64
import binascii
import json

from braidlake.errors import RequestError


def encode(value) -> str:
    return base64.b64encode(json.dumps(value, separators=(",", ":"), ensure_ascii=False, default=str).encode()).decode()


def decode(text: str, kind: type):
    try:
        value = json.loads(base64.b64decode(text, validate=True))
    except (binascii.Error, ValueError) as e:
        raise RequestError(f"not a valid cursor or node id: {text!r}") from e
    if not isinstance(value, kind):
        raise RequestError(f"not a valid cursor or node id: {text!r}")
    return value


def node_id(table: str, key: list) -> str:
    return encode([table, *key])
