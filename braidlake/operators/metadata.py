"""Metadata of a catalog: key and JSON-value tables, row estimates, size and version."""

from __future__ import annotations

import hashlib
import json
import urllib.request

from braidlake import __version__
from braidlake.functions import codec
from braidlake.sources.catalog import Catalog

# The names of the fields, in the API's order.
FIELDS = (
    "lastProcessedHeight", "lastProcessedTimestamp", "targetHeight", "startHeight", "chain", "specName", "genesisHash", "evmChainId",
    "lastFinalizedVerifiedHeight", "unfinalizedBlocks", "lastCreatedPoiHeight", "latestSyncedPoiHeight", "indexerHealthy",
    "indexerNodeVersion", "queryNodeVersion", "rowCountEstimate", "dbSize", "dynamicDatasources", "deployments", "historicalStateEnabled",
)


def _value(text):
    """A value, which is JSON or JSON within a JSON string."""
    for _ in range(2):
        if isinstance(text, str):
            try:
                text = json.loads(text)
            except ValueError:
                return text
    return text


def metadata(catalog: Catalog, chain: str | None = None, wanted: set[str] | None = None, external=None, tables: dict | None = None) -> dict | None:
    """Metadata of a chain: the plain table, the one whose chain it is, or the first. None where there is no table.

    external() may give more fields (a service's); the table's own come first. Only wanted estimates are computed.
    """
    tables = catalog.metadata if tables is None else tables
    if not tables:
        return None
    read = {n: {r[0]: _value(r[1]) for r in tables[n]().collect()} for n in tables}
    if chain is None:
        name = "_metadata" if "_metadata" in read else next(iter(sorted(read)))
    else:
        fits = [n for n in sorted(read) if str(read[n].get("chain")) == chain or n.endswith(chain)]
        if not fits:
            return None
        name = fits[0]
    out = {f: None for f in FIELDS} | {k: v for k, v in (external() if external else {}).items() if k in FIELDS} | {k: v for k, v in read[name].items() if k in FIELDS}
    out["queryNodeVersion"] = __version__
    if wanted is None or "rowCountEstimate" in wanted:
        out["rowCountEstimate"] = [{"table": n, "estimate": c} for n, c in sorted(catalog.row_estimates().items())]
    if wanted is None or "dbSize" in wanted:
        out["dbSize"] = str(catalog.size_in_bytes())
    return out


def service(url: str, timeout: float = 5.0) -> dict:
    """Fields that a service tells under /meta and /health; what doesn't answer in time adds none. For an engine's external_metadata."""
    out: dict = {}
    for path in ("/health", "/meta"):
        try:
            with urllib.request.urlopen(url.rstrip("/") + path, timeout=timeout) as r:
                got = json.loads(r.read())
        except (OSError, ValueError):
            continue
        if isinstance(got, dict):
            out |= {k: v for k, v in got.items() if k in FIELDS}
        if path == "/health":
            out["indexerHealthy"] = True
    return out


def metadatas(catalog: Catalog) -> dict:
    """A node for each metadata table; cursors are places."""
    names = sorted(catalog.metadata)
    nodes = [metadata(catalog, tables={n: catalog.metadata[n]}) for n in names]
    return {"totalCount": len(nodes), "nodes": nodes, "edges": [{"cursor": codec.encode([i + 1]), "node": n} for i, n in enumerate(nodes)]}


def channel(schema: str, table: str, kind: str) -> str:
    """Name of a table's notification channel: the first 63 hexadecimal digits of a BLAKE2b hash of its parts."""
    return hashlib.blake2b(f"{schema}_{table}_{kind}".encode()).hexdigest()[:63]
