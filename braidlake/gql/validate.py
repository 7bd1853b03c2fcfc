"""What a request may cost: depth, complexity, aliases, and requests in a batch."""

from __future__ import annotations

from dataclasses import dataclass

from braidlake.errors import RequestError
from braidlake.gql.parser import Document, Field, Inline, Operation, Spread


@dataclass(frozen=True)
class Limits:
    """None: no limit."""

    depth: int | None = None
    complexity: int | None = None
    aliases: int | None = None
    batch: int | None = None


def _inside(doc: Document, item, seen: tuple[str, ...]) -> tuple[list, tuple[str, ...]]:
    """Selection below an item, and the fragments entered so far; a fragment within itself is an error."""
    if isinstance(item, Spread):
        if item.name in seen:
            raise RequestError(f"fragment {item.name!r} contains itself")
        if item.name not in doc.fragments:
            raise RequestError(f"no fragment {item.name!r}")
        return doc.fragments[item.name].selection, (*seen, item.name)
    return item.selection or [], seen


def depth(doc: Document, selection: list, seen: tuple[str, ...] = ()) -> int:
    """Nesting of fields; fragments add none."""
    most = 0
    for item in selection:
        inner, below = _inside(doc, item, seen)
        most = max(most, isinstance(item, Field) + (depth(doc, inner, below) if inner else 0))
    return most


def complexity(doc: Document, selection: list, seen: tuple[str, ...] = ()) -> int:
    """One for each field, those of fragments wherever they are spread."""
    total = 0
    for item in selection:
        inner, below = _inside(doc, item, seen)
        total += isinstance(item, Field) + complexity(doc, inner, below)
    return total


def aliases(doc: Document, selection: list, seen: tuple[str, ...] = ()) -> int:
    total = 0
    for item in selection:
        inner, below = _inside(doc, item, seen)
        total += (isinstance(item, Field) and item.alias != item.name) + aliases(doc, inner, below)
    return total


def check(doc: Document, op: Operation, limits: Limits) -> int:
    """The operation's complexity; an error if it is beyond a limit. The introspection query may be deep and large."""
    cost = complexity(doc, op.selection)
    if limits.depth is not None and op.name != "IntrospectionQuery" and (d := depth(doc, op.selection)) > limits.depth:
        raise RequestError(f"the query's depth is {d}; {limits.depth} is allowed")
    if limits.complexity is not None and op.name != "IntrospectionQuery" and cost > limits.complexity:
        raise RequestError(f"the query's complexity is {cost}; {limits.complexity} is allowed")
    if limits.aliases is not None and (a := aliases(doc, op.selection)) > limits.aliases:
        raise RequestError(f"the query has {a} aliases; {limits.aliases} are allowed")
    return cost


def check_batch(n: int, limits: Limits) -> None:
    if limits.batch is not None and n > limits.batch:
        raise RequestError(f"the batch has {n} requests; {limits.batch} are allowed")


__all__ = ["Inline", "Limits", "aliases", "check", "check_batch", "complexity", "depth"]
