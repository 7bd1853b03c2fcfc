"""Full-text search: every token of the query among the words of a row's text columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.errors import RequestError
from braidlake.plans.ordering import Term, beyond
from braidlake.plans.predicates import Scope

#: Words are runs of letters, digits, underscores and hyphens of any script.
_BREAK = r"[^\p{L}\p{N}_-]+"


def tokens(query: str) -> list[str]:
    """The query's tokens: parts between white space, without any other character, in lower case."""
    kept = (re.sub(r"[^\w-]", "", part).lower() for part in query.split())
    return list(dict.fromkeys(t for t in kept if t))


def matches(text: Column, wanted: list[str]) -> Column:
    """All tokens are words of the text. The substring tests reach the scan's rows before any word is split off."""
    low = F.lower(text)
    rough = reduce(lambda a, b: a & b, [low.contains(t) for t in wanted])
    words = F.split(low, _BREAK)
    return rough & reduce(lambda a, b: a & b, [F.array_contains(words, t) for t in wanted])


def score(text: Column, wanted: list[str]) -> Column:
    """Occurrences of the tokens among the words."""
    return F.size(F.filter(F.split(F.lower(text), _BREAK), lambda w: w.isin(*wanted)))


def search(scope: Scope, query: str) -> DataFrame | None:
    """Valid rows that match, with __score; None for a query without tokens, which finds nothing. The entity's own finder comes first."""
    columns, finder = scope.entity.declared.search, scope.entity.declared.finder
    if finder is not None and query.strip():
        found = finder(scope.frame(), query)
        return found if "__score" in found.columns else found.withColumn("__score", F.lit(0))
    if not columns:
        raise RequestError(f"{scope.entity.type_name} has no search")
    wanted = tokens(query)
    if not wanted:
        return None
    text = F.concat_ws(" ", *(scope.col(c) for c in columns))
    return scope.frame(matches(text, wanted)).withColumn("__score", score(text, wanted))


def ranked(scope: Scope, query: str, first: int, offset: int = 0, after: dict | None = None) -> DataFrame | None:
    """A page of the matches, most occurrences first, ties by key; after: the place of a row, by __score and key, that the page follows."""
    rows = search(scope, query)
    if rows is None:
        return None
    if after is not None:
        terms = [Term("__score", descending=True), *(Term(k) for k in scope.entity.declared.key)]
        if set(after) != {t.column for t in terms}:
            raise RequestError("the cursor is from another order")
        rows = rows.where(beyond(terms, [after[t.column] for t in terms], [rows.schema[t.column].dataType for t in terms]))
    return rows.orderBy(F.desc("__score"), *(scope.col(c) for c in scope.entity.tiebreak)).offset(offset).limit(first)
