"""Names of the API, from names of tables and columns."""

from __future__ import annotations

import re

_VOWELS = "aeiou"


def _words(name: str) -> tuple[str, list[str]]:
    inner = name.lstrip("_")
    return name[: len(name) - len(inner)], [w for w in inner.split("_") if w]


def camel(name: str) -> str:
    """snake_case to camelCase; leading underscores stay."""
    lead, words = _words(name)
    return lead + "".join(w if i == 0 else w[0].upper() + w[1:] for i, w in enumerate(words))


def pascal(name: str) -> str:
    lead, words = _words(name)
    return lead + "".join(w[0].upper() + w[1:] for w in words)


def enum_item(name: str) -> str:
    return name.upper()


def enum_type(name: str) -> str:
    """Type name of an enumeration: words also break where a letter follows a digit; a leading digit gets an underscore."""
    if name[:1].isdigit():
        name = "_" + name
    inner = name.lstrip("_")
    words = [w for w in re.split(r"_|(?<=\d)(?=[A-Za-z])", inner) if w]
    return name[: len(name) - len(inner)] + "".join(w[0].upper() + w[1:].lower() for w in words)


def plural(word: str) -> str:
    if re.fullmatch(r"(.*_)?metadatum", word):
        return word[: -len("metadatum")] + "metadata"
    if word.endswith("y") and word[-2:-1] not in tuple(_VOWELS):
        return word[:-1] + "ies"
    return word + ("es" if re.search(r"(s|x|z|ch|sh)$", word) else "s")


def singular(word: str) -> str:
    if re.fullmatch(r"(.*_)?metadata", word):
        return word[: -len("metadata")] + "metadatum"
    if word.endswith("ies") and len(word) > 3:
        return word[:-3] + "y"
    if re.search(r"(ch|sh|x|z)es$", word):
        return word[:-2]
    if word.endswith("ses"):
        # A vowel and s before "es" is a stem of its own when short (buses), and part of a stem in -se otherwise (responses).
        return word[:-2] if word[-4:-3] in tuple(_VOWELS) else word[:-1]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def type_name(table: str) -> str:
    return pascal(singular(table))


def plural_type_name(table: str) -> str:
    """Plural of the type name; runs of capitals are lowered but for their first."""
    lead, words = _words(plural(singular(table)))
    name = lead + "".join(w[0].upper() + w[1:] for w in words)
    return re.sub(r"[A-Z]{2,}", lambda m: _lower_run(m, name), name)


def _lower_run(m: re.Match, name: str) -> str:
    run, ends = m[0], m.end() == len(name)
    if not ends and name[m.end()].islower() and name[m.end() :] != "s":
        return run[0] + run[1:-1].lower() + run[-1]
    return run[0] + run[1:].lower()


def connection_field(table: str) -> str:
    return camel(plural(singular(table)))


def single_field(table: str) -> str:
    return camel(singular(table))


def forward_field(column: str) -> str:
    """The parent that a foreign key leads to: the column without _id, _uuid or _fk."""
    return camel(re.sub(r"(?<=.)_(id|uuid|fk)$", "", column))


def backward_field(child: str, column: str) -> str:
    return f"{connection_field(child)}By{pascal(column)}"


def backward_single_field(child: str, column: str) -> str:
    return f"{single_field(child)}By{pascal(column)}"
