r"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

A surrogate is a keyed permutation of the values of one form: letters stay letters of their case and
script (in names vowels stay vowels), digits digits, hexadecimal digits such, punctuation as it is. Two
different values of a form therefore don't share a surrogate, in one document or in any two, and a
value has the same one everywhere, with no table of values to build or join. Written forms of a number
that differ in punctuation, and addresses that differ in case, keep their common identity.

* e-mail addresses: local part and host names; top-level domains and the example domains stay
* IPv4 addresses: a Feistel network on the 32 bits, so that octets are valid; IPv6 addresses by their hexadecimal digits
* payment cards of 13 to 19 digits: first digit and the validity of the check digit stay
* telephone numbers: the country code after + stays
* access keys, tokens and passwords after a name and = or :, long hexadecimal strings
* account numbers: the country stays, and check digits that were right (by 97) are so again
* names after a title, or after a given name of the lists: given names of the lists move within those of
  their gender and script, surnames of the list within it; others are permuted, given names but for
  their last letter, which in many languages shows gender. Later mentions of these given names and
  surnames alone, anywhere in the document, get the same surrogates

Where a surrogate equals its value, another permutation takes its place. Where it is another value's
surrogate, or a value that the document holds, permutations of further keys are tried, so that values
stay apart; `collisions` counts those that none of KEYS has parted. Only names without a title whose
given name is in no list are not found, as in any language capitals alone don't tell them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm.common import fresh, table

KEY = "surrogates-1"

#: Keys that are tried one after another until a document's surrogates differ.
KEYS = 4

TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "": ["Dr", "Prof", "Professor", "Doctor"],
}
GIVEN = {
    "f": ["Alice", "Amy", "Ann", "Anna", "Barbara", "Carol", "Clara", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Hannah", "Helen", "Ines", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Laura", "Linda", "Lisa", "Lucia", "Maria", "Marta", "Mary", "Nancy", "Nina", "Nora", "Olivia", "Patricia", "Paula", "Rachel", "Sandra", "Sara", "Sarah", "Sofia", "Susan", "Teresa", "Анна", "Вера", "Елена", "Мария", "Ольга", "Ελένη", "Μαρία", "Σοφία"],
    "m": ["Adam", "Andrew", "Carlos", "Charles", "Daniel", "David", "Emil", "Felix", "George", "Henry", "Hugo", "Jacob", "James", "Jan", "John", "Jonas", "Joseph", "Karl", "Kevin", "Leo", "Lucas", "Marco", "Martin", "Matthew", "Max", "Michael", "Oscar", "Paul", "Peter", "Richard", "Robert", "Samuel", "Simon", "Steven", "Thomas", "William", "Антон", "Борис", "Иван", "Олег", "Павел", "Γιώργος", "Νίκος", "Πέτρος"],
}
SURNAMES = ["Adams", "Allen", "Baker", "Becker", "Brown", "Campbell", "Carter", "Clark", "Davis", "Diaz", "Dubois", "Evans", "Fischer", "Garcia", "Green", "Hall", "Harris", "Hill", "Hoffmann", "Jackson", "Johnson", "Jones", "Keller", "King", "Lee", "Lewis", "Lopez", "Martinez", "Meyer", "Miller", "Mitchell", "Moore", "Moreau", "Nelson", "Parker", "Perez", "Phillips", "Roberts", "Robinson", "Rossi", "Schmidt", "Schneider", "Scott", "Smith", "Taylor", "Thompson", "Torres", "Turner", "Walker", "Weber", "White", "Williams", "Wilson", "Wright", "Young"]
_ANY_TITLE = "|".join(t for g in TITLES.values() for t in g)
_ANY_GIVEN = "|".join(n for g in GIVEN.values() for n in g)
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:['’\-]\p{Lu}\p{L}+)*"

#: Kinds in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._+\-])[A-Za-z0-9._+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_\-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?(?=[^\s0-9]{0,64}[0-9])[^\s\"'<>#$%&*,;]{6,}",
    "hex": r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,}(?![0-9A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[A-Z0-9]{0,26}[0-9]{6})[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[a-fA-F:]*[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=(?:[0-9a-fA-F]{0,4}:){3,7}[0-9a-fA-F])(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})::[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "person": rf"(?<!\p{{L}})(?:(?:{_ANY_TITLE})\.? {_NAME}(?: {_NAME})?|(?:{_ANY_GIVEN}) {_NAME})",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every value has at least: a cheap test of most texts.
_STARTS = "".join(sorted({t[0] for names in (*TITLES.values(), *GIVEN.values()) for t in names}))
HINT = rf"[0-9@]|(?=[{_STARTS}])(?<!\p{{L}})(?:(?:{_ANY_TITLE})\.?|{_ANY_GIVEN}) \p{{Lu}}"

_DIGITS = ("0123456789",)
_CODE = (*_DIGITS, "abcdefghijklmnopqrstuvwxyz")
_HEX = (*_DIGITS, "abcdef")
_SCRIPTS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöüãõåæœø", "ñçß", "аеёиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιοωά", "βγδζθκλμνξπρστφχψ", "έήίόύώ")


def _hash(*parts: Column, bits: int = 32) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, bits // 4), 16, 10).cast("long")


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _shifted(c: Column, by: Column, alphabets: Column) -> Column:
    """The lower-case character moved within its alphabet, null for others. Where a character is in no alphabet, nothing is hashed."""
    own = F.filter(alphabets, lambda a: (F.instr(a, c) > 0) & (c != ""))
    return let(F.try_element_at(own, F.lit(1)), lambda a: F.when(a.isNotNull(), F.substring(a, ((F.instr(a, c) - 1 + by) % F.length(a) + 1).cast("int"), F.lit(1))))


def _pass(s: Column, key: Column, alphabets: Column) -> Column:
    """Each character moved by a hash of the key and what the ones before it have become: a bijection."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("pre"))

    def step(acc: Column, c: Column) -> Column:
        grown = lambda x: F.struct(F.concat(acc["out"], F.when(c == F.lower(c), F.coalesce(x, c)).otherwise(F.coalesce(F.upper(x), c))).alias("out"), F.concat(acc["pre"], F.coalesce(x, F.lit(""))).alias("pre"))
        return let(_shifted(F.lower(c), _hash(key, acc["pre"]), alphabets), grown)

    return F.aggregate(F.split(s, ""), start, step, lambda a: a["out"])


def _moved(s: Column, kind: Column, key: Column, alphabets: Column) -> Column:
    """s under a keyed permutation of its form: forwards, then backwards, so that all of it bears on each character. Another one where it changes nothing."""
    turn = lambda x, n: F.reverse(_pass(x, F.concat(key, F.lit("|"), kind, F.lit("|"), n.cast("string")), alphabets))
    whole = lambda x, first: F.aggregate(F.array(F.lit(first), F.lit(first + 1)), x, lambda y, n: turn(y, n))
    return let(s, lambda x: let(whole(x, 1), lambda y: F.when(y == x, whole(y, 3)).otherwise(y)))


def _ip(s: Column, key: Column) -> Column:
    octets = F.transform(F.split(s, r"\."), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    halves = F.struct(F.shiftright(number, 16).alias("l"), (number % 65536).alias("r"))
    rounds = F.array(*(F.lit(i) for i in range(4)))
    turn = lambda h, i: F.struct(h["r"].alias("l"), h["l"].bitwiseXOR(_hash(F.concat(key, F.lit("|ip")), i.cast("string"), h["r"].cast("string"), bits=16)).alias("r"))
    text = lambda h: F.concat_ws(".", F.floor(h["l"] / 256).cast("string"), (h["l"] % 256).cast("string"), F.floor(h["r"] / 256).cast("string"), (h["r"] % 256).cast("string"))
    return F.aggregate(rounds, halves, turn, text)


def _checked(made: Column, s: Column) -> Column:
    """A card's number whose last digit has moved by as much as the check sum did."""
    digits = lambda x: F.transform(F.filter(F.split(x, ""), lambda c: F.instr(F.lit("0123456789"), c) * F.length(c) > 0), lambda c: c.cast("int"))

    def check(x: Column) -> Column:
        """Sum of all but the last digit, every other one from the end doubled."""
        body = let(digits(x), lambda d: F.reverse(F.slice(d, F.lit(1), F.size(d) - 1)))
        doubled = F.transform(body, lambda d, i: F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
        return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)

    return let(made, lambda m: F.concat(F.substr(m, F.lit(1), F.length(m) - 1), F.pmod(F.substr(m, F.length(m)).cast("int") + check(s) - check(m), F.lit(10)).cast("string")))


def _iban(made: Column, s: Column) -> Column:
    """An account number whose two check digits are right by 97 if those of s are; a letter counts as 10 and up."""

    def rest(x: Column) -> Column:
        moved = F.split(F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4))), "")
        known = F.filter(moved, lambda c: c != "")
        return F.aggregate(known, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(F.upper(c)) - 55) % 97)

    head, tail = F.substr(made, F.lit(1), F.lit(2)), F.substr(made, F.lit(5))
    right = F.concat(head, F.lpad((F.lit(98) - rest(F.concat(head, F.lit("00"), tail))).cast("string"), 2, "0"), tail)
    return F.when(rest(s) == 1, right).otherwise(made)


def _in_list(name: Column, lists: list[list[str]], kind: str, key: Column) -> Column:
    """A name of a list moved within it; null for others. None stays as it is, and no two meet."""
    out = None
    for names in lists:
        array, n = F.array(*(F.lit(x) for x in names)), len(names)
        at = (F.array_position(array, name) + _hash(F.concat(key, F.lit(f"|{kind}"))) % (n - 1)) % n + 1
        out = (F if out is None else out).when(F.array_contains(array, name), F.element_at(array, at.cast("int")))
    return out


def _given(name: Column, key: Column) -> Column:
    scripts = {"latin": "A-Za-z", "cyrillic": "А-я", "greek": "Α-ω"}
    lists = [[n for n in names if _in(n, letters)] for names in GIVEN.values() for letters in scripts.values()]
    body = F.substr(name, F.lit(1), F.length(name) - 1)
    return F.coalesce(_in_list(name, lists, "given", key), F.concat(_moved(body, F.lit("given"), key, _array(_SCRIPTS)), F.substr(name, F.length(name))))


def _surname(name: Column, key: Column) -> Column:
    return F.coalesce(_in_list(name, [SURNAMES], "surname", key), _moved(name, F.lit("surname"), key, _array(_SCRIPTS)))


def _array(items: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(x) for x in items))


def _in(name: str, letters: str) -> bool:
    return letters[0] <= name[0] <= letters[-1] and (letters[0] == "A") == name.isascii()


_PERSON = rf"^((?:{_ANY_TITLE})\.? )?({_NAME} )?({_NAME})$"


def surrogate(value: Column, key: Column) -> Column:
    """The surrogate of a value, other than a person's name, that ANY has found: what stays before and after, and what is permuted between."""
    part = lambda p, i: F.regexp_extract(value, p, i)
    mail = r"(?s)^(.*@(?:.*\.)?)((?i:example\.(?:com|org|net)|[A-Za-z]+))$"
    after = r"(?s)^([A-Za-z_\-]+[\"']?\s{0,2}[=:]\s{0,2}[\"']?)(.*)$"
    phone = r"^(\+[0-9]{1,3}(?=[^0-9]))?(.*)$"
    none = F.lit("")
    hexadecimal = part(after, 2).rlike(r"^[0-9a-fA-F]+\W*$")

    def cut(kind: Column | str, before: Column, body: Column, behind: Column, alphabets: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), before.alias("before"), body.alias("body"), behind.alias("behind"), alphabets.alias("alphabets"))

    from_ = lambda n: F.substr(value, F.lit(n))
    parts = {
        "email": cut("email", none, part(mail, 1), part(mail, 2), _array(_CODE)),
        "key": cut("key", F.substring(value, 1, 4), from_(5), none, _array(_CODE)),
        "secret": cut(F.when(hexadecimal, F.lit("hex")).otherwise(F.lit("secret")), part(after, 1), part(after, 2), none, F.when(hexadecimal, _array(_HEX)).otherwise(_array(_CODE))),
        "hex": cut("hex", none, value, none, _array(_HEX)),
        "account": cut("account", F.substring(value, 1, 4), from_(5), none, _array(_CODE)),
        "ip": cut("ip", none, value, none, _array(_DIGITS)),
        "ip6": cut("ip6", none, value, none, _array(_HEX)),
        "phone": cut("phone", part(phone, 1), part(phone, 2), none, _array(_DIGITS)),
        "ssn": cut("ssn", none, value, none, _array(_DIGITS)),
        "card": cut("card", F.substring(value, 1, 1), F.substr(value, F.lit(2), F.length(value) - 2), F.substr(value, F.length(value)), _array(_DIGITS)),
    }
    chosen = reduce(lambda out, k: (F if out is None else out).when(value.rlike(f"^(?:{KINDS[k]})$"), parts[k]), parts, None)

    def made(p: Column) -> Column:
        whole = F.concat(p["before"], _moved(p["body"], p["kind"], key, p["alphabets"]), p["behind"])
        ip = let(_ip(value, key), lambda x: F.when(x == value, _ip(x, F.concat(key, F.lit("2")))).otherwise(x))
        return F.when(p.isNull(), value).when(p["kind"] == "ip", ip).when(p["kind"] == "card", _checked(whole, value)).when(p["kind"] == "account", let(whole, lambda w: _iban(w, value))).otherwise(whole)

    return let(chosen, made)


def _apart(items: Column, name, make, taken: Column, key: str) -> Column:
    """array<struct<value, s>> of items: make(item, key) under the first key whose surrogate is neither a taken value nor another's."""
    keys = F.array(*(F.lit(key if k == 0 else f"{key}#{k}") for k in range(KEYS)))
    start = F.array().cast("array<struct<value:string,s:string>>")

    def step(acc: Column, item: Column) -> Column:
        used = lambda s: F.array_contains(taken, s) | F.exists(acc, lambda x: x["s"] == s)
        s = F.aggregate(keys, F.lit(None).cast("string"), lambda s, k: F.when(s.isNull() | used(s), make(item, k)).otherwise(s))
        return F.concat(acc, F.array(F.struct(name(item).alias("value"), s.alias("s"))))

    return F.aggregate(items, start, step)


def _of(made: Column, value: Column) -> Column:
    return F.try_element_at(F.filter(made, lambda x: x["value"] == value), F.lit(1))["s"]


def replace_pii(docs: DataFrame, text: str, key: str = KEY, details: bool = False) -> DataFrame:
    """docs with surrogates in the text; details: also n_entities and collisions, with _ before them where docs has such names.

    Null stays null, texts without values stay as they are, byte for byte; texts of any length are done
    whole, values that repeat get one surrogate, an empty table gives no rows. Other columns, whatever
    their names, are untouched. There is no shuffle: a document needs nothing from another.
    """
    names, found, known, made, *counts = fresh(docs.columns, "pii_names", "pii_found", "pii_known", "pii_made", "n_entities", "collisions")
    t, nothing = F.col(f"`{text}`"), F.array().cast("array<string>")
    person = rf"^(?:{KINDS['person']})$"
    part = lambda e, i: F.trim(F.regexp_extract(e, _PERSON, i))
    # Values by the patterns alone; then, where there are persons, also each mention of their names.
    out = docs.withColumn(found, F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(nothing))
    people = F.filter(F.array_distinct(found), lambda e: e.rlike(person))
    both = F.flatten(F.transform(people, lambda e: F.array(F.struct(part(e, 2).alias("name"), F.lit(True).alias("given")), F.struct(part(e, 3).alias("name"), F.lit(False).alias("given")))))
    out = out.withColumn(names, F.array_distinct(F.filter(both, lambda n: n["name"] != "")))
    mentions = F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(F.transform(names, lambda n: n["name"]), "|"), F.lit(r")(?!\p{L}|['’\-]\p{Lu})"))
    some = F.size(names) > 0
    out = out.withColumn(found, F.when(some, F.regexp_extract_all(t, mentions, F.lit(0))).otherwise(F.col(found)))
    # Of a name that is a given name in one place and a surname in another, the given name counts.
    given = F.transform(F.filter(names, lambda n: n["given"]), lambda n: n["name"])
    other = F.array_except(F.transform(F.filter(names, lambda n: ~n["given"]), lambda n: n["name"]), given)
    listed = F.concat(F.transform(given, lambda n: F.struct(n.alias("name"), F.lit(True).alias("given"))), F.transform(other, lambda n: F.struct(n.alias("name"), F.lit(False).alias("given"))))
    words = F.array_union(F.transform(names, lambda n: n["name"]), F.array_distinct(found))
    named = _apart(listed, lambda n: n["name"], lambda n, k: F.when(n["given"], _given(n["name"], k)).otherwise(_surname(n["name"], k)), words, key)
    out = out.withColumn(known, F.when(some, named).otherwise(F.array().cast("array<struct<value:string,s:string>>")))
    composed = lambda e: F.concat(F.regexp_extract(e, _PERSON, 1), F.when(part(e, 2) != "", F.concat(_of(F.col(known), part(e, 2)), F.lit(" "))).otherwise(""), _of(F.col(known), part(e, 3)))
    mention = lambda e: F.exists(names, lambda n: n["name"] == e)
    plain = F.filter(F.array_distinct(found), lambda e: ~e.rlike(person) & ~mention(e))
    settled = _apart(plain, lambda e: e, surrogate, words, key)
    persons = F.transform(F.filter(F.array_distinct(found), lambda e: e.rlike(person)), lambda e: F.struct(e.alias("value"), composed(e).alias("s")))
    out = out.withColumn(made, F.when(some, F.concat(settled, known, persons)).otherwise(settled))
    join = lambda pieces: let(F.col(made), lambda m: F.array_join(F.zip_with(pieces, F.col(found), lambda p, e: F.concat(p, F.coalesce(_of(m, e), F.lit("")))), ""))
    replaced = F.when(some, join(F.split(t, mentions, -1))).otherwise(join(F.split(t, ANY, -1)))
    columns = [F.when(F.size(found) > 0, replaced).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if details:
        values, made_ones = F.transform(F.col(made), lambda m: m["value"]), F.transform(F.col(made), lambda m: m["s"])
        doubled = F.size(made) - F.size(F.array_distinct(made_ones)) + F.size(F.array_intersect(values, made_ones))
        columns += [F.size(found).alias(counts[0]), doubled.alias(counts[1])]
    return out.select(*columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, "text", details=True)
