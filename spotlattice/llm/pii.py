"""PII surrogates: detected entities get keyed replacements of their own type, format, script and gender.

An entity is known by its type and its normal form (an e-mail address in lower case, a phone number's digits, ...), so
its mentions in any document and any way of writing get the same surrogate. A keyed SHA-256 of (type, normal form,
attempt) drives a generator of the type: Luhn-valid card numbers stay Luhn-valid and keep their first digit, addresses
come from ranges nobody uses, given names come from lists of the title's gender, surnames are made of syllables of the
same script (with the Slavic gender ending), secrets keep their alphabet and length. The surrogate is then written into
the mention's own format: its separators, its case.

Names are found by a title before them. In a document that names a person so, every other mention of one of the name's
words (as written, or in capitals) is replaced as well, by the surrogate of the word's role in the first titled mention.

Collision checks: over the distinct entities of the whole corpus, no two of a type may share a surrogate and none may be
an entity that occurs. In each round every open entity tries a surrogate; of those that try the same one the first in the
order of a hash gets it, if it is free, and the others try again. Settled entities are not touched again. The few entities
with another attempt than the first are joined to the documents that mention them; all others need no join.

Texts without a digit, an at sign, a title or 32 letters of hexadecimal digits have no mention; they are passed by without
the patterns. Everything is Spark functions. Only distinct entities are shuffled, never texts (unless very many collide).

``secret`` is the key: with it the surrogates can be made again, so it belongs to whoever runs the job.

Defined cases: null text stays null; text without entities is returned unchanged; very long texts are scanned whole;
repeated rows are treated alike; an empty table gives an empty result; extra columns are kept, but for those named as
the output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlattice.llm.util import own_name, sized_broadcast, stored

_AN = r"\p{L}\p{N}"
_TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа")}
_ANY_TITLE = "|".join(sorted((t for ts in _TITLES.values() for t in ts), key=len, reverse=True))
#: A capitalised word (O'Brien, McDonald and Smith-Jones are words), and initials before one.
_WORD = rf"(?:\p{{Lu}}\. )*+(?:\p{{Lu}}['’])?\p{{Lu}}\p{{Ll}}+(?:[-'’]?\p{{Lu}}\p{{Ll}}+)*(?![{_AN}])"
_HEX = r"[0-9a-fA-F]{32,}+"
#: The registered lengths of IBANs; codes that are not here match in groups of four with any last group.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{'|'.join(codes.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![{_AN}])" for n, codes in _IBAN_LENGTHS.items())
#: The alternatives are tried in this order at each place.
PATTERN = "|".join(
    [
        rf"(?<![{_AN}._%+-])[{_AN}._%+-]++@[{_AN}-]+(?:\.[{_AN}-]+)+",
        rf"(?<![{_AN}])(?=[0-9a-fA-F])(?:{_HEX})(?![{_AN}])",
        r"(?<![\d.])(?=\d{1,3}\.)(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
        r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
        r"(?<![\d-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3\d{3}[ -]?\d{6}[ -]?\d{5})(?!\d)",
        r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
        r"\+\d(?:[ .-]?\(?\d\)?){7,14}(?!\d)",
        r"\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
        rf"(?<![{_AN}])(?=[A-Z]{{2}}\d{{2}})(?:{_IBAN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_AN}]))",
        rf"(?<![{_AN}])(?:{_ANY_TITLE})\.? {_WORD}(?: {_WORD})*+",
    ]
)
_GIVEN = {
    "m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"),
    "f": ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"),
}
_GIVEN_CYRILLIC = {
    "m": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"),
    "f": ("Алина", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"),
}
#: The shapes of single words of a name in the rest of its document.
_INITIAL = r"^\p{Lu}\.$"
_SYLLABLES = tuple(c + v for c in "bdfklmnprstv" for v in "aeio")[:32]
_SYLLABLES_CYRILLIC = tuple(c + v for c in "бдклмнпрст" for v in "аеио")[:32]


def _type_of(m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(rf"^{_HEX}$"), "secret")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^[\d -]+$") & (digits >= 15), "card")
        .when(m.rlike(r"\d"), "phone")
        .otherwise("name")
    )


def _titled(m: Column) -> Column:
    """A titled name as array of struct(type, raw), to be joined by blanks: the title stays, the words have roles."""
    words = F.split(m, " ")
    gender = F.when(m.rlike(rf"^(?:{'|'.join(_TITLES['f'])})\.? "), "f").otherwise("m")
    surname = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), F.concat(F.lit("surname_"), gender)).otherwise(F.lit("surname"))
    role = lambda w, i: F.when(i == 0, "keep").when(i == F.size(words) - 1, surname(w)).otherwise(F.concat(F.lit("given_"), gender))
    return F.transform(words, lambda w, i: F.struct(role(w, i).alias("type"), w.alias("raw")))


def _parts(m: Column, named: Column) -> Column:
    """A mention as array of struct(type, raw). A name without a title is one of the words in ``named``."""
    alone = F.get(F.filter(named, lambda x: F.lower(x["raw"]) == F.lower(m)), F.lit(0))["type"]
    one = lambda t: F.array(F.struct(t.alias("type"), m.alias("raw")))
    return F.when(_type_of(m) != "name", one(_type_of(m))).when(F.contains(m, F.lit(" ")), _titled(m)).otherwise(one(alone))


def _possible(text: Column) -> Column:
    """Whether there can be a mention; each alternative of the pattern needs one of these."""
    out = text.contains("@") | text.rlike("[0-9]")
    for title in sorted({t for ts in _TITLES.values() for t in ts if not any(o != t and o in t for os in _TITLES.values() for o in os)}):
        out = out | text.contains(title)
    return out | text.rlike("[a-fA-F]{32}")


def _plan(text: Column) -> Column:
    """struct(pattern, named): what to look for in a text, and (type, raw) of the words of its titled names; null for texts
    that can have no mention."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    titled = F.filter(found, lambda m: _type_of(m) == "name")
    named = F.filter(F.flatten(F.transform(titled, _titled)), lambda x: (x["type"] != "keep") & ~x["raw"].rlike(_INITIAL))
    bound = F.transform(F.array(named), lambda xs: F.struct(F.concat_ws("|", F.array_distinct(F.transform(_longest_first(xs), lambda x: x["raw"]))).alias("words"), xs.alias("named")))
    alone = lambda w: F.concat(F.lit(f"{PATTERN}|(?<![{_AN}])(?:"), w, F.lit("|"), F.upper(w), F.lit(f")(?![{_AN}])"))
    plan = F.transform(bound, lambda b: F.struct(F.when(b["words"] == "", F.lit(PATTERN)).otherwise(alone(b["words"])).alias("pattern"), b["named"].alias("named")))
    return F.when(_possible(text), F.element_at(plan, 1))


def _longest_first(xs: Column) -> Column:
    """So that a double name is found before its half."""
    return F.transform(F.array_sort(F.transform(xs, lambda x: F.struct((-F.length(x["raw"])).alias("n"), x["raw"].alias("raw")))), lambda y: F.struct(y["raw"].alias("raw")))


def _normal(p: Column) -> Column:
    t, raw = p["type"], p["raw"]
    return F.when(t.isin("phone", "card", "ssn"), F.regexp_replace(raw, r"\D", "")).when(t == "iban", F.regexp_replace(raw, " ", "")).otherwise(F.lower(raw))


def _stage(parts: Column, have: set[str], **more: Callable[[Column], Column]) -> Column:
    """parts, an array of structs with the fields ``have``, with further fields."""
    order = [f for f in ("type", "raw", "norm", "attempt", "h", "new") if f in have]
    return F.transform(parts, lambda p: F.struct(*[p[f].alias(f) for f in order], *[f(p).alias(k) for k, f in more.items()]))


def _hash(p: Column, secret: str) -> Column:
    one = lambda i: F.sha2(F.concat_ws("|", F.lit(secret), p["type"], p["norm"], p["attempt"].cast("string"), F.lit(str(i))).cast("binary"), 256)
    return F.concat(one(0), one(1))


def _number(h: Column, at: Column | int) -> Column:
    """The byte of the hash at a place."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(h, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(words: tuple[str, ...], h: Column, at: Column | int) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), F.pmod(_number(h, at), F.lit(len(words))) + 1)


def _hex(h: Column, n: Column) -> Column:
    """n digits: those of the hash, and beyond them those of hashes of it with a counter."""
    more = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor((n - 1) / 64))), lambda i: F.sha2(F.concat_ws("|", h, i.cast("string")).cast("binary"), 256))
    return F.substring(F.when(n > 128, F.concat(h, F.array_join(more, ""))).otherwise(h), F.lit(1), n)


def _digits(h: Column, n: Column) -> Column:
    return F.substring(F.translate(h, "abcdef", "135790"), F.lit(1), n)


def _luhn(body: Column) -> Column:
    """The check digit for a string of digits."""
    each = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    """The number that digits and letters (A is 10) spell, modulo 97."""
    step = lambda r, c: F.when(c.rlike("^[0-9]$"), F.pmod(r * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _iban(norm: Column, h: Column) -> Column:
    """The country stays; the check digits are right if they were."""
    country, made = F.substring(norm, 1, 2), _map_letters(F.substring(norm, F.lit(3), F.length(norm)), h)
    valid = _mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
    account = F.substring(made, F.lit(3), F.length(made))
    check = F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(valid, check).otherwise(F.substring(made, 1, 2)), account)


def _map_letters(s: Column, h: Column) -> Column:
    """Letters and digits of s by others of their kind, everything else as it is."""
    letter = lambda alphabet, i: F.substring(F.lit(alphabet), F.pmod(_number(h, i), F.lit(len(alphabet))) + 1, F.lit(1))
    one = lambda c, i: (
        F.when(c.rlike("^[0-9]$"), F.pmod(_number(h, i), F.lit(10)).cast("string"))
        .when(c.rlike("^[A-Z]$"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
        .when(c.rlike(r"^\p{IsCyrillic}$"), letter("абвгдежзиклмнопрстуфхцчшэюя", i))
        .when(c.rlike(r"^\p{L}$"), letter("abcdefghijklmnopqrstuvwxyz", i))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.split(s, ""), one), "")


def _name_word(p: Column, lists: tuple, cyrillic: tuple) -> Column:
    """One word, and one more for every two attempts."""
    h, n = p["h"], F.floor(p["attempt"] / 2).cast("int")
    make = lambda words: F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: _pick(words, h, i)), "-")
    return F.when(p["norm"].rlike(r"\p{IsCyrillic}"), make(cyrillic)).otherwise(make(lists))


def _surname(p: Column, gender: str) -> Column:
    h, n = p["h"], F.lit(2) + F.floor(p["attempt"] / 2).cast("int")
    make = lambda words: F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: _pick(words, h, i)), "")
    latin = F.concat(make(_SYLLABLES), _pick(("n", "rt", "ns", "ll", "nd", "r", "s", "ck"), h, 40))
    return F.initcap(F.when(p["norm"].rlike(r"\p{IsCyrillic}"), F.concat(make(_SYLLABLES_CYRILLIC), F.lit("нов" if gender == "m" else "нова"))).otherwise(latin))


def _canonical(p: Column) -> Column:
    """The surrogate of an entity, in its normal form (names keep their capitals)."""
    t, norm, h = p["type"], p["norm"], p["h"]
    n = F.length(norm)
    octets = F.concat_ws(".", (F.pmod(_number(h, 0), F.lit(16)) + 240).cast("string"), *[_number(h, i).cast("string") for i in (1, 2, 3)])
    body = F.concat(F.substring(norm, 1, 1), _digits(h, n - 2))
    valid = _luhn(F.substring(norm, F.lit(1), n - 1)) == F.substring(norm, n, F.lit(1))
    card = F.concat(body, F.when(valid, _luhn(body)).otherwise(F.substring(F.translate(F.reverse(h), "abcdef", "246801"), 1, 1)))
    phone = F.concat(F.substring(norm, F.lit(1), F.greatest(n - 10, F.lit(0))), _digits(h, F.least(n, F.lit(10))))
    tail = F.when(p["attempt"] >= 8, p["attempt"].cast("string")).otherwise("")
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    host = F.when(domain.rlike(r"\..*\."), F.concat(F.lit("mail"), F.pmod(_number(h, 50), F.lit(10)).cast("string"), F.lit("."))).otherwise("")
    email = F.concat(_map_letters(local, h), tail, F.lit("@"), host, F.lit("example."), _pick(("com", "net", "org"), h, 51))
    out = F.when(t == "email", email).when(t == "ip", octets).when(t == "card", card).when(t == "phone", phone)
    out = out.when(t == "ssn", F.concat(F.lit("9"), _digits(h, F.lit(8)))).when(t == "secret", _hex(h, n))
    out = out.when(t == "iban", _iban(norm, h))
    for g in ("m", "f"):
        out = out.when(t == f"given_{g}", _name_word(p, _GIVEN[g], _GIVEN_CYRILLIC[g])).when(t == f"surname_{g}", _surname(p, g))
    return out.when(t == "surname", _surname(p, "")).otherwise(p["raw"])


def _rendered(p: Column) -> Column:
    """The surrogate in the mention's own format: its separators for numbers, its case for the rest."""
    t, raw, new = p["type"], p["raw"], p["new"]
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    fill = F.aggregate(
        F.split(raw, ""),
        start,
        lambda s, c: F.when(c.rlike("^[0-9A-Z]$"), F.struct(F.concat(s["out"], F.substring(new, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))),
        lambda s: s["out"],
    )
    shout = (raw == F.upper(raw)) & (raw != F.lower(raw))
    return F.when(t.isin("phone", "card", "ssn", "iban"), fill).when(shout & (t != "keep"), F.upper(new)).otherwise(new)


_ENTITY = {"type", "raw", "norm"}


def mentions(text: Column, plan: Column) -> Column:
    """array of mentions, each an array of struct(type, raw, norm)."""
    found = F.regexp_extract_all(text, plan["pattern"], F.lit(0))
    staged = F.transform(F.transform(found, lambda m: _parts(m, plan["named"])), lambda ps: _stage(ps, {"type", "raw"}, norm=_normal))
    return F.when(plan.isNotNull(), staged).otherwise(F.array().cast("array<array<struct<type:string,raw:string,norm:string>>>"))


def _with_mentions(docs: DataFrame, text: str, plan: str, out: str) -> DataFrame:
    return docs.withColumn(plan, _plan(F.col(text))).withColumn(out, mentions(F.col(text), F.col(plan)))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (type, norm) of all texts."""
    flat = _with_mentions(docs.select(F.col(text).alias("t")), "t", "p", "m").select(F.explode(F.flatten("m")).alias("e")).select("e.type", "e.norm")
    return flat.where("type <> 'keep'").distinct()


def surrogate_table(found: DataFrame, secret: str, *, rounds: int = 200) -> DataFrame:
    """distinct (type, norm) -> (type, norm, attempt, new), without two entities of a type that share a surrogate."""
    taken = found.select("type", F.col("norm").alias("new"))
    todo, settled = found.select("type", "norm"), None
    for attempt in range(rounds):
        made = todo.withColumns({"attempt": F.lit(attempt), "raw": F.col("norm")}).withColumn("h", _hash(_Row(), secret))
        made = stored(made.withColumn("new", F.lower(_canonical(_Row()))).select("type", "norm", "attempt", "new"), "tried")
        # One of those that try the same: an aggregate, as many may.
        first = made.groupBy("type", "new").agg(F.min(F.struct(F.xxhash64("norm").alias("x"), "norm", "attempt")).alias("f"))
        first = first.select("type", "f.norm", "f.attempt", "new").join(taken, ["type", "new"], "left_anti")
        if settled is not None:
            first = first.join(settled.select("type", "new"), ["type", "new"], "left_anti")
        first = stored(first.select("type", "norm", "attempt", "new"), "settled")
        settled = first if settled is None else settled.unionByName(first)
        todo = stored(made.select("type", "norm").join(first.select("type", "norm"), ["type", "norm"], "left_anti"), "open")
        if todo.isEmpty():
            return settled
    raise RuntimeError("a type has more entities than its surrogates can tell apart")


class _Row:
    """The columns of a frame, read like the fields of a struct."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def replace(docs: DataFrame, *, secret: str, key: str = "doc_id", text: str = "text", out: str = "text", count: str | None = None) -> DataFrame:
    """docs with every entity of ``text`` replaced in ``out``; ``count`` names a column for the number of mentions."""
    table = surrogate_table(stored(entities(docs, text), "entities"), secret)
    again = table.where("attempt > 0").select("type", "norm", "attempt")
    m, tries, plan = own_name(docs, "__mentions"), own_name(docs, "__tries"), own_name(docs, "__plan")
    df = _with_mentions(docs, text, plan, m)
    if again.isEmpty():
        attempt: Callable[[Column], Column] = lambda p: F.lit(0)
    else:
        named = _with_mentions(docs.select(F.col(key).alias("__k"), F.col(text).alias("t")), "t", "p", "m").select("__k", F.explode(F.flatten("m")).alias("e")).select("__k", "e.type", "e.norm").distinct()
        per_doc = named.join(again, ["type", "norm"]).groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "type", "norm"), "attempt"))).alias(tries))
        per_doc = stored(per_doc, "tries")
        side = sized_broadcast(per_doc, per_doc.count(), 20_000)
        df = df.join(side, df[key].eqNullSafe(side["__k"]), "left").drop("__k")
        attempt = lambda p: F.coalesce(F.get(F.filter(F.map_entries(F.col(tries)), lambda e: e["key"] == F.concat_ws("|", p["type"], p["norm"])), F.lit(0))["value"], F.lit(0))
    each = lambda parts, have, **more: F.transform(parts, lambda ps: _stage(ps, have, **more))
    staged = each(F.col(m), _ENTITY, attempt=attempt)
    staged = each(staged, _ENTITY | {"attempt"}, h=lambda p: _hash(p, secret))
    staged = each(staged, _ENTITY | {"attempt", "h"}, new=_canonical)
    words = F.transform(staged, lambda ps: F.array_join(F.transform(ps, _rendered), " "))
    between = F.split(F.col(text), F.col(plan)["pattern"], -1)
    joined = F.array_join(F.flatten(F.zip_with(between, words, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    df = df.withColumn(out, F.when(F.size(m) > 0, joined).otherwise(F.col(text)))
    if count:
        df = df.withColumn(count, F.size(m))
    return df.drop(m, tries, plan)
