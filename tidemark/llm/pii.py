"""Surrogates for personal data, with DataFrame functions only.

Entities are found by patterns.  Every distinct entity gets one surrogate, made from a keyed hash of the
entity: of the same type, length and script, digit for digit and letter for letter, names (each by itself,
so that a surname is the same with and without a first name) with the ending of their gender.  Surrogates are
checked against each other and against all entities found, so distinct entities stay distinct, the same
entity gets the same surrogate everywhere, and no surrogate is somebody else's datum.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import join_unique
from tidemark.session import disposable, materialise, shuffle_partitions

# ------------------------------------------------------------------ patterns (fixed values, Java syntax)

# Java's matcher recurses over repeated groups, so their number is bounded; long runs are single classes, taken
# possessively or from the edge of a run only, so a text costs time in proportion to its length.
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,127}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
_H = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\w:.])(?=[0-9A-Fa-f:]{{0,39}}\d)(?:(?:{_H}:){{7}}{_H}|{_H}(?::{_H}){{1,5}}::(?:{_H}(?::{_H}){{0,5}})?|(?:{_H})?::{_H}(?::{_H}){{1,5}})(?![\w:])"
PHONE = r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){6,14})(?!\d)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)"
LONG_CARD = r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}\1\d{3}(?!\d)"
SHORT_CARD = r"(?<![\d-])3[04-9]\d{2}([ -]?)\d{6}\1\d{4,5}(?!\d)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
ACCESS_KEY = r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)"
HEX = r"(?<!\w)[0-9a-f]{32,128}(?!\w)"
SECRET = r"(?<=(?:password|passwd|pwd|token|secret|api_key|apikey) {0,2}[=:] {0,2}[\"']?)[A-Za-z0-9_+/.~-]{6,}+"
MALE = r"Mr\.?|Sir|Herr|Herrn|Señor|Sr\.|Don|Monsieur|M\.|г-н|господин"
FEMALE = r"Mrs\.?|Ms\.?|Miss|Madam|Frau|Señora|Señorita|Sra\.|Doña|Madame|Mme|Mlle|г-жа|госпожа"
EITHER = r"Dr\.?|Prof\.?|Professor"
_PART = r"\p{Lu}(?:['’]\p{Lu})?\p{L}*+(?<=\p{Ll})"
NAME = rf"(?<![\p{{L}}\d])(?:{MALE}|{FEMALE}|{EITHER}) {_PART}(?:[ -]{_PART}){{0,2}}(?!\p{{L}})"
#: Order matters where patterns overlap: the first that fits at a place wins.
PATTERNS = {
    "email": EMAIL, "access_key": ACCESS_KEY, "secret": SECRET, "hex": HEX, "iban": IBAN, "long_card": LONG_CARD, "card": CARD, "short_card": SHORT_CARD,
    "social": SOCIAL, "phone": PHONE, "ip": IPV4, "ipv6": IPV6, "name": NAME,
}
CARDS = ("long_card", "card", "short_card")
#: No entity without one of these; a cheap test before the patterns, with a look at one letter before the words.
MARKS = rf"[0-9@=:]|(?=[DFHMPSгп])(?:{MALE}|{FEMALE}|{EITHER}) \p{{Lu}}"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CYRILLIC_UPPER, CYRILLIC_LOWER = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "абвгдежзиклмнопрстуфхцчшэюя"
#: (male, female, either) endings of surrogate names by script.
ENDINGS = {
    "latin": (("on", "er", "us", "ek"), ("a", "ia", "ina", "ela"), ("en", "ey", "in", "is")),
    "cyrillic": (("ов", "ин", "ев", "ский"), ("ова", "ина", "ева", "ская"), ("ко", "их", "ич", "юк")),
    "greek": (("ος", "ης", "ας", "ιδης"), ("ου", "η", "α", "ιδου"), ("ακι", "ω", "ι", "ερ")),
}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αειου"}
CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрст", "greek": "βγδζκλμνπρστφ"}
#: Letters a part of a name needs to be looked for where it stands alone.
ALONE = 3
#: Characters a surrogate is made for one by one; a longer secret becomes its type and hash.
LONGEST = 1024

TRIES = 30


def _any_pattern() -> str:
    """All patterns as one; groups of single patterns are renumbered."""
    parts, groups = [], 0
    for pattern in PATTERNS.values():
        if r"\1" in pattern:
            groups += 1
            pattern = pattern.replace(r"\1", rf"\{groups}")
        parts.append(pattern)
    return "|".join(f"(?:{p})" for p in parts)


ENTITY = _any_pattern()


def entities(text: Column) -> Column:
    """All entities of a text in order, as found from left to right without overlap."""
    return F.when(text.rlike(MARKS), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entity_type(value: Column) -> Column:
    """Type by the form of the entity alone, so that equal entities always have one type."""
    kind = F.lit("secret")
    for name, pattern in reversed([(n, p) for n, p in PATTERNS.items() if n != "secret"]):
        kind = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


# ------------------------------------------------------------------ surrogates


def _stream(key: str, value: Column, attempt: Column | int, length: Column) -> Column:
    """Two hexadecimal digits for each place of the value, and 64 more."""
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    blocks = F.sequence(F.lit(0), F.floor(length / 64).cast("int") + 1)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\u0001", F.lit(key), attempt.cast("string"), b.cast("string"), value).cast("binary"), 512)), "")


def _byte(stream: Column, place: Column | int) -> Column:
    place = F.lit(place) if isinstance(place, int) else place
    return F.conv(F.substring(stream, 2 * place + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), number % len(letters) + 1, F.lit(1))


def _like(char: Column, byte: Column, lower: str = LOWER, upper: str = UPPER) -> Column:
    """A character of the same class; digits other than 0 stay other than 0; what has no class stays."""
    return (
        F.when(char.rlike("^[1-9]$"), _pick("123456789", byte)).when(char == "0", _pick(DIGITS, byte))
        .when(char.rlike("^[a-z]$"), _pick(lower, byte)).when(char.rlike("^[A-Z]$"), _pick(upper, byte))
        .when(char.rlike("^[а-яё]$"), _pick(CYRILLIC_LOWER, byte)).when(char.rlike("^[А-ЯЁ]$"), _pick(CYRILLIC_UPPER, byte))
        .otherwise(char)
    )


def _masked(value: Column, stream: Column, keep: Column | int, lower: str = LOWER, upper: str = UPPER) -> Column:
    """Character by character, the first ``keep`` as they are."""
    keep = F.lit(keep) if isinstance(keep, int) else keep
    places = F.sequence(F.lit(0), F.length(value) - 1)
    return F.array_join(F.transform(places, lambda i: F.when(i < keep, F.substring(value, i + 1, F.lit(1))).otherwise(_like(F.substring(value, i + 1, F.lit(1)), _byte(stream, i), lower, upper))), "")


def _luhn(digits: Column) -> Column:
    """Checksum of a number: a multiple of 10 if it is valid.  Every second digit counts twice, from the last but one on."""
    twice = lambda i: (F.length(digits) - i) % 2 == 0
    return F.aggregate(
        F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0),
        lambda total, i: total + F.when(twice(i), F.floor(_digit(digits, i) * 2 / 10).cast("int") + (_digit(digits, i) * 2) % 10).otherwise(_digit(digits, i)),
    )


def _digit(digits: Column, i: Column) -> Column:
    return F.substring(digits, i + 1, F.lit(1)).cast("int")


def _card(value: Column, stream: Column) -> Column:
    """First digit and separators kept; valid check digits stay valid."""
    masked = _masked(value, stream, 1)
    plain = F.regexp_replace(value, "[ -]", "")
    body = F.substring(F.regexp_replace(masked, "[ -]", ""), F.lit(1), F.length(plain) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    valid = F.concat(F.substring(masked, F.lit(1), F.length(masked) - 1), check.cast("string"))
    return F.when(_luhn(plain) % 10 == 0, valid).otherwise(masked)


def _ip(stream: Column) -> Column:
    first = 11 + _byte(stream, 0) % 110  # never 10 or 127
    return F.concat_ws(".", first.cast("string"), *((_byte(stream, i) % 254 + 1).cast("string") for i in (1, 2, 3)))


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^(?:{FEMALE}|{MALE}|{EITHER}) ", 0)


def _parts(value: Column) -> Column:
    """(gender and name, which is what a surrogate belongs to, and name) of each name after the title."""
    title = _title(value)
    gender = F.when(title.rlike(rf"^(?:{FEMALE}) $"), "f").when(title.rlike(rf"^(?:{EITHER}) $"), "n").otherwise("m")
    names = F.split(F.substring(value, F.length(title) + 1, F.length(value)), "[ -]")
    return F.transform(names, lambda name: F.struct(F.concat_ws(" ", gender, name).alias("value"), name.alias("name")))


def _name_part(key: str, value: Column, attempt: int) -> Column:
    """A name of the script and gender; every attempt has a syllable more than the one before."""
    letters = 2 * (2 + attempt)
    stream = _stream(key, value, attempt, F.lit(letters))
    made = {}
    for script, ends in ENDINGS.items():
        body = F.concat(*(_pick((CONSONANTS if i % 2 == 0 else VOWELS)[script], _byte(stream, i)) for i in range(letters + 1)))
        male, female, either = (F.element_at(F.array(*map(F.lit, e)), _byte(stream, letters + 1) % len(e) + 1) for e in ends)
        whole = F.concat(body, F.when(value.startswith("f "), female).when(value.startswith("n "), either).otherwise(male))
        made[script] = F.concat(F.upper(F.substring(whole, 1, 1)), F.substring(whole, F.lit(2), F.length(whole)))
    script = lambda name: value.rlike(rf"^. \p{{Is{name}}}")
    return F.when(script("Cyrillic"), made["cyrillic"]).when(script("Greek"), made["greek"]).otherwise(made["latin"])


def surrogate(key: str, value: Column, kind: Column, attempt: int) -> Column:
    """Of all kinds but names.  Places of a value are looked up one by one, so its length is bounded."""
    stream = _stream(key, F.concat_ws("\u0001", kind, value), attempt, F.least(F.length(value), F.lit(LONGEST)))
    # the top-level domain, a country code and the fixed head of a key stay
    domain_end = F.length(value) - F.length(F.regexp_extract(value, r"\.[A-Za-z0-9-]+$", 0))
    email = F.concat(_masked(F.substring(value, F.lit(1), domain_end), stream, 0), F.regexp_extract(value, r"\.[A-Za-z0-9-]+$", 0))
    return (
        F.when(kind == "email", email).when(kind == "ip", _ip(stream)).when(kind.isin(*CARDS), _card(value, stream))
        .when(kind == "hex", _masked(value, stream, 0, "abcdef"))
        .when(kind == "ipv6", _masked(value, stream, 0, "abcdef", "ABCDEF"))
        .when(kind == "phone", _masked(value, stream, F.length(F.regexp_extract(value, r"^\+\d{1,3}", 0))))
        .when(kind == "access_key", _masked(value, stream, 4)).when(kind == "iban", _masked(value, stream, 2))
        .when(F.length(value) > LONGEST, _bracketed(key, value, kind)).otherwise(_masked(value, stream, 0))
    )


def _bracketed(key: str, value: Column, kind: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit("-"), F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value).cast("binary"), 256), F.lit(">"))


def _distinct(pending: DataFrame, taken: DataFrame, attempts: Iterable[Column]) -> DataFrame:
    """``pending`` (one row per value) with surrogates that are neither taken nor given twice.

    Each attempt serves the values whose surrogate is free, of those that meet the smallest; the last serves
    what it can.
    """
    columns, done = pending.columns, None
    for made in attempts:
        # small in bytes, dear in hashes: adaptive execution must not put it into one task
        tried = materialise(pending.repartition(shuffle_partitions(pending.sparkSession), "value").withColumn("surrogate", made), "tried")
        first = tried.groupBy("surrogate").agg(F.min("value").alias("_first"))
        free = materialise(first.join(taken, F.col("surrogate") == F.col("_taken"), "left_anti"), "free")
        good = tried.join(free.select(F.col("_first").alias("value")), "value", "left_semi")
        good = materialise(good.select(*columns, "surrogate"), "given")
        done = good if done is None else done.unionByName(good)
        pending = tried.join(good.select("value"), "value", "left_anti").select(*columns)
        if pending.isEmpty():
            return done
        pending = materialise(pending, "pending")
        taken = taken.unionByName(good.select(F.col("surrogate").alias("_taken")))
    return done


def _assign_names(names: DataFrame, key: str) -> DataFrame:
    """(value, kind) of names to (value, kind, surrogate, parts): titles and separators kept, each name by its own surrogate.

    ``parts`` maps each name of the whole, without its title, to its surrogate.

    A name has one surrogate for each gender, whatever stands beside it, and no surrogate is a name that was
    found.  So whole names stay distinct as well.
    """
    parts = materialise(names.select("value", "kind", F.posexplode(_parts(F.col("value"))).alias("_at", "_part")), "name-parts")
    distinct = materialise(parts.select("_part.value").distinct(), "distinct-names")
    taken = parts.select(F.col("_part.name").alias("_taken")).distinct()
    given = _distinct(distinct, taken, (_name_part(key, F.col("value"), attempt) for attempt in itertools.count()))
    named = join_unique(parts.select(F.col("_part.value").alias("_name"), F.col("_part.name").alias("_bare"), "value", "kind", "_at"), given.select(F.col("value").alias("_name"), "surrogate"), "_name", parts.count())
    whole = named.groupBy("value", "kind").agg(F.array_sort(F.collect_list(F.struct("_at", "_bare", "surrogate"))).alias("_named"))
    whole = whole.withColumn("_new", F.col("_named.surrogate"))
    title = _title(F.col("value"))
    # the separators of the names, each followed by the next surrogate
    gaps = F.regexp_extract_all(F.substring("value", F.length(title) + 1, F.length("value")), F.lit("[ -]"), F.lit(0))
    joined = F.array_join(F.zip_with("_new", gaps, lambda name, gap: F.concat(name, F.coalesce(gap, F.lit("")))), "")
    return whole.select("value", "kind", F.concat(title, joined).alias("surrogate"), F.transform("_named", lambda p: F.struct(p["_bare"].alias("name"), p["surrogate"].alias("surrogate"))).alias("parts"))


def assign_surrogates(values: DataFrame, key: str) -> DataFrame:
    """(value) to (value, kind, surrogate, parts), one row per distinct value; ``parts`` (name, surrogate) of names only.

    A surrogate that equals an entity found anywhere, or one given already, is made anew with another
    attempt number; of entities that meet in one surrogate the smallest keeps it.  After ``TRIES`` attempts
    (a form with too few values) the surrogate is the type and a hash in angle brackets.  Names are settled
    one by one, not as they stand together, and never run out, for they grow with the attempts.
    """
    found = materialise(values.distinct().withColumn("kind", entity_type(F.col("value"))), "entities")
    bracketed = _bracketed(key, F.col("value"), F.col("kind"))
    attempts = itertools.chain((surrogate(key, F.col("value"), F.col("kind"), attempt) for attempt in range(TRIES)), [bracketed])
    done = _distinct(found.where("kind <> 'name'"), found.select(F.col("value").alias("_taken")), attempts)
    done = done.withColumn("parts", F.lit(None).cast("array<struct<name:string,surrogate:string>>"))
    names = found.where("kind = 'name'")
    return done if names.isEmpty() else done.unionByName(_assign_names(names, key))


def _alone(parts: Column) -> Column:
    """A pattern that finds the names of ``parts`` where they stand alone."""
    return F.concat(F.lit(r"(?<![\p{L}\d])(?:"), F.array_join(F.array_sort(F.map_keys(parts)), "|"), F.lit(r")(?![\p{L}\d])"))


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with surrogates in the text, and ``n_entities``.

    Found are e-mail addresses, access keys, values after words such as ``password``, hexadecimal strings of 32 to
    128 digits, IBANs, card numbers of 14 to 16 and 19 digits, social security numbers, phone numbers (grouped 3-3-4,
    or international with ``+``), IPv4 and IPv6 addresses, and names behind a title.  Of a name found in a text, each
    part of at least ``ALONE`` letters is also replaced where it stands alone in that text; a name that two
    genders share in a text has the surrogate of its smaller mention.  Bare numbers without grouping are left alone.

    NULL and empty texts, and texts without entities, stay as they are (0 entities); rows are neither lost
    nor merged, whatever their ids.  A column named n_entities is replaced; other names do not clash.  Names standing
    alone count as entities.

    The patterns run over each text once; what they find is written with the rows.  Only (text digest, entity) pairs
    move; the surrogates of a text come back to it by its digest.  Copies of one text share that row.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    spark = docs.sparkSession
    # the row travels as one struct, so that its names cannot meet those used here
    found = docs.select(F.struct(*columns).alias("_row"), entities(F.col(text_col)).alias("_found"))
    text = F.col(f"_row.`{text_col}`")
    with disposable(spark) as keep:
        seen = keep(materialise(found.withColumn("_digest", F.when(F.size("_found") > 0, F.md5(text.cast("binary")))), "seen"))
        held = seen.where("_digest IS NOT NULL")
        pairs = materialise(held.select("_digest", F.explode(F.array_distinct("_found")).alias("value")).distinct(), "pairs")
        given = materialise(assign_surrogates(pairs.select("value"), key).select("value", "surrogate", "parts"), "surrogates")
        told = pairs.join(given, "value").groupBy("_digest").agg(
            F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("_map"),
            F.array_sort(F.flatten(F.collect_list(F.transform("parts", lambda p: F.struct("value", p["name"].alias("name"), p["surrogate"].alias("surrogate")))))).alias("_named"),
        )
        usable = F.filter("_named", lambda p: F.length(p["name"]) >= ALONE)
        # of mentions that give one name two surrogates, the smallest counts
        names = F.aggregate(
            usable, F.create_map().cast("map<string,string>"),
            lambda m, p: F.when(F.map_contains_key(m, p["name"]), m).otherwise(F.map_concat(m, F.create_map(p["name"], p["surrogate"]))),
        )
        maps = keep(materialise(told.select("_digest", "_map", names.alias("_names")), "maps"))
    joined = held.join(maps, "_digest")
    put = lambda pattern, of, new: F.array_join(
        # the text between what the pattern finds, each followed by what replaces it; nothing follows the last
        F.zip_with(F.split(of, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    # between entities names may stand alone; the pattern of a text's names is made from the names themselves
    between = F.split(text, ENTITY, -1)
    lone = F.transform(between, lambda part: F.regexp_extract_all(part, _alone(F.col("_names")), F.lit(0)))
    named = F.zip_with(between, lone, lambda part, hits: put(_alone(F.col("_names")), part, F.transform(hits, lambda v: F.element_at("_names", v))))
    no_names = F.size("_names") == 0
    pieces = F.when(no_names, between).otherwise(named)
    count = F.size("_found") + F.when(no_names, F.lit(0)).otherwise(F.size(F.flatten(lone)))
    whole = F.array_join(F.zip_with(pieces, F.transform("_found", lambda v: F.element_at("_map", v)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = joined.select(F.col("_row").withField(f"`{text_col}`", whole).alias("_row"), count.cast("long").alias("n_entities"))
    plain = seen.where("_digest IS NULL").select("_row.*", F.lit(0).cast("long").alias("n_entities"))
    return changed.select("_row.*", "n_entities").unionByName(plain)
