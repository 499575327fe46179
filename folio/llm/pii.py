"""PII surrogates, in DataFrame operations only.

Detected entities are replaced by keyed surrogates of their kind: the same entity has the same surrogate in every
document (coreference), two entities never share one (distinctness), and a surrogate keeps what the original shows:
kind, length and separators of numbers and secrets, letter case and script, check digits, the gender that a name's
title gives. Surrogates come from ranges that belong to nobody where there are such ranges (reserved addresses, example
domains, numbers that no authority gives out). A name that follows a title is looked for in the whole text, so later
mentions without the title are replaced alike; a word that the text also has in lower case is taken for a common word
and replaced behind its title only.

Texts are cut once by one pattern; the parts in between are never touched, nor are matches that fail their check (card
numbers by Luhn, IBANs by their check digits, phones by their number of digits). Entities are aggregated to distinct ones
before anything is derived; only documents that hold entities are shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import discard, spool

# Titles by gender, the names of settings whose values are secrets, the first letters of issued keys.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Signora", "Госпожа", "Κυρία"]
MALE_TITLES = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"]
OTHER_TITLES = ["Dr", "Prof", "Professor"]
SECRET_NAMES = ["password", "passwd", "passphrase", "pass", "pwd", "client_secret", "secret", "auth_token", "token", "api_key", "apikey", "access_key", "private_key"]
KEY_SIGNS = ["AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "AIza", "sk-", "eyJ"]
# Words behind a title that name an office, a job or a product; calling codes of two digits.
NO_NAMES = ["President", "Minister", "Chairman", "Speaker", "Secretary", "Developer", "Engineer", "Manager", "Analyst", "Designer", "Director", "Word", "Office", "Excel", "Windows", "Universe", "World"]
TWO_DIGIT_CODES = ["20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"]

_TITLE = "|".join(sorted(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES, key=len, reverse=True))
_WORD = r"\p{Lu}[\p{L}\p{M}'’-]++"
_TITLES = rf"(?:(?:{_TITLE})\.? {{1,2}})++(?!(?:{'|'.join(NO_NAMES)})(?![\p{{L}}\p{{M}}]))"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Every kind: what no text without it can match (cheap to look for), and its pattern; in order of precedence. Runs are entered at their start only, so matching stays linear.
KINDS = {
    "email": ("@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    "secret": ("[=:]", r"(?<![A-Za-z0-9])(?i:" + "|".join(SECRET_NAMES) + r")\s{0,3}[=:]\s{0,3}(?:\"(?=[^\"\s]*\")[^\"\s]{6,}+|'(?=[^'\s]*')[^'\s]{6,}+|[\"']?(?=[+/_!@#$%^*~-]*+[A-Za-z0-9])[A-Za-z0-9+/_!@#$%^*~-]{8,}+)"),
    "access": ("|".join(KEY_SIGNS), r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[po]_[0-9A-Za-z]{36}|xox[bp]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{35}|sk-[0-9A-Za-z_-]{20,}+|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+)(?![A-Za-z0-9])"),
    "iban": (r"\d", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ipv6": (":", rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])"),
    "ip": (r"\d", rf"(?<![\d.vV])(?<!version ){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)"),
    "card": (r"\d", r"(?<![\d.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d]|[.-]\d)"),
    "ssn": (r"\d", r"(?<![\d.-])(?!000|666|9)\d{3}-\d{2}-\d{4}(?![\d]|[.-]\d)"),
    "phone": (r"\d", r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\d+(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\d]|[.-]\d)|(?<![\d.+-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\d]|[.-]\d)|(?<![\d.,+/-]|\d )(?=0[1-9](?:[ -]?\d){7,10}(?![ -]?\d))0\d{1,4}(?:[ -]\d{2,4}){2,4}(?![\d]|[.,/-]\d)"),
    "name": (rf"(?:{_TITLE})\.? ", rf"(?<![\p{{L}}\p{{M}}]){_TITLES}{_WORD}(?: {_WORD})?"),
}
PATTERNS = {kind: pattern for kind, (_, pattern) in KINDS.items()}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = "|".join(sorted({hint for hint, _ in KINDS.values()}))
#: Attempts at a surrogate of the entity's own form; beyond them it gets a name in brackets, of which there is no end.
TRIES = 8

_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιο"}
_CONSONANTS = {"latin": "bdfgklmnprstv", "cyrillic": "бвгдклмнпрст", "greek": "βγδκλμνπρστ"}
_ENDINGS = {"latin": {"female": "a", "male": "n", "any": "er"}, "cyrillic": {"female": "а", "male": "н", "any": "ко"}, "greek": {"female": "α", "male": "ς", "any": "ου"}}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _mod97(text: Column) -> Column:
    """The rest modulo 97 of digits and letters, A as 10 to Z as 35."""
    values = F.transform(_chars(text), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _iban_rest(iban: Column) -> Column:
    return _mod97(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)))


def _kind(mention: Column) -> Column:
    """The kind of a mention; null where its check fails, "known" for a name that stands alone."""
    passes = {
        "iban": lambda m: _iban_rest(F.replace(m, F.lit(" "), F.lit(""))) == 1,
        "card": lambda m: F.call_function("luhn_check", _digits(m)),
        "phone": lambda m: F.length(_digits(m)).between(7, 15),
    }
    found = F.lit("known")
    for kind, pattern in reversed(PATTERNS.items()):
        sure = F.when(passes[kind](mention), F.lit(kind)) if kind in passes else F.lit(kind)
        found = F.when(mention.rlike(rf"^(?:{pattern})$"), sure).otherwise(found)
    return found


def _titled(mention: Column) -> tuple[Column, Column, Column]:
    """All titles with the space behind them, gender, and the words of the name."""
    both = rf"^((?:(?:{_TITLE})\.? +)++)(.*)$"
    title, names = F.regexp_extract(mention, both, 1), F.split(F.regexp_extract(mention, both, 2), " ")
    each = F.split(F.regexp_replace(title, r"\.", ""), " +")
    of = lambda titles: F.arrays_overlap(each, F.array(*map(F.lit, titles)))
    return title, F.when(of(FEMALE_TITLES), "female").when(of(MALE_TITLES), "male").otherwise("any"), names


def _people(text: Column) -> Column:
    """(kind, norm, shown) of the names behind the titles of a text, family names first."""
    mentions = F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))

    def one(mention: Column) -> Column:
        _, gender, names = _titled(mention)
        family = F.struct(F.lit("family").alias("kind"), F.lower(F.element_at(names, -1)).alias("norm"), F.element_at(names, -1).alias("shown"))
        given = F.struct(F.concat(F.lit("given-"), gender).alias("kind"), F.lower(F.element_at(names, 1)).alias("norm"), F.element_at(names, 1).alias("shown"))
        return F.when(F.size(names) > 1, F.array(family, given)).otherwise(F.array(family))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(mentions, one))))


def _pattern(text: Column, people: Column) -> Column:
    """The pattern for a text: that of all kinds, and the names of its people wherever they stand."""
    rare = F.filter(people, lambda p: ~F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{M}])"), p["norm"], F.lit(r"(?![\p{L}\p{M}])"))))
    words = F.array_distinct(F.flatten(F.transform(rare, lambda p: F.array(p["shown"], F.upper(p["shown"])))))
    longest_first = F.array_sort(words, lambda x, y: F.length(y) - F.length(x))
    alone = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}])(?:"), F.array_join(longest_first, "|"), F.lit(r")(?![\p{L}\p{M}])"))
    return F.when(F.size(words) > 0, alone).otherwise(F.lit(PATTERN))


def _parts(kind: Column, mention: Column, people: Column) -> Column:
    """(fixed, kind, norm, shown) pieces of a mention: fixed pieces stay, the others are entities."""
    piece = lambda fixed, kind, norm, shown: F.struct(F.lit(fixed).alias("fixed"), kind.alias("kind"), norm.alias("norm"), shown.alias("shown"))
    plain = lambda text: piece(True, F.lit(None).cast("string"), F.lit(None).cast("string"), text)
    own = lambda kind, norm, shown: piece(False, kind, norm, shown)
    setting = r"^([^=:]*[=:]\s*[\"']?)(.*)$"
    label, value = F.regexp_extract(mention, setting, 1), F.regexp_extract(mention, setting, 2)
    title, gender, names = _titled(mention)
    family = own(F.lit("family"), F.lower(F.element_at(names, -1)), F.element_at(names, -1))
    given = own(F.concat(F.lit("given-"), gender), F.lower(F.element_at(names, 1)), F.element_at(names, 1))
    known = F.element_at(F.filter(people, lambda p: p["norm"] == F.lower(mention)), 1)["kind"]
    digits = _digits(mention)
    return (
        F.when(kind.isNull() | ((kind == "known") & known.isNull()), F.array(plain(mention)))
        .when(kind == "known", F.array(own(known, F.lower(mention), mention)))
        .when(kind == "secret", F.array(plain(label), own(kind, value, value)))
        .when((kind == "name") & (F.size(names) > 1), F.array(plain(title), given, plain(F.lit(" ")), family))
        .when(kind == "name", F.array(plain(title), family))
        .when(kind.isin("email", "ipv6"), F.array(own(kind, F.lower(mention), mention)))
        .when(kind == "iban", F.array(own(kind, F.replace(mention, F.lit(" "), F.lit("")), mention)))
        .when(kind == "phone", F.array(own(kind, F.when(mention.startswith("+"), F.regexp_replace(F.concat(F.lit("+"), digits), r"^\+1(\d{10})$", "$1")).otherwise(digits), mention)))
        .when(kind.isin("card", "ssn"), F.array(own(kind, digits, mention)))
        .otherwise(F.array(own(kind, mention, mention)))
    )


def mentions(docs: DataFrame) -> DataFrame:
    """(row, number, part, fixed, kind, norm, shown) of (row, text, people, pattern): all pieces of all mentions, in order."""
    found = docs.select("row", "people", F.posexplode(F.regexp_extract_all("text", "pattern", F.lit(0))).alias("number", "mention"))
    pieces = found.select("row", "number", F.posexplode(_parts(_kind(F.col("mention")), F.col("mention"), F.col("people"))).alias("part", "piece"))
    return pieces.select("row", "number", "part", "piece.*").distinct()


def _keyed(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal digits."""
    block = hashlib.sha256(key.encode()).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _number(seed: Column, at: Column, below: Column | int) -> Column:
    """A keyed number from 0 to below - 1 for a place of a seed."""
    bits = F.conv(F.substring(F.sha2(F.concat(seed, F.lit("|"), at.cast("string")), 256), 1, 12), 16, 10).cast("long")
    return F.pmod(bits, F.lit(below) if isinstance(below, int) else below).cast("int")


def _pick(letters: str, seed: Column, at: Column) -> Column:
    return F.substring(F.lit(letters), _number(seed, at, len(letters)) + 1, F.lit(1))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _like(text: Column, seed: Column, hexadecimal: Column) -> Column:
    """Each digit and letter by a keyed one of its class; hexadecimal texts stay hexadecimal."""
    swap = lambda c, i: (
        F.when(c.rlike(r"\d"), _pick("0123456789", seed, i))
        .when(hexadecimal & c.rlike("[a-f]"), _pick("abcdef", seed, i))
        .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", seed, i))
        .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", seed, i))
        .otherwise(c)
    )
    return F.array_join(F.transform(_chars(text), swap), "")


def _luhn(digits: Column) -> Column:
    """Digits and their Luhn check digit."""
    backward = F.reverse(F.split(digits, ""))
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.filter(backward, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
    total = F.aggregate(values, F.lit(0), lambda a, b: a + b)
    return F.concat(digits, F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _syllables(script: str, count: Column, seed: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(_pick(_CONSONANTS[script], seed, i * 2), _pick(_VOWELS[script], seed, i * 2 + 1))), "")


def _surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity: a keyed function of its kind, its normal form and the number of the attempt."""
    seed = _keyed(key, F.concat_ws("|", kind, norm, attempt.cast("string")))
    digits = F.array_join(F.transform(_chars(norm), lambda c, i: _pick("0123456789", seed, i)), "")
    user, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    ending = F.element_at(F.split(domain, r"\."), -1)
    host = F.concat(_like(F.substring_index(domain, ".", 1), seed, F.lit(False)), F.lit(".example."), F.when(ending.isin("com", "net", "org"), ending).otherwise("com"))
    grown = lambda text: F.concat(text, F.when(attempt > 0, attempt.cast("string")).otherwise(""))
    email = F.concat(grown(_like(user, seed, F.lit(False))), F.lit("@"), host)
    octet = lambda i, low, many: (_number(seed, F.lit(i), many) + low).cast("string")
    ip = F.concat_ws(".", octet(1, 240, 15), octet(2, 0, 256), octet(3, 0, 256), octet(4, 1, 254))
    ipv6 = F.concat_ws(":", F.lit("2001:db8"), *(F.substring(seed, 1 + 4 * i, 4) for i in range(6)))
    inner = lambda first, last: F.substring(digits, F.lit(first), F.length(norm) - last)
    card = _luhn(F.concat(F.lit("9"), inner(1, 2)))
    ssn = F.concat(F.lit("9"), inner(1, 1))
    # A number of another country keeps its code. What follows begins with 0, as no number does behind a code, or with 00.
    code = F.when(~norm.startswith("+"), 0).when(norm.rlike(r"^\+[17]"), 2).when(F.substring(norm, 2, 2).isin(TWO_DIGIT_CODES), 3).otherwise(4)
    zeros = F.when(norm.startswith("0"), "00").otherwise("0")
    phone = F.concat(F.substring(norm, F.lit(1), code), zeros, F.substring(digits, F.lit(1), F.length(norm) - code - F.length(zeros)))
    account = _like(F.substring(norm, F.lit(5), F.length(norm)), seed, F.lit(False))
    check = F.lpad((98 - _iban_rest(F.concat(F.substring(norm, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(F.substring(norm, 1, 2), check, account)
    access = F.concat(F.substring(norm, 1, 4), _like(F.substring(norm, F.lit(5), F.length(norm)), seed, F.lit(False)))
    named = None
    for script, letter in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", "")):
        for sort in ("female", "male", "any"):
            made = F.concat(_syllables(script, F.lit(2) + attempt + _number(seed, F.lit(0), 2), seed), F.lit(_ENDINGS[script][sort]))
            here = ((kind == f"given-{sort}") | (F.lit(sort == "any") & (kind == "family"))) & norm.rlike(letter)
            named = F.when(here, made) if named is None else named.when(here, made)
    own = (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "ipv6", ipv6)
        .when(kind == "card", card)
        .when(kind == "ssn", ssn)
        .when(kind == "phone", phone)
        .when(kind == "iban", iban)
        .when(kind == "access", access)
        .when(kind == "secret", _like(norm, seed, norm.rlike("^[0-9a-f]+$")))
        .otherwise(named)
    )
    return F.when(attempt >= TRIES, F.concat(F.lit("["), F.split(kind, "-")[0], F.lit("-"), F.substring(seed, 1, 24), F.lit("]"))).otherwise(own)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for distinct (kind, norm): no surrogate twice within a kind, none that is itself an entity.

    Entities that lose a collision (all but the smallest norm of each) try again with the next attempt; each round
    shuffles the surrogates only. From attempt ``TRIES`` on surrogates are names of 96 keyed bits in brackets, so the
    rounds end also where all surrogates of an entity's own form are taken.
    """
    known = spool(entities.select("kind", "norm").distinct(), "pii-entities")
    made = spool(known.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)), "pii-surrogates")
    while True:
        taken = known.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("taken"))
        winner = made.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "norm")).alias("winner"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", "winner.norm").withColumnRenamed("norm", "winner")
        marked = made.join(taken, ["kind", "surrogate"], "left").join(winner, ["kind", "surrogate"], "left")
        lost = F.col("taken").isNotNull() | (F.col("winner").isNotNull() & (F.col("winner") != F.col("norm")))
        marked = marked.withColumn("lost", lost)
        if marked.where("lost").isEmpty():
            discard(known)
            return made.select("kind", "norm", "surrogate")
        again = marked.withColumn("attempt", F.col("attempt") + F.col("lost").cast("int")).select("kind", "norm", "attempt", F.when(F.col("lost"), _surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)).otherwise(F.col("surrogate")).alias("surrogate"))
        new = spool(again, "pii-surrogates")
        discard(made)
        made = new


def _shown(kind: Column, surrogate: Column, shown: Column) -> Column:
    """A surrogate in the form of a mention: its separators, its country code and its letter case."""
    given = surrogate
    signs = F.when(kind == "iban", F.lit("[A-Z0-9]")).otherwise(F.lit(r"\d"))
    surrogate = F.when(kind == "phone", _digits(surrogate)).otherwise(surrogate)
    spare = F.when(kind == "phone", F.length(_digits(shown)) - F.length(surrogate)).otherwise(0)  # digits of the mention before those of the entity
    filled = F.aggregate(
        _chars(shown),
        F.struct((-spare).alias("used"), F.lit("").alias("text")),
        lambda acc, c: F.when(
            F.regexp_like(c, signs), F.struct((acc["used"] + 1).alias("used"), F.concat(acc["text"], F.when(acc["used"] < 0, c).otherwise(F.substring(surrogate, acc["used"] + 1, F.lit(1)))).alias("text"))
        ).otherwise(F.struct(acc["used"].alias("used"), F.concat(acc["text"], c).alias("text"))),
        lambda acc: acc["text"],
    )
    upper = (F.upper(shown) == shown) & (F.length(shown) > 1)
    return (
        F.when(given.startswith("["), given)
        .when(kind.isin("card", "ssn", "phone", "iban"), filled)
        .when(kind.startswith("given") | (kind == "family"), F.when(upper, F.upper(surrogate)).otherwise(F.initcap(surrogate)))
        .when(kind.isin("email", "ipv6") & upper, F.upper(surrogate))
        .otherwise(surrogate)
    )


def replace_entities(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced by its surrogate; other columns stay as they were.

    Null and empty texts and texts without entities stay as they are. Rows equal in doc_id and text come back alike;
    doc_id may be null. ``key``, which must be kept secret and can't be empty, selects the surrogates: the same key gives
    the same ones for the same entities, but for those that collisions moved. ``counts`` adds n_entities.
    """
    if not key:
        raise ValueError("surrogates need a key")
    body = F.col("folio_row")[text]
    given = docs.select(F.struct("*").alias("folio_row"))
    marked = given.withColumn("holds", F.coalesce(body.rlike(HINT) & body.rlike(PATTERN), F.lit(False)))
    named = F.concat(F.coalesce(F.concat(F.lit("="), F.col("folio_row")[doc_id].cast("string")), F.lit("")), F.lit("|"), body)
    touched = marked.where("holds").select("folio_row", F.sha2(named, 256).alias("row"), body.alias("text")).withColumn("people", _people(F.col("text")))
    touched = touched.withColumn("pattern", _pattern(F.col("text"), F.col("people")))
    found = spool(mentions(touched.select("row", "text", "people", "pattern")), "pii-mentions")
    mapping = surrogates(found.where("NOT fixed").groupBy("kind", "norm").agg(F.lit(1)), key)
    moved = found.where("NOT fixed").join(mapping, ["kind", "norm"]).select("row", "number", "part", "fixed", _shown(F.col("kind"), F.col("surrogate"), F.col("shown")).alias("shown"))
    whole = found.where("fixed").select("row", "number", "part", "fixed", "shown").unionByName(moved)
    spoken = whole.groupBy("row", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "shown"))), lambda p: p["shown"]), "").alias("spoken"), (~F.every("fixed")).cast("long").alias("n"))
    by_row = spoken.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "spoken"))), lambda p: p["spoken"]).alias("spoken"), F.sum("n").alias("n"))
    joined = touched.join(by_row, "row", "left")
    woven = F.array_join(F.zip_with(F.split("text", F.col("pattern"), -1), F.col("spoken"), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")

    def columns(new: Column, n: Column) -> list[Column]:
        own = [new.alias(c) if c == text else F.col("folio_row")[c].alias(c) for c in docs.columns]
        return own + ([n.cast("long").alias("n_entities")] if counts else [])

    return joined.select(*columns(woven, F.coalesce("n", F.lit(0)))).unionByName(marked.where("NOT holds").select(*columns(body, F.lit(0))))


def session_key(spark: SparkSession) -> str:
    """The key that the session names as ``spark.folio.pii.key``; a public one, for demonstrations only, where it names none."""
    return spark.conf.get("spark.folio.pii.key", None) or "demonstration only"
