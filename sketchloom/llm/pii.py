"""Personal data: keyed surrogates of the same type, script and format.

Native: DataFrame functions only.

Every distinct entity, in a normal form of its own type, gets a surrogate from
a keyed hash.  A surrogate that equals another entity's surrogate, or an entity
of the corpus, is drawn again with the next attempt number until all differ, so
different entities stay different.  The same entity has one surrogate wherever
it occurs and however it is written: the normal form is replaced and then
rendered in the form found (punctuation of numbers, case of letters).

Types: e-mail addresses (the labels of the host stay below the same top-level
domain), telephone numbers (the country code stays), IPv4 and IPv6 addresses,
payment card numbers (Luhn-valid ones stay valid), IBANs (those with right check
digits get right ones), US social security numbers, credentials assigned to
names such as token or password, and names after a title.

Names are replaced word by word: a family name has one surrogate with or without
the given name, and a given name one for each gender that titles give it (one
met only after titles such as Dr or Prof has that of the gendered one, if there
is one).  In a text with titled names, later mentions of their words without a
title are replaced too, where they stand as words with a capital.  Latin,
Cyrillic and Greek names get names of the same script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, text_of

_TITLE_F = r"(?:Mrs|Ms|Miss|Mme|Madame|Frau|Señora|Sra|Г-жа|Κα)"
_TITLE_M = r"(?:Mr|Monsieur|Herr|Señor|Sr|Г-н|Κος)"
_TITLE_N = r"(?:Dr|Prof|Professor|Doktor|Professeur|Doctor)"
#: Words in lower case before a family name, which stay.
_PARTICLE = r"(?:van|von|vom|zu|zum|der|den|de|del|della|di|da|do|dos|du|la|las|le|los|ten|ter|af)"
# repeats of groups are bounded, since the matcher recurses into them
_TITLE = rf"(?:{_TITLE_F}|{_TITLE_M}|{_TITLE_N})\.? (?:{_TITLE_N}\.? ){{0,20}}(?:{_PARTICLE} ){{0,3}}"
_H = "[0-9A-Fa-f]{1,4}"
_ASSIGN = r"""(?i:token|secret|password|passwd|api.?key)["']?\s{0,3}[=:]\s{0,3}["']?"""
#: An entity begins where a word could; what may not stand before some types is said there.
PATTERNS = {
    # without quotes only what has both letters and digits
    "secret": rf"""{_ASSIGN}(?:(?<=["'])[A-Za-z0-9+/_=!@#$%^&*~?-]{{8,}}+(?=["'])|(?<!["'])(?=[A-Za-z+/_=-]{{0,99}}[0-9])(?=[0-9+/_=-]{{0,99}}[A-Za-z])[A-Za-z0-9+/_=-]{{8,}}+(?!["']))""",
    "email": r"(?<![.+%-])[\w.+%-]++@[\w-]+(?:\.[\w-]+){0,125}\.\p{L}{2,}",
    "ipv4": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ipv6": rf"(?<!:)(?=[A-Fa-f:]*\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}})(?![\w:])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![.-])(?:\d{13,19}+|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7})(?![\w-])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4})(?!\w)",
    "name": rf"{_TITLE}\p{{Lu}}[\p{{L}}'’-]*(?: \p{{Lu}}[\p{{L}}'’-]*){{0,2}}",
}
#: Joins of entities and surrogates are dealt to so many tasks an entity.
SALTS = 8
ANY = r"(?<![\w\p{L}])(?:" + "|".join(PATTERNS.values()) + ")"

_FIRST = {
    ("Latin", "f"): "Anna Clara Emma Eva Ida Julia Laura Lena Maria Nora Olga Paula Rosa Sara Vera Zoe",
    ("Latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leon Max Oscar Paul Simon Victor",
    ("Cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Ольга Софья",
    ("Cyrillic", "m"): "Антон Борис Виктор Денис Игорь Максим Павел Сергей",
    ("Greek", "f"): "Άννα Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία Χαρά",
    ("Greek", "m"): "Άρης Γιάννης Δημήτρης Κώστας Μάριος Νίκος Πέτρος Στέφανος",
}
_SYLLABLES = {
    "Latin": "ba be bo da de do fa ga ka ke la le lo ma me mo na ne no pa ra re ro sa se so ta te to va vi zo",
    "Cyrillic": "ба бе во га да де до за ка ко ла ле ло ма ме мо на не но па ра ре ро са со та те то ва ви зо ми",
    "Greek": "βα βε γα δα δε ζα θα κα κο λα λε λο μα με μο να νε νο πα ρα ρε ρο σα σο τα τε το φα φι χα χο μι",
}


def _hash(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits of a keyed hash (HMAC-like, the key on both sides)."""
    inner = F.sha2(F.concat_ws("\u0000", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.sha2(F.concat_ws("\u0000", F.lit(key), inner), 256)


def _stream(digest: Column, i: Column, below: int) -> Column:
    """A number below ``below`` from the i-th stretch of a hash, drawn out as far as needed."""
    part = F.sha2(F.concat_ws(":", digest, F.floor(i / 8).cast("string")), 256)
    at = (F.pmod(i, F.lit(8)) * 8 + 1).cast("int")
    return F.pmod(F.conv(F.substr(part, at, F.lit(8)), 16, 10).cast("long"), F.lit(below)).cast("int")


def _redraw(text: Column, digest: Column, digits: bool = True, letters: bool = True) -> Column:
    """Each digit or letter replaced by another of its kind, the rest as it is."""

    def one(c, i):
        out = c
        low = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), _stream(digest, i, 26) + 1, F.lit(1))
        if letters:
            out = F.when(c.rlike(r"^\p{Ll}$"), low).when(c.rlike(r"^\p{Lu}$"), F.upper(low)).otherwise(out)
        if digits:
            out = F.when(c.rlike("^[0-9]$"), _stream(digest, i, 10).cast("string")).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _redraw_hex(text: Column, digest: Column) -> Column:
    """Hexadecimal digits replaced by such, in the case they have."""
    return F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c, i: F.when(c.rlike("^[0-9a-f]$"), F.lower(F.hex(_stream(digest, i, 16)))).when(c.rlike("^[A-F]$"), F.hex(_stream(digest, i, 16))).otherwise(c),
        ),
        "",
    )


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, from the right, the last one single."""
    return F.aggregate(
        F.transform(
            F.reverse(F.split(digits, "")),
            lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10).cast("int")),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def _choose(words: str, digest: Column, i: int) -> Column:
    names = words.split()
    return F.element_at(F.array(*map(F.lit, names)), _stream(digest, F.lit(i), len(names)) + 1)


def kind_of(entity: Column) -> Column:
    """The type of a found entity, by the first pattern that matches it whole; names with their gender (n: unknown)."""
    out = F.when(entity.rlike(f"^{_ASSIGN}"), "secret")
    for kind in ("email", "ipv4", "ipv6", "iban", "ssn", "card", "phone"):
        out = out.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.when(entity.rlike(rf"^{_TITLE_F}\.? "), "name-f").when(entity.rlike(rf"^{_TITLE_M}\.? "), "name-m").otherwise("name-n")


def lead_of(entity: Column) -> Column:
    """What is found with an entity but stays: the name a credential is assigned to, titles."""
    return F.regexp_extract(entity, rf"^(?:{_ASSIGN}|{_TITLE})", 0)


def _normal(kind: Column, entity: Column) -> Column:
    """One form for all spellings of an entity."""
    return (
        F.when(kind.isin("card", "ssn"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(entity, "[^0-9+]", ""))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind.startswith("name"), F.initcap(F.lower(entity)))
        .otherwise(entity)
    )


def _units(kind: Column, normal: Column) -> Column:
    """What gets a surrogate of its own: each word of a name by its role, any other entity whole."""
    words = F.split(normal, " ")
    given = F.concat(F.lit("given"), F.substr(kind, F.lit(5)))
    role = lambda w, i: F.struct(F.when(i == F.size(words) - 1, "family").otherwise(given).alias("unit"), w.alias("value"))
    return F.when(kind.startswith("name"), F.transform(words, role)).otherwise(F.array(F.struct(kind.alias("unit"), normal.alias("value"))))


def _tail(digest: Column, n: int, letters: bool) -> Column:
    """``n`` more letters or digits for a surrogate, none at first."""
    return _redraw(F.lit(("x" if letters else "0") * n), _hash("tail", digest)) if n else F.lit("")


def _mod97(text: Column) -> Column:
    """Remainder by 97 of digits and capitals, A standing for 10 and so on."""
    digit = lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97))
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("^[0-9]$"), digit(a, c)).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def _script_of(word: Column, by_script: dict[str, Column]) -> Column:
    out = F.when(word.rlike(r"\p{IsCyrillic}"), by_script["Cyrillic"]).when(word.rlike(r"\p{IsGreek}"), by_script["Greek"])
    return out.otherwise(by_script["Latin"])


def surrogate(key: str, kind: Column, normal: Column, attempt: int) -> Column:
    """A draw for the normal form of a unit; the attempt number changes it.

    Later attempts draw longer forms where the type allows it: a syllable more
    for a name at each attempt, a letter or digit more for addresses, telephone
    numbers and credentials from the fourth on.
    """
    d = _hash(key, kind, normal, F.lit(attempt))
    more = max(0, attempt - 2)
    user, host = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    top = F.regexp_extract(host, r"((?:\.example)?\.[^.]+)$", 1)
    empty = ~F.concat(user, F.substr(host, F.lit(1), F.length(host) - F.length(top))).rlike("[A-Za-z0-9]")
    user = F.when(empty, F.regexp_replace(user, ".", "x")).otherwise(user)
    email = F.concat(_redraw(user, d), _tail(d, more, True), F.lit("@"), _redraw(F.substr(host, F.lit(1), F.length(host) - F.length(top)), _hash(key, d, F.lit("host"))), top)
    octet = lambda i: (_stream(d, F.lit(i), 254) + 1).cast("string")
    ip = F.concat_ws(".", octet(0), octet(1), octet(2), octet(3))
    code = F.regexp_extract(normal, r"^(\+1|\+7|\+\d{2})", 1)
    phone = F.concat(code, _redraw(F.substr(normal, F.length(code) + 1, F.length(normal)), d), _tail(d, more, False))
    body = _redraw(F.substr(normal, F.lit(1), F.length(normal) - 1), d)
    check = F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    valid = F.pmod(_luhn_sum(normal), F.lit(10)) == 0
    card = F.concat(body, F.when(valid, check).otherwise(_stream(d, F.lit(99), 10).cast("string")))
    country, account = F.substr(normal, F.lit(1), F.lit(2)), _redraw(F.substr(normal, F.lit(5), F.length(normal)), d)
    right = _mod97(F.concat(F.substr(normal, F.lit(5), F.length(normal)), F.substr(normal, F.lit(1), F.lit(4)))) == 1
    digits = F.when(right, 98 - _mod97(F.concat(account, country, F.lit("00")))).otherwise(_stream(d, F.lit(98), 100))
    iban = F.concat(country, F.lpad(digits.cast("string"), 2, "0"), account)
    filled = F.when(normal.rlike("[A-Za-z0-9]"), normal).otherwise(F.regexp_replace(normal, ".", "x"))
    secret = F.when(normal.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _redraw_hex(normal, d)).otherwise(_redraw(filled, d))
    secret = F.concat(secret, F.when(normal.rlike("^[0-9]+$"), _tail(d, more, False)).otherwise(_tail(d, more, True)))
    family, given = {}, {}
    for script in _SYLLABLES:
        syllables = [_choose(_SYLLABLES[script], d, i) for i in (1, 2, 3, *range(7, 7 + attempt))]
        family[script] = F.initcap(F.concat(*syllables))
        women, men = _FIRST[script, "f"], _FIRST[script, "m"]
        first = F.when(kind == "given-f", _choose(women, d, 0)).when(kind == "given-m", _choose(men, d, 0)).otherwise(_choose(f"{women} {men}", d, 0))
        given[script] = F.concat(first, *syllables[:attempt])
    return (
        F.when(kind == "email", email).when(kind == "ipv4", ip).when(kind == "ipv6", _redraw_hex(normal, d)).when(kind == "phone", phone).when(kind == "card", card)
        .when(kind == "ssn", _redraw(normal, d)).when(kind == "iban", iban).when(kind == "secret", secret)
        .when(kind == "family", _script_of(normal, family)).otherwise(_script_of(normal, given))
    )


def _render(kind: Column, entity: Column, drawn: Column) -> Column:
    """The surrogate in the form of the entity found."""
    chars = F.split(entity, "")
    spaced = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike("[0-9A-Z+]"), F.struct(F.concat(s["out"], F.substr(drawn, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    spaced = F.concat(spaced["out"], F.substr(drawn, spaced["at"], F.length(drawn)))
    cased = F.array_join(
        F.transform(chars, lambda c, i: F.when(c.rlike(r"^\p{Lu}$"), F.upper(F.substr(drawn, i + 1, F.lit(1)))).otherwise(F.substr(drawn, i + 1, F.lit(1)))), ""
    )
    rest = F.substr(drawn, F.length(entity) + 1, F.length(drawn))
    cased = F.concat(cased, F.when(entity == F.upper(entity), F.upper(rest)).otherwise(rest))
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"), spaced)
        .when(kind.isin("email", "ipv6"), cased)
        .when(kind.startswith("name") & (F.length(entity) > 1) & (entity == F.upper(entity)), F.upper(drawn))
        .otherwise(drawn)
    )


def _assign(units: DataFrame, key: str, attempts: int) -> DataFrame:
    """(unit, value, drawn) with all values of drawn different, from each other and from all values."""
    pending, done = materialize(units, "pii-units"), None
    every = pending.select(F.col("value").alias("drawn")).distinct()
    for attempt in range(attempts):
        drawn = pending.select("unit", "value", surrogate(key, F.col("unit"), F.col("value"), attempt).alias("drawn"))
        first = W.partitionBy("drawn").orderBy("unit", "value")
        fresh = drawn.withColumn("place", F.row_number().over(first)).join(every, "drawn", "left_anti")
        if done is not None:
            fresh = fresh.join(done.select("drawn"), "drawn", "left_anti")
        fresh = fresh.where("place = 1").select("unit", "value", "drawn")
        done = materialize(fresh if done is None else done.unionByName(fresh), "pii-drawn")
        pending = materialize(pending.join(done.select("unit", "value"), ["unit", "value"], "left_anti"), "pii-pending")
        if not pending.limit(1).count():
            return done
    raise RuntimeError(f"some entities have no surrogate of their own after {attempts} attempts")


def _with_neutral(units: DataFrame, key: str, attempts: int) -> DataFrame:
    """Surrogates of all units; given names of unknown gender take the gendered one's, if there is one."""
    gendered = units.where(F.col("unit").isin("given-f", "given-m")).groupBy("value").agg(F.max("unit").alias("known"))
    own = units.join(gendered, "value", "left").withColumn("known", F.when(F.col("unit") == "given-n", F.coalesce("known", "unit")).otherwise(F.col("unit")))
    own = materialize(own.select("unit", "value", "known"), "pii-known")
    drawn = _assign(own.select(F.col("known").alias("unit"), "value").distinct(), key, attempts)
    return own.join(drawn.withColumnRenamed("unit", "known"), ["known", "value"]).select("unit", "value", "drawn")


def _salted(marked: DataFrame, drawn: DataFrame) -> DataFrame:
    """``marked`` with the surrogates of its units; rows of an entity that is everywhere go to SALTS tasks."""
    spread = drawn.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return marked.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int")).join(spread, ["unit", "value", "salt"])


def _mentions(piece: Column, pattern: Column, alias: Column) -> Column:
    """(text, n): a stretch between entities with its mentions of known names replaced, and their number."""
    found = F.regexp_extract_all(piece, pattern, F.lit(0))
    new = F.transform(found, lambda m: _render(F.lit("name"), m, F.element_at(alias, F.initcap(F.lower(m)))))
    joined = F.array_join(F.zip_with(F.split(piece, pattern, -1), new, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    return F.when(pattern.isNull(), F.struct(piece.alias("text"), F.lit(0).alias("n"))).otherwise(F.struct(joined.alias("text"), F.size(found).alias("n")))


def replace_pii(docs: DataFrame, key: str, attempts: int = 50) -> DataFrame:
    """``docs`` with surrogates in ``text``, and a column ``pii_entities`` (long) more.

    All columns of ``docs`` stay; one of them named pii_entities is replaced.  A
    text without entities stays as it is, a null text stays null (0 entities).
    Rows are numbered as they are read, so null or repeated ids do no harm.  An
    empty table gives an empty result.  Surrogates of names, addresses, telephone
    numbers and credentials grow until all differ; an address or a credential of
    neither letters nor digits gets letters.  Those of the other types keep
    their length; entities that take up their numbers (a billion or more) end in
    an error after ``attempts`` draws, never in a shared surrogate.

    The corpus is searched once and written with what was found; only rows with
    entities are joined, by their number.
    """
    columns = [c for c in docs.columns if c != "pii_entities"]
    found = F.coalesce(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    tagged = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("d"), found.alias("found"), F.monotonically_increasing_id().alias("row")), "pii-tagged")
    entries = (
        tagged.where(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "found"))
        .withColumn("lead", lead_of(F.col("found"))).withColumn("kind", kind_of(F.col("found")))
        .withColumn("entity", F.substr("found", F.length("lead") + 1, F.length("found")))
        .select("row", "at", "lead", "kind", "entity", _normal(F.col("kind"), F.col("entity")).alias("normal"))
    )
    entries = materialize(entries, "pii-entries")
    is_name = F.col("kind").startswith("name")
    units = entries.select("row", "at", "kind", F.size(F.split("normal", " ")).alias("words"), F.explode(_units(F.col("kind"), F.col("normal"))).alias("u"))
    units = units.select("row", "at", "kind", "words", "u.unit", "u.value")
    drawn = _with_neutral(units.select("unit", "value").distinct(), key, attempts)
    marked = materialize(_salted(units, drawn).select("row", "at", "kind", "words", "unit", "value", "drawn"), "pii-marked")
    # a word of a full name keeps that surrogate where it stands alone in the same text
    rank = F.struct(F.col("words") == 1, F.col("unit"))
    alias = marked.where(is_name).groupBy("row", "value").agg(F.min_by("drawn", rank).alias("drawn"))
    alias = alias.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("value", "drawn"))).alias("alias"))
    whole = marked.where(~is_name).select("row", "at", "drawn")
    rows = (
        entries.join(whole, ["row", "at"], "left").groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("at", "lead", "kind", "entity", F.coalesce("drawn", "normal").alias("drawn")))).alias("held")).join(alias, "row", "left")
    )
    as_found = F.array_distinct(F.flatten(F.transform(F.filter("held", lambda e: e["kind"].startswith("name")), lambda e: F.split(e["entity"], " "))))
    forms = F.filter(F.array_distinct(F.concat(as_found, F.transform(as_found, F.upper))), lambda w: F.length(w) > 1)
    longest = F.array_sort(forms, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).otherwise(F.when(x < y, -1).when(x > y, 1).otherwise(0)))
    pattern = F.when(F.size(forms) > 0, F.concat(F.lit(r"(?<![\w\p{L}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\w\p{L}])")))
    name = lambda e: F.array_join(F.transform(F.split(e["drawn"], " "), lambda w: F.element_at("alias", w)), " ")
    new = F.transform("held", lambda e: F.concat(e["lead"], _render(e["kind"], e["entity"], F.when(e["kind"].startswith("name"), name(e)).otherwise(e["drawn"]))))
    rows = materialize(rows.select("row", new.alias("new"), pattern.alias("pattern"), "alias"), "pii-by-row")
    touched = (
        tagged.where(F.size("found") > 0).join(rows, "row")
        .withColumn("pieces", F.transform(F.split("d.text", ANY, -1), lambda p: _mentions(p, F.col("pattern"), F.col("alias"))))
        .withColumn("text", F.array_join(F.zip_with("pieces", "new", lambda p, n: F.concat(p["text"], F.coalesce(n, F.lit("")))), ""))
        .withColumn("n", F.size("new").cast("long") + F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["n"]))
    )
    same = [F.col("d")[c].alias(c) for c in columns]
    replaced = [F.col("text") if c == "text" else F.col("d")[c].alias(c) for c in columns]
    untouched = tagged.where(F.size("found") == 0).select(*same, F.lit(0).cast("long").alias("pii_entities"))
    return untouched.unionByName(touched.select(*replaced, F.col("n").alias("pii_entities")))
