"""Personal data replaced by keyed surrogates of the same type and format.

Detected are e-mail addresses, IPv4 and IPv6 addresses, telephone numbers, long card
and account numbers, international account numbers whose check digits hold, social
security numbers, secret keys, keys of known prefixes and personal names: a listed
given name, initials, a capitalised family name, or a title and one or two
capitalised words. An entity has the same surrogate wherever it occurs (coreference), two entities have
different ones (distinctness), and no surrogate is an entity that occurs in the
texts; a check of all of them repeats until nothing collides. Digits become
digits, letters letters of the same case, punctuation stays; e-mail domains get a
reserved top domain, addresses of one domain keep sharing one; octets keep their
number of digits; a number that passes the card checksum still does, and an
international account number keeps its country and gets valid check digits; names keep
gender and script, words after a title stay as many (a given name that is not listed
becomes a gender-neutral one).

A format may have fewer forms than the texts have entities ("+1 2 33 44" has 100,000).
What collides again and again gets longer surrogates, one character more with each
attempt, so that the attempts end; only then does a surrogate leave its format.

Without the key, a surrogate says nothing about its entity.

Defined cases: NULL and empty texts stay as they are, as do texts without
entities; rows that share an id are told apart by their text, and rows that are
repeated are treated alike; an empty table gives no rows; a domain of more than 127
labels is none, and its text may be replaced in part. Only doc_id and text are
read; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcost.llm.words import take
from haulcost.sources.scratch import cut_lineage, release

# Given names by gender and script, family names by script.
MALE_LATIN = (
    "James Robert Michael William David Thomas Charles Daniel Matthew Anthony Hans Jürgen "
    "Wolfgang Klaus Pierre François Jacques Carlos Miguel Luis Jorge Javier"
).split()
FEMALE_LATIN = (
    "Mary Patricia Jennifer Elizabeth Barbara Susan Jessica Sarah Karen Margaret Ursula Monika "
    "Sabine Brigitte Nathalie Françoise Sylvie Carmen María Lucía Isabel Pilar"
).split()
MALE_CYRILLIC = "Александр Сергей Дмитрий Андрей Алексей Михаил Иван Николай Павел Виктор".split()
FEMALE_CYRILLIC = "Анна Елена Ольга Татьяна Наталья Ирина Мария Светлана Екатерина Юлия".split()
FAMILY_LATIN = (
    "Smith Johnson Brown Miller Wilson Moore Taylor Walker Young Hill Müller Schneider Fischer "
    "Weber Wagner Becker Hoffmann Martin Bernard Dubois Moreau Laurent Lefebvre Girard García "
    "Fernández López Martínez Sánchez Romero Torres Ramírez"
).split()
FAMILY_MALE_CYRILLIC = "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков".split()
FAMILY_FEMALE_CYRILLIC = [x + "а" for x in FAMILY_MALE_CYRILLIC]
GROUPS = {
    "male_latin": (MALE_LATIN, FAMILY_LATIN),
    "female_latin": (FEMALE_LATIN, FAMILY_LATIN),
    "male_cyrillic": (MALE_CYRILLIC, FAMILY_MALE_CYRILLIC),
    "female_cyrillic": (FEMALE_CYRILLIC, FAMILY_FEMALE_CYRILLIC),
}
# Further given names that are looked for, by the group that replaces them.
ALSO_GIVEN = {
    "male_latin": (
        "John Richard Joseph Christopher Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George "
        "Timothy Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin "
        "Scott Brandon Benjamin Samuel Gregory Alexander Patrick Frank Raymond Jack Dennis Jerry Peter Henry "
        "Adam Nathan Walter Kyle Harold Carl Arthur Roger Albert Ahmed Mohammed Mohamed Ali Omar Hassan "
        "Stefan Andreas Markus Uwe Dieter Günter Heinz Karl Fritz Jean Michel Philippe Alain Nicolas Olivier "
        "Laurent Marc Juan José Antonio Francisco Manuel Pedro Diego Alejandro Fernando Rafael Sergio Pablo"
    ).split(),
    "female_latin": (
        "Linda Lisa Nancy Betty Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah "
        "Stephanie Rebecca Sharon Laura Cynthia Dorothy Amy Kathleen Angela Shirley Emma Brenda Pamela Nicole "
        "Anna Samantha Katherine Christine Helen Debra Rachel Carolyn Janet Maria Catherine Heather Diane "
        "Olivia Julie Joyce Victoria Ruth Virginia Lauren Kelly Christina Joan Evelyn Judith Alice Fatima "
        "Aisha Petra Renate Claudia Gabriele Heike Birgit Ingrid Marie Jeanne Sophie Camille Isabelle Valérie "
        "Ana Laura Marta Elena Rosa Teresa Cristina Paula Raquel Beatriz Julia Martha Gloria"
    ).split(),
    "male_cyrillic": "Владимир Евгений Максим Денис Олег Игорь Юрий Борис Роман Константин Антон Илья".split(),
    "female_cyrillic": "Марина Людмила Галина Надежда Вера Любовь Валентина Дарья Алина Ксения".split(),
}
#: Every given name that is looked for, by group.
LOOKED_FOR = {group: [*given, *ALSO_GIVEN[group]] for group, (given, _) in GROUPS.items()}
# Titles before a name, and gender-neutral given names by script.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Monsieur Madame Señor Señora".split()
NEUTRAL_LATIN = "Alex Robin Kim Chris Sam Dominique Sascha Jamie".split()
NEUTRAL_CYRILLIC = "Саша Женя Валя Слава".split()
# Countries by the length of their international account numbers.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_GIVEN = sorted({name for names in LOOKED_FOR.values() for name in names})

#: Kinds of entity in the order in which they are tried. Every pattern starts where nothing
#: that it could have begun with stands before, so a text is searched in one pass; long
#: lists are only gone through after a look at what they all begin with. Groups
#: are repeated a bounded number of times (a domain has at most 127 labels), as the engine
#: goes one call deeper with each.
_NAMED = rf"(?:{'|'.join(_GIVEN + [x.upper() for x in _GIVEN])})"
_FAMILY = r"\p{Lu}[\p{L}\p{M}'’\-]*\p{L}"
_AFTER_GIVEN = rf"(?:[ \u00a0]{{1,8}}\p{{Lu}}\.){{0,3}}[ \u00a0]{{1,8}}{_FAMILY}"
_ACCOUNT = "|".join(
    rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[0-9A-Z]){{{length - 4}}}"
    for length, countries in ACCOUNT_LENGTHS.items()
)
_HEX = "[0-9A-Fa-f]"
_INITIALS = "".join(sorted({title[0] for title in TITLES}))
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-@])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@(?:[\p{L}\p{N}\-]++\.){1,126}\p{L}{2,}",
    "key": (
        r"(?<![\p{L}\p{N}_\-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_\-]{35}|gh[pousr]_[0-9A-Za-z]{36,255}"
        r"|(?:sk|pk|rk)[\-_](?:[0-9A-Za-z]{2,10}[\-_]){0,3}[0-9A-Za-z]{20,255}|xox[abprs]-[0-9A-Za-z\-]{10,255})"
        r"(?![\p{L}\p{N}])"
    ),
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])",
    "account": rf"(?<![\p{{L}}\p{{N}}])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_ACCOUNT})(?![\p{{L}}\p{{N}}])",
    # Eight groups, or fewer around a double colon after a group of three or four.
    "ip6": (
        rf"(?<![\p{{L}}\p{{N}}:.])(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{7}}|(?=[A-Fa-f:]{{0,32}}[0-9])"
        rf"{_HEX}{{3,4}}(?::{_HEX}{{1,4}}){{0,5}}::(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{0,5}})?)(?![\p{{L}}\p{{N}}:])"
    ),
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "phone": (
        # Numbers of country code 1 have ten digits; a number that follows is not theirs.
        r"(?<![\p{L}\p{N}+])(?:\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}"
        r"|\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,3}"
        r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}"
        r"|(?<![.,/\-])0[1-9]\d{1,3}[ /\-]\d{5,8}(?![.,/\-]\d))(?![\p{L}\p{N}])"
    ),
    "number": r"(?<![\p{L}\p{N}])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])",
    "titled": (
        rf"(?<![\p{{L}}\p{{M}}])(?=[{_INITIALS}])(?:{'|'.join(TITLES)})\.?[ \u00a0]{{1,8}}(?!{_NAMED}{_AFTER_GIVEN}|(?:{'|'.join(TITLES)})(?![\p{{L}}\p{{M}}]))"
        rf"{_FAMILY}(?:[ \u00a0]{{1,8}}{_FAMILY})?"
    ),
    "name": rf"(?<![\p{{L}}\p{{M}}])(?=\p{{Lu}}){_NAMED}{_AFTER_GIVEN}",
}
ANY = "|".join(PATTERNS.values())
#: Fixed value: the part of a key that says what it is for, which stays.
KEY_PREFIX = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|(?:sk|pk|rk)[\-_](?:[0-9A-Za-z]{2,10}[\-_]){0,3})"
#: Fixed value: the title of a name, which stays.
TITLE = r"^[\p{L}]+\.?[ \u00a0]+"
#: After so many attempts a surrogate may have more characters than its entity.
LOOSER = 4
#: From this attempt on every surrogate gets one character more with each attempt, so that
#: no number of entities uses up its format for good.
WIDER = 12


def _whole(kind: str) -> Column:
    return F.col("entity").rlike(f"^(?:{PATTERNS[kind]})$")


def kind_of() -> Column:
    kinds = list(PATTERNS)
    return reduce(lambda c, k: c.when(_whole(k), k), kinds[1:], F.when(_whole(kinds[0]), kinds[0]))


def _digits(*parts: Column | str) -> Column:
    """128 hexadecimal digits that depend on the key and the parts."""
    texts = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.sha2(F.concat_ws("\x1f", F.col("_key"), *[t.cast("string") for t in texts]), 512)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values)).cast("int") + 1)


def _number(hex_digits: Column, start: int, length: int = 7) -> Column:
    return F.conv(F.substring(hex_digits, start, length), 16, 10).cast("long")


def _scrambled(text: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Digits for digits and letters for letters of the same case; the rest stays."""
    letters = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"

    def swap(char: Column, at: Column) -> Column:
        value = F.conv(F.substring(stream, F.pmod(at * 3, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")
        digit = F.substring(F.lit("0123456789"), value % 10 + 1, F.lit(1))
        letter = F.substring(F.lit(letters), value % len(letters) + 1, F.lit(1))
        letter = F.when(char.rlike(r"\p{Lu}"), F.upper(letter)).otherwise(letter)
        return F.when(char.rlike("[0-9]"), digit).when(char.rlike(r"\p{L}"), letter).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def _card_sum(number: Column) -> Column:
    """The card checksum of a text's digits: 0 if it holds."""
    digits = F.reverse(F.split(F.regexp_replace(number, r"\D", ""), ""))

    def weighed(d: Column, at: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(at % 2 == 0, d.cast("int")).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.transform(digits, weighed), F.lit(0), lambda a, b: a + b) % 10


def _checked(fake: Column) -> Column:
    """The text with its last digit chosen so that the card checksum holds."""
    head = F.substring(fake, F.lit(1), F.length(fake) - 1)
    rest = _card_sum(F.concat(head, F.lit("0")))
    return F.concat(head, F.pmod(10 - rest, F.lit(10)).cast("string"))


def _account_rest(text: Column) -> Column:
    """The remainder by 97 of a text whose letters count as 10 to 35."""

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return (
            F.when(code.between(48, 57), (rest * 10 + code - 48) % 97)
            .when(code.between(65, 90), (rest * 100 + code - 55) % 97)
            .otherwise(rest)
        )

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _account_holds(account: Column) -> Column:
    tail = F.substring(account, F.lit(5), F.length(account))
    return _account_rest(F.concat(tail, F.substring(account, 1, 4))) == 1


def _account(stream: Column, wide: Column) -> Column:
    """Another account of the same country, with check digits that hold."""
    country, own = F.substring("normal", 1, 2), F.substring(F.col("normal"), F.lit(5), F.length("normal"))
    made = F.concat(_scrambled(own, stream), wide)
    check = F.lit(98) - _account_rest(F.concat(made, country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), made)


def _titled(stream: Column) -> Column:
    """As many words as the entity has after its title, in its script."""
    cyrillic = F.col("normal").rlike(r"\p{IsCyrillic}")
    woman = F.col("normal").rlike("а$")
    pick = lambda names, at: _pick(names, _number(stream, at))

    def family(at: int) -> Column:
        russian = F.when(woman, pick(FAMILY_FEMALE_CYRILLIC, at)).otherwise(pick(FAMILY_MALE_CYRILLIC, at))
        return F.when(cyrillic, russian).otherwise(pick(FAMILY_LATIN, at))

    given = F.when(cyrillic, pick(NEUTRAL_CYRILLIC, 41)).otherwise(pick(NEUTRAL_LATIN, 41))
    before = F.when(F.col("normal").contains(" "), F.concat(given, F.lit(" "))).otherwise("")
    parts = [before, family(11)]
    for number, at in ((1, 21), (2, 31)):
        parts.append(F.when(F.col("attempt") >= number * LOOSER, F.concat(F.lit("-"), family(at))).otherwise(""))
    parts.append(F.when(F.col("attempt") >= WIDER, F.concat(F.lit("-"), _more(stream, "a"))).otherwise(""))
    return F.lower(F.concat(*parts))


def _more(stream: Column, sample: str) -> Column:
    """As many more characters like the sample as there were attempts from WIDER on."""
    extra = F.greatest(F.col("attempt") - WIDER + 1, F.lit(0))
    return F.when(extra > 0, _scrambled(F.repeat(F.lit(sample), extra), stream)).otherwise("")


def _name(stream: Column) -> Column:
    given = F.split("normal", "[ \u00a0]")[0]
    choice = None
    for group, (own, family) in GROUPS.items():
        # Another name of the group: some places after the entity's own, if that is one.
        place = F.array_position(F.array(*[F.lit(x.lower()) for x in own]), given)
        another = place + _number(stream, 1) % (len(own) - 1)
        more = F.when(
            F.col("attempt") >= LOOSER,
            F.concat(F.lit("-"), _pick(family, _number(stream, 21))),
        ).otherwise("")
        even_more = F.when(
            F.col("attempt") >= 2 * LOOSER,
            F.concat(F.lit("-"), _pick(family, _number(stream, 31))),
        ).otherwise("")
        wide = F.when(F.col("attempt") >= WIDER, F.concat(F.lit("-"), _more(stream, "a"))).otherwise("")
        made = F.concat(
            _pick(own, another), F.lit(" "), _pick(family, _number(stream, 11)), more, even_more, wide
        )
        own_group = given.isin([x.lower() for x in LOOKED_FOR[group]])
        choice = F.when(own_group, made) if choice is None else choice.when(own_group, made)
    return F.lower(choice)


def surrogate() -> Column:
    """The lower-case surrogate of ``normal``, given kind, attempt and key."""
    stream = _digits(F.col("kind"), F.col("normal"), F.col("attempt"))
    extra = F.when(
        F.col("attempt") >= LOOSER, (_number(stream, 101) % 100_000).cast("string")
    ).otherwise("")
    extra = F.concat(extra, _more(stream, "0"))
    domain = F.split("normal", "@")[1]
    by_domain = _digits(F.lit("domain"), domain)
    host = _scrambled(F.lit("abcdefgh"), by_domain)
    email = F.concat(_scrambled(F.split("normal", "@")[0], stream), extra, F.lit("@"), host, F.lit(".example"))
    low = lambda octet: F.when(F.length(octet) == 1, 0).when(F.length(octet) == 2, 10).otherwise(100)
    span = lambda octet: F.when(F.length(octet) == 1, 10).when(F.length(octet) == 2, 90).otherwise(156)

    def octet(char: Column, at: Column) -> Column:
        value = F.conv(F.substring(stream, at * 5 + 1, F.lit(5)), 16, 10).cast("int")
        loose = F.col("attempt") >= LOOSER
        return F.when(loose, value % 256).otherwise(low(char) + value % span(char)).cast("string")

    ip = F.array_join(F.transform(F.split("normal", r"\."), octet), ".")
    country = F.regexp_extract("normal", r"^(?:\+\d{1,3}(?=[ .\-(])|0(?=[1-9]\d{1,3}[ /\-]))", 0)
    wide = _more(stream, "0")
    prefix = F.regexp_extract("normal", KEY_PREFIX, 0)
    secret_key = F.concat(prefix, _scrambled(F.substring("normal", F.length(prefix) + 1, F.length("normal")), stream))
    phone = F.concat(country, _scrambled(F.substring("normal", F.length(country) + 1, F.length("normal")), stream))
    digits = F.concat(_scrambled(F.col("normal"), stream), wide)
    number = F.when(_card_sum(F.col("normal")) == 0, _checked(digits)).otherwise(digits)
    secret = F.concat(_scrambled(F.col("normal"), stream, hexadecimal=True), wide)
    port = F.when(F.col("attempt") >= WIDER, F.concat(F.lit(":"), wide)).otherwise("")
    return (
        F.when(F.col("kind") == "email", email)
        .when(F.col("kind") == "key", F.concat(secret_key, wide))
        .when(F.col("kind") == "secret", secret)
        .when(F.col("kind") == "account", _account(stream, wide))
        .when(F.col("kind") == "ip6", secret)
        .when(F.col("kind") == "ip", F.concat(ip, port))
        .when(F.col("kind") == "phone", F.concat(phone, wide))
        .when(F.col("kind") == "number", number)
        .when(F.col("kind") == "ssn", digits)
        .when(F.col("kind") == "titled", _titled(stream))
        .when(F.col("kind") == "name", _name(stream))
    )


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, surrogate) of distinct entities, free of collisions.

    Of the entities that share a surrogate the first keeps it, unless it is an
    entity itself; the others try again with the next attempt.
    """
    state = cut_lineage(
        entities.withColumn("attempt", F.lit(0))
        .withColumn("_key", F.lit(key))
        .withColumn("surrogate", surrogate())
        .drop("_key")
    )
    while True:
        rank = F.row_number().over(Window.partitionBy("surrogate").orderBy("attempt", "kind", "normal"))
        real = state.select(F.col("normal").alias("surrogate"), F.lit(True).alias("real")).distinct()
        judged = state.withColumn("_rank", rank).join(real, "surrogate", "left")
        again = (F.col("_rank") > 1) | F.coalesce("real", F.lit(False))
        after = cut_lineage(judged.withColumn("again", again).select("kind", "normal", "attempt", "surrogate", "again"))
        release(state)
        if after.filter("again").isEmpty():
            return after.select("kind", "normal", "surrogate")
        state = cut_lineage(
            after.withColumn("attempt", F.col("attempt") + F.col("again").cast("int"))
            .withColumn("_key", F.lit(key))
            .withColumn("surrogate", F.when(F.col("again"), surrogate()).otherwise(F.col("surrogate")))
            .select("kind", "normal", "attempt", "surrogate")
        )
        release(after)


def found(documents: DataFrame) -> DataFrame:
    """Distinct entities per document: doc, version, entity, kind and normal form."""
    matches = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    return (
        documents.select("doc", "version", F.explode(F.array_distinct(matches)).alias("entity"))
        .withColumn("kind", kind_of())
        .withColumn(
            "normal",
            F.when(F.col("kind") == "number", F.regexp_replace("entity", r"\D", ""))
            .when(F.col("kind") == "key", F.col("entity"))
            .when(F.col("kind") == "account", F.regexp_replace("entity", " ", ""))
            .when(
                F.col("kind") == "titled",
                F.regexp_replace(F.regexp_replace(F.lower("entity"), TITLE, ""), "[ \u00a0]+", " "),
            )
            .when(F.col("kind") == "name", F.regexp_replace(F.lower("entity"), "[ \u00a0]+", " "))
            .otherwise(F.lower("entity")),
        )
        .where((F.col("kind") != "account") | _account_holds(F.col("normal")))
    )


def _grouped(kept: str = "[0-9]", between: str = "[^0-9]") -> Column:
    """The surrogate's characters with the entity's separators between them."""
    upto = lambda at: F.length(F.regexp_replace(F.substring("entity", F.lit(1), at + 1), between, ""))
    more = F.substring("surrogate", F.length("normal") + 1, F.length("surrogate"))
    digits = F.array_join(
        F.transform(
            F.split("entity", ""),
            lambda char, at: F.when(
                char.rlike(kept), F.substring("surrogate", upto(at), F.lit(1))
            ).otherwise(char),
        ),
        "",
    )
    return F.concat(digits, more)


def _cased() -> Column:
    upper = (F.col("entity") == F.upper("entity")) & (F.col("entity") != F.lower("entity"))
    return (
        F.when(F.col("kind") == "number", _grouped())
        .when(F.col("kind") == "key", F.col("surrogate"))
        .when(F.col("kind") == "account", _grouped("[0-9A-Z]", "[^0-9A-Z]"))
        .when(
            F.col("kind") == "titled",
            F.concat(F.regexp_extract("entity", TITLE, 0), F.initcap(F.regexp_replace("surrogate", "-", "- "))),
        )
        .when(upper, F.upper("surrogate"))
        .when(F.col("kind") == "name", F.initcap(F.regexp_replace("surrogate", "-", "- ")))
        .otherwise(F.col("surrogate"))
    )


def with_surrogates(documents: DataFrame, key: str) -> DataFrame:
    """The documents with entities in ``text`` replaced; adds ``_entities``, how many differ.

    Documents and entities meet by place; texts travel once, to the documents'
    replacements. An entity that very many documents hold is a hot key of a join
    that Spark can split.
    """
    # Rows travel as one column, so that no name of theirs meets a name used here.
    keyed = documents.select(F.struct("*").alias("_row")).withColumn(
        "_version", F.xxhash64("_row.text")
    )
    texts = keyed.select(
        F.col("_row.doc_id").alias("doc"), F.col("_version").alias("version"), F.col("_row.text").alias("text")
    )
    some = rf"[0-9@]|\p{{Lu}}\p{{L}}+[ \u00a0]+\p{{Lu}}|(?:{'|'.join(TITLES)})\.[ \u00a0]"
    places = cut_lineage(found(texts.filter(F.col("text").rlike(some))).distinct())
    names = assigned(places.select("kind", "normal").distinct(), key)
    also = F.hash("kind", "normal")
    replaced = places.withColumn("_also", also).join(
        names.withColumn("_also", also).hint("merge"), ["kind", "normal", "_also"]
    )
    pair = F.struct("entity", F.regexp_replace(_cased(), "- ", "-").alias("by"))
    per_document = replaced.groupBy("doc", "version").agg(
        F.map_from_entries(F.collect_list(pair)).alias("_by")
    )
    joined = keyed.join(
        per_document,
        F.col("_row.doc_id").eqNullSafe(F.col("doc")) & (F.col("_version") == F.col("version")),
        "left",
    )
    text = F.col("_row.text")
    rebuilt = F.array_join(
        F.zip_with(
            F.split(text, ANY, -1),
            F.regexp_extract_all(text, F.lit(ANY), F.lit(0)),
            lambda between, match: F.concat(
                between, F.coalesce(F.element_at(F.col("_by"), match), match, F.lit(""))
            ),
        ),
        "",
    )
    changed = F.col("_row").withField("text", F.when(F.col("_by").isNull(), text).otherwise(rebuilt))
    return joined.select(
        changed.alias("_row"), F.coalesce(F.size("_by"), F.lit(0)).alias("_entities")
    ).select("_row.*", "_entities")


def op2_pii_surrogates(spark, sf_dir: str, key: str = "surrogates-1") -> DataFrame:
    """All documents with surrogates in place of personal data."""
    documents = take(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text")
    return with_surrogates(documents, key).withColumnRenamed("_entities", "n_entities")
