r"""PII surrogates: every detected entity gets a keyed replacement of its own kind (DataFrame functions only).

Found are e-mail addresses, telephone, card and social security numbers, IBANs, IPv4 addresses, secrets (long hex
strings and well-known key shapes) and names after a title.  The replacement keeps kind and format: digits become
digits, letters become letters of the same case and script, separators and lengths stay; cards keep the issuer's first
two digits and get a valid check digit, IBANs keep their country and get valid ones; an IPv4 address stays one; the mail
domain becomes a reserved one; a name keeps its title and number of words and ends as names of that gender do.

A replacement is drawn from SHA-256 of a secret key, the kind, the entity in canonical form (digits only, lower case; a
name with the gender of its title, so "Mr. Smith" and "Herr Smith" are one; a telephone number without a country code 1) and an attempt number.  Equal entities thus
get equal replacements in all documents and formats (coreference).  All distinct entities of the corpus are checked: of
those that drew the same replacement, or one that is itself an entity of the corpus, only the least keeps it, the others
draw again until all are distinct within their kind.  Mail names and names grow with the attempts, so they cannot run out; a
format of fixed length whose numbers are nearly all taken (``MAX_ATTEMPTS`` draws in vain) ends with an error.

The texts are searched once; what was found is written beside them to the shared folder.  Documents without an entity
are passed through unshuffled.  Each distinct surface is dressed once, and occurrences are joined to surfaces by a join
that Spark splits where one surface is very frequent; the replacements of a text come back to it by the text's hash, so
no broadcast grows with the data.

Defined results: null and empty texts come back as they are; repeated rows stay; several entities of one text are
replaced from left to right without overlap; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, discard, settle

KEY = "shelfmark surrogate key"
#: Kinds that a telephone number must not run into, with their patterns (Java).
IP = r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:(?:4[0-9]{3}|5[1-5][0-9]{2}|2[2-7][0-9]{2}|35[0-9]{2}|6011|64[4-9][0-9]|65[0-9]{2})[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
LOCAL = r"[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}"
#: A further group of digits of a telephone number: no address, card, social security or local number begins after its space.
GROUP = "(?:(?! (?:" + "|".join([IP, CARD, SSN, LOCAL + "(?![0-9A-Za-z])"]) + "))[ .-]?[0-9]{2,5})"
#: Ten national digits as 3-3-4 are a whole number, and what follows is not part of it; other layouts have two to four groups.
WHOLE = r"\+(?:1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:" + WHOLE + r"|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})" + GROUP + r"{2,4}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|" + LOCAL + ")(?![0-9A-Za-z])"
#: Titles; those that may also stand behind a name or a letter (fixed first) count only where no capital word is before them.
TITLE = (
    r"(?:(?:Sr|M)\.(?<!\p{Lu}[\p{L}'’-]{0,30} (?:Sr|M)\.)|(?:Mrs?|Ms|Dr|Prof|Sra|Srta|MRS?|MS|DR|PROF)\.|Miss|MISS|Mister|Herr|HERR|Frau|FRAU|Señora?|SEÑORA?|Monsieur|Madame|Mme|Mlle|Господин|ГОСПОДИН|Госпожа|ГОСПОЖА)"
)
#: A name: a capital, then letters and inner apostrophes and hyphens up to the end of the word.
WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-][\p{L}][\p{L}\p{M}]*+)*+(?![\p{L}\p{N}])"
#: Words in capitals that are no second name.
JOINING = "AND|OR|THE|IS|WAS|HAS|HAD|OF|FROM|TO|IN|AT|UND|ODER|IST|WAR|HAT|VON|AUS|ET|OU|EST|DE|Y|EN|И|ИЛИ"
#: Length of an IBAN by its country (fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
}


def _iban_pattern() -> str:
    """Country, check digits and the groups of four that its length leaves, the last one shorter."""
    of = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        of.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{groups}}}" + (f" ?[0-9A-Z]{{{rest}}}" if rest else ""))
    return r"(?<![0-9A-Za-z])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(of) + r")(?![0-9A-Za-z])"


#: Kinds in the order in which a match is named, with their patterns (Java).
KINDS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])",
    "iban": _iban_pattern(),
    "ip": IP,
    "card": CARD,
    "ssn": SSN,
    "phone": PHONE,
    "name": r"(?<![\p{L}\p{N}])" + TITLE + " " + WORD + "(?: (?!(?:" + TITLE + "|" + JOINING + r")(?!\p{L}))" + WORD + ")?",
}
ANY_KIND = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without any of these holds no entity.
HINT = r"[0-9@]|(?:Sr|M|Mrs?|Ms|Dr|Prof|Sra|Srta|MRS?|MS|DR|PROF)\. |Miss|MISS|Mister|Herr|HERR|Frau|FRAU|Señor|SEÑOR|Monsieur|Madame|Mme|Mlle|Госпо|ГОСПО"
FEMALE = r"^(?:Mrs\.|MRS\.|Ms\.|MS\.|Miss|MISS|Frau|FRAU|Señora|SEÑORA|Sra\.|Srta\.|Madame|Mme|Mlle|Госпожа|ГОСПОЖА) "
#: First letters of a canonical name, by gender.
FEMALE_MARK, MALE_MARK = "f ", "m "
LATIN = ["ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "ta", "ve", "wi", "jo", "ha", "ke"]
CYRILLIC = ["ба", "де", "фи", "го", "лу", "ма", "не", "пи", "ро", "су", "та", "ве", "ви", "жо", "ха", "ке"]
MAX_ATTEMPTS = 64


def kind_of(surface: Column) -> Column:
    """Kind of a match; null for what has the shape of a card number or an IBAN but not its check digits."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(surface.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    number = F.replace(surface, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(number, F.lit(5), F.length(number)), F.substr(number, F.lit(1), F.lit(4)))
    wrong = ((out == "card") & (_luhn(F.regexp_replace(surface, "[^0-9]", ""), 1) % 10 != 0)) | ((out == "iban") & (_mod97(moved) != 1))
    return F.when(wrong, F.lit(None)).otherwise(out)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of the number in which each capital stands for its two digits (A is 10)."""
    number = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.try_to_number(c, F.lit("9")).cast("int"))
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.pmod(acc * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + number(c), F.lit(97)).cast("int"))


def _international(surface: Column) -> Column:
    """Whether a telephone number has the country code 1 before its ten national digits."""
    return surface.startswith("+1") & (F.length(F.regexp_replace(surface, "[^0-9]", "")) == 11)


def _luhn(digits: Column, first: int) -> Column:
    """Check sum; ``first`` is 1 if the last digit is the check digit, 0 if it is still missing."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda c, i: c.cast("int") * F.when(i % 2 == first, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))


def canonical(kind: Column, surface: Column) -> Column:
    digits = F.regexp_replace(surface, "[^0-9]", "")
    return (
        F.when((kind == "phone") & _international(surface), F.substr(digits, F.lit(2), F.lit(10)))
        .when(kind.isin("card", "ssn", "phone"), digits)
        .when(kind == "iban", F.replace(surface, F.lit(" "), F.lit("")))
        .when(kind == "email", F.lower(surface))
        .when(kind == "name", F.concat(F.when(surface.rlike(FEMALE), FEMALE_MARK).otherwise(MALE_MARK), F.lower(F.regexp_replace(surface, r"^\S+ ", ""))))
        .otherwise(surface)
    )


def _stream(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """Hex digits enough for four per character of the value."""
    blocks = F.sequence(F.lit(0), (F.length(value) / 16).cast("int") + 2)
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt, b.cast("string")).cast("binary"), 256)), "")


def _draw(stream: Column, i: Column, below: Column | int) -> Column:
    """A number below ``below`` from the i-th four hex digits."""
    return F.pmod(F.conv(F.substr(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(below) if isinstance(below, int) else below)


def _char(c: Column, stream: Column, i: Column) -> Column:
    def letter(first: str, n: int) -> Column:
        return F.substr(F.lit("".join(chr(ord(first) + k) for k in range(n))), _draw(stream, i, n) + 1, F.lit(1))

    return (
        F.when(c.rlike("[0-9]"), _draw(stream, i, 10).cast("string"))
        .when(c.rlike("[a-z]"), letter("a", 26))
        .when(c.rlike("[A-Z]"), letter("A", 26))
        .when(c.rlike(r"[а-я]"), letter("а", 32))
        .when(c.rlike(r"[А-Я]"), letter("А", 32))
        .when(c.rlike(r"[α-ω]"), letter("α", 17))
        .otherwise(c)
    )


def _masked(value: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: _char(c, stream, i)), "")


def _hex(value: Column, stream: Column) -> Column:
    """Hex strings stay hex, in the same case."""
    return F.when(value.rlike("^[0-9a-f]+$"), F.substr(stream, F.lit(1), F.length(value))).when(value.rlike("^[0-9A-F]+$"), F.upper(F.substr(stream, F.lit(1), F.length(value))))


def _card(value: Column, stream: Column) -> Column:
    body = F.concat(F.substr(value, F.lit(1), F.lit(2)), F.substr(_masked(value, stream), F.lit(3), F.length(value) - 3))
    return F.concat(body, F.pmod(F.lit(10) - _luhn(body, 0) % 10, F.lit(10)).cast("string"))


def _iban(value: Column, stream: Column) -> Column:
    """The country stays, letters and digits are drawn, the two check digits are those of ISO 7064 (mod 97)."""
    country, body = F.substr(value, F.lit(1), F.lit(2)), F.substr(_masked(value, stream), F.lit(5), F.length(value))
    return F.concat(country, F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body)


def _name(value: Column, stream: Column, attempt: Column) -> Column:
    """Syllables of the name's script with the ending of its gender; more of them at each attempt."""
    words = F.split(F.regexp_replace(value, r"^\S+ ", ""), " ")
    female = value.startswith(FEMALE_MARK)
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    pool = F.when(cyrillic, F.array(*map(F.lit, CYRILLIC))).otherwise(F.array(*map(F.lit, LATIN)))
    ending = F.when(cyrillic, F.when(female, "на").otherwise("н")).otherwise(F.when(female, "na").otherwise("n"))

    def word(_: Column, i: Column) -> Column:
        syllables = F.transform(F.sequence(F.lit(0), attempt.cast("int") + 1), lambda s: F.element_at(pool, _draw(stream, F.pmod(i * 7 + s, F.length(stream) / 4 - 1).cast("int"), 16) + 1))
        return F.initcap(F.concat(F.array_join(syllables, ""), ending))

    return F.lower(F.array_join(F.transform(words, word), " "))


def surrogate(kind: Column, value: Column, attempt: Column, s: Column) -> Column:
    """Replacement of an entity in canonical form (of a name: without the title), drawn from the stream ``s``."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    # After a few draws in vain the local part gets more letters.
    more = F.substr(F.translate(s, "0123456789", "ghijklmnop"), F.lit(2), F.floor(attempt.cast("int") / 4).cast("int"))
    mail = F.concat(_masked(local, s), more, F.lit("@"), _masked(F.substring_index(domain, ".", 1), F.reverse(s)), F.lit(".example."), F.substring_index(domain, ".", -1))
    ip = F.concat_ws(".", *[(_draw(s, F.lit(k), 254) + 1).cast("string") for k in range(4)])
    number = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(_masked(value, s), F.lit(2), F.length(value)))
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", ip)
        .when(kind == "card", _card(value, s))
        .when(kind == "phone", number)
        .when(kind == "iban", _iban(value, s))
        .when(kind == "name", _name(value, s, attempt))
        .when(kind == "ssn", _masked(value, s))
        .otherwise(F.coalesce(_hex(value, s), _masked(value, s)))
    )


def dress(kind: Column, surface: Column, replacement: Column) -> Column:
    """The replacement in the format of the surface."""
    # The k-th digit or capital of the surface becomes the k-th character of the replacement; a country code 1 stays.
    code = F.when((kind == "phone") & _international(surface), 1).otherwise(0)
    place = lambda i: F.length(F.regexp_replace(F.substr(surface, F.lit(1), i + 1), "[^0-9A-Z]", "")) - code
    filled = F.array_join(F.transform(F.split(surface, ""), lambda c, i: F.when(c.rlike("[0-9A-Z]") & (place(i) > 0), F.substr(replacement, place(i), F.lit(1))).otherwise(c)), "")
    title = F.regexp_extract(surface, r"^\S+ ", 0)
    bare = F.when(kind == "name", F.regexp_replace(surface, r"^\S+ ", "")).otherwise(surface)
    shouted = (F.upper(bare) == bare) & (F.lower(bare) != bare)
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"), filled)
        .when(kind == "name", F.concat(title, F.when(shouted, F.upper(replacement)).otherwise(F.initcap(replacement))))
        .when((kind == "email") & shouted, F.upper(replacement))
        .otherwise(replacement)
    )


def draw(entities: DataFrame, key: str) -> DataFrame:
    """Adds replacement; the stream is a column of its own so that it is made once per row, not once per character."""
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt").cast("string")
    streamed = entities.withColumn("__stream", _stream(kind, value, attempt, key))
    return streamed.withColumn("replacement", surrogate(kind, value, attempt, F.col("__stream"))).drop("__stream")


def distinct_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, replacement): one row per entity, replacements distinct within a kind and no entity themselves."""
    # The expressions cost more than their few bytes tell, so the rows are dealt out evenly before they run.
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = settle(entities.select("kind", "value").distinct().repartition(parts, "kind", "value").withColumn("attempt", F.lit(0)), "values")
    table = settle(draw(values, key), "entities")
    # A drawn name has no gender mark, so it is held against the names of the corpus without theirs.
    bare = F.when(F.col("kind") == "name", F.regexp_replace("value", r"^\S+ ", "")).otherwise(F.col("value"))
    real = settle(table.select("kind", bare.alias("replacement")).distinct(), "real")
    discard(values)
    for _ in range(MAX_ATTEMPTS):
        claims = table.groupBy("kind", "replacement").agg(F.min("value").alias("first"), F.count("*").alias("n"))
        claims = claims.join(real.withColumn("is_real", F.lit(True)), ["kind", "replacement"], "left").where("n > 1 OR is_real")
        claims = settle(claims.select("kind", "replacement", "first", F.coalesce("is_real", F.lit(False)).alias("is_real")), "claims")
        if claims.isEmpty():
            discard(real, claims)
            return table.select("kind", "value", "replacement")
        judged = table.join(claims, ["kind", "replacement"], "left").withColumn("again", F.coalesce(F.col("is_real") | (F.col("value") != F.col("first")), F.lit(False)))
        kept = judged.where("NOT again").select("kind", "value", "attempt", "replacement")
        drawn = draw(judged.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), key)
        old, table = table, settle(kept.unionByName(drawn), "entities")
        discard(old, claims)
    raise ValueError("surrogates stay ambiguous: too many entities of one kind for its format")


def found_entities(documents: DataFrame) -> DataFrame:
    """The documents' columns, __found (array of surfaces, null for none) and __key (hash of the text, null for none), settled.

    This is the only search over all texts.
    """
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found = documents.withColumn("__found", F.when(hinted, F.regexp_extract_all("text", F.lit(ANY_KIND), F.lit(0))))
    found = found.withColumn("__found", F.when(F.size("__found") > 0, F.col("__found")))
    return settle(found.withColumn("__key", F.when(F.col("__found").isNotNull(), F.md5(F.col("text").cast("binary")))), "found")


def pseudonymise(documents: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with replaced entities, and __n_entities."""
    columns = documents.columns
    documents = apart(documents, "text")
    inner = documents.columns
    found = found_entities(documents)
    dirty = found.where("__key IS NOT NULL")
    # Rows of one text have one set of occurrences.
    surfaces = settle(dirty.select("__key", "__found").dropDuplicates(["__key"]).select("__key", F.posexplode("__found").alias("pos", "surface")), "surfaces")
    forms = surfaces.select("surface").distinct().withColumn("kind", kind_of(F.col("surface"))).where("kind IS NOT NULL")
    forms = settle(forms.withColumn("value", canonical(F.col("kind"), F.col("surface"))), "forms")
    table = distinct_surrogates(forms, key)
    dressed = settle(forms.join(table, ["kind", "value"]).select("surface", dress(F.col("kind"), F.col("surface"), F.col("replacement")).alias("new")), "dressed")
    by_text = surfaces.join(dressed, "surface").groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("__new"))
    both = dirty.join(settle(by_text, "by_text"), "__key", "left")
    gaps = F.split("text", ANY_KIND, -1)
    woven = F.transform(gaps, lambda gap, i: F.when(i == 0, gap).otherwise(F.concat(F.coalesce(F.element_at("__new", i - 1), F.element_at("__found", i)), gap)))
    rewritten = both.withColumn("text", F.array_join(woven, "")).withColumn("__n_entities", F.coalesce(F.size("__new"), F.lit(0)).cast("long")).select(*inner, "__n_entities")
    untouched = found.where("__key IS NULL").select(*inner, F.lit(0).cast("long").alias("__n_entities"))
    return untouched.unionByName(rewritten).toDF(*columns, "__n_entities")


def op5_surrogates(spark: SparkSession, documents: DataFrame) -> DataFrame:
    out = pseudonymise(documents.select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("__n_entities").alias("n_entities"))
