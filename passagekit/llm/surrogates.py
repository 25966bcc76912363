"""PII surrogates (native: no Python on the executors).

Detected entities are replaced by keyed stand-ins of the same type: e-mail
addresses, telephone, card and social security numbers, IBANs, IPv4 addresses,
access tokens and names. A name is known by a form of address before it; in the
same document it is then replaced wherever it stands, so that no mention keeps the
real name beside the stand-in. A stand-in keeps the format
(separators, letter case, length; a Luhn-valid card stays valid, octets stay
below 256), a name's gender and script, and depends on the key and the entity's
canonical form only, so all mentions of an entity in the corpus agree, however
they are written.

Distinct canonical forms are collected by a partial aggregate; a stand-in that
equals another's or any real entity of its type is drawn again until none
clashes. Redrawn names grow by a syllable a draw, and the other types but ipv4
and tokens grow from draw ``LONGER`` on, so stand-ins never run out, also where
a format is too short for all its entities. Mentions meet their stand-ins in a join whose hot keys Spark splits;
only documents with an entity are shuffled.

Defined results: a null text stays null; empty texts and texts without entities
pass unchanged; null and repeated ids are allowed (rows are told apart by id and
text); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, staged

# Fixed formats of the entity types, in the order in which they are tried.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "token": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])"
             r"|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"
             r"|(?<![A-Za-z0-9+.\-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![A-Za-z0-9]|[.\-][0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{4}(?:[ \-]?[0-9]{4}){3}(?:[ \-]?[0-9]{3})?|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}"
            r"|[0-9]{4}(?:[ \-][0-9]{3}){3}|[0-9]{13,19})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9\-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
}
_NAME = r"\p{Lu}[\p{L}'\-]+(?: \p{Lu}[\p{L}'\-]+)*+"
MALE = r"(?<=(?<![\p{L}])(?:Mr|Herr|Monsieur|Sr|Señor|г-н|[Гг]осподин)\.? )(" + _NAME + ")"
FEMALE = r"(?<=(?<![\p{L}])(?:Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|г-жа|[Гг]оспожа)\.? )(" + _NAME + ")"
PATTERN = "|".join([*FORMATS.values(), MALE, FEMALE])

# A cheap pattern that every entity contains, tried first: most texts have none.
HINT = (r"@|[0-9]{2}|[0-9]\.[0-9]|[0-9a-f]{32}|[0-9A-F]{32}"
        r"|(?:M[rsiomae]|Herr|Frau|S[re])[a-zñ]{0,7}\.? \p{Lu}|(?:г-н|г-жа|осподин|оспожа)\.? \p{Lu}")
KEY = "spark.passagekit.surrogates.key"     # setting that holds the secret key

# Given names by gender and script, and syllables for family names.
GIVEN = {
    ("m", "latin"): ["Adam", "Boris", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leon", "Martin"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина"],
}
SYLLABLES = {"latin": ["bar", "del", "fin", "gor", "hal", "kin", "lor", "mon", "nev", "ral", "sen", "tor"],
             "cyrillic": ["бар", "дел", "фин", "гор", "лор", "мон", "нев", "рал", "сен", "тор"]}
LONGER = 6                   # draws that keep the length; later ones append to it
DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def _pick(options: str, i: Column) -> Column:
    return F.substring(F.lit(options), i % len(options) + 1, F.lit(1))


def _word(options: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (i % len(options) + 1).cast("int"))


def _byte(h: Column, i: Column) -> Column:
    """Number 0 to 255 from a hexadecimal digest, cycling through it."""
    return F.conv(F.substring(h, ((i * 2) % 64 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _appended(options: list[str], h: Column, n: Column) -> Column:
    """``n`` words of ``options`` drawn from a digest, as one string."""
    places = F.arrays_zip(F.sequence(F.lit(1), n).alias("i"), F.array_repeat(h, n).alias("h"))
    drawn = F.transform(places, lambda x: _word(options, _byte(x["h"], x["i"] + 2)))
    return F.when(n > 0, F.array_join(drawn, "")).otherwise(F.lit(""))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _redrawn(text: Column, h: Column, letters: str = LOWER) -> Column:
    """``text`` with its digits and lower-case letters drawn anew."""
    drawn = F.transform(F.arrays_zip(_chars(text).alias("c"), F.array_repeat(h, F.length(text)).alias("h")),
                        lambda x, i: F.when(x["c"].rlike("[0-9]"), _pick(DIGITS if letters == LOWER else letters, _byte(x["h"], i)))
                        .when(x["c"].rlike("[a-z]"), _pick(letters, _byte(x["h"], i))).otherwise(x["c"]))
    return F.array_join(drawn, "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string (0 modulo 10: valid)."""
    return F.aggregate(F.reverse(_chars(digits)), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")),
                       lambda a, c: F.struct(
                           (a["s"] + F.when(a["i"] % 2 == 0, c.cast("int")).otherwise(
                               F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))).alias("s"),
                           (a["i"] + 1).alias("i")), lambda a: a["s"])


def _card(canon: Column, h: Column) -> Column:
    """Same length and first digit; the last digit keeps a valid number valid."""
    body = F.concat(F.substring(canon, 1, 1), F.substring(_redrawn(canon, h), F.lit(2), F.length(canon) - 2))
    check = ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    return F.concat(body, F.when(luhn_sum(canon) % 10 == 0, check).otherwise(_pick(DIGITS, _byte(h, F.lit(20)))))


def _name(canon: Column, gender: Column, h: Column, attempt: Column, key: str) -> Column:
    """Given names of the gender (one for each word before the last) and a
    family name, in the script of the original. Family names are keyed by
    themselves."""
    family = F.element_at(F.split(canon, " "), -1)
    words = F.size(F.split(canon, " "))
    two = words > 1
    fh = F.sha2(F.concat_ws("|", F.lit(key), F.lit("family"), family,
                            F.when(two, F.lit(0)).otherwise(attempt).cast("string")), 256)
    out = None
    for script in ("cyrillic", "latin"):
        parts = [_word(SYLLABLES[script], _byte(fh, F.lit(i))) for i in range(3)]
        first = F.when(gender == "f", _word(GIVEN["f", script], _byte(h, F.lit(1)))).otherwise(
            _word(GIVEN["m", script], _byte(h, F.lit(1))))
        # a family keeps its name: redrawn members get a longer given name
        more = _appended(SYLLABLES[script], h, attempt)
        last = F.initcap(F.concat(*parts))
        middle = F.when(gender == "f", _appended([" " + x for x in GIVEN["f", script]], h, words - 2)).otherwise(
            _appended([" " + x for x in GIVEN["m", script]], h, words - 2))
        name = F.when(two, F.concat(first, F.when(attempt > 0, F.lit("-")).otherwise(F.lit("")), more, middle, F.lit(" "), last)
                      ).otherwise(F.concat(last, more))
        out = name if out is None else F.when(canon.rlike(r"\p{IsCyrillic}"), out).otherwise(name)
    return out


def stand_in(kind: Column, canon: Column, gender: Column, attempt: Column, key: str) -> Column:
    """Keyed stand-in for a canonical form."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    letters, digits = (_appended(list(x), h, F.greatest(attempt - LONGER, F.lit(0))) for x in (LOWER, DIGITS))
    domain = F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    dh = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(_redrawn(F.substring_index(canon, "@", 1), h), letters, F.lit("@"), _redrawn(host, dh), top)
    phone = F.concat(F.substring(canon, 1, 1), _redrawn(F.substring(canon, F.lit(2), F.length(canon)), h), digits)
    iban = F.concat(F.substring(canon, 1, 2), _redrawn(F.substring(canon, F.lit(3), F.length(canon)), h), digits)
    ipv4 = F.concat_ws(".", *[(_byte(h, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    return (F.when(kind == "email", email).when(kind == "token", _redrawn(canon, h, HEX))
            .when(kind == "phone", phone).when(kind == "card", F.concat(_card(canon, h), digits))
            .when(kind == "ssn", F.concat(_redrawn(canon, h), digits))
            .when(kind == "iban", iban).when(kind == "ipv4", ipv4)
            .otherwise(F.lower(_name(canon, gender, h, attempt, key))))


def kind_of(raw: Column, male: Column, female: Column) -> Column:
    out = F.when(male != "", "name").when(female != "", "name")
    for kind, pattern in FORMATS.items():
        out = out.when(raw.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("name")


def canonical(kind: Column, raw: Column) -> Column:
    """What all spellings of an entity share."""
    return (F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(raw, "[^0-9]", ""))
            .when(kind == "iban", F.lower(F.regexp_replace(raw, " ", "")))
            .when(kind == "ipv4", F.regexp_replace(raw, r"(?<![0-9])0+(?=[0-9])", ""))
            .otherwise(F.lower(raw)))


def laid_out(kind: Column, raw: Column, sur: Column) -> Column:
    """The stand-in in the format of a mention."""
    # separators of the mention, with the stand-in's characters in between
    rank = F.transform(_chars(raw), lambda c: F.when(c.rlike("[0-9A-Za-z]"), 1).otherwise(0))
    at = F.transform(rank, lambda r, i: F.when(r == 1, i).otherwise(-1))
    places = F.filter(at, lambda i: i >= 0)
    spaced = F.array_join(F.transform(
        F.arrays_zip(_chars(raw).alias("c"), F.array_repeat(sur, F.length(raw)).alias("s"),
                     F.array_repeat(places, F.length(raw)).alias("p")),
        lambda x, i: F.when(x["c"].rlike("[0-9A-Za-z]"), F.substring(x["s"], F.array_position(x["p"], i).cast("int"), F.lit(1)))
        .otherwise(x["c"])), "")
    # what a grown stand-in has beyond the mention's places
    spaced = F.concat(spaced, F.substring(sur, F.size(places) + 1, F.length(sur)))
    cased = F.when(raw == F.upper(raw), F.upper(sur))
    return (F.when(kind.isin("phone", "card", "ssn"), spaced).when(kind == "iban", F.upper(spaced))
            .when(kind.isin("email", "token"), cased.otherwise(sur)).when(kind == "ipv4", sur)
            .otherwise(cased.otherwise(F.replace(F.initcap(F.replace(sur, F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-")))))


def entity_table(mentions: DataFrame, key: str) -> DataFrame:
    """``kind, raw, sur``: each spelling with its stand-in, laid out."""
    raws = staged(mentions.groupBy("kind", "raw").agg(F.min("gender").alias("gender"))
                  .withColumn("canon", canonical(F.col("kind"), F.col("raw"))), "spellings")
    real = staged(raws.groupBy("kind", "canon").agg(F.min("gender").alias("gender")), "entities")
    cols = [F.col(c) for c in ("kind", "canon", "gender", "attempt")]
    table = staged(real.withColumn("attempt", F.lit(0)).withColumn("sur", stand_in(*cols, key)), "standins")
    taken = real.select("kind", F.col("canon").alias("sur"), F.lit(True).alias("real"))
    while True:
        order = Window.partitionBy("kind", "sur").orderBy("attempt", "canon")
        seen = staged(table.withColumn("rank", F.row_number().over(order)).join(taken, ["kind", "sur"], "left")
                      .withColumn("clash", (F.col("rank") > 1) | F.col("real").isNotNull()), "clashes")
        if seen.where("clash").isEmpty():
            break
        again = seen.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int"))
        table = staged(again.withColumn("sur", F.when(F.col("clash"), stand_in(*cols, key)).otherwise(F.col("sur")))
                       .select("kind", "canon", "gender", "attempt", "sur"), "standins")
    return staged(raws.join(table.select("kind", "canon", "sur"), ["kind", "canon"])
                  .select("kind", "raw", laid_out(F.col("kind"), F.col("raw"), F.col("sur")).alias("sur")), "layout")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_entities`` with every entity replaced, one row per input row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    some = rows.where(has)
    groups = [F.regexp_extract_all("text", F.lit(PATTERN), F.lit(i)) for i in range(3)]
    found = some.select("doc_id", "th", F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(
        groups, ("raw", "male", "female"), strict=True)])).alias("pos", "m"))
    titled = staged(found.select(
        "doc_id", "th", "pos", F.col("m.raw").alias("raw"), kind_of(F.col("m.raw"), F.col("m.male"), F.col("m.female")).alias("kind"),
        F.when(F.col("m.female") != "", "f").when(F.col("m.male") != "", "m").alias("gender")).distinct(), "titled")
    # a document's known names, longest first: they stand for their person without a form of address too
    names = titled.where("kind = 'name'").select("doc_id", "th", F.struct((-F.length("raw")).alias("n"), "raw").alias("name"))
    known = staged(names.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("name")).alias("names")).select(
        F.col("doc_id").alias("id"), F.col("th").alias("t"),
        F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join("names.raw", "|"), F.lit(r")(?![\p{L}\p{N}])")).alias("pattern")), "known")
    of_doc = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("t"))
    named = some.join(known, of_doc)
    again = named.select("doc_id", "th", F.posexplode(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).alias("pos", "raw"))
    # what fits no format is a name
    again = staged(again.distinct().withColumn("kind", kind_of(F.col("raw"), F.lit(""), F.lit(""))), "again")
    others = titled.join(known, of_doc, "left_anti")
    cols = ["doc_id", "th", "pos", "raw", "kind"]
    mentions = others.select(*cols).unionByName(again.select(*cols))
    spelled = titled.select("kind", "raw", "gender").unionByName(again.select("kind", "raw", F.lit(None).cast("string").alias("gender")))
    table = entity_table(spelled, key)
    per_doc = staged(mentions.join(table, ["kind", "raw"]).groupBy("doc_id", "th")
                     .agg(F.sort_array(F.collect_list(F.struct("pos", "sur"))).alias("s"))
                     .select(F.col("doc_id").alias("id"), F.col("th").alias("t"), F.col("s.sur").alias("sur")), "per_doc")
    changed = some.join(per_doc, of_doc).drop("id", "t").join(known, of_doc, "left")
    gaps = F.split("text", F.coalesce("pattern", F.lit(PATTERN)), -1)
    text = F.array_join(F.zip_with(gaps, "sur", lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    changed = changed.select("doc_id", text.alias("text"), F.size("sur").alias("n_entities"))
    return changed.unionByName(rows.where(~has).select("doc_id", "text", F.lit(0).alias("n_entities")))


def op10_surrogates(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir), spark.conf.get(KEY, "no secret: set " + KEY))
