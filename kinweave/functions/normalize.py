"""Names and addresses in a canonical form, as column expressions.

Everything but the folding of non-ASCII text runs in the JVM; folding is an Arrow UDF that sees only rows that need it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values: romanisation by offset within an Indic block -----------------------------------------------------
CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l",
    0x33: "l", 0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x58: "q", 0x59: "kh", 0x5A: "g",
    0x5B: "z", 0x5C: "d", 0x5D: "dh", 0x5E: "f", 0x5F: "y",
}
VOWELS = {
    0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e",
    0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "ri", 0x61: "li",
}
SIGNS = {
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e",
    0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x62: "li", 0x63: "li",
}
MODIFIERS = {0x01: "n", 0x02: "n", 0x03: "h"}
VIRAMA, NUKTA = 0x4D, 0x3C
# --- fixed values: legal words, aliases, addresses ------------------------------------------------------------------
LEGAL = (
    "private pvt pvtltd limited ltd llp llc inc incorporated corp corporation co company plc pc pllc lp ltda gmbh sarl "
    "sas sasu sa eurl sci snc cie ms the and of et du de la le les des"
).split()
LEGAL_FRENCH = "ets etablissements etablissement compagnie societe ei".split()
LEET = ("0134578", "oleastb")
DOTTED = r"\b((?:[a-z]\.){2,}[a-z]?\.?)"
ALIAS = (
    r"\s*(?:\bformerly(?: known as)?:?|\bf/k/a\b|\bfka\b|\ba/k/a\b|\baka\b|\bt/a\b|\bd/b/a\b|\bdba\b|\btrading as\b|"
    r"\bdoing business as\b)\s*"
)
ID_NOISE = r"\(\s*id\s*:?\s*\d+\s*\)|#\s*\d+"
WEB = r"(?:https?://)?(?:www\.)?([a-z0-9-]+)\.(?:com|in|net|org|co\.in|fr|co|biz|info)\b"
ADDRESS_WORDS = {
    "st": "street str saint sainte ste", "rd": "road", "dr": "drive drv", "ave": "avenue av avn avenu", "ln": "lane",
    "ct": "court crt", "pl": "place plc", "blvd": "boulevard bd boul bvd", "cir": "circle", "trl": "trail",
    "pkwy": "parkway", "hwy": "highway", "ter": "terrace terr", "sq": "square", "n": "north", "s": "south", "e": "east",
    "w": "west", "apt": "apartment appt", "fl": "floor flr", "bldg": "building", "no": "number num nº n°", "near": "nr",
    "opp": "opposite", "rue": "r", "chemin": "ch chem", "allee": "all", "imp": "impasse", "quai": "q", "rte": "route",
    "cours": "crs", "sec": "sector", "col": "colony", "hno": "h.no", "po": "p.o",
}
ORDINALS = (
    "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth "
    "fifteenth sixteenth seventeenth eighteenth nineteenth twentieth"
).split()
ADDRESS_DROPPED = "null city pmb unit c o at and of the du de la le les des d l bis ter".split()
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me",
    "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
    "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
    "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}
DEPARTMENTS = {
    "nord": "hauts-de-france", "pas-de-calais": "hauts-de-france", "pas de calais": "hauts-de-france",
    "gironde": "nouvelle-aquitaine", "loire-atlantique": "pays de la loire", "loire atlantique": "pays de la loire",
}
SOUNDS = [("tion", "shn"), ("ph", "f"), ("x", "ks"), ("q", "k"), ("c", "k"), ("w", "v"), ("v", "b"), ("z", "j")]
# --------------------------------------------------------------------------------------------------------------------

NATIVE = "[ऀ-ൿ]"
# marks of the romaniser: a syllable begins, an inherent vowel waits, a vowel is given or refused
_BEGIN, _WAIT, _GIVEN = "\ue000", "\ue001", "\ue002"


def _letters() -> dict[int, str]:
    one: dict[int, str] = {k: _BEGIN for k in range(0x80)}
    one |= {k: _BEGIN + v + _WAIT for k, v in CONSONANTS.items()} | {k: _BEGIN + v for k, v in (VOWELS | MODIFIERS).items()}
    one |= {k: _GIVEN + v for k, v in SIGNS.items()} | {0x66 + d: _BEGIN + str(d) for d in range(10)}
    one |= {VIRAMA: _GIVEN, NUKTA: ""}
    return {block + k: v for block in range(0x0900, 0x0D80, 0x80) for k, v in one.items()}


_LETTERS = _letters()


def romanize(text: str) -> str:
    """Indic letters to Latin. A consonant's inherent vowel is spoken before another Indic letter, not at a word's end."""
    if not re.search(NATIVE, text):
        return text
    marked = text.translate(_LETTERS)
    marked = re.sub(f"{_WAIT}(?={_BEGIN})", "a", marked)
    return re.sub(f"[{_BEGIN}{_WAIT}{_GIVEN}]", "", marked)


def fold_text(text: str) -> str:
    """Compatibility forms, plain apostrophes, Latin letters without accents, lower case; in this order."""
    text = unicodedata.normalize("NFKC", text).replace("’", "'").replace("‘", "'")
    text = unicodedata.normalize("NFKD", romanize(text))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


@F.pandas_udf(StringType())
def _fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


def fold(text: Column) -> Column:
    plain = text.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(plain, F.lower(text)).otherwise(_fold_udf(F.when(~plain, text)))


def words(text: Column) -> Column:
    """Non-empty runs of a-z and 0-9."""
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != "")


def unleet(token: Column) -> Column:
    """Digits that stand for letters, in tokens that have both."""
    mixed = token.rlike("[0-9]") & token.rlike("[a-z]")
    return F.when(mixed, F.translate(token, *LEET)).otherwise(token)


def skeleton(token: Column) -> Column:
    """Consonants as they sound: a key that spellings and transliterations share."""
    out = F.regexp_replace(token, "[^a-z]", "")
    for old, new in SOUNDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, "(?<=[bcdfgjklmnpqrstvxz])h", "")
    out = F.regexp_replace(out, "[aeiou]", "")
    return F.regexp_replace(out, r"(.)\1+", "$1")


def skeleton_of(token: str) -> str:
    """The same of one Python string."""
    out = re.sub("[^a-z]", "", token)
    for old, new in SOUNDS:
        out = out.replace(old, new)
    out = re.sub("(?<=[bcdfgjklmnpqrstvxz])h", "", out)
    return re.sub(r"(.)\1+", r"\1", re.sub("[aeiou]", "", out))


#: Skeletons of legal words, without the French ones: theirs are names too.
LEGAL_SKELETONS = sorted({skeleton_of(w) for w in LEGAL} - {""})



def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normalize_names(df: DataFrame, column: str = "business_name", ascii_only: bool = False) -> DataFrame:
    """Adds name_clean, name_core, name_compact, name_skel, name_alias, name_is_web, name_has_alias, name_native."""
    raw = F.coalesce(F.col(column), F.lit(""))
    s = F.lower(raw) if ascii_only else fold(raw)
    s = F.replace(F.replace(s, F.lit("m/s"), F.lit(" ms ")), F.lit("&"), F.lit(" and "))
    df = df.withColumn("_s", s)
    # dots of a dotted abbreviation go, those elsewhere stay
    df = df.withColumn("_dotted", F.array_distinct(F.regexp_extract_all("_s", F.lit(DOTTED), F.lit(1))))
    df = df.withColumn("_s", F.aggregate("_dotted", F.col("_s"), lambda acc, d: F.replace(acc, d, F.replace(d, F.lit("."), F.lit("")))))
    df = df.withColumn("_s", F.regexp_replace("_s", ID_NOISE, " "))
    df = df.withColumn("_web", F.regexp_extract("_s", WEB, 0)).withColumn("_site", F.regexp_extract("_s", WEB, 1))
    parts = F.split("_s", ALIAS, 2)
    df = df.withColumn("_parts", parts).withColumn("name_has_alias", F.size("_parts") > 1)
    main = F.when(F.col("name_has_alias"), F.element_at("_parts", 2)).otherwise(F.col("_s"))
    main = F.when(F.col("_web") != "", F.replace(main, F.col("_web"), F.col("_site"))).otherwise(main)
    df = df.withColumn("_tokens", F.transform(words(main), unleet))
    core = F.filter("_tokens", lambda t: ~t.isin(LEGAL + LEGAL_FRENCH))
    df = df.withColumn("_core", F.when(F.size(core) > 0, core).otherwise(F.col("_tokens")))
    skels = F.filter(F.transform("_core", skeleton), lambda k: (k != "") & ~k.isin(LEGAL_SKELETONS))
    return df.withColumns(
        {
            "name_clean": _joined(F.col("_tokens")),
            "name_core": _joined(F.col("_core")),
            "name_compact": F.array_join("_core", ""),
            "name_skel": _joined(skels),
            "name_alias": F.when(F.col("name_has_alias"), _joined(words(F.element_at("_parts", 1)))).otherwise(""),
            "name_is_web": (F.col("_web") != "") | F.trim("_s").rlike("^[@#]"),
            "name_native": raw.rlike(NATIVE),
        }
    ).drop("_s", "_dotted", "_web", "_site", "_parts", "_tokens", "_core")


def normalize_addresses(df: DataFrame, column: str = "business_address", ascii_only: bool = False) -> DataFrame:
    """Adds addr_clean, addr_nums, addr_alpha, addr_skel, addr_empty, addr_ncomp."""
    raw = F.coalesce(F.col(column), F.lit(""))
    s = F.lower(raw) if ascii_only else fold(raw)
    s = F.replace(F.replace(s, F.lit("<null>"), F.lit(" ")), F.lit("#"), F.lit(" "))
    s = F.regexp_replace(s, r"\bn\s*°", " ")
    parts = F.filter(F.transform(F.split(s, ","), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: (c != "") & (c != "null"))
    df = df.withColumn("_parts", parts)
    regions = _lookup(STATES | DEPARTMENTS)
    numbers = _lookup({w: str(k) for k, w in enumerate(ORDINALS)})
    canon = _lookup({v: k for k, vs in ADDRESS_WORDS.items() for v in vs.split()})
    ordinal = r"^0*(\d+)(?:st|nd|rd|th|e|er|eme)?$"

    def token(t: Column) -> Column:
        number = F.regexp_extract(t, ordinal, 1)
        word = F.coalesce(F.element_at(canon, t), t)
        kept = F.when(word.isin(ADDRESS_DROPPED), F.lit("")).otherwise(unleet(word))
        return F.when(number != "", number).otherwise(kept)

    regional = F.transform("_parts", lambda c: F.replace(F.coalesce(F.element_at(regions, c), c), F.lit("'"), F.lit("")))
    raw_tokens = F.flatten(F.transform(regional, words))
    named = F.transform(raw_tokens, lambda t: F.coalesce(F.element_at(numbers, t), t))
    df = df.withColumn("_tokens", F.filter(F.transform(named, token), lambda t: t != ""))
    alpha = F.filter("_tokens", lambda t: ~t.rlike("^[0-9]+$"))
    return df.withColumns(
        {
            "addr_clean": _joined(F.col("_tokens")),
            "addr_nums": _joined(F.filter("_tokens", lambda t: t.rlike("^[0-9]+$"))),
            "addr_alpha": _joined(alpha),
            "addr_skel": _joined(F.filter(F.transform(alpha, skeleton), lambda k: k != "")),
            "addr_empty": F.size("_parts") == 0,
            "addr_ncomp": F.size("_parts"),
        }
    ).drop("_parts", "_tokens")


def prepare(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Both normalisers on a source table."""
    return normalize_addresses(normalize_names(df, ascii_only=ascii_only), ascii_only=ascii_only)


# --- fixed values: scripts by block ---
SCRIPTS = "Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam".split()


def script_of(name: Column) -> Column:
    """Script of the first Indic letter; else Latin or other."""
    first = F.regexp_extract(name, NATIVE, 0)
    block = F.floor((F.ascii(first) - 0x0900) / 0x80).cast("int") + 1
    listed = F.element_at(F.array(*[F.lit(s) for s in SCRIPTS]), F.when(first != "", block).otherwise(1))
    return F.when(first != "", listed).when(name.rlike("[A-Za-z]"), "Latin").otherwise("other")


def last_component(address: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.lower(address), ","), F.trim), lambda c: c != "")
    return F.coalesce(F.element_at(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(""))), -1), F.lit(""))


def postcodes(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(address, F.lit(r"\b(\d{5,6})\b"), F.lit(1)))


def bag(address: Column) -> Column:
    """An address as a sorted set of words, for comparing without regard to order."""
    return _joined(F.array_sort(F.array_distinct(words(F.lower(address)))))


def first_number(address: Column) -> Column:
    return F.regexp_extract(address, r"(\d+)", 1)
