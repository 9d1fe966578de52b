"""Cleaning of free text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character that counts as white space.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = f"[{WHITE_SPACE}]+"
# What text with anything to collapse must hold: one range is tested far faster than a list of marks.
UNEVEN_SPACE = "[^ -~]|  "

# Words that mean "no value".
NA_TOKENS = ["n/a", "na", "n / a", "none", "null", "nil", "-", "--"]
LONGEST_NA_TOKEN = max(map(len, NA_TOKENS))

# Province names and their codes.
PROVINCE_CODES = {
    "ALBERTA": "AB", "BRITISH COLUMBIA": "BC", "MANITOBA": "MB",
    "NEW BRUNSWICK": "NB", "NEWFOUNDLAND AND LABRADOR": "NL",
    "NOVA SCOTIA": "NS", "NORTHWEST TERRITORIES": "NT", "NUNAVUT": "NU",
    "ONTARIO": "ON", "PRINCE EDWARD ISLAND": "PE", "QUEBEC": "QC",
    "SASKATCHEWAN": "SK", "YUKON": "YT",
}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    """Both ends freed of any Unicode white space."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def collapse_spaces(value: Column) -> Column:
    """Runs of white space become one space; most text has none to collapse."""
    return F.when(value.rlike(UNEVEN_SPACE), F.regexp_replace(value, SPACE_RUN, " ")).otherwise(value)


def clean_stripped(stripped: Column) -> Column:
    """NULL for stripped text that says nothing. Only short text can be a token."""
    said = (F.length(stripped) > LONGEST_NA_TOKEN) | (
        (stripped != "") & ~F.lower(stripped).isin(NA_TOKENS))
    return F.when(said, stripped)


def clean_string(value: Column) -> Column:
    return clean_stripped(strip(value))


def normalize_name(value: Column) -> Column:
    return collapse_spaces(clean_string(value))


def clean_lower(value: Column) -> Column:
    return clean_string(F.lower(value))


def province_code(stripped: Column) -> Column:
    code = F.upper(stripped)
    known = F.try_element_at(literal_map(PROVINCE_CODES), code)
    return F.when(F.length(code) <= 2, code).otherwise(F.coalesce(known, F.left(code, F.lit(2))))


def normalize_province(value: Column) -> Column:
    return F.when(value != "", province_code(strip(value)))


def normalize_postal_code(value: Column) -> Column:
    packed = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    spaced = F.concat(F.substring(packed, 1, 3), F.lit(" "), F.substring(packed, 4, 3))
    return F.when(F.length(packed) == 6, spaced).otherwise(blank_to_null(F.upper(strip(value))))


def normalize_status(value: Column) -> Column:
    return F.lower(F.coalesce(blank_to_null(value), F.lit("unknown")))


def digits_to_int(value: Column) -> Column:
    stripped = strip(value)
    return F.when(stripped.rlike("^[0-9]+$"), stripped.try_cast("int"))


def digits_only(value: Column) -> Column:
    return blank_to_null(F.regexp_replace(value, "[^0-9]", ""))


def date_of(stripped: Column) -> Column:
    iso = stripped.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$")
    other = F.regexp_replace(
        F.regexp_replace(stripped, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
        r"^(\d{4})/?(\d{1,2})/?(\d{1,2})$", "$1-$2-$3")
    return F.when(iso, stripped.try_cast("date")).when(
        stripped.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$|^\d{4}/\d{1,2}/\d{1,2}$|^\d{8}$"), other.try_cast("date"))


def parse_date(value: Column) -> Column:
    """A date as a database would read it; anything else is NULL."""
    return date_of(strip(value))


# Letters with a mark and the plain letter that stands for each.
_MARKED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿŠšŽž"
_PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyySsZz"


def unaccent(value: Column) -> Column:
    plain = F.translate(value, _MARKED, _PLAIN)
    for ligature, letters in {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss"}.items():
        plain = F.replace(plain, F.lit(ligature), F.lit(letters))
    return plain
