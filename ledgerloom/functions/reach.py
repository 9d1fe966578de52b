"""Phones, e-mails, hosts and domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ledgerloom.functions.text import blank_to_null, clean_string, strip

# The patterns that find an e-mail and a phone in page text.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(\+?1[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}"

# The North American plan as a rule: area code without x11, N9x, 37x and 96x,
# exchange from 200 up.
AREA_CODE_RULE = r"(?!37|96|[2-9]11)[2-9][0-8]\d"
SUBSCRIBER_RULE = r"[2-9]\d{6}"
# Seven-digit numbers that hold across the country.
SHARED_COST = r"310\d{4}"
EXTENSION = r"(?i)[\s,;]*(?:;ext=|extension|extn|ext|x|#|~|int)[\s:.]*\d{1,9}#?\s*$"

# Public suffixes of more than one label (registry-run ones).
TWO_LABEL_SUFFIXES = [
    "ab.ca", "bc.ca", "mb.ca", "nb.ca", "nf.ca", "nl.ca", "ns.ca", "nt.ca",
    "nu.ca", "on.ca", "pe.ca", "qc.ca", "sk.ca", "yk.ca", "gc.ca",
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk",
    "com.au", "edu.au", "gov.au", "net.au", "org.au",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "ac.in", "co.in", "gov.in", "net.in", "org.in",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "ac.kr", "co.kr", "go.kr", "or.kr",
    "ac.za", "co.za", "gov.za", "org.za",
    "com.br", "gov.br", "net.br", "org.br",
    "com.cn", "gov.cn", "net.cn", "org.cn",
    "com.hk", "org.hk", "com.mx", "gob.mx", "org.mx",
    "com.sg", "com.tr", "com.tw", "com.ar", "com.co", "com.pe", "com.ph",
    "com.my", "com.ua", "com.vn", "co.il", "co.id", "co.th",
]
# Labels under which country registries sell names. Below any
# two-letter top-level name they count as a suffix, listed above or not: a
# suffix taken for a domain would make one company of a whole country.
REGISTRY_LABELS = ["ac", "co", "com", "edu", "go", "gob", "gov", "govt", "mil", "ne", "net", "nom", "or", "org"]
# Names below which every label is a public suffix, and the names
# below them that are ordinary ones all the same.
WILDCARD_SUFFIXES = [
    "bd", "ck", "er", "fk", "jm", "kh", "mm", "np", "pg",
    "kawasaki.jp", "kitakyushu.jp", "kobe.jp", "nagoya.jp", "sapporo.jp", "sendai.jp", "yokohama.jp",
]
EXCEPTED_NAMES = [
    "www.ck",
    "city.kawasaki.jp", "city.kitakyushu.jp", "city.kobe.jp", "city.nagoya.jp", "city.sapporo.jp",
    "city.sendai.jp", "city.yokohama.jp",
]
# Top-level names that are a suffix even when they stand alone.
SINGLE_LABEL_SUFFIXES = ["ca", "com", "org", "net", "info", "biz", "io", "co", "us", "uk", "fr", "de", "eu"]


def plain_number(value: Column) -> Column:
    """The number with its usual punctuation taken out."""
    return F.translate(value, " ()-./\t", "")


def normalize_phone(value: Column, area_codes: Sequence[str] | None = None, plain: Column | None = None) -> Column:
    """``+1…`` for a valid North American number, else NULL.

    ``area_codes`` narrows the numbering rule to a list of assigned codes.
    ``plain`` is ``plain_number(value)`` when the caller has it as a column.
    Ordinary numbers are settled by it alone; labels, extensions and letters
    take the longer way.
    """
    plain = plain_number(value) if plain is None else plain
    area = AREA_CODE_RULE if area_codes is None else "(?:" + "|".join(area_codes) + ")"
    number = rf"({area}{SUBSCRIBER_RULE}|{SHARED_COST})$"
    ordinary = plain.rlike(r"^(?:\+?1)?" + number)

    dialled = F.regexp_extract(value, r"(?s)[+\d(].*", 0)
    packed = F.upper(F.regexp_replace(F.regexp_replace(dialled, EXTENSION, ""), r"[^0-9+A-Za-z]", ""))
    # Letters stand for their keys when there are enough of them to be a word.
    keyed = F.when(
        packed.rlike("(?:[^A-Z]*[A-Z]){3}"),
        F.translate(packed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999"),
    ).otherwise(F.regexp_replace(packed, "[A-Z]", ""))
    other = F.regexp_extract(keyed, r"^(?:\+?1|0111)?" + number, 1)
    short = F.length(plain) < 10
    return (
        F.when(ordinary & short, F.concat(F.lit("+1"), F.right(plain, F.lit(7))))
        .when(ordinary, F.concat(F.lit("+1"), F.right(plain, F.lit(10))))
        .when(value.rlike(r"^[\d\s()\-./]*$"), F.when(plain.startswith("0111"), _prefixed(other)))
        .otherwise(_prefixed(other))
    )


def _prefixed(national: Column) -> Column:
    return F.concat(F.lit("+1"), blank_to_null(national))


def host_of(site: Column) -> Column:
    """Host of a lower-case, stripped address with or without a scheme."""
    host = F.regexp_extract(
        site, r"^(?:(?:[a-z][a-z0-9+.\-]*:)?//)?(?:[^/?#\\]*@)?\.*([^/?#\\:]*)", 1)
    return blank_to_null(F.rtrim(host, F.lit(".")))


def url_host(website: Column) -> Column:
    return host_of(strip(F.lower(website)))


def domain_of_host(host: Column, suffixes: Sequence[str] = tuple(TWO_LABEL_SUFFIXES)) -> Column:
    """Registrable domain: the label before the longest public suffix, and it.

    Any alphabetic top-level name counts as a suffix, and so do registry labels
    below a country. The longest rule wins: an excepted name is a domain though
    a wildcard makes its like suffixes. A host that is itself a suffix has no
    domain.
    """
    tail = F.substring_index(host, ".", -2)
    wild = {size: [w for w in WILDCARD_SUFFIXES if w.count(".") == size - 1] for size in (1, 2)}

    def below(size: int) -> Column:
        """Whether the host lies below a wildcard of so many labels; the suffix is one label longer."""
        known = F.substring_index(host, ".", -size)
        return known.isin(wild[size]) & (known != host)

    def beyond(size: int) -> Column:
        suffix, domain = F.substring_index(host, ".", -size - 1), F.substring_index(host, ".", -size - 2)
        return F.when(suffix != host, domain)
    registry = tail.rlike(rf"^(?:{'|'.join(REGISTRY_LABELS)})\.[a-z]{{2}}$")
    return (
        F.when(~F.contains(host, F.lit(".")), F.when(~host.isin(SINGLE_LABEL_SUFFIXES), host))
        .when(F.substring_index(host, ".", -3).isin(EXCEPTED_NAMES), F.substring_index(host, ".", -3))
        .when(tail.isin(EXCEPTED_NAMES), tail)
        .when(below(2), beyond(2))
        .when(below(1), beyond(1))
        .when(tail.isin(list(suffixes)) | registry, F.when(host != tail, F.substring_index(host, ".", -3)))
        .when(host.rlike(r"\.(?:[a-z]{2,}|xn--[a-z0-9\-]+)$"), tail)
        .when(host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), host)
        .otherwise(F.substring_index(host, ".", -1))
    )


def normalize_domain(website: Column, suffixes: Sequence[str] = tuple(TWO_LABEL_SUFFIXES)) -> Column:
    return domain_of_host(url_host(clean_string(website)), suffixes)


def first_email(text: Column) -> Column:
    return F.lower(blank_to_null(F.regexp_extract(text, EMAIL_PATTERN, 0)))


def first_phone(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, PHONE_PATTERN, 0))
