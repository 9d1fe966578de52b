"""Business listings in landed directory pages.

A page is cut at the opening tags of its listings; every value is then the first
match inside its piece. Real documents nest, so text that follows the last
listing belongs to its piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import blank_to_null, collapse_spaces, strip
from ledgerloom.schemas import CONFIDENCE
from ledgerloom.sources.files import raw_records

# Class names of the parts of a listing.
LISTING_CLASSES = ["listing__content__wrapper", "listing"]
NAME_CLASS, PHONE_CLASS = "listing__name--link", "mlr__item__cta"
ADDRESS_CLASS, WEBSITE_CLASS = "listing__address--full", "mlr__submenu__item"

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def _with_class(tags: str, name: str) -> str:
    """Pattern of an opening tag that has exactly this class among its classes."""
    return rf"""(?is)<({tags})\b(?=[^>]*?\sclass\s*=\s*["'](?:[^"'>]*\s)?{name}(?:\s[^"'>]*)?["'])[^>]*>"""


def _class_part(tags: str, part: str) -> str:
    """Pattern of an opening tag one of whose classes contains ``part``."""
    return rf"""(?is)<({tags})\b(?=[^>]*?\sclass\s*=\s*["'][^"'>]*{part}[^"'>]*["'])[^>]*>"""


def _inner(html: Column, opening: str) -> Column:
    """Markup between the first such tag and its own closing tag; NULL if absent.

    Tags of the same name in between are counted, so an element that holds
    others like it is not cut at the first of their closing tags. An element
    that is never closed is empty.
    """
    tag = F.lower(F.regexp_extract(html, opening, 1))
    rest = F.regexp_extract(html, rf"{opening}(.*)", 2)
    pieces = F.regexp_extract_all(rest, F.lit(r"(?s)(<[^>]*>|[^<]+|<)"), F.lit(1))

    def step(state: Column, piece: Column) -> Column:
        same = F.lower(F.regexp_extract(piece, r"^</?([a-zA-Z0-9]+)", 1)) == tag
        depth = F.when(state["depth"] == 0, 0).when(same & piece.startswith("</"), state["depth"] - 1).when(
            same & piece.startswith("<") & ~piece.endswith("/>"), state["depth"] + 1).otherwise(state["depth"])
        return F.struct(depth.alias("depth"), (state["held"] + F.when(depth > 0, 1).otherwise(0)).alias("held"))

    walked = F.aggregate(pieces, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("held")), step)
    inside = F.when(walked["depth"] == 0, F.array_join(F.slice(pieces, F.lit(1), walked["held"]), "")).otherwise("")
    return F.when(html.rlike(opening), inside)


def _attribute(html: Column, opening: str, name: str) -> Column:
    tag = F.regexp_extract(html, opening, 0)
    return _unescape(blank_to_null(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)))


def _unescape(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _joined_text(markup: Column) -> Column:
    """Text of an element, each piece of text stripped, pieces put together."""
    pieces = F.transform(F.split(markup, r"(?s)<[^>]*>"), lambda p: strip(_unescape(p)))
    return F.array_join(pieces, "")


def _flat_text(markup: Column) -> Column:
    return strip(collapse_spaces(_unescape(F.regexp_replace(markup, r"(?s)<[^>]*>", ""))))


def listing_records(pages: DataFrame, source_name: str = "yellowpages_ca") -> DataFrame:
    """RAW records from (html, query, city, province, url)."""
    html = F.col("html")
    first, second = (_with_class("div", name) for name in LISTING_CLASSES)
    cut = F.when(html.rlike(first), F.split(html, first)).otherwise(F.split(html, second))
    pieces = F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))
    piece = F.col("piece")
    name = F.coalesce(_inner(piece, _with_class("a", NAME_CLASS)), _inner(piece, _class_part("h2|h3|a", "name")))
    phone = F.coalesce(
        _attribute(piece, _with_class("a", PHONE_CLASS), "data-phone"),
        _joined_text(_inner(piece, _class_part("div|span|a", "phone"))))
    address = F.coalesce(
        _inner(piece, _with_class("div", ADDRESS_CLASS)), _inner(piece, _class_part("span|div", "address")))
    href = _attribute(piece, _with_class("a", WEBSITE_CLASS), "href")
    listed = (
        pages.select("query", "city", "province", "url", F.explode(pieces).alias("piece"))
        .select(
            "query", "city", "province", "url", blank_to_null(_joined_text(name)).alias("name"),
            phone.alias("phone"), _flat_text(address).alias("address"),
            F.when(href.startswith("http"), href).alias("website"))
        .where(F.col("name").isNotNull())
    )
    return raw_records(
        listed,
        legal_name=F.col("name"), operating_name=F.col("name"),
        province=F.col("province"), city=F.col("city"), address_line1=F.col("address"),
        phone=F.col("phone"), website=F.col("website"), industry=F.col("query"),
        source_name=F.lit(source_name), source_kind=F.lit("business_directory"),
        source_url=F.col("url"), confidence=F.lit("0.60").cast(CONFIDENCE),
    )
