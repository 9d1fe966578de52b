"""Code tables: statuses, entity types, titles and roles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.text import blank_to_null, literal_map, strip

# Status words of the federal registry.
REGISTRY_STATUSES = {
    "active": "active", "actif": "active",
    "dissolved": "dissolved", "dissoute": "dissolved", "amalgamated": "dissolved",
    "inactive": "inactive",
}

# Status words of the licence portals.
PORTAL_ACTIVE = ["active", "issued", "valid", "open", "registered"]
PORTAL_INACTIVE = ["inactive", "closed", "cancelled", "expired", "suspended"]

# Entity-type codes and their labels.
ENTITY_TYPES = {
    "BC": "BC Company",
    "S": "BC Society",
    "CP": "BC Cooperative",
    "SP": "BC Sole Proprietorship",
    "GP": "BC General Partnership",
    "LP": "BC Limited Partnership",
    "XCP": "Extraprovincial Cooperative",
    "XS": "Extraprovincial Society",
    "A": "Extraprovincial Company",
    "LLC": "Limited Liability Company",
    "XP": "Extraprovincial Limited Partnership",
}

# Officer-title keywords in the order they are tried.
OFFICER_ROLES = {
    "president": "president",
    "director": "other_decision_maker",
    "secretary": "other_decision_maker",
    "treasurer": "other_decision_maker",
    "vice-president": "other_decision_maker",
    "vp": "other_decision_maker",
    "ceo": "president",
    "chief executive officer": "president",
    "managing director": "general_manager",
    "general manager": "general_manager",
    "founder": "founder",
    "owner": "owner",
    "officer": "other_decision_maker",
}

# Title phrases looked for in page text, in order.
PAGE_TITLES = {
    "owner": "owner", "founder": "founder", "co-founder": "founder",
    "president": "president", "general manager": "general_manager",
    "gm": "general_manager", "office manager": "office_manager",
    "operations manager": "operations_manager", "ops manager": "operations_manager",
    "it manager": "it_manager", "it director": "it_director",
    "director of it": "it_director", "procurement": "procurement",
    "purchasing manager": "procurement",
}


def registry_status(value: Column) -> Column:
    word = F.lower(strip(F.coalesce(value, F.lit(""))))
    known = F.try_element_at(literal_map(REGISTRY_STATUSES), word)
    return F.coalesce(known, blank_to_null(word), F.lit("active"))


def portal_status(value: Column) -> Column:
    word = F.lower(value)
    return (
        F.when(word.isNull() | (word == ""), None)
        .when(word.isin(PORTAL_ACTIVE), "active")
        .when(word.isin(PORTAL_INACTIVE), "inactive")
        .when(word == "dissolved", "dissolved")
        .otherwise("unknown")
    )


def entity_label(value: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(ENTITY_TYPES), value), value)


def officer_role(title: Column) -> Column:
    """Role of the first keyword, in table order, that the title contains."""
    word = F.lower(strip(title))
    role = None
    for keyword, name in OFFICER_ROLES.items():
        hit = word.contains(keyword)
        role = F.when(hit, name) if role is None else role.when(hit, name)
    return role.otherwise("other_decision_maker")


def page_title_role(phrase: Column) -> Column:
    return F.try_element_at(literal_map(PAGE_TITLES), phrase)
