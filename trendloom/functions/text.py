"""Column functions over ticket text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def clean(value: Column) -> Column:
    """Strip all surrounding whitespace; NULL becomes ''."""
    return F.coalesce(F.btrim(value, F.lit(V.WHITESPACE)), F.lit(""))


def or_default(value: Column, default: str | Column) -> Column:
    """The value, or the default when it is NULL or ''."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def subject_from(description: Column) -> Column:
    """The head of a description, with dots when it was cut."""
    dots = F.when(F.length(description) > V.SUBJECT_CHARS, "...").otherwise("")
    return F.concat(F.substring(description, 1, V.SUBJECT_CHARS), dots)


def filled_subject(subject: Column, description: Column) -> Column:
    return F.when(subject == "", subject_from(description)).otherwise(subject)


def filled_description(subject: Column, description: Column) -> Column:
    """The description, or the (filled) subject when there is none."""
    return F.when(description == "", filled_subject(subject, description)).otherwise(description)


def valid_priority(priority: Column) -> Column:
    """Case-sensitive allow-list; anything else becomes the default."""
    return F.when(priority.isin(*V.PRIORITIES), priority).otherwise(V.DEFAULT_PRIORITY)


def mapped_status(status: Column) -> Column:
    pairs = [F.lit(x) for pair in V.STATUS_MAP.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.lit(V.DEFAULT_STATUS))


def fill_placeholder(description: Column, product: Column) -> Column:
    return F.replace(description, F.lit(V.PLACEHOLDER), product)


def is_template(text: Column) -> Column:
    return text.contains("{") & text.contains("}")


def rich_embed_text(subject: Column, description: Column, ticket_type: Column, product_area: Column) -> Column:
    """The text to embed: only parts that carry information, joined by '. '."""
    s, d, t, p = (clean(c) for c in (subject, description, ticket_type, product_area))
    joined = F.concat_ws(
        ". ",
        F.when(s != "", s),
        F.when((d != "") & ~is_template(d) & (d != s), d),
        F.when(~t.isin(V.DEFAULT_TICKET_TYPE, ""), F.concat(F.lit("Type: "), t)),
        F.when(~p.isin(V.DEFAULT_PRODUCT_AREA, ""), F.concat(F.lit("Product: "), p)),
    )
    return F.when(joined != "", joined).otherwise(d)


def simple_embed_text(subject: Column, description: Column, separator: str = ". ") -> Column:
    return clean(F.concat(clean(subject), F.lit(separator), clean(description)))


def segment(name: Column) -> Column:
    """Dashboard segment of a cluster name: the first matching rule."""
    rules = [(_has_word(name, pattern.split("|")), label) for label, pattern in V.SEGMENTS]  # alternatives of plain letters
    return _first_rule(rules, V.OTHER_SEGMENT)


def segment_order(label: Column) -> Column:
    rules = [(label == name, position) for position, (name, _) in enumerate(V.SEGMENTS)]
    return _first_rule(rules, len(V.SEGMENTS))


def theme(name: Column) -> Column:
    return _by_theme(name, [key for key, _, _ in V.THEMES], V.OTHER_THEME[0])


def theme_summary(name: Column) -> Column:
    """The summary used when no model answers: the first theme with a keyword in the name."""
    return _by_theme(name, [text for _, _, text in V.THEMES], V.OTHER_THEME[1])


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def _by_theme(name: Column, results: list[str], default: str) -> Column:
    hits = [_has_word(name, words) for _, words, _ in V.THEMES]
    return _first_rule(list(zip(hits, results)), default)


def _has_word(name: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    lowered = F.lower(name)
    return reduce(Column.__or__, [lowered.contains(w) for w in words])


def _first_rule(rules, default) -> Column:
    chain = F
    for condition, result in rules:
        chain = chain.when(condition, F.lit(result))
    return chain.otherwise(F.lit(default))
