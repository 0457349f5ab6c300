"""Map Column expressions for run options: JSON parsing, override merge where
the last map wins, and lookup with a default that keeps present nulls.

Options come in two forms. Text options (``parse_options``) are ``map<string,string>``: every value
is its text. Typed options (``parse_typed``) are ``map<string,variant>``: numbers, booleans, nulls, arrays and
nested objects keep their types through merge, lookup and serialisation."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIONS_TYPE = "map<string,string>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_options(json_text) -> Column:
    """JSON object text -> map<string,string> (numbers keep their text). Of a repeated
    key the last value counts (``spark.sql.mapKeyDedupPolicy``, set by the session
    settings); malformed text gives null, which ``malformed`` tells apart."""
    return F.from_json(_c(json_text), OPTIONS_TYPE)


def malformed(json_text) -> Column:
    """True for text that is no JSON object: its options are unknown, not empty."""
    c = _c(json_text)
    return c.isNotNull() & parse_options(c).isNull()


def literal_options(options: dict[str, str | None]) -> Column:
    """A fixed option map, e.g. a config section."""
    if not options:
        return F.create_map().cast(OPTIONS_TYPE)
    parts = []
    for key, value in options.items():
        parts += [F.lit(key), F.lit(value).cast("string")]
    return F.create_map(*parts)


def merge_override(base, override) -> Column:
    """``base.update(override)``: keys of ``override`` win, an overriding null
    is kept. ``map_concat`` alone fails on duplicate keys, so the base is first
    filtered to the keys the override does not have."""
    b, o = _c(base), F.coalesce(_c(override), F.create_map().cast(OPTIONS_TYPE))
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(o, k)), o)


def get_option(options, key: str, default: str | None) -> Column:
    """``d.get(key, default)``: the default only when the key is absent."""
    m = _c(options)
    return F.when(F.map_contains_key(m, F.lit(key)), F.element_at(m, F.lit(key))) \
        .otherwise(F.lit(default).cast("string"))


TYPED = "map<string,variant>"


def parse_typed(json_text) -> Column:
    """JSON object text -> map<string,variant>. Of a repeated key the last value counts; text that is
    malformed or no object gives null (``malformed_typed`` tells it from an absent text)."""
    return F.try_parse_json(_c(json_text)).try_cast(TYPED)


def malformed_typed(json_text) -> Column:
    """True for text that is no JSON object."""
    c = _c(json_text)
    return c.isNotNull() & parse_typed(c).isNull()


def literal_typed(options: dict) -> Column:
    """A fixed option map of any JSON values, e.g. a config section."""
    return parse_typed(F.lit(json.dumps(options)))


def merge_typed(base, override) -> Column:
    """``base.update(override)`` on typed options: an overriding null is kept, a nested object is replaced whole."""
    none = F.lit("{}")
    b, o = F.coalesce(_c(base), parse_typed(none)), F.coalesce(_c(override), parse_typed(none))
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(o, k)), o)


def get_typed(options, key: str, kind: str, default=None, path: str = "$") -> Column:
    """``options.get(key, default)`` as ``kind``: the default only when the key is absent. A JSON null, and a
    value that can't be ``kind``, is null. ``path`` looks inside a nested value, which may lack it: null."""
    m = _c(options)
    value = F.element_at(m, F.lit(key))
    found = F.when(~F.is_variant_null(value), F.try_variant_get(value, path, kind))
    return F.when(F.map_contains_key(m, F.lit(key)), found).otherwise(F.lit(default).cast(kind))


def has_option(options, key: str) -> Column:
    """True where the key is there, with a null value too."""
    return F.coalesce(F.map_contains_key(_c(options), F.lit(key)), F.lit(False))


def typed_json(options) -> Column:
    """Typed options as JSON text."""
    return F.to_json(_c(options))
