"""Expressions that turn a landed record's raw fields into clean columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions.text import let, remove_all, space_tokens, squeeze_space, strip_space

# ------------------------------------------------------------------- HTML


def _lookup(chars: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(chars)), "map<string,string>")


# Names that count without a semicolon, too, longest first.
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_REFERENCE = rf"&(?:#[xX][0-9A-Fa-f]+;?|#[0-9]+;?|[0-9A-Za-z]+;|(?:{'|'.join(_BARE_NAMES)}))"
# Codes 128 to 159 are read as the usual Western code page, as browsers do.
_WESTERN = {
    str(code): char
    for code in range(128, 160)
    if (char := bytes([code]).decode("cp1252", "ignore"))
}


def _entity_char(entity: Column) -> Column:
    """The character a reference such as ``&amp;``, ``&copy`` or ``&#8212;`` stands
    for; NULL if it stands for none."""
    names = _lookup({name.rstrip(";"): char for name, char in html5.items() if name.endswith(";")})
    bare = _lookup({name: html5[name] for name in _BARE_NAMES})
    body = F.regexp_extract(entity, r"^&(?:#[xX]?)?([0-9A-Za-z]+);?$", 1)
    digits = F.when(entity.rlike("^&#[xX]"), F.conv(body, 16, 10)).otherwise(body)
    code = digits.try_cast("int")
    from_code = (
        F.when(code.between(128, 159) & F.map_contains_key(_lookup(_WESTERN), digits), F.try_element_at(_lookup(_WESTERN), digits))
        .when((code == 0) | code.isNull() | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )
    # an unknown name may begin with one that needs no semicolon
    start = F.regexp_extract(entity, f"^&({'|'.join(_BARE_NAMES)})", 1)
    beginning = F.concat(
        F.try_element_at(bare, start), F.substring(entity, F.length(start) + 2, F.length(entity))
    )
    named = F.when(entity.endswith(";"), F.coalesce(F.try_element_at(names, body), beginning))
    return F.when(entity.startswith("&#"), from_code).otherwise(
        F.coalesce(named, F.try_element_at(bare, body))
    )


def unescape_entities(text: Column) -> Column:
    """Replace character references. Those that yield an ampersand go last, so
    that ``&amp;lt;`` ends as ``&lt;`` and is not unescaped twice."""
    def replaced(text: Column) -> Column:
        found = F.transform(
            F.array_distinct(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))),
            lambda e: F.struct(e.alias("entity"), _entity_char(e).alias("char")),
        )
        # Longer references first, so that none is taken for the start of another.
        in_order = F.sort_array(
            F.transform(
                F.filter(found, lambda x: x["char"].isNotNull()),
                lambda x: F.struct(
                    (x["char"] == "&").alias("last"),
                    (-F.length(x["entity"])).alias("length"),
                    x["entity"].alias("entity"),
                    x["char"].alias("char"),
                ),
            )
        )
        done = F.aggregate(in_order, text, lambda done, f: F.replace(done, f["entity"], f["char"]))
        return F.when(F.contains(text, F.lit("&")), done).otherwise(text)

    return let(text, replaced)


def html_to_text(html: Column | str) -> Column:
    """The text a reader sees: no comments, scripts or styles; every tag
    separates the text on its two sides by a space."""
    html = F.col(html) if isinstance(html, str) else html
    visible = remove_all(
        html,
        [
            r"(?is)<!--.*?-->",
            r"(?is)<script[^>]*>.*?</script>",
            r"(?is)<style[^>]*>.*?</style>",
        ],
    )
    return unescape_entities(F.regexp_replace(visible, r"(?s)<[^>]*>", " "))


def clean_text(text: Column | str) -> Column:
    """Squeeze whitespace and delete printed page furniture."""

    # (?U) gives digits, spaces and letter case their Unicode meaning
    furniture = [f"(?{'i' if ignore else ''}U){p}" for p, ignore in fv.BOILERPLATE_PATTERNS]
    body = remove_all(squeeze_space(text), furniture)
    body = F.trim(remove_all(body, [f"(?U){fv.DANGLING_START_PATTERN}"]))
    return F.trim(remove_all(body, [f"(?U){fv.DANGLING_PAIR_PATTERN}"]))


# --------------------------------------------------------------- metadata


def flatten_metadata(value: Column | str, keys: Sequence[str] = fv.METADATA_KEYS) -> Column:
    """One text from a field that may be plain text, a list or an object.

    Lists are unwrapped to their first element however deep they nest; an
    object gives the first of ``keys`` whose value is not empty, and its own
    JSON text if there is none; nothing gives ``'Unknown'``.
    """
    value = F.col(value) if isinstance(value, str) else value
    nothing = ["", "0", "0.0", "false", "[]", "{}"]

    def entry(variant: Column, key: str) -> Column:
        path = f'$["{key}"]'
        text = F.try_variant_get(variant, path, "string")
        is_text = F.schema_of_variant(F.try_variant_get(variant, path, "variant")) == "STRING"
        return F.when(~text.isin(nothing) | (is_text & (text != "")), text)

    def from_object(inner: Column) -> Column:
        return let(
            F.try_parse_json(inner), lambda v: F.coalesce(*[entry(v, k) for k in keys], inner)
        )

    def from_json(json_text: Column) -> Column:
        opening = F.regexp_extract(json_text, r"^[\s\[]+", 0)
        depth = F.length(F.regexp_replace(opening, r"[^\[]", ""))
        path = F.concat(F.lit("$"), F.repeat(F.lit("[0]"), depth))
        inner = F.call_function("get_json_object", json_text, path)
        is_object = json_text.rlike(r"^[\s\[]*\{")
        unwrapped = let(inner, lambda x: F.when(is_object, from_object(x)).otherwise(x))
        is_null = json_text.rlike(r"^[\s\[]*null\s*[,\]]")
        return F.when(F.try_parse_json(json_text).isNull(), json_text).when(~is_null, unwrapped)

    looks_like_json = value.rlike(r"^\s*[\[{]")
    flat = F.when(looks_like_json, let(value, from_json)).otherwise(value)
    return strip_space(F.coalesce(flat, F.lit(fv.UNKNOWN)))


def digits_as_number(identifier: Column | str) -> Column:
    """All digits of an identifier as a number, -1 where there are none."""
    identifier = F.col(identifier) if isinstance(identifier, str) else identifier
    digits = F.regexp_replace(identifier, "[^0-9]", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint"))


def package_date(package_id: Column | str) -> Column:
    """``NAME-yyyy-mm-dd`` as the integer yyyymmdd, 0 where malformed."""
    parts = F.split(package_id, "-")
    joined = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3)))
    return F.coalesce(joined.try_cast("int"), F.lit(0))


def congress_number(package_congress: Column, granule_congress: Column) -> Column:
    """The package's congress unless unknown, else the granule's, else '0'."""
    of_package = F.nullif(flatten_metadata(package_congress), F.lit(fv.UNKNOWN))
    return F.coalesce(of_package, flatten_metadata(F.coalesce(granule_congress, F.lit("0"))))


# ---------------------------------------------------------------- speaker


def member_name(name: Column | str) -> Column:
    """Struct (speaker, lastname, firstname) from a member's listed name."""
    unknown = F.lit(fv.UNKNOWN)

    def parts_of(name: Column) -> Column:
        with_comma = let(F.split(name, ","), lambda p: F.struct(
            F.trim(
                F.concat_ws(" ", strip_space(F.get(p, F.lit(1))), strip_space(F.get(p, F.lit(0))))
            ).alias("speaker"),
            strip_space(F.get(p, F.lit(0))).alias("lastname"),
            strip_space(F.get(p, F.lit(1))).alias("firstname"),
        ))
        without = let(space_tokens(name), lambda w: F.struct(
            name.alias("speaker"),
            F.when(F.size(w) > 1, F.element_at(w, -1)).otherwise(unknown).alias("lastname"),
            F.when(F.size(w) > 1, F.get(w, F.lit(0))).otherwise(unknown).alias("firstname"),
        ))
        return F.when(F.contains(name, F.lit(",")), with_comma).otherwise(without)

    return let(F.col(name) if isinstance(name, str) else name, parts_of)


def opening_name(text: Column | str) -> Column:
    """Struct (speaker, lastname, firstname) from the words a speech opens
    with, e.g. ``Mr. SMITH of Texas.``; unknown where it names nobody."""
    pattern = f"(?U){fv.OPENING_NAME_PATTERN}"
    state = f"(?U){fv.OPENING_STATE_PATTERN}"
    unknown = F.lit(fv.UNKNOWN)

    def named(opening: Column) -> Column:
        title = F.regexp_extract(opening, pattern, 1)
        name = F.regexp_replace(strip_space(F.regexp_extract(opening, pattern, 2)), state, "")
        return let(name, lambda n: F.struct(
            F.when(n != "", F.initcap(F.concat_ws(" ", title, n)))
            .otherwise(F.lit(fv.UNKNOWN_SPEAKER))
            .alias("speaker"),
            F.when(n != "", F.initcap(F.element_at(space_tokens(n), -1)))
            .otherwise(unknown)
            .alias("lastname"),
            unknown.alias("firstname"),
        ))

    return let(F.substring(text, 1, fv.NAME_WINDOW_CHARS), named)
