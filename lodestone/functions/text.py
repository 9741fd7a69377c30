"""Scalar functions as Column expressions, all evaluated by Spark itself.

A null argument gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import values as V


def _words(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def identifier_tokens(name: Column, conceptual: bool = False) -> Column:
    """Tokens of an identifier.

    ASCII: split at ACRONYMWord, camelCase and letter/digit borders, in lower case. Other
    names keep their case and split at signs. Over-long names have no tokens. Conceptual
    tokens take aliases and lose an action prefix and a measurement suffix.
    """
    spaced = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Za-z])([0-9])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([0-9])([A-Za-z])", "$1 $2")
    ascii_ = F.regexp_extract_all(F.lower(spaced), F.lit("([a-z0-9]+)"))
    other = F.regexp_extract_all(name, F.lit(r"([\p{L}\p{N}]+)"))
    tokens = F.when(F.length(name) > V.MAX_IDENTIFIER_CHARS, F.array().cast("array<string>")).when(F.octet_length(name) == F.length(name), ascii_).otherwise(other)
    if not conceptual:
        return tokens
    aliased = F.transform(tokens, lambda t: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in V.ALIASES.items() for x in kv]), t), t))

    def without_prefix(t: Column) -> Column:
        return F.when((F.size(t) > 1) & F.array_contains(_words(V.ACTION_PREFIXES), F.try_element_at(t, F.lit(1))), F.slice(t, 2, V.MAX_IDENTIFIER_CHARS)).otherwise(t)

    def without_suffix(t: Column) -> Column:
        return F.when((F.size(t) > 1) & F.array_contains(_words(V.MEASUREMENT_SUFFIXES), F.try_element_at(t, F.lit(-1))), F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t)

    return let(aliased, lambda t: let(without_prefix(t), without_suffix))


def eligible_identifier(tokens: Column) -> Column:
    """Whether tokens are specific enough to match on."""
    number = lambda t: t.rlike("^[0-9]+$")

    def judge(tokens: Column, telling: Column) -> Column:
        plain = F.forall(telling, lambda t: F.octet_length(t) == F.length(t))
        entity = (F.try_element_at(tokens, F.lit(-1)) == "id") & F.exists(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: F.length(t) >= 3)
        first = F.try_element_at(telling, F.lit(1))
        many = F.size(F.filter(telling, lambda t: (F.length(t) >= 3) & ~number(t))) >= 2
        return F.when(F.size(telling) == 0, F.when(F.size(tokens) >= 2, entity).otherwise(False)).when(~plain, F.exists(telling, lambda t: F.length(t) >= 4)).when(F.size(telling) == 1, (F.length(first) >= 6) & ~number(first)).otherwise(many)

    return let(tokens, lambda own: let(F.filter(own, lambda t: ~F.array_contains(_words(V.COMMON_WORDS), t)), lambda telling: judge(own, telling)))


def generic_field(tokens: Column) -> Column:
    """Whether a field's tokens say too little to compare tables by."""
    telling = F.filter(tokens, lambda t: ~F.array_contains(_words(V.GENERIC_FIELD_WORDS), t))
    return F.forall(telling, lambda t: (F.length(t) < 3) | t.rlike("^[0-9]+$"))


def text_tokens(text: Column) -> Column:
    """Tokens of running text, 4096 at most."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    own = F.when(F.octet_length(text) == F.length(text), F.regexp_extract_all(F.lower(spaced), F.lit("([a-z0-9]+)"))).otherwise(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)")))
    return F.slice(own, 1, V.MAX_UNIT_TOKENS)


def word_set(text: Column) -> Column:
    """Distinct words in lower case, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)")))


def snake_identifiers(text: Column) -> Column:
    """Identifiers with underscores inside a text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)\b")))


def quantities(text: Column) -> Column:
    """Numbers with a unit right behind them, as written."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)? ?(?:ms|sec|s|kb|mb|gb|hz|mbps|gbps|%))(?:[^A-Za-z0-9]|$)")))


def one_space(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dehyphenate(text: Column) -> Column:
    """Words that a line break parted, joined."""
    return F.regexp_replace(text, r"(\w)-\s+(\w)", "$1$2")


def bounded(text: Column, most: int = 60) -> Column:
    """At most so many characters, the last three being dots where some are left out."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def framed_id(*parts: Column) -> Column:
    """Identity of a unit (X17): parts framed by their UTF-8 lengths, hashed, 32 hex digits."""
    framed = [F.concat(F.lpad(F.lower(F.hex(F.octet_length(p))), 16, "0"), p) for p in parts]
    return F.substring(F.sha2(F.concat(*framed), 256), 1, 32)


def text_type(text: Column) -> Column:
    """Type of a scalar written as text (X25); blank, none and null are null."""
    t = F.trim(text)
    low = F.lower(t)
    as_time = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, "T", " "), "Z$", "+00:00"))
    return (
        F.when(t.isNull() | (t == "") | low.isin("null", "none"), "null").when(low.isin("true", "false"), "boolean").when(t.rlike(V.INTEGER_RE), "integer")
        .when(t.rlike(V.NUMBER_RE), "number").when(t.rlike(V.DATETIME_RE) & as_time.isNotNull(), "datetime")
        .when(t.rlike(V.DATE_RE) & F.expr("true") & t.try_cast("date").isNotNull(), "date")
        .when(t.rlike(V.TIME_RE) & F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), t)).isNotNull(), "time").otherwise("string")
    )


def decimal_text(number: Column) -> Column:
    """A decimal without exponent or trailing zeros."""
    t = number.cast("string")
    return F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")).otherwise(t)


def doi(text: Column) -> Column:
    """Canonical DOI, or null."""
    bare = F.lower(F.regexp_replace(F.trim(text), r"^(?i)(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/[-._;()/:a-z0-9]+$"), bare)


def path_normalised(path: Column) -> Column:
    """Path without empty, ``.`` and resolvable ``..`` segments."""
    fold = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")), F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.try_element_at(F.concat(F.array(F.lit("")), acc), F.lit(-1)) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == "..") & path.startswith("/"), acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(fold, "/"))


def percent_normalised(path: Column) -> Column:
    """A URL's path with the escapes of unreserved characters undone, other escapes in capitals, and characters that need one escaped."""

    def unescape(p: Column) -> Column:
        code, rest = F.substring(p, 1, 2), F.regexp_replace(p, "(?s)^..", "")
        char = F.char(F.conv(code, 16, 10).cast("int"))
        plain = F.conv(code, 16, 10).cast("int") < 128
        return F.when(~p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), p)).when(plain & char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(code), rest))

    parts = F.split(path, "%")
    decoded = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 100_000), unescape), ""))
    escape = lambda c: F.when(c.rlike("^[A-Za-z0-9/:@!$&'()*+,;=._~%-]$") | (c == ""), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.when(decoded.rlike("^[A-Za-z0-9/:@!$&'()*+,;=._~%-]*$"), decoded).otherwise(F.array_join(F.transform(F.split(decoded, ""), escape), ""))


def canonical_url(url: Column) -> Column:
    """Identity of an http(s) URL, or null.

    Scheme and host in lower case, no default port, no fragment, dot segments resolved,
    the query kept; an address with user information has none.
    """
    part = lambda n: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", n)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = percent_normalised(part(3))
    clean = path_normalised(F.when(path == "", "/").otherwise(path))
    clean = F.when(path.rlike("/(\\.{1,2})?$") & (clean != "/"), F.concat(clean, F.lit("/"))).otherwise(clean)
    return F.when(scheme.isin("http", "https") & (host != "") & ~host.contains("@"), F.concat(scheme, F.lit("://"), host, clean, part(4)))


def url_origin(url: Column) -> Column:
    return F.regexp_extract(canonical_url(url), "^(https?://[^/?]*)", 1)


def salience(level: Column, floor: float = 0.4) -> Column:
    """Weight of a heading of some level."""
    return F.round(F.greatest(F.lit(1.0) - level * 0.1, F.lit(floor)), 6)


def last_segment(path: Column) -> Column:
    """Last telling segment of a schema path."""
    parts = F.filter(F.split(path, r"[/.\[\]]+"), lambda s: ~s.isin("", "*", "$"))
    return F.try_element_at(parts, F.lit(-1))


def prose_cues(text: Column) -> Column:
    """Whether a paragraph looks like a definition, a caveat and a procedure (X9), as a struct of three truth values."""
    start = F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    steps = F.substring(start, 1, 2).isin("1.", "1)", "- ", "* ")
    return F.struct(text.rlike(V.DEFINITION_RE).alias("definition"), text.rlike(f"(?i){V.CAVEAT_RE}").alias("caveat"), steps.alias("procedure"))


def plain_number(text: Column) -> Column:
    """A written decimal without needless signs, zeros or point, so equal numbers are equal texts (X26); null for other texts."""
    bare = F.regexp_replace(text, "^[-+]", "")
    whole = F.regexp_replace(F.regexp_replace(bare, r"\..*$", ""), "^0+", "")
    part = F.regexp_replace(F.regexp_extract(bare, r"\.([0-9]*)$", 1), "0+$", "")
    number = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    return F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.when(text.startswith("-") & (number != "0"), F.concat(F.lit("-"), number)).otherwise(number))
