"""Text values of the source database as JSON literals, chosen by type OID.

Every function is a Column expression. A null result means the text is not valid for
the type; SQL NULL never reaches them.
"""

from pyspark.sql import Column, functions as F

from .jsontext import bind, json_embed, json_float, json_quote

# fixed values: type OIDs of the source catalogue
BOOL, BYTEA, INT8, INT2, INT4, TEXT = 16, 17, 20, 21, 23, 25
JSON, FLOAT4, FLOAT8, TIMESTAMP, TIMESTAMPTZ, INTERVAL, NUMERIC, UUID, JSONB = \
    114, 700, 701, 1114, 1184, 1186, 1700, 2950, 3802
BPCHAR, VARCHAR, DATE = 1042, 1043, 1082
# fixed values: array OID -> element OID
ARRAY_ELEMENT = {1000: BOOL, 1005: INT2, 1007: INT4, 1009: TEXT, 1014: BPCHAR, 1015: VARCHAR,
                 1016: INT8, 1021: FLOAT4, 1022: FLOAT8, 1231: NUMERIC, 2951: UUID}
# fixed value: largest accepted byte string
MAX_BYTEA = 64 * 1024 * 1024

_TS = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d+))?"
_ZONE = r"(Z|[+-]\d{2}(?::\d{2})?| UTC| \+0000)$"


def _number(text: Column, kind: str) -> Column:
    # an empty match must be null before the cast: a failing cast raises inside, per value
    return F.nullif(text, F.lit("")).try_cast(kind)


def pg_int(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint").cast("string"))


# What ``bind`` holds is interpreted, so each of the long conversions below has a compiled branch in front for the
# texts that a source mostly sends. Texts a branch does not match exactly take the general way.

# at most 15 digits, from 1e-6 on: such a text is the shortest one of its double
_SHORT_FLOAT = r"^(?:0|[1-9]\d{0,8})(?:\.\d{0,5}[1-9])?\z"


def pg_float(text: Column) -> Column:
    """NaN and infinities have no JSON form and are invalid here."""
    value = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(text.rlike(_SHORT_FLOAT), text).otherwise(
        bind(value, lambda v: F.when(F.abs(v) < float("inf"), json_float(v))))


def pg_bool(text: Column) -> Column:
    return F.when(text.isin("t", "true"), "true").when(text.isin("f", "false"), "false")


def _instant(text: Column, pattern: str, shift: Column | None) -> Column:
    # The fraction is copied as text: nine digits would not fit a microsecond timestamp.
    wall = F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    value = F.when(text.rlike(pattern), wall.try_cast("timestamp_ntz"))
    if shift is not None:
        value = value - shift
    fraction = F.rtrim(F.substring(F.regexp_extract(text, pattern, 3), 1, 9), F.lit("0"))
    return F.concat(F.replace(value.cast("string"), F.lit(" "), F.lit("T")),
                    F.regexp_replace(fraction, "^(?=.)", "."), F.lit("Z"))


def pg_timestamp_iso(text: Column) -> Column:
    return _instant(text, _TS + "$", None)


def pg_timestamptz_iso(text: Column) -> Column:
    def offset(zone: Column) -> Column:
        named = ~zone.rlike(r"^[+-]")
        hours = F.when(named, 0).otherwise(F.substring(zone, 2, 2).try_cast("int"))
        minutes = F.when(named | (F.length(zone) < 6), 0).otherwise(F.substring(zone, 5, 2).try_cast("int"))
        sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
        return F.make_dt_interval(F.lit(0), hours * sign, minutes * sign)

    return _instant(text, _TS + _ZONE, bind(F.regexp_extract(text, _TS + _ZONE, 4), offset))


# one optional date unit each, then an optional clock
_UNITS = {"Y": r"(?:^|\s)([+-]?\d+)\s*years?", "M": r"(?:^|\s)([+-]?\d+)\s*mons?",
          "D": r"(?:^|\s)([+-]?\d+)\s*days?"}
_CLOCK = r"^(-?)([+-]?\d+):([+-]?\d+):([+-]?(?:\d+\.?\d*|\.\d+))$"


def _part(value: Column, letter: str) -> Column:
    return bind(value, lambda v: F.when(v != 0, F.concat(v.cast("string"), F.lit(letter))).otherwise(""))


def _seconds(value: Column) -> Column:
    # below 1e-4 the exponent has two digits, e.g. 5e-05
    tiny = F.concat(F.regexp_replace(F.substring_index(value.cast("string"), "E", 1), r"\.0$", ""),
                    F.lit("e-"), F.lpad(F.substring_index(value.cast("string"), "E-", -1), 2, "0"))
    shown = F.when(F.abs(value) < 1e-4, tiny).otherwise(json_float(value))
    return F.when(value != 0, F.concat(shown, F.lit("S"))).otherwise("")


def _clock_iso(rest: Column) -> Column:
    sign = F.when(F.regexp_extract(rest, _CLOCK, 1) == "-", -1).otherwise(1)
    clock = F.concat(_part(_number(F.regexp_extract(rest, _CLOCK, 2), "bigint") * sign, "H"),
                     _part(_number(F.regexp_extract(rest, _CLOCK, 3), "bigint") * sign, "M"),
                     bind(_number(F.regexp_extract(rest, _CLOCK, 4), "double") * sign, _seconds))
    return F.when(rest == "", "").otherwise(
        bind(clock, lambda c: F.when(c == "", "").otherwise(F.concat(F.lit("T"), c))))


_DAYS_AND_CLOCK = r"^(?:[1-9]\d{0,8} days? )?\d{2}:\d{2}:\d{2}\z"


def _days_and_clock_iso(text: Column) -> Column:
    part = lambda at, letter: F.when(F.substring(text, at, 2) == "00", "").otherwise(
        F.concat(F.substring(text, at, 2).cast("int").cast("string"), F.lit(letter)))
    days = F.when(F.length(text) > 8, F.concat(F.substring_index(text, " ", 1), F.lit("D"))).otherwise("")
    clock = F.when(F.endswith(text, F.lit("00:00:00")), "").otherwise(
        F.concat(F.lit("T"), part(-8, "H"), part(-5, "M"), part(-2, "S")))
    return F.when(text == "00:00:00", "PT0S").otherwise(F.concat(F.lit("P"), days, clock))


def pg_interval_iso(text: Column) -> Column:
    """ISO-8601 duration; text that cannot be read is passed on unchanged."""
    def convert(s: Column) -> Column:
        rest, dates = s, []
        for letter, pattern in _UNITS.items():
            dates.append(_part(F.coalesce(_number(F.regexp_extract(s, pattern, 1), "int"), F.lit(0)), letter))
            rest = F.regexp_replace(rest, pattern, " ")
        # null when what remains is neither empty nor a clock
        clock = bind(F.trim(rest), lambda r: F.when((r == "") | r.rlike(_CLOCK), _clock_iso(r)))
        iso = F.concat(F.lit("P"), *dates, clock)
        done = bind(iso, lambda i: F.when(i == "P", "PT0S").otherwise(i))
        return (F.when(s == "", "PT0S").when(F.startswith(s, F.lit("P")), s)
                .otherwise(F.coalesce(done, s)))

    return F.when(text.rlike(_DAYS_AND_CLOCK), _days_and_clock_iso(text)).otherwise(bind(F.trim(text), convert))


def pg_bytea_b64(text: Column) -> Column:
    ok = text.rlike(r"^\\x([0-9a-fA-F]{2})*+$") & (F.length(text) - 2 <= 2 * MAX_BYTEA)
    return F.when(ok, F.base64(F.unhex(F.substring(text, 3, 2 * MAX_BYTEA))))


def _scalar(oid: Column, text: Column) -> Column:
    return (F.when(oid.isin(INT2, INT4), pg_int(text))
            .when(oid.isin(FLOAT4, FLOAT8), pg_float(text))
            .when(oid == BOOL, pg_bool(text))
            .otherwise(json_quote(text)))


_TOKEN = r' *"(?:[^"\\]|\\.)*+" *,?|[^,]*+,|[^,]++'


def _element(raw: Column, element_oid: Column) -> Column:
    def unquote(t: Column) -> Column:
        inside = F.substring(t, F.lit(2), F.length(t) - 2)
        return F.when(F.startswith(t, F.lit('"')), F.regexp_replace(inside, r"(?s)\\(.)", "$1")).otherwise(t)

    text = F.trim(F.regexp_replace(F.trim(raw), r" *,$", ""))
    return bind(bind(text, unquote),
                lambda v: F.when(F.upper(v) == "NULL", "null").otherwise(_scalar(element_oid, v)))


# arrays of integers, and of texts in printable ASCII that need no escapes
_INTEGERS = r"^\{(?:0|-?[1-9]\d{0,17})(?:,(?:0|-?[1-9]\d{0,17}))*+\}\z"
_PLAIN = r"""(?:"[ !#-%'-;=?-\[\]-~]++"|[!#-%'-+\--;=?-\[\]-z|~]++)"""
_TEXTS = r"^\{" + _PLAIN + "(?:," + _PLAIN + r")*+\}\z"


def _array_json_of(oid: int, text: Column) -> Column:
    """``pg_array_json`` for an element type known when the plan is made."""
    slow, inner = pg_array_json(text, F.lit(oid)), F.substring(text, F.lit(2), F.length(text) - 2)
    if oid in (INT2, INT4):
        return F.when(text.rlike(_INTEGERS), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(slow)
    if oid in (FLOAT4, FLOAT8, BOOL):
        return slow
    quoted = F.regexp_replace(inner, r'"([^"]+)"|([^",]+)', '"$1$2"')
    return F.when(text.rlike(_TEXTS), F.concat(F.lit("["), F.regexp_replace(quoted, '(?i)"null"', "null"), F.lit("]"))).otherwise(slow)


def pg_array_json(text: Column, element_oid: Column) -> Column:
    """JSON array of a one-dimensional array literal.

    Text that is no array literal, or nests another array, stays a plain string. An
    element spelled NULL in any case becomes null, quoted or not.
    """
    def members(inner: Column) -> Column:
        tokens = F.filter(F.regexp_extract_all(inner, F.lit(_TOKEN), F.lit(0)), lambda t: F.trim(t) != "")
        parts = F.transform(tokens, lambda t: _element(t, element_oid))
        return bind(parts, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.concat(
            F.lit("["), F.array_join(p, ","), F.lit("]"))))

    def convert(s: Column) -> Column:
        flat = (F.length(s) >= 2) & F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}")) & ~s.rlike(r"^\{\s*\{")
        return F.when(~flat, json_quote(s)).otherwise(
            bind(F.substring(s, F.lit(2), F.length(s) - 2), members))

    return bind(F.trim(text), convert)


def json_literal(oid: Column, text: Column) -> Column:
    """JSON literal of one non-null value, or null when the text is invalid for the type."""
    element_oid = F.element_at(
        F.create_map(*[F.lit(x) for pair in ARRAY_ELEMENT.items() for x in pair]), oid)
    as_text = (F.when(oid == TIMESTAMP, pg_timestamp_iso(text))
               .when(oid == TIMESTAMPTZ, pg_timestamptz_iso(text))
               .when(oid == INTERVAL, pg_interval_iso(text))
               .when(oid == BYTEA, pg_bytea_b64(text))
               .otherwise(text))
    return (F.when(oid.isin(INT2, INT4), pg_int(text))
            .when(oid.isin(FLOAT4, FLOAT8), pg_float(text))
            .when(oid == BOOL, pg_bool(text))
            .when(oid.isin(JSON, JSONB), json_embed(text))
            .when(oid.isin(*ARRAY_ELEMENT), pg_array_json(text, element_oid))
            .otherwise(bind(as_text, json_quote)))


def json_literal_of(oid: int, text: Column) -> Column:
    """``json_literal`` for a type known when the plan is made: only that type's expression."""
    quoted = lambda iso: F.concat(F.lit('"'), iso, F.lit('"'))  # noqa: E731  text that needs no escapes
    if oid in (INT2, INT4):
        return pg_int(text)
    if oid in (FLOAT4, FLOAT8):
        return pg_float(text)
    if oid == BOOL:
        return pg_bool(text)
    if oid in (JSON, JSONB):
        return json_embed(text)
    if oid in ARRAY_ELEMENT:
        return _array_json_of(ARRAY_ELEMENT[oid], text)
    if oid == TIMESTAMP:
        return quoted(pg_timestamp_iso(text))
    if oid == TIMESTAMPTZ:
        return quoted(pg_timestamptz_iso(text))
    if oid == BYTEA:
        return quoted(pg_bytea_b64(text))
    if oid == INTERVAL:
        return F.when(text.rlike(_DAYS_AND_CLOCK), quoted(_days_and_clock_iso(text))).otherwise(
            bind(pg_interval_iso(text), json_quote))
    return json_quote(text)
