"""JSON literals as text, byte-compatible with the delivered events.

Strings escape ``<``, ``>``, ``&`` and the two Unicode line separators; numbers use
plain notation between 1e-6 and 1e21.
"""

from functools import reduce

from pyspark.sql import Column, functions as F

# fixed values: short escapes of control characters
SHORT_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
# fixed values: characters written as \u escapes besides the control characters
HTML_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def _replace_all(text: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once however often ``use`` refers to it.

    Column expressions are trees: naming a long one several times repeats it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


_HTML = "[<>&\u2028\u2029]"
_ESCAPED = "[\\x00-\\x1f\"\\\\<>&\u2028\u2029]"


def html_escape(text: Column) -> Column:
    return F.when(text.rlike(_HTML),
                  _replace_all(text, HTML_ESCAPES.items())).otherwise(text)


def json_quote(text: Column) -> Column:
    """Quoted JSON string. Escaping runs only for the rows whose text needs it."""
    controls = [(chr(i), SHORT_ESCAPES.get(i, f"\\u{i:04x}")) for i in range(32)]
    escaped = _replace_all(text, [("\\", "\\\\"), ('"', '\\"')])
    escaped = F.when(text.rlike("[\\x00-\\x1f]"), _replace_all(escaped, controls)).otherwise(escaped)
    plain = ~text.rlike(_ESCAPED)
    body = F.when(plain, text).otherwise(_replace_all(escaped, HTML_ESCAPES.items()))
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_compact(text: Column) -> Column:
    """Drop whitespace outside of strings."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|\s+', "$1")


def is_json(text: Column) -> Column:
    """Whether ``text`` is exactly one JSON value.

    The parser tolerates text after the first value, so the value is checked inside
    both an array and an object: no trailing text can be valid in both.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    single = F.size(F.try_variant_get(in_array, "$", "array<variant>")) == 1
    return F.coalesce(single & in_object.isNotNull(), F.lit(False))


def json_embed(text: Column) -> Column:
    """Compacted JSON value, or null when ``text`` is not exactly one JSON value."""
    # compacting drops no character that is escaped, so the text itself tells whether there is one
    compact = json_compact(text)
    shown = F.when(text.rlike(_HTML), _replace_all(compact, HTML_ESCAPES.items())).otherwise(compact)
    return F.when(is_json(text), shown)


_JSON_TOKEN = r'"(?:[^"\\]|\\.)*+"|[{}\[\]:,]|[^{}\[\]:,"]++'


def json_member(text: Column, name: str) -> Column:
    """Compacted raw text of one member of a top-level object, null when it is missing.

    Parsing the member as a value would rewrite numbers (``1.50`` -> ``1.5``); walking the
    tokens keeps them. Offsets are folded, the text is cut once.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("pos"), F.lit("").alias("before"), F.lit("").alias("key"),
                     F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, t: Column) -> Column:
        top = s["depth"] == 1
        is_key = top & s["before"].isin("{", ",") & F.startswith(t, F.lit('"'))
        opens = top & (t == ":") & (s["key"] == f'"{name}"')
        closes = top & t.isin(",", "}") & (s["first"] > 0) & (s["last"] == 0)
        return F.struct(
            (s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)).alias("depth"),
            (s["pos"] + F.length(t)).alias("pos"), t.alias("before"),
            F.when(is_key, t).when(t == ",", "").otherwise(s["key"]).alias("key"),
            F.when(opens, s["pos"] + 1).otherwise(s["first"]).alias("first"),
            F.when(opens, 0).when(closes, s["pos"]).otherwise(s["last"]).alias("last"))

    def cut(compact: Column) -> Column:
        tokens = F.regexp_extract_all(compact, F.lit(_JSON_TOKEN), F.lit(0))
        return bind(F.aggregate(tokens, start, step), lambda s: F.when(
            s["last"] > 0, F.substring(compact, s["first"], s["last"] - s["first"])))

    # a text that doesn't hold the key as it is written has no such member
    return F.when(F.contains(text, F.lit(f'"{name}"')), bind(json_compact(text), cut))


def _trim_fraction(text: Column) -> Column:
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def json_float(value: Column) -> Column:
    """Shortest decimal text of a finite double."""
    shown = value.cast("string")
    size = F.abs(value)
    mantissa = _trim_fraction(F.substring_index(shown, "E", 1))
    power = F.substring_index(shown, "E", -1)
    scientific = F.concat(mantissa, F.lit("e"), F.when(F.startswith(power, F.lit("-")), power)
                          .otherwise(F.concat(F.lit("+"), power)))
    return (F.when(F.instr(shown, "E") == 0, _trim_fraction(shown))
            .when((size < 1e-6) | (size >= 1e21), scientific)
            .when(size < 1, _trim_fraction(shown.try_cast("decimal(38,25)").cast("string")))
            .otherwise(_trim_fraction(shown.try_cast("decimal(38,17)").cast("string"))))


def json_object(data: Column) -> Column:
    """Object text of a map whose values are JSON literals, keys in byte order."""
    # no comparison by lambda; keys differ, so values are never compared
    entries = F.sort_array(F.map_entries(data))
    quote = F.lit('"')
    plain = ~F.array_join(F.map_keys(data), "").rlike(_ESCAPED)
    # one test for all keys of a map; each is escaped only where one needs it
    simple = F.transform(entries, lambda e: F.concat(quote, e["key"], quote, F.lit(":"), e["value"]))
    full = F.transform(entries, lambda e: F.concat(json_quote(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(F.when(plain, simple).otherwise(full), ","), F.lit("}"))


def json_object_bytes(data: Column) -> Column:
    """Length of ``json_object`` in UTF-8, without building it. Characters are escaped one by one, so all keys are at once."""
    values = F.map_values(data)
    joined = F.array_join(values, "")
    # with a text for nulls the join is longer: members without a value are left out, which the text itself tells best
    whole = F.octet_length(F.array_join(values, "", "~")) == F.octet_length(joined)
    n = F.size(data)
    names = F.octet_length(json_quote(F.array_join(F.map_keys(data), ""))) - 2
    # quotes and a colon by member, commas between them, braces around
    size = names + F.octet_length(joined) + n * 3 + F.greatest(n - 1, F.lit(0)) + 2
    return F.when(whole, size).otherwise(F.octet_length(json_object(data)))
