"""Text expressions that agree with Python's string methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters `str.strip` removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The line breaks `str.splitlines` knows.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Non-ASCII letters that a case-insensitive regex treats as i and s, but `lower`
# leaves alone (the Kelvin sign is lowered to k).
FOLD_FROM, FOLD_TO = "\u0131\u0130\u017f", "iis"


def let(value: Column, body) -> Column:
    """`body(x)` with `x` bound once to `value`.

    A lambda variable cannot be inlined, so `value` is computed once however often `body` uses it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def sql_text(value: str) -> str:
    """A string literal of Spark SQL. `${` is spelled so that it is not taken for a variable."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("${", "$\\u007B")
    return "'" + escaped.replace("\n", "\\n").replace("\r", "\\r") + "'"


def let_sql(value: str, name: str, body: str) -> str:
    """SQL form of `let`: `body` may use `name` for the value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def fold_sql(text: str) -> str:
    """SQL form of `fold`."""
    odd = " OR ".join(f"contains({text}, '{letter}')" for letter in FOLD_FROM)
    return (
        f"CASE WHEN {odd} THEN lower(translate({text}, '{FOLD_FROM}', '{FOLD_TO}')) "
        f"ELSE lower({text}) END"
    )


def strip_sql(text: str) -> str:
    """SQL form of `strip`."""
    return f"btrim({text}, {sql_text(STRIP_CHARS)})"


def contains_any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_text(word)})" for word in words) + ")"


def fold(text: Column) -> Column:
    """Case-folded text: an ASCII word is in it exactly when a case-insensitive regex finds it."""
    odd = F.lit(False)
    for letter in FOLD_FROM:
        odd = odd | F.contains(text, F.lit(letter))
    return F.when(odd, F.lower(F.translate(text, FOLD_FROM, FOLD_TO))).otherwise(F.lower(text))


def strip(text: Column) -> Column:
    """`str.strip`, in linear time on any run of spaces."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def split_lines(text: str) -> Column:
    """`str.splitlines` of a column: every Unicode line break, no empty line after the last."""
    return F.expr(split_lines_sql(text))


def split_lines_sql(text: str) -> str:
    parts = f"split({text}, {sql_text(LINE_BREAKS)})"
    return let_sql(
        parts,
        "_parts",
        "CASE WHEN element_at(_parts, -1) = '' THEN slice(_parts, 1, size(_parts) - 1) "
        "ELSE _parts END",
    )


def split_newlines_sql(text: str) -> str:
    return f"split({text}, {sql_text(chr(10))})"


def decode_utf8(content: Column) -> Column:
    """Bytes to text, leaving out what is not UTF-8.

    A U+FFFD that the bytes spell themselves stays. It is written as two private-use characters while
    the marks of broken bytes are taken out; the first of them, where the bytes hold it, is doubled.
    """
    text = content.cast("string")
    doubled = F.replace(text, F.lit("\ue000"), F.lit("\ue000\ue000"))
    kept = F.replace(doubled, F.lit("\ufffd"), F.lit("\ue000\ue001"))
    valid = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    return F.when(
        F.contains(text, F.lit("\ufffd")) | F.contains(text, F.lit("\ue000")),
        F.regexp_replace(F.regexp_replace(valid, "(?<!\ue000)((?:\ue000\ue000)*)\ue000\ue001", "$1\ufffd"), "\ue000\ue000", "\ue000"),
    ).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def percent_encode(text: Column) -> Column:
    """`urllib.parse.quote`: space is %20; `/` and `~` stay as they are."""
    form = F.url_encode(text)
    for was, now in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        form = F.replace(form, F.lit(was), F.lit(now))
    return form


# Characters escaped in a reflected payload, in this order; `&` is not one of them.
PAYLOAD_ESCAPES = (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape_payload(text: Column) -> Column:
    """HTML escape of a payload as a reflecting page would write it."""
    for raw, escaped in PAYLOAD_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def escape_html(text: Column) -> Column:
    """HTML escape for our own reports: `&` first, then the payload escapes."""
    return escape_payload(F.replace(text, F.lit("&"), F.lit("&amp;")))


# Character references decoded in attribute values, `&amp;` last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"),
    ("&#x27;", "'"), ("&apos;", "'"), ("&#47;", "/"), ("&#x2F;", "/"), ("&nbsp;", "\xa0"),
    ("&#38;", "&"), ("&amp;", "&"),
)


def unescape_html_sql(text: str) -> str:
    """SQL value: character references back to characters; a text without `&` is passed through."""
    decoded = text
    for reference, character in ENTITIES:
        decoded = f"replace({decoded}, '{reference}', {sql_text(character)})"
    return f"CASE WHEN contains({text}, '&') THEN {decoded} ELSE {text} END"


def contains_any(text: Column, words) -> Column:
    """Whether any of the words is in the text, as written."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def preview(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)
