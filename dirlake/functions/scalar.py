"""Scalar rules of the directory's forms and importer, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What web-form trimming removes: space, tab, line feed, carriage return, NUL, vertical tab.
FORM_SPACE = " \t\n\r\0\x0b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that slugs write in ASCII.
FOLDED = ("çğıöşüâîû", "cgiosuaiu")
#: Tags that a post may have, attributes of any of them, and of some.
POST_TAGS = ["a", "abbr", "b", "blockquote", "br", "cite", "code", "del", "div", "em", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "ins", "li", "ol", "p", "pre", "q", "s", "small", "span", "strong", "sub", "sup", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "u", "ul"]
ANY_ATTRIBUTES, OWN_ATTRIBUTES = ["class", "id", "lang", "title"], {"a": ["href", "rel", "target"], "img": ["src", "alt", "width", "height"], "td": ["colspan", "rowspan"], "th": ["colspan", "rowspan"]}
#: Texts, tags and stray signs of HTML; attributes in double quotes; URLs of a scheme that is let through, or of none.
TOKEN, ATTRIBUTE = "</?[A-Za-z!?][^<>]*>|[^<]+|<", '[ \\t\\r\\n]([a-z]+="[^"<>]*")'
SAFE_URL = '^[a-z]+="((https?|ftp|mailto):|[^:&"/?#]*["/?#])'
NUMBER = "^[ \\t\\n\\r]*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[ \\t\\n\\r]*$"


def form_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(FORM_SPACE))


def unicode_trim(c: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text(c: Column) -> Column:
    """Missing as empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def is_empty(c: Column) -> Column:
    """Null, the empty string and '0' count as empty."""
    return text(c).isin("", "0")


def flag(c: Column) -> Column:
    """True for exactly '1'; never null."""
    return F.coalesce(c.cast("string") == "1", F.lit(False))


def lenient_int(c: Column) -> Column:
    """The integer at the start of a string, after blanks; else 0. '12abc' is 12, '1e3' is 1000, too large is 0."""
    number = F.regexp_extract(text(c), "^[ \\t\\n\\r]*([+-]?[0-9]+(\\.[0-9]*)?[eE][+-]?[0-9]+)", 1)
    whole = F.regexp_extract(text(c), "^[ \\t\\n\\r]*([+-]?[0-9]+)", 1)
    return F.coalesce(F.when(number != "", number.try_cast("double").try_cast("bigint")).otherwise(whole.try_cast("bigint")), F.lit(0).cast("bigint"))


def is_numeric(c: Column) -> Column:
    return F.coalesce(c.rlike(NUMBER), F.lit(False))


def decimal_point(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("."))


def strip_tags(c: Column, instead: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]*>", instead)


def post_html(c: Column) -> Column:
    """HTML made anew from allowed parts: tags of POST_TAGS with their attributes in double quotes, and text.

    Other tags and comments go, what stands between them stays; so do other attributes, and URLs of other schemes or with a
    character reference where a scheme could be. A sign that begins no tag is escaped.
    """

    def kept(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, "^</?([A-Za-z][A-Za-z0-9]*)[^A-Za-z0-9]", 1))
        key = lambda a: F.substring_index(a, "=", 1)
        own = lambda a: reduce(Column.__or__, [(name == tag) & key(a).isin(some) for tag, some in OWN_ATTRIBUTES.items()])
        safe = lambda a: ~key(a).isin("href", "src") | F.lower(a).rlike(SAFE_URL)
        attributes = F.filter(F.regexp_extract_all(x, F.lit(ATTRIBUTE), F.lit(1)), lambda a: (key(a).isin(ANY_ATTRIBUTES) | own(a)) & safe(a))
        tag = F.concat(F.lit("<"), name, F.array_join(F.transform(attributes, lambda a: F.concat(F.lit(" "), a)), ""), F.when(x.endswith("/>"), " /").otherwise(""), F.lit(">"))
        return F.when(x == "<", "&lt;").when(~x.startswith("<"), x).when(~name.isin(POST_TAGS), "").when(x.startswith("</"), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(tag)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), kept), "")


def text_field(c: Column) -> Column:
    """One line of plain text: no tags, blanks collapsed, trimmed."""
    return F.btrim(F.regexp_replace(strip_tags(c), "[\\r\\n\\t ]+", " "))


def text_area(c: Column) -> Column:
    """As text_field, but line feeds stay."""
    return F.btrim(F.regexp_replace(strip_tags(c), "[\\r\\t ]+", " "), F.lit(" \n"))


def email(c: Column) -> Column:
    """Allowed characters only; empty unless what is left looks like an address."""
    kept = F.regexp_replace(c, "[^A-Za-z0-9.!#$%&'*+/=?^_`{|}~@-]", "")
    return F.when(kept.rlike("^[^@]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+$") | c.isNull(), kept).otherwise(F.lit(""))


def url(c: Column) -> Column:
    """Only http, https, ftp and mailto, or no scheme; characters that no URL has go."""
    kept = F.regexp_replace(F.btrim(c), "[^A-Za-z0-9\\-~+_.?#=!&;,/:%@$|*'()\\[\\]\\x80-\\x{10FFFF}]", "")
    scheme = F.lower(F.regexp_extract(text(kept), "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme.isin("", "http", "https", "ftp", "mailto") | c.isNull(), kept).otherwise(F.lit(""))


def hex_color(c: Column) -> Column:
    """'#' and 3 or 6 hex digits, else null."""
    return F.when(c.rlike("^#([A-Fa-f0-9]{3}){1,2}$"), c)


def slug(c: Column) -> Column:
    """Lower case, ASCII for Turkish and circumflex letters, other characters as single hyphens."""
    low = F.lower(F.translate(c, "İ", "I"))  # in lower case it would be an i and a dot
    return F.btrim(F.regexp_replace(F.translate(low, *FOLDED), "[^a-z0-9]+", "-"), F.lit("-"))


def first_word(c: Column) -> Column:
    return F.get(F.split(c, " "), F.lit(0))


def last_word(c: Column) -> Column:
    """The last of several words, else empty."""
    words = F.split(c, " ")
    return F.when(F.size(words) > 1, F.try_element_at(words, F.lit(-1))).otherwise(F.lit(""))


def joined(*columns: Column) -> Column:
    """Concatenation in which null is the empty string."""
    return F.concat(*[text(c) for c in columns])


def token(*columns: Column) -> Column:
    """Base64 of the fields, joined by bars."""
    return F.base64(F.concat_ws("|", *columns).cast("binary"))


def login_token(user_id: Column, email: Column, seconds: Column | None = None) -> Column:
    """The token of a login: id, e-mail and time in seconds, by default when the query began."""
    return token(user_id.cast("string"), email, (F.unix_timestamp() if seconds is None else seconds).cast("string"))


def titled(items: Column, field: str) -> Column:
    """Items whose field isn't empty, with text_field applied to all of their fields; a missing list is null."""
    return F.filter(items, lambda x: ~is_empty(x[field]))


def cleaned(items: Column, fields: list[str]) -> Column:
    return F.transform(items, lambda x: F.struct(*[text_field(x[f]).alias(f) for f in fields]))


def listed(ids: Column, one: Column) -> Column:
    """Whether an array of ids holds one; a missing list or id is never listed."""
    return F.coalesce(F.array_contains(ids, one), F.lit(False))
