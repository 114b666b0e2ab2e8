"""Text expressions for pages and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character references replaced in page text, `&amp;` last.
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&deg;", "°"),
    ("&#176;", "°"),
    ("&#xB0;", "°"),
    ("&micro;", "µ"),
    ("&plusmn;", "±"),
    ("&ndash;", "–"),
    ("&amp;", "&"),
)

_BLANKS = r"[ \t\r\n\f]+"
_WORD_BREAK = r"[^\p{L}\p{N}]+"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _BLANKS, " "))


def decode(c: Column) -> Column:
    for reference, character in ENTITIES:
        c = F.replace(c, F.lit(reference), F.lit(character))
    return c


def page_title(html: Column) -> Column:
    return squeeze(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_text(html: Column) -> Column:
    """Visible text: no head, scripts, styles, comments or tags."""
    c = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    c = F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, r"(?is)<title[^>]*>.*?</title>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    return squeeze(decode(c))


def split_words(text: Column) -> Column:
    """Lower-case words in text order; the first or last one may be blank."""
    return F.split(F.lower(text), _WORD_BREAK)


def words(text: Column) -> Column:
    """Lower-case words in text order."""
    return F.array_remove(split_words(text), "")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n neighbouring words, joined by one blank."""
    if n == 1:
        return tokens
    return F.when(
        F.size(tokens) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(tokens) - n),
            lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<string>"))


def copy_key(text: Column) -> Column:
    """Equal for texts that differ only in letter case and blanks."""
    return F.sha2(F.lower(squeeze(text)), 256)
