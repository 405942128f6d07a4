"""Text columns: extraction, canonical representations, hashes and tokens."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions.bound import bound

# Lookarounds stand in for Unicode word boundaries; Java's own differ on combining marks. The mark comes
# before the look back over it, which then is made at marks only.
MENTION = rf"@(?<!{V.WORD}@)({V.MENTION_BODY})(?!{V.WORD})"
HASHTAG = rf"#(?<!{V.WORD}#)({V.HASHTAG_BODY})(?!{V.WORD})"
PUNCTUATION_RUN = rf"([{''.join(V.REPEATED_PUNCTUATION)}])\1{{2,}}"

# A URL body is a run of characters and closed parentheses, of two units or more, that ends in a
# parenthesis or in a character that is not punctuation. Possessive groups read each unit once, so
# long junk tokens neither backtrack exponentially nor deepen the stack.
_RUN, _PARENS = f"{V.URL_CHAR}*+", V.URL_PARENS
_URL_BODY = "|".join(
    [
        f"(?:{_RUN}{_PARENS})++{V.URL_CHAR}*{V.URL_LAST_CHAR}",
        f"{V.URL_CHAR}++{_PARENS}(?:{_RUN}{_PARENS})*+",
        f"{_PARENS}(?:{_RUN}{_PARENS})++",
        f"{V.URL_CHAR}+{V.URL_LAST_CHAR}",
    ]
)
# A bare host is a whole run of host characters that ends in a dot and two to four letters and is
# followed by a slash, so the run is read possessively and its tail checked by looking back. The
# letters include the four others that fold to ASCII ones.
_LETTERS = "a-zA-Z\u0130\u0131\u017f\u212a"
_HOST = (
    rf"(?![.]?[{_LETTERS}]{{1,4}}/)[{_LETTERS}0-9.\-]++/"
    rf"(?<=[{_LETTERS}0-9.\-][.][{_LETTERS}]{{2,4}}/)"
)
URL = (
    rf"(?:(?<!{V.WORD})(?:(?i:https?)://|(?i:www)\p{{Nd}}{{0,3}}[.]|(?=[{_LETTERS}0-9]){_HOST})"
    rf"|(?<={V.WORD})(?=[.\-]){_HOST})(?:{_URL_BODY})"
)


def _may_have_url(text: Column) -> Column:
    """Cheap test that spares texts without a slash or `www` the pattern."""
    return F.contains(text, F.lit("/")) | F.contains(F.lower(text), F.lit("www"))


def _by_blanks(text: Column) -> Column:
    """What stands between blanks. No URL holds one, and a blank before or behind is to the pattern
    what the begin or end of the text is: parts can be searched one by one."""
    return F.split(text, " ")


def _replace_urls(text: Column, by: str) -> Column:
    def replaced(text: Column) -> Column:
        parts = F.transform(_by_blanks(text), lambda p: F.when(_may_have_url(p), F.regexp_replace(p, URL, by)).otherwise(p))
        return F.when(_may_have_url(text), F.array_join(parts, " ")).otherwise(text)

    return bound(text, replaced)


def _find_all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends (Spark's `trim` only knows the blank)."""
    return F.btrim(text, F.lit(V.SPACES))


def _single_blanks(text: Column) -> Column:
    """White-space runs become one blank. Single blanks, most of all runs, are left as they are.

    Most characters are visible ASCII, which one comparison of the look ahead tells, the class only many.
    """
    seen = "(?![!-~])"
    return F.regexp_replace(text, f"{seen}(?: {seen}{V.SPACE}+|(?! ){V.SPACE}+)", " ")


def collapse_space(text: Column) -> Column:
    """White-space runs become one blank; none at the ends."""
    return F.trim(_single_blanks(text))


def collapse_punctuation(text: Column) -> Column:
    """Three or more equal marks of `! ? . , ;` become one."""
    return F.regexp_replace(text, PUNCTUATION_RUN, "$1")


def extract_urls(text: Column) -> Column:
    """URLs in order of first appearance, without repeats."""
    none = F.array().cast("array<string>")
    parts = F.array_join(F.filter(_by_blanks(text), _may_have_url), " ")
    found = F.array_distinct(_find_all(parts, URL, 0))
    return F.when(_may_have_url(text), found).when(text.isNotNull(), none)


def _first_casing(found: Column) -> Column:
    """Drop case-insensitive repeats, keeping the first spelling."""

    def kept(found: Column) -> Column:
        keys = F.transform(found, lambda x: F.lower(x))
        first = bound(keys, lambda k: F.filter(found, lambda x, i: F.array_position(k, F.lower(x)) == i + 1))
        # One hit or none needs no comparison.
        return F.when(F.size(found) < 2, found).otherwise(first)

    return bound(found, kept)


def extract_mentions(text: Column) -> Column:
    return _first_casing(_find_all(text, MENTION, 1))


def extract_hashtags(text: Column) -> Column:
    return _first_casing(_find_all(text, HASHTAG, 1))


def import_hashtags(text: Column) -> Column:
    """Looser import-time rule: every `#word`, lower-cased, repeats kept."""
    return F.transform(_find_all(text, f"#({V.WORD}+)", 1), lambda x: F.lower(x))


def import_mentions(text: Column) -> Column:
    return _find_all(text, f"@({V.WORD}+)", 1)


def import_urls(text: Column) -> Column:
    return _find_all(text, V.IMPORT_URL, 0)


def split_hashtag_field(field: Column) -> Column:
    """Hashtags of a mapped column: cut at comma, bar or semicolon, `#` stripped, lower-cased.

    The blank test comes before the `#` is stripped, so a lone `#` leaves an empty tag.
    """
    parts = F.filter(F.split(field, "[,|;]"), lambda x: strip(x) != "")
    return F.transform(parts, lambda x: F.lower(F.regexp_replace(strip(x), r"\A#+", "")))


def append_missing(first: Column, second: Column) -> Column:
    """`first`, then the elements of `second` it lacks, each once."""
    return F.concat(first, F.array_except(second, first))


def union_in_order(first: Column, second: Column) -> Column:
    """Distinct elements of both arrays by first occurrence; a null array counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, empty), F.coalesce(second, empty)))


#: What stands for numbers that are no characters: the replacement, and the bytes of Windows-1252.
_NUMBERED = {0: "\ufffd", 13: "\r"} | {
    b: bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(0x80, 0xA0)
}


def _by_start(names: dict[str, str]) -> Column:
    """Names and what they stand for as one literal: a map by the first two letters of maps by name."""
    parts: dict[str, dict[str, str]] = {}
    for name, value in names.items():
        parts.setdefault(name[:2], {})[name] = value
    return F.from_json(F.lit(json.dumps(parts)), "map<string,map<string,string>>")


def decode_entities(text: Column) -> Column:
    """Decode HTML entities as the HTML 5 rules ask: by number, by name, and the old names that need
    no semicolon. A text is cut at each `&`, and the reference at the head of each part replaced."""
    head = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    names = _by_start(html5)
    old_names = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    replaced = F.from_json(F.lit(json.dumps({str(n): c for n, c in _NUMBERED.items()})), "map<string,string>")

    def named(reference: Column) -> Column:
        return F.try_element_at(F.try_element_at(names, F.substring(reference, 1, 2)), reference)

    def number(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "^#[xX]?0*([0-9a-fA-F]*)", 1)
        hexadecimal = F.when(F.length(digits) <= 8, F.conv(F.concat(F.lit("0"), digits), 16, 10))
        decimal = F.when(F.length(digits) <= 10, F.concat(F.lit("0"), digits))
        code = F.coalesce(F.when(reference.rlike("^#[xX]"), hexadecimal).otherwise(decimal).try_cast("bigint"), F.lit(1 << 40))
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        unprintable = code.between(1, 8) | code.between(14, 31) | code.between(127, 159) | code.between(0xFDD0, 0xFDEF)
        unprintable = unprintable | (code == 11) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return (
            F.when(F.try_element_at(replaced, code.cast("string")).isNotNull(), F.try_element_at(replaced, code.cast("string")))
            .when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
            .when(unprintable, F.lit(""))
            .otherwise(character)
        )

    def name(reference: Column) -> Column:
        old = F.regexp_extract(reference, "^(" + "|".join(old_names) + ")", 1)
        prefix = F.concat(named(old), F.substring(reference, F.length(old) + 1, F.length(reference)))
        whole = named(reference)
        return F.coalesce(whole, F.when(old != "", prefix), F.concat(F.lit("&"), reference))

    def part(piece: Column, i: Column) -> Column:
        reference = F.regexp_extract(piece, head, 1)
        rest = F.substring(piece, F.length(reference) + 1, F.length(piece))
        decoded = F.when(reference == "", F.lit("&")).when(F.startswith(reference, F.lit("#")), number(reference)).otherwise(name(reference))
        return F.when(i == 0, piece).otherwise(F.concat(decoded, rest))

    pieces = F.transform(F.split(text, "&"), part)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def canonical_text(text: Column) -> Column:
    """The stripped, lower-cased, space-collapsed text."""
    return _single_blanks(F.lower(strip(text)))


def text_hash(text: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical_text(text), 256)


def sentiment_ready(decoded: Column) -> Column:
    """Case kept; mentions become `@user`, URLs `http`."""
    text = F.regexp_replace(decoded, MENTION, "@user")
    text = _replace_urls(text, "http")
    return collapse_space(collapse_punctuation(text))


def cleaned(decoded: Column) -> Column:
    """Lower-cased text without URLs, mentions and `#`."""
    text = _replace_urls(decoded, " ")
    text = F.regexp_replace(text, MENTION, " ")
    text = F.regexp_replace(text, HASHTAG, "$1")
    return F.lower(collapse_space(collapse_punctuation(text)))


def ner_text(decoded: Column) -> Column:
    """Case and mentions kept; URLs dropped, `#` stripped."""
    text = _replace_urls(decoded, " ")
    text = F.regexp_replace(text, HASHTAG, "$1")
    return collapse_space(collapse_punctuation(text))


def without_hashtags(text: Column) -> Column:
    """Hashtags are topical annotations, no evidence of named entities."""
    return F.regexp_replace(text, f"#{V.WORD}+", " ")


def preferred_text(canonical: Column, original: Column) -> Column:
    """The canonical text, or the original when that is missing or empty."""
    return F.coalesce(F.nullif(canonical, F.lit("")), original)


def preprocessing_meta(
    original: Column, cleaned_text: Column, urls: Column, mentions: Column, hashtags: Column
) -> Column:
    """What the preprocessing saw, as a struct."""
    return F.struct(
        F.lit(V.PREPROCESSING_VERSION).alias("version"),
        F.size(urls).alias("url_count"),
        F.size(mentions).alias("mention_count"),
        F.size(hashtags).alias("hashtag_count"),
        F.length(original).alias("char_length_original"),
        F.length(cleaned_text).alias("char_length_cleaned"),
        text_hash(original).alias("text_hash"),
    )


def merge_meta(existing: Column, meta: Column) -> Column:
    """Meta struct over the keys of an existing map; the new value wins."""
    fields = [
        "version", "url_count", "mention_count", "hashtag_count", "char_length_original",
        "char_length_cleaned", "text_hash",
    ]
    fresh = F.create_map(*[x for f in fields for x in (F.lit(f), meta[f].cast("string"))])
    kept = F.map_filter(
        F.coalesce(existing, F.create_map().cast("map<string,string>")),
        lambda key, _: ~key.isin(fields),
    )
    return F.map_concat(kept, fresh)


def words(text: Column) -> Column:
    """Maximal runs of word characters of the lower-cased text."""
    return F.split(F.lower(text), f"{V.NOT_WORD}+")


def keyword_tokens(text: Column, stop_words: list[str] | tuple = tuple(V.STOP_WORDS)) -> Column:
    """Tokens of three or more ASCII letters that are whole words, without stop words."""
    return F.filter(
        words(text), lambda w: w.rlike(r"\A[a-z]{3,}\z") & ~w.isin(list(stop_words))
    )


def topic_tokens(text: Column, stop_words: list[str] | tuple = tuple(V.STOP_WORDS)) -> Column:
    """Words of two or more word characters, without stop words."""
    return F.filter(words(text), lambda w: (F.length(w) >= 2) & ~w.isin(list(stop_words)))



def split_space(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.filter(F.split(text, f"{V.SPACE}+"), lambda w: w != "")
