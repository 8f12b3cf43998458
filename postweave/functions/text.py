"""Cleaning and tokenising of posts, as native column expressions.

Word characters are letters and numbers of any script plus the underscore;
white space is Unicode white space plus the four separator controls.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"

# Patterns that must match those of the data's original processing.
URL = r"(?U)http" + NOT_SPACE + "+"
REPOST = r"^RT "
HASHTAG = "#(" + WORD + "+)"
MENTION = "@(" + WORD + "+)"
TAG_PIECE = r"([A-Z]?[a-z]+|[0-9]+)"
HASHTAG_TOKEN = r"^#.*"
MENTION_TOKEN = r"^@.*"
PUNCTUATION_TOKEN = r"(?U)^[^\p{L}\p{N}_\s\x1c-\x1f]$"
MENTION_MASK = "@user"
INFO_SEPARATOR = " <sep> "

TOKEN = r"(?U)[#@]?" + WORD + r"+|[^\p{L}\p{N}_\s\x1c-\x1f]"
SENTENCE_GAP = r"(?U)(?<=[.!?])" + SPACE + "+"


def collapse_urls(text: Column) -> Column:
    """Shorten every ``http…`` run to the bare word ``http``."""
    return F.regexp_replace(text, URL, "http")


def strip_repost(text: Column) -> Column:
    """Remove a leading repost mark."""
    return F.regexp_replace(text, REPOST, "")


def hashtag_names(text: Column) -> Column:
    """The lower-cased hashtag names of a text, as an array."""
    return F.transform(F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(1)), F.lower)


def hashtags(text: Column) -> Column:
    """The lower-cased hashtag names of a text, comma-joined."""
    return F.array_join(hashtag_names(text), ", ")


def mentions(text: Column) -> Column:
    """The mentioned names of a text, comma-joined."""
    return F.array_join(F.regexp_extract_all(text, F.lit(MENTION), F.lit(1)), ", ")


def mask_mentions(text: Column) -> Column:
    """Replace every mention by one fixed name."""
    return F.regexp_replace(text, MENTION, MENTION_MASK)


def strip_space(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def split_hashtag(tag: Column) -> Column:
    """Put spaces around the capitalised words and digit runs of a hashtag name."""
    spaced = F.regexp_replace(tag, TAG_PIECE, " $1 ")
    return strip_space(F.regexp_replace(spaced, rf"(?U){SPACE}+", " "))


def clean_post(text: Column) -> dict[str, Column]:
    """The cleaned text of a post with its hashtags and mentions.

    The letters R and T are stripped as a character set at both ends, so ``TRUE RT``
    loses its first two letters as well.
    """
    flat = F.replace(strip_space(F.btrim(text, F.lit("RT"))), F.lit("\n"), F.lit(" "))
    short = collapse_urls(flat)
    return {"text": mask_mentions(short), "hashtags": hashtags(short), "mentions": mentions(short)}


def sentences(text: Column) -> Column:
    """Split at white space that follows a full stop, exclamation or question mark."""
    return F.filter(F.split(text, SENTENCE_GAP), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Words (with a leading ``#`` or ``@`` if any) and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def text_with_info(text: Column, *info: Column) -> Column:
    """A text and its attributes in one string; NULL attributes are left out."""
    return F.concat_ws(INFO_SEPARATOR, text, *(c.cast("string") for c in info))


def token_positions(tokens: Column, pattern: str) -> Column:
    """0-based positions of the tokens that match ``pattern``."""
    marked = F.transform(tokens, lambda t, i: F.when(t.rlike(pattern), i))
    return F.array_compact(marked)


def replace_tokens(tokens: Column, pattern: str, replacement: str) -> Column:
    """Keep the tokens that match ``pattern``; put ``replacement`` for the others."""
    return F.transform(tokens, lambda t: F.when(t.rlike(pattern), t).otherwise(F.lit(replacement)))


def hashtag_tokens(tokens: Column) -> Column:
    """Tokens that start with ``#``, without it and in lower case."""
    tagged = F.filter(tokens, lambda t: t.startswith("#"))
    return F.transform(tagged, lambda t: F.lower(F.substring(t, 2, 2**31 - 1)))


def _positions(items: Column) -> Column:
    # An empty array has no positions: sequence(0, -1) would count down.
    none = F.array().cast("array<int>")
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(none)


def _pick(items: Column, positions: Column) -> Column:
    return F.transform(F.array_sort(positions), lambda i: F.get(items, i))


def select_by_index(items: Column, indexes: Column) -> Column:
    """The elements at the given 0-based indexes, in element order."""
    return _pick(items, F.array_intersect(_positions(items), indexes))


def remove_by_index(items: Column, indexes: Column) -> Column:
    """The elements at all other indexes, in element order."""
    return _pick(items, F.array_except(_positions(items), indexes))
