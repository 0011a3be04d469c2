"""Text functions as column expressions; character classes are Unicode, lengths are code points."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


#: White space, as ``(?U)\s`` means it.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def without_urls(c: Column) -> Column:
    """The text without links and bare paths. Each pattern needs a slash or ``www.``, so most texts need none."""
    once = F.regexp_replace(c, r"(?U)https?://\S+|www\.\S+|\S+\.\w{2,4}/\S+", "")
    bare = F.regexp_replace(once, r"(?U)\S+\.(com|org|gov|net|io|co|edu|news)/\S*", "")
    return F.when(c.contains("/") | c.contains("www."), bare).otherwise(c)


def strip_urls(c: Column) -> Column:
    """The text without links and bare paths, trimmed."""
    return strip(without_urls(c))


def stripped_lengths(c: Column) -> tuple[Column, Column]:
    """The length of ``c``, from which links were taken, when trimmed, and when trimmed on its left alone."""
    return F.length(strip(c)), F.length(F.regexp_replace(c, r"(?U)^\s+", ""))


def joined_length(trimmed: Column, left: Column, link: Column) -> Column:
    """The length of a text with ``link`` behind a space, by ``strip_urls``, from the text's ``stripped_lengths``.

    No link reaches over white space, so what is left of both is what is left of each.
    """
    rest = without_urls(link)
    behind = F.length(strip(rest))
    return F.when(behind == 0, trimmed).when(trimmed == 0, behind).otherwise(left + 1 + F.length(F.regexp_replace(rest, r"(?U)\s+$", "")))


#: What ``clean_headline`` takes out, and a part of each that a text without any of these lacks.
_MESS = {r"(?U)https?://\S{20,}": "://", r"(?U)bsky\.app/profile/\S+": "bsky.app/profile/", r"(?U)did:(plc|web):\S+": "did:", r"(?U)\bundefined\b": "undefined", r"(?U)#\w+\s*$": "#"}


def clean_headline(c: Column) -> Column:
    out, messy = c, F.lit(False)
    for pattern, part in _MESS.items():
        out, messy = F.regexp_replace(out, pattern, ""), messy | c.contains(part)
    # Single spaces stay as they are, so only other white space is replaced.
    return strip(F.regexp_replace(F.when(messy, out).otherwise(c), r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def title_words(c: Column) -> Column:
    """The first six words that carry meaning."""
    for pattern, by in ((r"(?U)https?://\S+", ""), (r"(?U)www\.\S+", ""), (r"(?U)[^\w\s]", " ")):
        c = F.regexp_replace(F.lower(c) if by == "" and "http" in pattern else c, pattern, by)
    words = F.split(strip(c), r"(?U)\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(dims.STOPWORDS)), 1, 6)


def title_key(family: Column, text: Column) -> Column:
    words = title_words(text)
    return F.when(F.size(words) >= 3, F.concat(family, F.lit(":"), F.array_join(F.slice(F.array_sort(words), 1, 5), " ")))


def truncate(c: Column, limit: int) -> Column:
    """Cut at the last sentence end in the back of the limit, else at a space, else at the limit."""
    window, low = F.substring(c, 1, limit), max(int(limit * 0.4), 20)
    sentence = F.regexp_extract(window, rf"(?s)^(.{{{low + 1},}}[.!?])(?=[ \"'\n)]|$)", 1)
    space = F.length(window) - F.locate(" ", F.reverse(window))
    cut = F.when((F.locate(" ", window) == 0) | (space < limit * 0.4), F.lit(limit)).otherwise(space)
    rest = F.concat(F.regexp_replace(F.substring(c, F.lit(1), cut.cast("int")), r"(?U)\s+$", ""), F.lit("..."))
    return F.when(F.length(c) <= limit, c).when(sentence != "", F.regexp_replace(sentence, r"(?U)\s+$", "")).otherwise(rest)


def excerpt_differs(headline: Column, text: Column) -> Column:
    h, t = F.regexp_replace(strip(headline), r"[.!?…]+$", ""), strip(text)
    given = (F.coalesce(F.length(headline), F.lit(0)) > 0) & (F.coalesce(F.length(text), F.lit(0)) > 0)
    return given & ~t.startswith(F.substring(h, 1, 30)) & ~h.startswith(F.substring(t, 1, 30))


def relative_time(seconds: Column) -> Column:
    m = F.floor(seconds / 60)
    return F.when(m < 1, "just now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("d ago")))


def mostly_latin(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return ~((letters > 10) & (F.regexp_count(c, F.lit("[A-Za-z]")) < letters * 0.5))


def command(c: Column) -> Column:
    """What a direct message asks for: opt_out, opt_in, or null."""
    out = c.rlike(r"(?iU)^\s*(opt\s*out|exclude\s*me|remove\s*me|don'?t\s*include\s*me)\s*[.!]?\s*$")
    back = c.rlike(r"(?iU)^\s*(opt\s*in|include\s*me|add\s*me\s*back)\s*[.!]?\s*$")
    return F.when(out, "opt_out").when(back, "opt_in")
