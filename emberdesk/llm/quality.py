"""Line-first quality rules, with built-in column functions only.

Every line is judged by itself: navigation bars, lines of symbols instead of punctuation, shouting, and
known boilerplate are removed first. A document is then rejected if too large a share of its words went
with these lines, or if it fails the base counts: too few words, or too many inside repeated windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: What separates words; symbols that are counted; phrases of boilerplate lines.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "copyright ©", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "accept cookies", "sign up for", "click here",
    "enable javascript", "licensed under", "skip to content", "skip to main content", "alle rechte vorbehalten", "cookies akzeptieren", "nutzungsbedingungen", "hier klicken", "zum inhalt springen",
    "tous droits réservés", "accepter les cookies", "conditions d'utilisation", "politique de confidentialité", "cliquez ici", "aller au contenu", "todos los derechos reservados", "aceptar cookies",
    "términos de uso", "política de privacidad", "haga clic aquí", "saltar al contenido",
)
#: Words that links of a page's frame are made of.
LINK_WORDS = (
    "home", "homepage", "about", "contact", "login", "logout", "register", "menu", "search", "sitemap", "faq", "help", "subscribe", "newsletter", "share", "tweet", "next", "previous", "more", "read", "back", "top",
    "startseite", "kontakt", "impressum", "anmelden", "registrieren", "suche", "datenschutz", "hilfe", "weiterlesen", "teilen", "accueil", "connexion", "recherche", "aide", "partager", "suivant", "inicio", "contacto", "buscar", "ayuda", "compartir", "siguiente",
)
LINK = r"(?i)(?<![^\x20\x09|<>/])(?:" + "|".join(LINK_WORDS) + r")(?![^\x20\x09|<>/:,])"
#: The same inside a text, where lines' ends are borders as well.
LINK_IN_TEXT = LINK.replace(r"\x09|", r"\x09\n|")
SENTENCE_END = r"[.!?…][\"'”’»)\]]*[\x20\x09\r]*$"
STUTTER = r"(?<![^\x20\x09])([^\x20\x09]+)(?:[\x20\x09]\1){3}(?![^\x20\x09])"
#: The same inside a text: lines' ends are borders as well, and no word holds one.
STUTTER_IN_TEXT = r"(?<![^\x20\x09\n])([^\x20\x09\n]+)(?:[\x20\x09]\1){3}(?![^\x20\x09\n])"

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document that keeps a smaller share of its words than this is rejected.
MIN_KEPT_SHARE = 0.5
#: Symbols, bars and doubled marks allowed for each word of a line.
MAX_MARKS_PER_WORD = 0.3


def _boilerplate(text: Column, words: Column | None = None) -> Column:
    """Whether ``text`` holds a phrase, and with its number of ``words`` given, whether that is a quarter of them."""
    lower = F.lower(text)
    return reduce(lambda a, b: a | b, [lower.contains(p) if words is None else lower.contains(p) & (words <= 4 * len(p.split())) for p in BOILERPLATE])


def failing_line(line: Column) -> Column:
    """True if ``line`` has words and fails a rule.

    Navigation: bars between few words, or link words as half of a line that doesn't end like a sentence.
    Punctuation: doubled marks and symbols in place of punctuation; a word said four times on end.
    Boilerplate: a known phrase that makes up a quarter of the line, so that sentences may mention it.
    """
    words = F.regexp_count(line, F.lit(WORD))
    bars = F.regexp_count(line, F.lit(r"(?<![^\x20\x09])[|<>](?![^\x20\x09])"))
    marks = F.regexp_count(line, F.lit(r"[#*$%&|<>]{2,}|!{2,}|\?{2,}"))
    navigation = (bars >= 2) & (bars * 4 >= words) | (F.regexp_count(line, F.lit(LINK)) * 2 >= words - bars) & ~line.rlike(SENTENCE_END)
    punctuation = (words >= 3) & (marks > words * MAX_MARKS_PER_WORD)
    stutter = F.regexp_count(line, F.lit(STUTTER)) * 8 >= words
    return (words > 0) & (navigation | punctuation | line.rlike(STUTTER) & stutter | _boilerplate(line, words))


def suspect(text: Column, n_symbols: Column) -> Column:
    """False only if no line of ``text`` can fail: each rule of ``failing_line`` needs a symbol, a doubled mark,
    a stutter between the text's or a line's ends, a link word or a phrase, which the whole text then has as well."""
    return (n_symbols > 0) | text.contains("!!") | text.contains("??") | text.rlike(STUTTER_IN_TEXT) | text.rlike(LINK_IN_TEXT) | _boilerplate(text)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts, verdict and cleaned text of every document, in one pass without a shuffle.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
    n_removed_lines, base_failed, kept, cleaned``, and with ``keep`` a struct ``columns`` of the columns it names,
    so that these may have any names.

    Null or empty text has no words, so it fails the base rule. Texts of any length are judged whole, in one row. Windows are compared by 64-bit hashes of
    their words within a document. Repeated rows are judged alike; an empty table gives no rows. Columns
    of the input are read only by the names given, so others can't clash.
    """
    keep = keep or None
    rows = texts(docs, id_col, text_col) if keep is None else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("columns"))
    extra = [] if keep is None else ["columns"]
    held = ["doc_id", "text", *extra]

    split = rows.select(*held, F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"), F.split("text", "\n").alias("lines"))
    n_symbols = (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long")
    hashed = split.select(*held, "words", "lines", n_symbols.alias("n_symbols"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    # One hash for each window of eight words, in order.
    n, none = F.size("h"), F.array().cast("array<long>")
    windows = F.slice(F.transform("h", lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)])), F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)))
    hashed = hashed.select(
        *held, "lines", "n_symbols", n.cast("long").alias("n_words"), F.when(n >= WINDOW, windows).otherwise(none).alias("hashes"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.filter("lines", lambda x: x.rlike(WORD)).alias("worded"),
        # Every line is judged once; texts in which none can fail have no marks.
        F.when(suspect(F.col("text"), F.col("n_symbols")), F.transform("lines", failing_line)).otherwise(F.array().cast("array<boolean>")).alias("fails"),
    )
    # Only a document with a repeated window sorts its windows.
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = hashed.withColumn("ordered", F.when(repeated, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:long,i:int>>")))
    twice = F.transform("ordered", lambda x, k: F.when((x["h"] == F.get("ordered", k - 1)["h"]) | (x["h"] == F.get("ordered", k + 1)["h"]), x["i"]))
    placed = ordered.withColumn("places", F.array_sort(F.filter(twice, lambda p: p.isNotNull())))
    covered = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    counted = placed.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))

    words_lost = F.transform("fails", lambda f, i: F.when(f, F.regexp_count(F.get("lines", i), F.lit(WORD))).otherwise(0))
    lost = F.aggregate(words_lost, F.lit(0).cast("long"), lambda a, x: a + x)
    counts = F.struct(
        "n_words", "word_chars", "n_symbols", "n_repeat_words",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        lost.alias("n_removed_words"), F.size(F.filter("fails", lambda f: f)).cast("long").alias("n_removed_lines"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )
    # A generator of one row: a filter on the counts stays above it, so that it isn't computed from the text again.
    judged = counted.select(*held, "lines", "fails", F.explode(F.array(counts)).alias("q")).select(*held, "lines", "fails", "q.*")
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= MIN_KEPT_SHARE * F.col("n_words"))
    cleaned = F.when(F.col("n_removed_lines") == 0, F.col("text")).otherwise(F.array_join(F.filter("lines", lambda _, i: ~F.get("fails", i)), "\n"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "n_removed_lines", "base_failed", kept.alias("kept"), cleaned.alias("cleaned"), *extra
    )
