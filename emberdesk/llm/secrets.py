"""Secret scan: candidate strings, judged by a random forest over what they and their neighbours look like.

Candidates are found and described with built-in column functions; the forest is a nest of conditions
over these descriptions, so the whole scan is one pass of column expressions. How likely a string's letters
follow each other, and how much of it common words cover, is told by tables drawn from a tokenizer's
vocabulary. The forest is trained at call time from a labelled table of findings; by default one made by
rule from a fixed seed.
"""

from __future__ import annotations

import functools
import json
import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts, vocabulary
from .encode import byte_letters
from .forest import as_column, fit_forest

#: What a candidate is made of, and the words that speak for or against one.
CANDIDATE = r"[A-Za-z0-9_+/.\-]{16,}(?:={1,2}(?![A-Za-z0-9_+/.\-=\"']))?"
#: What follows a name: in the word with something behind it, or as its last character.
NAMED = r"^[\"'\]]?(?:=|:(?!//)[^\x20])"
MAYBE_NAMED = r"^[\"'\]]?:"
SPEAKS_FOR = r"(?i)token|secret|passw|pwd|api|key|auth|bearer|credential|private"
SPEAKS_AGAINST = r"(?i)example|sample|dummy|test|placeholder|your|xxxx|1234567|abcdef0|sha\d*|md5|commit|checksum|uuid|version|digest|etag|hash"
FILE_END = r"\.(py|js|ts|java|go|rs|c|h|cpp|html?|css|json|xml|ya?ml|md|txt|png|jpe?g|gif|pdf|zip|gz|jar|so|dll)\b"

#: Labelled findings used at most; a larger table is cut to the first of them by their hash.
MAX_LABELLED = 5_000
THRESHOLD = 0.5
#: The vocabulary's first words of so many letters make the dictionary.
WORDS, WORD_LETTERS = 500, (4, 9)

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_hex", "f_transitions", "f_case_flips", "f_runs", "f_pairs", "f_dictionary", "f_path", "f_file", "f_for", "f_against", "f_assigned", "f_quoted", "f_vowels", "f_dashes", "f_named"]


@dataclass(frozen=True)
class Language:
    """What ordinary words look like: log-likelihoods of letter pairs against chance, and common words."""

    pairs: tuple[float, ...]
    words: str


@functools.lru_cache(maxsize=4)
def language(vocab_path: str | None = None) -> Language:
    """Drawn from the words of a vocabulary; those with a space before them, first by number."""
    model = json.loads(vocabulary(vocab_path))["model"]["vocab"]
    space = byte_letters()[0x20]
    known = [t[1:].lower() for t, _ in sorted(model.items(), key=lambda x: x[1]) if t[:1] == space and t[1:].isascii() and t[1:].isalpha()]
    seen = np.full((26, 26), 0.5)
    for w in known:
        codes = [ord(c) - 97 for c in w]
        for x, y in zip(codes, codes[1:], strict=False):
            seen[x, y] += 1
    likely = np.log(seen / seen.sum(axis=1, keepdims=True) * 26)
    lo, hi = WORD_LETTERS
    words = list(dict.fromkeys(w for w in known if lo <= len(w) <= hi))[:WORDS]
    return Language(tuple(np.round(likely.ravel(), 4).tolist()), "(?i)" + "|".join(sorted(words, key=lambda w: (-len(w), w))))


def candidates(rows: DataFrame) -> DataFrame:
    """``doc_id, word_no, nth, word, before, value, after`` for every candidate of every word of ``text``.

    A word with several candidates, as in a URL or in JSON without white space, is cut behind each of them:
    ``word`` is then the piece that ends with the candidate, and the last one also has the word's rest. A
    candidate that only names what follows (``my_long_name=...``) is none, and stays in its value's piece.
    ``after`` is what stands between a candidate and the next, or the word's end.
    """
    split = rows.select("doc_id", F.split("text", r"[\x20\x09-\x0D]+").alias("words"))
    longish = F.filter(F.transform("words", lambda w, i: F.when(F.length(w) >= 16, i)), lambda i: i.isNotNull())
    at = split.withColumn("at", longish).where(F.size("at") > 0)
    described = F.transform(
        "at",
        lambda i: F.struct(
            i.alias("word_no"), F.get("words", i).alias("word"),
            F.concat_ws(" ", F.get("words", i - 3), F.get("words", i - 2), F.get("words", i - 1)).alias("before"),
            F.coalesce(F.substring(F.get("words", i + 1), 1, 1), F.lit("")).alias("next"),
            F.regexp_extract_all(F.get("words", i), F.lit(CANDIDATE), F.lit(0)).alias("values"),
        ),
    )
    worth = F.filter(described, lambda c: F.size(c["values"]) > 0)
    found = at.select("doc_id", F.explode(worth).alias("c")).select("doc_id", "c.*").withColumn("between", F.split("word", CANDIDATE))
    # A name's word may be followed by one that begins with its sign.
    signs = F.transform("values", lambda _, i: F.when((i == F.size("values") - 1) & (F.get("between", i + 1) == ""), F.col("next")).otherwise(F.get("between", i + 1)))
    found = found.withColumn("names", F.transform(signs, lambda x: x.rlike(NAMED) | (x == "=")))
    each = found.select("doc_id", "word_no", "before", "between", "values", "names", F.size("values").alias("n"), F.posexplode("values").alias("nth", "value")).where(~F.get("names", F.col("nth")))
    rest = F.when(F.col("nth") == F.col("n") - 1, F.get("between", F.col("n"))).otherwise("")
    last = F.col("nth") - 1
    name = F.when(F.get("names", last), F.concat(F.get("between", last), F.get("values", last))).otherwise("")
    piece = F.concat(F.coalesce(name, F.lit("")), F.get("between", F.col("nth")), "value", rest)
    return each.select("doc_id", "word_no", "nth", piece.alias("word"), "before", "value", F.get("between", F.col("nth") + 1).alias("after"))


def features(found: DataFrame, words: Language) -> DataFrame:
    found = found.withColumn("codes", F.transform(F.split(F.lower("value"), ""), lambda c: F.ascii(c) - 97))
    table = F.expr("array(" + ", ".join(f"{x}D" for x in words.pairs) + ")")
    letter = lambda c: c.between(0, 25)
    pair = F.filter(F.transform("codes", lambda c, i: F.when(letter(c) & letter(F.get("codes", i + 1)), F.get(table, c * 26 + F.get("codes", i + 1)))), lambda x: x.isNotNull())
    found = found.withColumn("pair", pair).drop("codes")
    v, around = F.col("value"), F.concat_ws(" ", "before", "word")
    n = F.length(v).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    return found.withColumns(
        {
            "f_length": n,
            "f_digits": share(r"[0-9]"),
            "f_upper": share(r"[A-Z]"),
            "f_lower": share(r"[a-z]"),
            "f_hex": share(r"[0-9a-fA-F]"),
            "f_transitions": share(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
            "f_case_flips": share(r"[a-z](?=[A-Z])"),
            "f_runs": share(r"(.)\1\1"),
            "f_pairs": F.when(F.size("pair") > 0, F.aggregate("pair", F.lit(0.0), lambda a, x: a + x) / F.size("pair")).otherwise(-2.0),
            "f_dictionary": F.lit(1.0) - F.length(F.regexp_replace(v, words.words, "")) / n,
            "f_path": F.regexp_count(v, F.lit("[/.]")).cast("double"),
            "f_file": v.rlike(FILE_END).cast("double"),
            "f_for": around.rlike(SPEAKS_FOR).cast("double"),
            "f_against": around.rlike(SPEAKS_AGAINST).cast("double"),
            "f_assigned": around.rlike(r"[=:]\s*[\"']?[A-Za-z0-9_+/.\-]{16,}").cast("double"),
            "f_quoted": F.col("word").rlike(r"^[\"'`]").cast("double"),
            "f_vowels": share(r"[aeiouAEIOU]"),
            "f_dashes": F.regexp_count(v, F.lit("[-_]")).cast("double"),
            "f_named": F.col("after").rlike(MAYBE_NAMED).cast("double"),
        }
    )


def labelled_findings(rows: int = 1_600, seed: int = 11, vocab_path: str | None = None) -> list[tuple[str, int]]:
    """Labelled findings made by rule: ``(text, 1)`` holds a secret as its longest candidate, ``(text, 0)`` none."""
    rng = random.Random(seed)
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    words = language(vocab_path).words.removeprefix("(?i)").split("|")
    syllables = ["the", "con", "ver", "ta", "re", "mi", "lo", "gen", "tor", "in", "ous", "ble", "str", "ank"]

    def of(chars: str, lo: int, hi: int) -> str:
        return "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))

    def made() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def word() -> str:
        return rng.choice(words) if rng.random() < 0.5 else made()

    def positive() -> str:
        name = rng.choice(["token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret", "pin", "pass", word()])
        if rng.random() < 0.3:
            name = rng.choice([f"{word()}_{name}", f"{word()}_{word()}_{name}", f"{name}_{word()}_{word()}", f"{word()}-{word()}-{name}"])
        value = rng.choice(
            [
                lambda: of(hexes, 28, 64), lambda: of(mixed, 20, 48), lambda: "AKIA" + of(string.ascii_uppercase + string.digits, 16, 16), lambda: "ghp_" + of(mixed, 36, 36), lambda: "sk-" + of(mixed, 32, 48),
                lambda: of(mixed + "+/", 40, 40) + "=", lambda: of(string.ascii_letters, 20, 40), lambda: of(string.ascii_lowercase, 20, 40), lambda: ".".join(of(mixed + "-_", 20, 40) for _ in range(3)),
            ]
        )()
        return rng.choice([f'{name} = "{value}"', f"{name}={value}", f"{name}: {value}", f"Authorization: Bearer {value}", f'"{name}": "{value}",', f"export {name.upper()}={value}", f"https://{made()}.com/{made()}?{name}={value}", f"{name} is {value}"])

    def negative() -> str:
        joined = lambda sep, k: sep.join(word() for _ in range(k))
        return rng.choice(
            [
                lambda: "commit " + of(hexes, 40, 40),
                lambda: "sha256 checksum " + of(hexes, 64, 64),
                lambda: "id " + "-".join(of(hexes, k, k) for k in (8, 4, 4, 4, 12)),
                lambda: joined("/", 4) + f"/v{rng.randint(1, 9)}/index{rng.randint(1, 99)}.html",
                lambda: rng.choice(["", ".", "/", "//", "~/"]) + joined("/", rng.randint(2, 5)) + rng.choice(["", str(rng.randint(1, 99)), f"/{word()}{rng.randint(1, 99)}/index"]),
                lambda: f"https://{word()}.{rng.choice(['com', 'org', 'io'])}/" + joined(rng.choice("/-_"), 4),
                lambda: f"{joined('_', 3)}{rng.choice(['=', ': ', ' = ', ':'])}{rng.choice([word(), of(string.digits, 1, 6), 'true'])}",
                lambda: f"{joined('_', 2).upper()}_{rng.choice(['SECRET', 'TOKEN', 'PASSWORD', 'API_KEY'])}: {word()}",
                lambda: of(string.digits, 16, 19),
                lambda: joined("_", 3) + f"{rng.randint(1, 999)}_{word()}",
                lambda: f"{word()}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com",
                lambda: f"https://www.{word()}{word()}.com/{word()}/{rng.randint(1000, 99999)}",
                lambda: 'token = "your_token_here_' + of(string.digits, 3, 5) + '"',
                lambda: 'api_key = "example-' + of("x0", 16, 24) + '"',
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:00:00.{rng.randint(100, 999)}",
                lambda: "".join(word() for _ in range(4)) + f".{rng.randint(10, 99)}",
                lambda: "".join(word() for _ in range(rng.randint(3, 6))),
                lambda: "".join(made() for _ in range(rng.randint(3, 6))),
                lambda: "".join(word().capitalize() for _ in range(rng.randint(3, 6))),
                lambda: joined(rng.choice("_-."), rng.randint(3, 5)),
                lambda: rng.choice("-_=.") * rng.randint(16, 40),
                lambda: rng.choice(["token", "password", "key"]) + " = " + joined(rng.choice("_."), 4),
                lambda: of("abc", 1, 1) * rng.randint(16, 40),
            ]
        )()

    out = []
    for i in range(rows):
        label = i % 2
        body = positive() if label else negative()
        out.append((f"{made()} {made()} {body} {made()} {made()}", label))
    return out


def _once(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` behind a generator of one row, so that a filter on them stays above it and none is computed twice."""
    return rows.select(F.explode(F.array(F.struct(*columns))).alias("once")).select("once.*")


def train(spark: SparkSession, labelled: DataFrame | None = None, vocab_path: str | None = None) -> Column:
    """The forest's vote as a column over ``FEATURES``, fitted on at most ``MAX_LABELLED`` findings.

    ``labelled`` has columns ``text`` and ``secret`` (0 or 1); each row's longest candidate that no colon follows
    is its finding, or else its longest.
    """
    if labelled is None:
        if vocab_path not in _BY_RULE:
            made = spark.createDataFrame(labelled_findings(vocab_path=vocab_path), "text string, secret int")
            _BY_RULE[vocab_path] = _fitted(spark, made, vocab_path)
        return as_column(_BY_RULE[vocab_path], FEATURES)
    return as_column(_fitted(spark, labelled, vocab_path), FEATURES)


#: The forest of the table made by rule, which is always the same.
_BY_RULE: dict[str | None, list] = {}


def _fitted(spark: SparkSession, labelled: DataFrame, vocab_path: str | None) -> list:
    rows = labelled.where("text is not null and secret is not null").select("text", F.col("secret").cast("int").alias("secret")).orderBy(F.xxhash64("text"), "text").limit(MAX_LABELLED)
    held = [(i, r.text, r.secret) for i, r in enumerate(rows.collect())]  # bounded by MAX_LABELLED
    numbered = spark.createDataFrame([(i, t) for i, t, _ in held], "doc_id long, text string")
    described = _once(features(candidates(numbered), language(vocab_path)), "doc_id", "word_no", "nth", F.length("value").alias("length"), *FEATURES)
    first = F.struct(F.col("f_named") == 0, "length", "word_no", "nth")
    found = described.groupBy("doc_id").agg(F.max_by(F.struct(*FEATURES), first).alias("f")).select("doc_id", "f.*").orderBy("doc_id").collect()
    secret = {i: s for i, _, s in held}
    x, y = np.array([[r[c] for c in FEATURES] for r in found], dtype=float), np.array([secret[r.doc_id] for r in found])
    return fit_forest(x, y)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None) -> DataFrame:
    """``doc_id, word_no, value, score``: the candidates that the forest takes for secrets.

    ``word_no`` counts the pieces between white space from 0; a word gives a row for each of its secrets, each
    candidate being a longest run of its characters, so none overlap and no tie arises. What stands before ``=``, or
    before ``:`` and more, names a value and is never returned. Texts of any length
    are read whole, in one row. Null or empty texts have no candidates; a null id stays null; repeated rows
    give repeated findings; an empty table gives none. Only the two columns named are read.
    """
    vote = train(docs.sparkSession, labelled, vocab_path)
    found = _once(features(candidates(texts(docs, id_col, text_col)), language(vocab_path)), "doc_id", F.col("word_no").cast("long").alias("word_no"), "value", *FEATURES)
    judged = _once(found, "doc_id", "word_no", "value", F.round(vote, 6).alias("score"))
    return judged.where(F.col("score") >= threshold)
