"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Of all ways to cut a word into tokens, merging by rank reaches exactly one, and that one has a property
that can be tested locally: every two neighbouring tokens, encoded together, stay these two. So for every
prefix there is one last token: a token that ends there, whose prefix before it has a last token that
is compatible with it. The table of last tokens is filled from left to right, trying the tokens that
end at a byte as the vocabulary's automaton reports them over its suffix links, longest first; the ids
are read off by following the table back from the end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, schema_of, slices, texts, vocabulary
from .encode import byte_letters, kept_for_worker

ENCODED = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Segments and token pairs kept per Python worker, the first met. It bounds memory only.
CACHE_ENTRIES = 800_000


class PrefixEncoder:
    def __init__(self, spec: str, cache_entries: int = CACHE_ENTRIES):
        import ahocorasick
        import regex

        model = json.loads(spec)
        self._check(model)
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = {t: i for t, i in model["model"]["vocab"].items() if all(c in to_byte for c in t)}
        self.bytes_of = [b""] * (max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.single = [vocab[c] for c in byte_letters()]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.bytes_by_name = {str(i): b for i, b in enumerate(self.bytes_of)}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.automaton.make_automaton()
        self.limit = cache_entries
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.inner: dict[str, str] = {}

    @staticmethod
    def _check(model: dict) -> None:
        """Refuse a tokenizer file that asks for other rules than those followed here: its ids would be wrong."""
        before, rules = model["pre_tokenizer"] or {}, model["model"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        pairs = rules.get("type", "BPE") == "BPE" and not any(rules.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = all(not t[x] for t in model["added_tokens"] for x in ("single_word", "lstrip", "rstrip"))
        if model.get("normalizer") or not (plain and pairs and added):
            raise ValueError("the vocabulary is no plain byte-level BPE: only the byte-level pre-tokenizer without a prefix space, no normalizer and merges by rank are followed")

    def _merged(self, data: bytes) -> list[int]:
        """Merging by rank, the definition; it decides pairs of tokens, never whole words."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            rank, at, new = min(((*self.merges[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges), default=(None, 0, 0), key=lambda m: (m[0], m[2]))
            if rank is None:
                break
            ids[new : new + 2] = [at]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        ok = self.pairs.get((left, right))
        if ok is None:
            ok = self._merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.pairs) < self.limit:
                self.pairs[left, right] = ok
        return ok

    def stands(self, token: int) -> bool:
        ok = self.alone.get(token)
        if ok is None:
            ok = self.alone[token] = self._merged(self.bytes_of[token]) == [token]
        return ok

    def word(self, data: bytes) -> list[int]:
        n = len(data)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        at, done = -1, False
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            if end != at:
                at, done = end, False
            if done:
                continue
            before = end + 1 - length
            if self.stands(token) if before == 0 else last[before] >= 0 and self.compatible(last[before], token):
                last[end + 1], size[end + 1] = token, length
                done = True
        out = []
        while n:
            if last[n] < 0:
                raise ValueError("a prefix has no last token: the vocabulary lacks a byte")
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def _piece(self, text: str) -> list[int]:
        ids: list[int] = []
        for w in self.words(text):
            known = self.known.get(w)
            if known is None:
                known = self.word(w.encode())
                if len(self.known) < self.limit // 8:
                    self.known[w] = known
            ids += known
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``; the strings of special tokens become their ids."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self._piece(text)
        ids: list[int] = []
        for part in self.cut_special.split(text):
            ids += [self.special[part]] if part in self.special else self._piece(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Bytes of the tokens in order, as UTF-8; what isn't valid becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _segment(self, piece: str) -> str:
        """The ids of a space and ``piece``, joined by commas; empty if they depend on the text around."""
        if not piece or piece[0].isspace() or any(s in piece for s in self.special):
            return ""
        return ",".join(map(str, self._piece(" " + piece)))

    def joined(self, text: str) -> str:
        """The ids of ``text`` joined by commas, by segments met before where that is exact.

        The pattern always cuts before a single space between visible characters, so segments there are
        encoded alike alone and in place.
        """
        head, *rest = text.split(" ")
        get, parts = self.inner.get, [",".join(map(str, self._piece(head)))]
        exact = bool(head) and not any(s in head for s in self.special)
        for p in rest if exact else ():
            found = get(p)
            if found is None:
                found = self._segment(p)
                if len(self.inner) < self.limit:
                    self.inner[p] = found
            if not found:
                exact = False
                break
            parts.append(found)
        return ",".join(parts) if exact else ",".join(map(str, self.encode(text)))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids joined by commas, and the text decoded from those ids."""
        ids = self.joined(text)
        tokens = ids.split(",") if ids else []
        return len(tokens), ids, b"".join(map(self.bytes_by_name.__getitem__, tokens)).decode("utf-8", "replace")


def _encode_batches(spec: str):
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept_for_worker(PrefixEncoder, spec)
        for b in slices(batches):
            yield batch_of(out, [b.column(0).to_pylist(), [enc.encode(t) for t in b.column(1).to_pylist()]])

    return run


def _digest_batches(spec: str):
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept_for_worker(PrefixEncoder, spec)
        for b in slices(batches):
            rows = [enc.digest(t) for t in b.column(1).to_pylist()]
            yield batch_of(out, [b.column(0).to_pylist(), [r[0] for r in rows], [hashlib.sha256(r[1].encode()).hexdigest() for r in rows], [hashlib.sha256(r[2].encode()).hexdigest() for r in rows]])

    return run


def encode(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row, in one pass without a shuffle.

    Null or empty text gives an empty list; a null id stays null; repeated rows give repeated rows; an
    empty table gives none. Columns other than the two named are not read.
    """
    return texts(docs, id_col, text_col).mapInArrow(_encode_batches(vocabulary(vocab_path)), schema_of(ENCODED))


def decode(encoded: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` for rows of ids; null or empty ids give the empty text."""
    spec = vocabulary(vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept_for_worker(PrefixEncoder, spec)
        for b in slices(batches):
            yield batch_of(pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), [b.column(0).to_pylist(), [enc.decode(x or []) for x in b.column(1).to_pylist()]])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text, and return counts and digests of ids and decoded text.

    Null text is empty and has no ids; a null id stays null; repeated rows give repeated rows; an empty table
    gives none. Texts of any length are encoded whole. A vocabulary of other rules than plain byte-level
    pairs raises an error. Only the two columns named are read.
    """
    return texts(docs, id_col, text_col).mapInArrow(_digest_batches(vocabulary(vocab_path)), schema_of(DIGESTS))
