"""Byte-pair counts and ids for the public vocabularies, cached by white-space piece.

``tokenizers`` merges every occurrence of a word anew once its small cache is full. Here a text is cut
at places where no pre-token can span, and every distinct piece is encoded once per worker. The
merging itself runs in ``tiktoken``, which merges the adjacent pair whose *concatenation* ranks
lowest, while a merge list names the *pair*. The two agree whenever each vocabulary entry, encoded
alone, ends as itself by its own rule: let the runs diverge first at parts x, y whose concatenation
is the entry w. Nothing crossed the ends of w before, so inside w the run went as it does for w
alone, which passes through two parts once, by its own rule; x, y is that rule. ``proven`` checks the
condition with the library, entry by entry, and ``tests/llm`` keeps it checked.

Only characters below U+0250 (less a few with special case or space rules) take this way: all else
goes through the library itself, so other Unicode versions can't change a result.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Most pieces that a worker keeps; about 120 bytes each. A full cache is emptied, results don't depend on it.
CACHE = 64_000
#: Outside of this set a piece is left to the library. \x1c-\x1f, \x85 and \xa0 are spaces to some engines only; U+0130 grows in lower case.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ɏ]")


def vocabulary(name: str) -> str:
    """Path of a vocabulary: a path as given, or a name that ``public_tokenizers`` knows."""
    import os

    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=8)
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(path))
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, as a map back to the byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> tuple[dict[bytes, int], dict[int, int]]:
    """Mergeable ranks of a merge list, and from rank to id. The end-of-word mark becomes byte 255, which UTF-8 never holds."""
    spec = json.load(open(vocabulary(path), encoding="utf-8"))["model"]
    end, back = spec.get("end_of_word_suffix") or "", byte_letters()

    def raw(s: str) -> bytes:
        marked = bool(end) and s.endswith(end)
        return bytes(back[c] for c in (s[: -len(end)] if marked else s)) + b"\xff" * marked

    vocab = spec["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["merges"]]
    singles = sorted((s for s in vocab if len(raw(s).rstrip(b"\xff") or b"\xff") == 1 and s not in set(merged)), key=lambda s: (len(raw(s)), raw(s)))
    order: dict[bytes, int] = {bytes([b]): b for b in range(256)}
    ids = {order[raw(s)]: vocab[s] for s in singles if len(raw(s)) == 1}
    for s in [x for x in singles if len(raw(x)) > 1] + merged:
        if raw(s) not in order:
            order[raw(s)] = len(order)
            ids[order[raw(s)]] = vocab[s]
    return order, ids


@functools.lru_cache(maxsize=4)
def core(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks(path)[0], special_tokens={})._core_bpe


def proven(path: str, texts: list[str]) -> list[bool]:
    """Which of these vocabulary strings the library encodes, alone, as exactly one token that is itself."""
    t = library(path)
    return [len(e.ids) == 1 and e.ids[0] == t.token_to_id(s) for s, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True)]


class Pieces(dict):
    """From a piece of text to what it encodes as; a missing piece is encoded and, within bounds, kept."""

    def __init__(self, encode, most: int = CACHE) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str):
        if len(self) >= self.most:
            self.clear()
        got = self.encode(piece)
        if len(piece) <= 64:
            self[piece] = got
        return got


# --- lower-cased words with an end mark -------------------------------------------------------------

#: What this vocabulary's pre-tokeniser finds, for characters that _PLAIN lets pass, already in lower case.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\\s0-9a-zªµºß-öø-ɏ²³¹¼-¾]+")
_OPENS = "<|"


class WordIds:
    """Ids of a lower-casing word vocabulary as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str = "word_bpe_49k.json") -> None:
        self.lib, self.core = library(path), core(path)
        self.ids = {r: i.to_bytes(4, "little") for r, i in ranks(path)[1].items()}
        self.pieces = Pieces(self._piece)

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return b"".join([self.ids[r] for r in self.core.encode_single_piece(piece.encode() + b"\xff")])
        words = _WORDS.findall(piece)
        if words == [piece]:
            return b"".join([self.ids[r] for r in self.core.encode_single_piece(piece.encode() + b"\xff")])
        return b"".join([self.pieces[w] for w in words])

    def __call__(self, text: str) -> bytes:
        if _PLAIN.search(text) or _OPENS in text:
            return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))


# --- byte-level pre-tokens --------------------------------------------------------------------------

_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼-¾]+| ?[^\\s0-9A-Za-zªµºÀ-ÖØ-öø-ɏ²³¹¼-¾]+|\\s+(?!\\S)|\\s+")
_UNSAFE = re.compile(r"\s ")
_CUTS = re.compile(r"(?<=\S) (?=\S)")


@functools.lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and one token when they stand alone, proven by the library.

    A string counts only if it is valid UTF-8 of the plain characters, so that any text in which it is
    a pre-token encodes that pre-token the same way: byte-level pre-tokens are merged independently.
    """
    spec, back = json.load(open(vocabulary(path), encoding="utf-8"))["model"]["vocab"], byte_letters()
    found = []
    for s, i in spec.items():
        try:
            text = bytes(back[c] for c in s).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if not _PLAIN.search(text) and _TOKENS.findall(text) == [text]:
            found.append((text, i))
    got = library(path).encode_batch([t for t, _ in found], add_special_tokens=False)
    return frozenset(t for (t, i), e in zip(found, got, strict=True) if e.ids == [i])


class ByteCounts:
    """Token counts of a byte-level vocabulary: whole tokens are counted, only the rest is merged."""

    def __init__(self, path: str = "byte_bpe_50k.json") -> None:
        self.lib, self.core, self.whole = library(path), core(path), whole_tokens(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.pieces = Pieces(self._piece)

    def _piece(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        tokens = _TOKENS.findall(piece)
        if tokens == [piece]:
            return len(self.core.encode_single_piece(piece.encode()))
        return sum([self.pieces[t] for t in tokens])

    def __call__(self, text: str) -> int:
        if _PLAIN.search(text) or any(s in text for s in self.special):
            return len(self.lib.encode(text, add_special_tokens=False).ids)
        # A space between two other characters always starts a pre-token; of several spaces only the last can.
        first, *rest = _CUTS.split(text) if _UNSAFE.search(text) else text.split(" ")
        return self.pieces[first] + sum(map(self.pieces.__getitem__, [" " + x for x in rest]))


@functools.lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@functools.lru_cache(maxsize=4)
def byte_counts(path: str) -> ByteCounts:
    return ByteCounts(path)
