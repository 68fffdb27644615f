"""The words that a BPE model with word ends sees in a text, as its tokenizer file states them.

A text is brought to NFC, white space becomes a space, letters are lowered one code point at a time, and the pattern
below picks words; all else is dropped. Each word is encoded on its own, so equal words share one encoding.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

# The tokenizer file's own pattern, its special tokens and its sign for the end of a word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_WORD = regex.compile(PATTERN)
#: The same words by the standard library, which is faster; its letters hold some numbers, and its space some controls.
_FAST = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
_NOT_FAST = regex.compile(r"[\x1c-\x1f\p{Nl}\p{No}]")
#: Blocks in which Unicode's releases agree on letters, digits, space and case. A text with any other code point is
#: split by the tokenizers library itself, whose release may differ from this interpreter's.
_OTHER = regex.compile("[^\\x00-\u0557\u0590-\u06ff\u2010-\u205f\u3000-\u33ff\u4e00-\u9fff\uac00-\ud7a3]")


def byte_letters() -> list[str]:
    """Byte-level BPE writes each byte as one visible letter: printable bytes as themselves, others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def normalized(text: str) -> str:
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # str.lower() turns a sigma at a word's end into another letter than a lone sigma
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def words_of(text: str) -> list[str]:
    """Words of a text of the agreed blocks."""
    low = normalized(text)
    return (_WORD if _NOT_FAST.search(low) else _FAST).findall(low)


class Vocabulary:
    """The tables of a tokenizer file: ids, merge ranks, special tokens."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["end_of_word_suffix"] != WORD_END or model.get("continuing_subword_prefix"):
            raise ValueError(f"not a BPE file with word ends: {path}")
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {m: i for i, m in enumerate(merges)}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.number = self.ids | self.special
        self.names = {i: t for t, i in self.number.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens: (part, is special). They are found in the raw text, before it is lowered."""
        if not self.cut or "<" not in text:
            return [(text, False)]
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def words(self, text: str) -> list[str]:
        """The words of any text."""
        if text.isascii() or not _OTHER.search(text):
            return words_of(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._bytes = {c: b for b, c in enumerate(byte_letters())}
        t = self._library
        said = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))
        return [bytes(self._bytes[c] for c in w).decode("utf-8") for w, _ in said]
