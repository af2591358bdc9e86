"""The pre-tokens and vocabulary of a word-end byte-pair tokenizer file (a .json of the tokenizers library)."""

from __future__ import annotations

import json
import re
import unicodedata

import regex

#: The tokenizer file's split pattern.  Its white space is dropped; specials are found in the raw text before all else.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"

_words = regex.compile(PRETOKEN).findall
#: The same pattern for lower-cased texts of Latin letters alone, which the standard library's faster matcher can hold as ranges.
_BEYOND = re.compile("[^\x00-\u024f]").search
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+"
_latin, _latin_lines, _lines = re.compile(_LATIN).findall, re.compile(_LATIN + "|\n").findall, regex.compile(PRETOKEN + r"|\n").findall


def normalise(text: str) -> str:
    """NFC and lower case, character by character (no final-sigma rule)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text or "İ" in text:
            return "".join(c.lower() for c in text)
    return text.lower()


def pretokens(text: str) -> list[str]:
    text = normalise(text)
    return _words(text) if _BEYOND(text) else _latin(text)


def pretokens_of_each(words: list[str]) -> list[str]:
    """The pre-tokens of all words, which hold no line feed; a line feed stands after those of each word."""
    text = normalise("\n".join([*words, ""]))
    return _lines(text) if _BEYOND(text) else _latin_lines(text)


class Vocabulary:
    """Ids by byte string, with the merges' ranks; the last byte of a word is a symbol of its own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.end = spec["model"]["end_of_word_suffix"]

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(self.end) and token != self.end
            raw = [back[c] for c in (token[: -len(self.end)] if last else token)]
            return tuple(raw[:-1]) + (raw[-1] + 256 * last,)

        self.ids = {symbols(t): i for t, i in spec["model"]["vocab"].items()}
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[symbols(a), symbols(b)] = rank
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)").split
        self.longest = max(map(len, self.ids))

    def encode(self, word: tuple[int, ...]) -> list[tuple[int, ...]]:
        """The tokens of one word by its merges: the lowest rank first, leftmost among equals."""
        parts = [(s,) for s in word]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts
