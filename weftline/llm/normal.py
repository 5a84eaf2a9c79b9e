"""Words of a text regardless of how they are written."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like a Latin letter, and that letter.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
_FOLD = str.maketrans(_LOOKALIKES)
# A short tag may hold anything; a longer one must read as a name with attributes, as words between angle marks may
# be text. No attempt goes past the next angle mark, so that many open ones take no longer.
_ATTRIBUTE = r"""\s+[^\s=<>"']++(?:\s*=\s*(?:"[^"<]*+"|'[^'<]*+'|[^\s"'<>]++))"""
TAG = rf"""<[/!]?[A-Za-z](?:[^\s<>"'=]*+{_ATTRIBUTE}(?:{_ATTRIBUTE}?)*+\s*+/?>|[^<>]{{0,400}}+>)"""
_TAG = re.compile(TAG)
_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|table|h[1-6]|hr|section|article)\b", re.I)
# a word cut at the end of a line; the next line may begin with a quote mark
_HYPHEN = re.compile(r"(?<=\w)[-‐‑]\s*\n[\s>]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[̀-ͯ᪰-᫿⃐-⃿]")
_UNSEEN = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")


def without_comments(text: str) -> str:
    """The text without markup comments; one that isn't closed is left."""
    out, pos = [], 0
    while (i := text.find("<!--", pos)) >= 0 and (j := text.find("-->", i + 4)) >= 0:
        out.append(text[pos:i])
        pos = j + 3
    return "".join([*out, text[pos:]])


def flatten(text: str) -> str:
    """The text without markup, in one character form and case, with look-alike letters folded."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(lambda m: " " if _BLOCK_TAG.match(m.group()) else "", without_comments(text))
    if not text.isascii():
        text = _UNSEEN.sub("", text)
        text = unicodedata.normalize("NFKC", text)
    text = _HYPHEN.sub("", text)
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text)).translate(_FOLD)
    return text


def words(text: str | None) -> list[str]:
    return _WORD.findall(flatten(text)) if text else []


# what is never split between two words: a comment, a tag, a word cut at the end of a line, other visible characters
_PIECE = re.compile(rf"(?:<!--.*?-->|{TAG}|(?<=\w)[-‐‑]\s*\n[\s>]*(?=\w)|\S)+", re.S)


def places(text: str) -> list[tuple[int, int]]:
    """Where each of :func:`words` stands in the text: the characters of the stretch between blanks that holds it.

    A stretch that doesn't give the words that come next is taken with those after it.
    """
    whole, out, start = words(text), [], None
    for m in _PIECE.finditer(text):
        start = m.start() if start is None else start
        got = words(text[start : m.end()])
        if whole[len(out) : len(out) + len(got)] == got:
            out.extend([(start, m.end())] * len(got))
            start = None
    return out + [(len(text) if start is None else start, len(text))] * (len(whole) - len(out))
