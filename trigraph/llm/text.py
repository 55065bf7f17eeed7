"""Words of forum posts with their places, markup left out."""

from __future__ import annotations

import re
from array import array

#: What may follow the word of a tag in brackets; anything else makes it ordinary text.
_REST = r"(?:\s*+=[^\[\]]*+|\s++[\w-]++=[^\[\]]*+|\s*+/?)\]"
#: Markup of any length. Each piece stops at the next bracket and never gives anything back, so time is linear.
_MARKUP = re.compile(
    r"</?[A-Za-z][^<>\r\n]*+>"
    r"|</?[A-Za-z][\w:-]*+(?:\s++[\w:-]++=(?:\"[^\"<>]*+\"|'[^'<>]*+'))*+\s*+/?>"
    r"|\[(?P<b>img|video|media)" + _REST + r"[^\[\]]*+\[/(?P=b)\]"
    r"|\[/?(?:b|i|u|s|quote|code|url|img|size|color|colour|list|li|center|spoiler|hr|\*)" + _REST +
    r"|&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});"
    r"|\bhttps?://[^\s\[\]<>\"]*+",
    re.S | re.I,
)
#: What opens a stretch that ends at a mark of its own, and that mark.
_OPENS = re.compile(r"<!--|<(script|style)\b[^<>]*+>", re.I)
_CLOSES = {"": re.compile("-->"), "script": re.compile(r"</script\s*+>", re.I), "style": re.compile(r"</style\s*+>", re.I)}
_WORD = re.compile(r"[^\W_]+")


def _blank(piece: str) -> str:
    return "\n" + " " * (len(piece) - 1) if piece[0] == "<" else " " * len(piece)


def _without_hidden(text: str) -> str:
    """Comments, scripts and styles blanked. An opening without its end is left; the end is looked for once."""
    out, at, unclosed = [], 0, set()
    for m in _OPENS.finditer(text):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in unclosed:
            continue
        end = _CLOSES[kind].search(text, m.end())
        if end is None:
            unclosed.add(kind)
            continue
        out += [text[at : m.start()], _blank(text[m.start() : end.end()])]
        at = end.end()
    return "".join([*out, text[at:]]) if out else text


def blank_markup(text: str) -> str:
    """``text`` with its markup blanked to the same length, so that places stay places in the original."""
    if "<!--" in text or "</" in text:
        text = _without_hidden(text)
    if "<" in text or "[" in text or "&" in text or "://" in text:
        return _MARKUP.sub(lambda m: _blank(m[0]), text)
    return text


def words_with_places(text: str | None) -> tuple[list[str], array, array]:
    """Lower-case words, their starts and their ends in ``text``."""
    words: list[str] = []
    starts, ends = array("q"), array("q")
    if text:
        for m in _WORD.finditer(blank_markup(text)):
            words.append(m[0].lower())
            starts.append(m.start())
            ends.append(m.end())
    return words, starts, ends


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(blank_markup(text))] if text else []
