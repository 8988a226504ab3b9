"""Quick folding of characters that look like others, for operators that only need to read a text.

The canonical forms of problem 2 come from ``lookalike``; this module holds the tables both share.
"""

from __future__ import annotations

import re
import unicodedata

#: Characters that do not show.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤︎️﻿᠋᠌᠍"

#: Letters of other scripts drawn like Latin ones, as pairs.
CYRILLIC_GREEK = (
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ҮY ѵv ЗЗ гг ԌG ӏl ԚQ ԜW Ѵv ёë їï "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv αa ρp υu ιi κk ϲc ϳj Ϲc ͿJ ɡg ɩi ɑa ⅼl ⅰi ⅴv ⅹx ⅽc ⅾd ⅿm ⲟo ꓲI օo ոn ցg հh ѐè"
)

LATIN_LOOK = {ord(p[0]): p[1] for p in CYRILLIC_GREEK.split() if len(p) == 2 and p[0] != p[1]}
LATIN_LOOK[0x03F9], LATIN_LOOK[0x0474] = "C", "V"


def _wide() -> dict[int, str]:
    """Full-width, half-width, mathematical, circled-free and presentation forms: single characters whose
    compatibility form only changes width or joining, from the character database."""
    out = {}
    for block in (range(0xFF01, 0xFFEF), range(0xFB00, 0xFB07), range(0xFB50, 0xFE00), range(0xFE70, 0xFEFD), range(0x1D400, 0x1D800)):
        for c in block:
            if (form := unicodedata.normalize("NFKC", chr(c))) != chr(c) and len(form.strip()) == len(form):
                out[c] = form
    for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]:
        out[c] = " "
    return out


WIDE = _wide()
FOLD = WIDE | LATIN_LOOK | {ord(c): "" for c in INVISIBLE}
_TO = {chr(c): to for c, to in FOLD.items()}
_ANY = re.compile("[" + "".join(re.escape(c) for c in _TO if c < "\U00010000") + "]")  # a class that holds more is slow
_ASTRAL = re.compile("[\U0001d400-\U0001d7ff]")


def quick_fold(text: str) -> str:
    """The text as it is read: wide forms narrowed, look-alikes Latin, what does not show left out; NFC."""
    if text.isascii():
        return text
    text = _ANY.sub(lambda m: _TO[m.group()], text)
    if _ASTRAL.search(text):
        text = _ASTRAL.sub(lambda m: _TO.get(m.group(), m.group()), text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


#: Characters that quick_fold leaves out or takes apart.
RESIZED = re.compile("[" + "".join(re.escape(c) for c, to in _TO.items() if c < "\U00010000" and len(to) != 1) + "]")


def keeps_places(text: str) -> bool:
    """Whether quick_fold surely gives a character for each character: nothing is left out, parted or composed."""
    return text.isascii() or not (RESIZED.search(text) or _ASTRAL.search(text)) and unicodedata.is_normalized("NFC", _ANY.sub(lambda m: _TO[m.group()], text))


def resized(m: re.Match[str]) -> str:
    """What stands for a character that ``RESIZED`` finds."""
    return _TO[m.group()]
