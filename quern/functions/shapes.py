"""Letters of one shape: which code points print like a Latin letter."""

from __future__ import annotations

import unicodedata
from functools import cache

# Letters whose usual shape equals that of a Latin letter, by that letter.
SAME_SHAPE = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "ΗНᎻ",
    "I": "ΙІӀᏆ", "J": "ЈᎫ", "K": "ΚКᏦ", "L": "Ꮮ", "M": "ΜМᎷ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ",
    "Q": "Ԛ", "R": "ᎡᏒ", "S": "ЅՏᏚ", "T": "ΤТᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ",
    "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іιɩ", "j": "јϳ", "k": "κ",
    "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "νѵ", "w": "ԝա",
    "x": "хχ", "y": "уүγ",
}


@cache
def read_as_latin() -> dict[int, str]:
    """Lower-case letters by code point that a reader takes for a Latin one, for ``str.translate``.

    Besides letters of the same shape: lower-case forms of capitals of the same shape, and letters that
    Unicode names small capitals or script forms of a Latin letter.
    """
    out = {ord(ch): latin for latin, alike in SAME_SHAPE.items() if latin.islower() for ch in alike}
    for latin, alike in SAME_SHAPE.items():
        for ch in alike:
            out.setdefault(ord(ch.lower()), latin.lower())
    for cp in [*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0x2100, 0x2150), *range(0xA720, 0xA800)]:
        name = unicodedata.name(chr(cp), "")
        for start in ("LATIN LETTER SMALL CAPITAL ", "LATIN SMALL LETTER SCRIPT ", "SCRIPT SMALL "):
            if name.startswith(start) and len(name) == len(start) + 1:
                out.setdefault(cp, name[-1].lower())
    return {cp: latin for cp, latin in out.items() if cp > 0x7F}
