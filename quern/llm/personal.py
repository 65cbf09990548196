"""Personal information inside free text: find it, and replace it with typed placeholders.

A text is first normalised: look-alike letters, widths, kinds of space and dash, code points that
show nothing, and runs of spelled-out digits become plain characters, and each plain character
remembers where it came from. Identifiers are found in the plain text, in which an address may
also be written with (at) and [dot], and their spans are mapped back, so that only the characters
of the identifier itself change.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.lookalikes import apart, shows_nothing

TYPES = ("email", "phone", "national_id", "street_address", "person_name")
MOST_NAMES = 1_000_000  # a lexicon beyond this is refused, as every worker holds it

# Digits in words.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_word = "|".join(sorted(SPELLED, key=len, reverse=True))
SPELLED_RUN = re.compile(rf"(?i)\b(?:{_word})(?:[ ,-]{{1,2}}(?:{_word})){{5,14}}\b")
SPELLED_WORD = re.compile(rf"(?i){_word}")


def may_be_spelled(low: str) -> bool:
    """Whether a lower-case text has enough words of digits for a run. The first and last of a run may touch other signs."""
    return sum(map(SPELLED.__contains__, low.replace("-", " ").replace(",", " ").split())) >= 4



# --- patterns over normalised text ---------------------------------------------------------------
AT_WORDS, BARE_AT_WORDS, DOT_WORDS = ("at", "ät", "arroba", "arobase"), ("at", "arroba", "arobase"), ("dot", "punkt", "point", "punto")
_any_at, _bare_at, _any_dot = "|".join(AT_WORDS), "|".join(BARE_AT_WORDS), "|".join(DOT_WORDS)
_at = rf"(?:[ ]?@[ ]?|[ ]?[\[({{<][ ]?(?:{_any_at})[ ]?[\])}}>][ ]?|[ ](?:{_bare_at})[ ](?=[\w-]+[ ](?:{_any_dot})[ ]))"
_dot = rf"(?:\.|[ ]?[\[({{<][ ]?(?:{_any_dot})[ ]?[\])}}>][ ]?|[ ](?:{_any_dot})[ ])"
EMAIL = re.compile(
    rf"(?i)(?<![\w.+%-])(?P<local>[a-z0-9][\w.+%'-]{{0,63}}){_at}(?P<host>[a-z0-9][a-z0-9-]{{0,62}}(?:{_dot}[a-z0-9][a-z0-9-]{{0,62}}){{0,6}}{_dot}(?P<tld>[a-z]{{2,24}}))(?![\w-]|\.\w)"
)
AT_HINTS = ("@", *(f"{o}{gap}{w}" for o in "[({<" for gap in ("", " ") for w in AT_WORDS))
BARE_AT_HINTS, DOT_HINTS = tuple(f" {w} " for w in BARE_AT_WORDS), tuple(f" {w} " for w in DOT_WORDS)


def may_have_email(low: str) -> bool:
    """Whether a lower-case text has what stands for an @ in one of the ways of EMAIL."""
    return any(h in low for h in AT_HINTS) or any(h in low for h in DOT_HINTS) and any(h in low for h in BARE_AT_HINTS)


# Runs of digits long enough for a phone or identity number.
NUMBER_HINT = re.compile(r"\d[\d ().,/+-]{4,}\d|[A-Z]\d\d[A-Z]\d")
# Six digits among letters, as far apart as they can be in an identity number after its cue.
MIXED_HINT = re.compile(r"\d(?:(?:[ ./-]?[A-Za-z]){0,13}[ ./-]?\d){5}")
# Endings of file names, which no mail host has.
FILE_ENDINGS = {"png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "ts", "json", "md", "py", "txt", "html", "yaml", "yml", "toml", "lock", "tgz", "zip"}
LOGIN_BEFORE = re.compile(r"(?i)(?:\b(?:ssh|scp|sftp|rsync|mosh|ssh-copy-id|git clone)\b(?:[ ]+-{1,2}\S+(?:[ ]+[\w./~]+)?){0,4}[ ]+|://[^\s/\"'<>]{0,200})\Z")

PHONE = [(rx, None) for rx in [
    # international
    re.compile(r"(?<![\w+])(?:\+|00[ ])\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,5}){1,5}(?:[ ]?(?:ext\.?|x)[ ]?\d{1,6})?(?![\w]|[.,]\d)"),
    # three, three, four digits
    re.compile(r"(?<![\w.+/:-])(?<!\d[ ])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?:[ ]?(?:ext\.?|x)[ ]?\d{1,6})?(?![\w/]|[.-]\d)"),
    # trunk zero and groups
    re.compile(r"(?<![\w.+/:-])(?<!\d[ ])0\d{2,4}[ /-]\d{3,4}[ -]\d{3,4}(?![\w]|[.-]\d)"),
    re.compile(r"(?<![\w.+/:-])(?<!\d[ ])0\d(?:[ .-]\d{2}){4}(?![\w]|[.-]\d)"),
    re.compile(r"(?<![\w.+/:-])(?<!\d[ ])\(?0\d{1,4}\)?[ ]?[/-][ ]?\d{5,9}(?![\w]|[.-]\d)"),
    re.compile(r"(?<![\w.+/:-])(?<!\d[ ])[67]\d{2}[ ]\d{2}[ ]\d{2}[ ]\d{2}(?![\w]|[.-]\d)"),
    # any seven or more digits right after a word that announces a number
    re.compile(r"(?i)\b(?:tel|tél|telefon|telephone|téléphone|teléfono|phone|mobile|mobil|handy|cell|pager|fax|rückruf)\b[.:]?[ ]{0,2}(?P<v>\(?\d(?:[ ./()-]{0,2}\d){6,14})(?![\w]|[.-]\d)"),
]]
# Words that announce an identity number.
ID_CUE = (
    r"(?:ssn|social security(?: (?:no|number))?|social insurance|ni number|national insurance(?: (?:no|number))?|nir|numéro de sécurité sociale|"
    r"dni|nie|nif|steuer-?id(?:entifikationsnummer)?|steuernummer|ausweis(?:nummer|nr)?|personalausweis|passport(?: (?:no|number))?|reisepass(?:nummer)?|passeport|pasaporte|tax id|tin)"
)
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def right_letter(v: str) -> bool:
    """Whether a Spanish number ends in the letter that its digits give."""
    v = v.replace("-", "")
    return DNI_LETTERS[int(str("XYZ".find(v[0])) + v[1:-1] if v[0] in "XYZ" else v[:-1]) % 23] == v[-1]


def right_key(v: str) -> bool:
    """Whether a French number of 15 digits ends in its key; without the key it can't be told."""
    v = v.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return len(v) == 15 and v.isdigit() and 97 - int(v[:13]) % 97 == int(v[13:])


def right_digit(v: str) -> bool:
    """Whether a German tax number of 11 digits ends in its check digit."""
    d, p = [int(x) for x in v.replace(" ", "")], 10
    for x in d[:10]:
        p = ((x + p) % 10 or 10) * 2 % 11
    return d[0] > 0 and (11 - p) % 10 == d[10]


# After a word that announces one, any form counts; alone, a form that hardly anything else has, or right check digits.
NATIONAL = [
    (re.compile(rf"(?i)\b{ID_CUE}\b[.:#]{{0,2}}[ ]{{0,2}}(?:(?:no|nr|number|nummer)\b[.:]?[ ]?)?(?P<v>[A-Z]{{0,2}}[ ]?\d(?:[ ./-]?[A-Z0-9]){{5,18}}?)(?=[\s.,;:!?)\]\"']|\Z)(?![ ]\d)"), None),
    (re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w]|[.-]\d)"), None),
    (re.compile(r"(?<![\w.-])[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D](?![\w])"), None),
    (re.compile(r"(?<![\w.-])(?<!\d[ ])[1-478][ ]\d{2}[ ]\d{2}[ ]\d[\dAB][ ]\d{3}[ ]\d{3}(?:[ ]\d{2})?(?![\w]|[ ]?\d)"), right_key),
    (re.compile(rf"(?<![\w.-])(?:\d{{8}}-?[{DNI_LETTERS}]|[XYZ]-?\d{{7}}-?[{DNI_LETTERS}])(?![\w])"), right_letter),
    (re.compile(r"(?<![\w.-])(?<!\d[ ])\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}(?![\w]|[ ]?\d)"), right_digit),
]
ID_HINT = re.compile(rf"(?i)\d{{3}}-\d{{2}}-\d{{4}}|[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-D]\b|\d \d\d \d\d \d|\d\d \d{{3}} \d{{3}}|\b[XYZ]?-?\d{{7,8}}-?[A-Z]\b|{ID_CUE}")

_cap = r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’-]*"
# Words for streets, as the address patterns have them; the English and German ones in this letter case only.
STREETS_EN = "Court|Road|Lane|Blvd|Boulevard|Dr|Drive|Close|Terrace|Street|St|Avenue|Ave|Way|Place|Square|Crescent|Rd|Ct|Ln|Row|Mews|Gardens|Grove|Hill|Walk|Parkway|Pkwy|Highway|Circle"
STREETS_DE = r"straße|strasse|str\.|weg|allee|platz|gasse|ufer|damm|ring|steig|pfad"
STREETS_FR = r"rue|avenue|av\.|impasse|boulevard|bd|chemin|place|allée|quai|route|cours|square|passage"
STREETS_ES = r"avenida|avda\.?|calle|c/|plaza|paseo|camino|carrera|ronda"
ADDRESS = [
    re.compile(
        rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)[ ]\w{{1,5}},[ ])?(?<![\w.,-])(?<![.,]\d)\d{{1,5}}[A-Za-z]?[ ](?:[NSEW]\.?[ ])?(?:{_cap}[ ]){{1,3}}"
        rf"(?:{STREETS_EN})\b\.?"
        rf"(?:,[ ](?:Suite|Apt\.?|Unit|Floor|Flat)[ ]\w{{1,5}})?(?:,[ ]{_cap}(?:[ ]{_cap})?(?:[ ][A-Z]{{1,2}}\d[\dA-Z]?[ ]\d[A-Z]{{2}})?)?"
    ),
    re.compile(rf"\b{_cap}(?:{STREETS_DE})[ ]\d{{1,4}}[a-z]?\b(?:,[ ](?:D-)?\d{{5}}[ ]{_cap})?"),
    re.compile(
        rf"(?i:\b\d{{1,4}}(?:[ ]?(?:bis|ter|quater))?,?[ ](?:{STREETS_FR})[ ](?:de la |de l'|de l’|des |du |de |d'|d’)?){_cap}"
        rf"(?:[ -]{_cap})*(?:,[ ](?:\d{{5}}[ ])?{_cap}(?:-[\wÀ-ÿ]+)*)?"
    ),
    re.compile(
        rf"(?i:\b(?:{STREETS_ES})[ ]?(?:del |de la |de las |de los |de |las |los |la |el )?){_cap}(?:[ ]{_cap})*,?[ ](?:n\.?[ºo][ ]?)?\d{{1,4}}"
        rf"(?:,[ ]\d{{1,2}}\.?[ºo]?[ ]?[A-Z]?)?(?:,[ ]{_cap}(?:[ ](?:del[ ]|de[ ])?{_cap})*)?"
    ),
]
# One of these is in every address the patterns find: as written, or in lower case.
ADDRESS_HINTS = tuple(f" {w}" for w in STREETS_EN.split("|")) + tuple(f"{w} " for w in STREETS_DE.replace("\\", "").split("|"))
LOW_ADDRESS_HINTS = tuple(f" {w} " for w in STREETS_FR.replace("\\", "").split("|")) + tuple(STREETS_ES.replace("\\.?", "").split("|"))


def may_have_address(t: str) -> bool:
    """Whether a text has a street's word of ADDRESS."""
    low = t.lower()
    return any(h in t for h in ADDRESS_HINTS) or any(h in low for h in LOW_ADDRESS_HINTS)


# Forms of address before a family name.
TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herrn?|Frau|Fr|Hr|Monsieur|Madame|Mademoiselle|Mme|Mlle|M|Sra?|Srta|Señora?|Señorita|Don|Doña)"
_upper = "A-ZÀ-ÖØ-ÞŠŽŁ"
_token = rf"[{_upper}][a-zà-öø-ÿšžłA-ZÀ-ÖØ-Þ]*(?:['’][{_upper}][a-zà-ÿ]+)?(?:-[{_upper}][a-zà-öø-ÿA-ZÀ-ÖØ-Þ]+)?"
NAME_TOKEN = re.compile(rf"(?<![\w@.+/-])(?:{_token})(?![\w@/+])")
CAPITALISED = re.compile(rf"[{_upper}][a-zà-öø-ÿšžłA-ZÀ-ÖØ-Þ]+")
TITLED = re.compile(rf"(?<!\w){TITLE}\.?[ ](?P<v>(?:{_token}[ ])?{_token})(?![\w@])")


class Names:
    """Which words can be parts of names: those of a lexicon, and words built of the same pieces.

    A word is built like the lexicon's given (or family) names if all its runs of three letters,
    beginning and end included, occur in them, and it isn't an entry of two kinds.
    """

    def __init__(self, entries: list[tuple[str, str]]):
        self.known: dict[str, set[str]] = {"given": set(), "family": set()}
        for word, part in entries:
            if word and part in self.known:
                self.known[part].add(fold(word))
        self.runs = {p: {r for w in self.known[p] for r in _runs(w)} for p in self.known}
        # Beginnings and endings: of three letters, or of two that several names share.
        self.heads = {p: _shared(self.known[p], lambda w, n: w[:n]) for p in self.known}
        self.tails = {p: _shared(self.known[p], lambda w, n: w[-n:]) for p in self.known}
        # Family names whose ending no other one has are ordinary words used as names.
        ends: dict[str, int] = {}
        for w in self.known["family"]:
            ends[w[-3:]] = ends.get(w[-3:], 0) + 1
        self.plain = {w for w in self.known["family"] if ends[w[-3:]] == 1}
        self._is = lru_cache(200_000)(self._decide)
        self.parts = lru_cache(200_000)(self._parts)
        self.likely = lru_cache(200_000)(self._likely)

    def _decide(self, word: str, part: str) -> bool:
        if word in self.known[part]:
            return True
        return len(word) >= 4 and all(r in self.runs[part] for r in _runs(word))

    def is_part(self, word: str, part: str) -> bool:
        """Whether a word can be a given or a family name; both halves of a double name must be."""
        return all(self._is(fold(w), part) for w in word.split("-") if w) and len(word) > 1

    def _parts(self, word: str) -> tuple[bool, bool]:
        """Whether a word can be a given name, and whether a family name."""
        return self.is_part(word, "given"), self.is_part(word, "family")

    def _likely(self, word: str) -> tuple[bool, bool]:
        """The same, looser: a beginning and an ending of such names; enough beside another name."""
        given, family = self.parts(word)
        ok = {}
        for part in self.known:
            ok[part] = all(
                len(w) >= 4 and any(w[:n] in self.heads[part] for n in (2, 3)) and any(w[-n:] in self.tails[part] for n in (2, 3))
                for w in (fold(x) for x in word.split("-") if x)
            )
        return given or (ok["given"] and len(word) > 1), family or (ok["family"] and len(word) > 1)

    def is_plain(self, word: str) -> bool:
        """Whether a family name is an ordinary word as well."""
        return fold(word) in self.plain


def _shared(words: set[str], cut) -> set[str]:
    threes = {cut(w, 3) for w in words}
    twos: dict[str, int] = {}
    for w in words:
        twos[cut(w, 2)] = twos.get(cut(w, 2), 0) + 1
    return threes | {k for k, n in twos.items() if n >= 3}


def fold(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower()


def _runs(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


@cache
def _same_length() -> dict[int, str]:
    """Replacements of one code point by one, for texts that need no other."""
    from quern.llm.lookalikes import mapping

    out = {}
    for ch, _, one, k in mapping():
        if not k and len(one) == 1 and one != ch:
            out[ord(ch)] = one
    for dash in "‐‑‒–—−﹣－":
        out[ord(dash)] = "-"
    out[ord("＠")] = "@"
    return out


DIGIT = re.compile(r"\d")
NEEDS_MAP = re.compile(r"[̀-ͯ͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿­\U000e0000-\U000e0fff]")


def normalised(text: str) -> tuple[str, list[int] | None]:
    """Plain text, and the source position of each of its characters (None: the same positions).

    Digits in words become digits, with a plus before a run, so that it reads as a number of its own.
    """
    where = None
    if not text.isascii():
        if NEEDS_MAP.search(text):
            chars, where = [], []
            for i, ch in enumerate(text):
                if shows_nothing(ch) and ch != "\r":
                    continue
                if chars and unicodedata.combining(ch):
                    one = unicodedata.normalize("NFC", chars[-1] + ch)
                    if len(one) == 1:
                        chars[-1] = one
                        continue
                plain = unicodedata.normalize("NFC", apart(ch)) or ch
                for c in plain:
                    chars.append(c)
                    where.append(i)
            text = "".join(chars)
        text = text.translate(_same_length())
    if may_be_spelled(text.lower()) and SPELLED_RUN.search(text):
        out, src, at = [], [], 0
        for m in SPELLED_RUN.finditer(text):
            out += [text[at : m.start()], "+"]
            src += [*range(at, m.start()), m.start()]
            for w in SPELLED_WORD.finditer(m.group()):
                out.append(SPELLED[w.group().lower()])
                src.append(m.start() + w.start())
            # The last digit stands for its whole word.
            src[-1] = m.end() - 1
            at = m.end()
        out.append(text[at:])
        src += range(at, len(text))
        where = [where[i] for i in src] if where is not None else src
        text = "".join(out)
    return text, where


def _free(spans: list[tuple[int, int, str]], s: int, e: int) -> bool:
    return all(e <= a or s >= b for a, b, _ in spans)


def _emails(t: str) -> list[tuple[int, int, str]]:
    out = []
    low = t.lower()
    if may_have_email(low):
        for m in EMAIL.finditer(t):
            s, e = m.span()
            if m["tld"].lower() in FILE_ENDINGS or LOGIN_BEFORE.search(t, max(0, s - 260), s):
                continue
            # user@host:path is a clone or copy address
            if re.match(r":[\w~./-]", t[e : e + 2]) and not re.match(r":\d", t[e : e + 2]):
                continue
            out.append((s, e, "email"))
    return out


def _numbers(t: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for kind, rules, hint in (("national_id", NATIONAL, ID_HINT), ("phone", PHONE, None)):
        if hint is not None and not hint.search(t):
            continue
        for rx, right in rules:
            for m in rx.finditer(t):
                s, e = m.span("v") if "v" in rx.groupindex else m.span()
                if right is not None and not right(t[s:e]):
                    continue
                if not _free(taken, s, e) or not _free(out, s, e):
                    continue
                digits = sum(c.isdigit() for c in t[s:e])
                if kind == "phone" and not 7 <= digits <= 20 or kind == "national_id" and digits < 6:
                    continue
                out.append((s, e, kind))
    return out


def _names(t: str, names: Names, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    # Most texts have no word of this kind: their distinct capitalised words tell.
    words = {w: names.likely(w) for w in set(CAPITALISED.findall(t))}
    if not any(g or f for g, f in words.values()):
        return []
    tokens = []
    for m in NAME_TOKEN.finditer(t):
        w = m.group()
        g, f = words.get(w) or names.likely(w)
        initial = len(w) == 1
        if (g or f or initial) and _free(taken, *m.span()):
            tokens.append((m.start(), m.end(), g, f, initial, w))
    out: list[tuple[int, int, str]] = []
    for (s1, e1, g1, f1, i1, w1), (s2, e2, g2, f2, i2, w2) in zip(tokens, tokens[1:]):
        gap = t[e1:s2]
        if gap == " " or re.fullmatch(r"[ ]?\n[ ]{0,4}", gap):
            ok = (g1 and f2) or (f1 and g2 and not names.is_plain(w1)) or (g1 and i2 and t[e2 : e2 + 1] == ".")
        elif gap == ". ":
            ok = i1 and f2
        elif re.fullmatch(r",[ ]?\n?", gap):
            ok = (f1 and (g2 or (i2 and t[e2 : e2 + 1] == "."))) and not (g1 and not f1)
        elif re.fullmatch(r"['\"],[ ]?['\"]", gap):
            ok = (g1 and f2) or (f1 and g2)
        else:
            ok = False
        if ok:
            out.append((s1, e2 + (i2 and t[e2 : e2 + 1] == "."), "person_name"))
    for m in TITLED.finditer(t):
        words = m["v"].split(" ")
        if any(any(names.likely(w)) for w in words):
            s, e = m.span("v")
            if not any(names.likely(words[-1])):
                e = s + len(words[0])
            if _free(taken, s, e):
                out.append((s, e, "person_name"))
    # One word of the lexicon's pieces, if it can't be an ordinary word.
    for s, e, _, _, _, w in tokens:
        if any(names.parts(w)) and not names.is_plain(w) and len(w) >= 5 and _free(out, s, e):
            out.append((s, e, "person_name"))
    return out


def find_in(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal information in a text, in positions of the text itself."""
    if not text:
        return []
    t, where = normalised(text)
    found = _emails(t)
    if DIGIT.search(t):
        if NUMBER_HINT.search(t) or MIXED_HINT.search(t) and ID_HINT.search(t):
            found += _numbers(t, found)
        if may_have_address(t):
            for rx in ADDRESS:
                found += [(m.start(), m.end(), "street_address") for m in rx.finditer(t) if _free(found, *m.span())]
    found += _names(t, names, found)
    if where is not None:
        where = [*where, len(text)]
        found = [(where[s], where[e - 1] + 1 if where[e - 1] + 1 > where[s] else where[e], k) for s, e, k in found]
        found = [(s, _whole(text, e), k) for s, e, k in found]
    # A name in three parts is found as two overlapping pairs.
    out: list[tuple[int, int, str]] = []
    for s, e, k in sorted(set(found)):
        if out and s < out[-1][1] and k == out[-1][2]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), k)
        else:
            out.append((s, e, k))
    return out


def _whole(text: str, end: int) -> int:
    """End moved past marks, invisible code points, and the rest of a word."""
    while end < len(text) and (unicodedata.combining(text[end]) or (shows_nothing(text[end]) and text[end] not in "\r\n")):
        end += 1
    return end


def replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    """Text with each span replaced by its type's placeholder; overlapping spans become one, of the first's type."""
    out, at = [], 0
    for s, e, kind in found:
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def lexicon(names: DataFrame) -> list[tuple[str, str]]:
    """Entries of a name table; refused beyond ``MOST_NAMES``, as every worker holds them."""
    rows = names.select("name_text", "name_part").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return [(r.name_text, r.name_part) for r in rows if r.name_text]


def scan(df: DataFrame, names: DataFrame, key: str = "id", text: str = "content", redact: bool = True) -> DataFrame:
    """Rows (key, pii_types, redacted) of each row: the distinct types found, and the text without them.

    Null text has no types and stays null; empty text stays empty; texts of any length are read
    whole; repeated rows are treated alike; other columns are dropped. Without ``redact`` the text
    isn't built.
    """
    entries = lexicon(names)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Names(entries)
        for b in batches:
            types, texts = [], []
            for t in b["t"]:
                found = find_in(t, known)
                types.append(sorted({k for _, _, k in found}))
                texts.append(replaced(t, found) if redact and t else t if redact else None)
            yield pd.DataFrame({"k": b["k"], "pii_types": types, "redacted": pd.Series(texts, dtype="object")})

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, pii_types array<string>, redacted string")
    return out.withColumnRenamed("k", key)
