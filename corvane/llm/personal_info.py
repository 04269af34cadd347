"""Problem 5: personal information in free text.

A text passes a chain of transducers, each of which keeps the source offset of every
character it emits:
  1. compatibility forms are decomposed and recomposed, format characters dropped,
     runs of blanks shortened, look-alike letters of other scripts in Latin words replaced;
  2. digits that are spelled out in a row become digits;
  3. disguised at-signs and dots become '@' and '.'.
Identifiers are detected on the normalised text and their spans mapped back, so that
every item is an exact substring of the source and the rest of the text is untouched.
A text that no transducer changes is searched as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import spread

KINDS = ("email", "id_number", "phone", "address", "name")

# Look-alike letters (Cyrillic and Greek to Latin).
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмнтвАЕОРСУХІЈЅКМНТВαορνΑΒΕΗΙΚΜΝΟΡΤΧ", "aeopcyxijsdhkmhtbAEOPCYXIJSKMHTBaopvABEHIKMNOPTX"))
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "null": "0", "cero": "0", "zéro": "0", "ноль": "0", "one": "1", "eins": "1", "uno": "1", "один": "1", "two": "2", "zwei": "2", "dos": "2", "deux": "2", "два": "2",
    "three": "3", "drei": "3", "tres": "3", "trois": "3", "три": "3", "four": "4", "vier": "4", "cuatro": "4", "quatre": "4", "четыре": "4", "five": "5", "fünf": "5", "cinco": "5", "cinq": "5", "пять": "5",
    "six": "6", "sechs": "6", "seis": "6", "шесть": "6", "seven": "7", "sieben": "7", "siete": "7", "sept": "7", "семь": "7", "eight": "8", "acht": "8", "ocho": "8", "huit": "8", "восемь": "8",
    "nine": "9", "neun": "9", "nueve": "9", "neuf": "9", "девять": "9",
}

_ODD_SPACE = re.compile(r"[ \t]{2,}|\t")
_WORD_DIGITS = re.compile(r"\b(?:(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + r")\b[ -]?){7,}", re.I)
_ATS = "at|ät|arroba|arobase|klammeraffe|собака"
_DOTS = "dot|punkt|punto|point|точка"
_AT_BRACKET = rf"[\[({{<]\s*(?:{_ATS})\s*[\])}}>]"
_AT = re.compile(rf"\s*{_AT_BRACKET}\s*|(?<=\w)\s+(?:{_ATS})\s+(?=[\w-]+(?:\s+(?:{_DOTS})\s+[\w-]|\s*[\[({{<]\s*(?:{_DOTS})\s*[\])}}>]))", re.I)
_DOT = re.compile(rf"\s*[\[({{<]\s*(?:{_DOTS})\s*[\])}}>]\s*|(?<=\w)\s+(?:{_DOTS})\s+(?=\w)", re.I)
# What a text must hold for the patterns to match: an at-sign in brackets, or a word for the dot.
_AT_BRACKET = re.compile(_AT_BRACKET, re.I)
_DOT_WORDS = tuple(_DOTS.split("|"))
#: Characters that compatibility normalisation or the removal of format characters can change.
_COMPAT = re.compile("(?:.[̀-ͯ]+|[ ­²³¹¼-¾ -‏ -  -₟℀-⅏　ﬀ-ﬆ﻿＀-￯\U0001d400-\U0001d7ff])+", re.S)
_AT_TOKEN = re.compile(r"\S*@\S*")
#: A Latin letter beside a look-alike, which a word of both scripts has.
_BOTH = re.compile("[A-Za-z][{0}]|[{0}][A-Za-z]".format("".join(LOOKALIKES)))
#: Words with letters of both scripts, in which look-alikes stand for Latin ones.
_MIXED = re.compile("(?=[^\\W\\d_]*[A-Za-z])(?=[^\\W\\d_]*[" + "".join(LOOKALIKES) + "])[^\\W\\d_]+")


class Offsets:
    """A normalised text and, for each of its characters, the source span it came from."""

    def __init__(self, text: str):
        self.text = text
        self.at: list[int] | None = None  # start of each character's source span, and one past the end
        self.to: list[int] | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.at is None else (self.at[a], self.to[b - 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the current text; all of a replacement maps to its whole span."""
        if not edits:
            return
        at = self.at if self.at is not None else list(range(len(self.text)))
        to = self.to if self.to is not None else list(range(1, len(self.text) + 1))
        out, new_at, new_to, last = [], [], [], 0
        for a, b, s in edits:
            out += (self.text[last:a], s)
            new_at += at[last:a]
            new_to += to[last:a]
            if len(s) == b - a:
                new_at += at[a:b]
                new_to += to[a:b]
            else:
                new_at += [at[a]] * len(s)
                new_to += [to[b - 1]] * len(s)
            last = b
        out.append(self.text[last:])
        self.text, self.at, self.to = "".join(out), new_at + at[last:], new_to + to[last:]


def _compat(m: re.Match) -> tuple[int, int, str]:
    new = unicodedata.normalize("NFKC", m[0])
    return m.start(), m.end(), new if new.isascii() else "".join(c for c in new if unicodedata.category(c) != "Cf")


def _per_char(edits: list[tuple[int, int, str]], text: str) -> list[tuple[int, int, str]]:
    """Split edits that keep the length (full-width runs) so that offsets stay exact; others by character."""
    out = []
    for a, b, s in edits:
        if len(s) == b - a or b - a == 1:
            out.append((a, b, s))
            continue
        k = a
        while k < b:
            e = k + 1
            while e < b and "̀" <= text[e] <= "ͯ":
                e += 1
            new = unicodedata.normalize("NFKC", text[k:e])
            out.append((k, e, "".join(c for c in new if unicodedata.category(c) != "Cf")))
            k = e
    return out


def normalise(text: str) -> Offsets:
    o = Offsets(text)
    if not text.isascii():
        o.rewrite(_per_char([_compat(m) for m in _COMPAT.finditer(text)], text))
        if _BOTH.search(o.text):
            o.rewrite([(m.start(), m.end(), "".join(LOOKALIKES.get(c, c) for c in m[0])) for m in _MIXED.finditer(o.text)])
        if "@" in o.text:
            o.rewrite([(m.start(), m.end(), "".join(LOOKALIKES.get(c, c) for c in m[0])) for m in _AT_TOKEN.finditer(o.text) if not m[0].isascii()])
    if "  " in o.text or "\t" in o.text:
        o.rewrite([(m.start(), m.end(), " ") for m in _ODD_SPACE.finditer(o.text)])
    low = o.text.lower()
    # of seven words in a row the inner five stand between blanks or hyphens
    if sum(map(DIGIT_WORDS.__contains__, low.replace("-", " ").split())) >= 5:
        o.rewrite([(m.start(), m.start() + len(m[0].rstrip(" -")), "".join(DIGIT_WORDS[w.lower()] for w in re.findall(r"\w+", m[0]))) for m in _WORD_DIGITS.finditer(o.text)])
    if any(w in low for w in _DOT_WORDS) or _AT_BRACKET.search(o.text):
        at = [(m.start(), m.end(), "@") for m in _AT.finditer(o.text)]
        if at:
            # Dots count as disguised only near a disguised at-sign.
            dots = [(m.start(), m.end(), ".") for m in _DOT.finditer(o.text) if any(a - 60 < m.start() < b + 80 for a, b, _ in at)]
            o.rewrite(sorted(at + dots))
    return o


_EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")

_ID_CUE = re.compile(
    r"(?i)\b(?:social security|social insurance|insurance number|insured person|insurance no|national id|national identity|identity card|identity number|id card|passport|tax (?:number|id|no)|taxpayer|driver'?s? licen[cs]e|driving licen[cs]e"
    r"|sozialversicherung\w*|versicherungsnummer|versichertennummer|ausweis\w*|personalausweis\w*|reisepass\w*|steuer-?(?:id|nummer)\w*|führerschein\w*"
    r"|dni|nie|nif|seguridad social|pasaporte|carn[eé] de conducir|número fiscal|numéro fiscal|sécurité sociale|carte d.identité|passeport|permis de conduire|numéro national"
    r"|паспорт\w*|снилс|инн|водительск\w+|удостоверени\w+)"
)
_ID = re.compile(
    r"(?<![\w-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}-\d{2}-\d{4}|\d{2}[A-Z]\d{6}-?\d|[A-Z]{1,3}\d{6,9}[A-Z]?|\d{4} \d{4} \d{4}(?: \d{1,4})?|\d{1,2}\.\d{3}\.\d{3}-?[A-Z\d]?|\d{8}-?[A-Z]|\d{3} \d{3} \d{3}(?: \d{2})?|\d{8,12})(?![\w-]|\.\d)", re.I
)
_NOT_PERSON = re.compile(r"(?i)(?:\b(?:activation|code|serial|order|ticket|build|device|error|program|programme|licence key|imei|version|invoice no|tracking|case|model|bestell\w*|gerät\w*|pedido|commande|заказ\w*|код\w*)\b|0x|#)[^.!?]{0,25}$")

_PHONE = re.compile(
    r"(?<![\w.,+\-/:])(?:"
    r"\+\d{1,3}[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d(?:[ .\-/]?\d){6,11}"
    r"|\(\+?\d{2,5}\) ?\d{3,4}(?:[ .\-]?\d{2,4}){1,2}"
    r"|\d{3}[.\-]\d{3}[.\-]\d{4}"
    r"|0\d{2,4}[ /\-]\d{3,4}[ \-]?\d{3,4}"
    r"|0\d(?: \d{2}){4}"
    r"|00\d{2}(?:[ \-]?\d){8,11}"
    r"|[2-9]\d{9}|0\d{9,10}"
    r")(?![\w\-]|[.,:]\d)"
)

#: The fewest digits that _PHONE admits: "(12) 345 67".
LEAST_PHONE = 7

#: A number with what may stand inside it; everything about digits is looked for around these.
_CHUNK = re.compile(r"(?:\(\+|[+(])?\d(?:[\d .\-/()]*\d)?")

# Words that end a street name, and words that begin one.
_STREET = "street|road|lane|avenue|drive|close|way|row|court|terrace|place|square|gardens|crescent|boulevard|grove|hill|park|walk|mews|rise|view"
_STREET_ABBR = "st|rd|ave|ln|dr|blvd|ct|pl|sq|cres|ter"
_NUMBER_FIRST = re.compile(
    rf"\d{{1,5}}[a-z]? (?:[^\W\d_][\w'’-]*[ -]){{1,3}}?(?:(?:{_STREET})\b|(?:{_STREET_ABBR})\b\.?)(?:, ?(?:flat|apt\.?|apartment|unit|suite) ?\d+[a-z]?)?"
    r"|\d{1,4}(?: ?bis| ?ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours) (?:(?:de|du|des|la|le) ){0,2}(?:[dl]['’])?[^\W\d_][\w'’-]*(?: (?-i:[A-ZÀ-Þ])[\w'’-]*)?",
    re.I,
)
_STREET_BEFORE = re.compile(
    r"(?:\b[^\W\d_]+(?:straße|strasse|str\.)|\b(?-i:[A-ZÄÖÜ])[^\W\d_]+(?:gasse|platz|allee|weg|ufer|damm|ring)"
    r"|\b(?:[^\W\d_]+ ){1,2}(?:straße|strasse|str\.|platz|allee|weg)"
    r"|\b(?:calle|avenida|avda\.|plaza|paseo|carrera|camino|c/) ?(?:(?:de|del|la|las|los) ){0,2}[^\W\d_]+(?: [^\W\d_]+)?,?(?: ?n\.?º)?"
    r"|\b(?:ул\.|улица|пр\.|проспект|пер\.|переулок) ?[^\W\d_]+,?(?: ?(?:д\.|дом))?) $",
    re.I,
)
_CLOSE_NUMBER = re.compile(r"\d{1,4}(?:[a-z]\b)?(?:, ?\d+\.?º ?\w?\b|, ?кв\. ?\d+)?", re.I)
_COMMON_IN_STREET = re.compile(r"(?i)^(?:\d+[a-z]? )?(?:.*\b(?:the|a|an|of|and|in|on|to|my|is|records|items|minutes|days|reports|menu|page|year|could|go|either|for|it|that|with)\b)")

_TOK = r"[^\W\d_]+(?:['’][^\W\d_]+)?(?:-[^\W\d_]+)?"
_FULL = rf"(?:[^\W\d_]\. ?|{_TOK} )(?:[^\W\d_]\. ?)?{_TOK}"
_TITLE = r"\b(?:Dr|Mr|Mrs|Ms|Miss|Prof|Herr|Frau|Hr|Hrn|Fr|Sr|Sra|Srta|Don|Doña|Mme|Mlle|M|Г-н|Г-жа)\b\.? "
# Words for the part a person plays, and what stands before them.
_ROLES = (
    "colleague|coworker|co-worker|manager|boss|supervisor|assistant|secretary|accountant|bookkeeper|technician|engineer|teacher|tutor|doctor|lawyer|friend|neighbou?r|landlord|tenant|flatmate|roommate|husband|wife|partner|brother|sister|cousin|uncle|aunt|nephew|niece|son|daughter|father|mother|client|customer|agent|advisor|adviser|director|owner|author|user|reviewer"
    "|kolleg(?:e|en|in)|chef(?:in)?|freund(?:in)?|nachbar(?:n|in)?|bruder|schwester|mann|frau|sohn|tochter|lehrer(?:in)?|arzt|ärztin|leiter(?:in)?|kund(?:e|en|in)|berater(?:in)?"
    "|compañer[oa]|jef[ea]|amig[oa]|vecin[oa]|herman[oa]|marido|esposa|hij[oa]|profesora?|médic[oa]|client[ea]|asesora?"
    "|collègue|patronn?e?|amie?|voisine?|frère|sœur|mari|femme|fils|fille|professeure?|médecin|cliente?|conseill(?:er|ère)"
    "|коллег[аеиу]|начальник[аеу]?|друг[аеу]?|подруг[аеиу]|сосед(?:ка|а|у)?|брат[ау]?|сестр[аеыу]|муж[ау]?|жен[аеуы]|клиент[ау]?"
)
_OWN = "my|our|his|her|their|your|the|a|an|former|new|mein(?:e|en|em|er)?|unser(?:e|en|em|er)?|ihr(?:e|en|em)?|sein(?:e|en|em)?|mi|su|nuestr[oa]|mon|ma|notre|son|sa|leur|мо[йяейю]+|наш(?:а|ей|ему)?"
_ROLE = re.compile(rf"(?<!says )(?<!said )(?<!sagt )(?<!meint )(?<!dice )(?<!dit )\b(?:{_OWN}) (?:{_ROLES}),? ({_FULL})", re.I)
_ROLE_WORD = re.compile(_ROLES, re.I)
#: A word before a capital: where the costlier pattern of roles is tried.
_BEFORE_CAPITAL = re.compile(r" (?=([\w-]+),? [A-ZÀ-ÞА-Я])")
LONGEST_OWN = 1 + max(map(len, _OWN.split("|")))


@lru_cache(1 << 16)
def _is_role(word: str) -> bool:
    return _ROLE_WORD.fullmatch(word) is not None


#: An initial and a surname, neither first nor last of a sentence.
_INITIAL_HINT = re.compile(r" [A-ZÀ-ÞА-Я]\. ?[A-ZÀ-ÞА-Я]")
_INITIAL = re.compile(r"(?:(?<=[^\W\d_] )|(?<=-- ))((?:[A-ZÀ-ÞА-Я][a-zà-ÿа-я'’]+ )?[A-ZÀ-ÞА-Я]\. ?(?:[A-ZÀ-ÞА-Я]\. ?)?[A-ZÀ-ÞА-Я][a-zà-ÿа-я'’]+(?:-[A-ZÀ-ÞА-Я][a-zà-ÿа-я]+)?)(?= [^\W\dA-ZÀ-Þ_])")
_NAMES = [
    # (literals one of which the text must hold, pattern, needs capitals): a cue on both sides
    # stands for itself, one cue wants a capitalised name, None a capitalised name or the line's end.
    (("colleague",), rf"\b(?:my|our) colleague ({_FULL})(?= lost\b)", False),
    (("belongs to",), rf"\bbelongs to ({_FULL})(?=,? not\b)", False),
    (("spoke",), rf"\bspoke (?:to|with) ({_FULL})(?= (?:from|at|in)\b)", False),
    (("gracias a",), rf"\bgracias a ({_FULL})(?= por\b)", False),
    (("ask for",), rf"\bask for ({_FULL})(?= when\b)", False),
    (("signed by",), rf"\bsigned by ({_FULL})(?= in\b|[.,;]|\s*$)", False),
    ((" here, ",), rf"({_FULL})(?= here, )", False),
    (("name is", "called", "heiße", "heisse", "llamo", "nombre es", "appelle", "зовут"), rf"\b(?:my name is|i am called|ich heiße|mein name ist|me llamo|mi nombre es|je m['’]appelle|меня зовут) ({_FULL})", True),
    (("regards", "yours", "sincerely", "cheers", "thanks", "best", "grü", "gruß", "saludos", "atentamente", "cordialement", "salutations", "уважением"), rf"\b(?:regards|yours|sincerely|cheers|thanks|best|grüße|grüßen|grüsse|gruß|saludos|atentamente|cordialement|salutations|с уважением)[,:]\s*({_FULL})", None),
    (("--", "—", "–"), rf"(?:^|(?<=\s))(?:--|—|–) ?({_FULL})(?=\s*$|\s*\n| (?-i:[A-ZÀ-Þ¿¡<(+\d]))", None),
    (
        ("belongs to", "spoke", "talked to", "gracias a", "merci à", "dank", "ask for", "signed by", "written by"),
        rf"\b(?:belongs to|spoke to|spoke with|talked to|gracias a|merci à|dank an|danke an|ask for|signed by|written by) ({_FULL})",
        True,
    ),
]
_NAMES = [(hints, re.compile(p, re.I), caps) for hints, p, caps in _NAMES]
_TITLES = ("dr", "mr", "mrs", "ms", "miss", "prof", "herr", "frau", "hr", "hrn", "fr", "sr", "sra", "srta", "don", "doña", "mme", "mlle", "m", "г-н", "г-жа")
#: A title in the text without case; those that are words or letters of their own only with a point.
_TITLE_HINT = re.compile(r"(?<![^\W_])(?:" + "|".join(re.escape(x) + (r"\. " if x in ("m", "don", "fr", "hr") else r"\.? ") for x in _TITLES) + ")")
_TITLED_CUE = re.compile(rf"{_TITLE}((?:[^\W\d_]\. ?|{_TOK} )?(?:[^\W\d_]\. ?)?{_TOK})(?= (?:promised|closed|recommended|called|said|wrote|told|replied|answered|signed|from|here|hat|sagte|schrieb|dijo|a dit|dit)\b)", re.I)
_TITLED = re.compile(rf"{_TITLE}([A-ZÀ-ÞА-Я](?:\. ?|[\w'’]+ )?(?:[A-ZÀ-Þ]\. ?)?[A-ZÀ-ÞА-Я][a-zà-ÿа-я'’]+(?:-[A-ZÀ-ÞА-Я][\w'’]+)?|[A-ZÀ-ÞА-Я][a-zà-ÿа-я'’]+(?:-[A-ZÀ-ÞА-Я][\w'’]+)?)")
# Words that are no part of a name.
_NO_NAME = frozenset(
    "the a an my our your his her their this that it is was and or of for in on at by with from to not call text ask they we i you he she one two both half whole team since when while after before because then there where every each some any all new old back page menu mode "
    "der die das ein eine mein meine unser und ist el la los las un una mi tu su y es le les une mon ma mes et est please thanks thank long here".split()
)


def _capital(name: str) -> bool:
    parts = re.split(r"[ -]+|(?<=\.)", name)
    return all(p[:1].isupper() for p in parts if p) and not all(p.isupper() for p in parts if p)


def _good_name(name: str, caps: bool | None, text: str, end: int) -> bool:
    tokens = [t.casefold() for t in name.replace(".", ". ").split() if not t.endswith(".")]
    if any(t in _NO_NAME for t in tokens):
        return False
    if caps is False or _capital(name) or caps is None and name.isupper() and not text[end : end + 24].isupper():
        return True
    # a signature in small letters, or among capitals, stands at the end of its line
    return caps is None and (end >= len(text) or text[end] in "\n\r" or text[end:].lstrip(" ")[:1] in ("", "\n"))


_SENTENCE_BREAK = re.compile(r"(?<!\bno)(?<!\bnr)[.!?]\s|\n", re.I)


def _sentence(t: str, x: int, y: int) -> tuple[int, int]:
    """The bounds of the sentence around t[x:y]."""
    start, end = 0, len(t)
    for m in _SENTENCE_BREAK.finditer(t):
        if m.end() <= x:
            start = m.end()
        elif m.start() >= y:
            end = m.start()
            break
    return start, end


def _identity(t: str, a: int, b: int, add) -> None:
    """An identity number at or around the number t[a:b] with a cue before it in its sentence, or right after it."""
    for m in _ID.finditer(t, max(0, a - 4), min(len(t), b + 3)):
        x, y = m.span()
        if m[0].isalpha() or x >= b or y <= a:
            continue
        start, end = _sentence(t, x, y)
        cue = None
        for cue in _ID_CUE.finditer(t, start, x):
            pass
        # a cue speaks of the first number after it
        near = cue is not None and not any(c.isdigit() for c in t[cue.end() : x])
        if not near:
            near = _ID_CUE.search(t, y, end)
            near = near is not None and near.start() - y <= 20
        if near and not _NOT_PERSON.search(t[max(start, x - 30) : x]):
            add("id_number", x, y)


def _place(t: str, a: int, b: int, add) -> None:
    """A street address whose house number (or flat) is the first number of t[a:b]."""
    m = _NUMBER_FIRST.match(t, a)
    if m:
        if not _COMMON_IN_STREET.match(m[0]):
            start = a
            # the flat's number is the chunk before: "Flat 4, 12 Hill Road"
            head = re.search(r"\b(?:flat|apt\.?|apartment|unit|suite|wohnung|whg\.?|piso|appt\.?) ?#?\d+[a-z]?, ?$", t[max(0, a - 25) : a], re.I)
            if head:
                start = max(0, a - 25) + head.start()
            add("address", start, m.end())
        return
    if a and t[a - 1] == " " and a > 3 and (t[a - 2].isalpha() or t[a - 2] in ".,º"):
        head = _STREET_BEFORE.search(t, max(0, a - 45), a)
        if head:
            m = _CLOSE_NUMBER.match(t, a)
            if m and not _COMMON_IN_STREET.match(head[0]):
                add("address", head.start(), m.end())


def find(text: str | None) -> list[tuple[str, int, int]]:
    """[(kind, start, end)] in source characters, in order, without overlaps.

    Null and '' give []. Where spans meet, the kind named first in KINDS is kept.
    """
    if not text:
        return []
    o = normalise(text)
    t = o.text
    found: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        if a < b and not any(a < y and x < b for _, x, y in found):
            found.append((kind, a, b))

    if "@" in t:
        for m in _EMAIL.finditer(t):
            add("email", *m.span())
    for m in _CHUNK.finditer(t):
        a, b = m.span()
        size = sum(map(m[0].count, "0123456789"))
        if size >= 6:
            _identity(t, a, b, add)
        if size >= LEAST_PHONE:
            for p in _PHONE.finditer(t, a, min(len(t), b + 2)):
                if p.end() <= b and not _NOT_PERSON.search(t, max(0, p.start() - 30), p.start()):
                    add("phone", *p.span())
        _place(t, a, b, add)
    low = t.lower()
    for hints, pattern, caps in _NAMES:
        if any(h in low for h in hints):
            for m in pattern.finditer(t):
                if _good_name(m[1], caps, t, m.end(1)):
                    add("name", *m.span(1))
    if _TITLE_HINT.search(low):
        for m in _TITLED_CUE.finditer(t):
            if _good_name(m[1], False, t, m.end(1)):
                add("name", *m.span(1))
        for m in _TITLED.finditer(t):
            if _good_name(m[1], True, t, m.end(1)):
                add("name", *m.span(1))
    for before in _BEFORE_CAPITAL.finditer(t):
        if _is_role(before[1].lower()):
            m = _ROLE.search(t, max(0, before.start() - LONGEST_OWN), len(t))
            if m and m.start() <= before.start() and _good_name(m[1], True, t, m.end(1)):
                add("name", *m.span(1))
    for m in _INITIAL.finditer(t) if _INITIAL_HINT.search(t) else ():
        if _good_name(m[1], True, t, m.end(1)):
            add("name", *m.span(1))
    spans = sorted((x, y, kind) for kind, a, b in found for x, y in [o.span(a, b)])
    return [(kind, x, y) for x, y, kind in spans]


def redact(text: str | None, items: list[tuple[str, int, int]]) -> str | None:
    """The text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS], [NAME] for the items; null stays null."""
    if not items:
        return text
    out, last = [], 0
    for kind, a, b in items:
        out += (text[last:a], f"[{kind.upper()}]")
        last = b
    return "".join(out) + text[last:]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for kind, a, b in find(text):
                for c, v in zip(cols, (id_, kind, text[a:b], a, b)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))], ["id", "kind", "item", "start", "end"])


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        spans = [find(t) for t in texts]
        yield pa.RecordBatch.from_arrays([ids, pa.array([redact(t, s) for t, s in zip(texts, spans)], pa.string()), pa.array([len(s) for s in spans], pa.int32())], ["id", "text", "items"])


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")))


def items(df: DataFrame, id_col: str = "review_id", text_col: str = "review_text") -> DataFrame:
    """(id, kind, item, start, end), one row per piece found; no shuffle. An item that occurs twice gives two rows."""
    return _source(df, id_col, text_col).mapInArrow(_items, "id bigint, kind string, item string, start int, end int").withColumnRenamed("id", id_col)


def redacted(df: DataFrame, id_col: str = "review_id", text_col: str = "review_text") -> DataFrame:
    """(id, text, items): every row, its text with placeholders and how many were put in."""
    return _source(df, id_col, text_col).mapInArrow(_redacted, "id bigint, text string, items int").withColumnsRenamed({"id": id_col, "text": text_col})
