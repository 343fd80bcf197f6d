"""Personal information in free text, replaced by typed placeholders.

Method: regular expressions propose spans of each kind with a score; checksums
(Luhn, mod 97 and those of national numbers) confirm them, words nearby adjust
the score, and spans that reach the threshold are kept. Where spans overlap,
the higher score wins, then the longer. The text between the spans is left as
it is. A number whose checksum fails passes only behind a word that announces
such a number: a mistyped number is still a person's.

Names are told from other capitalised pairs by what is common: a word is
common if its lower-case form is one token of a public tokenizer's vocabulary,
as merge, gate and garden are and family names mostly are not. Common given
names, titles, and words that precede or follow persons add to the score;
capitalised common words behind ("... Library") and things named after persons
("... lens") take from it.

Each document is worked on as a whole in one task; the costly patterns run
only around signs that a place of their kind must hold. No row is moved. A text without a place comes
out unchanged.

Nulls: a null text stays null and has no places; an empty one stays empty.
Other columns are passed on as they are. Repeated rows are worked on each.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.session import spread

KINDS = ("email", "phone", "national_id", "address", "name")
THRESHOLD = 1.0
#: Characters around a span in which words count.
NEAR = 60

#: Folder of the public vocabularies that say which words are common.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Given names that are frequent in English, German, Spanish and French.
GIVEN = frozenset(
    """James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Donald Sandra Steven Ashley Paul Emily Andrew Kimberly Kenneth Michelle George Carol Kevin Amanda Brian Melissa Edward Laura Ruth Alice Alma Clara Emma Edith Eleanor Grace Hugh June Nora Owen Oliver Simon Peter Philip Samuel Henry Jack Jane Julia Kate Helen Anna Carl
    Hans Peter Wolfgang Klaus Jürgen Dieter Werner Heinz Helmut Bernd Uwe Stefan Andreas Ursula Karin Helga Sabine Ingrid Renate Monika Petra Brigitte Birgit Heike Silke Anke Karl Ulrich Volker Matthias
    Antonio José Manuel Francisco Juan Javier Miguel Carlos Alejandro Pedro Pablo Luis Sergio Carmen Ana Isabel Dolores Pilar Teresa Rosa Cristina Lucía Marta Elena Fernando Diego Rocío Nuria
    Jean Pierre Michel Philippe Alain Nicolas Christophe Laurent Marie Nathalie Isabelle Sylvie Catherine Martine Françoise Camille Antoine Julien François Hélène Chloé Claire Sébastien Pascal Yann Zoé""".split()
)
# What is named after persons, in lower case.
THINGS = frozenset("lens camera library award prize theorem museum airport university foundation algorithm tower bridge hall house garden street method effect equation telescope test machine distribution process filter tree transform medal stadium station school hospital institute building park square engine turbine watch guitar".split())

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
# a gap in a name or address: blanks, or a line end with what may lead the next line
_GAP = r"(?:[ \t]+|[ \t]*\r?\n[ \t]*(?:(?://|\#|>|\*|--)[ \t]*)*)"
_WORD = rf"[{_UP}](?:[’'][{_UP}])?[{_LOW}]+(?:[’'][{_LOW}]+)?"
_CAPS = rf"[{_UP}]{{3,}}"
_FAMILY = rf"(?:(?:von|van|de|del|de la|di|du|le|la|zu|da|dos){_GAP})?(?:{_WORD}|{_CAPS})(?:-(?:{_WORD}|{_CAPS}))*"
_INITIALS = rf"[{_UP}]\.(?:[ -]?[{_UP}]\.)*"

_LOCAL = r"[A-Za-z0-9_%'À-ÿ](?:[\w.%+'\-]*[\w%+\-])?"
_EMAIL = re.compile(rf"(?<![\w.+%\-@/])({_LOCAL})@((?:[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ\-]*[A-Za-z0-9À-ÿ])?\.)+[A-Za-zÀ-ÿ]{{2,}})(?![\w@])")
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|At|@|a|ät|arroba|chez)\s?[\])}>]\s?|\s(?:at|AT|At|arroba)\s|\s@\s|\s@|@\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|Dot|punkt|punto|point|\.)\s?[\])}>]\s?|\s(?:dot|DOT|Dot|punto|punkt)\s)"
_HIDDEN = re.compile(rf"(?<![\w.+%\-@/])({_LOCAL}){_AT}([A-Za-z0-9][A-Za-z0-9\-]*(?:(?:{_DOT}|\.)[A-Za-z0-9\-]+)*(?:{_DOT}|\.)[A-Za-z]{{2,}})(?![\w@])")

_EXT = r"(?:,?\s?(?:ext\.?|extension|x|Durchwahl|Nebenstelle|poste|extensión)\s?\d{1,6})?"
_PHONE = re.compile(
    rf"""(?<![\w.+/\-])(?<!\d[ .\-/])(?:
      (?P<nanp>(?:(?:\+|00)1[ .\-]?|1[ .\-])?(?:\(\d{{3}}\)[ .\-]?|\d{{3}}[ .\-])\d{{3}}[ .\-]\d{{4}})
     |(?P<plus>(?:\+|00)[1-9]\d{{0,2}}[ .\-/]?(?:\(0\d{{0,4}}\)|\(\d{{1,4}}\))?(?:[ .\-/]?\d){{6,12}})
     |(?P<uk>\(?0(?:20|1\d{{2,3}}|7\d{{3}}|2\d)\)?[ \-]\d{{3,4}}[ \-]\d{{3,4}})
     |(?P<de>\(?0[2-9]\d{{1,4}}\)?[ /\-]{{1,3}}\d{{3,8}}(?:[ \-]\d{{1,5}}){{0,2}})
     |(?P<fr>0[1-9](?:[ .\-]\d{{2}}){{4}}|0[1-9]\d{{8}})
     |(?P<es>[6789]\d{{2}}(?:[ .\-]\d{{3}}){{2}}|[6789]\d{{2}}(?:[ .\-]\d{{2}}){{3}}|[6789]\d{{8}})
    ){_EXT}(?![\w])(?![.\-/]\d)""",
    re.X,
)
_PHONE_WORDS = re.compile(r"(?i)\b(?:tel|phone|call|reach|ring|fax|mobile|cell|llama|llame|teléfono|móvil|telefon|handy|mobil|téléphone|portable|appel(?:er|ez)|joindre|au|al|rückfragen|contact|on|or)\b\.?")
# any grouping of digits, where such a word stands directly in front
_SPOKEN = re.compile(r"(?i)\b(?:tel|phone|fax|mobile|cell|teléfono|móvil|telefon|handy|mobil|téléphone)\b[.:]*[ ]?((?:\+|\()?\d{1,5}\)?(?:[ .\-/]\d{1,5}){1,5})(?![\w])(?![.\-/]\d)")
_NOT_PHONE_WORDS = re.compile(r"(?i)(?:\b(?:request|epoch|order|build|ticket|commit|version|line|port|id|code)\W{0,3}$)")

_IDS = re.compile(
    r"""(?<![\w])(?<!\d[ .\-/])(?:
      (?P<nir>[12][ ]?\d{2}[ ]?(?:0[1-9]|1[0-2]|[2-9]\d)[ ]?(?:\d{2}|2[AB])[ ]?\d{3}[ ]?\d{3}(?:[ ]?\d{2})?)
     |(?P<ssn>\d{3}(?P<s>[ \-])\d{2}(?P=s)\d{4})
     |(?P<nino>[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D])
     |(?P<dni>\d{8}[ \-]?[A-Z]|\d{2}\.\d{3}\.\d{3}[ \-]?[A-Z])
     |(?P<nie>[XYZ][ \-]?\d{7}[ \-]?[A-Z])
     |(?P<steuer>\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}|\d{11})
     |(?P<passport>[A-Z]{1,2}\d{6,8}|[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8})
     |(?P<fiscale>[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z])
     |(?P<person>(?:19|20)?\d{6}[\-+]\d{4})
     |(?P<nine>\d{3}[ \-]\d{3}[ \-]\d{3}|\d{9})
    )(?![\w])(?![.\-/]\d)(?![ ]\d)""",
    re.X,
)
_ID_WORDS = re.compile(
    r"(?i)\b(?:ssn|social (?:security|insurance)|sin|ni number|nino|national insurance|passport|pasaporte|passeport|reisepass|ausweis|personalausweis|steuer-?id|steuernummer|idnr|tin|tax id|dni|nie|nif|sécu|sécurité sociale|seguridad social|nir|insee|bsn|burgerservicenummer|personnummer|codice fiscale|sozialversicherung\w*|identity|id card)\b"
)

_HOUSE = r"\d{1,4}(?:[ ]?[A-Za-z](?![\w]))?"
_STREET_EN = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Crescent|Cres\.?|Close|Way|Place|Pl\.?|Square|Sq\.?|Terrace|Boulevard|Blvd\.?|Parkway|Row|Mews|Hill|Grove|Gardens)"
_FLAT = r"(?:(?:Flat|Apt\.?|Apartment|Suite|Unit|Ste\.?)[ ]?\#?\w+,?[ ])?"
_ADDRESS = re.compile(
    rf"""(?<![\w.\-/])(?:
      (?P<en>{_FLAT}\d{{1,5}}(?:[ ]?[A-Z](?![\w]))?(?:-\d+)?,?{_GAP}(?:(?:{_WORD}|\d+(?:st|nd|rd|th)|[NSEW]\.?){_GAP}){{1,4}}?{_STREET_EN}(?![\w])(?:,?{_GAP}(?:Suite|Apt\.?|Apartment|Flat|Unit|Ste\.?|\#)[ ]?\w+)?)
     |(?P<de>(?:(?:Am|An[ ](?:der|den)|Auf[ ](?:der|dem)|Im|In[ ]der|Zum|Zur|Unter[ ]den){_GAP}(?:{_WORD}(?:-{_WORD})*)(?:{_GAP}{_WORD})?|(?:{_WORD}{_GAP})?(?:[{_UP}][{_LOW}]*(?:-{_WORD})*-?(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|stieg|chaussee|steig|hof|markt|Straße|Str\.|Weg|Platz|Allee|Gasse))),?{_GAP}{_HOUSE}(?:,?[ ](?:Wohnung|Whg\.?|App\.?|OG|EG)[ ]?\w*)?)
     |(?P<es>(?:Calle|C/|C\.|Avda\.?|Av\.|Avenida|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carrer|Glorieta){_GAP}?(?:(?:de|del|la|las|los|el){_GAP}){{0,3}}{_WORD}(?:{_GAP}(?:(?:de|del|la|las|los|y){_GAP}){{0,2}}{_WORD}){{0,3}},?{_GAP}(?:n\.?º?[ ]?)?{_HOUSE}(?:,?[ ]\d{{1,2}}\.?[ºª°](?:[ ][A-Z\d]\b)?)?)
     |(?P<fr>\d{{1,4}}(?:[ ]?(?:bis|ter|quater)|[ ]?[A-Z](?![\w]))?,?{_GAP}(?:rue|avenue|av\.|boulevard|bd\.?|place|chemin|allée|impasse|quai|cours|route|square|passage|faubourg|Rue|Avenue|Boulevard|Place)(?:{_GAP}(?:de|du|des|la|le|les|l’|l'|d'|d’|aux?)){{0,3}}(?:{_GAP}|(?<=['’])){_WORD}(?:(?:{_GAP}|-)(?:(?:de|du|des|la|le|les)(?:{_GAP}|-))?{_WORD}){{0,3}})
    )""",
    re.X,
)
_FLAT_AFTER = re.compile(r",? (?:Suite|Apt\.?|Flat|Unit) ?\w+")

_GIVEN_FIRST = re.compile(rf"(?<![\w@.\-/])({_WORD}|{_CAPS})(?:-{_WORD})?((?:{_GAP}{_INITIALS}|{_GAP}[{_UP}](?=[ ]))*){_GAP}({_FAMILY})(?![\w@])")
_FAMILY_FIRST = re.compile(rf"(?<![\w@.\-/])({_FAMILY}),{_GAP}({_WORD}(?:-{_WORD})?)((?:{_GAP}{_INITIALS})*)(?![\w@])")
_GIVEN_LEAD = re.compile(rf"({_WORD})(?:{_GAP}{_INITIALS})*{_GAP}$")
_INITIAL_FIRST = re.compile(rf"(?<![\w@.\-/&])({_INITIALS}){_GAP}?({_FAMILY})(?![\w@])")
_INITIAL_LAST = re.compile(rf"(?<![\w@.\-/])({_FAMILY}),{_GAP}({_INITIALS})(?!\w)")

# Titles, and words in front of persons.
_TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Sir Herr Herrn Frau Hr Fr M Mme Mlle Monsieur Madame Sr Sra Srta Don Doña Dra Drs".split())
_LEADS = frozenset(
    "author name user reporter owner contact assignee from to cc by with for ask ping call thank thanks regards sincerely and says von vom an für mit bei und durch danke grüße gruß par pour avec chez et merci cordialement au à por para con y gracias saludos contactez contacter contacte".split()
)
_TRAIL = re.compile(
    r"[ ]?[<(]\s*[\w.+\-%]+\s*(?:@|[\[(]at[\])]|\bat\b)|,?\s(?:said|says|wrote|writes|asked|asks|has|had|was|is|will|would|fixed|reviewed|approved|reported|noted|lives|lived|works|worked|called|calls|thinks|wants|needs|agrees|disagrees|joined|left|added|merged|suggested"
    r"|hat|hatte|ist|war|wird|schrieb|schreibt|sagte|sagt|bat|bittet|fragte|wohnt|meldete|meint|a|avait|est|était|écrit|demande|dit|habite|propose|ha|es|fue|escribió|dijo|pidió|pregunta|vive|propuso)\b|,? (?:phone|tel|on \+?[\d(]|at \d)|['\"]\s*[,)]"
)
_JOINED = re.compile(rf",?\s(?:and|und|et|y|or|oder|ou|o)\s(?={_WORD},?\s{_WORD})")
_BEHIND = re.compile(rf"[ ]({_WORD}|{_CAPS})|[ ]([a-z]{{3,}})")
_LISTED = re.compile(rf"{_WORD} (?:{_WORD}|{_CAPS}), $")
# Words that begin a sentence with a noun behind them.
_DETERMINERS = frozenset(
    "A An The This That These Those My Your Our Their Its No Each Every Some Der Die Das Den Dem Des Dieser Diese Dieses Diesen Ein Eine Einen Einem Kein Keine Ist Am Im Zum Zur El La Los Las Un Una Unos Este Esta Estos Si Le Les Une Ce Cet Cette Ces Du".split()
)
# Words of streets, months and days that follow a capitalised word.
_PLACES_AND_TIMES = frozenset(
    "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Crescent Cres Close Way Place Square Terrace Boulevard Parkway Row Mews Hill Grove Gardens January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
)


@functools.cache
def common_words(paths: tuple[str, ...] = VOCABULARIES) -> frozenset[str]:
    """Words whose lower-case form is one token of a vocabulary; read by the executors."""
    words = set()
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                token = base64.b64decode(line.split()[0])
                if token[:1] == b" ":
                    word = token[1:].decode("utf-8", "replace")
                    if word.isalpha() and word.islower():
                        words.add(word)
    return frozenset(words)


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _dni_ok(s: str) -> bool:
    t = re.sub(r"[^0-9A-Z]", "", s)
    n = t[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2") if t[0] in "XYZ" else t[:-1]
    return n.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23] == t[-1]


def _steuer_ok(s: str) -> bool:
    d = [int(c) for c in _digits(s)]
    p = 10
    for x in d[:10]:
        t = (x + p) % 10 or 10
        p = t * 2 % 11
    return d[0] != 0 and (11 - p) % 10 == d[10]


def _nir_ok(s: str) -> bool:
    t = s.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return len(t) == 15 and t.isdigit() and 97 - int(t[:13]) % 97 == int(t[13:])


def _luhn_ok(s: str) -> bool:
    d = [int(c) for c in reversed(_digits(s))]
    return sum(d[::2]) % 10 == -sum(x * 2 - 9 * (x > 4) for x in d[1::2]) % 10


def _bsn_ok(s: str) -> bool:
    d = [int(c) for c in _digits(s)]
    return any(d) and (sum((9 - i) * x for i, x in enumerate(d[:8])) - d[8]) % 11 == 0


def _fiscale_ok(s: str) -> bool:
    # What the characters at odd places count, in the order 0-9 and A-Z.
    odd = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
    at = ["0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c) for c in s]
    even = [x if x < 10 else x - 10 for x in at]
    return (sum(odd[x] for x in at[:15:2]) + sum(even[1:15:2])) % 26 == at[15] - 10


def _windows(trigger: re.Pattern, text: str, before: int, after: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text around what ``trigger`` finds, merged where they meet."""
    lo = hi = -1
    for m in trigger.finditer(text):
        a, z = max(0, m.start() - before), m.end() + after
        if a > hi:
            if hi >= 0:
                yield lo, hi
            lo = a
        hi = z
    if hi >= 0:
        yield lo, hi


_SIGN = re.compile("@")
# what every spelling of it holds; each choice begins with a plain character, which is quick to look for
_SPELLED = re.compile("@|" + "|".join(rf"{b}\s?(?:at|AT|At|a|ät|arroba|chez)\s?[\])}}>]" for b in (r"\[", r"\(", r"\{", "<")) + r"|at(?<=\sat)\s|AT(?<=\sAT)\s|At(?<=\sAt)\s|arroba(?<=\sarroba)\s")


def _emails(text: str) -> Iterator[tuple[int, int, str, float]]:
    for lo, hi in _windows(_SIGN, text, 100, 260):
        for m in _EMAIL.finditer(text, lo, hi):
            after = text[m.end() : m.end() + 2]
            if after[:1] == ":" and after[1:2].strip() and after[1:2] not in "/\"'" or text[max(0, m.start() - 3) : m.start()] == "://" or after[:1] == "/" and m[1].lower() == "git":
                continue  # where a repository is cloned from
            yield m.start(), m.end(), "email", 3.0
    for lo, hi in _windows(_SPELLED, text, 100, 260):
        pos = lo
        while (m := _HIDDEN.search(text, pos, hi)) is not None:
            whole = m.group()
            bracketed = re.search(r"[\[({<]\s?(?:at|AT|At|a|ät|arroba|chez)\s?[\])}>]", whole)
            if "@" not in whole and not bracketed and not re.search(_DOT, whole) or re.search(r"@\s?\d+(?:\.\d+)*$", whole):
                pos = m.end(1)  # a plain "at" needs a spelled-out dot; what looked like the host may be a local part
                continue
            pos = m.end()
            yield m.start(), m.end(), "email", 2.0


_NUMBERS = re.compile(r"\d(?:[ .\-/()]{0,3}\d){6,}")
_NUMERALS = re.compile(r"\d(?:[ .\-]?[\dA-Z]){5,}|[A-Z]{6}\d{2}|[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8}")


def _phones(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in itertools.chain.from_iterable(_PHONE.finditer(text, lo, hi) for lo, hi in _windows(_NUMBERS, text, 6, 40)):
        digits = _digits(re.split(r"(?i)\s?,?(?:ext|x|durchwahl|poste|nebenstelle)", m.group())[0])
        if not 8 <= len(digits) <= 15:
            continue
        before = text[max(0, m.start() - NEAR) : m.start()]
        if _NOT_PHONE_WORDS.search(before[-20:]):
            continue
        plain = m.group().isdigit()
        score = 0.7 if plain else 1.2 if m["nanp"] or m["plus"] or m["fr"] else 0.9
        if _PHONE_WORDS.search(before[-30:]):
            score += 0.4
        if _ID_WORDS.search(before[-25:]):
            score -= 0.6
        yield m.start(), m.end(), "phone", score
    for m in itertools.chain.from_iterable(_SPOKEN.finditer(text, lo, hi) for lo, hi in _windows(_NUMBERS, text, 24, 4)):
        if 8 <= len(_digits(m[1])) <= 15:
            yield m.start(1), m.end(1), "phone", 1.1


def _national_ids(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in itertools.chain.from_iterable(_IDS.finditer(text, lo, hi) for lo, hi in _windows(_NUMERALS, text, 10, 24)):
        v, near = m.group(), _ID_WORDS.search(text[max(0, m.start() - NEAR) : m.start()]) is not None
        if m["nir"]:
            score = 2.0 if _nir_ok(v) else 0.5
        elif m["ssn"]:
            score = 1.5
        elif m["nino"]:
            score = 1.6
        elif m["dni"] or m["nie"]:
            score = 1.6 if _dni_ok(v) else 0.6
        elif m["fiscale"]:
            score = 1.8 if _fiscale_ok(v) else 0.6
        elif m["steuer"]:
            score = (1.1 if " " in v else 0.8) if _steuer_ok(v) else 0.4
        elif m["person"]:
            score = 1.1 if _luhn_ok(_digits(v)[-10:]) else 0.3
        elif m["passport"]:
            score = 0.6 if re.fullmatch(r"[A-Z]{1,2}\d{6,8}", v) else 0.3
        else:
            score = 0.6 if _luhn_ok(v) or _bsn_ok(v) else 0.1
        yield m.start(), m.end(), "national_id", score + (0.8 if near else 0)


def _addresses(text: str) -> Iterator[tuple[int, int, str, float]]:
    for m in _ADDRESS.finditer(text):
        end = m.end()
        if (f := _FLAT_AFTER.match(text, end)) is not None:
            end = f.end()
        yield m.start(), end, "address", 1.5


def _titled(before: str) -> bool:
    """Whether the text ends with a title and a blank."""
    bare = before.rstrip()
    return bare != before and bare.rsplit(None, 1)[-1].rstrip(".").lstrip("\"'({[") in _TITLES if bare else False


def _led(before: str) -> bool:
    """Whether the text ends with a word that leads to a person, punctuation aside."""
    bare = before.rstrip(" \t\r\n\"'(:=,")
    word = bare.rsplit(None, 1)[-1].lstrip("\"'({[").lower() if bare else ""
    return word in _LEADS or word.endswith("-by")


_COMMA, _INITIAL = re.compile(rf"[{_UP}{_LOW}],[ \t\r\n]"), re.compile(rf"[{_UP}]\.")


def _each(pattern: re.Pattern, trigger: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches near what ``trigger`` finds; the next may begin within the last."""
    for lo, hi in _windows(trigger, text, 60, 80):
        pos = lo
        while (m := pattern.search(text, pos, hi)) is not None:
            yield m
            pos = m.start() + 1 if pattern is _INITIAL_FIRST else max(m.end(1), m.start() + 1)


def _names(text: str) -> Iterator[tuple[int, int, str, float]]:
    common = common_words()

    def usual(word: str) -> bool:
        return word.lower() in common

    def form(word: str) -> bool:
        """A common word, or a form of one that may begin a sentence."""
        w = word.lower()
        return w in common or any(w.endswith(e) and (w[: -len(e)] in common or w[: -len(e)] + "e" in common) for e in ("ed", "s", "es", "ing", "e", "er", "en"))

    def cues(start: int, end: int) -> float:
        before = text[max(0, start - 40) : start]
        follows = _TRAIL.match(text, end) is not None or _JOINED.match(text, end) is not None
        leads = _led(before) or _LISTED.search(before) is not None
        return (0.8 if _titled(before) else 0) + (0.4 if leads else 0) + (0.4 if follows else 0)

    def family_score(family: str, end: int, lone: float = 0.5) -> float:
        """0.6 for an uncommon family name, less for common words and things named after persons."""
        words = [w for w in re.split(r"[\s\-]+", family) if w[0].isupper()]
        if any(w in _PLACES_AND_TIMES or len(w) < 3 and w.isupper() or w in _TITLES for w in words):
            return -2.0
        score = 0.6 if any(not usual(w) for w in words) else -0.1
        m = _BEHIND.match(text, end)
        if m is not None and (m[2] in THINGS or m[1] is not None):
            score -= 0.8 if m[2] or usual(m[1]) else lone
        return score

    def given_score(word: str) -> float:
        if word in GIVEN or word.isupper() and word.capitalize() in GIVEN:
            return 0.6
        return -0.5 if word in _DETERMINERS else 0.0 if form(word) else 0.4

    pos = 0
    while (m := _GIVEN_FIRST.search(text, pos)) is not None:
        pos = m.start() + len(m[1])
        score = family_score(m[3], m.end()) + given_score(m[1])
        if score < 0.2 or re.split(r"[\s\-]+", m[3])[-1] in GIVEN:
            continue
        if m[1].isupper() and m[3].isupper() and m[1].capitalize() not in GIVEN:
            continue
        if m[3][0].islower() and m[1] not in GIVEN:
            score -= 0.3  # a preposition rather than a part of the name
        score += cues(m.start(), m.end()) - (0.3 if "\n" in text[m.start() : m.end()] and m[1] not in GIVEN else 0)
        if m[2]:
            score += 0.2  # initials between the two
        if score >= THRESHOLD:
            yield m.start(), m.end(), "name", score
            pos = m.end()
    for m in _each(_FAMILY_FIRST, _COMMA, text):
        if m[1] in GIVEN:
            continue
        before = text[max(0, m.start() - 24) : m.start()]
        lead = _GIVEN_LEAD.search(before)
        if lead and given_score(lead[1]) > 0 and not _led(before) and not _titled(before):  # "Given Family, Given ..." is a list
            continue
        given = m[2].split("-")[0]
        score = family_score(m[1], m.end()) + given_score(given) - (0.0 if given in GIVEN else 0.2)
        start = m.start()
        if m[1][0].islower() and text[start - 2 : start - 1].isalpha():  # the preposition of the word in front
            start = m.end(1) - len(m[1].split()[-1])
        yield start, m.end(), "name", score + cues(start, m.end())
    for m in _each(_INITIAL_FIRST, _INITIAL, text):
        yield m.start(), m.end(), "name", 0.4 + family_score(m[2], m.end(), 0.3) + cues(m.start(), m.end())
    for m in _each(_INITIAL_LAST, _INITIAL, text):
        yield m.start(), m.end(), "name", 0.4 + family_score(m[1], m.end()) + cues(m.start(), m.end())


_FINDERS = (_emails, _phones, _national_ids, _addresses, _names)
# a quoted value of a record, as in SQL
_QUOTED = re.compile(r"['\"]")


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the places in ``text``, from 0, in order."""
    found = [s for finder in _FINDERS for s in finder(text)]
    spans = [s for s in found if s[3] >= THRESHOLD]
    for s in found:  # a quoted number in a record that holds another of the person's data
        if s[2] == "national_id" and 0.6 <= s[3] < THRESHOLD and _QUOTED.match(text, s[1]) and any(0 < s[0] - x[1] <= 8 and _QUOTED.match(text, x[1]) for x in spans):
            spans.append((*s[:3], THRESHOLD))
    spans.sort(key=lambda s: (-s[3], s[0] - s[1], s[0]))
    kept: list[tuple[int, int, str, float]] = []
    taken = bytearray(len(text) + 1)
    for s in spans:
        if not any(taken[s[0] : s[1]]):
            taken[s[0] : s[1]] = b"\x01" * (s[1] - s[0])
            kept.append(s)
    return sorted(kept)


def replace(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for start, end, kind, _ in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


_PLACES = "array<struct<start_pos:int,end_pos:int,kind:string,score:double>>"


def redacted(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``text`` replaced, and ``places`` in the old text.

    A place is (start_pos, end_pos, kind, score): its first character, counted
    from 1, and its last.
    """

    @F.pandas_udf(f"struct<text:string,places:{_PLACES}>")
    def work(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = find(t) if t else []
            rows.append((replace(t, spans) if t is not None else None, [{"start_pos": a + 1, "end_pos": z, "kind": k, "score": round(s, 3)} for a, z, k, s in spans] if t is not None else None))
        return pd.DataFrame(rows, columns=["text", "places"])

    keep = [c for c in documents.columns if c not in (text, "places", "_pii")]
    return spread(documents.select(*keep, text)).select(*keep, work(F.col(text)).alias("_pii")).select(*keep, F.col("_pii.text").alias(text), F.col("_pii.places").alias("places"))


def places(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start_pos, end_pos, kind, score): one row per place."""
    return found.select(key, F.explode("places").alias("p")).select(key, "p.*")
