"""Personal information in free text: a semi-Markov conditional random field.

The text is cut into segments, each an entity of one type or a single character
of none. A segment's weight is the sum over features of the *whole* span: its
shape, its parts, the words round it. Characters of no entity weigh 0, so the
weight of a segmentation is that of its entities, and the best one is found by
dynamic programming over the ends of the candidate spans, whose length is
bounded. Boundaries and types are thus chosen jointly: a surname inside an email
address or a number inside a street address loses against the longer span.

Candidate spans come from loose patterns, which say only where an entity could
stand; whether it is one is left to the weights. They are trained by
``pii_train`` and kept in ``pii_weights.json``.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Written, spread

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
WEIGHTS = Path(__file__).with_name("pii_weights.json")
#: Bits of the name gazetteer for each of its words, and places that a word sets. One word in 170,000 is taken for a name by chance.
WORD_BITS, HASHES = 32, 8
#: The gazetteer has 2 MB at least and 256 MB at most, so that it may be broadcast; that is enough for 67 million words, beyond which chance hits grow.
LEAST_BITS, MOST_BITS = 24, 31
#: Characters before a house number in which its street begins.
STREET = 160

# Particles of surnames, name titles, names that are also words, street words, labels of numbers.
PARTICLES = "de la|de las|de los|van der|van den|von der|van|von|de|del|della|di|da|dos|du|le|la|ten|ter|zu|af|al|el|bin|ben|mac|mc|st\\."
TITLES = "dr|prof|mr|mrs|ms|miss|herr|frau|mme|mlle|monsieur|madame|señor|señora|sr|sra|don|doña"
AMBIGUOUS = frozenset("may will mark rose grace art joy frank bo stone winter reed field rivers harrow june april august hope faith dawn bill jack rob pat sue bob drew grant chase miles lily ivy iris daisy ruby pearl amber summer autumn hunter cook baker smith carter mason page brook brooks lane hill wood woods forest ford marsh moore english french gray grey brown white black green young long short best sharp wise noble bishop king knight pope abbot major max guy gene dean ray jay drake rich".split())
STREETS = "Street|Road|Lane|Avenue|Terrace|Court|Drive|Close|Way|Square|Row|Hill|Place|Crescent|Gardens|Grove|Park|Walk|Boulevard|Parade|Quay|Mews|St|Rd|Ln|Ave|Ter|Ct|Dr|Cl|Sq|Pl|Blvd|Cres"
STRASSE = "straße|strasse|str\\.|weg|gasse|ring|platz|allee|damm|ufer|steig|pfad|chaussee|markt|wall|graben|straat|laan|plein|gracht|gatan|vägen|vej"
RUE = "rue|bd|bld|boulevard|av\\.|avenue|chemin|place|quai|allée|impasse|route|cours|passage|square|ruelle"
CALLE = "Calle|C/|Avda\\.|Avenida|Av\\.|Plaza|Pza\\.|Paseo|Camino|Ronda|Travesía|Carretera|Ctra\\."
VIA = "Via|Viale|Piazza|Corso|Vicolo|Largo|Rua|Travessa|Praça|Estrada|Alameda|ulica|Ulica|ul\\.|aleja|al\\.|plac"
VIA_LINKS = "das|dos|da|do|de|del|della|dei|degli|di|e|św\\."
# Words that begin a sentence or phrase and are no given names, and days and months.
FUNCTION_WORDS = frozenset("ask see call write contact talk check send visit tell meet read use dear hello hallo hi from to cc with for by at on in of and or but the this that these those our your their his her its some any all both each every many most more new old no not please thanks thank best kind warm der die das den dem des ein eine einen einem diese dieser dieses diesen meine deine seine ihre unsere unser mein dein kein keine sehr viele vielen liebe lieber schöne beste bitte danke wir sie ich es er man wenn sollten sollte können haben sind ist le la les un une des ce cette ces mon ma mes notre votre merci bien nous vous il elle el los las una unos este esta estos mi su nuestro gracias un muchas i we you he she they it if when where what who how why is are was were do does did can could should would will shall may must have has had mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep oct nov dec monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split())
PHONE_LABELS = frozenset("tel tél phone telephone telefon teléfono téléphone mobile mobil móvil portable fax handy call ring dial line direct directo directe durchwahl telefonisch appelez llámame llame anrufen joindre t m p appeler rufnummer numéro número reach text".split())
ID_LABELS = frozenset("ssn social security passport passeport pasaporte reisepass tax id identity card identity ni insurance national personal personnummer personnel ausweis personalausweis steuer steuernummer idnr dni nie nif documento fiscal sozialversicherung badge licence license".split())
OTHER_LABELS = frozenset("parcel catalogue catalog invoice order run batch version tile lane sample gene coordinates rechnung facture factura ip server host relay rechner serveur servidor records rows lignes filas einträge replaces ratio percent isbn issn ticket case ref reference tracking serial build article item lot po inv paket colis paquete id esmtp with".split())

_BASE64 = re.compile(r"(?:^[A-Za-z0-9+/]{56,}={0,2}\r?$\n?){2,}(?:^[A-Za-z0-9+/]+={0,2}\r?$)?|^[A-Za-z0-9+/]{64,}={0,2}\r?$(?:\n^[A-Za-z0-9+/]+={0,2}\r?$)?", re.M)
_ID_HEADER = re.compile(r"[>| \t]*(?:message-id|in-reply-to|references|content-id|resent-message-id)[ \t]*:", re.I)
_PLAIN_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_PART = re.compile(r"[\w.+%'-]+")
_AT_SIGNS = (" AT ", "at)", "at]", "at}", "at>", "AT)", "AT]", "At)", "At]", "ät)", "arroba", "at )", "at ]", " dot ", "＠")
_DOT_WORD = re.compile(r"(?i)[^a-z](?:dot|punkt|point|punto)[^a-z]")
_AT = re.compile(r" ?[\[({<] ?(?:at|AT|At|ät|arroba) ?[\])}>] ?| AT | at (?=[\w-]+ dot )|＠")
_DOT_BEFORE = re.compile(r"(?<![\w.+%'-])[\w.+%'-]+ (?:dot|DOT|punkt|point|punto) \Z")
_LOCAL = re.compile(r"[\w.+%'-]*[A-Za-z0-9_]")  # on the text before the sign, read backwards
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[\[({<] ?(?:dot|DOT|Dot|punkt|point|punto) ?[\])}>] ?| DOT | dot |\.)[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"(?=[+(\d][\d .\-/()]{6})[+(\d]\d*(?:(?:[ .\-/]|\) ?|[ .\-/]?\()\d+)*")
_ALNUM = re.compile(r"[A-Z](?:[A-Z] \d\d \d\d \d\d [A-Z]|[A-Z]?\d{2}[A-Z0-9]{4,8})(?![\w@\-])")
_STREET_NUMBER_FIRST = re.compile(
    rf"(?<![\w@.,:/\-])\d\d{{0,4}}(?:[A-Za-z]| ?(?:bis|ter|quater))?,? (?:(?:[A-Z][\w'’-]+\.? ){{1,3}}?(?:{STREETS})\b|(?P<fr>(?:{RUE}) (?:(?:de la|de l['’]|du|des|de|d['’]) ?)?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)?))"
)
_STREET_ES = re.compile(rf"(?<!\w)(?:{CALLE}) ?(?:(?:del|de la|de los|de las|de) )?[A-ZÀ-Þ][\w-]+(?: [A-ZÀ-Þ][\w-]+)?,?(?: (?:n[º°]\.?|núm\.|No\.))?\Z")
_VIA_NAME = rf"(?:(?:{VIA_LINKS}) )*[A-ZÀ-ÞĄ-Ż][\w'’-]+(?: (?:(?:{VIA_LINKS}) )*[A-ZÀ-ÞĄ-Ż][\w'’-]+){{0,3}}"
_STREET_VIA = re.compile(rf"(?<!\w)(?:{VIA}) {_VIA_NAME},?(?: n[º°.]?\.?)?\Z")
_STREET_NUMBER_VIA = re.compile(rf"(?<![\w@.,:/\-])\d{{1,4}}[A-Za-z]?,? (?:{VIA}) {_VIA_NAME}")
_STREET_WORDS = frozenset(STREETS.split("|"))
_VIA_WORDS = tuple(x.replace("\\", "") + " " for x in VIA.split("|"))
_STREET_AM = re.compile(r"(?<!\w)(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den|Hinter der|Vor dem) [A-ZÄÖÜ][\wäöüß-]+\Z")
_STREET_STARTS = frozenset(x.replace("\\", "") for x in f"{CALLE}|{VIA}".split("|")) | {"Am", "An", "Im", "In", "Auf", "Zum", "Zur", "Unter", "Hinter", "Vor"}
_REPLY_SIGNS = re.compile(r"[>|]")
_CAPITAL_LAST = re.compile(r"[A-ZÀ-Þ][\w'’-]+\Z")
_STREET_MORE = re.compile(rf" (?:{STREETS})\b")
_HOUSE = re.compile(r" \d{1,4}(?: ?[a-z](?!\w))?(?!\w|[.,:]\d)")
_STREET_DE = re.compile(rf"(?<!\w)[A-ZÄÖÜ][\wäöüß-]*(?:{STRASSE})\Z")
_STRASSE_ENDS = tuple(x.replace("\\", "") for x in STRASSE.split("|"))
_CAP = re.compile(r"[A-ZÀ-ÖØ-Þ][\w'’]*")
_IN_WORD = re.compile(r"[\w@.+/=\-'’]")
_GOES_ON = frozenset("@+/=")
_PARTICLE = re.compile(rf"(?<![\w])((?:{PARTICLES}) )$", re.I)
_INITIAL = re.compile(r"(?<![\w.])[A-ZÀ-Þ]\.$")
_INITIAL_NAME = re.compile(r"[A-ZÀ-Þ]\. ([A-ZÀ-ÖØ-Þ][\w'’]+)")
_CAP_BEFORE = re.compile(r"(?<![\w@.+/=\-'’])[A-ZÀ-ÖØ-Þ][\w'’]+\Z")
_TITLED = re.compile(r"\.? ([A-ZÀ-ÖØ-Þ][\w'’-]+)")
_TITLED_MORE = re.compile(rf"(?: [A-ZÀ-Þ]\.)?(?: (?:{PARTICLES}))? [A-ZÀ-ÖØ-ÞĄ-Ż][\w'’-]+(?![\w@+/=])")
_PAIR = re.compile(r"([A-ZÀ-ÖØ-ÞĄ-Ż][a-zà-öø-ÿą-ż'’-]{2,}) (?=[A-ZÀ-ÖØ-ÞĄ-Ż])(?:[A-Z]\. )?([A-ZÀ-ÖØ-ÞĄ-Ż][a-zà-öø-ÿą-ż'’-]{2,})(?![\w@+/='’]|\.\w| [A-ZÀ-Þ])")
_TITLE_WORDS = frozenset("Dr Prof Mr Mrs Ms Miss Herr Frau Mme Mlle Monsieur Madame Señor Señora Sr Sra".split())
_TITLE = re.compile(rf"(?<!\w)(?:{TITLES})\.? $", re.I)
_PREV = re.compile(r"([\w'’]+|[^\w\s])[ \t]*\Z")
_NEXT = re.compile(r"[ \t]*([\w'’]+|[^\w\s])")
_DIGITS = re.compile(r"\d+")
_UPPER = re.compile(r"[A-Z]")
_NO_NUMBER = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}|\d{1,4}/\d{1,2}/\d{2,4}")  # an IPv4 address, a date
_GLUED_LEFT = re.compile(r"[\w@.,:/\-]")
_GLUED_RIGHT = re.compile(r"[\w@]|\.\d")
_DATED_FIELD = re.compile(r"(?:received|date|sent|x-[\w-]+)\s*:", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[ \t]*\r?\n(?!\r?\n)[>| \t]*(?:[^\W\d_]{1,4}>[>| \t]*)*")
_TAG = re.compile(r"</?(?:p|div|b|i|u|em|strong|span|br|a|li|ul|td|tr|font|html|body)\b[^<>\n]*>|&nbsp;")
_END = re.compile(r"[ \t]*\r?(?:\n|\Z)")
_MARKS = re.compile(r"[>| \t]*(?:[^\W\d_]{1,4}>[>| \t]*)*")
_ADDRESS_FIELD = re.compile(r"(?:from|to|cc|bcc|reply-to|sender|von|an|de|à|para)\s*:", re.I)
_OPEN_ID = re.compile(r"[0-9a-f]{6,}|\d{5,}")

Span = tuple[int, int, str, list[str]]


class Gazetteer:
    """Given names and surnames of the corpus's address headers, as a Bloom filter. A word may be taken for a name by chance, rarely."""

    def __init__(self, bitmap: bytes | None = None, words: dict[str, str] | None = None):
        """``words``: flags ``g``, ``s`` or ``gs`` by lower-case word, for training and tests."""
        self.bitmap, self.words, self.seen = bitmap, dict(words or {}), {}

    def _has(self, key: str) -> bool:
        h, mask = xxhash.xxh64_intdigest(key.encode(), seed=42), len(self.bitmap) * 8 - 1
        low, step = h & 0xFFFFFFFF, h >> 32 | 1
        for i in range(HASHES):
            at = low + i * step & mask
            if not self.bitmap[at >> 3] >> (at & 7) & 1:
                return False
        return True

    def flags(self, word: str) -> str:
        low = word.lower()
        if (f := self.words.get(low)) is None:
            f = "" if self.bitmap is None else "g" * self._has("g:" + low) + "s" * self._has("s:" + low)
        return f

    def note(self, word: str) -> tuple[str, int, bool] | tuple[()]:
        """Flags of a capitalised word, its length without a genitive and whether it is a title; empty if it is nothing of these. Kept in ``seen``."""
        bare = word[:-2] if word[-2:] in ("'s", "’s") else word
        f, title = self.flags(bare), bare in _TITLE_WORDS
        noted = (f, len(bare), title) if f or title else ()
        if len(self.seen) < 200_000:
            self.seen[word] = noted
        return noted


def build_gazetteer(docs: DataFrame, text: str = "text") -> bytes:
    """Bloom filter of the words of all display names in the header of every message, as large as their number asks for.

    The distinct words are written to the shared checkpoint folder and counted on the way. The bitmap is put together on the
    executors in rows of 4 KB.
    """
    head = F.substring_index(F.substring_index(F.col(text), "\n\n", 1), "\r\n\r\n", 1)
    head = F.when(F.instr(head, "@") > 0, head)
    quoted = F.regexp_extract_all(head, F.lit(r"""\"([^<>"@\n,:()\[\]]{2,}, [^<>"@\n,:()\[\]]{2,})\"[ \t]<[^<>\s@]+@"""), F.lit(1))
    before = F.regexp_extract_all(head, F.lit(r"""(?m)(?:[:,]|^)[ \t]*"?([^<>"@\n,:()\[\]]{2,})"?[ \t]<[^<>\s@]+@"""), F.lit(1))
    after = F.regexp_extract_all(head, F.lit(r"@\S+ \(([^()<>@\n]{2,})\)"), F.lit(1))
    shown = docs.select(F.explode(F.concat(quoted, before, after)).alias("n")).groupBy("n").agg(F.lit(1).alias("one")).select(F.lower(F.trim("n")).alias("n"))
    comma = F.instr("n", ", ") > 0
    words = lambda c: F.split(F.trim(c), r"\s+")
    first, rest = F.element_at(words(F.col("n")), 1), F.slice(words(F.col("n")), 2, 1 << 20)
    given = F.when(comma, words(F.substring_index("n", ", ", -1))).otherwise(F.array(first))
    sur = F.when(comma, words(F.substring_index("n", ", ", 1))).otherwise(rest)
    tagged = F.concat(F.transform(given, lambda w: F.concat(F.lit("g:"), w)), F.transform(sur, lambda w: F.concat(F.lit("s:"), w)))
    tokens = shown.where(~F.col("n").rlike(r"\d|=\?")).select(F.explode(tagged).alias("w")).where(F.col("w").rlike(r"^[gs]:\p{L}[\p{L}'’-]+$"))
    tokens = tokens.where(~F.col("w").rlike(rf"^[gs]:({PARTICLES}|{TITLES})$"))
    held = Written(tokens.distinct(), n=F.count("*"))
    bits = min(MOST_BITS, max(LEAST_BITS, (held.metrics["n"] * WORD_BITS - 1).bit_length()))
    h = F.xxhash64("w")
    low, step = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    places = held.df.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: low + i * step)).alias("b"))
    places = places.select((F.col("b").bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("b"))
    rows = places.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    held.drop()
    out = bytearray(1 << (bits - 3))
    for r in rows:
        at = (r.k - 1) * len(r.bits)
        out[at : at + len(r.bits)] = r.bits
    return bytes(out)


def _before(text: str, a: int) -> str:
    """The text shortly before ``a``, with line breaks, reply marks and markup as blanks."""
    part = text[max(0, a - 72) : a]
    if "<" in part or "&" in part:
        part = _TAG.sub(" ", part)
    return _BREAK.sub(" ", part) if "\n" in part else part


def _line(text: str, a: int) -> str:
    """The part of the line before ``a``, without reply marks."""
    line = text[text.rfind("\n", 0, a) + 1 : a]
    return line[_MARKS.match(line).end() :]


class Contexts:
    """What stands round the spans of one text. Spans share their ends, so either side is looked at once."""

    def __init__(self, text: str):
        self.text = text
        self.lefts: dict[int, tuple[str, str]] = {}
        self.rights: dict[int, tuple[str, str]] = {}

    def left(self, a: int) -> tuple[str, str]:
        """The line before ``a``, without reply marks and markup, and the word or sign before ``a``; at a line's start the word before the break, else ``^``."""
        if a in self.lefts:
            return self.lefts[a]
        text = self.text
        line = _line(text, a)
        if line.endswith((">", ";")):
            line = _TAG.sub(" ", line)
        if p := _PREV.search(line[-24:]):
            prev = p[1].lower()
        else:
            start = text.rfind("\n", 0, a)
            p = _PREV.search(text[max(0, start - 24) : start].rstrip("\r")) if start > 0 else None
            prev = p[1].lower() if p and p[1][-1].isalnum() else "^"
        self.lefts[a] = line, prev
        return line, prev

    def right(self, b: int) -> tuple[str, str]:
        """The word or sign after ``b``, or, at a line's end, none and the word with which the sentence goes on beyond it."""
        if b in self.rights:
            return self.rights[b]
        text, end = self.text, b
        while text[end : end + 1] in ("<", "&") and (m := _TAG.match(text, end)):
            end = m.end()
        nxt = on = ""
        if n := _NEXT.match(text, end):
            nxt = n[1].lower()
        elif (m := _BREAK.match(text, end)) and (n := _NEXT.match(text, m.end())) and n[1][0].islower():
            on = n[1]
        self.rights[b] = nxt, on
        return nxt, on

    def around(self, a: int, b: int) -> tuple[str, str, str]:
        """``(line, prev, next)``. A span that is alone in its line ends with ``$``, any other may go on in the next line."""
        line, prev = self.left(a)
        nxt, on = self.right(b)
        return line, prev, nxt or (on if line.strip() else "") or "$"


def _labels(before: str) -> list[str]:
    """Which kind of label stands among the last words before a number."""
    near = _LETTERS.findall(before[-44:].lower())[-4:]
    for i, w in enumerate(reversed(near)):
        if w in PHONE_LABELS:
            return ["lab=phone" if i < 2 else "lab=phone-far"]
        if w in ID_LABELS:
            return ["lab=id"]
        if w in OTHER_LABELS:
            return ["lab=other" if i < 2 else "lab=other-far"]
    return ["lab=none"]


def _shape(s: str) -> str:
    return _DIGITS.sub(lambda m: str(len(m[0])), s)


def _number_facts(around: Contexts, a: int, b: int, shape: str, dated: bool | None = None) -> list[str]:
    """``dated``: for a span within a chain of groups, whether its line is a dated field, so that no long line is read for each."""
    text = around.text
    s = text[a:b]
    if dated is None:
        line, prev, nxt = around.around(a, b)
    else:
        p = _PREV.search(text[max(0, a - 24) : a])
        nxt, on = around.right(b)
        line, prev, nxt = "", p[1].lower() if p else "^", nxt or on or "$"
    f = _labels(_before(text, a))
    f += ["bias", "shape=" + shape, f"digits={sum(map(str.isdigit, s))}", "prev=" + prev]
    if s[0] == "+" or s.startswith("00"):
        f.append("international")
    if "(" in s:
        f.append("bracket")
    if s[0] == "0":
        f.append("zero")
    if s.isdigit():
        f.append("plain")
    if nxt in ("-", "_", "/", ":", "%"):
        f.append("goes-on")
    if _DATED_FIELD.match(line) if dated is None else dated:
        f.append("header")
    return f


def _numbers(around: Contexts, out: list[Span]) -> None:
    text = around.text
    for m in _NUMBER.finditer(text):
        s, a = m[0], m.start()
        if len(s) < 7 or _NO_NUMBER.fullmatch(s) or _GLUED_LEFT.match(text[a - 1 : a]) or _GLUED_RIGHT.match(text, m.end()):
            continue
        # A chain of groups may hold several numbers: each run of whole groups of a number's length is a candidate.
        blanks = [i for i, c in enumerate(s) if c == " "] if " " in s else []
        ends, first, dated = [*blanks, len(s)], 0, None
        for i in [0, *(k + 1 for k in blanks)]:
            while ends[first] - i < 7:
                if (first := first + 1) == len(ends):
                    break
            for e in islice(ends, first, None):
                if e - i > 32:
                    break
                x = s[i:e]
                if 7 <= sum(map(str.isdigit, x)) <= 15 and not _NO_NUMBER.fullmatch(x) and x.count("(") == x.count(")"):
                    if i and dated is None:
                        dated = bool(_DATED_FIELD.match(_line(text, a)))
                    f = _number_facts(around, a + i, a + e, _shape(x), dated)
                    out.append((a + i, a + e, "phone", f))
                    if x[0] not in "+(":
                        out.append((a + i, a + e, "id_number", f))
            if first == len(ends):
                break
    for m in _ALNUM.finditer(text):
        if sum(map(str.isdigit, m[0])) >= 5 and not _GLUED_LEFT.match(text[m.start() - 1 : m.start()]):
            f = _number_facts(around, m.start(), m.end(), _UPPER.sub("A", _shape(m[0])))
            out.append((m.start(), m.end(), "id_number", f))


def _in_id_field(text: str, a: int) -> bool:
    """Whether ``a`` lies in a header field that holds message ids, or in a line that continues one."""
    start = text.rfind("\n", 0, a) + 1
    while start and text[start] in " \t":
        start = text.rfind("\n", 0, start - 1) + 1
    return bool(_ID_HEADER.match(text, start))


def _emails(text: str, out: list[Span]) -> None:
    def add(a: int, b: int, kind: str) -> None:
        local = _LOCAL_PART.match(text, a)[0]
        f = ["bias", "kind=" + kind]
        if _in_id_field(text, a):
            f.append("id-header")
        if _OPEN_ID.match(local):
            f.append("hex")
        prev = text[a - 1 : a]
        f += ["prev=" + (prev if prev in "<(:" else "other"), "next=>" if text[b : b + 1] == ">" else "next=other"]
        out.append((a, b, "email", f))

    def before(at: int) -> re.Match | None:
        n = 64  # doubled as long as the local part goes on
        while (run := _LOCAL_PART.match(back := text[max(0, at - n) : at][::-1])) and run.end() == n:
            n *= 2
        return _LOCAL.match(back)

    at = text.find("@")
    while at >= 0:
        local, host = before(at), _PLAIN_HOST.match(text, at + 1)
        if local and host:
            add(at - local.end(), host.end(), "plain")
        at = text.find("@", at + 1)
    if any(x in text for x in _AT_SIGNS):
        for m in _AT.finditer(text):
            local, host = before(m.start()), _HOST.match(text, m.end())
            if local and host and not host[0].replace(".", "").isdigit():
                a, dotted = m.start() - local.end(), _DOT_WORD.search(host[0])
                while dotted and (more := _DOT_BEFORE.search(text, max(0, a - 80), a)):
                    a = more.start()
                add(a, host.end(), "at-dot" if dotted else "at")


def _addresses(around: Contexts, out: list[Span]) -> None:
    text = around.text

    def add(a: int, b: int, kind: str) -> None:
        line, prev, nxt = around.around(a, b)
        f = ["bias", kind, "prev=" + prev, "comma" if nxt == "," else "nocomma"]
        if prev == "^":
            f.append("line")
        if prev in OTHER_LABELS:
            f.append("other-label")
        out.append((a, b, "address", f))

    for m in _STREET_NUMBER_FIRST.finditer(text):
        if not m["fr"]:
            add(m.start(), m.end(), "en")
            # "12 Park Road": the shorter reading ends at the first street word, the longer one at a second.
            if more := _STREET_MORE.match(text, m.end()):
                add(m.start(), more.end(), "en-longer")
            continue
        add(m.start(), m.end(), "fr")
        rest, _, last = m[0].rpartition(" ")
        if last[0].isupper() and _CAPITAL_LAST.search(rest):
            add(m.start(), m.start() + len(rest), "fr-shorter")
    if any(x in text for x in _VIA_WORDS):
        for m in _STREET_NUMBER_VIA.finditer(text):
            add(m.start(), m.end(), "via")
    for m in _HOUSE.finditer(text):
        at = m.start()
        if not text.endswith(_STRASSE_ENDS, 0, at) and not (word := text[text.rfind(" ", max(0, at - 40), at) + 1 : at])[:1].isupper() and word[:1] not in ("n", ">", "|"):
            continue  # a street ends with a name or a mark of its number
        before = text[max(0, at - STREET) : at]
        if before.endswith(_STRASSE_ENDS) and (name := _STREET_DE.search(before)):
            add(m.start() - len(name[0]), m.end(), "de")
        elif not _STREET_STARTS.isdisjoint(_REPLY_SIGNS.sub(" ", before).split()):
            for kind, pattern in (("es", _STREET_ES), ("via", _STREET_VIA), ("de-am", _STREET_AM)):
                if name := pattern.search(before):
                    add(m.start() - len(name[0]), m.end(), kind)


def _names(around: Contexts, gaz: Gazetteer, out: list[Span]) -> None:
    text, flags = around.text, gaz.flags
    units: list[tuple[int, int, str]] = []  # start, end, flags
    titled: list[tuple[int, int]] = []
    seen, note = gaz.seen.get, gaz.note
    for m in _CAP.finditer(text):
        word = m[0]
        if (noted := seen(word)) is None:
            noted = note(word)
        if not noted:
            continue
        f, size, title = noted
        start, end = m.span()
        if title and (t := _TITLED.match(text, end)) and not flags(t[1]):
            titled.append(t.span(1))
        if f and not _IN_WORD.match(text[start - 1 : start]) and text[end : end + 1] not in _GOES_ON:
            units.append((start, start + size, f))
    pairs = []
    for m in _PAIR.finditer(text):
        first, second = m.groups()
        if first.lower() in FUNCTION_WORDS or second.lower() in FUNCTION_WORDS or second in _STREET_WORDS or seen(first) or seen(second):
            continue
        if not _IN_WORD.match(text[m.start() - 1 : m.start()]):
            pairs.append(m.span())
    if not units and not titled and not pairs:
        return
    ends = {e: (s, f) for s, e, f in units}
    starts = {s: (e, f) for s, e, f in units}

    starting: dict[int, tuple] = {}

    def add(a: int, b: int, pattern: str) -> None:
        # What a start gives is the same for every name that begins there.
        if (start := starting.get(a)) is None:
            line, prev = around.left(a)
            starting[a] = start = line, prev, not line.strip(), bool(_TITLE.search(line[-12:])), bool(_ADDRESS_FIELD.match(line))
        line, prev, blank, titled, field = start
        nxt, on = around.right(b)
        if not nxt:
            nxt = on if on and not blank else "$"
        word = text[a:b]
        f = ["bias", pattern, "prev=" + prev, "next=" + nxt]
        if pattern in ("??", "T??"):  # contexts of words that nothing else tells to be names weigh for themselves
            f = [pattern, pattern + ":prev=" + prev, pattern + ":next=" + nxt, pattern + ":first=" + word.partition(" ")[0].lower()]
            if blank:
                f.append(pattern + ":line")
        elif " " not in word and word.lower() in AMBIGUOUS:
            f = ["bias", "ambiguous", "amb:prev=" + prev, "amb:next=" + nxt]
            if prev.isdigit() or nxt.isdigit():
                f.append("amb:number")
            if blank and nxt in (",", "$", "-", ":"):
                f.append("amb:line")
            elif prev in ".?!^":
                f.append("amb:start")
        if titled:
            f.append("title")
        if word.isupper() and len(word) > 3:
            f.append("upper")
        if nxt == "<" or nxt == '"' or field:
            f.append("field")
        out.append((a, b, "name", f))

    # Surnames that no header shows: after a title, or after a given name with or without an initial.
    for s, e in titled:
        add(s, e, "T?")
        if m := _TITLED_MORE.match(text, e):
            add(s, m.end(), "T??")
    # Two words that no header shows.
    for s, e in pairs:
        add(s, e, "??")
    for s, e, f in units:
        if "g" in f:
            add(s, e, "G")
            if text[e : e + 1] == " ":
                if (m := _CAP.match(text, e + 1)) and (e + 1) not in starts and m.end() - m.start() > 2:
                    add(s, m.end(), "G?")
                elif (m := _INITIAL_NAME.match(text, e + 1)) and m.start(1) not in starts:
                    add(s, m.end(), "GI?")
            if text[s - 2 : s] == ", " and (m := _CAP_BEFORE.search(text, max(0, s - 26), s - 2)) and m.start() not in starts:
                add(m.start(), e, "?,G")
        if "s" not in f:
            continue
        a = s
        while p := _PARTICLE.search(text[max(0, a - 9) : a]):
            a -= len(p[1])
        if a == s and text[s - 1 : s] == " " and "s" in ends.get(s - 1, (0, ""))[1] and "g" not in ends[s - 1][1]:
            a = ends[s - 1][0]  # a surname of two words
        kind = "P" * (a != s) + "S"
        add(a, e, kind)
        if text[a - 1 : a] == " ":
            if "g" in (left := ends.get(a - 1, (0, "")))[1]:
                add(left[0], e, "G" + kind)
            elif _INITIAL.search(text[max(0, a - 4) : a - 1]):
                add(a - 3, e, "I" + kind)
                if text[a - 4 : a - 3] == " " and "g" in (left := ends.get(a - 4, (0, "")))[1]:
                    add(left[0], e, "GI" + kind)
        if text[e : e + 2] == ", " and "g" in starts.get(e + 2, (0, ""))[1]:
            add(a, starts[e + 2][0], kind + ",G")


def candidates(text: str, gaz: Gazetteer) -> list[Span]:
    """``(start, end, type, features)`` of every span that could be an entity. Encoded blocks hold none."""
    if "base64" in text:
        text = _BASE64.sub(lambda m: " " * len(m[0]), text)
    out: list[Span] = []
    around = Contexts(text)
    _emails(text, out)
    _numbers(around, out)
    _addresses(around, out)
    _names(around, gaz, out)
    return out


class Model:
    """Weights by type and feature. Training needs sums over all segmentations, tagging the best one."""

    def __init__(self, weights: dict[str, dict[str, float]]):
        self.weights = {k: weights.get(k, {}) for k in TYPES}

    @classmethod
    def load(cls, path: str | Path | None = None) -> Model:
        return cls(json.loads(Path(path or WEIGHTS).read_text()))

    def score(self, kind: str, features: list[str]) -> float:
        get = self.weights[kind].get
        return sum([get(f, 0.0) for f in features])

    def best(self, spans: list[Span]) -> list[Span]:
        """The segmentation of greatest weight; of equal ones, the one with fewer entities."""
        scored = [(s, e, w, k) for k, (s, e, kind, f) in enumerate(spans) if (w := self.score(kind, f)) > 0]
        if not scored:
            return []
        scored.sort(key=lambda x: (x[1], x[0]))
        ends: list[int] = [0]  # ends so far, the best weight up to each, and what was chosen there
        total: list[float] = [0.0]
        chosen: list[tuple[int, int] | None] = [None]
        for s, e, w, k in scored:
            j = bisect_right(ends, s) - 1
            if (value := total[j] + w) > total[-1] + 1e-12:
                if ends[-1] == e:
                    total[-1], chosen[-1] = value, (j, k)
                else:
                    ends.append(e)
                    total.append(value)
                    chosen.append((j, k))
        out, at = [], len(ends) - 1
        while at > 0:
            j, k = chosen[at]
            out.append(spans[k])
            at = j
        return out[::-1]


def find(text: str, gaz: Gazetteer, model: Model) -> list[Span]:
    """The entities of ``text``, from left to right."""
    return model.best(candidates(text, gaz))


def redact(text: str, gaz: Gazetteer, model: Model) -> str:
    """``text`` with every entity replaced by the placeholder of its type; all else stays as it is."""
    out, at = [], 0
    for s, e, kind, _ in find(text, gaz, model):
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join([*out, text[at:]])


def _per_document(docs: DataFrame, doc_id: str, text: str, schema: str, rows) -> DataFrame:
    """``rows(id, text, gaz, model)`` gives the result rows of one document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((build_gazetteer(docs), Model.load().weights))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, weights = held.value
        gaz, model = Gazetteer(bitmap), Model(weights)
        for b in batches:
            found = [r for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in rows(i, t, gaz, model)]
            columns = list(zip(*found)) if found else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, b.column(0).type if k == 0 else pa.string()) for k, c in enumerate(columns)], names=names)

    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(schema).fields])
    names = out.fieldNames()
    return spread(docs).mapInArrow(task, out)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pii_type, pii_value)``: the distinct entities of each document, exactly as they stand in it.

    Null and empty texts hold none. Repeated documents repeat their rows; ``doc_id`` may be null. An empty table gives an
    empty result.
    """

    def rows(i, t, gaz, model):
        return [(i, k, v) for k, v in sorted({(k, t[s:e]) for s, e, k, _ in find(t, gaz, model)})] if t else []

    return _per_document(docs, doc_id, text, "pii_type string, pii_value string", rows)


def redact_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)``: every document with placeholders for its entities. A null text stays null."""
    return _per_document(docs, doc_id, text, "text string", lambda i, t, gaz, model: [(i, redact(t, gaz, model) if t else t)])
