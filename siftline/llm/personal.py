"""Personal details inside free text: detection, typed placeholders and keyed surrogates."""

from __future__ import annotations

import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shipped, stored

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDER = {"email": "[email]", "phone": "[phone]", "id_number": "[id]", "address": "[address]", "person": "[name]"}

# Patterns. The words of forms, letters and address lines in the languages of the texts. All but the names
# are matched in lower-cased text and start at a sign or a digit, so that a text without details costs little.
_DOT = r"(?:\.| ?[(\[{]dot[)\]}] ?| dot )"
AT = re.compile(r" ?@ ?| ?[(\[{] ?(?:@|at) ?[)\]}] ?")
BARE_AT = re.compile(r" at (?=[a-z][\w-]*(?:\.[a-z]| dot ))")
LOCAL = re.compile(r"(?<![\w.+-])\w[\w.+-]*$")
DOMAIN = re.compile(rf"[a-z][\w-]*(?:{_DOT}[a-z][\w-]+)+")

DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT_WORD = rf"(?:{'|'.join(DIGIT_WORDS)})"
PHONES = (
    ("+", re.compile(r"\+\d[\d /().\-]{6,22}\d(?: ?ext\.? ?\d{1,5})?")),
    ("(", re.compile(r"\((?!(?:19|20)\d\d\))0?\d{2,4}\)[ \-/.]?\d{3,4}[ \-/.]?\d{3,5}(?!\d)")),
    ("0", re.compile(r"0(?:0\d{2}[ \-/.]?\d[\d \-/.]{5,16}\d|\d{2,4}[ ./\-]\d{3,4}[ ./\-]?\d{3,4}|(?: \d){8,12})(?!\w)")),
    ("", re.compile(rf"{_DIGIT_WORD}(?:[ \-]{_DIGIT_WORD}){{2,}}(?:[ \-](?:\d{{2,4}}|{_DIGIT_WORD}))+(?!\w)")),
    ("", re.compile(r"(?:tel|mobile|phone|telefon|handy|fax|m)[.:]{0,2} (?P<n>\(?\d[\d /().\-]{4,16}\d)(?!\w)")),
)
NOT_PHONE = re.compile(r"(?:isbn|issn|doi|patent|invoice|order|ticket|version|grade|#)\W{0,3}(?:\w+\W+)?$")

ID_WORDS = ("social security", "ssn", "national insurance", "ni n", "passport", "reisepass", "id card", "identity card", "personalausweis", "steuer", "tax id", "dni", "nie", "nif", "n.i.f", "sécurité sociale", "sozialversicherung")
ID_LABELLED = re.compile(
    r"(?<!\w)(?:social security(?: number)?|ssn|national insurance(?: number)?|ni (?:number|no\.?)|passport(?: no\.?| number)?|reisepass(?:nummer)?|(?:id|identity) card(?: no\.?| number)?|personalausweis(?:nummer)?|steuer-?id(?:nr\.?|nummer)?|tax id|dni|nie|nif|n\.i\.f\.|(?:numéro|n°|no\.?) de sécurité sociale|sozialversicherungsnummer)"
    r"[ :.#]{1,3}(?P<n>[a-z]{0,3}[ -]?\d(?:[\da-z]|[ -](?=[\da-z]*\d|[a-z]\b)){4,17})(?![\da-z])"
)
ID_SHAPED = re.compile(r"(?<!\w)(?:\d{3}-\d{2}-\d{4}|\d{8}-?[a-z]|[a-z]{2}(?: ?\d{2}){3} ?[a-d]|[a-z]{2}-\d{6}-\d|[xyz]\d{7}-?[a-z])(?!\w)")

_TYPE = r"(?:street|road|lane|close|crescent|avenue|way|terrace|court|drive|place|square|gardens|row|walk|mews|hill|grove|green|park|rise)"
_LEAD = r"(?:rue|calle|avenida|avenue|boulevard|via|viale|plaza|paseo|place|chemin|allée|carrer|quai|impasse)"
_TAIL = r"[\w'’-]*(?:stra(?:ss|ß)e|weg|kamp|gasse|platz|allee|damm|ring|ufer|steig|chaussee|laan|straat|gatan|vägen)"
_WORD = r"[^\W\d][\w'’-]*"
_PLAIN = rf"(?!(?:at|is|to|from|and|with|in|on|lives|address|adresse|anschrift)\b){_WORD}"
_STREET = rf"(?:(?:{_PLAIN} ){{1,3}}{_TYPE}\b|{_LEAD}(?: {_WORD}){{1,4}}|{_TAIL}\b)"
_POST = r"(?:[a-z]{1,2}\d{1,2}[a-z]? \d[a-z]{2}|\d{4,5})"
_TOWN = rf"(?:{_POST} )?{_WORD}(?:(?: {_WORD}){{1,2}}(?= ?(?:\r?$|[\n/;,(.·]| {_POST})))?(?: {_POST})?"
HOUSE = re.compile(r"\d{1,4}(?: ?[a-z])?\b")
STREET_AFTER = re.compile(rf",? {_STREET} ?[,/] ?{_TOWN}", re.MULTILINE)
STREET_BEFORE = re.compile(rf"(?<![\w'’/-])(?:(?:address|adresse|anschrift|dirección|at|is|to|from|and) )*(?P<n>{_STREET}),? $")
TOWN_AFTER = re.compile(rf" ?[,/] ?{_TOWN}", re.MULTILINE)
FLAT = re.compile(r"(?:flat|apt\.?|apartment|unit|wohnung|piso|appartement) \d{1,4}\w?,? $|c/o $")
ADDRESS_LABEL = re.compile(r"^[ \t]*(?:address|adresse|anschrift|postal address|dirección|indirizzo|lives at|wohnhaft)[ \t]*:?[ \t]+(?P<n>(?=[^\n]*\d)[^\n\[·;]+?[,/][^\n\[·;]+?)(?=[ \t]*(?:/[ \t]*\S+(?: ?@|[ (\[]+at\b)|;|\[|\r?$))", re.MULTILINE)

_PART = r"(?:[^\W\d_]\.|[^\W\d_][^\W\d_]*(?:['’-][^\W\d_]+)*)"
_NAME = rf"(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Mme|M)\.?\ )?{_PART}(?:,?\ {_PART}){{1,3}}"
_BROKEN = r"\ [^\W\d_]*â€"  # the next word has lost its encoding
_NO = r"(?!(?:the|a|an|our|my|his|her|their|its|der|die|das|le|la|les|el|los|las|head|team)\b)"
PERSON = re.compile(
    rf"""(?:^|(?<=\s)|(?<=[>*.]))(?:
    Signed,\ (?P<a>{_NO}{_NAME})(?=\s*(?:\r?$|[,;.(])|{_BROKEN})
    |(?:Referee|References?|Correspondence|Contact(?=:)|Attn\.?|Kontakt|Name|Contacto|Referenz(?:en)?|Kind\ regards|Best\ wishes),?\ ?:?\ (?P<b>{_NO}{_NAME}?)(?=\s*(?:,\s*(?!{_PART}\s*[,(\[+\r\n])|[(;\[+/·]|\r?$))
    |Ansprechpartner(?:in)?\ (?:ist\ )?(?P<c>{_NO}{_NAME})(?=,)
    |Emergency\ contact:?\ (?P<d>{_NO}{_NAME})(?=\s*[(,;])
    |(?:My|Our)\ (?:line\ )?manager,?\ (?P<e>{_NO}{_NAME})(?=\ at\b)
    |Reported\ (?:directly\ )?to\ (?P<f>{_NO}{_NAME})(?=\ at\b|\ in\b)
    |Worked\ (?:closely\ )?with\ (?P<g>{_NO}{_NAME})(?=\ on\ the\ handover|\ at\b)
    |Took\ over\ the\ desk\ from\ (?:(?P<h>{_NO}{_NAME}?)(?=\ and\ trained\b)|\[\w+\])(?:\ and\ trained\ (?P<i>{_NO}{_NAME})(?=\s*\r?$|[.;]|{_BROKEN}))?
    |Recommended\ by\ (?P<j>{_NO}{_NAME})(?=,\ who\b)
    |and\ ask\ for\ (?P<k>{_NO}{_NAME})(?=\s*(?:\r?$|[.;,])|{_BROKEN})
    |(?:years|months)\ under\ (?P<l>{_NO}{_NAME})(?=\ I\b)
    |I\ share\ (?:a|an|the)\ {_PART}\ with\ (?P<m>{_NO}{_NAME})(?=\ at\b|\ in\b|[.;,])
    )""",
    re.VERBOSE | re.MULTILINE,
)
PERSON_HINT = re.compile(r"Signed,|Refere|Correspondence|Contact|Kontakt|Ansprechpartner|Emergency contact|manager|Reported |Worked |Took over|Recommended by|ask for|I share|years under|months under|Attn|Name|Contacto|Kind regards|Best wishes")
CAPITALISED = r"(?:[^\W\d_]\.|[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][A-ZÀ-ÖØ-Þ]?[^\W\d_]+)*|(?:van|von|de|del|della|di|da|la|le|den|der|bin|al)(?= ))"
ALONE = re.compile(rf"(?:# )?(?:Dr\. |Prof\. )?(?P<n>{CAPITALISED}(?:,? {CAPITALISED}){{1,3}})(?: [^\W\d_]*â€.*)?\s*")
SMALL = re.compile(rf"(?:# )?(?P<n>{_PART}(?: {_PART}){{1,2}})\s*")
HEADER = re.compile(rf"(?:Dr\. |Prof\. )?(?P<n>{_PART}(?:,? {_PART}){{1,3}}) · ")


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def name_parts(name: str) -> list[str]:
    return [p for p in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", name.lower()) if len(p) > 1 and p not in ("dr", "prof")]


#: Leftovers of conversion inside a line: invisible characters, breaks, spaces in front and in rows.
DIRT = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]+|<br ?/?>|^[ \t\u00a0]+|[ \t\u00a0]{2,}|[\t\u00a0]", re.MULTILINE)


def squeezed(text: str) -> tuple[str, list[int] | None, list[int]]:
    """The text without leftovers, and where its parts begin in the cleaned and in the original text."""
    if not DIRT.search(text):
        return text, None, []
    out, ours, theirs, at, size = [], [0], [0], 0, 0
    for m in DIRT.finditer(text):
        out.append(text[at : m.start()])
        size += m.start() - at
        front = m.start() == 0 or text[m.start() - 1] == "\n"
        if m.group()[0] in " \t\u00a0" and not front:
            out.append(" ")
            ours.append(size)
            theirs.append(m.start())
            size += 1
        at = m.end()
        ours.append(size)
        theirs.append(at)
    out.append(text[at:])
    return "".join(out), ours, theirs


def detect(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """What detect_clean finds in the text without leftovers, as places in the text itself."""
    clean, ours, theirs = squeezed(text)
    certain, possible = detect_clean(clean)
    if ours is None:
        return certain, possible

    def back(i: int) -> int:
        k = bisect_right(ours, i) - 1
        return theirs[k] + i - ours[k]

    return [(back(a), back(b - 1) + 1, k) for a, b, k in certain], [(back(a), back(b - 1) + 1) for a, b in possible]


class Spans(list):
    def put(self, a: int, b: int, kind: str) -> None:
        if all(b <= x or y <= a for x, y, _ in self):
            self.append((a, b, kind))


def detect_clean(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """((start, end, kind) of the details in a text, in order and without overlaps; (start, end) of what may be names).

    A name is certain where a form or a phrase announces it. A line that consists of words with capitals, or begins with
    a name before a middle dot, may hold one: that is decided by the names announced elsewhere in the collection."""
    low = lowered(text)
    out = Spans()
    for sign in (AT, BARE_AT):
        for m in sign.finditer(low):
            local = LOCAL.search(low, max(0, m.start() - 64), m.start())
            domain = DOMAIN.match(low, m.end()) if local else None
            if domain:
                out.put(local.start(), domain.end(), "email")
    for m in ID_SHAPED.finditer(low):
        out.put(*m.span(), "id_number")
    if any(w in low for w in ID_WORDS):
        for m in ID_LABELLED.finditer(low):
            out.put(*m.span("n"), "id_number")
    for sign, pattern in PHONES:
        if sign in low:
            for m in pattern.finditer(low):
                a, b = m.span("n") if "n" in pattern.groupindex else m.span()
                if m.start() and (low[m.start() - 1].isalnum() or low[m.start() - 1] in "-.") and sign != "+":
                    continue
                if sum(c.isdigit() for c in m.group()) <= 17 and not NOT_PHONE.search(low[max(0, a - 24) : a]):
                    out.put(a, b, "phone")
    if PERSON_HINT.search(text):
        for m in PERSON.finditer(text):
            for g in range(1, len(m.groups()) + 1):
                if m.start(g) >= 0:
                    out.put(*m.span(g), "person")
    for m in HOUSE.finditer(low):
        a, b = m.span()
        if a and low[a - 1] not in " \n\t:(/" or b >= len(low):
            continue
        if low[b] in ", ":
            after = STREET_AFTER.match(low, b)
            if after:
                front = FLAT.search(low, max(0, a - 24), a)
                out.put(front.start() if front else a, after.end(), "address")
                continue
        if low[b] in ",/ " and a and low[a - 1] == " ":
            town = TOWN_AFTER.match(low, b)
            before = STREET_BEFORE.search(low, max(0, low.rfind("\n", 0, a) + 1, a - 60), a) if town else None
            if before:
                front = FLAT.search(low, max(0, before.start("n") - 24), before.start("n"))
                out.put(front.start() if front else before.start("n"), town.end(), "address")
    for m in ADDRESS_LABEL.finditer(low):
        out.put(*m.span("n"), "address")
    maybe: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        n = len(line)
        if 4 < n < 60 and line[0] not in "-*•":
            m = ALONE.fullmatch(line) or (SMALL.fullmatch(line) if line.islower() else None)
        else:
            m = HEADER.match(line) if " · " in line else None
        if m:
            maybe.append((at + m.start("n"), at + m.end("n")))
        elif " · " in line and (m := HEADER.match(line)):
            maybe.append((at + m.start("n"), at + m.end("n")))
        at += n + 1
    return sorted(out), [x for x in maybe if all(x[1] <= a or b <= x[0] for a, b, _ in out)]


# Surrogates

#: Syllables that invented names are made of; endings mark the gender that a given name seems to have.
GIVEN_STEMS = ("Al", "Bel", "Cor", "Dal", "El", "Fen", "Gil", "Hal", "Jor", "Kel", "Lor", "Mar", "Nel", "Or", "Per", "Quin", "Ros", "Sel", "Tor", "Var")
MALE, FEMALE = ("an", "en", "in", "or", "us", "ek"), ("a", "ia", "ina", "ela", "ora", "issa")
FAMILY = (("Ash", "Brand", "Cald", "Dun", "Ester", "Fal", "Gran", "Hol", "Iver", "Kest", "Lang", "Morn", "Nor", "Oster", "Pell", "Rav", "Stan", "Thorn", "Ul", "Wen"), ("ber", "den", "ford", "gard", "holt", "lund", "mark", "ner", "rick", "sen", "strom", "tell", "vik", "wald", "wick", "yard"))
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = str.maketrans(LATIN, "абкдефгхийклмнопкрстуввкыз")
GREEK = str.maketrans(LATIN, "αβκδεφγχιικλμνοπκρστυβωξυζ")
#: Words of an address that tell nothing about where it is.
ADDRESS_WORDS = frozenset(
    """street road lane close crescent avenue way terrace court drive place square gardens row walk mews hill grove green park rise rue calle avenida boulevard
    via viale plaza paseo chemin allée carrer quai impasse flat apt apartment unit wohnung piso appartement c o de la le les du des del der die das den dem an am
    im in of the at""".split()
)
ADDRESS_TAIL = re.compile(r"(?:stra(?:ss|ß)e|weg|kamp|gasse|platz|allee|damm|ring|ufer|steig|chaussee|laan|straat|gatan|vägen)$")
WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
ADDRESSED = ("dr", "prof", "mr", "mrs", "ms", "herr", "frau")
#: Draws after which surrogates get longer, so that there is always a free one.
LENGTHEN, LENGTHEN_DIGITS = 50, 1000


def identity(kind: str, value: str) -> str:
    """What makes two mentions the same: letters and digits for addresses, digits for numbers, the parts of a name in any
    order, the address of an email in any spelling."""
    low = unicodedata.normalize("NFKC", value).lower()
    if kind == "phone":
        spelt = re.sub(_DIGIT_WORD, lambda m: str(DIGIT_WORDS.index(m.group())), low.partition("ext")[0])
        return "".join(c for c in spelt if c.isdigit())
    if kind == "person":
        return " ".join(sorted(name_parts(low)))
    if kind == "email":
        low = re.sub(r"[\s(\[{]+at[\s)\]}]+", "@", re.sub(r"[\s(\[{]+dot[\s)\]}]+", ".", low))
        return re.sub(r"[()\[\]{}\s]", "", low)
    return "".join(c for c in low if c.isalnum())


def cased(made: str, like: str) -> str:
    return made.upper() if like.isupper() and len(like) > 1 else made.lower() if like.islower() else made


def in_script(c: str, number: int) -> str:
    """A letter of the script and case of ``c``."""
    if "LATIN" in unicodedata.name(c, ""):
        new = LATIN[number % 26]
        return new.upper() if c.isupper() else new
    first = ord(c) & ~0x1F
    kind = unicodedata.category(c)
    near = [x for x in map(chr, range(first, first + 32)) if unicodedata.category(x) == kind]
    return near[number % len(near)]


class Surrogates:
    """Keyed replacements within one record: a detail gets the same one wherever it is mentioned, two details never the
    same (a taken one is drawn again, after LENGTHEN draws a longer one), and format, case, script and gender of the
    original stay. Of an address the kinds of street stay, the names of street and town and all numbers go."""

    def __init__(self, key: bytes, scope: str = ""):
        self.key, self.scope, self.given, self.taken = key, scope, {}, {}

    def _stream(self, kind: str, ident: str, turn: int) -> Iterator[int]:
        block = 0
        while True:
            yield from hmac.digest(self.key, f"{self.scope}\x1f{kind}\x1f{ident}\x1f{turn}\x1f{block}".encode(), "sha256")
            block += 1

    def of(self, kind: str, value: str) -> str:
        ident = identity(kind, value)
        turn = self.given.get((kind, ident), 0)
        while True:
            made = self._make(kind, value, ident, turn)
            mark = (kind, identity(kind, made))
            if mark[1] != ident and self.taken.setdefault(mark, ident) == ident:
                self.given[kind, ident] = turn
                return made
            turn += 1

    def _made_up(self, word: str, role: str, turn: int) -> str:
        """A word drawn by the word itself, so that 'Ann Lee' and 'A. Lee' keep one family name; never the word itself.
        Scripts that names can't be spelt in get letters of their own."""
        low = word.lower()
        for again in range(256):
            draw = self._stream("part", f"{low}{role}{again or ''}", turn)
            if not ("LATIN" in (script := unicodedata.name(word[0], "")) or "CYRILLIC" in script or "GREEK" in script):
                made = "".join(in_script(c, next(draw)) if c.isalpha() else c for c in word)
                made += "".join(in_script(word[0], next(draw)) for _ in range(turn // LENGTHEN))
            else:
                if role == "given":
                    made = GIVEN_STEMS[next(draw) % len(GIVEN_STEMS)] + (FEMALE if low.endswith(("a", "e", "ine", "а", "я", "η", "α")) else MALE)[next(draw) % 6]
                else:
                    made = FAMILY[0][next(draw) % len(FAMILY[0])] + FAMILY[1][next(draw) % len(FAMILY[1])]
                made += "".join(FAMILY[1][next(draw) % len(FAMILY[1])] for _ in range(turn // LENGTHEN))
                if "CYRILLIC" in script or "GREEK" in script:
                    made = made.lower().translate(CYRILLIC if "CYRILLIC" in script else GREEK).capitalize()
            if made.lower() != low:
                break
        return cased(made, word)

    def _make(self, kind: str, value: str, ident: str, turn: int) -> str:
        if kind == "person":
            return self._name(value, turn)
        if kind == "address":
            return self._address(value, ident, turn)
        draw = self._stream(kind, ident, turn)
        marks = {i for m in EMAIL_MARKS.finditer(value) for i in range(*m.span())} if kind == "email" else ()
        out = []
        for i, c in enumerate(value):
            if c.isdigit():
                keep = kind == "phone" and value[:1] == "+" and i < 3  # the country stays
                out.append(c if keep else str(next(draw) % 10))
            elif c.isalpha() and kind == "phone":
                out.append(c)
            elif c.isalpha() and i not in marks:
                out.append(in_script(c, next(draw)))
            else:
                out.append(c)
        if kind == "phone" and not any(c.isdigit() for c in value):  # written in words
            out = [DIGIT_WORDS[next(draw) % 10] if w in DIGIT_WORDS else w for w in re.split(r"([^\W\d_]+)", value.lower())]
        more = turn // (LENGTHEN if kind == "email" else LENGTHEN_DIGITS)
        extra = "".join(LATIN[next(draw) % 26] if kind == "email" else str(next(draw) % 10) for _ in range(more))
        return extra + "".join(out) if kind == "email" else "".join(out) + extra

    def _name(self, value: str, turn: int) -> str:
        words = list(WORDS.finditer(value))
        full = [m for m in words if len(m.group()) > 1 and m.group().lower() not in ADDRESSED]
        if not full:
            full = [m for m in words if m.group().lower() not in ADDRESSED]  # names of one sign
        family = full[0] if "," in value and full else full[-1] if full else None
        out, at = [], 0
        for m in words:
            w = m.group()
            if m in full:
                new = self._made_up(w, "family" if m is family else "given", turn)
            else:
                new = w if len(w) > 1 else in_script(w, next(self._stream("part", w.lower(), turn)))
            out += [value[at : m.start()], new]
            at = m.end()
        return "".join([*out, value[at:]])

    def _address(self, value: str, ident: str, turn: int) -> str:
        draw = self._stream("address", ident, turn)
        out, at = [], 0
        for m in ADDRESS_PART.finditer(value):
            w = m.group()
            low = w.lower()
            beside = value[max(0, m.start() - 1) : m.start()] + value[m.end() : m.end() + 1]
            if w.isdigit():
                new = str(next(draw) % 9 + 1) + "".join(str(next(draw) % 10) for _ in w[1:])
            elif low in ADDRESS_WORDS:
                new = w
            elif len(w) == 1 or any(c.isdigit() for c in beside):  # of a post code or a house number
                new = "".join(in_script(c, next(draw)) if c.isalpha() else c for c in w)
            elif (end := ADDRESS_TAIL.search(low)) and end.start():
                new = cased(self._made_up(w[: end.start()], "place", turn) + w[end.start() :].lower(), w)
            else:
                new = self._made_up(w, "place", turn)
            out += [value[at : m.start()], new]
            at = m.end()
        return "".join([*out, value[at:]])


ADDRESS_PART = re.compile(r"\d+|[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: 'at', 'dot' and the ending of a domain, which stay readable.
EMAIL_MARKS = re.compile(r"(?<!\w)(?:at|AT|dot|DOT)(?!\w)|[A-Za-z]+$")


# Operators

SPANS = "array<struct<a:int,b:int,line:bigint,kind:string,value:string,parts:array<string>>>"


def _scan(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., mark, spans): the details of each text that has some; kind '' marks a possible name. mark tells texts of
    one record apart. A possible name that an email of the same text spells is a name."""
    shipped(texts.sparkSession)
    kept = texts.select(*keys, F.xxhash64(text).alias("mark"), F.col(text).alias("__text")).where(F.length("__text") > 0)
    kinds = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)
    inner = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("line", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("parts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, spans = [], []
            for i, value in enumerate(batch.column(n + 1)):
                t = value.as_py()
                certain, possible = detect(t)
                if not certain and not possible:
                    continue
                mailed = {p for a, b, k in certain if k == "email" for p in name_parts(t[a:b].partition("@")[0].replace("_", " "))} if possible else ()
                rows = []
                for a, b, k in (*certain, *((a, b, "") for a, b in possible)):
                    parts = name_parts(t[a:b]) if k in ("person", "") else []
                    sure = "person" if not k and len(parts) > 1 and all(p in mailed for p in parts) else k
                    rows.append({"a": a, "b": b, "line": t.count("\n", 0, a) + 1, "kind": sure, "value": t[a:b], "parts": parts})
                owner.append(i)
                spans.append(rows)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(n + 1)), pa.array(spans, pa.list_(inner))], names=[*keys, "mark", "spans"])

    return kept.mapInArrow(run, f"{kinds}, mark bigint, spans {SPANS}")


def _known(seen: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(part): parts of names. Counted are the records that announce a name with the part, and those that have it where a
    name may be; a part of names is announced in ``share`` of both together at least."""
    each = seen.select(*keys, F.explode("spans").alias("s")).select(*keys, (F.col("s.kind") == "person").alias("said"), F.explode("s.parts").alias("part")).distinct()
    return each.groupBy("part").agg((F.count_if("said") / F.count("*")).alias("rate")).where(F.col("rate") >= share).select("part")


def replaced(texts: DataFrame, keys: list[str], text: str, surrogate_key: bytes, share: float = 0.2) -> DataFrame:
    """(keys..., mark, spans): for each text with details their places, kinds and keyed surrogates; spans holds
    (a, b, line, kind, value, surrogate) in order. mark is xxhash64 of the text.

    Forms, phrases and formats find details; a line that is or begins with what looks like a name counts if each part of
    it is a part of names: of all records that have the part where a name may stand, ``share`` at least announce it as
    one. That is a rate, so it means the same in small and in large tables. The parts are counted over all records and
    joined, so no list of names is fetched. Null and empty texts have no rows, repeated rows count once.
    """
    seen = stored(_scan(texts, keys, text).dropDuplicates([*keys, "mark"]))
    open_ = seen.select(*keys, "mark", F.explode("spans").alias("s")).where("s.kind = '' and size(s.parts) > 0").select(*keys, "mark", "s.a", F.array_distinct("s.parts").alias("parts"))
    hits = open_.select(*keys, "mark", "a", F.size("parts").alias("n"), F.explode("parts").alias("part")).join(_known(seen, keys, share), "part")
    named = hits.groupBy(*keys, "mark", "a", "n").count().where("count = n").groupBy(*keys, "mark").agg(F.collect_list("a").alias("named"))  # places in one text
    rows = seen.join(named, [*keys, "mark"], "left").select(*keys, "mark", "spans", "named")
    n = len(keys)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    inner = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("line", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = list(zip(*(batch.column(k).to_pylist() for k in range(n)), strict=True))
            for ident, spans, named_ in zip(ids, batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True):
                own, there = Surrogates(surrogate_key, "\x1f".join(map(str, ident))), set(named_ or ())
                kept = sorted((s["a"], s["b"], s["line"], s["kind"] or "person", s["value"]) for s in spans if s["kind"] or s["a"] in there)
                out.append([{"a": a, "b": b, "line": line, "kind": kind, "value": value, "surrogate": own.of(kind, value)} for a, b, line, kind, value in kept])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n + 1)), pa.array(out, pa.list_(inner))], names=[*keys, "mark", "spans"])

    return rows.mapInArrow(run, f"{kinds}, mark bigint, spans array<struct<a:int,b:int,line:bigint,kind:string,value:string,surrogate:string>>")


def found_lines(texts: DataFrame, keys: list[str], text: str, surrogate_key: bytes = b"example", share: float = 0.2) -> DataFrame:
    """(keys..., line, kind): one row for each line of a text and each kind of detail in it that gets a surrogate; line
    counts from 1 at line feeds. Placeholders are no details. Nulls, empty texts and repeats as in replaced."""
    spans = replaced(texts, keys, text, surrogate_key, share).select(*keys, F.explode("spans").alias("s"))
    return spans.where("s.surrogate <> s.value").select(*keys, "s.line", "s.kind").distinct()


def masked(texts: DataFrame, keys: list[str], text: str, share: float = 0.2, surrogate_key: bytes | None = None) -> DataFrame:
    """(keys..., text, details): the texts with each detail replaced by its typed placeholder or, with a key, by a
    surrogate that is the same for all mentions in a record; details counts the replacements.

    Everything else stays as it is, byte for byte. Null texts stay null, empty ones empty, repeated rows give one row.
    """
    spans = replaced(texts, keys, text, surrogate_key or b"example", share)
    rows = texts.select(*keys, F.col(text).alias("__text"), F.xxhash64(text).alias("mark")).distinct()
    same = [rows[k].eqNullSafe(spans[k]) for k in (*keys, "mark")]
    rows = rows.join(spans, same, "left").select(*(rows[k] for k in keys), "__text", "spans")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, count = [], []
            for t, spans_ in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                made, at = [], 0
                for s in spans_ or ():
                    made += [t[at : s["a"]], s["surrogate"] if surrogate_key else PLACEHOLDER[s["kind"]]]
                    at = s["b"]
                out.append("".join([*made, t[at:]]) if made else t)
                count.append(len(spans_ or ()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(out, pa.string()), pa.array(count, pa.int64())], names=[*keys, "text", "details"])

    return rows.mapInArrow(run, f"{kinds}, text string, details bigint")
