"""High-recall span generators and their features for personal data in free text.

A span is (kind, start, end, features).  Generators overlap on purpose: a name
with and without the next word, an address with and without a town, a number as
phone and as identity number.  The boosted trees choose between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# A blank inside a span: spaces, or one line break with quote marks of replies.
_B = r"(?:[ \t\u00a0]+(?:\r?\n(?:[ \t]*>)*[ \t]*)?|\r?\n(?:[ \t]*>)*[ \t]*)"
_UP, _LOW = "A-ZÀ-ÖØ-ÞŠŽČŁ", "a-zß-öø-ÿšžčłńśćęąőű"

# ---------------------------------------------------------------- fixed values
PARTICLES = ["van der", "van den", "van de", "van", "von der", "von", "de la", "de los", "del", "de", "della", "di", "du", "da", "dos", "ter", "ten", "zu", "af"]
PARTICLE_ENDS = {p.split()[-1] for p in PARTICLES}
ORG_WORDS = {
    "group", "alliance", "institute", "foundation", "project", "council", "authors", "systems", "software", "works", "networks", "society", "university", "college", "school",
    "labs", "laboratories", "gmbh", "inc", "ltd", "llc", "ag", "corp", "corporation", "company", "team", "committee", "consortium", "association", "license", "licence", "court",
    "community", "department", "ministry", "office", "centre", "center", "bank", "agency", "union", "board", "holding", "partners", "services", "solutions", "technologies", "press",
}
FUNCTION_WORDS = {
    "the", "a", "an", "as", "at", "by", "for", "from", "in", "is", "it", "its", "no", "not", "of", "on", "or", "our", "to", "we", "with", "this", "that", "these", "those", "if", "he", "she", "they", "you",
    "your", "their", "his", "her", "there", "here", "all", "any", "each", "some", "see", "when", "while", "where", "what", "who", "how", "why", "after", "before", "since", "until", "and", "but", "so", "then",
    "also", "only", "both", "please", "thanks", "thank", "dear", "hello", "hi", "write", "call", "phone", "contact", "tel", "fax", "email", "mail", "send", "ask",
    "new", "old", "note", "copyright", "according", "reported", "reviewed", "signed", "merged", "maintained", "approved", "postal", "address", "questions", "mr", "mrs", "ms", "dr",
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "für", "von", "vom", "zum", "zur", "im", "am", "auf", "mit", "nach", "ohne", "seit", "zwischen", "laut", "bei", "und", "oder", "wir",
    "sie", "er", "es", "bitte", "nicht", "kein", "keine", "wenn", "herr", "frau", "anschrift", "adresse", "ansprechpartner", "rückfragen", "gemeldet", "le", "la", "les", "l", "un", "une", "du", "de", "au",
    "aux", "et", "ou", "pour", "sur", "selon", "entre", "sans", "aucun", "aucune", "nous", "vous", "il", "elle", "ce", "cette", "par", "avec", "monsieur", "madame", "signalé", "el", "los", "las", "una",
    "según", "para", "sin", "que", "por", "con", "del", "este", "esta", "no", "si", "señor", "señora", "dirección", "contacto", "informado",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
}
STREET_EN = "Street|Road|Lane|Avenue|Drive|Court|Close|Way|Terrace|Place|Square|Row|Walk|Crescent|Boulevard|Parkway|Highway|Hill|Gardens|Mews|Rise|Grove"
STREET_EN_SHORT = "Rd|Ln|Ave|Dr|Ct|Pl|Sq|Cres|Blvd|Pkwy"
STREET_DE = "straße|strasse|str\\.|weg|gasse|platz|allee|ufer|garten|damm|ring|hof|steig|pfad|markt|graben|wall|chaussee"
STREET_DE_LEAD = "Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den|Unter der|Hinter der|Alte|Alter|Altes|Neue|Neuer|Große|Kleine"
STREET_FR = "rue|avenue|boulevard|place|chemin|quai|impasse|allée|route|cours|passage|square|faubourg|sentier|montée|ruelle"
STREET_ES = "calle|avenida|paseo|plaza|camino|carrera|ronda|travesía|carretera|callejón|rambla|cuesta|c/|avda\\.?"
ID_LABELS = (
    r"ssn|social security|insurance (?:no|number)|passports?|passeport|pasaporte|reisepass(?:nummer)?|personalausweis(?:nummer)?|ausweis(?:nummer|nr)?|identity (?:card|document|number)|"
    r"id card|national id(?:entity)?|personal[ _]?(?:id|number|no)|personnummer|identit[ée]|identidad|d\.?n\.?i|n\.?i\.?e|n\.?i\.?f|tax(?:payer)? (?:number|id|no|identification)|tin|"
    r"steuer(?:nummer|[- ]?id|nr)|steueridentifikationsnummer|fiscal|sécurité sociale|seguridad social|sozialversicherung(?:snummer)?|driver'?s? licen[cs]e|führerschein|permis de conduire"
)
NOT_ID = (
    r"tickets?|issues?|case|build|job|order(?: number)?|serial(?: number)?|model|invoice|batch|lot|item|part(?: number)?|revision|version|release|port|offset|bytes|line|checksums?|digest|hash|commit|sha\d*|"
    r"tracking(?: number)?|shipment|parcel|booking|receipt|ean|isbn|issn|range|prüfsumme|somme|suma|bestellung|bestellnummer|rechnung|auftrag|seriennummer|commande|facture|pedido|factura"
)
PHONE_CUES = r"phone|call|tel(?:efon|ephone|éphone|éfono|efonisch)?|tél|mobile|cell|fax|unter|under|on|at|appeler|joindre|llam(?:e|ar)|anruf(?:en)?|dial|ring|reach|handy|portable|móvil|whatsapp|hotline"
PERSON_CUES = (
    "signed-off-by", "reported-by", "reviewed-by", "acked-by", "co-authored-by", "tested-by", "from", "cc", "reported by", "reviewed by", "merged by", "maintained by", "written by", "approved by", "prepared by",
    "on behalf of", "ask for", "according to", "attention", "attn", "copyright", "(c)", "©", "reviewer", "assignee", "author", "maintainer", "owner", "name", "dear", "mr", "mrs", "ms", "dr",
    "gemeldet von", "geprüft von", "laut", "ansprechpartner", "ansprechpartnerin", "herr", "herrn", "frau", "contact", "contacto", "signalé par", "selon", "d'après", "monsieur", "madame",
    "informado por", "según", "señor", "señora", "sr", "sra", "don", "doña",
)
PREPOSITIONS = {"by", "from", "to", "for", "with", "of", "and", "via", "von", "an", "bei", "mit", "und", "par", "à", "pour", "avec", "et", "de", "por", "a", "para", "con", "y"}
# -----------------------------------------------------------------------------

_WORD = rf"(?:[{_UP}][{_LOW}]+(?:['’][{_UP}]?[{_LOW}]+)?|[{_UP}]{{2,}})"
_NAME = rf"{_WORD}(?:-{_WORD})*"
_INITIAL = rf"[{_UP}]\."
_PARTICLE = "(?:" + "|".join(p.replace(" ", _B) for p in PARTICLES) + ")"
_FAMILY = rf"(?:(?i:{_PARTICLE}){_B})?{_NAME}"
_PERSON = re.compile(rf"(?<![\w@/.-])(?=(?P<given>{_NAME}|{_INITIAL})(?P<mid>(?:{_B}{_INITIAL})*){_B}(?P<family>{_FAMILY})(?![\w@])(?!\.\w))")
_COMMA = re.compile(rf",{_B}(?=[{_UP}])")
_FAMILY_END = re.compile(rf"(?<![\w@/.-]){_FAMILY}$")
_LAST_NAME = re.compile(rf"{_NAME}$")
_GIVEN_START = re.compile(rf"(?P<given>{_NAME}|{_INITIAL})(?P<mid>(?:{_B}{_INITIAL})*)(?![\w@])(?!\.\w)")
# Areas that may hold a long number
_NUMBERS = re.compile(r"[+(]*\d[\d() ./\t\r\n>-]{3,}\d")

_AT_SIGN = re.compile(r"@|\(at\)|\[at\]|\{at\}|(?<=\s)at(?=\s)", re.I)
_DOMAIN = re.compile(rf"[A-Za-z0-9À-ÿ-]+(?:(?:\.|{_B}?(?:\(dot\)|\[dot\]|\{{dot\}}){_B}?|{_B}dot{_B})[A-Za-z0-9À-ÿ-]+)+", re.I)
_BLANK = re.compile(rf"{_B}?")
_SPELLED = re.compile(r"\(at\)|\[at\]|\{at\}|\sat\s", re.I)
_PHONE = re.compile(rf"(?<![\w@.#/-])(?<!\d:)(?=(?P<number>(?:\+|\(\d{{1,4}}\)|\d)(?:(?:[ ./-]|{_B}|(?:[ ./-]|{_B})?\(\d{{1,4}}\)(?:[ ./-]|{_B})?)?\d)+)(?P<ext>,?{_B}(?:ext|extension|x|durchwahl|dw|poste|int)\.?{_B}?\d{{1,5}})?(?![\w-]*\w))", re.I)
_ID = re.compile(rf"(?<![\w@.#/-])(?<!\d:)(?=(?P<number>(?:(?!(?:ID|NO|NR)\b)[A-Z]{{1,2}}{_B}?)?\d(?:(?:[ ./-]|{_B})?\d)*(?:-?[A-Z])?)(?![\w/-]))")
_TOWN_WORD = rf"[{_UP}][{_LOW}]+(?:-[{_UP}]?[{_LOW}]+)*"
_TOWN_LINK = r"(?:am|an der|ob der|sur|sous|en|de la|de|del|la|le|les|upon|on|in der|im)"
_TOWN = rf"{_TOWN_WORD}(?:{_B}(?:{_TOWN_LINK}{_B})?{_TOWN_WORD}){{0,3}}"
_POSTAL = r"\d{5}"
_OUTCODE = rf"[A-Z]{{1,2}}\d[A-Z\d]?{_B}\d[A-Z]{{2}}"
_UNIT = rf"(?:,?{_B}(?:Suite|Floor|Apt|Apartment|Unit|Room|Flat|Fl|Ste|Piso|Étage)\.?{_B}\d+[A-Za-z]?|,?{_B}?\#\d+[A-Za-z]?)"
_EN = rf"(?P<en>\d{{1,5}}[A-Za-z]?{_B}(?:{_TOWN_WORD}{_B}){{1,3}}(?:(?:{STREET_EN})\b|(?:St|Str)\b\.?|(?:{STREET_EN_SHORT})\b(?:\.(?=,))?))"
_FR = rf"(?P<fr>\d{{1,5}}(?:{_B}?(?:bis|ter|[a-c]))?,?{_B}(?i:{STREET_FR}){_B}(?:(?:de|du|des|la|le|les|aux|au|à|sur|l'|d'){_B}?){{0,3}}[{_UP}][\w'’-]*)"
_ES = rf"(?P<es>(?i:{STREET_ES}){_B}(?:(?:de|del|la|las|los|el){_B}){{0,3}}[{_UP}][\w'’-]*(?:{_B}(?:(?:de|del|la|las|los|el){_B})?[{_UP}][\w'’-]*){{0,3}},?{_B}(?:n\.?º{_B}?)?\d{{1,5}}[A-Za-z]?)"
_DE = (
    rf"(?P<de>(?:[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)*-?(?i:{STREET_DE})|(?:{STREET_DE_LEAD}){_B}(?:[{_UP}][{_LOW}]+(?:-[{_UP}]?[{_LOW}]+)*)(?:{_B}[{_UP}][{_LOW}]+)?){_B}\d{{1,4}}(?:{_B}?[a-z](?!\w))?)"
)
_NUMBER_FIRST = re.compile(rf"(?:{_EN}|{_FR})(?!\w)")
_NUMBER_LAST = re.compile(rf"(?<![\w.,:/#-])(?:{_ES}|{_DE})$")
_HOUSE = re.compile(r"(?<![\w.,:/#-])\d{1,5}(?=[A-Za-z]?,?[ \t\r\n])")
_HOUSE_LAST = re.compile(rf"(?<![\w.,:/#-])(?P<house>\d{{1,5}}[A-Za-z]?)(?:{_B}[A-Za-z])?(?!\w)")
_UNIT_AT = re.compile(_UNIT)
_BREAK = r"(?:[ \t]*\r?\n(?:[ \t]*>)*[ \t]*)"
_AFTER_STREET = re.compile(rf"(?:,{_B}?|{_B})(?P<zip>{_POSTAL}){_B}(?P<town1>{_TOWN})|(?:,{_B}?|{_BREAK})(?:(?P<town2>{_TOWN})(?:(?P<uk>,?{_B}{_OUTCODE})|(?P<us>,{_B}[A-Z]{{2}}{_B}\d{{5}}))|(?P<town3>{_TOWN}))")
_WORDS = re.compile(rf"{_TOWN_WORD}|{_TOWN_LINK}(?![\w])")

_LABEL = re.compile(rf"(?i)(?<![\w])(?:{ID_LABELS})(?![a-z])")
_NOT_ID = re.compile(rf"(?i)(?<![\w])(?:{NOT_ID})(?![\w])")
_CLAUSE_END = re.compile(r"[.;!?](?=\s)|\n[ \t>]*\n")
_PHONE_BEFORE = re.compile(rf"(?i)(?<![\w])(?:{PHONE_CUES})[ .:]*(?:an|at|on|le|la|al|el|unter|under|us at|the)?[\s:>.(]*$")
_AFTER_NAME = re.compile(rf"^(?:{_B}(?:wrote|said|pointed|writes|reported|approved|schrieb|a écrit|escribió)\b|,{_B}(?:identity|passport|tel|tél|id\b|ssn)|{_B}?[<(]\S|,{_B}t[eé]l)", re.I)
_INTERNATIONAL = re.compile(r"(?:\+|00)[1-9]\d{0,2}(?:[ ./-]?\(0\))?(?:[ ./-]?\d{2,5}){2,5}")
_NATIONAL = re.compile(r"(?:\+?1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\d{3}[ .-]\d{4}|0\d{2,5}[ /.-]\d{4,9}|0\d(?:[ .-]?\d\d){4}|0\d{1,4}[ /.-]\d{2,5}(?:[ .-]\d{2,5}){1,3}")
_DATE = re.compile(r"(?:19|20)\d\d[-./](?:0?[1-9]|1[0-2])[-./]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d")


@dataclass
class Span:
    """``words``: up to two (role, word) whose sightings elsewhere in the corpus are evidence; spans of one ``group`` compete by them."""

    kind: int
    start: int
    end: int
    features: list[float]
    words: tuple[tuple[str, str] | None, tuple[str, str] | None] = (None, None)
    group: int = 0


KINDS = ("person", "email", "phone", "id_number", "address")
#: Features found in the text alone, and those that the words' sightings elsewhere add.
OWN_FEATURES = (23, 12, 21, 21, 20)
WORD_FEATURES = (2, 0, 0, 0, 4)

#: (role, word) -> [times seen, times seen where the role is plain] in one text
Words = dict[tuple[str, str], list[int]]


_GAPS = re.compile(r"[ \t\u00a0]*\r?\n(?:[ \t]*>)*[ \t]*|[ \t\u00a0]+")


def _cued(before: str) -> bool:
    """A cue for a name ends the text before it (a year may stand between)."""
    t = _GAPS.sub(" ", before).lower().rstrip(" \"'«").removesuffix("(").rstrip()
    if t and t[-1] in ":=,.":
        t = t[:-1].rstrip()
    if t[-4:].isdigit():
        t = t[:-4].rstrip()
        return t.endswith(("copyright", "(c)", "©"))
    if not t.endswith(PERSON_CUES):
        return False
    return any(t.endswith(c) and not t[: -len(c)][-1:].isalnum() for c in PERSON_CUES)


_SIGNATURE = re.compile(r"--\s*\n[ \t>]*$")
_LINE_START = re.compile(r"(?:^|\n)[ \t>]*$")
_WORD_CHARS = re.compile(r"\w+")
_NEXT_CAPITAL = re.compile(rf"{_B}?([{_UP}][\w-]*)")
_NAME_ENDS = re.compile(r"\s*[\n<(,;.]")


def _flat(s: str) -> str:
    """The text in one line: line breaks with quote marks are blanks."""
    return _GAPS.sub(" ", s).strip()


def _mailboxes(text: str) -> Iterator[tuple[int, int, int]]:
    """(start and end of the local part, end of the at sign with its blanks) at every at sign after a word."""
    for m in _AT_SIGN.finditer(text):
        stop = _back_over_blank(text, m.start())
        start = stop
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        while start < stop and not (text[start].isalnum() or text[start] == "_"):
            start += 1
        if start < stop and not (start > 0 and text[start - 1] in "%@/"):
            yield start, stop, _BLANK.match(text, m.end()).end()


def _back_over_blank(text: str, at: int) -> int:
    """The end of the text before a blank (spaces, or a line break with quote marks) that ends at ``at``."""
    stop = at
    while stop > 0 and (text[stop - 1].isspace() or (text[stop - 1] == ">" and text[text.rfind("\n", 0, stop) + 1 : stop].strip(" \t>") == "")):
        stop -= 1
    return stop if "\n" in text[stop:at] or ">" not in text[stop:at] else at


def _words_back(text: str, at: int, count: int) -> int:
    """Where the last ``count`` words before ``at`` begin, however long they are."""
    for _ in range(count):
        at = _back_over_blank(text, at)
        while at > 0 and not text[at - 1].isspace():
            at -= 1
    return at


def _local_words(text: str, boxes: list[tuple[int, int, int]]) -> set[str]:
    words = set()
    for start, stop, _ in boxes:
        local = text[start:stop].lower()
        words |= {*re.split(r"[._+-]", local), re.sub(r"\W", "", local)}
    return {w for w in words if len(w) > 3}


def _names(text: str) -> Iterator[tuple[int, int, str, str, str, bool]]:
    """(start, end, given, middle initials, family, written with a comma) of everything shaped like a name."""
    for m in _PERSON.finditer(text):
        if m["given"].split("-")[0].lower() not in FUNCTION_WORDS:
            yield m.start(), m.end("family"), m["given"], m["mid"], m["family"], False
    for c in _COMMA.finditer(text):
        g = _GIVEN_START.match(text, c.end())
        f = _FAMILY_END.search(text, _words_back(text, c.start(), 3), c.start()) if g else None  # a particle has two words at most
        if not f:
            continue
        end = g.end("mid") if g["mid"] else g.end("given")
        bare = _LAST_NAME.search(f[0])
        for at in {0, bare.start()}:  # a particle may also belong to the text before
            if f[0][at:].split("-")[0].lower() not in FUNCTION_WORDS:
                yield f.start() + at, end, g["given"], g["mid"], f[0][at:], True


def _last_word(family: str) -> str:
    return _GAPS.sub(" ", family).rpartition(" ")[2]


_LOWER_NEXT = re.compile(rf",?{_B}[{_LOW}]")


def person_spans(text: str, words: Words, boxes: list[tuple[int, int, int]]) -> list[Span]:
    """Everything shaped like a name.  Without a sign beside it, only its words' other sightings can make it one."""
    out: list[Span] = []
    parts: set[str] | None = None
    for start, end, given, mid, family, comma in _names(text):
        last = _last_word(family)
        stop = _back_over_blank(text, start)
        broken = stop == 0 or "\n" in text[stop:start]
        before, after = text[max(0, start - 44) : start], text[end : end + 30]
        cued, followed = _cued(before), bool(_AFTER_NAME.match(after))
        signed = broken and stop > 1 and text[stop - 2 : stop] == "--" and bool(_SIGNATURE.search(text[max(0, stop - 2) : start]))
        if parts is None:
            parts = _local_words(text, boxes)
        own = {w.lower() for w in _WORD_CHARS.findall(text[start:end])}
        shared = bool(parts) and any(p.endswith(w) for w in map(_ascii, own) if len(w) > 3 for p in parts)
        plain = int(cued or followed or signed)
        refs = (None if given.endswith(".") else ("given", given.split("-")[0].lower()), ("family", last.split("-")[0].lower()))
        for r in refs:
            if r:
                n = words.setdefault(r, [0, 0])
                n[0] += 1
                n[1] += plain
        nxt = _NEXT_CAPITAL.match(after)
        first = stop
        while first > 0 and (text[first - 1].isalnum() or text[first - 1] in "'’_-"):
            first -= 1
        prior, edge = text[first:stop], stop
        while edge > 0 and text[edge - 1] in "\"'> ":
            edge -= 1
        word = prior.lower()
        out.append(
            Span(
                0, start, end,
                [
                    cued, followed, comma, signed, shared, bool(own & ORG_WORDS), last.lower() in FUNCTION_WORDS or given.lower() in FUNCTION_WORDS, bool(nxt) and nxt[1].lower() in ORG_WORDS,
                    len(given) == 2 and given[1] == ".", bool(mid), " " in family or "\n" in family, text[start:end].isupper(), "\n" in text[start:end], broken,
                    prior[:1].isupper() and word not in FUNCTION_WORDS, word in PARTICLE_ENDS, bool(_NAME_ENDS.match(after) or not after), word in PREPOSITIONS, word in ("by", "von", "par", "por"),
                    text[edge - 1 : edge] in (":", "=") if edge else False, broken or text[stop - 1] in ".!?:;", bool(_LOWER_NEXT.match(after)), text[start].islower(),
                ],
                refs,
            )
        )
    return out


def _ascii(word: str) -> str:
    return word.translate(str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüý", "aaaaaaceeeeiiiinoooooouuuuy"))


def email_spans(text: str, boxes: list[tuple[int, int, int]]) -> list[Span]:
    out = []
    for start, _, at_end in boxes:
        m = _DOMAIN.match(text, at_end)
        if not m:
            continue
        whole, domain = text[start : m.end()], m[0]
        local = re.match(r"[\w.+-]+", whole)[0]
        labels = re.split(rf"\.|{_B}?(?:\(dot\)|\[dot\]|\{{dot\}}){_B}?|{_B}dot{_B}", domain, flags=re.I)
        lead, after = text[_words_back(text, start, 1) if start and not text[start - 1].isspace() else start : start], text[m.end() : m.end() + 12]
        word_at = bool(re.search(r"\sat\s", whole, re.I)) and "@" not in whole and "(" not in whole
        out.append(
            Span(
                1, start, m.end(),
                [
                    labels[-1].isalpha() and len(labels[-1]) > 1, bool(_SPELLED.search(whole)), word_at, bool(re.search(rf"{_B}dot{_B}", domain, re.I)),
                    bool(re.match(r":[\w/~]", after)), local.lower() in ("git", "hg", "svn", "ssh"), "pkg:" in lead or "://" in lead or lead[-1:] in ("/", ")"),
                    any(x.isdigit() for x in labels[-1]), len(labels), bool(re.match(r"[/@]", after)), "\n" in whole, len(local),
                ],
            )
        )
    return out


def _abbreviated(text: str, period: int) -> bool:
    """Whether fewer than four letters stand before a period."""
    start = period
    while start > 0 and period - start < 4 and text[start - 1].isalpha():
        start -= 1
    return 0 < period - start < 4


class Numbers:
    """The areas of a text that may hold a long number, each with the clause before it in one line.

    A clause reaches back to its beginning, and over one other number at most.
    """

    def __init__(self, text: str):
        self.text, self.areas = text, [m.span() for m in _NUMBERS.finditer(text)]
        ends = [m.end() for m in _CLAUSE_END.finditer(text) if m[0] != "." or not _abbreviated(text, m.start())] if self.areas else []
        self.read: dict[tuple[int, int], tuple] = {}
        self.starts, k, begin = [], 0, 0
        for i, (start, _) in enumerate(self.areas):
            while k < len(ends) and ends[k] <= start:
                begin = ends[k]
                k += 1
            self.starts.append(max(begin, self.areas[i - 2][1] if i > 1 else 0))

    def matches(self, pattern: re.Pattern, before: int, behind: int) -> Iterator[tuple[re.Match, int]]:
        for (start, end), clause in zip(self.areas, self.starts, strict=True):
            for m in pattern.finditer(self.text, max(0, start - before), end + behind):
                yield m, clause

    def lead(self, clause: int, start: int) -> tuple[str, tuple[bool, float], tuple[bool, float], bool]:
        """The clause before a number, its labels of identity numbers and of other numbers, and whether it ends with a cue for a phone number."""
        key = clause, start
        if key not in self.read:
            flat = _GAPS.sub(" ", self.text[min(clause, start) : start]).rstrip()
            # cues and what may follow them are shorter than 48 characters in one line
            self.read[key] = flat, _last_label(_LABEL, flat), _last_label(_NOT_ID, flat), bool(_PHONE_BEFORE.search(flat[-48:]))
        return self.read[key]


def _last_label(pattern: re.Pattern, lead: str) -> tuple[bool, float]:
    """Whether a clause has a label, and the number of words between it and the clause's end (20 if there is none)."""
    end = -1
    for m in pattern.finditer(lead):
        end = m.end()
    return end >= 0, float(min(len(lead[end:].split()), 20)) if end >= 0 else 20.0


def _groups(flat: str) -> list[int]:
    return [len(g) for g in re.findall(r"\d+", flat)]


def phone_spans(text: str, numbers: Numbers) -> list[Span]:
    out, seen = [], set()
    for m, clause in numbers.matches(_PHONE, 0, 24):
        start = m.start()
        for end in {m.end("number"), m.end("ext") if m["ext"] else m.end("number"), *_line_ends(text, start, m.end("number"))}:
            span = text[start:end]
            number = text[start : min(end, m.end("number"))]
            digits = sum(c.isdigit() for c in number)
            if not 6 < digits < 17 or (start, end) in seen or span.count("(") != span.count(")"):
                continue
            seen.add((start, end))
            flat = _flat(number)
            lead, label, other, cued = numbers.lead(clause, start)
            after = text[end : end + 16]
            more = re.match(rf"[ ./-]?\d|,?{_B}(?:ext|x)\.?{_B}?\d", after, re.I)
            groups = _groups(flat)
            out.append(
                Span(
                    2, start, end,
                    [
                        bool(_INTERNATIONAL.fullmatch(flat)), bool(_NATIONAL.fullmatch(flat)), flat[0] == "+", flat.startswith("00"), "(" in flat, flat[0] == "0" and not flat.startswith("00"),
                        digits, cued, *label, *other, bool(_DATE.match(flat)), span.count("\n"), bool(more),
                        bool(m["ext"]) and end == m.end("ext"), bool(re.search(r"\d[\s./-]*$", lead[-4:])), bool(_LINE_START.search(text[max(0, start - 12) : start])), max(groups), len(groups),
                        text[start - 1 : start] == "(" and after[:1] == ")",
                    ],
                )
            )
    return out


def _line_ends(text: str, start: int, end: int) -> list[int]:
    """Ends of the pieces if a number is cut at its line breaks."""
    return [start + m.start() for m in re.finditer(r"[ \t]*\n", text[start:end])]


def id_spans(text: str, numbers: Numbers) -> list[Span]:
    out, seen = [], set()
    for m, clause in numbers.matches(_ID, 4, 3):
        start = m.start()
        for end in {m.end("number"), *_line_ends(text, start, m.end("number"))}:
            number = text[start:end]
            digits = sum(c.isdigit() for c in number)
            if digits < 6 or (start, end) in seen:
                continue
            seen.add((start, end))
            lead, label, other, cued = numbers.lead(clause, start)
            after = text[end : end + 12]
            flat = _flat(number)
            groups = _groups(flat)
            out.append(
                Span(
                    3, start, end,
                    [
                        *label, *other, label[1] < other[1], cued, digits, flat[0].isalpha(), flat[-1].isalpha(), groups == [3, 2, 4] and "-" in flat,
                        bool(_DATE.match(flat)), number.count("\n"), bool(re.match(r"[./:@-]\d|\s*\n[ >]*\d", after)), flat.count(" "), bool(_INTERNATIONAL.fullmatch(flat) or _NATIONAL.fullmatch(flat)),
                        bool(re.search(r"[\dA-Z][ ./-]*$", lead[-2:])), groups[0], groups[-1], len(groups), lead.endswith((":", "=", "#")), flat.count("-") + flat.count("/"),
                    ],
                )
            )
    return out


_STREET_MORE = re.compile(rf"{_B}(?:(?:de|du|des|del|la|le|les|los|las){_B})?[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)*(?![\w@])")


def _streets(text: str) -> Iterator[tuple[str, int, list[int]]]:
    """(language, start, possible ends) of each street with its number; only where the name comes last can it go on."""
    for h in _HOUSE.finditer(text):
        m = _NUMBER_FIRST.match(text, h.start())
        if m:
            ends = [m.end()]
            while m.lastgroup == "fr" and len(ends) < 3 and (more := _STREET_MORE.match(text, ends[-1])):
                ends.append(more.end())
            yield m.lastgroup, m.start(), ends
    for n in _HOUSE_LAST.finditer(text):
        name = _back_over_blank(text, n.start())
        if name == n.start() or name == 0 or not _named(text, name):
            continue  # the word before the number is no name
        low = _words_back(text, name, 13)  # a street has no more words
        for stop in sorted({n.end(), n.end("house")}, reverse=True):
            m = _NUMBER_LAST.search(text, low, stop)
            if m:
                yield m.lastgroup, m.start(), [stop]
                break


def _named(text: str, end: int) -> bool:
    """Whether a word with a capital, or the sign for a number behind one, ends here."""
    start = _words_back(text, end, 1)
    if text[start:end].lower() in ("n.º", "nº"):
        end = _back_over_blank(text, start)
        start = _words_back(text, end, 1)
    return text[start : start + 1].isupper()


def _tail(text: str, stop: int) -> tuple[int, re.Match | None, str, list[int]]:
    """After a street: end of its unit, the match of town and code, the town's group and the ends of its words."""
    unit = _UNIT_AT.match(text, stop)
    core = unit.end() if unit else stop
    tail = _AFTER_STREET.match(text, core)
    if not tail:
        return core, None, "", []
    name = next(n for n in ("town1", "town2", "town3") if tail[n])
    return core, tail, name, [w.end() for w in _WORDS.finditer(text, tail.start(name), tail.end(name)) if w[0][0].isupper()]


def address_spans(text: str, words: Words) -> list[Span]:
    out = []

    def sighted(role: str, word: str, plain: bool) -> tuple[str, str]:
        n = words.setdefault((role, word), [0, 0])
        n[0] += 1
        n[1] += int(plain)
        return role, word

    for group, (lang, start, stops) in enumerate(_streets(text)):
        # end, stop, kind of code, town, its words, has a town, number of the stop, has a unit
        options: list[tuple] = []
        for more, stop in enumerate(stops):
            core, tail, name, ends = _tail(text, stop)
            unit = core > stop
            street = sighted("street", _street_name(text[start:stop]), unit or bool(re.match(r"[ \t]*(?:[,;.]|\n)", text[stop : stop + 3])))
            options.append((core, stop, 0, None, 0, False, more, unit, street))
            town = None
            if tail and re.match(r"\w+", tail[name])[0].lower() not in FUNCTION_WORDS:
                closed = name == "town2" or bool(re.match(r"[ \t]*[.,;\n]|$" if len(ends) > 1 else r"[ \t]*[.,;\n]|$|[ \t]+[a-zß-ÿ]", text[tail.end() : tail.end() + 4]))
                for end in ends:
                    sighted("town", _flat(text[tail.start(name) : end]).lower(), closed and end == ends[-1])
            for k, end in enumerate(ends):
                town = ("town", _flat(text[tail.start(name) : end]).lower())
                options.append((end, stop, int(name == "town1"), town, k + 1, True, more, unit, street))
            if name == "town2":
                options.append((tail.end(), stop, 2, ("town", _flat(tail[name]).lower()), len(ends), True, more, unit, street))
        best_code = max(o[2] for o in options)
        lead = _GAPS.sub(" ", text[_words_back(text, start, 3) : start]).rstrip()
        for end, stop, code, town, n_words, has_town, more, unit, street in options:
            nxt = re.match(rf"{_B}?([{_UP}][\w-]*)", text[end : end + 24])
            span = text[start:end]
            out.append(
                Span(
                    4, start, end,
                    [
                        code, best_code - code, n_words, has_town, unit, lang == "en", lang == "de", lang == "fr", lang == "es", bool(re.match(r"[ \t]*[.,;\n]|$", text[end : end + 4])),
                        bool(nxt) and nxt[1].lower() in FUNCTION_WORDS, bool(nxt), "\n" in span, bool(re.search(r"(?i)(?<!\w)(?:section|chapter|figure|table|page|step|line|version|module|item|no)$", lead)),
                        bool(re.match(r"\s+[a-zß-ÿ]|\s*$|[.,;]", text[end : end + 3])), "\n" in text[stop:end], _flat(span).split()[-1].lower() in FUNCTION_WORDS, more, lead.endswith((":", ",", "(")),
                        bool(re.search(r"(?i)(?<!\w)(?:address|adresse|anschrift|dirección|domicilio|at|in|to|from|near|nach|bei|à|au|en)[ :]*$", lead)),
                    ],
                    (town, street), group,
                )
            )
    return out


def _street_name(text: str) -> str:
    return re.sub(r"[\d,]+[a-z]?\b", "", _flat(text).lower()).strip()


def spans(text: str) -> tuple[list[Span], Words]:
    """All candidate spans of a text, and how often it shows each of the words that spans refer to."""
    words: Words = {}
    numbers, boxes = Numbers(text), list(_mailboxes(text))
    found = person_spans(text, words, boxes) + email_spans(text, boxes) + phone_spans(text, numbers) + id_spans(text, numbers) + address_spans(text, words)
    return found, words
