"""Invented labelled texts for fitting the span classifiers.

Everything is made up from syllables and public formats: names, mailboxes,
numbers of many countries' shapes, addresses in four languages, and strings that
resemble them.  The sentences are of everyday office and engineering prose and
were written without regard to any corpus to be searched.  The size of the
sample is a parameter and the seed fixed, so the fitted trees are the same
everywhere.
"""

from __future__ import annotations

import random
import re

_ON, _NU, _CO = "b br c ch d dr f g gr h j k kl l m n p r s sch st t th v w z".split(), "a e i o u é ö ü".split(), "l n r s t m nd rg ck ld".split()


def _word(r: random.Random, syllables: int) -> str:
    return "".join(r.choice(_ON) + r.choice(_NU) + (r.choice(_CO) if r.random() < 0.4 else "") for _ in range(syllables)).capitalize()


class Maker:
    def __init__(self, seed: int):
        r = self.r = random.Random(seed)
        self.given = [_word(r, r.choice((1, 2, 2, 3))) + r.choice(("a", "e", "n", "l", "")) for _ in range(70)]
        self.family = [_word(r, 2) + r.choice(("son", "mann", "ova", "ic", "ez", "well", "quist", "bauer", "eira", "ard", "ova", "lund")) for _ in range(260)]
        self.town = {k: [_word(r, 2) + r.choice(x) for _ in range(14)] for k, x in (("en", ("ford", "bury", " Falls", "ton", "haven")), ("de", ("berg", "dorf", " am Moor", "heim")), ("fr", ("ville", "-sur-Orne", "val", "ac")), ("es", ("sol", " del Rio", "mar", "ales")))}
        self.street = [_word(r, 2) for _ in range(60)]
        self.org = [f"{_word(r, 2)} {r.choice(['', _word(r, 1) + ' '])}{r.choice(['Group', 'Alliance', 'Institute', 'Foundation', 'Project', 'Council', 'Systems', 'Works', 'Networks', 'Software', 'Authors'])}" for _ in range(40)]
        self.who: tuple[str, str] = ("A", "B")

    # --- pieces -------------------------------------------------------------
    def n(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def pkg(self) -> str:
        return f"{_word(self.r, 2).lower()}-{self.r.choice('parser queue cache loader index codec router'.split())}"

    def ver(self) -> str:
        return f"{self.r.randrange(9)}.{self.r.randrange(22)}.{self.r.randrange(12)}"

    def hex(self, k: int = 10) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(k))

    def new_person(self) -> None:
        r = self.r
        fresh = r.random() < 0.3
        g = _word(r, 2) if fresh else r.choice(self.given)
        f = _word(r, 2) + "sen" if fresh else r.choice(self.family)
        if r.random() < 0.08:
            g += "-" + r.choice(self.given)
        if r.random() < 0.1:
            f += "-" + r.choice(self.family)
        if r.random() < 0.12:
            f = r.choice(["van der", "de", "von", "van", "du"]) + " " + f
        self.who = (g, f)

    def person(self) -> str:
        r, (g, f) = self.r, self.who
        x = r.random()
        if x < 0.12:
            s = f"{g[0]}. {f}"
        elif x < 0.26:
            s = f"{f[0].upper() + f[1:]}, {g}"
        elif x < 0.38:
            s = f"{g} {r.choice('ABCDEFGHJKLMPRST')}. {f}"
        else:
            s = f"{g} {f}"
        return s.upper() if r.random() < 0.08 else s

    def email(self) -> str:
        r = self.r
        g, f = (re.sub(r"[^a-z-]", "", x.lower()) for x in self.who)
        local = r.choice([f"{g}.{f}", f"{g[:1]}{f}", f"{f}_{g}", f"{f}-{g[:1]}", f"{g}{self.n(2)}", f"{g}+list", "info", "security", "press-team"])
        host = [_word(r, 2).lower().encode("ascii", "ignore").decode() + r.choice(["soft", "-labs", "net", ""]), r.choice(["example", "test", "invalid", "org", "com"])]
        if r.random() < 0.25:
            host.insert(0, r.choice(["mail", "corp", "lists"]))
        x = r.random()
        if x < 0.72:
            s = f"{local}@{'.'.join(host)}"
        elif x < 0.78:
            s = f"{local} @ {'.'.join(host)}"
        elif x < 0.88:
            s = f"{local} (at) {' (dot) '.join(host)}"
        elif x < 0.94:
            s = f"{local}[at]{'.'.join(host)}"
        else:
            s = f"{local} at {' dot '.join(host)}"
        return s.upper() if r.random() < 0.1 else s

    def phone(self) -> str:
        r, n = self.r, self.n
        return r.choice(
            [
                lambda: f"+44 (0)20 {n(4)} {n(4)}", lambda: f"+44{n(10)}", lambda: f"0{r.choice('1234567')}{n(2)}/{n(7)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(4)}",
                lambda: f"+1-{n(3)}-{n(3)}-{n(4)}" + r.choice(["", f" ext. {n(2)}", f" x{n(3)}"]), lambda: f"0049.{n(2)}.{n(5)}.{n(3)}", lambda: f"+49 (0){n(2)} {n(5)}-{n(3)}", lambda: f"+49 {n(2)} {n(5)} {n(3)}",
                lambda: f"+46 {n(1)} {n(3)} {n(3)} {n(2)}", lambda: f"0{r.choice('12345')} {n(2)} {n(2)} {n(2)} {n(2)}", lambda: f"+33 {r.choice('12346')} {n(2)} {n(2)} {n(2)}.{n(2)}", lambda: f"0{r.choice('12345')}.{n(2)}.{n(2)}.{n(2)}.{n(2)}",
            ]
        )()

    def idno(self) -> str:
        r, n = self.r, self.n
        up = lambda: r.choice("ABCDEFGHKLMNPRSTVXYZ")
        return r.choice(
            [
                lambda: f"{n(8)}{up()}", lambda: f"{up()}{n(7)}{up()}", lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"{r.choice(['19', '20'])}{n(2)}{r.choice(['03', '10', '12'])}{r.choice(['07', '15', '28'])}-{n(4)}",
                lambda: f"{n(2)}/{n(3)}/{n(5)}", lambda: f"{up()}{up()} {n(2)} {n(2)} {n(2)} {up()}", lambda: f"{up()}{up()}{n(6)}{up()}", lambda: f"{up()}{up()}{n(7)}", lambda: f"{up()}{n(8)}", lambda: f"{n(11)}", lambda: f"{n(9)}",
                lambda: f"{n(2)} {n(3)} {n(3)} {n(3)}", lambda: f"{r.choice('12')} {n(2)} {n(2)} {n(2)} {n(3)} {n(3)} {n(2)}", *[self.digits] * 6,
            ]
        )()

    def digits(self) -> str:
        """A number of some record: two to four groups of digits in a shape of no country's."""
        r = self.r
        sep, up = r.choice("-- /"), lambda k: "".join(r.choice("ABCDEFGHKLMNPRSTVXYZ") for _ in range(k))
        s = ""
        while sum(c.isdigit() for c in s) < 6:
            s = sep.join(self.n(r.choice((1, 2, 3, 3, 4, 4, 5, 6))) for _ in range(r.choice((2, 3, 3, 4)))) if r.random() < 0.7 else self.n(r.randrange(6, 14))
        if r.random() < 0.35:
            s = up(r.choice((1, 2))) + r.choice(("", " ")) + s
        return s + up(1) if r.random() < 0.1 else s

    def other(self) -> str:
        """A number that is nobody's: of a record's shape, or of a document's."""
        r, n = self.r, self.n
        return r.choice([self.digits, self.digits, self.idno, lambda: f"{r.choice('ABCDEFXYZ')}{r.choice('ABCDEFXYZ')}-{n(6)}", lambda: f"{n(3)}-{n(10)}", lambda: f"{n(4)} {n(4)} {n(4)}", lambda: n(10)])()

    def address(self, lang: str) -> str:
        r = self.r
        st, no, town = r.choice(self.street), f"{r.randrange(1, 260)}" + r.choice(["", "", "", "a", "b"]), r.choice(self.town[lang]) if r.random() < 0.75 else _word(r, 3)
        sep = r.choice([", ", ", ", "\n"])
        if lang == "en":
            s = f"{no} {st} {r.choice(['Road', 'Street', 'St.', 'Lane', 'Avenue', 'Ave', 'Drive', 'Court', 'Close', 'Way'])}"
            if r.random() < 0.25:
                s += r.choice([f", Suite {r.randrange(50)}", f", Floor {r.randrange(40)}", f", Apt {r.randrange(50)}", f" #{r.randrange(50)}"])
            end = r.choice(["", "", f"{sep}{town}", f"{sep}{self.n(5)} {town}", f"{sep}{town} {r.choice(['QX', 'B', 'SW'])}{r.randrange(1, 9)} {r.randrange(9)}{r.choice(['ZB', 'AB', 'XY'])}", f"{sep}{town}, {r.choice(['OH', 'TX', 'NY'])} {self.n(5)}"])
        elif lang == "de":
            s = r.choice([f"{st}{r.choice(['straße', 'weg', 'gasse', 'allee', 'ufer', 'platz'])} {no}", f"Am {st} {no}", f"Alte {st} {no}"])
            end = r.choice(["", f"{sep}{self.n(5)} {town}", f"{sep}{self.n(5)} {town}"])
        elif lang == "fr":
            s = f"{no}{r.choice([' ', ', '])}{r.choice(['rue', 'avenue', 'boulevard', 'place', 'chemin'])} {r.choice(['des ', 'du ', 'de ', 'de la ', ''])}{st}" + (f" {r.choice(self.street)}" if r.random() < 0.25 else '')
            end = r.choice(["", f"{sep}{self.n(5)} {town}", f"{sep}{self.n(5)} {town}"])
        else:
            s = f"{r.choice(['Calle', 'Avenida', 'Paseo', 'Plaza'])} {r.choice(['de los ', 'del ', 'de la ', ''])}{st}, {no}"
            end = r.choice(["", f"{sep}{self.n(5)} {town}", f"{sep}{self.n(5)} {town}"])
        return s + end

    # --- sentences ------------------------------------------------------------
    POSITIVE = {
        "en": ["Acked-by: {P} <{E}>", "Cc: {P} <{E}>", "On {d} {P} <{E}> remarked:", "Prepared by {P} for the {o}.", "I spoke with {P} yesterday and we agreed to wait.", "Dear {P}, your request has arrived.", "Yours sincerely,\n{P}",
               "Mrs {P} will take over next week.", "Dr {P} gave the talk.", "Name: {P}\nPhone: {N}\nMail: {E}", "This was discovered by {P} while testing.", "{P} (the {o}) objected.", "{P} said that the release can go out.", "{P} reported no further trouble.",
               "We met {P} and {P} in spring.", "A parcel for {P} was left at {A}.", "Credit is due to {P}.", "Many thanks to {P} and the {o}.", "The account belongs to {P}, passport number {I}.", "owner: {P}", "approver = {P}", "attn {P}", "The patch came from {P}.",
               "© {y4} {P}", "© {y4} {P} {x}", "Written by {P}, {y4}.", "According to our colleague {P} nothing was lost.", "In the opinion of {P}, {k} can stay.", "Text {N} if the door is closed.", "You may dial {N} at any time.", "Hotline: {N}.", "Fax {N}, attention of {P}",
               "Telephone {N} or mail {E}.", "My mobile is {N}.", "Reply to {E}, please.", "The mailbox {E} is full.", "send invoices to {E}", "<{E}>", "contact=\"{E}\"", "mailto:{E}", "({E})", "{P} ({N}) keeps the keys.", "The porter ({N}) can open it.", "ask the front office ({N})", "His social security number, {I}, was printed.", "SSN: {I}",
               "ID card {I}", "Her passport ({I}) has expired.", "The taxpayer id is {I} and must be hidden.", "national_id={I}", "Personal ID {I} appears twice.", "The tax number of the applicant is {I}.", "Passport of the visitor: {I}", "national id of the holder = {I}", "The identity card no. of the tenant, {I}, is wrong.", "Driver's license {I} was scanned.", "The employee lives at {A}.", "Visit us at {A}.", "Address: {A}", "Deliver to {A}.",
               "The workshop is in {A}; ring twice.", "Billing address: {A} {x}", "Our branch at {A} is closed.", "{P}\n{A}\n{N}", "-- \n{P}\n{o}\n{A}\n{N}\n{E}", "{P}\n{N}\n{E}", "-- \n{P}\n{o}\n{A}\nTel: {N}\n{E}", "Regards,\n{P}\n{E}", "Meet {P}, our new auditor.", "The signature of {P} is missing.", "assigned to {P}"],
        "de": ["Bitte wenden Sie sich an {P}.", "Frau {P} ist im Urlaub.", "Herr {P}, Telefon {N}, hilft weiter.", "Mit freundlichen Grüßen\n{P}", "Nach Auskunft von {P} ist {k} in Ordnung.", "Verfasst von {P}", "Der Brief an {P}, {A}, kam zurück.", "Sie erreichen uns unter {N}.",
               "Mobil: {N}", "E-Mail: {E}", "Schreiben Sie an {E}.", "Die Personalausweisnummer {I} ist ungültig.", "Reisepass {I} wurde kopiert.", "Seine Steuer-ID lautet {I}.", "Adresse: {A}", "Unser Büro liegt in {A}.", "Wohnhaft: {A} {x}", "Lieferung an {A}.", "Laut Aussage von {P} war alles gut."],
        "fr": ["Veuillez contacter {P}.", "Madame {P} est absente.", "M. {P}, téléphone {N}, vous aidera.", "Cordialement,\n{P}", "D'après {P}, {k} est en ordre.", "Rédigé par {P}", "La lettre pour {P}, {A}, est revenue.", "Joignable au {N}.", "Portable : {N}", "Courriel : {E}", "Répondre à {E}.",
               "La carte d'identité {I} est périmée.", "Passeport numéro {I}.", "Son numéro fiscal est {I}.", "Notre bureau se trouve au {A}.", "Domicile : {A} {x}", "Livraison : {A}", "Merci à {P} pour son aide."],
        "es": ["Póngase en contacto con {P}.", "La señora {P} está ausente.", "Don {P}, teléfono {N}, le ayudará.", "Atentamente,\n{P}", "Según nos dijo {P}, {k} está en orden.", "Redactado por {P}", "La carta para {P}, {A}, fue devuelta.", "Puede llamarnos al {N}.", "Móvil: {N}", "Correo: {E}",
               "Responda a {E}.", "El DNI {I} ha caducado.", "Pasaporte número {I}.", "Su número fiscal es {I}.", "Nuestra oficina está en {A}.", "Domicilio: {A} {x}", "Entrega: {A}", "Gracias a {P} por su ayuda."],
    }
    NEGATIVE = [
        "{o} agreed to the plan.", "A letter from the {o} arrived.", "We asked {o} for advice.", "Our contract with {o} ends soon.", "See the notes of the {o}, Volume {y}.", "© {y4} {o}", "Written by the {o}, {y4}.", "The {W} {W} is a fine tool.", "Try {W} {W} instead.", "{W} Server {v} is out.",
        "{W} Desktop runs on {W} Linux.", "Open Source Software is not free of duties.", "The Quick Start Guide explains it.", "Read the Release Notes first.", "New features of {W} Suite {y4}:", "case {u} was settled", "Order {u} has shipped.", "Invoice no. {u} is unpaid.", "Tracking number {u}",
        "serial: {u}", "S/N {u}", "Lot {u} failed the test.", "Part {u} is out of stock.", "job {u} finished after {y} minutes", "Revision {u} broke it.", "ISBN {u}", "Booking {u} was cancelled.", "The model {u} has two ports.", "batch {u}", "The checksum is {u}.", "hash {h}{h}", "{h}",
        "offset {g} of {g} bytes", "epoch {g}", "The range {u} to {u} is reserved.", "It weighs {y} kg and costs {y}.50.", "Page {y} of {y}", "Issue #{f} repeats #{f}.", "RFC {f}, section {z}.{z}", "{k} {v} needs {k} {v} or later.", "npm install {k}@{v}", "docker pull {w}/{k}:{v}",
        "git clone git@git.{w}.example:{w}/{k}.git", "ssh://git@code.{w}.test/{w}/{k}", "pkg:pypi/{k}@{v}", "import {{ {W} }} from '@{w}/{k}'", "see https://{w}.example/a/{f}?at={y}", "The server at 192.168.{y2}.{z} listens on {f}.", "From 203.0.113.{z} to 203.0.113.{y2}", "On {d} at 0{z}:{y2} it began.",
        "timestamp {d}T1{z}:{y2}:{y2}Z", "between {d} and {d}", "{y} Main Street Records were lost.", "Chapter {z} Park Avenue Stories", "Table {y} Lane Changes", "{y} Way Handshakes are slow", "Line {y} Drive Errors", "{W} Road Show {y4}", "Das Werk {W} hat {y} Plätze.", "Auftrag {u} ist fertig.",
        "Rechnung {u} ist offen.", "Die {o} stimmte zu.", "La facture {u} est payée.", "La commande {u} est partie.", "{o} a signé.", "El pedido {u} salió ayer.", "La factura {u} está pagada.", "{o} firmó el acuerdo.", "meet at noon", "look at dot files first", "Build {u}", "Ticket {u}.", "Bestellung {u}", "digest {h}", "It repeats {u}.", "same as {u}", "ticket {u} was merged into {u}", "This order replaces order\n{u}.", "superseded by {u}", "{h} differs from {g}",
        "Dear customer, thank you.", "Call the {o} first.", "Reported by nobody so far.", "To Whom It May Concern", "Best Regards", "Kind Regards,\nThe {o}", "Mit Freundlichen Grüßen", "North America and South America", "Monday Morning Meeting", "Version {v} (build {g})",
    ]
    STARTS = ["It rained all day.", "Please wait.", "Nothing else was found.", "Alles Weitere folgt.", "Rien d'autre.", "Nada más.", "Ring the bell.", "Ensuite, revenez.", "Danach geht es weiter.", "Bring a copy.", "They open at nine.", "Parking is free.", "Visitors are welcome."]

    def date(self) -> str:
        r = self.r
        y, m, d = r.randrange(1990, 2040), r.randrange(1, 13), r.randrange(1, 29)
        return r.choice([f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{d:02}/{m:02}/{y}"])

    def fill(self, template: str, lang: str) -> tuple[str, list[tuple[str, int, int]]]:
        out, found = "", []
        for piece in re.split(r"(\{\w+\})", template):
            if not re.fullmatch(r"\{\w+\}", piece):
                out += piece.replace("{{", "{").replace("}}", "}")
                continue
            c = piece[1:-1]
            kind = {"P": "person", "E": "email", "N": "phone", "I": "id_number", "A": "address"}.get(c)
            if c == "P" and found and self.r.random() < 0.7:
                self.new_person()
            value = {
                "P": self.person, "E": self.email, "N": self.phone, "I": self.idno, "A": lambda: self.address(lang), "o": lambda: self.r.choice(self.org), "k": self.pkg, "v": self.ver, "h": self.hex, "u": self.other, "d": self.date,
                "w": lambda: _word(self.r, 2).lower(), "W": lambda: _word(self.r, 2), "y": lambda: str(self.r.randrange(10, 399)), "y2": lambda: str(self.r.randrange(10, 60)), "y4": lambda: str(self.r.randrange(1998, 2036)),
                "z": lambda: str(self.r.randrange(1, 9)), "f": lambda: self.n(self.r.randrange(3, 6)), "g": lambda: self.n(self.r.randrange(7, 12)), "x": lambda: self.r.choice([*self.STARTS, f"{self.r.choice(self.org)} agreed."]),
            }[c]()
            if kind:
                found.append((kind, len(out), len(out) + len(value)))
            out += value
        return out, found

    def document(self, positive: dict[str, list[str]] | None = None, negative: list[str] | None = None) -> tuple[str, list[tuple[str, int, int]]]:
        r, positive, negative = self.r, positive or self.POSITIVE, negative or self.NEGATIVE
        text, found, lang = "", [], r.choice(["en", "en", "en", "de", "fr", "es"])
        for _ in range(r.randrange(2, 7)):
            self.new_person()
            template = r.choice(positive[lang if r.random() < 0.8 else "en"]) if r.random() < 0.55 else r.choice(negative)
            piece, spans = self.fill(template, lang)
            found += [(k, a + len(text), b + len(text)) for k, a, b in spans]
            text += piece + r.choice([" ", " ", "\n", "\n\n"])
        if r.random() < 0.4:
            text, found = self._wrapped(text, found, r.choice(["\n", "\n", "\n> "]))
        return text, found

    def _wrapped(self, text: str, found: list[tuple[str, int, int]], brk: str) -> tuple[str, list[tuple[str, int, int]]]:
        out, at, place, width, line = [], [], 0, self.r.randrange(30, 72), 0
        for ch in text:
            cut = ch == " " and line > width
            out.append(brk if cut else ch)
            at.append(place)
            place += len(out[-1])
            line = 0 if cut or ch == "\n" else line + 1
        return "".join(out), [(k, at[a], at[b - 1] + 1) for k, a, b in found]


def sample(size: int, seed: int, positive: dict[str, list[str]] | None = None, negative: list[str] | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``size`` texts with their labelled places; other sentences than the own ones may be given."""
    maker = Maker(seed)
    return [maker.document(positive, negative) for _ in range(size)]
