"""Labelled spans to train the tagger of personal data on.

A part of an example is (text, type) with type "" for ordinary text. An item is
set between random lead and tail words, in frames of its type, alone on a line,
in a table row or between sentences, so that the tagger learns shapes and weak
hints and no fixed carriers; NOTE_SHARE of them are written in the manner of project
notes. Family names are partly common ones, partly
invented from letters; streets, firms, hosts and numbers are invented. Decoys
have the shape of an item and are none. Ordinary sentences go in between; those that
might hold personal data themselves are kept out (``ordinary``).

``Maker(held=True)`` uses frames, names and words that training never sees; the
quality stated in the README is measured on these.
"""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

from palimpsest.llm.given_names import GIVEN, KNOWN, MORE, ORDINARY_TOO

#: Common family names.
FAMILY = """Adams Ahmed Allen Alvarez Andersen Anderson Bailey Baker Bauer Becker Bennett Bernard Bianchi Blanc Brooks Brown Bruun Campbell Carter Castro Chen Clark Clarke Collins Cooper Costa Cox
Cruz Davies Davis Diaz Dubois Dupont Durand Edwards Esposito Evans Fernandes Fernández Ferrari Fischer Fisher Flores Foster Fournier García Girard Gomes Gómez González Gray Green Gruber Gupta
Hall Hansen Harris Hernández Hill Hoffmann Horvat Howard Hughes Ivanov Jackson Jansen Jensen Johansson Johnson Jones Kaya Keller Kelly Khan Kim King Klein Koch Kowalski Kumar Lambert Lange Larsen
Laurent Lee Lefebvre Lewis Li Lopes López Marino Martin Martínez Mendes Mendoza Meyer Mitchell Moore Morales Moreau Moretti Morgan Morris Müller Murphy Murray Nakamura Nelson Neumann Nguyen Nielsen
Novak Nowak Oliveira Ortiz Parker Patel Pereira Pérez Peters Petrov Phillips Popescu Ramírez Reed Ribeiro Ricci Richter Rivera Roberts Robinson Rodríguez Romano Rossi Roux Russo Ruiz Santos""".split()
#: Common nouns and adjectives that begin the names of places, teams and products.
COMMON = """Blue Red Green North South East West Upper Lower Grand New Old Golden Silver Silent Bright First Second Open Global Central Northern Southern Data Cloud Core Inner Night Spring Summer
Winter Autumn Monday Tuesday Friday Sunday January March July October United Royal Public Digital Quantum River Stone Iron Copper Amber Velvet Paper Solar Lunar Arctic Atlantic""".split()
NOUNS = """Beacon Lantern Prism Tide Compass Relay Anchor Harbor Summit Canyon Mosaic Delta Orchard Ridge Forge Bridge Garden Tower Valley Station Market Square Library Team Board Group Platform Engine
Service Gateway Review Report Project Phase Release Pipeline Cluster Index Ledger Archive Kingdom Nations Bank Museum University Council Office Kitchen Sprint Roadmap""".split()
TRADES = "Systems Foods Partners Holding Research Energy Materials Logistics Press Media Labs Insurance Capital Institute Foundation Services Textiles Motors Optics Pharma".split()
FORMS = "Ltd LLC Inc GmbH AG BV SA Corp plc SpA Oy AB".split()

WORD = re.compile(r"[^\W\d_][\w'’-]*")
#: Sentences in which a word must occur to count as an ordinary one.
USUAL = 30


def ordinary(sentences: list[str]) -> list[str]:
    """Sentences that can hold no personal data.

    They have no long numbers and no address signs, no known given name in any
    case, no initial, and of two capitalised words in a row one is a usual word.
    """
    usual = Counter(w for s in sentences for w in set(WORD.findall(s)))
    known = {w.lower() for w in KNOWN}

    def good(s: str) -> bool:
        if re.search(r"[@＠]|\(at\)|\[at\]|\d{5,}|\d[ .\-/]\d{2,}|\b[A-Z]\.|(?i:street|straße|str\.|avenue|\brue\b|\bvia\b|calle|lane|road)", s):
            return False
        words = WORD.findall(s)
        if any(w.lower() in known for w in words if w not in ORDINARY_TOO):
            return False
        return all(max(usual[a], usual[b]) >= USUAL for a, b in itertools.pairwise(words) if a[0].isupper() and b[0].isupper())

    return [s for s in sentences if good(s)]


#: Words before an item, by type and language; {} is the item.
FRAMES = {
    "name": [
        *["{}"] * 12, "Tell {}", "Thank {}", "Remind {}", "Invite {}", "Wait for {}", "Danke {}", "Frage an {}", "Merci {}", "Gracias {}", "Sincerely, {}", "Cheers, {}", "Approved: {}", "Bring {} along", "Is {} here?", "{} and {}", "{}, {}",
        "{} said so", "I spoke with {} about it", "thanks to {}", "{} and the others agreed", "as {} wrote", "{} will join on Thursday", "please tell {}", "handed over to {}", "owner: {}", "author: {}", "from {}",
        "by {}", "met {} in the lobby", "{} is on leave", "my colleague {} knows more", "assigned to {}", "reviewed by {}", "{} noted that", "Dear {},", "Hello {},", "Regards, {}", "Best wishes {}", "{}:", "- {}",
        "{} (lead)", "interview: {}", "the idea came from {}", "when {} returns", "{} has left the team", "{} disagrees", "told {} to wait", "chaired by {}", "attendees: {}", "{} called twice", "visit of {}", "{}'s notes",
        "nach Rücksprache mit {}", "{} hat zugesagt", "Ansprechpartner: {}", "von {}", "{} kommt später", "laut Auskunft von {}", "avec {}", "selon {}", "{} a dit oui", "de la part de {}", "con {}", "según {}", "{} dijo que no",
        "secondo {}", "{} ha confermato", "segundo {}", "{} vai ligar", "volgens {}", "{} belt terug", "со слов {}", "{} ждёт ответа", "{}と話した", "Teilnehmer {}", "hablar con {}", "parler à {}", "lo dice {}",
    ],
    "email": [
        "write to {}", "mail: {}", "e-mail {}", "reachable at {}", "send it to {}", "{} bounced", "reply to {}", "account {}", "user {}", "forward this to {}", "from {}", "to: {}", "my address is {}", "{} is the new mailbox",
        "invite {}", "({})", "contact: {}", "questions go to {}", "an {}", "schreib an {}", "E-Mail: {}", "écris à {}", "courriel {}", "correo {}", "escribe a {}", "scrivi a {}", "envia para {}", "stuur naar {}", "почта {}", "{}",
    ],
    "phone": [
        "call {}", "dial {}", "phone: {}", "tel. {}", "Tel: {}", "mobile {}", "cell {}", "my number is {}", "ring me at {}", "text {}", "fax {}", "{} rang twice", "call me on {}", "hotline {}", "reach us under {}", "number {}", "☎ {}",
        "Telefon {}", "Handy {}", "erreichbar unter {}", "Rückruf unter {}", "tél. {}", "appelle le {}", "portable : {}", "llama al {}", "teléfono {}", "móvil {}", "chiama {}", "cellulare {}", "liga para {}", "bel {}", "звоните {}", "{}", "WhatsApp {}",
    ],
    "address": [
        "lives at {}", "send the parcel to {}", "office: {}", "{} is where we meet", "address: {}", "our branch at {}", "located in {}", "the flat at {}", "pick it up at {}", "home address {}", "at {}", "visit {}", "corner of {}", "the keys are at {}",
        "wohnhaft {}", "Anschrift: {}", "Büro in der {}", "adresse : {}", "habite {}", "domicile {}", "dirección: {}", "vive en {}", "indirizzo {}", "abita in {}", "morada: {}", "adres {}", "адрес {}", "{}", "billing address {}", "the van stops at {}",
    ],
    "id_number": ["{}", "her {}", "his {}", "the {}", "{} on file", "copy of {}", "verified {}", "{} was checked", "enter {}", "please update {}", "mit {}", "avec {}", "con {}", "{} expired", "the form has {}", "{} is wrong", "stored {}", "profile: {}"],
}
#: Frames that only the held-out examples use.
HELD = {
    "name": ["{} won the chess game", "we all miss {}", "flowers for {}", "{} borrowed the projector", "the desk of {}", "{} speaks four languages", "seat next to {}", "Geburtstag von {}", "photo by {}", "{} prefers tea"],
    "email": ["subscribe {}", "{} never answers", "the alias {} is gone", "shared the sheet with {}", "Postfach {}", "escríbeme: {}"],
    "phone": ["voicemail on {}", "{} is engaged", "the alarm dials {}", "emergency contact {}", "notfalls {}", "numéro {}"],
    "address": ["the bakery at {}", "moving van parked by {}", "we painted {}", "mailbox of {}", "Treffpunkt {}", "rendez-vous {}"],
    "id_number": ["lost {}", "photographed {}", "{} belongs to her", "{} typed by hand", "Kopie: {}"],
}
#: Family and given names that only the held-out examples use.
HELD_FAMILY = "Smith Sanders Holmes Watanabe Schröder Vasquez Okafor Lindgren Petrovic Haddad Field Turner Byrne Sato Weiss Marchetti Delgado Fontaine Visser Kovacs".split()
HELD_GIVEN = "Sherlock Brigitte Naomi Esteban Gunther Aoife Rashid Tamara Leopold Yasmin Dominic Ottilie Cedric Marisol Benedict Ludmila Raymond Celeste Igor Freya".split()
#: Share of the training examples in the manner of project notes; the held-out ones have none.
NOTE_SHARE = 0.45
STREET_EN = "Street Lane Avenue Road Rd St. St Ave Ave. Ln Drive Dr Court Way Boulevard Blvd Terrace Place Crescent Close Hill Square Parkway Row".split()


class Maker:
    """Makes labelled examples with a seed; ``notes`` are ordinary sentences."""

    def __init__(self, seed: int, notes: list[str], held: bool = False):
        self.r = random.Random(seed)
        self.notes = notes
        self.held = held
        self.words = [w for s in notes[:3000] for w in re.findall(r"[^\W\d_]+", s)] or ["note"]

    def pick(self, *options):
        return self.r.choice(options)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def made(self, low: int = 1, high: int = 3) -> str:
        """An invented capitalised word."""
        on, nucleus = "b br c ch d dr f fr g gr h j k kl kr l m n p pr qu r s sch sl st t th tr v w wh y z zh".split(), "a e i o u a e i o u a e i o u a e i o u ai ea ie ou é ö ü á ø".split()
        coda = [*[""] * 16, *"n r l s m t k d g b v x n r l s nd rt st ng".split()]
        w = "".join(self.r.choice(on if self.r.random() < 0.85 else [""]) + self.r.choice(nucleus) + self.r.choice(coda) for _ in range(self.r.randint(low, high)))
        w += self.pick("", "", "", "", "er", "son", "sen", "berg", "man", "mann", "ley", "ford", "ov", "ova", "ski", "ska", "ez", "es", "ić", "ini", "etti", "eau", "oux", "strom", "ström", "dale", "wick", "quist", "dóttir", "dottir", "holm", "kamp", "ton", "ier")
        return w[0].upper() + w[1:]

    def family(self) -> str:
        if self.held and self.r.random() < 0.5:
            return self.r.choice(HELD_FAMILY)
        x = self.r.random()
        s = self.r.choice(FAMILY) if x < 0.3 else self.made(1, 4)
        if x > 0.96:
            s += "-" + self.r.choice(FAMILY)
        elif x > 0.93:
            s = self.pick("de ", "van ", "von ", "di ", "da ", "O'", "Mc", "del ") + s
        return s

    def given(self) -> str:
        if self.held and self.r.random() < 0.5:
            return self.r.choice(HELD_GIVEN)
        return self.r.choice(GIVEN if self.r.random() < 0.7 else MORE)

    def typo(self, s: str) -> str:
        i = self.r.randrange(1, max(2, len(s) - 1))
        return self.pick(s[:i] + s[i + 1 :], s[:i] + s[i + 1 : i + 2] + s[i : i + 1] + s[i + 2 :], s[:i] + s[i : i + 1] + s[i:])

    def name(self) -> list[tuple[str, str]]:
        g, s = self.given(), self.family()
        if self.r.random() < 0.12:
            s = self.typo(s)
        m = self.r.choice("ABCDEFGHIJKLMNOPRSTVW")
        full = self.pick(*[f"{g} {s}"] * 12, f"{s}, {g}", f"{s}, {g} {m}.", f"{g[0]}. {s}", f"{g[0]}. {m}. {s}", f"{g[0]}.{m}. {s}", f"{g} {m}. {s}", f"{s} {g}", f"{s}, {g[0]}.", f"{g} {self.given()} {s}")
        x = self.r.random()
        full = full.upper() if x < 0.08 else full.lower() if x < 0.11 else full
        title = self.pick(*[""] * 7, "Mr ", "Mr. ", "Ms ", "Mrs. ", "Dr. ", "Prof. ", "Herr ", "Frau ", "Mme ", "Sr. ", "Sra. ")
        return [(title, ""), (full, "name")]

    @staticmethod
    def plain(text: str) -> str:
        import unicodedata

        text = unicodedata.normalize("NFKD", text.lower().replace("ø", "o").replace("ß", "ss"))
        return re.sub(r"[^a-z0-9]", "", "".join(c for c in text if not unicodedata.combining(c)))

    def email(self) -> list[tuple[str, str]]:
        g, s, w = self.plain(self.given()), self.plain(self.family()), self.plain(self.r.choice(self.words)) or "info"
        user = self.pick(f"{g}.{s}", f"{g}.{s}", f"{g}-{s}", f"{g[0]}{s}", s, f"{s}_{g[0]}", f"{g}{self.digits(2)}", f"{g}.{s}+{w}", f"{s}{g[0]}", w, f"{g}_{s}{self.digits(1)}", f"{g[0]}.{s}")
        host = self.pick("", "", "", "mail.", "eu.", "hr-", "post.", "smtp.", "dept.") + self.plain(self.made(2, 3)) + self.pick("", "-" + w)
        host += self.pick(".example", ".invalid", ".test", ".example.com", ".example.org", ".example.net", ".com", ".org", ".net", ".de", ".fr", ".co.uk", ".io", ".es", ".it", ".edu")
        at = self.pick(*["@"] * 7, " @ ", " (at) ", "(at)", "[at]", "＠", " [at] ", " at ")
        if at in (" (at) ", "(at)", " [at] ", " at ", "[at]") and self.r.random() < 0.7:
            host = host.replace(".", " dot " if at == " at " else self.pick(" (dot) ", "(dot)") if "(" in at else self.pick(" [dot] ", " dot ", "[dot]"))
        elif at == " at ":
            host = host.replace(".", " dot ")
        a = user + at + host
        a = a.upper() if self.r.random() < 0.07 else a
        return self.pick([(a, "email")], [(a, "email")], [(a, "email")], [("<", ""), (a, "email"), (">", "")], [("mailto:", ""), (a, "email")])

    def phone(self) -> list[tuple[str, str]]:
        d, land = self.digits, self.r.choice("1 7 20 27 30 31 33 34 39 41 43 44 45 46 47 48 49 52 55 61 81 86 90 91 351 353 358 420".split())
        area, exchange = str(self.r.randint(201, 989)), str(self.r.randint(200, 999))
        p = self.pick(
            f"{area}-{exchange}-{d(4)}", f"({area}) {exchange}-{d(4)}", f"({area}) {exchange} {d(4)}", f"{area}.{exchange}.{d(4)}", f"1.{area}.{exchange}.{d(4)}", f"+1 {area} {exchange} {d(4)}", f"+1-{area}-{exchange}-{d(4)}", f"+1{area}{exchange}{d(4)}",
            f"0{d(2)} {d(4)} {d(4)}", f"0{d(4)} {d(6)}", f"0{d(3)} {d(3)} {d(4)}", f"+44 (0){d(2)} {d(4)} {d(4)}", f"+44 {d(4)} {d(6)}", f"0{d(2)} {d(5)} {d(3)}", f"0{d(3)}/{d(7)}", f"0{d(2)}-{d(7)}", f"0{d(3)} {d(7)}",
            f"+{land} {d(3)} {d(5)} {d(2)}", f"+{land} {d(2)} {d(5)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{land} {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+{land} {d(3)} {d(3)} {d(3)}",
            f"00{land} {d(3)} {d(3)} {d(3)}", f"+{land}{d(9)}", f"00{land}{d(9)}", f"0{d(10)}", f"0{d(2)} {d(8)}",
        )
        if self.r.random() < 0.1:
            p = p.replace("-", self.pick("‑", "–")).replace(" ", " ")
        return [(p, "phone")] + ([(self.pick(" ext. ", " x", " ext ", ", ext. ", " extension ", " Durchwahl ") + self.digits(self.r.randint(2, 4)), "")] if self.r.random() < 0.1 else [])

    def ident(self) -> list[tuple[str, str]]:
        d, letter = self.digits, lambda n: "".join(self.r.choice("ABCDEFGHJKLMNPQRSTXYZ") for _ in range(n))
        kind = self.r.randrange(5)
        if kind == 0:
            cap = self.pick("SSN", "ssn:", "SSN:", "soc. sec. no.", "social security number", "social security no.", "national ID", "identity number", "ID card", "DNI", "Ausweisnr.")
            v = self.pick(f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(9)}", f"{d(8)}{letter(1)}")
        elif kind == 1:
            cap = self.pick("NINO", "NI number", "NI no.", "national insurance no.", "national insurance number", "insurance number", "NI:")
            v = self.pick(f"{letter(2)}{d(6)}{letter(1)}", f"{letter(2)} {d(2)} {d(2)} {d(2)} {letter(1)}")
        elif kind == 2:
            cap = self.pick("TIN", "tax ID", "tax number", "tax no.", "Steuer-ID", "Steuer-IdNr.", "Steuernummer", "numéro fiscal", "NIF", "codice fiscale")
            v = self.pick(f"{d(11)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(10)}", f"{d(3)} {d(3)} {d(3)}")
        elif kind == 3:
            cap = self.pick("passport", "passport no.", "passport number", "travel document", "Reisepass", "passeport", "pasaporte", "passaporto")
            v = self.pick(letter(1) + d(7), letter(1) + d(8), letter(2) + d(7), d(9), letter(1) + d(6))
        else:
            cap = self.pick("IBAN", "IBAN:", "account", "bank account", "account no.", "Konto", "compte", "cuenta")
            b = self.r.choice("DE FR ES IT NL GB AT CH BE PT XA ZZ XX LU".split()) + d(2) + d(self.pick(12, 14, 16, 18, 18, 20))
            v = self.pick(b, b, " ".join(b[i : i + 4] for i in range(0, len(b), 4)), " ".join(b[i : i + 4] for i in range(0, len(b), 4)))
        return ([(cap + " ", "")] if self.r.random() < 0.85 else []) + [(v, "id_number")]

    def address(self) -> list[tuple[str, str]]:
        s, no = self.pick(self.made(2, 3), self.made(1, 3), self.r.choice(FAMILY), self.r.choice(COMMON), self.r.choice("Maple Baker Oak Church Park Mill Station Victoria King's Bridge Garden Elm".split())), str(self.r.randint(1, 249)) + self.pick("", "", "", "", "A", "b", "B")
        lead = self.pick("", "", "", "Old ", "North ", "W. ", "St. ", "Upper ")
        way = self.r.choice(STREET_EN)
        a = self.pick(
            *[f"{no} {lead}{s} {way}"] * 7, f"{s}straße {no}", f"{s}strasse {no}", f"{s}str. {no}", f"{s}weg {no}", f"{s}gasse {no}", f"{s} Platz {no}", f"{s}allee {no}", f"Am {s} {no}", f"Calle {s} {no}", f"Calle de {s}, {no}", f"Plaza {s} {no}",
            f"{no} rue de {s}", f"{no}, avenue des {s}s", f"{no}, rue {s}", f"{no} bd {s}", f"Via {s} {no}", f"Piazza {s} {no}", f"Avenida {s} {no}", f"Rua {s}, {no}", f"{s}straat {no}", f"{s}laan {no}",
        )
        a = a.upper() if self.r.random() < 0.08 else a
        unit = self.pick(*[""] * 5, f", Apt {self.digits(2)}", f", Unit {self.digits(1)}", f", Flat {self.digits(1)}", f", Apt. {self.digits(1)}B", f", Suite {self.digits(3)}")
        town = self.pick("", "", "", f", {self.digits(5)} {self.made(1, 2)}", f", {self.made(2, 3)}", f", {self.made(1, 2)} {self.pick('SW1', 'NE4', 'B12')} {self.digits(1)}{self.pick('AB', 'QT')}")
        return [(a, "address"), (unit + town, "")]

    def some_words(self, most: int = 4) -> str:
        words = " ".join(self.r.choice(self.words) for _ in range(self.r.randint(1, most)))
        return words[:1].upper() + words[1:] if self.r.random() < 0.3 else words

    def item(self, kind: str) -> list[tuple[str, str]]:
        return {"name": self.name, "email": self.email, "phone": self.phone, "id_number": self.ident, "address": self.address}[kind]()

    def framed(self, kind: str) -> list[tuple[str, str]]:
        frame = self.r.choice((HELD if self.held else FRAMES)[kind])
        a, *more = frame.split("{}")
        b = more.pop()
        if self.r.random() < 0.3:
            a = a[:1].upper() + a[1:]
        a = self.some_words(3) + " " + a if self.r.random() < 0.25 else a
        b = b + " " + self.some_words(3) if self.r.random() < 0.25 else b
        out = [(a, ""), *self.item(kind)]
        for between in more:
            out += [(between, ""), *self.item(kind)]
        return [*out, (b, "")]

    def note_carrier(self) -> list[tuple[str, str]]:
        """A sentence in the manner of project notes."""
        n, e, p, i, a = self.name, self.email, self.phone, self.ident, self.address
        made: list = self.pick(
            [n, " asked to be called on ", p, " from now on."], [n, " moved to ", a, "."], [n, " wohnt jetzt in: ", a, "."], ["Ask ", n, " whether this still holds."], ["According to ", n, " the import is done."],
            ["Laut ", n, " ist der Import fertig."], ["Signed, ", n], ["Signed, ", n, "."], ["Meeting held by ", n, " and ", n, "."], ["Meeting held by ", n, " and ", n, " approved the change."], [n, " approved the change."], [n, " a validé le changement."], [n, " aprobó el cambio."],
            ["Contact ", n, " at ", e, " or ", p, "."], ["Contacter ", n, " au ", p, "."], ["Llamar a ", n, " al ", p, "."], ["Bitte ", n, " unter ", p, " anrufen."], ["For the record: ", n, ", ", i, ", ", a, "."], ["For the record: ", n, ", ", i, "."],
            ["login was ", e, "."], ["cc ", e, "; bcc ", e, "."], ["Send the minutes to ", e, " please."], ["User said: my ", i, ", my mail is ", e, "."], ["New phone ", p, ", old one ", p, " is dead."], ["The form shows ", i, " next to ", p, "."],
            ["The badge request lists ", i, "."], ["Hinterlegt ist ", i, "."], ["Le dossier indique ", i, "."], ["El expediente indica ", i, "."], ["Il modulo riporta ", i, "."], ["Deliver the laptop to ", a, " next week."], ["Ship to: ", a, "."], ["Lieferung an ", a, ", Tel. ", p, "."],
            ["Entrega en ", a, "."], ["Livraison : ", a, "."], ["Visitors should come to ", a, " and ring ", p, "."], ["Reached ", p, ", nobody answered."], ["Rückfragen an ", e, "."], ["Escribir a ", e, " antes del lunes."], ["Écrire à ", e, " avant lundi."],
            ["Call ", p], ["Call ", p], ["Call back ", p, " (", lambda: [(self.thing(), "")], ")"], ["Mail to ", e], ["Delivery ", a], ["Ask ", n, " (", p, ")"], ["Meeting ", n, " / ", n], ["Site visit ", a], ["Check ", i], ["Form ", i, " for ", n], [self.thing(), " contact ", e], [self.thing(), " contact ", e], [n, " <", e, ">"], ["Delivery to ", a], ["Note from ", n, ": call ", p], ["Позвонить ", n, " по номеру ", p, "."],
        )
        out: list[tuple[str, str]] = []
        for part in made:
            out += [(part, "")] if isinstance(part, str) else part()
        return out

    def note_decoy(self) -> str:
        """Numbers and names in project notes that are no personal data."""
        d, w = self.digits, self.pick("patch", "tuple", "throttle", "parser", "router", "heap", "kernel", "webhook", "cursor", "socket")
        return self.pick(
            f"Pinned {w}@{d(1)}.{d(3)}.0 in the lock file.", f"Mentioned by @{w}{d(1)} in the channel.", f"Mail queue {w} at {self.thing()} dot release {d(1)}.", f"Checksum {d(self.r.randint(9, 12))}, size {d(5)} bytes.",
            f"{self.thing()} Street is the name of dataset {d(3)}.", f"Drive {d(1)} of {self.thing()} failed, lane {d(3)} is fine.", f"Path /srv/{w}/{self.thing()}/{d(5)}.json is missing.", f"Ticket {self.thing()}-{d(6)} is closed.",
            f"See commit {d(10)} for details.", f"IDs {d(8)} to {d(8)} are reserved.", f"Order {d(2)}-{d(3)}-{d(6)} arrived.", f"Version {d(1)}.{d(2)}.{d(3)} of {self.thing()} is out.", f"{self.thing()} approved the change.", f"Ask {self.thing()} whether this still holds.",
            f"{self.thing()} moved to {self.thing()}.", f"({w} {self.thing()} {d(4)}, {self.thing()} {d(5)}, {self.thing()}).", f"Prefers {w} over heap in {self.thing()}, see {self.thing()} {d(5)}.", f"Works on {self.thing()} and {self.thing()} since mirror {d(5)}.",
            f"Invoice no. {self.pick(f'{d(3)}-{d(3)}-{d(3)}', f'{d(2)}-{d(3)}-{d(3)}', f'{d(3)}-{d(2)}-{d(3)}')} covers {self.thing()} storage.", f"Rechnung Nr. {d(3)}-{d(3)}-{d(3)} liegt bei.", f"Build {d(5)}.{d(1)}.{d(3)} passed on port 80{d(1)}.",
            f"The probe at {self.pick('192.0.2', '198.51.100', '203.0.113')}.{d(1)} answered in {d(3)} ms.", f"Measured {d(4)}.555 and {d(4)}.0{d(2)} on {self.thing()}.", f"Window 2024-0{self.r.randint(1, 9)}-1{d(1)} 0{d(1)}:{d(2)} to 0{d(1)}:{d(2)}.",
            f"Version 00.{d(3)}.{d(3)}.{d(3)} replaced {d(1)}.{d(1)}.{d(1)}.",
            f"Meeting about {self.thing()} / {self.thing()}", f"Project {self.thing()}", f"Review the second milestone for {self.thing()}", f"{self.made(2, 3)}{self.pick("gen", "tron", "plex", "link", "core")} {self.pick('Research', 'Foundation', 'Publishing', 'International', 'Systems')} {self.pick('AG', 'Ltd', 'LLC', 'BV')}", f"Invoice {d(4)}-{d(4)} over {d(4)} EUR at 10:{d(2)} on 2024-0{self.r.randint(1, 9)}-1{d(1)}.",
        )

    def carrier(self) -> list[tuple[str, str]]:
        if not self.held and self.r.random() < NOTE_SHARE:
            return self.note_carrier()
        kinds = ["name", "name", "name", "email", "phone", "phone", "id_number", "id_number", "address", "address"]
        x = self.r.random()
        if x < 0.6:
            out = self.framed(self.r.choice(kinds))
        elif x < 0.75:  # several items in a row
            out = []
            sign = self.pick(", ", " / ", " | ", " - ", "; ", " or ", " and ", "\n", ": ", " (")
            for kind in self.r.choices(kinds, k=self.r.randint(2, 3)):
                out += [*self.item(kind), (sign, "")]
            out[-1] = (")" if sign == " (" else "", "")
        elif x < 0.9:  # between ordinary words
            out = [(self.some_words() + self.pick(" ", " ", ": ", ", "), ""), *self.item(self.r.choice(kinds)), (self.pick(" ", " ", ", ", " - ") + self.some_words(), "")]
        else:  # beside a thing
            out = [(self.thing() + self.pick(" ", ": ", " - ", ", "), ""), *self.item(self.r.choice(kinds))]
            if self.r.random() < 0.4:
                out += [(" (" + self.thing() + ")", "")]
        return [*out, (self.pick(".", ".", "", "!", " ...", ";"), "")]

    def thing(self) -> str:
        """The name of something that is no person."""
        m = self.made(2, 3)
        return self.pick(
            m, m, f"{m} {self.r.choice(NOUNS)}", f"{m} {self.r.choice(NOUNS)}", f"{self.r.choice(COMMON)} {self.r.choice(NOUNS)}", f"{m}-{self.digits(2)}", f"{m} {self.r.choice(TRADES)} {self.r.choice(FORMS)}", f"{m} {self.r.choice(TRADES)}",
            f"{self.r.choice(NOUNS)} {m}", f"Project {m}", f"{m}DB", f"lib{m.lower()}", f"{m} {self.digits(1)}.{self.digits(2)}", f"{m} {self.digits(self.r.randint(1, 5))}", f"{m.upper()} {self.digits(self.r.randint(2, 5))}", f"{m} {self.r.choice(NOUNS)} {self.digits(self.r.randint(1, 4))}", m.upper(), f"the {m} {self.pick('team', 'service', 'board', 'plan')}",
        )

    def decoy(self) -> str:
        if not self.held and self.r.random() < NOTE_SHARE:
            return self.note_decoy()
        d, w, t = self.digits, self.r.choice(self.words), self.thing
        number = self.pick(
            f"{d(2)}.{d(1)}.{d(3)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(3)}.{d(1)}.{d(2)}.{d(3)}", f"{d(4)}-0{self.r.randint(1, 9)}-{self.r.randint(10, 28)}", f"{d(2)}:{d(2)} to {d(2)}:{d(2)}", f"{d(self.r.randint(5, 12))}", f"{d(4)}-{d(4)}", f"{d(2)}-{d(3)}-{d(6)}",
            f"{d(3)}-{d(3)}-{d(3)}", f"{d(1)},{d(3)},{d(3)}", f"0x{d(6)}", f"{d(3)}.{d(3)} ms", f"{d(4)}.{d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(8)} and {d(8)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(5)} {d(5)}", f"{d(3)}-{d(2)}-{d(3)}", f"00.{d(3)}.{d(3)}.{d(3)}",
        )
        letters = "".join(self.r.choice("ABCDEFGHKLMNPRSTVXZ") for _ in range(self.r.randint(1, 3)))
        number = self.pick(number, number, number, f"{letters}-{d(self.r.randint(3, 7))}", f"{letters}{d(self.r.randint(2, 5))}", f"{d(self.r.randint(6, 12))}, {w} {d(5)} {w}", f"{d(2)}-{d(3)}-{d(6)}")
        label = self.pick("serial", "run", "batch", "lot", "case", "ref.", "tracking", "article", "model", "asset", "device", "sensor", "window", "probe", "Serie", "numéro de série", "Auftrag", "checksum", "checksum", "serial", "order", "invoice", "invoice no.", "ticket", "commit", "build", "version", "IDs", "port", "size", "hash", "ISBN", "Rechnung Nr.", "between", "measured", "took", "server", "at", "on", "row", "batch", "SKU", "part", "code", "facture", "pedido", "released")
        label = label[:1].upper() + label[1:] if self.r.random() < 0.5 else label
        return self.pick(
            f"{label} {number}", f"{label} {number} {w} {self.some_words(2)}", f"{label} {number} {w}", f"{t()} {label} {number}", f"{w} {number} {w}", f"{w}@{d(1)}.{d(2)}.{d(1)}", f"@{w}{d(1)} {self.some_words()}", f"{w} at {t()} dot release {d(1)}", f"/{w}/{t()}/{d(5)}.json", f"https://{w}.{self.plain(t())}.io/{d(4)}",
            f"{t()} {self.pick('Street', 'Road', 'Lane', 'Avenue', 'Drive')} {self.some_words(2)}", f"{self.pick('Drive', 'Lane', 'Row', 'Place')} {d(1)} {self.some_words(2)}", f"{t()} {self.some_words()}", f"{self.some_words()} {t()}", f"{t()} / {t()}", f"{t()} and {t()}",
            self.unnamed(), self.unnamed(), f"{w} ({t()}, {t()} {d(4)})", f"{d(2)} {self.some_words(2)}", f"{d(3)} {self.r.choice(NOUNS).lower()}s on {t()}", f"git@{w}:{self.plain(t())}", f"{w}: {d(3)} {w} {d(3)}",
        )

    def unnamed(self) -> str:
        """A frame of names around something that is none."""
        return self.r.choice(FRAMES["name"]).replace("{}", self.pick(self.thing(), self.thing(), self.some_words(2), self.made(2, 3)))

    def note(self) -> str:
        note = self.r.choice(self.notes)
        return note.upper() if self.r.random() < 0.06 else note

    def example(self, most: int = 180) -> list[tuple[str, str]]:
        """Parts of one example, about ``most`` characters."""
        parts: list[tuple[str, str]] = []
        gap = self.pick(" ", " ", " ", "\n- ", "  ", " ... ", "\n")
        for what in self.r.choices("cdn", weights=(5, 4, 4), k=self.r.randint(1, 4)):
            parts += self.carrier() if what == "c" else [(self.decoy() + self.pick("", "."), "")] if what == "d" else [(self.note(), "")]
            parts.append((gap, ""))
        if self.r.random() < 0.5:
            parts.pop()
        if self.r.random() < 0.2:
            parts.insert(0, (self.pick("> ", "- ", "**Note** ", "* ", "1. "), ""))
        out, size = [], 0
        for text, kind in parts:
            if size + len(text) > most and not kind:
                text = text[: max(0, most - size)]
            if size + len(text) > most:
                break
            out.append((text, kind))
            size += len(text)
        return [(t, k) for t, k in out if t] or [("note", "")]
