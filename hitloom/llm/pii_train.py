"""Training of the entity model on invented, labelled mail lines.

``python -m hitloom.llm.pii_train`` writes ``pii_weights.json``. Names, streets
and numbers are made up at random, so the weights can't learn any of them; the
names of a line are in its gazetteer with the probability ``KNOWN``, as names of
a corpus mostly are. The number of lines, ``LINES``, is the bound of the labelled
sample.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter

from .pii import AMBIGUOUS, TYPES, WEIGHTS, Gazetteer, Model, Span, candidates

LINES, EPOCHS, RATE, L2, SEED, KNOWN = 160_000, 10, 0.3, 2e-5, 11, 0.93
#: Features of fewer spans than this get no weight, so that no made-up word or number does.
LEAST_SPANS = 12

ONSETS = "b br c d dr f fr g gr h j k kl l m n p pr r s st t tr v w z sh".split()
VOWELS = "a e i o u ai ei ou ia".split()
CODAS = "n r l s m th nd rt lk x ck".split() + [""] * 6
SUR_ENDS = "sen son berg feld mann stein ova ski ez ard ois ini ton worth by well".split()
AMB_GIVEN = [w for w in sorted(AMBIGUOUS) if w in "may will mark rose grace art joy frank bo june april august hope faith dawn bill jack rob pat sue bob drew grant chase miles lily ivy iris daisy ruby pearl amber autumn guy gene dean ray jay drake rich max".split()]
AMB_SUR = [w for w in sorted(AMBIGUOUS) if w not in AMB_GIVEN]
MONTHS = "January February March April May May May June August September October May".split()
HEADERS = ("From", "To", "Cc", "Reply-To", "Message-", "In-Reply", "References", "List-", "Received", "Date")
FILLER = ["the adapter table", "our second plot", "lane 3", "sample S08", "gene Kx04g0012345", "the spring batch", "run 240511_AB12", "batch 471", "the freezer", "the whole index", "those reads"]


class Maker:
    def __init__(self, seed: int, strangers: bool = True):
        self.r, self.strangers = random.Random(seed), strangers
        # Names that are also words are names of someone in any corpus.
        self.words: dict[str, str] = dict.fromkeys(AMB_GIVEN, "g") | dict.fromkeys(AMB_SUR, "s")
        self.known = KNOWN

    def pick(self, *xs):
        return self.r.choice(xs)

    def word(self, n: int = 2) -> str:
        return "".join(self.r.choice(ONSETS) + self.r.choice(VOWELS) + self.r.choice(CODAS) for _ in range(n))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def know(self, word: str, flag: str) -> None:
        if self.r.random() < self.known:
            have = self.words.get(word.lower(), "")
            self.words[word.lower()] = "".join(sorted(set(have + flag)))

    def given(self) -> str:
        g = (self.r.choice(AMB_GIVEN) if self.r.random() < 0.3 else self.word(self.pick(1, 2, 2))).capitalize()
        self.know(g, "g")
        return g

    def surname(self) -> str:
        if self.r.random() < 0.12:
            base = self.r.choice(AMB_SUR).capitalize()
        else:
            base = (self.word(self.pick(1, 2)) + self.pick(*SUR_ENDS)).capitalize()
        x = self.r.random()
        if x < 0.03:
            base = "O'" + base
        self.know(base, "s")
        if x > 0.95:
            base = self.pick("van ", "de la ", "von ", "Mac ", "di ", "van der ") + base
        return base

    def stranger(self) -> str:
        """A full name of which no header shows anything."""
        self.known = 0.0
        out = f"{self.word(self.pick(2, 2, 3)).capitalize()} {self.pick('', '', '', self.pick(*'ABCDEFGHKLMRSTW') + '. ')}{(self.word(self.pick(1, 2)) + self.pick(*SUR_ENDS)).capitalize()}"
        self.known = KNOWN
        return out

    def name(self) -> str:
        g, s, x = self.given(), self.surname(), self.r.random()
        if x < 0.5:
            return f"{g} {s}"
        if x < 0.58:
            return g
        if x < 0.64:
            return s
        if x < 0.72:
            return f"{s}, {g}"
        if x < 0.80:
            return f"{g} {s.upper()}"
        if x < 0.90:
            return f"{g} {self.pick(*'ABCDEFGHKLMRSTW')}. {s}"
        return f"{g[0]}. {s}"

    def host(self) -> str:
        return self.pick("", "", "mail.", "lab-") + self.word() + "." + self.pick("example", "test", "org", "net", "co.example", "example.net", "invalid")

    def email(self) -> str:
        local = self.pick(f"{self.word()}.{self.word()}", self.word(3), f"{self.word()}{self.digits(2)}", f"{self.word()}+{self.word(1)}", f"{self.word()}_{self.word(1)}")
        h, x = self.host(), self.r.random()
        if x < 0.6:
            out = f"{local}@{h}"
            return out.upper() if self.r.random() < 0.1 else out
        if x < 0.75:
            return f"{local} (at) {h}"
        if x < 0.78:
            return f"{self.pick(self.word(), f'{self.word()} dot {self.word()}')} at {h.replace('.', ' dot ')}" if "." in h else f"{local} (at) {h}"
        if x < 0.87:
            return f"{local} [at] {h.replace('.', ' [dot] ')}"
        return f"{local} AT {h.replace('.', ' DOT ')}"

    def phone(self) -> str:
        d = self.digits
        sep = self.pick("-", ".", " ")
        forms = [
            f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1{d(10)}", f"+{d(2)}{d(self.pick(9, 10))}", f"+{d(2)} ({d(2)}) {d(5)} {d(3)}",
            f"00{d(2)}-{d(2)}-{d(5)}-{d(3)}", f"0{d(2)}/{d(self.pick(7, 8))}", f"0{d(3)} {d(6)}", f"+44 {d(4)} {d(6)}", f"0{d(2)} {d(4)} {d(4)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"0{d(1)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"+49 {d(3)} {d(7)}", f"+{d(2)} {d(2)} {d(3)} {d(4)}",
        ]
        return self.pick(*forms)

    def id_number(self) -> str:
        d, u = self.digits, lambda n: "".join(self.r.choice("ABCDEFGHKLMPRSTXZ") for _ in range(n))
        return self.pick(f"{d(3)}-{d(2)}-{d(4)}", f"{d(6)}-{d(4)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{u(2)} {d(2)} {d(2)} {d(2)} {u(1)}", f"{u(1)}{d(7)}", f"{u(1)}{d(2)}{u(1)}{d(5)}", f"{u(2)}{d(7)}", f"{d(11)}", f"{d(8)}")

    def street(self) -> str:
        x, n = self.r.random(), str(self.r.randrange(1, 2500))
        w = lambda: self.word().capitalize()
        if x < 0.5:
            stem = self.pick(w(), w(), f"St. {w()}", f"Old {w()}", f"{w()} {w()}", self.pick("Ninth", "Park", "Mill", "Station"))
            return f"{n}{self.pick('', '', '', 'b')} {stem} {self.pick('Street', 'Road', 'Lane', 'Avenue', 'Terrace', 'Court', 'St', 'Rd', 'Ave', 'Blvd', 'Drive')}"
        n = str(self.r.randrange(1, 200))
        if x < 0.68:
            return f"{self.pick(w() + self.pick('straße', 'weg', 'gasse', 'platz', 'str.', 'ring', 'allee', 'straat', 'laan', 'gatan', 'vägen'), 'Am ' + w(), 'An der ' + w())} {n}{self.pick('', '', 'a', 'b')}"
        if x < 0.76:
            via = self.pick("Via", "Viale", "Piazza", "Corso", "Rua", "Travessa", "Praça", "ul.", "ulica") + " " + self.pick("", "", "das ", "della ", "do ", "dei ") + w() + self.pick("", "", f" {w()}")
            return self.pick(f"{via} {n}", f"{via}, {n}", f"{n} {via}")
        if x < 0.88:
            return f"{n}{self.pick('', '', ' bis', ' ter')}{self.pick('', ',')} {self.pick('rue', 'bd', 'avenue', 'chemin', 'place', 'quai')} {self.pick('du ', 'des ', 'de la ', '')}{w()}"
        return f"{self.pick('Calle', 'Avda.', 'Plaza', 'Paseo')} {self.pick('del ', 'de la ', '')}{w()}{self.pick(' nº ', ', ', ' ')}{n}"

    def town(self) -> str:
        return self.word().capitalize() + self.pick("field", "haven", "wald", "stra", "mouth")

    def line(self) -> list[tuple[str, str]]:
        """Pieces ``(text, type)``; an empty type is plain text."""
        p, r = self.pick, self.r
        nm, ph, em, idn, ad = (lambda: (self.name(), "name")), (lambda: (self.phone(), "phone")), (lambda: (self.email(), "email")), (lambda: (self.id_number(), "id_number")), (lambda: (self.street(), "address"))
        amb = r.choice(AMB_GIVEN).capitalize()
        f, d = r.choice(FILLER), self.digits
        full = lambda: (f"{self.given()} {self.surname()}", "name")
        one = lambda: (self.given(), "name")
        sur = lambda: (self.surname(), "name")
        kinds = [
            lambda: [(p("Dear ", "Hi ", "Hello ", "Hallo ", "Bonjour ", "Hola ", "Liebe/r ", "Cher/Chère ", "Estimado/a ", "Guten Tag ", ""), ""), one(), (p(",", ",", ":", " -", "!"), "")],
            lambda: [(p("\n\n", "\n", "\n\n> "), ""), one(), (p(",\n", ",\n\n", ":\n", " -\n\n"), "")],
            lambda: [(p("Dear ", "Hello ", "Sehr geehrte/r "), ""), (p("Dr. ", "Prof. ", "Mr. ", "Mrs ", "Frau ", "Herr ", "Mme ", "Sr. "), ""), sur(), (",", "")],
            lambda: [(p("Thanks\n", "Best,\n", "Cheers\n", "Kind regards,\n", "MfG\n", "Cordialement,\n", "Gracias\n", "Un saludo,\n", "Viele Grüße\n"), ""), p(one, full)(), ("\n", "")],
            lambda: [(p("Ask ", "Please ask ", "Talk to ", "Check with ", "Bitte mit ", "Voyez avec ", "Pregúntale a ", "Fragen Sie "), ""), p(nm, nm, one)(), (p(" about it.", " first.", ".", " klären.", " please."), "")],
            lambda: [("", ""), p(nm, nm, one)(), (p(" will take over after lunch.", " will take over tonight.", " is away.", " übernimmt das.", " s'en occupe.", " se encarga.", " said so.", " has the key.", " knows more."), "")],
            lambda: [(f"{f} is late. ", ""), p(nm, nm, one)(), (p(" will take over today.", " will do it.", " übernimmt das.", " s'en occupe.", " se encarga.", " wrote that."), "")],
            lambda: [(p("According to ", "As told by ", "Laut ", "Selon ", "Según "), ""), p(nm, nm, one)(), (p(" this is normal.", " all is fine.", ", yes.", " nothing changed."), "")],
            lambda: [(p("Dr. ", "Prof. ", "Dr. "), ""), sur(), (p(" signed the form.", " was there.", " agreed."), "")],
            lambda: [(f"On Sun, {d(1)} Jan 2031 15:36:57 +0{d(1)}00, ", ""), full(), (" <", ""), em(), (p("> wrote:", "> a écrit :", "> schrieb:"), "")],
            lambda: [(p("From: ", "To: ", "Cc: ", "Reply-To: "), ""), full(), (" <", ""), em(), (">", "")],
            lambda: [(p("From: ", "To: ", "Cc: "), ""), em(), (" (", ""), full(), (")", "")],
            lambda: [(p("From: ", "To: ", "Cc: ") + '"', ""), (f"{self.surname()}, {self.given()}", "name"), ('" <', ""), em(), (">", "")],
            lambda: [(p("From: ", "To: "), ""), full(), (p("\n", "\nSubject: about it\n", " [mailto:"), ""), em(), ("]", "")],
            lambda: [(p("From: ", "To: ", "To: ", "Cc: "), ""), em(), ("", "")],
            lambda: [(p("Write to ", "Cc ", "The form goes to ", "Escribe a ", "Écrivez à ", "Schreiben Sie an ", "contact "), ""), em(), (p(".", " instead.", " next time.", " (not to the list).", ", please."), "")],
            lambda: [("List-Post: <mailto:", ""), em(), (">", "")],
            lambda: [("", ""), em(), ("\n", "")],
            lambda: [(p("Message-ID: ", "In-Reply-To: ", "References: ", "Message-Id: ") + f"<{''.join(r.choice('0123456789abcdef') for _ in range(11))}.{d(p(2, 3, 4))}@{self.host()}>", "")],
            lambda: [(f"References: <{''.join(r.choice('0123456789abcdef') for _ in range(11))}.{d(2)}@{self.host()}>\n <{''.join(r.choice('0123456789abcdef') for _ in range(10))}.{d(3)}@{self.host()}>", "")],
            lambda: [(p("Call me on ", "My direct line is ", "or ring ", "Tel. ", "Tel: ", "Phone: ", "M: ", "T ", "phone ", "Appelez-moi au ", "Mi teléfono es ", "Tél. : ", "Durchwahl: ", "Telefonisch unter ", "Llámame al ", "Mobile ", "Fax "), ""), ph(), (p(".", ", best after ten.", " and ask for the lab.", "\n", " today."), "")],
            lambda: [(p("\n", "and ", f"{f} or "), ""), ph(), ("\n", "")],
            lambda: [(p("Payroll has ", "For the list: ", "They asked again for my ", "Ausweis: ", "Documento: ", "badge : ", "see "), ""), (p("SSN ", "SSN: ", "social security number ", "tax id ", "passport no. ", "passport ", "Passport: ", "personal no. ", "identity number ", "ID card ", "identity card no ", "NI number ", "national insurance ", "DNI ", "Steuer-ID "), ""), idn(), (p(" on file.", ".", ", please.", "\n"), "")],
            lambda: [(p("Ship it to ", "I have moved to ", "The parcel waits at ", "Lieferung bitte an ", "Livraison au ", "Envíalo a ", "visit us at ", "The lab is at ", ""), ""), ad(), (p(f", {self.town()}.", ".", f", {self.town()}", "\n", f"\n{self.town()}"), "")],
            lambda: [(f"{self.town()} is far. ", ""), ad(), (f", {self.town()}", "")],
            # No entities.
            lambda: [(f"{amb} {p('somebody', 'anyone', 'you', 'they', 'we', 'it', 'the', 'someone', 'people')} {p('mark', 'check', 'call')} {f} {p('today', 'soon')}?", "")] if amb in ("Will", "May") else [(f"{amb} {p('by', 'period', 'the', 'of', 'from', 'to', 'is', 'for', 'and', 'in', 'up', 'with', 'at', 'a', 'time', 'your', 'this')} {p('4', 'the', 'all', '84 percent', 'invoice')} ends.", "")],
            lambda: [(p(f"It is ready {p('before', 'after', 'in', 'by', 'until', 'since', 'this', 'last', 'next', 'early', 'late', 'during')} {r.choice(MONTHS)}{p('?', '.', ',', ' then')}", f"{d(1)} {r.choice(MONTHS)} 2031", f"{r.choice(MONTHS)} {d(1)}, 2031"), "")],
            lambda: [(f"{f} is late. {p('Rose', 'Grace', 'Will', 'Mark', 'Frank', 'Art', 'Joy', 'Hope', 'Stone', 'Winter', 'Field', 'Reed', 'Grant', 'Bill', 'May')} {p('by', 'period', 'somebody', 'the', 'of', 'we', 'work', 'samples', 'for', 'notes', 'words', 'it', 'you', 'valves', 'walls', 'from')} {p('84 percent', 'ends', 'it', 'again', 'since', 'all', 'this')}.", "")],
            lambda: [(f"{p('Parcel', 'Tracking', 'Paket', 'Colis')} {d(4)} {d(4)} {d(4)} with {f} is on its way.", "")],
            lambda: [(f"{p('Catalogue no.', 'Article', 'Part no.', 'Item', 'Cat. no.')} {d(2)}-{d(2)}-{d(4)} replaces K{d(1)}.{d(3)}.{d(2)}.", "")],
            lambda: [(f"{p('Invoice', 'Order', 'Rechnung', 'La facture', 'factura')} {p('INV-', 'PO-', 'RE-', '')}{d(p(5, 7, 8))} covers {f}.", "")],
            lambda: [(f"{p('The server at', 'host', 'Der Rechner', 'Le serveur', 'El servidor')} {p('192', '10', '203')}.{p('0', '168')}.{d(1)}.{d(p(1, 2, 3))} is down.", "")],
            lambda: [(f"Coordinates {d(4)}:{d(4)}:{d(4)} look odd in {f}.", "")],
            lambda: [(f"Version {d(1)}.{d(1)}.{d(2)} reads {f} about {d(2)} percent faster; there were {d(5)} records, {d(2)} of them new.", "")],
            lambda: [(f"Received: from relay1.{self.host()} ([192.0.2.{d(2)}]) by mx.{self.host()} with ESMTP id {d(1)}a{d(7)}; {d(10)}", "")],
            lambda: [(f"Received: from relay1.{self.host()} by mx.{self.host()} with ESMTP id {d(9)}; Wed, 8 Oct 2031 04:10:{d(2)} +0000", "")],
            lambda: [(f"Date: {p('Sat, 10 Jan 2032 09:38:35 +0000', '2031-05-12 10:11:12', '12.05.2031', '7/3/2031 0:30 PM', d(10))}", "")],
            lambda: [(f"{p('Lane', 'Tile', 'Batch', 'Sample', 'Room', 'Ticket', 'Case', 'Build', 'Serial')} {d(p(1, 3, 7, 8, 10))} {p('came back', 'is fine', 'failed')}; {f} did not.", "")],
            lambda: [(f"The {p('old', 'long')} {p('stone', 'reed', 'field', 'winter', 'river', 'rose')} {p('basement', 'valve', 'trip')} froze. See {d(4)} {d(2)} {d(4)} {d(2)}.", "")],
            lambda: [(f"We used {d(2)} {p('Small', 'Large', 'New')} {p('Tubes', 'Racks', 'Boxes')} and {d(1)} {p('Lane', 'Park', 'Court')} maps; {d(3)} Reads.", "")],
        ]
        # Full names of which no header shows anything, and pairs of capitalised words that are none.
        strangers = [
            lambda: [(p("Dr. ", "Prof. ", "Mr. ", "Ms. ", "Mrs ", "Frau ", "Herr "), ""), (self.stranger(), "name"), (p(" signed the form.", " was there.", ",", " agreed.", " will call."), "")],
            lambda: [(p("Dear ", "Hi ", "Hello ", "Hallo ", "Bonjour ", "Hola ", "Ask ", "Please ask ", "Talk to ", "Check with ", "Voyez avec ", "According to ", "As told by ", "Laut ", "Selon ", "Según ", "I met ", "from ", "signed by ", "with "), ""), (self.stranger(), "name"), (p(",", ".", " about it.", " first.", " yesterday.", ":", " and the others."), "")],
            lambda: [("It came late. ", ""), (self.stranger(), "name"), (p(" will take over today.", " said so.", " wrote that.", " has the key.", " wrote:", " übernimmt das.", " s'en occupe."), "")],
            lambda: [(f"{p('Quality', 'Project', 'Customer', 'Freezer', 'Library', 'Data', 'Final', 'Annual')} {p('Control', 'Report', 'Service', 'Plan', 'Review', 'Access', 'Board')} {p('is', 'was', 'has', 'will')} {f}.", "")],
            lambda: [(p("Ask ", "See ", "From ", "with ", "for ", "by ", "at ", "about ", "of ", "in ") + f"{p('Customer', 'Technical', 'Quality', 'Human', 'Central', 'North', 'Upper')} {p('Service', 'Support', 'Control', 'Resources', 'Library', 'Station', 'Campus')}{p('.', ',', ' today.', ' soon.')}", "")],
            lambda: [(p("Viele Grüße", "Beste Grüße", "Best Wishes", "Kind Regards", "Many Thanks", "Mit Freundlichen Grüßen", "Yours Sincerely", "Un Saludo") + p("\n", ",\n"), "")],
            lambda: [(f"{p('Hier', 'Dort', 'Heute', 'Leider', 'Schreiben', 'Fragen', 'Prüfen')} {p('Sie', 'Proben', 'Daten', 'Rechner', 'Ergebnisse')} {p('an', 'bitte', 'mit', 'sind', 'fehlen')} {f}.", "")],
            lambda: [(p("in ", "near ", "to ", "from ", "") + f"{p('New', 'Santa', 'San', 'Upper', 'East', self.word().capitalize())} {self.town()}{p('.', ',', ' today.')}", "")],
        ]
        return r.choice(kinds + strangers if self.strangers else kinds)()


def labelled(lines: int, seed: int, strangers: bool = True) -> list[tuple[str, list[tuple[int, int, str]], dict[str, str]]]:
    """``(text, entities, words of the gazetteer)`` of every line, each with a line before and after it."""
    out = []
    for k in range(lines):
        m = Maker(seed * 1_000_003 + k, strangers)
        text, gold = m.pick("", "\n", "All well.\n", "> ", "It works today. "), []
        mark = m.pick("", "", "> ", "| ", "AB> ", ">")
        for piece, kind in m.line():
            if kind:
                gold.append((len(text), len(text) + len(piece), kind))
            elif m.r.random() < 0.3 and (blanks := [i for i, c in enumerate(piece) if c == " " and (i > 12 or len(text) - text.rfind("\n") > 12)]) and not piece.startswith(HEADERS):
                # Mail is wrapped: a blank outside an entity becomes a line break, perhaps with a reply mark.
                at = m.r.choice(blanks)
                piece = piece[:at] + m.pick("\n", "\n", "\r\n") + mark + piece[at + 1 :]
            text += piece
        text += m.pick("", "\n", "\nMore below.", " See you.")
        out.append((text, gold, m.words))
    return out


def _add(a: float, b: float) -> float:
    return b if a == -math.inf else a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(spans: list[Span], scores: list[float]) -> list[float]:
    """Probability of every span under the model: sums over all segmentations, forward and backward."""
    points = sorted({x for s, e, _, _ in spans for x in (s, e)})
    at = {x: i for i, x in enumerate(points)}
    n = len(points)
    into: list[list[int]] = [[] for _ in range(n)]
    out_of: list[list[int]] = [[] for _ in range(n)]
    for k, (s, e, _, _) in enumerate(spans):
        into[at[e]].append(k)
        out_of[at[s]].append(k)
    forward, backward = [0.0] * n, [0.0] * n
    for i in range(n):
        total = forward[i - 1] if i else 0.0
        for k in into[i]:
            total = _add(total, forward[at[spans[k][0]]] + scores[k])
        forward[i] = total
    for i in range(n - 1, -1, -1):
        total = backward[i + 1] if i + 1 < n else 0.0
        for k in out_of[i]:
            total = _add(total, backward[at[spans[k][1]]] + scores[k])
        backward[i] = total
    z = forward[-1] if n else 0.0
    return [math.exp(min(0.0, forward[at[s]] + scores[k] + backward[at[e]] - z)) for k, (s, e, _, _) in enumerate(spans)]


def train(lines: int = LINES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, dict[str, float]]:
    """Weights of greatest penalised conditional likelihood, by stochastic gradient with steps that shrink per feature."""
    data = []
    for text, gold, words in labelled(lines, seed):
        spans = candidates(text, Gazetteer(words=words))
        want = set(gold)
        if spans:
            data.append((spans, [float((s, e, k) in want) for s, e, k, _ in spans]))
    met = Counter((k, x) for spans, _ in data for _, _, k, f in spans for x in f)
    data = [([(s, e, k, [x for x in f if met[k, x] >= LEAST_SPANS]) for s, e, k, f in spans], is_gold) for spans, is_gold in data]
    weights: dict[str, dict[str, float]] = {k: {} for k in TYPES}
    squares: dict[str, dict[str, float]] = {k: {} for k in TYPES}
    mean: dict[str, dict[str, float]] = {k: {} for k in TYPES}
    r = random.Random(seed)
    for epoch in range(epochs):
        r.shuffle(data)
        for spans, is_gold in data:
            scores = [sum(weights[k].get(x, 0.0) for x in f) for _, _, k, f in spans]
            for p, y, (_, _, k, f) in zip(marginals(spans, scores), is_gold, spans):
                if abs(y - p) < 1e-4:
                    continue
                w, q = weights[k], squares[k]
                for x in f:
                    g = y - p - L2 * w.get(x, 0.0)
                    q[x] = q.get(x, 0.0) + g * g
                    w[x] = w.get(x, 0.0) + RATE * g / (1.0 + math.sqrt(q[x]))
        if epoch >= epochs // 2:  # the result is the mean over the later epochs
            for k, w in weights.items():
                for x, v in w.items():
                    mean[k][x] = mean[k].get(x, 0.0) + v / (epochs - epochs // 2)
    return {k: {x: round(v, 3) for x, v in sorted(w.items()) if abs(v) >= 0.02} for k, w in mean.items()}


def accuracy(weights: dict[str, dict[str, float]], lines: int, seed: int, strangers: bool = True) -> dict[str, tuple[int, int, int]]:
    """``(right, found, true)`` by type over freshly made lines."""
    model, out = Model(weights), {}
    for text, gold, words in labelled(lines, seed, strangers):
        got = {(s, e, k) for s, e, k, _ in model.best(candidates(text, Gazetteer(words=words)))}
        for kind in {k for *_, k in got} | {k for *_, k in gold}:
            g, t = {x for x in got if x[2] == kind}, {x for x in gold if x[2] == kind}
            a, b, c = out.get(kind, (0, 0, 0))
            out[kind] = a + len(g & t), b + len(g), c + len(t)
    return out


if __name__ == "__main__":
    found = train()
    WEIGHTS.write_text(json.dumps(found, ensure_ascii=False, indent=0, sort_keys=True) + "\n")
    for kind, (right, got, true) in sorted(accuracy(found, 3000, SEED + 1).items()):
        print(f"{kind}: precision {right / max(1, got):.4f}, recall {right / max(1, true):.4f} of {true}")
