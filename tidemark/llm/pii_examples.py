"""Labelled examples for personal data that the base patterns miss, and for what only looks like it.

Each example is a line of invented words around one span; the kind is None where the span is
nothing personal. Everything is drawn by rules from a seed.
"""

from __future__ import annotations

import random

#: Words before a span that speak for a kind, and words that speak against any.
CUES = {
    "email": ("email", "e-mail", "mail", "write to", "contact", "correo", "courriel", "schreiben an", "adresse", "reach me"),
    "ip": ("ip", "host", "address", "server", "client", "addr", "login from", "serveur", "servidor", "adresse"),
    "card": ("card", "visa", "mastercard", "credit card", "karte", "carte", "tarjeta", "cc", "card number", "kartennummer"),
    "phone": ("phone", "tel", "tel.", "call", "fax", "mobile", "cell", "call me at", "telefon", "téléphone", "teléfono", "móvil", "handy", "whatsapp", "text me on"),
}
AGAINST = ("order", "invoice", "version", "isbn", "part no.", "ref", "id", "page", "since", "item", "ticket", "serial", "rechnung", "factura", "facture", "total", "score", "build", "sku", "at", "token =", "in")
ENDINGS = ("com", "org", "net", "de", "fr", "es", "edu", "io", "co.uk", "info")
PLAIN_WORDS = ("the", "and", "then", "we", "saw", "that", "noon", "station", "work", "house", "und", "der", "haus", "la", "casa", "les", "jours", "look", "point", "product", "line", "early")


def _luhn_sum(digits: str) -> int:
    return sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(reversed(digits)))


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        r = self.r
        return r.choice(PLAIN_WORDS) if r.random() < 0.4 else "".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))

    def words(self, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(0, most)))

    def card(self, valid: bool) -> str:
        body = self.r.choice("3456") + self.digits(14)
        check = (10 - _luhn_sum(body + "0") % 10) % 10
        return body + str(check if valid else (check + self.r.randint(1, 9)) % 10)

    def groups(self, *sizes: int, by: str = "-") -> str:
        return by.join(self.digits(n) for n in sizes)

    # ---- spans: (text, whether its form alone tells) ---------------------------------------
    def email(self) -> tuple[str, bool]:
        r = self.r
        user, host, end = self.word() + r.choice(["", ".", "_"]) + self.word(), self.word() + self.word(), r.choice(ENDINGS)
        at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "."), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", "."), ("@", " dot "), ("@ ", "."), (" AT ", " DOT "), ("<at>", "."), ("{at}", "{dot}")])
        return user + at + host + dot + end.replace(".", dot), True

    def ip(self) -> tuple[str, bool]:
        r = self.r
        if r.random() < 0.5:
            dot = r.choice(["[.]", "(.)", " [.] "])
            return dot.join(str(r.randint(0, 255)) for _ in range(4)), True
        groups = [f"{r.randint(0, 65535):x}" for _ in range(8)]
        if r.random() < 0.5:
            cut = r.randint(1, 6)
            return ":".join(groups[:cut]) + "::" + ":".join(groups[cut + 1 :][: r.randint(1, 6)]), True
        return ":".join(groups), True

    def phone(self) -> tuple[str, bool]:
        r = self.r
        form = r.randint(0, 9)
        if form == 0:
            return f"({self.digits(3)}) {self.digits(3)}-{self.digits(4)}", True
        if form == 1:
            return f"({self.digits(3)}) {self.digits(3)} {self.digits(4)}", True
        if form == 2:
            return "00" + r.choice("1345") + self.digits(1) + " " + self.groups(3, 3, 4, by=" "), True
        if form == 3:
            return "1-800-" + self.groups(3, 4), True
        return [
            self.groups(3, 3, 4), self.groups(3, 3, 4, by="."), self.groups(3, 3, 4, by=" "), "0" + self.groups(2, 8, by=" "), "0" + self.groups(3, 6, by="/"), "0" + self.digits(9),
        ][form - 4], False

    def card_span(self) -> tuple[str, bool]:
        c, by = self.card(True), self.r.choice([".", "/", "  ", "–", " ", ". "])
        return by.join((c[:4], c[4:8], c[8:12], c[12:])), True

    def nothing(self) -> str:
        """What has no kind whatever stands before it."""
        r = self.r
        year, month, day = str(r.randint(1900, 2035)), f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}"
        forms = [
            lambda: self.digits(r.randint(7, 20)).replace("0", "7", 1), lambda: self.card(False), lambda: " ".join(textwise(self.card(False))), lambda: f"{year}-{month}-{day}", lambda: f"{day}/{month}/{year}",
            lambda: f"{day}.{month}.{year} {r.randint(10, 23)}", lambda: f"{year}-{month}-{day} {day}", lambda: f"{r.randint(1, 99)}.{self.digits(5)} {r.randint(1, 99)}.{self.digits(5)}", lambda: f"{r.randint(1, 9)} {self.digits(3)} {self.digits(3)}",
            lambda: "978-" + self.groups(1, 2, 6, 1), lambda: year + "-" + self.digits(6), lambda: year + "-" + str(int(year) + 5), lambda: " ".join(str(r.randint(1, 99)) for _ in range(r.randint(7, 12))),
            lambda: f"{r.randint(0, 23):02}:{month}:{day}", lambda: ":".join(f"{r.randint(0, 255):02x}" for _ in range(6)), lambda: f"{self.word()} at {self.word()}.{self.word()}", lambda: f"{self.word()} at {self.word()} dot {self.word()}",
            lambda: f"{self.word()} @ {r.randint(2, 90)}.{self.digits(2)}", lambda: ".".join(textwise(self.card(False))), lambda: f"{r.randint(1, 20)}.{r.randint(0, 50)}.{self.digits(6)}", lambda: self.digits(3) + "." + self.digits(3) + "." + self.digits(3) + " " + self.digits(2),
            lambda: f"ab::{self.word()}", lambda: "::".join((self.word()[:2], "add")),
        ]
        return r.choice(forms)()

    def example(self) -> dict:
        r = self.r
        kind = r.choice([None, None, None, "email", "ip", "card", "phone", "phone"])
        cue = against = ""
        if kind is None:
            span = self.nothing()
            if r.random() < 0.4:
                against = r.choice(AGAINST) + r.choice([" ", ": ", " #"])
            elif r.random() < 0.1:
                cue = r.choice(CUES[r.choice(list(CUES))]) + r.choice([" ", ": "])
        else:
            span, tells = {"email": self.email, "ip": self.ip, "card": self.card_span, "phone": self.phone}[kind]()
            chance = r.random()
            if chance < 0.6:
                cue = r.choice(CUES[kind]) + r.choice([" ", ": ", " = "])
            elif not tells:  # a bare number, or one that is called something else
                kind, against = None, r.choice([r.choice(AGAINST) + " ", ""])
        if r.random() < 0.3:
            cue, against = cue.capitalize(), against.capitalize()
        before = self.words(6)
        before = (before + r.choice([" ", ". ", ", ", "\n"]) if before else "") + cue + against
        after = r.choice(["", ".", ",", " ", "\n", ") ", "; "])
        after = after + (" " if after[-1:] not in (" ", "\n", "") else "") + (self.words(6) if after else "")
        return {"text": before + span + after, "kind": kind, "start": len(before), "end": len(before) + len(span)}


def textwise(card: str) -> tuple[str, ...]:
    """A number in groups of four."""
    return tuple(card[i : i + 4] for i in range(0, len(card), 4))


def examples(n: int = 3000, seed: int = 13) -> list[dict]:
    """``text``, ``kind`` (None: nothing personal), ``start`` and ``end`` of each example."""
    maker = _Maker(seed)
    return [maker.example() for _ in range(n)]
