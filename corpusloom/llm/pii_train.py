"""Training of the tagger of problem 4, in numpy: ``python -m corpusloom.llm.pii_train PAGES.parquet [STEPS]``.

Labelled spans are composed: items of each type, written by rules, set into carrier sentences and into lines of the given
pages that hold no such item. At most ``BACKGROUND`` lines are read. The result is ``pii_weights.npz`` beside this file.
"""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np

from corpusloom.llm import pii

BACKGROUND = 60_000
BATCH = 64
LENGTH = 128

GIVEN = "Leila Marta Theo Lena José Yusuf Chidi Felix Clara Diego Samir Pavel Miriam Greta Sofia Oskar Hanna Björn Priya Zoë Ruth Tomas Kofi Nadia Emil Anna Renée Victor Aisha Maeve Elif Amara Irina Mateo Jonas Ingrid Hiro Paulo Dario Bruno Peter Maria Ivan Lucía Noah Eva Ahmed Sven".split()
#: Given and family names of many languages, so that names are not known by the rule above alone (fixed values).
MORE_GIVEN = """John Mary James Linda Robert Susan Michael Karen William Emma Olivia Henry Alice George Grace Arthur Chloe Daniel Megan April June Thomas Sarah Charles Nancy Mark Julia Paul Laura Simon Rachel Kevin Amy Brian Joan
Hans Karl Jürgen Ute Heike Klaus Gisela Dieter Monika Uwe Sabine Stefan Katrin Lukas Johanna Friedrich Helga Jean Pierre Marie Luc Élodie Camille Antoine Céline François Hélène Guillaume Juan Carmen Pedro Rosa María Javier Pilar Andrés Núria Álvaro Inés
Giulia Marco Luca Chiara Matteo Lorenzo Wei Ming Li Xiu Jun Yan Mei Hiroshi Yuki Kenji Aiko Min Ji Seo Raj Anil Sunita Deepa Arjun Lakshmi Olga Boris Svetlana Dmitri Łukasz Agnieszka Piotr Katarzyna Jiří Šárka Zoltán Ágnes Ömer Şirin Çağla Fatima Omar Hassan Layla Khalid
Kwame Ama Ngozi Tunde Zanele Thabo Lars Astrid Nils Freja Øystein Åse Mikko Aino Siobhán Niamh Rhys Bronwen Ana João Inês Rui Thanh Linh Nguyet Mehmet Ayşe""".split()
FAMILY = """Smith Jones Brown Taylor Wilson Evans Walker White Green Hall Wood Harris Clark Cooper King Baker Hill Moore Young Scott Stone Carter Bell Price Foster Murphy O'Brien O'Neill McDonald MacLeod Fitzgerald Kowalski Nowak Wiśniewski Łukaszewski Novák Dvořák Šimek Horváth Szabó Nagy
Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Koch Bauer Richter Wolf Neumann Schwarz Zimmermann Krüger Hartmann Lange Vogel Dubois Martin Bernard Petit Moreau Laurent Lefèvre Garnier Rousseau Chevalier García López Martínez Sánchez Pérez Gómez Fernández Ruiz Díaz Moreno Muñoz Álvarez Romero Torre Vega Castillo
Rossi Russo Ferrari Bianchi Esposito Ricci Zhang Wang Chen Liu Yang Huang Zhao Tanaka Suzuki Sato Yamamoto Nakamura Kim Park Choi Singh Patel Sharma Gupta Iyer Ivanov Petrova Smirnov Kuznetsova Popov Hansen Nielsen Johansen Larsen Bergström Lindqvist Virtanen Korhonen Silva Santos Oliveira Costa Nguyen Tran Yılmaz Kaya Demir Şahin Öztürk Haddad Mansour Rahman Okafor Adeyemi Mensah Dlamini""".split()
STEMS = "Brask Dors Fenn Gral Harv Hest Krev Lint Mund Norr Oster Penn Quell Sall Tarn Tolm Vask Velm Wess Zand Berg Cald Mor Hal".split()
ENDS = "aire ane asse berg ero esh etti ington ley lley man onda ovic ow ström uil er sson ez".split()
STREETS = "Street Road Lane Terrace Close Way Crescent Row Court Avenue Ave. St Rd. Drive".split()
TOWNS = ["Velmoor", "Sallow Hill", "Mirefield", "Vastry", "Harrow Bay", "Kelvindale", "Port Linnet", "Tarnwick", "Quenby", "Upper Dorsley", "Brackenholt", "Ostermere", "Newhaven", "East Marlow"]
GERMAN_TOWNS = ["Bad Fennau", "Wesselbruch", "Kaldenroth", "Ostermühl", "Quarnstedt", "Hohenlim", "Neustadt"]
SPANISH_TOWNS = ["Vallosera", "Torrequena", "Brañuela", "Puerto Lindén", "Alcadiel", "Mirador del Sauce", "Villanueva"]
ROLES = "workshop lead|site manager|first-time visitor|new customer|apprentice|small team|board member|inspector|trainer|designer|neighbour|editor|planner|courier|student".split("|")
NOUNS = "kettle panel lamp ferry module harness sofa filter roast campus".split()
LATER = ", by early evening|, in small quantities|, as soon as the order is confirmed|, while stocks last|".split("|")

CARRIERS = """By {n}|Posted by {n}|Written by {n}|Text: {n}|Von {n}|Verfasst von {n}|Escrito por {n}|Por {n}|Texto: {n}
The visitor gave their name as {n} and left {p} as a contact.|The claim of {n} was filed under {i} and is still open.|For repairs, write to {n} at {e} or call {p} on weekdays.
"The {w} arrived on time," says {n}, who ordered it by early evening.|"Der Schrank kam pünktlich", sagt {n}.|"El jardín llegó a tiempo", dice {n}.|Holder: {n}, {i}.|Checked by {n}, {i}{l}.
Parcels for {n} go to {a}, never to the depot.|Former tenant {n} moved to {a} when the weather turns.|{n} answers questions about the {w} on {p}.|Our {r} {n} can be reached at {p}.|The meeting place is {a}; ask for {n}.
Para reparaciones, escriba a {n} en {e} o llame al {p}.|Für Reparaturen schreiben Sie an {n} unter {e} oder rufen Sie {p} an.|Los paquetes de {n} van a {s}.|La solicitud de {n} consta con {j}.|Der Antrag von {n} liegt unter {k} vor.
Pakete für {n} gehen an {g}.|Pregunte por {n} en el {p}.|Fragen beantwortet {n} unter {p}.|Invoice address: {a}.|Rechnungsanschrift: {g}.|Dirección de cobro: {s}.|Send the signed form to {e}.|Das Formular geht an {e}.|Envíe el formulario a {e}.
Mail {e}.|Lost your {w}? Mail {e}.|Complaints: {e}, {p}.|Reach me under {p} after six, or {e} at any time.|{e} | {p}|Tel. {p}|{b}: {e}|Contact {n} by phone on {p}.|{n}, {a}
A letter from {n} came.|{n} wrote to us in May.|We met {n} and {n} near the station.|Dear {n},|Yours sincerely, {n}|Signed: {n}|Author: {n}|Contact: {n}, {p}|The prize went to {n} of the second team.|Our guests were {n}, {n} and {n}.|Nobody had seen {n} since the last update.|The photo shows {n} in the garden.
Call {p}.|Call {p} or write to {e}.|Fax {p}|Phone: {p}|Mobile {p}, office {p}|Ring us on {p} before noon.|Telefon {p}|Llámenos al {p}.|{n} | {p} | {e}|{n} <{e}>|E-mail: {e}|Write to {e} today.|My number is {p}, ask for {n}.|Her {q} ran out.|Please quote {q} when you call.
{n}, {o}|Visit {n} at {o}.|The shop moved to {o} last year.|Our office: {o}|Send it to {o}.|Address: {o}|{n} lives at {o} with a dog.|Das Büro liegt in der {g}.|La tienda está en {s}.|In a note, {n} thanked the team.|Ein Brief von {n} kam an.|Frau {n} hat angerufen.|Herr {n} ist im Büro.|La carta de {n} llegó ayer.|Señora {n} vive en {s}.
The speaker, {n}, left early.|After the talk {n} asked a question about the {w}.|According to {n}, the {w} is late.|Photo: {n}|Translated by {n} and {n}|as told to {n}|with {n} on drums|{n} ({r})|{n} – {r}|{n} reviewed the {w}.|The team of {n} won.|Mr {n} and Mrs {n} paid."""
CARRIERS += "\n" + "|".join(["By {n}", "Posted by {n}", "Von {n}", "Por {n}", "Escrito por {n}", "Written by {n}"])
CARRIERS = [c for line in CARRIERS.split("\n") for c in re.split(r"(?<! )\|(?! )", line)]
DECOYS = """Order {x}-{x}-{x} was cleaned without a complaint.|Item {x}/{x} was described by the {r}.|Version {x}.{x}.{x} reviews the {w} and leaves the frame alone.|The workshop in {t} stores {x} {w}s.|From {t} to {t} the {w} is sorted by a {r}.
Published {d}|Last updated {d}|Page {x} of {x}|{x} people found this helpful|Prices for the {w} start at {x} credits.|{b} and the weekly {w}|With {b} the {w} is ordered in {x} steps.|{b} reviewed its first {w} in {t}.|Copyright 2024 {b} Group|Home Products About us Sign In
HOME SUPPORT PARTNERS CONTACT|See https://{b}.example/blog/post-{x} for more.|The shelf near {t} Street holds {x} {w}s and one lamp.|A {r} from {t} told us that the {w} works.|Narrow {w}, arranged in {t}|Free {w} check in {t}|XQ-{x} {w} manual|Ref #{x}{x}|Notes on the {w} in {t}
Inicio Precios Prensa Ayuda Tiendas|Ayuda Contacto Galería|Productos Empleo Acceder|Startseite Produkte Presse Kontakt|Stellen Hilfe Preise|War diese Seite hilfreich? Ja Nein|Text size A A A|Sitemap Imprint Accessibility|Aviso legal Política de privacidad
Share: Mail Print Copy link|Teilen: Mail Drucken Link kopieren|Alle Angaben ohne Gewähr|{b} 2025, Alle Rechte vorbehalten|{b} 2026, TODOS LOS DERECHOS RESERVADOS|schnelle Entwurf {x}, klare Weg {x}, einfache Keller {x}|neue Motor {x}, feste Balkon {x}|Veröffentlicht am {d}|Última actualización: {d}
XQ-{x} {w} manual, ZV-{x} {w} spare|Order 3065-8185-62 was stacked twice.|{w} {x}, {w} {x}, {w} {x}|Working with Template Tags|Robust terminals for {t}|Practical {w}s for {t}|Home > Blog > Heavy {w}s for {t}|Toggle navigation|GUÍA DEL MOTOR ESTABLE|El {w} y el panel|Shopping in {t} Market is a joy.|The {b} Office of {t} opens on Monday.|North {t} Station|Terms And Conditions|Frequently Asked Questions|New Product Launch in {t}|United Nations|Der Neue Plan|General Terms of Sale|Machine Learning Basics|Summer Sale Starts Monday|In January the {w} was late.|Monday Morning Report|Save 20% on {w}s, code {x}{x}|Windows {x} and Linux|ISBN and price on request|In {x}:{x} minutes|{x}.{x}.{x}.{x} is a host|{d} to {d}|{x},{x} of {x},{x}|room {x}, floor {x}|{x} x {x} x {x} cm|The {t} Road is closed.|Central Park and Main Street are near.|Adams County|The Green Lantern Hotel|Guests from {t} came back.|Between April and {t} the {w} is sold.|Kleine Balkon mit {x} Teilen|Neues im Juni aus {u}|Novedades de marzo en {v}|La sala de {v} recibe {x} piezas.|Der Preis beginnt bei {x} Talern in {u}."""
DECOYS = [c for line in DECOYS.split("\n") for c in line.split("|")]


class Writer:
    """Items and sentences by rule."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, form: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "9" else self.r.choice("ABCDEFGHKLMNPRSTVWXYZ") if c == "A" else c for c in form)

    def made_up(self) -> str:
        """A word no list holds: syllables of one script."""
        r = self.r
        kind = r.random()
        if kind < 0.8:
            word = "".join(r.choice("b c d f g h j k l m n p r s t v w z br ch dr gr kl kr pl sch sh st th tr".split()) + r.choice("a e i o u a e i o ai ei ou ie ö ü á é í".split()) for _ in range(r.randint(1, 3)))
            return (word + r.choice(["", "n", "r", "s", "l", "ck", "nd", "t", "ss", "x"])).capitalize()
        if kind < 0.9:
            return (r.choice("ŁŠČŽŚŻĐŞİĆŘ") + "".join(r.choice("aeiouyłšžćńřěąę") + r.choice("kmnrstvzl") for _ in range(r.randint(1, 3)))).capitalize()
        low = r.choice(["абвгдежиклмнопрстуя", "αβγδεικλμνοπρσυ"])
        return "".join(r.choice(low) for _ in range(r.randint(3, 8))).capitalize()

    def given(self) -> str:
        x = self.r.random()
        return self.r.choice(GIVEN) if x < 0.45 else self.r.choice(MORE_GIVEN) if x < 0.9 else self.made_up()

    def surname(self) -> str:
        def one() -> str:
            x = self.r.random()
            return self.r.choice(STEMS) + self.r.choice(ENDS) if x < 0.5 else self.r.choice(FAMILY) if x < 0.8 else self.made_up() if x < 0.95 else self.r.choice(STEMS)

        return one() + ("-" + one() if self.r.random() < 0.12 else "")

    def name(self) -> str:
        r = self.r
        given, family, x = self.given(), self.surname(), r.random()
        initial = r.choice("ABCDEFGHIJKLMNOPRSTVW") + "."
        if x < 0.1:
            given += f" {initial}"
        elif x < 0.14:
            given = initial
        elif x < 0.16:
            given = f"{initial} {r.choice('ABCDEHJKLMPRST')}."
        elif x < 0.19:
            given += f"-{self.given()}"
        elif x < 0.22:
            given += f" {self.given()}"
        elif x < 0.30:
            family = r.choice("de|de la|de los|del|van|van der|van den|von|von der|zu|da|dos|di|bin|al|ter|le|la".split("|")) + " " + family
        elif x < 0.34:
            family += " " + r.choice(["", "", "y "]) + self.surname()
        text = f"{family}, {given.split()[0]}" if r.random() < 0.08 and len(given) > 2 else f"{given} {family}"
        return text.upper() if r.random() < 0.1 else text

    def email(self) -> str:
        given, family = (re.sub(r"[^a-z]", "", x.lower()) or "x" for x in (self.given(), self.surname().split("-")[0]))
        user = self.r.choice([f"{given}.{family}", f"{given}_{family}", f"{given[0]}{family}", f"{family}{self.r.randint(1, 99)}", f"{given}-{family[0]}"])
        user += self.r.choice(["", "", "", "+news", "+web"])
        host = "".join(self.r.choice(("ve", "lo", "kri", "mu", "xo", "ten", "pe", "fla", "sol")) for _ in range(3))
        domain = [*self.r.choice([[], [], ["mail"], ["docs"], ["shop"]]), host, self.r.choice(("example", "test", "com", "org"))]
        at, dot = self.r.choice([("@", ".")] * 8 + [(" @ ", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot ")])
        text = user + at + dot.join(domain)
        return text.upper() if self.r.random() < 0.08 else text

    def phone(self) -> str:
        return self.digits(self.r.choice(["+1 555 555 9999", "1-555-555-9999", "(555) 555-9999", "555.555.9999", "555-9999", "+44 7700 900999", "+447700900999", "07700 900 999", "+49 30 23125 999", "030/23125999", "0049 30 23125-999", "+34 699 999 999", "0171 9999999"]
            + ["99 99 99 99 99", "+33 9 99 99 99 99", "+49 99 99 99 99 99", "(999) 9999 9999", "999 9999", "999 999 999", "+1 (999) 999-9999", "+99 99 9999 9999", "09999 999999", "9999 999 999", "0999/99 99 99", "+999 999 999 999", "0999.999.999", "99-9999-9999", "+9 999 999-99-99", "0999-9999999"]))

    def number(self) -> tuple[str, str]:
        if self.r.random() < 0.3:
            label = self.r.choice(["SSN ", "ID no. ", "tax number ", "passport ", "licence no. ", "NIE ", "personal number ", "social insurance number ", "identity number ", "Personalausweis ", "national ID: ", "ID card number "])
            return label, self.r.choice(["999-99-9999", "A9999999A", "99999999A", "AA999999", "999999/9999", "99 999 999 9", "A9AA99999", "9999999999", "999.999.999-99", "99999999-9", "AA 99 99 99 A", "999 999 999"])
        return self.r.choice([("tax ID ", "99/999/99999"), ("social security number ", "999-99-9999"), ("passport no. ", "A99999999"), ("resident ID ", "A-9999999-A"), ("citizen number ", "999999-9999"), ("identity card ", "A999A99A9"), ("national insurance number ", "AA 99 99 99 A")])

    def address(self) -> str:
        street = f"{self.r.choice(STEMS)}{self.r.choice(('', 'wood', 'gate', 'moor', 'field'))} {self.r.choice(STREETS)}"
        town = self.r.choice(TOWNS)
        post = self.digits(self.r.choice(["AA99 9AA", "AA9 9AA"]))
        n = self.r.randint
        return self.r.choice([f"Unit {n(1, 40)}B, {n(1, 99)} {street}, {town}", f"Flat {n(1, 40)}, {n(1, 99)} {street}, {town}, {post}", f"{n(1, 999)} {street}, {town} {n(10000, 99999)}", f"{n(1, 300)}-{n(1, 9)} {street}, {town}, {post}", f"{n(1, 99)} {street}, {town}"])

    def german(self) -> str:
        stem, n = self.r.choice(STEMS), self.r.randint
        street = self.r.choice([f"{stem}straße", f"Am {stem}{self.r.choice(('', 'wood', 'moor'))}", f"{stem}weg", f"{stem}platz"])
        return f"{street} {n(1, 150)}{self.r.choice(['', '', 'a'])}, {n(10000, 99999)} {self.r.choice(GERMAN_TOWNS)}"

    def spanish(self) -> str:
        stem, n = self.r.choice(STEMS) + self.r.choice(("", "field", "wood")), self.r.randint
        town = self.r.choice(SPANISH_TOWNS)
        return self.r.choice([f"Calle {stem} {n(1, 150)}, {n(10000, 99999)} {town}", f"Avenida de {stem}, {n(1, 99)}, {n(1, 9)}.º {self.r.choice('ABCD')}, {town}", f"Calle {stem}, {n(1, 99)}, {town}"])

    def other_address(self) -> str:
        """Addresses of other forms and words than the lists above."""
        r, n = self.r, self.r.randint
        word, town = (self.made_up() if r.random() < 0.5 else r.choice(FAMILY) for _ in range(2))
        town = r.choice(["", "", "", "New ", "Upper ", "Port ", "St. ", "San ", "Bad "]) + town + r.choice(["", "", "", " Hill", "ton", "ville", "burg"])
        kind = r.choice("Street Road Lane Avenue Square Drive Park Gardens Hill Place Boulevard Way St. Ave Grove Mews".split())
        post = self.digits(r.choice(["A9 9AA", "AA99 9AA", "99999", "9999", "9999 AA", "999 99"]))
        return r.choice([
            f"{n(1, 300)} {word} {kind}, {town}", f"{n(1, 300)} {word} {kind}, {town} {post}", f"{n(1, 300)}{r.choice('abcABC')} {word} {kind}, {town}, {post}", f"{n(1, 99)} rue de {word}, {post} {town}", f"{n(1, 99)} rue {word}, {post} {town}", f"{n(1, 99)}, avenue {word}, {post} {town}",
            f"{word}straße {n(1, 200)}, {post} {town}", f"{word}str. {n(1, 200)}, {post} {town}", f"{word}gasse {n(1, 99)}, {post} {town}", f"Calle de {word}, {n(1, 99)}, {post} {town}", f"Plaza {word} {n(1, 20)}, {post} {town}", f"Via {word} {n(1, 99)}, {post} {town}", f"Apt {n(1, 99)}, {n(1, 999)} {word} {kind}, {town}, {post}", f"{word}weg {n(1, 99)}, {post} {town}",
            f"{n(1, 999)} {word} {kind}, Suite {n(1, 90)}, {town} {post}", f"Flat {n(1, 30)}{r.choice('ABC')}, {n(1, 99)} {word} {kind}, {town}",
        ])

    def brand(self) -> str:
        return "".join(self.r.choice(("ve", "lo", "kri", "mu", "xo", "ten", "pe", "fla", "sol", "qui", "gra")) for _ in range(3)).capitalize()

    def carrier(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A sentence and the spans ``(start, end, type number)`` in it."""
        text, spans = "", []
        for part in re.split(r"(\{\w\})", self.r.choice(CARRIERS)):
            kind, value = None, part
            if re.fullmatch(r"\{\w\}", part):
                c = part[1]
                if c in "ijkq":
                    label, form = self.number()
                    if c == "j":
                        label = self.r.choice(["pasaporte n.º ", "número de identificación ", "DNI "])
                    if c == "k":
                        label = self.r.choice(["Passnummer ", "Ausweisnummer ", "Steuernummer "])
                    text += label
                    kind, value = 2, self.digits(form)
                elif c in "ne":
                    kind, value = (4, self.name()) if c == "n" else (0, self.email())
                elif c == "p":
                    kind, value = 1, self.phone()
                elif c in "agso":
                    kind, value = 3, {"a": self.address, "g": self.german, "s": self.spanish, "o": self.other_address}[c]()
                else:
                    value = {"w": lambda: self.r.choice(NOUNS), "r": lambda: self.r.choice(ROLES), "l": lambda: self.r.choice(LATER), "b": self.brand}[c]()
            if kind is not None:
                spans.append((len(text), len(text) + len(value), kind))
            text += value
        return text, spans

    def decoy(self) -> str:
        fill = {"x": lambda: self.r.choice([str(self.r.randint(1, 99)), f"{self.r.randint(1, 40)},{self.r.randint(100, 999)}"]), "w": lambda: self.r.choice(NOUNS), "r": lambda: self.r.choice(ROLES), "t": lambda: self.r.choice(TOWNS) if self.r.random() < 0.6 else self.r.choice(["", "", "Upper ", "Port ", "New ", "San ", "Bad ", "East "]) + self.made_up() + self.r.choice(["", "ton", " Hill", " Bay", "field"]), "u": lambda: self.r.choice(GERMAN_TOWNS), "v": lambda: self.r.choice(SPANISH_TOWNS), "b": self.brand, "d": lambda: self.digits(self.r.choice(["2024-09-19", "9/9/2024", "19.09.2025"]))}
        text = re.sub(r"\{(\w)\}", lambda m: fill[m[1]](), self.r.choice(DECOYS))
        return text.upper() if self.r.random() < 0.08 else text


def background(path: str) -> list[str]:
    """Sentences of the pages that hold no item, so far as plain patterns can tell."""
    import pyarrow.parquet as pq

    bad = re.compile(r"@|\(at\)|\[at\]|\[dot\]|\d{5,}|\d{3}[ .-]\d{3}|\b(?:" + "|".join(map(re.escape, GIVEN)) + r")\b|\b(?:" + "|".join(STEMS[:20]) + r")\w*|straße|Calle|Avenida|Flat \d|Unit \d|tax ID|passport|Pass|number|número|ID\b", re.I)
    lines: list[str] = []
    for text in pq.read_table(path, columns=["text"]).column("text").to_pylist():
        for line in text.split("\n"):
            lines += [s for s in re.split(r"(?<=[.!?])\s+", line) if s and not bad.search(s)]
        if len(lines) >= BACKGROUND:
            break
    return lines[:BACKGROUND]


def window(w: Writer, calm: list[str], whole: bool = False) -> tuple[str, np.ndarray]:
    """A text of up to ``LENGTH`` characters and its tags: one sentence as the splitter gives them, or a cut of running text.

    With ``whole`` no cut falls inside an item, where none could say what the rest of it is.
    """
    text, marks = "", []
    r = w.r.random()
    single = w.r.random() < 0.5
    while len(text) < LENGTH + 40:
        if w.r.random() < (0.6 if r < 0.75 else 0.0):
            part, spans = w.carrier()
        else:
            part, spans = (w.decoy() if w.r.random() < 0.45 or not calm else w.r.choice(calm)), []
        marks += [(a + len(text), b + len(text), t) for a, b, t in spans]
        text += part
        if single:
            break
        text += w.r.choice([" ", " ", " ", "  ", " | ", ", "])
    begin = 0 if single and w.r.random() < 0.9 else w.r.randint(0, min(40, len(text) - 1))
    n = LENGTH if single else w.r.randint(LENGTH // 2, LENGTH)
    end = min(len(text), begin + n)
    if whole:
        begin = min([a for a, b, _ in marks if a < begin < b], default=begin)
        end = min([a for a, b, _ in marks if a < min(end, begin + LENGTH) < b], default=min(end, begin + LENGTH))
    y = np.zeros(len(text), np.int64)
    for a, b, t in marks:
        y[a:b] = 2 + 2 * t
        y[a] = 1 + 2 * t
    return text[begin:end], y[begin:end]


def batch(w: Writer, calm: list[str], whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character numbers, tags and lengths of ``BATCH`` windows."""
    ids, tags, lengths = np.zeros((BATCH, LENGTH), np.uint8), np.zeros((BATCH, LENGTH), np.int64), np.zeros(BATCH, np.int64)
    for k in range(BATCH):
        text, y = window(w, calm, whole)
        n = lengths[k] = len(text)
        ids[k, :n], tags[k, :n] = pii.encode(text), y
    return ids, tags, lengths


def start(seed: int = 3) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    h, d = pii.HIDDEN, pii.EMBEDDING
    base = np.zeros((2, 4 * h))
    base[:, h : 2 * h] += 0.5
    return {
        "emb": g.normal(0, 1, (pii.VOCABULARY, d)), "wx": g.normal(0, 0.4 / d**0.5, (2, 2, d, 4 * h)), "base": base, "u": g.normal(0, 0.5 / h**0.5, (2, h, 4 * h)),
        "out": g.normal(0, 0.3 / h**0.5, (2, 2 * h, pii.TAGS)), "bias": np.zeros(pii.TAGS), "trans": np.zeros((pii.TAGS + 1, pii.TAGS)),
    }


def gradient(p: dict[str, np.ndarray], ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradient through the tables of what each character of a step adds to the gates: its embedding times ``wx``, plus ``base``."""
    table = p["emb"] @ p["wx"]
    table[:, 0] += p["base"][:, None]
    loss, g = table_gradient({**p, "x": table}, ids, tags, lengths)
    gx = g.pop("x")
    return loss, g | {"emb": np.einsum("dsvg,dseg->ve", gx, p["wx"], optimize=True), "wx": p["emb"].T @ gx, "base": gx[:, 0].sum(1)}


def table_gradient(p: dict[str, np.ndarray], ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood per sequence and its gradient; gates are stored halved, as in ``pii.Model``."""
    b, t = ids.shape
    h = pii.HIDDEN
    pairs = ids.reshape(b, t // 2, 2)
    back = (lengths[:, None] + 1) // 2 - 1 - np.arange(t // 2)[None, :]
    rows = np.arange(b)
    rid = np.where((back >= 0)[:, :, None], pairs[rows[:, None], np.maximum(back, 0)], 0)
    state, cell = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
    kept = []
    hs = np.empty((t // 2, 2, b, h), np.float32)
    for k in range(t // 2):
        z = state @ p["u"]
        for d, own in enumerate((pairs, rid)):
            z[d] += p["x"][d, 0][own[:, k, 0]] + p["x"][d, 1][own[:, k, 1]]
        a = np.tanh(z)
        i, f, o = (0.5 * (1 + a[..., j * h : (j + 1) * h]) for j in range(3))
        g = a[..., 3 * h :]
        before = cell
        cell = f * cell + i * g
        tc = np.tanh(cell)
        kept.append((state, before, a, i, f, o, g, tc))
        state = o * tc
        hs[k] = state
    at = np.maximum(back, 0).T
    both = np.concatenate([hs[:, 0], hs[at, 1, rows[None, :]]], 2)
    e = np.empty((t, b, pii.TAGS), both.dtype)
    e[0::2], e[1::2] = both @ p["out"][0] + p["bias"], both @ p["out"][1] + p["bias"]
    live = (np.arange(t)[:, None] < lengths[None, :])
    # Forward and backward sums of the CRF.
    tr, first = p["trans"][: pii.TAGS], p["trans"][pii.TAGS]
    alpha = np.empty_like(e)
    alpha[0] = e[0] + first
    etr = np.exp(tr)
    for k in range(1, t):
        m = alpha[k - 1].max(1, keepdims=True)
        nxt = np.log(np.exp(alpha[k - 1] - m) @ etr + 1e-30) + m + e[k]
        alpha[k] = np.where(live[k][:, None], nxt, alpha[k - 1])
    m = alpha[-1].max(1)
    logz = np.log(np.exp(alpha[-1] - m[:, None]).sum(1)) + m
    beta = np.zeros_like(e)
    for k in range(t - 2, -1, -1):
        v = beta[k + 1] + e[k + 1]
        m = v.max(1, keepdims=True)
        nxt = np.log(np.exp(v - m) @ etr.T + 1e-30) + m
        beta[k] = np.where(live[k + 1][:, None], nxt, 0)
    post = np.exp(alpha + beta - logz[None, :, None]) * live[:, :, None]
    y = tags.T
    gold = np.zeros_like(e)
    gold[np.arange(t)[:, None], rows[None, :], y] = live
    score = (e * gold).sum() + first[y[0]].sum() + (tr[y[:-1], y[1:]] * live[1:]).sum()
    loss = (logz.sum() - score) / b
    de = (post - gold) / b
    g_tr = np.zeros_like(p["trans"])
    for k in range(1, t):
        v = beta[k] + e[k]
        top_a, top_v = alpha[k - 1].max(1), v.max(1)
        w = np.exp(alpha[k - 1] - top_a[:, None]) * (np.exp(top_a + top_v - logz) * live[k])[:, None]
        g_tr[: pii.TAGS] += etr * (w.T @ np.exp(v - top_v[:, None])) / b
    np.add.at(g_tr, (y[:-1][live[1:]], y[1:][live[1:]]), -1 / b)
    g_tr[pii.TAGS] = (post[0].sum(0) - np.bincount(y[0], minlength=pii.TAGS)) / b
    grads = {"trans": g_tr, "bias": de.sum((0, 1)), "out": np.stack([both.reshape(-1, 2 * h).T @ de[k::2].reshape(-1, pii.TAGS) for k in (0, 1)])}
    dboth = de[0::2] @ p["out"][0].T + de[1::2] @ p["out"][1].T
    dh = np.zeros((t // 2, 2, b, h), np.float32)
    dh[:, 0] = dboth[:, :, :h]
    ok = back.T >= 0
    kk, bb = np.nonzero(ok)
    dh[at[kk, bb], 1, bb] = dboth[kk, bb, h:]
    gu, gx = np.zeros_like(p["u"]), np.zeros_like(p["x"])
    carry, dcell = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
    dz_all = np.empty((t // 2, 2, b, 4 * h), np.float32)
    for k in range(t // 2 - 1, -1, -1):
        state, before, a, i, f, o, g, tc = kept[k]
        d = dh[k] + carry
        dcell = dcell + d * o * (1 - tc * tc)
        dz = dz_all[k]
        dz[..., :h] = dcell * g * 0.5 * (1 - a[..., :h] ** 2)
        dz[..., h : 2 * h] = dcell * before * 0.5 * (1 - a[..., h : 2 * h] ** 2)
        dz[..., 2 * h : 3 * h] = d * tc * 0.5 * (1 - a[..., 2 * h : 3 * h] ** 2)
        dz[..., 3 * h :] = dcell * i * (1 - g * g)
        gu += state.transpose(0, 2, 1) @ dz
        carry = dz @ p["u"].transpose(0, 2, 1)
        dcell = dcell * f
    for j, own in enumerate((pairs, rid)):
        add = dz_all[:, j].reshape(-1, 4 * h)
        for slot in (0, 1):
            flat = own[:, :, slot].T.reshape(-1)
            order = np.argsort(flat, kind="stable")
            values, begin = np.unique(flat[order], return_index=True)
            gx[j, slot][values] = np.add.reduceat(add[order], begin)
    return float(loss), grads | {"u": gu, "x": gx}


def train(pages: str, steps: int = 12_000, rate: float = 6e-3, report: int = 100) -> dict[str, np.ndarray]:
    w, calm = Writer(5), background(pages)
    p = {k: v.astype(np.float32) for k, v in start().items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        loss, g = gradient(p, *batch(w, calm))
        size = sum(float((x * x).sum()) for x in g.values()) ** 0.5
        lr = rate * min(1, step / 50) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
        for k in p:
            x = g[k] * min(1, 5 / size)
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.98 * v[k] + 0.02 * x * x
            p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
        if report and step % report == 0:
            print(step, round(loss, 3), flush=True)
    return p


def held_out(p: dict[str, np.ndarray], calm: list[str], batches: int = 10, seed: int = 99) -> dict[str, float]:
    """Span precision and recall on composed windows of another seed, whose edges cut no item."""
    net, w = pii.Model(p), Writer(seed)
    hit = said = true = 0
    for _ in range(batches):
        ids, tags, lengths = batch(w, calm, whole=True)
        other, paths = net.viterbi(net.emissions(np.ascontiguousarray(ids.T), lengths), lengths)
        got = dict(zip(other.tolist(), paths.T))
        for k in range(BATCH):
            a = set(pii.tag_spans(got[k][: lengths[k]])) if k in got else set()
            b = set(pii.tag_spans(tags[k, : lengths[k]]))
            hit, said, true = hit + len(a & b), said + len(a), true + len(b)
    return {"precision": hit / max(1, said), "recall": hit / max(1, true)}


if __name__ == "__main__":
    weights = train(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 12_000)
    np.savez_compressed(Path(__file__).with_name("pii_weights.npz"), **{k: v.astype(np.float16) for k, v in weights.items()})
    print(held_out(weights, background(sys.argv[1])))
