"""Training lines for addresses, numbers and e-mail addresses, made from published formats.

No line and no value comes from a table. A value is drawn from the whole range of its format: numbering plans for phones,
the issuing rules for identity numbers, street and postal forms with made-up names. It is set into a label, a
sentence, a row or a line of its own. Decoys are what else has these shapes: references, amounts, versions, dates. Words that
stand around values are general vocabulary of five languages.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

Line = tuple[str, set, frozenset]
KINDS = frozenset(["email", "phone", "id_number", "address"])

# Number formats as published. # any digit, 2 a digit from 2 to 9, 1 a digit from 1 to 9, @ a letter; _ keeps the next character as it is.
PHONE_FORMS = {
    "us": ["(2##) 2##-####", "2##-2##-####", "2##.2##.####", "+_1 2##-2##-####", "+_1 (2##) 2##-####", "+_1-2##-2##-####", "+_1 2## 2## ####", "_12##2######", "_1-2##-2##-####"],
    "uk": ["+44 20 1### ####", "+44 (0)_1### ######", "+44 (0)20 1### ####", "0_1### ######", "020 1### ####", "0_1### ### ###", "07### ######", "+447### ######", "+44 (0)_1### ### ###"],
    "de": ["+49 (0)1# #####-###", "+49 1# #######", "01#/######", "01# #######", "01## #####-##", "0049 1# ##### ###", "01#1/######", "01## ##### ###", "+491#########"],
    "fr": ["+33 1 ## ## ## ##", "+33 (0)1-##-##-##-##", "01 ## ## ## ##", "01.##.##.##.##", "01########", "+33 (0)1 ## ## ## ##", "0033 1 ## ## ## ##", "01-##-##-##-##"],
    "es": ["+34 1## ### ###", "1## ### ###", "0034-1########", "0034 1## ### ###", "+34 1## ## ## ##", "+341########", "1## ## ## ##"],
}
ID_FORMS = {
    "us": ["###-##-####", "### ## ####"], "us_plain": ["#########"],
    "uk": ["@@######@", "@@ ## ## ## @"],
    "de_card": ["@##@#####", "@########"], "de_tax": ["1# ### ### ###", "1##########"], "passport": ["@@#######", "@########"],
    "fr": ["_1##_01##########", "_1 ## _01 ## ### ### ##", "_2 ## _1_0 ## ### ### ##", "_2##_1_2##########", "_2 ## _01 ## ### ### ##"],
    "es": ["########@", "########-@", "X#######@", "Y-#######-@", "Z#######@", "X-#######-@"],
}
# Forms that something else shares: only a label tells what they are.
BARE = {"us_plain", "de_card", "passport"}

PHONE_LABELS = "Tel|Tel.|tel|Phone|phone|Telephone|Mobile|mobile|Cell|Fax|fax|Téléphone|Tél.|Tél|Mobil|Handy|Telefon|Rückruf|Teléfono|Móvil|móvil|WhatsApp|Hotline".split("|")
ID_LABELS = "SSN|ssn|National Insurance|NINO|ID|id|Passport|passport no.|Tax ID|tax number|Personalausweis|Ausweisnummer|Steuer-ID|Kennnummer|DNI|NIE|NIF|documento|Identité|Sécurité sociale|national_id|passport_number".split("|")
ADDRESS_LABELS = "Address|Home|address|Anschrift|Adresse|Dirección|Domicilio|Wohnort|Office|Lives at|wohnhaft in".split("|")
EMAIL_LABELS = "E-mail|Email|mail|Contact|Courriel|Correo|Mail|cc|From|Kontakt".split("|")
# Names of numbers that are nobody's.
REFERENCES = "order|invoice|serial|batch|ticket|article|SKU|part|lot|parcel|booking|build|item|reference|contract|account of goods|tracking|revision|meter|barcode|ISBN|EAN|Bestellung|Auftrag|Rechnung|Artikel|Seriennummer|Charge|Vorgang|Sendung|commande|facture|colis|série|dossier|référence|pedido|factura|lote|referencia|artículo|envío|row|key|total|sum|count|amount|size|offset|hash|job|line|record|checksum|process".split("|")
FILLER = {
    "en": "the and then while because meeting garden window paper letter spring morning would after before near with without slowly green quiet bring early".split(),
    "de": "und dann weil Garten Fenster Papier Morgen nach vor bei ohne langsam still bringen früh wieder gestern Besuch".split(),
    "fr": "et puis jardin fenêtre papier matin après avant avec sans lentement calme hier visite souvent".split(),
    "es": "y luego jardín ventana papel mañana después antes con sin despacio tranquilo ayer visita siempre".split(),
}
PHONE_SAYINGS = ["You will get hold of us on {}.", "ring me back on {} tonight", "{} is what our front office answers", "if nobody picks up, dial {} instead", "Ask for the gardener at {} please", "wer fragen hat, wählt {} und wartet", "Zu sprechen unter {} ab acht", "composez le {} en cas de panne", "Pour nous parler, faites le {}.", "marque {} si llueve", "Su tía contesta en el {} por la noche.", "I lost my old one, so text {} from now"]
ID_SAYINGS = ["her papers say {}, as do mine", "The clerk typed {} twice by mistake.", "registered under {} since spring", "dem Amt liegt {} vor", "In der Akte der Person steht {}.", "inscrite sous le {} depuis mai", "El funcionario anotó {} sin mirar.", "holder {} signed here"]
ADDRESS_SAYINGS = ["They have lived at {} since May", "Send the chairs to {}.", "we meet in front of {} at six", "Er wohnt jetzt {}.", "Die Möbel gehen nach {}.", "Elle habite {}", "Déposez les chaises au {}.", "Vive en {} con su madre.", "Mande las sillas a {}", "a parcel for {} came back"]
EMAIL_SAYINGS = ["Just write to {} and wait.", "{} never answers on Sundays", "copy {} on this, please", "schreib an {}, wenn es passt", "Écrivez à {} avant jeudi", "Mande una línea a {} y espere."]

RESERVED = "example test invalid localhost".split()
GENERIC = "com org net edu gov info biz name io dev app cloud online".split()
SUFFIXES = "png jpg jpeg svg gif webp pdf py js ts go rs md txt csv json xml yml yaml toml ini cfg html css zip gz log lock so dll".split()

_ONSETS, _NUCLEI, _CODAS = "b br c cl d dr f g gl h k l m n p qu r s st t tr v w z".split(), "a e i o u ai ea oo".split(), "n r l s t nd rk ck m ld ng".split()


def word(rng: random.Random, syllables: int = 2) -> str:
    """A made-up word with a capital."""
    return ("".join(rng.choice(_ONSETS) + rng.choice(_NUCLEI) for _ in range(syllables)) + rng.choice(_CODAS)).capitalize()


def value(rng: random.Random, form: str) -> str:
    """A value of a form."""
    out, keep = [], False
    for c in form:
        if keep or c not in "#12@_":
            out.append(c)
            keep = False
        elif c == "_":
            keep = True
        else:
            out.append(rng.choice({"#": string.digits, "1": string.digits[1:], "2": string.digits[2:], "@": string.ascii_uppercase}[c]))
    return "".join(out)


def email(rng: random.Random) -> str:
    local = rng.choice(["{a}.{b}", "{a}", "{a}{n}", "{a}_{b}", "{a}+{b}", "{c}.{b}", "{a}-{b}", "{b}.{a}{n}"]).format(a=word(rng).lower(), b=word(rng).lower(), c=rng.choice(string.ascii_lowercase), n=rng.randint(1, 99))
    domain = rng.choice(["{a}", "{a}-{b}", "mail.{a}", "{a}.{b}", "{a}{n}"]).format(a=word(rng).lower(), b=word(rng, 1).lower(), n=rng.randint(1, 99))
    tld = rng.choice([*RESERVED[:3], *GENERIC, *(rng.choice(string.ascii_lowercase) + rng.choice(string.ascii_lowercase) for _ in range(8))])
    plain = f"{local}@{domain}.{tld}"
    if rng.random() < 0.35:
        at = rng.choice([" [at] ", " (at) ", "[at]", "(at)", " {at} ", " AT ", " at ", " [@] "])
        dot = " dot " if at == " at " else " DOT " if at == " AT " else rng.choice([" [dot] ", ".", "[dot]", " (dot) ", "(dot)", " dot "])
        plain = f"{local}{at}{domain.replace('.', dot)}{dot}{tld}"
    return plain.upper() if rng.random() < 0.05 and " " not in plain else plain


def address(rng: random.Random) -> str:
    number = str(rng.randint(1, 999 if rng.random() < 0.3 else 150))
    country = rng.choice(["en", "en", "en", "de", "de", "fr", "es", "box"])
    town = word(rng, rng.randint(1, 3))
    five = f"{rng.randint(0, 99999):05d}"
    if country == "en":
        street = " ".join(word(rng) for _ in range(rng.choice([1, 1, 1, 2]))) + " " + rng.choice("Street Road Lane Avenue Close Way Terrace Crescent Drive Court Place Square Hill Row Gardens Grove Mews Walk St Rd Ave Dr Ln".split())
        out = f"{number}{rng.choice(['', '', '', 'A', 'b'])}{rng.choice(['', '', ','])} {street}"
        if rng.random() < 0.3:
            unit = rng.choice(["Flat", "Unit", "Apt", "Suite", "Apartment"])
            out = f"{unit} {rng.randint(1, 99)}{rng.choice(['', 'B'])}, " + (out if rng.random() < 0.6 else street)
        if rng.random() < 0.5:
            out += f", {town}" + rng.choice(["", "", f" {rng.choice('EN SW B LS M'.split())}{rng.randint(1, 20)} {rng.randint(1, 9)}{rng.choice('ABDEFGH')}{rng.choice('ABDEFGH')}", f", {rng.choice('NY CA TX WA OH'.split())} {five}"])
    elif country == "de":
        street = rng.choice([word(rng) + rng.choice(["straße", "weg", "gasse", "platz", "allee", "str.", "ring", "damm", "ufer"]), word(rng).rstrip() + "markt", rng.choice(["Am ", "An der ", "Im ", "Auf dem "]) + word(rng), word(rng) + "er " + rng.choice(["Straße", "Weg", "Platz", "Allee"])])
        out = f"{street} {number}{rng.choice(['', '', '', ' a', 'b'])}" + rng.choice(["", f", {five} {town}", f"\n{five} {town}"])
    elif country == "fr":
        street = rng.choice("rue chemin boulevard avenue allée impasse place quai route".split()) + " " + rng.choice(["de la ", "des ", "du ", "de ", "de l'", ""]) + word(rng)
        out = f"{number}{rng.choice(['', '', ' bis', ' ter'])}{rng.choice([' ', ', '])}{street}" + rng.choice(["", f", {five} {town}", f"\n{five} {town}"])
    elif country == "es":
        out = rng.choice("Calle Camino Plaza Paseo Avenida Avda. Ronda C/".split()) + " " + rng.choice(["de la ", "del ", "de ", "", ""]) + word(rng) + rng.choice([" ", ", ", ", n.º ", ", núm. "]) + number + rng.choice(["", "", f", {rng.randint(1, 9)}.º {rng.choice('ABCD')}"]) + rng.choice(["", f", {five} {town}"])
    else:
        out = rng.choice(["P.O. Box", "PO Box", "Post Office Box", "Postfach", "Apartado de correos", "Boîte postale"]) + f" {rng.randint(1, 9999)}"
    return out.upper() if country == "en" and rng.random() < 0.05 else out


def _filler(rng: random.Random, most: int = 4) -> str:
    words = rng.choice(list(FILLER.values()))
    return " ".join(rng.choice(words) for _ in range(rng.randint(1, most)))


def carried(rng: random.Random, kind: str, text: str, labels: list[str], sayings: list[str], bare: bool) -> Line:
    """A value in a label, a sentence, a row, or a line of its own; `bare` forms in a label only."""
    way = 0.0 if bare else rng.random()
    if way < 0.35:
        sep = rng.choice([": ", " ", ":", " : ", "=", " = ", "/", ": ", '": "'])
        line = rng.choice(["", "- ", "* ", "  ", _filler(rng) + ", ", "# ", '{"']) + rng.choice(labels) + sep + "{}" + rng.choice(["", ".", ", " + _filler(rng), " " + _filler(rng), ";", '",', " (" + _filler(rng, 2) + ")"])
    elif way < 0.6:
        line = rng.choice(sayings)
    elif way < 0.75:
        mark = rng.choice([",", ";", "|", "\t", " | "])
        line = _filler(rng, 2) + mark + "{}" + mark + _filler(rng, 2)
    elif way < 0.85:
        line = rng.choice(["{}", "{}\n" + _filler(rng), _filler(rng) + "\n{}", _filler(rng) + "\n{}\n" + _filler(rng)])
    else:
        line = _filler(rng) + rng.choice([" ", " (", ", "]) + "{}"
        line += ") " + _filler(rng) if line.endswith("({}") else rng.choice([".", "", ", " + _filler(rng), " " + _filler(rng)])
    at = line.index("{}")
    return line[:at] + text + line[at + 2 :], {(at, at + len(text), kind)}, KINDS


def decoy(rng: random.Random) -> str:
    """A line in which nothing is anybody's."""
    n = lambda k: "".join(rng.choice(string.digits) for _ in range(k))
    letters = lambda k: "".join(rng.choice(string.ascii_uppercase) for _ in range(k))
    what = rng.choice(REFERENCES)
    shape = rng.choice([
        n(9), n(10), n(11), n(8), f"{n(3)} {n(3)} {n(3)}", f"{n(2)} {n(3)} {n(3)} {n(3)}", f"{n(3)}-{n(3)}-{n(3)}", f"{n(3)}-{n(3)}-{n(4)}", f"{letters(1)}{n(8)}", f"{letters(2)}{n(7)}", f"{letters(3)}-{n(4)}-{n(6)}",
        f"97{rng.choice('89')}-{n(1)}-{n(3)}-{n(5)}-{n(1)}", f"{n(3)}.{n(3)}.{n(4)}", f"0{n(9)}", f"{n(8)}{letters(1)}", f"{letters(1)}{n(2)}{letters(1)}{n(5)}", f"0{n(3)} {n(6)}",
    ])
    date = f"{rng.randint(1980, 2035)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    octets = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    file = word(rng).lower()
    day = rng.choice("Montag Dienstag Mittwoch Donnerstag Freitag Samstag Januar Mai Juli".split())
    place = rng.choice("Kapitel Abschnitt Seite Tabelle Zimmer Raum Punkt Band Bild Jahr Stand Modul Lager Projekt".split())
    unit = rng.choice("reports samples repairs visits copies chairs pages boxes".split())
    return rng.choice([
        f"{what} {shape}", f"{what}: {shape}", f"{what} {shape} {_filler(rng)}", f"{what}={shape} {what}={n(3)}", f"{_filler(rng)} {what} {shape}.", f"{what} no. {shape}", f"{_filler(rng)}, {what} {shape}, {_filler(rng)}", f"{what} {shape} {_filler(rng)}", f"{what} {shape}",
        f"{date}T{n(2)}:{n(2)}:{n(2)} {_filler(rng)}", f"{date} {n(2)}:{n(2)}", f"host {octets} {_filler(rng)}", f"version {rng.randint(1, 20)}.{n(1)}.{n(3)}.{n(2)}", f"{n(3)},{n(3)}.{n(2)}", f"{n(1)} {n(3)} {n(3)} {_filler(rng)}",
        "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 12, 32, 40]))), "-".join("".join(rng.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)),
        f"{file}@2x.{rng.choice(SUFFIXES)}", f"{file}@{rng.randint(0, 9)}.{n(1)}.{n(2)}", f"{file}@{word(rng).lower()}-{n(2)}:~$ {_filler(rng)}", f"scp {file}.txt {file}@{word(rng).lower()}.{rng.choice(['lan', 'local', 'internal'])}:/srv/{file}", f"@{file.capitalize()} {_filler(rng)}",
        f"{_filler(rng)} at the dot {_filler(rng, 1)}", f"{rng.choice(['look', 'stare', 'arrive', 'aim'])} at {rng.choice(['one', 'this', 'a'])} dot {rng.choice(['matrix', 'above', 'there', 'plot'])}",
        f"{n(1)} {word(rng)} {rng.choice('street court place hill walk'.split())} {unit}", f"{rng.randint(2, 90)} {unit} in {word(rng)} {word(rng)}", f"{rng.choice(['Am', 'Im', 'Zum'])} {day} {rng.randint(1, 31)} {rng.choice('Teile Seiten Personen Stück Briefe'.split())}", f"{rng.choice(['Im', 'Am', 'Zum', 'In der'])} {place} {rng.randint(1, 400)} {_filler(rng)}",
        f"{place} {rng.randint(1, 400)} {_filler(rng)}", f"{word(rng)} {rng.randint(1, 400)}", f"{rng.randint(2, 90)} {word(rng)} {word(rng)} {unit}", f"Nach {rng.randint(2, 90)} {rng.choice('Tagen Stunden Wochen'.split())} kam {word(rng)} {rng.randint(1, 90)}",
    ])


def generated_lines(seed: int = 9, keep: Callable[[str, int], bool] = lambda what, k: True, per_form: int = 18) -> list[Line]:
    """Training lines with the places of their values. keep(what, k): whether the k-th form, label or sentence of a list is
    used; the held-out figures leave some out."""
    rng = random.Random(seed)
    pick = lambda what, items: [x for k, x in enumerate(items) if keep(what, k)]
    out: list[Line] = []
    for kind, forms, labels, sayings in (("phone", PHONE_FORMS, PHONE_LABELS, PHONE_SAYINGS), ("id_number", ID_FORMS, ID_LABELS, ID_SAYINGS)):
        labels, sayings, k = pick("label", labels), pick("saying", sayings), 0
        for country, each in forms.items():
            for form in each:
                k += 1
                if keep(kind, k):
                    out += [carried(rng, kind, value(rng, form), labels, sayings, country in BARE) for _ in range(per_form)]
    for kind, make, labels, sayings in (("email", email, EMAIL_LABELS, EMAIL_SAYINGS), ("address", address, ADDRESS_LABELS, ADDRESS_SAYINGS)):
        labels, sayings = pick("label", labels), pick("saying", sayings)
        out += [carried(rng, kind, make(rng), labels, sayings, False) for _ in range(20 * per_form)]
    for title in ("Mr", "Mrs", "Ms", "Dr.", "Prof.", "Capt.", "Sister", "Herr", "Frau", "Madame", "La señora", "El señor"):
        for _ in range(3):
            name = rng.choice([word(rng), word(rng).upper(), "van " + word(rng), "O'" + word(rng), word(rng) + "-" + word(rng)])
            out.append((f"{title} {name} {_filler(rng)}", {(len(title) + 1, len(title) + 1 + len(name), "name")}, frozenset(["name"])))
    return out + [(decoy(rng), set(), KINDS) for _ in range(60 * per_form)]


def held_out(seed: int = 21) -> tuple[list[Line], list[Line]]:
    """Lines to train on and lines to measure with: every third number format, label and sentence is left out of the first
    and alone in the second; values and decoys are drawn anew."""
    return generated_lines(seed, lambda what, k: k % 3 != 0), generated_lines(seed + 1, lambda what, k: k % 3 == 0)
