"""Personal information in free text, by a semi-Markov conditional model over whole spans.

Proposals. Cheap patterns propose spans that could be a value of some type: e-mail addresses also in
their disguised forms, digit groups in the shapes of phone and identity numbers, street lines, runs of
capitalised words. A span's features see all of it at once: its type and shape, the words
around it, whether its parts are listed given names, whether its last part ends like surnames do here.

Model. A semi-Markov conditional random field: the probability of a segmentation grows with the exponential of
the summed scores of its spans, all else counting 0. Dynamic programming over the proposals by their ends gives the best
segmentation, boundaries and types jointly, and in training the probability of each span; a proposal spans
at most MAX_SPAN characters, so the work is linear in the text. Weights maximise the conditional likelihood.

Training. E-mail, number and address types learn from lines generated from published formats (personal_training), none
of them from a table. Names learn from the corpus: where a listed given name is followed by a capitalised word, the endings of these words, against
those of all other capitalised words, tell surnames that no list has, and words before such surnames tell given names.
Both are counted over all documents; only the labelled lines that the weights are fitted on are a bounded sample.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .personal_training import GENERIC, REFERENCES, RESERVED, SUFFIXES, generated_lines
from .sampling import hash_sample

MAX_SPAN = 120
SAMPLE_DOCS, SAMPLE_CHARS = 3_000, 20_000
TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

# Words of the languages of the corpus that stand before a value or inside it.
TITLES = frozenset("mr mrs ms miss dr prof capt sir sister brother father herr frau madame monsieur mme mlle m señor señora sr sra don doña senor senora professor captain".split())
PARTICLE = r"(?:van der |van den |van |von der |von |de la |de los |del |de |du |VAN DER |VAN |VON |DE LA |DEL |DE |DU )"
STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Clos|Way|Terrace|Terr|Crescent|Cres|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Hill|Row|Gardens|Grove|Mews|Walk)"
GERMAN = ("straße", "strasse", "str", "weg", "gasse", "platz", "markt", "allee", "ring", "anger", "kamp", "ufer", "damm", "hof", "steig", "berg", "chaussee")
FRENCH = r"(?:rue|chemin|boulevard|avenue|allée|impasse|place|quai|route|cours|square|passage|sentier|bd|av\.)"
SPANISH = "calle camino plaza paseo avenida avda. avda ronda carretera travesía callejón c/".split()
LABELS = {
    "phone": "tel phone telephone mobile cell fax whatsapp call ring tél téléphone appeler joignable mobil telefon rückruf erreichbar handy móvil teléfono llamar hotline".split(),
    "id_number": "ssn nino id passport national citizen tax identity insured number no nr ausweisnummer steuer kennnummer personalausweis dni nif nie identidad documento numéro sécurité sociale identité national_id personnr".split(),
}

UPPER = "A-ZÀ-ÖØ-ÞŁŚŽŠČ"
LOWER = "a-zà-öø-ÿłśžšč"
_LOCAL = re.compile(r"[\w.+%-]{1,64}$")
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,24}(?!\w)")
_HIDDEN_LOCAL = re.compile(r"[\w.+%-]{1,64} ?$")
_HIDDEN_DOMAIN = re.compile(r" ?[\w-]+(?: ?(?:[\[({] ?(?:dot|DOT|\.) ?[\])}]|\.| (?:dot|DOT) ) ?[\w-]+)+")
_SPOKEN_DOMAIN = re.compile(r"[\w-]+(?: (?:dot|DOT) [\w-]+)+")
_HIDDEN_AT = ("[at]", "(at)", "{at}", "[ at ]", "( at )", "[@]", "(@)", "{@}")
_NUMBER = re.compile(
    r"(?<![\w.@/\-])(?=[+(\dA-Z])(?:"
    r"(?P<intl>(?:\+|00(?=[1-9]))\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d(?:[ .\-/]?\d){5,11})"
    r"|(?P<area>(?:1[ \-])?\(\d{2,5}\) ?\d{3}[ .\-]\d{3,4})"
    r"|(?P<trunk1>1-\d{3}-\d{3}-\d{4}(?!\d))"
    r"|(?P<nanp>\d{3}[.\-]\d{3}[.\-]\d{4})"
    r"|(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w))"
    r"|(?P<insee>[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}(?!\d))"
    r"|(?P<nie>[XYZ]-?\d{7}-?[A-Z])"
    r"|(?P<dni>\d{8}-?[A-Z](?!\w))"
    r"|(?P<card>[A-Z]\d{2}[A-Z]\d{5})"
    r"|(?P<pass>[A-Z]{1,2}\d{7,8}(?!\w))"
    r"|(?P<ssn>\d{3}[ \-]\d{2}[ \-]\d{4}(?!\d))"
    r"|(?P<tax>\d{2} \d{3} \d{3} \d{3}(?!\d))"
    r"|(?P<trunk>0[1-9]\d{0,3}[ /.\-]?\d(?:[ .\-/]?\d){5,8})"
    r"|(?P<three>\d{3} \d{3} \d{3}(?! ?\d)|\d{3} \d{2} \d{2} \d{2}(?! ?\d))"
    r"|(?P<long>\d{9,11}(?!\d))"
    r")(?![\w]|[./:@\-]\d|-\w)"
)
_REFERENCES = frozenset(w.lower() for r in REFERENCES for w in r.split())
_CAP = rf"[{UPPER}][\w'’]*"
_ENGLISH = re.compile(rf"\d(?<![\w.\-/]\d)\d{{0,3}}[A-Za-z]?,? +(?:{_CAP} ){{1,3}}((?i:{STREET}))\b\.?")
_NUMBERLESS = re.compile(rf"(?<!\w)(?=[FfUuAaSs])(?i:flat|unit|apt\.?|apartment|suite) ?\d{{1,4}}[A-Za-z]?,? +(?:{_CAP} ){{1,3}}(?i:{STREET})\b\.?")
_BOX = re.compile(r"(?<!\w)(?=[PAB])(?:P\. ?O\. ?Box|PO Box|P\.O\.B\.|Post Office Box|Postfach|Apartado(?: de [Cc]orreos)?|Boîte [Pp]ostale|BP|B\.P\.) ?\d{1,5}(?: \d{2,3})*(?!\w)")
_GERMAN_TWO = re.compile(rf"[{UPPER}](?<![\w\-][{UPPER}])[\w\-]+ (?i:straße|strasse|weg|platz|allee|gasse|ring|damm|ufer) \d{{1,4}}(?: ?[a-z](?![\w]))?(?![\w\d])")
_UNIT = re.compile(r"(?i)\b(?:flat|unit|apt\.?|apartment|suite|room) ?(?:\d{1,4}[A-Za-z]?,? +)?$")
_CITY = re.compile(rf"(?:,\s*|[\r\n]+)\d{{5}} {_CAP}(?:[ \-]{_CAP})*|, {_CAP}(?:[ \-](?![A-Z]{{1,2}}\d){_CAP})?(?:,? [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}\b|, [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?(?!\d))?")
_POSTCODE = re.compile(rf"(?:,\s*|[\r\n]+)\d{{5}} {_CAP}(?:[ \-]{_CAP})*")
_GERMAN = re.compile(rf"([{UPPER}](?<![\w\-][{UPPER}])[\w\-]+\.?) (\d{{1,4}}(?: ?[a-z](?![\w]))?)(?![\w\d])")
_ON = re.compile(r"(?i)(?<!\w)(?:am|an der|an den|im|in der|auf dem|auf der|zum|zur) $")
_FRENCH = re.compile(rf"\d(?<![\w.\-/]\d)\d{{0,3}}(?: ?(?i:bis|ter|quater))?,? (?i:{FRENCH}) (?i:de la |de l['’]|des |du |de |d['’]|la |le )?{_CAP}(?:[ \-](?:d[eu]s? )?{_CAP})*")
_SPANISH = re.compile(rf"(?<!\w)(?=[CPARTcpart])(?:{'|'.join(re.escape(f) for w in SPANISH for f in (w, w.capitalize(), w.upper()))}) ?(?i:de las |de los |de la |del |de )?{_CAP}(?: {_CAP})*,? (?:n\.º ?|nº ?|núm\. ?)?\d{{1,4}}(?:, ?\d{{1,2}}\.º(?: ?[A-Z]\b)?)?")
_WORD = rf"(?:[{UPPER}][{LOWER}]+|[{UPPER}]{{2,}})"
_PART = rf"(?:(?:O['’]|D['’])?{_WORD}(?:-(?:O['’])?{_WORD})*|[{UPPER}]\.)"
_RUN = re.compile(rf"(?<![\w@.'’\-])(?:{PARTICLE})?{_PART}(?:,? (?:{PARTICLE})?{_PART})+(?![\w@]|['’](?!s\b))")
_TITLED = re.compile(rf"(?<!\w)(?=[A-Zdsm])(?:{'|'.join([t.capitalize() for t in sorted(TITLES - {'m'}, key=len, reverse=True)] + ['MRS', 'MR', 'MS', 'DR', 'PROF', 'HERR', 'FRAU', 'MADAME', 'señora', 'señor', 'doña', 'don', 'monsieur', 'madame', 'sra', 'sr'])})\.? ((?:{PARTICLE})?{_PART})")
_TOKEN, _DIGIT = re.compile(r"\w+", re.UNICODE), re.compile(r"\d")
_AFTER = re.compile(rf"(?<![\w\-])((?:{_WORD})(?:-{_WORD})*) (?:[{UPPER}]\. )?(?:{PARTICLE})?((?:O['’])?{_WORD}(?:-(?:O['’])?{_WORD})*)(?!\w)")
_CAPITALISED = re.compile(rf"(?<!\w){_WORD}")
_LEADING = re.compile(rf"(?<![\w\-]){_WORD}")
_LEADS = re.compile(rf"(?<![\w\-])({_WORD})[.:]? (?=({_WORD})(?!\w))")
_SPLIT = re.compile(rf"(,?) (?:{PARTICLE})?(?=[{UPPER}])")


def _lines_with_digits(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of lines that hold a digit: nothing else can hold a number or an address."""
    start = end = -1
    m = _DIGIT.search(text)
    while m:
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        b = len(text) if b < 0 else b
        if start < 0:
            start = a
        elif a > end + 1:
            yield start, end
            start = a
        end = b
        m = _DIGIT.search(text, b)
    if start >= 0:
        yield start, end


class Model:
    """Weights and what the sample told about names."""

    def __init__(self, given: set[str]):
        self.given = given
        self.weights: dict[str, float] = {}
        self.endings: dict[str, float] = {}
        self.inferred: set[str] = set()
        self.callers: set[str] = set()
        self.memo: dict[str, float] = {}

    # -- proposals -------------------------------------------------------------------------

    def proposals(self, text: str, types: frozenset[str] = frozenset(TYPES)) -> list[tuple[int, int, str, tuple[str, ...]]]:
        """(start, end, type, features) of all candidate spans."""
        out: list[tuple[int, int, str, tuple[str, ...]]] = []
        if "email" in types:
            self._emails(text, out)
        blocks = list(_lines_with_digits(text)) if types & {"phone", "id_number", "address"} else []
        if "phone" in types or "id_number" in types:
            for a, b in blocks:
                for m in _NUMBER.finditer(text, a, b):
                    self._number(text, m, types, out)
        if "address" in types:
            for a, b in blocks:
                self._addresses(text, a, b, out)
        if "name" in types:
            self._names(text, out)
        return out

    def _emails(self, text: str, out: list) -> None:
        """Every sign that may part an address, with what stands on both sides."""
        at = text.find("@")
        while at >= 0:
            local, domain = _LOCAL.search(text[max(0, at - 64) : at]), _DOMAIN.match(text, at + 1)
            if local and domain and (name := local.group().lstrip(".-+%")):
                self._email(text, at - len(name), domain.end(), "plain", out)
            at = text.find("@", at + 1)
        low = text.lower() if text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if "[" in text or "(" in text or "{" in text or " at " in text or " AT " in text else ""
        for sign in (*_HIDDEN_AT, " at "):
            at = low.find(sign)
            while at >= 0:
                after = at + len(sign)
                local = _HIDDEN_LOCAL.search(text[max(0, at - 65) : at])
                domain = (_SPOKEN_DOMAIN if sign == " at " else _HIDDEN_DOMAIN).match(text, after)
                if local and domain:
                    self._email(text, at - len(local.group()), domain.end(), "spoken" if sign == " at " else "hidden", out)
                at = low.find(sign, after)

    def _email(self, text: str, s: int, e: int, form: str, out: list) -> None:
        """A span's form, the kind of its top-level domain, and what stands around it."""
        last = _TOKEN.findall(text[max(s, e - 24) : e].lower())[-1:]
        tld = last[0] if last else ""
        kind = "reserved" if tld in RESERVED else "generic" if tld in GENERIC else "file" if tld in SUFFIXES else "country" if len(tld) == 2 else "other"
        after = text[e : e + 2] if text[e : e + 1] in ":/" else ""
        out.append((s, e, "email", ("email", f"email:form={form}", f"email:tld={kind}", f"email:form={form},tld={kind}", f"email:after={after if after in (':~', ':/', '/') or not after else ''}", f"email:numeric={text[s:e].split('@')[0].isdigit()}", f"email:one={s > 0 and text[s - 1] in '/@'}")))

    def _around(self, text: str, s: int, e: int) -> tuple[list[str], str, str]:
        left = _TOKEN.findall(text[max(0, s - 40) : s].lower())[-3:]
        right = _TOKEN.search(text, e, e + 24)
        return left, right.group().lower() if right else "", text[s - 1] if s else ""

    def _number(self, text: str, m: re.Match, types: frozenset[str], out: list) -> None:
        s, e, kind = m.start(), m.end(), m.lastgroup
        left, _, before = self._around(text, s, e)
        value = m.group()
        digits = sum(c.isdigit() for c in value)
        shape = "".join("0" if c.isdigit() else "A" if c.isalpha() else c for c in value)
        alone = not text[text.rfind("\n", 0, s) + 1 : s].strip(" \t#/*-;>") and not text[e : (text.find("\n", e) + 1 or len(text) + 1) - 1].strip()
        glued = before in "=:" and before != ""
        for kind_of in ("phone", "id_number"):
            if kind_of not in types:
                continue
            said = any(w in LABELS[kind_of] or w.rstrip("s") in LABELS[kind_of] for w in left)
            other = any(w in _REFERENCES for w in left[-2:])
            f = [kind_of, f"{kind_of}:kind={kind}", f"{kind_of}:label={said}", f"{kind_of}:digits={digits}", f"{kind_of}:digits={digits},one={value[0] == '1'}", f"{kind_of}:kind={kind},label={said}", f"{kind_of}:lead={value[:2] if value[0] in '+0(1' else ''}"]
            f += [f"{kind_of}:reference={other}", f"{kind_of}:kind={kind},reference={other}", f"{kind_of}:reference={other},label={said}"]
            f += [f"{kind_of}:glued={glued}", f"{kind_of}:alone={alone}", f"{kind_of}:shape={shape}", f"{kind_of}:before={before if before in ',;|' else ''}"]
            out.append((s, e, kind_of, tuple(f)))

    def _addresses(self, text: str, a: int, b: int, out: list) -> None:
        """The addresses whose first line lies in text[a:b]; a place and its postcode may follow on the next."""

        def add(s: int, e: int, kind: str, city: re.Pattern = _CITY) -> None:
            tail = city.match(text, e)
            end = tail.end() if tail else e
            if end - s <= MAX_SPAN:
                post = bool(tail and re.search(r"\d{5}", tail.group()))
                right = _TOKEN.match(text, end + 1) if text[end : end + 1] == " " else None
                noun = bool(right and right.group()[:1].isupper())
                out.append((s, end, "address", ("address", f"address:kind={kind}", f"address:city={bool(tail)}", f"address:post={post}", f"address:kind={kind},noun={noun}", f"address:length={min(6, text.count(' ', s, e))}")))

        for m in _ENGLISH.finditer(text, a, b):
            unit = _UNIT.search(text[max(0, m.start() - 24) : m.start()])
            small = m[1].islower()
            add(m.start() - (len(unit.group()) if unit else 0), m.end(), f"english,{small},{bool(unit)}")
        for m in _NUMBERLESS.finditer(text, a, b):
            add(m.start(), m.end(), "unit")
        for m in _BOX.finditer(text, a, b):
            add(m.start(), m.end(), "box")
        for m in _GERMAN.finditer(text, a, b):
            suffix = m[1].lower().rstrip(".").endswith(GERMAN)
            on = _ON.search(text[max(0, m.start() - 10) : m.start()])
            post = _POSTCODE.match(text, m.end())
            if suffix or post or on:
                add(m.start() - (len(on.group()) if on else 0), m.end(), f"german,{suffix},{bool(post)},{bool(on)}", _POSTCODE)
        for m in _GERMAN_TWO.finditer(text, a, b):
            add(m.start(), m.end(), f"german two,{bool(_POSTCODE.match(text, m.end()))}", _POSTCODE)
        for m in _FRENCH.finditer(text, a, b):
            add(m.start(), m.end(), "french", _POSTCODE)
        for m in _SPANISH.finditer(text, a, b):
            add(m.start(), m.end(), "spanish", _POSTCODE)

    def _surname(self, word: str) -> float:
        """Log odds of an ending, the greatest over the parts of a double name."""
        if (known := self.memo.get(word)) is not None:
            return known
        best = -9.0
        for p in re.split(r"[-'’]", word.lower()):
            if len(p) > 3:
                best = max(best, self.endings.get(p[-4:], 0.0) if p[-4:] in self.endings else self.endings.get(p[-3:], -1.5) - 0.5)
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[word] = best
        return best

    def _names(self, text: str, out: list) -> None:
        for m in _RUN.finditer(text):
            run, at = m.group(), m.start()
            pieces = []
            k = 0
            for sep in _SPLIT.finditer(run):
                pieces.append((k, sep.start(), bool(sep[1])))
                k = sep.start() + len(sep[1]) + 1
            pieces.append((k, len(run), False))
            words = [run[a:b] for a, b, _ in pieces]
            bare = [re.sub(rf"^{PARTICLE}", "", w) for w in words]
            is_given = [self._given(w) for w in bare]
            odds = [self._surname(w) for w in bare]
            for i in range(len(words)):
                for j in range(i + 1, min(i + 4, len(words))):
                    commas = [pieces[q][2] for q in range(i, j)]
                    s, e = at + pieces[i][0], at + pieces[j][1]
                    if e - s > MAX_SPAN:
                        continue
                    if not any(commas):
                        if bare[i] != words[i]:
                            continue
                        initials = [len(w) == 2 and w[1] == "." for w in bare]
                        if initials[j]:
                            continue
                        middle = {"initial" if initials[q] else "given" if is_given[q] else "surname" if odds[q] > 0.5 else "other" for q in range(i + 1, j)}
                        self._name(text, s, e, "order", words[i], bare[j], initials[i], is_given[i], is_given[j], odds[i], odds[j], middle, out)
                    elif commas[0] and not any(commas[1:]):
                        if len(bare[i]) == 2 and bare[i][1] == ".":
                            continue
                        if any(not (len(bare[q]) == 2 and bare[q][1] == ".") for q in range(i + 2, j + 1)):
                            continue
                        self._name(text, s, e, "comma", bare[i + 1], bare[i], False, is_given[i + 1], is_given[i], odds[i + 1], odds[i], {"initial"} if j > i + 1 else set(), out)
        for m in _TITLED.finditer(text):
            word = re.sub(rf"^{PARTICLE}", "", m[1])
            if len(word) == 2 and word[1] == ".":
                continue
            o = self._surname(word)
            out.append((m.start(1), m.end(1), "name", ("name:titled", f"name:titled,odds={min(3, max(-3, round(o)))}", f"name:titled,given={self._given(word)}")))

    def _given(self, word: str) -> bool:
        return any(p.lower() in self.given or p.lower() in self.inferred for p in word.split("-"))

    def _name(self, text, s, e, form, first, last, initial, first_given, last_given, first_odds, last_odds, middle, out) -> None:
        left, right, before = self._around(text, s, e)
        o = min(3, max(-3, round(last_odds)))
        caller = first.lower() in self.callers and not first_given
        titled = first.lower().rstrip(".") in TITLES and not initial
        out.append((s, e, "name", (
            "name", f"name:{form}", f"name:given={first_given},initial={initial}", f"name:odds={o}", f"name:given={first_given},odds={o}", f"name:initial={initial},odds={o}",
            f"name:lastgiven={last_given}", f"name:firstodds={min(3, max(-3, round(first_odds)))}", f"name:caller={caller}", f"name:middle={','.join(sorted(middle))}", f"name:middle={','.join(sorted(middle))},given={first_given}",
            f"name:form={form},given={first_given}", f"name:left={left[-1] if left else ''}", f"name:right={right}", f"name:title={titled}", f"name:upper={last.isupper()}",
        )))

    # -- decoding --------------------------------------------------------------------------

    def decode(self, proposals: list, weights: dict[str, float]) -> list[tuple[int, int, str, tuple[str, ...]]]:
        """The set of disjoint proposals with the greatest total score."""
        w = weights.get
        scored = [(e, s, kind, f, v) for s, e, kind, f in proposals if (v := sum(w(x, 0.0) for x in f)) > 0]
        if not scored:
            return []
        scored.sort(key=lambda x: (x[0], x[1], x[2]))
        ends = [x[0] for x in scored]
        best, take = [0.0], []
        for i, (_, s, _, _, v) in enumerate(scored):
            j = bisect_right(ends, s, 0, i)
            if best[j] + v > best[i]:
                best.append(best[j] + v)
                take.append(j)
            else:
                best.append(best[i])
                take.append(-1)
        out, i = [], len(scored)
        while i:
            if take[i - 1] >= 0:
                e, s, kind, f, _ = scored[i - 1]
                out.append((s, e, kind, f))
                i = take[i - 1]
            else:
                i -= 1
        return out[::-1]

    def find(self, text: str) -> list[tuple[int, int, str]]:
        return [(s, e, kind) for s, e, kind, _ in self.decode(self.proposals(text), self.weights)]

    # -- training --------------------------------------------------------------------------

    def count_endings(self, text: str, pos: Counter, neg: Counter) -> None:
        """Endings of the words after listed given names, and of all other capitalised words."""
        named = set()
        for m in _AFTER.finditer(text):
            if all(p.lower() in self.given for p in m[1].split("-")):
                named.add(m.start(2))
                for p in re.split(r"[-'’]", m[2].lower()):
                    if len(p) > 3:
                        pos[p[-4:]] += 1
                        pos[p[-3:]] += 1
        for m in _CAPITALISED.finditer(text):
            if m.start() not in named and len(m.group()) > 3 and m.group().lower() not in self.given:
                neg[m.group().lower()[-4:]] += 1
                neg[m.group().lower()[-3:]] += 1

    def learn_endings(self, pairs: dict[str, tuple[int, int]], pos: int, neg: int) -> None:
        """pairs: both counts of each ending that stands after a listed given name; pos and neg: the totals."""
        self.endings = {k: math.log((p + 0.1) / (pos + 1) * 4) - math.log((n + 0.5) / (neg + 1)) for k, (p, n) in pairs.items()}
        self.memo.clear()

    def count_leads(self, text: str, lead_in: Counter, lead_out: Counter, calls: Counter) -> None:
        """Words before surnames, all of their places, and words before listed given names."""
        lead_out.update(w.lower() for w in _LEADING.findall(text))
        for m in _LEADS.finditer(text):
            one, two = m[1].lower(), m[2].lower()
            if two in self.given:
                calls[one] += 1
            elif one not in self.given and self._surname(m[2]) > 1:
                lead_in[one] += 1

    def learn_leads(self, words: dict[str, tuple[int, int, int]], least_calls: float) -> None:
        """Words that call a name (titles, labels, weekdays) stand before listed given names; words before
        surnames that don't, and stand there more often than elsewhere, are given names no list has."""
        self.callers = {w for w, (_, _, n) in words.items() if n >= least_calls and w not in self.given} | TITLES
        self.inferred = {w for w, (n, out, _) in words.items() if n >= 2 and n >= 0.3 * out and w not in self.callers and len(w) > 2 and self._surname(w) <= 1}

    def learn_names(self, texts: list[str]) -> list[tuple[str, set[tuple[int, int, str]]]]:
        """All of this from texts at hand; labelled lines for training."""
        pos, neg, lead_in, lead_out, calls = (Counter() for _ in range(5))
        for text in texts:
            self.count_endings(text, pos, neg)
        self.learn_endings({k: (n, neg[k]) for k, n in pos.items()}, sum(pos.values()), sum(neg.values()))
        for text in texts:
            self.count_leads(text, lead_in, lead_out, calls)
        self.learn_leads({w: (lead_in[w], lead_out[w], calls[w]) for w in lead_in.keys() | calls.keys()}, 2)
        return self.label(texts)

    def label(self, texts: list[str]) -> list[tuple[str, set[tuple[int, int, str]]]]:
        """Labelled lines for training."""
        lines = []
        for text in texts:
            for line in text.split("\n"):
                gold: set[tuple[int, int, str]] = set()
                unclear = False
                for s, e, _, f in self.proposals(line, frozenset(["name"])):
                    listed = "name:given=True,initial=False" in f or any(x.endswith(",initial=True") and x.startswith("name:given=") for x in f) or any("titled" in x for x in f)
                    surname = any(x in f for x in ("name:odds=1", "name:odds=2", "name:odds=3", "name:titled,odds=1", "name:titled,odds=2", "name:titled,odds=3"))
                    if listed and surname and "name:lastgiven=True" not in f and "name:caller=True" not in f and not any(x.startswith("name:middle=") and "other" in x for x in f):
                        gold.add((s, e, "name"))
                    elif surname:
                        unclear = True
                spans = sorted(gold)
                clash = any(a[1] > b[0] for a, b in zip(spans, spans[1:]))
                if clash:
                    # of overlapping ones the longest is the whole name
                    spans.sort(key=lambda x: x[0] - x[1])
                    chosen: list = []
                    for x in spans:
                        if all(x[1] <= y[0] or x[0] >= y[1] for y in chosen):
                            chosen.append(x)
                    gold = set(chosen)
                if gold or not unclear:
                    lines.append((line, gold))
        return lines

    def train(self, lines: list[tuple[str, set, frozenset]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> None:
        """Gradient ascent on the conditional likelihood of the labelled segmentations, with adaptive steps and
        a quadratic penalty. The gradient of a feature is its count in the labelled spans less its expectation."""
        weights: dict[str, float] = defaultdict(float)
        squares: dict[str, float] = defaultdict(lambda: 1e-8)
        cases = []
        for line, gold, types in lines:
            spans = sorted(self.proposals(line, types), key=lambda p: (p[1], p[0], p[2]))
            if not spans:
                continue
            ends, left = [p[1] for p in spans], set(gold)
            back = [bisect_right(ends, p[0], 0, i) for i, p in enumerate(spans)]
            labels = []
            for p in spans:
                labels.append(float(p[:3] in left))
                left.discard(p[:3])
            cases.append(([p[3] for p in spans], back, labels))
        rng = random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(cases)
            for features, back, labels in cases:
                scores = [sum(weights[x] for x in f) for f in features]
                for f, label, expected in zip(features, labels, marginals(scores, back)):
                    if abs(gap := label - expected) > 1e-3:
                        for x in f:
                            g = gap - decay * weights[x]
                            squares[x] += g * g
                            weights[x] += rate * g / math.sqrt(squares[x])
        self.weights = dict(weights)


def marginals(scores: list[float], back: list[int]) -> list[float]:
    """The probability of each span under all segmentations into disjoint spans. back: how many of the spans,
    sorted by their ends, end before this one starts."""
    n = len(scores)
    alpha, beta = [0.0] * (n + 1), [-math.inf] * (n + 1)
    beta[n] = 0.0
    for i in range(n):
        alpha[i + 1] = _log_add(alpha[i], alpha[back[i]] + scores[i])
    for i in range(n, 0, -1):
        beta[i - 1] = _log_add(beta[i - 1], beta[i])
        beta[back[i - 1]] = _log_add(beta[back[i - 1]], beta[i] + scores[i - 1])
    return [math.exp(min(0.0, alpha[back[i]] + scores[i] + beta[i + 1] - alpha[n])) for i in range(n)]


def _log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def longer_names(lines: list[tuple[str, set]], given: set[str], seed: int = 2, most: int = 600) -> list[tuple[str, set]]:
    """Labelled lines in which a name of two parts gets a middle name, an initial or the surname of another one."""
    rng, out = random.Random(seed), []
    two = [(line, next(iter(gold))) for line, gold in lines if len(gold) == 1]
    two = [(line, s, e) for line, (s, e, kind) in two if kind == "name" and line[s:e].count(" ") == 1 and "," not in line[s:e]]
    firsts = sorted(g.capitalize() for g in given if g.isalpha())
    rng.shuffle(two)
    for line, s, e in two[:most]:
        first, last = line[s:e].split(" ")
        other = rng.choice(two)
        extra = rng.choice([rng.choice(firsts), rng.choice("ABCDEFGHJKLMNPRST") + ".", other[0][other[1] : other[2]].split(" ")[1]]) if firsts else rng.choice("ABCDEFGHJKLM") + "."
        name = f"{first} {extra} {last}"
        out.append((line[:s] + name + line[e:], {(s, s + len(name), "name")}))
    return out


def _counts(rows: DataFrame, model: Model, count, names: list[str]) -> DataFrame:
    """(key, *names): what model.count(text, one counter for each name) counts over all texts, each task its own first."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter() for _ in names]

        def out() -> pa.RecordBatch:
            keys = list(set().union(*counters))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counters)], names=["key", *names])

        for b in source:
            for text in b.column(0).to_pylist():
                count(shared.value, text, *counters)
                if sum(map(len, counters)) > 400_000:
                    yield out()
                    for c in counters:
                        c.clear()
        yield out()

    counted = rows.select("text").mapInArrow(run, ", ".join(["key string", *(f"{n} long" for n in names)]))
    return counted.groupBy("key").agg(*(F.sum(n).alias(n) for n in names))


def fit(documents: DataFrame, id_col: str, text_col: str, given_names: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model whose surname endings, callers and given names are counted over all documents. Its weights are fitted on
    generated lines and on the lines of a sample of at most sample_docs documents of at most sample_chars characters. The list of
    given names is collected whole."""
    given = {r.given_name.lower() for r in given_names.where("given_name is not null").select("given_name").distinct().toLocalIterator()}
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = documents.count()
    sample = sorted(hash_sample(texts.where(F.char_length("text") <= sample_chars), "id", total, sample_docs).collect())[:sample_docs]
    model = Model(given)
    endings = materialize(_counts(texts, model, Model.count_endings, ["p", "n"]), "endings")
    sums = endings.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    model.learn_endings({r.key: (r.p, r.n) for r in endings.where("p > 0").toLocalIterator()}, sums.p or 0, sums.n or 0)
    # a word calls names from the same frequency on at any size
    least_calls = max(2.0, 2.0 * total / SAMPLE_DOCS)
    leads = _counts(texts, model, Model.count_leads, ["lead_in", "lead_out", "calls"]).where((F.col("calls") >= least_calls) | ((F.col("lead_in") >= 2) & (F.col("lead_in") >= 0.3 * F.col("lead_out"))))
    model.learn_leads({r.key: (r.lead_in, r.lead_out, r.calls) for r in leads.toLocalIterator()}, least_calls)
    model.train(training_lines(model, model.label([r.text for r in sample])))
    model.memo.clear()
    return model


def training_lines(model: Model, names: list[tuple[str, set]]) -> list[tuple[str, set, frozenset]]:
    """The labelled lines with names, as many quiet ones as go with them, names made longer, and the generated lines."""
    quiet = [x for x in names if not x[1]]
    random.Random(1).shuffle(quiet)
    named = [x for x in names if x[1]]
    lines = [*named, *longer_names(named, model.given), *quiet[: 4 * len(named) + 500]]
    return [(line, gold, frozenset(["name"])) for line, gold in lines] + generated_lines()


def personal_places(documents: DataFrame, id_col: str, text_col: str, given_names: DataFrame) -> DataFrame:
    """(id, start_char, end_char, pii_type) of each place, in code points from 0.

    Null and empty texts have none. Repeated rows give repeated places. Whole texts are read, also very long ones.
    """
    model = fit(documents, id_col, text_col, given_names)
    return _apply(documents, id_col, text_col, model, "start_char int, end_char int, pii_type string",
                  lambda i, text, spans: [(i, *x) for x in spans], [pa.int32(), pa.int32(), pa.string()], ["start_char", "end_char", "pii_type"])


def masked(documents: DataFrame, id_col: str, text_col: str, given_names: DataFrame) -> DataFrame:
    """(id, text, n_places): the text with a typed placeholder for each place and otherwise unchanged;
    null stays null."""
    model = fit(documents, id_col, text_col, given_names)

    def replace(i, text: str | None, spans) -> list[tuple]:
        if text is None:
            return [(i, None, 0)]
        out, at = [], 0
        for s, e, kind in spans:
            out.append(text[at:s] + PLACEHOLDER[kind])
            at = e
        return [(i, "".join(out) + text[at:], len(spans))]

    return _apply(documents, id_col, text_col, model, "text string, n_places int", replace, [pa.string(), pa.int32()], ["text", "n_places"])


def _apply(documents: DataFrame, id_col: str, text_col: str, model: Model, schema: str, rows, kinds: list, names: list[str]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)  # weights and lists of a bounded sample
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in source:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.extend(rows(i, text, m.find(text) if text else []))
                if len(out) >= 5000:
                    yield pack(b, out)
                    out = []
            yield pack(b, out)

    def pack(b: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * (len(kinds) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, *kinds])], names=["id", *names])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, {schema}")
