"""Repair of text from scanned pages: running headers, page numbers, cut words, misread characters.

Furniture. Lines that look like a title are compared within their file by their skeleton (below) with numbers masked and page
numbers cut off. Equal ones, or such as differ by a character and by spaces, make each other running headers; that is found
by grouping what is left of titles that lose a character, never by pairs of titles. Number
lines in any of the usual styles are page numbers; bare numbers from 1000 on need a neighbour of the
sequence close by, since tables break into lines of bare numbers too.

Words. All words of the corpus are counted. Frequent forms (a relative frequency
bounds their number) are grouped by skeleton, in which glyphs that scanners confuse are the same. A
word is misread where its group has a far more frequent form that the neighbouring words support at least
as well, or where it becomes a known prefix and a frequent word by undoing one confusion. How often the word itself stands in the corpus
is known exactly however rare it is, and so is, for the words in question, how often they and their forms stand beside
their neighbours: these pairs are counted over all texts and joined to the lines.

Cut words. A word at the end of a line and the first word of the next body line are joined, also across
page furniture and chunks. The mark stays where the corpus knows the hyphenated form better.

Reflow. SQL windows over blocks of a file give each line its predecessor and successor and the
paragraph it belongs to. No window holds more than BLOCK chunks of a file; what a block needs of the one before or after
is taken from one row a block, so that the size of the blocks decides nothing. Only a paragraph that runs on over a whole block is cut.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .near_duplicates import Filter

BLOCK = 4096
# Glyphs that scanners confuse. Single characters share a class; pairs stand for one letter, or one glyph for a pair.
CLASSES = {"c": "e", "f": "t", "@": "a", "0": "o", "l": "i", "1": "i", "|": "i", "5": "s", "b": "h", "6": "h", "9": "g"}
PAIRS = {"ri": "n", "cl": "d", "ii": "u", "rn": "m", "vv": "w", "d": "cl", "m": "rn", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}
_CLASS = str.maketrans(CLASSES)
MARKS = "-¬­‐"
_WORD = re.compile(rf"[^\W_]+(?:[-@|][^\W_]+)*")
_END = re.compile(rf"[{MARKS}][ \t\r]*(?:\n\s*|$)")
LEAST_SHARE = 2e-6


def skeleton(word: str) -> str:
    return word.translate(_CLASS)


def whole_words(text: str) -> list[str]:
    """The words of a text in lower case, without those that a line end cuts in two."""
    text = text.lower()
    if not _END.search(text):
        return _WORD.findall(text)
    out, at = [], 0
    for m in _END.finditer(text):
        if m.start() < at:
            continue
        k = max(text.rfind(" ", at, m.start()), text.rfind("\n", at, m.start()), at)
        out += _WORD.findall(text, at, k)
        after = re.compile(r"\S*").match(text, m.end())
        at = after.end()
    return out + _WORD.findall(text, at)


def readings(word: str) -> list[str]:
    """The word itself and the word with one pair of glyphs read as the letter it looks like, or the reverse."""
    out = [word]
    for pair, letter in PAIRS.items():
        at = word.find(pair)
        while at >= 0:
            out.append(word[:at] + letter + word[at + len(pair) :])
            at = word.find(pair, at + 1)
    return out


_M64, _STEP, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


_KEYS: dict[str, int] = {}


def _word_key(word: str) -> int:
    key = _KEYS.get(word)
    if key is None:
        if len(_KEYS) > 500_000:
            _KEYS.clear()
        key = _KEYS[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return key


def pair_key(a: str, b: str) -> int:
    """A signed 64-bit hash of two neighbouring words."""
    x = (_word_key(a) * _STEP + _word_key(b)) & _M64
    x = ((x ^ (x >> 32)) * _MIX) & _M64
    x ^= x >> 29
    return x - (1 << 64) if x >> 63 else x


def pair_keys(words: list[str]) -> np.ndarray:
    """pair_key() of each two neighbours, unsigned."""
    known = _KEYS.get
    h = np.array([known(w) or _word_key(w) for w in words], np.uint64)
    x = h[:-1] * np.uint64(_STEP) + h[1:]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


class Lexicon:
    """Frequent forms of the corpus by skeleton and productive prefixes. rare: how often a word that isn't frequent, but may be taken for
    a frequent form, stands in the corpus, where that is three times or more."""

    def __init__(self, counts: dict[str, int], rare: dict[str, int] | None = None):
        self.counts, self.rare = counts, rare or {}
        self.forms: dict[str, list[str]] = defaultdict(list)
        for w in counts:
            if w.isalpha() and len(w) > 1:
                self.forms[skeleton(w)].append(w)
        rests: dict[str, set[str]] = defaultdict(set)
        for w in counts:
            for cut in range(2, len(w) - 3):
                if w[cut:] in counts and counts[w[cut:]] >= counts[w]:
                    rests[w[:cut]].add(w[cut:])
        self.prefixes = {p for p, r in rests.items() if len(r) >= 12 and p.isalpha()}
        self.prefix_forms: dict[str, list[str]] = defaultdict(list)
        for p in self.prefixes:
            self.prefix_forms[skeleton(p)].append(p)
        self.heads = {w.split("-")[0] for w in counts if "-" in w}
        self.memo: dict[str, tuple[list[str], str | None]] = {}

    def own(self, word: str) -> int:
        return self.counts.get(word) or self.rare.get(word, 0)

    def compound(self, word: str) -> bool:
        return any(word[:c] in self.prefixes and word[c:] in self.counts for c in range(2, len(word) - 3))

    def _choices(self, word: str) -> tuple[list[str], str | None]:
        """(frequent forms the word may stand for, the compound it may stand for), kept for each word."""
        if (known := self.memo.get(word)) is not None:
            return known
        forms, compound = [], None
        if len(word) > 1 and not word.isdigit():
            own, alien, reads = self.own(word), not word.isalpha(), readings(word)
            least = 2 * own + 1 if alien else max(20 * own, 1)
            forms = list(dict.fromkeys(f for r in reads for f in self.forms.get(skeleton(r), ()) if f != word and self.counts[f] >= least))
            if not forms and (alien or not own) and len(word) > 4 and (alien or not self.compound(word)):
                best = 0
                for r in reads:
                    for cut in range(2, len(r) - 3):
                        heads = self.prefix_forms.get(skeleton(r[:cut]), ())
                        for form in self.forms.get(skeleton(r[cut:]), ()) if heads else ():
                            for head in heads:
                                if self.counts[form] > best and head + form != word:
                                    compound, best = head + form, self.counts[form]
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[word] = forms, compound
        return forms, compound

    def right_form(self, word: str, before: str, after: str, context: dict[int, int] = {}) -> str | None:
        """The form that a lower-case word was misread from, or None where it seems right. context: how often pairs of
        neighbours stand in the corpus."""
        forms, compound = self._choices(word)
        if not forms:
            return compound
        own, alien = self.own(word), not word.isalpha()
        beside = lambda w: (context.get(pair_key(before, w), 0) if before else 0) + (context.get(pair_key(w, after), 0) if after else 0)
        # the pairs of this place don't speak for the word
        against = max(0, beside(word) - bool(before) - bool(after))
        best, best_score = None, 0.0
        for form in forms:
            n, support = self.counts[form], beside(form)
            if (alien or support > against or (support == against and (own < 3 or n >= 200 * own))) and n * (1 + support) > best_score:
                best, best_score = form, n * (1 + support)
        return best

    def in_question(self, line: str) -> Iterator[tuple[str, str]]:
        """The pairs of neighbours that right_form() asks for in a line."""
        lows = [w.lower() for w in _WORD.findall(line)]
        for k, low in enumerate(lows):
            parts = low.split("-")
            for p, part in enumerate(parts):
                forms = self._choices(part)[0]
                for w in (part, *forms) if forms else ():
                    if p == 0 and k:
                        yield lows[k - 1], w
                    if p == len(parts) - 1 and k + 1 < len(lows):
                        yield w, lows[k + 1]


def build_lexicon(texts: DataFrame, text_col: str) -> Lexicon:
    """Counts over all texts, each counted within its task before anything is shuffled. Frequent is a form with a share of LEAST_SHARE
    or more of all words, of which there are 1 / LEAST_SHARE at most. (A form must stand twenty times as often as what is
    taken for it, so one that stands once or twice needs no place.)"""
    rows = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            for w in [w for w in counter if "-" in w]:
                for part in w.split("-"):
                    counter[part] += counter[w]
            return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], names=["w", "n"])

        for b in source:
            for text in b.column(0).to_pylist():
                counter.update(whole_words(text))
            if len(counter) > 400_000:
                yield out()
                counter.clear()
        yield out()

    counted = materialize(rows.mapInArrow(words, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(3.0, LEAST_SHARE * total)
    lexicon = Lexicon({r.w: r.n for r in counted.where(F.col("n") >= least).toLocalIterator()})
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def confusable(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            words, n = b.column(0).to_pylist(), b.column(1)
            keep = [k for k, w in enumerate(words) if any(skeleton(r) in shared.value.forms for r in readings(w))]
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in keep], pa.string()), n.take(pa.array(keep, pa.int64()))], names=["w", "n"])

    between = counted.where((F.col("n") >= 3) & (F.col("n") < least))
    lexicon.rare = {r.w: r.n for r in between.mapInArrow(confusable, "w string, n long").toLocalIterator()}
    return lexicon


def context_counts(lines: DataFrame, texts: DataFrame, text_col: str, lexicon: Lexicon) -> DataFrame:
    """(id, line_no, context): for each line with words in question, how often the pairs of neighbours that matter stand in all texts."""
    shared = lines.sparkSession.sparkContext.broadcast(lexicon)

    def ask(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            at, keys = [], []
            for k, line in enumerate(b.column(2).to_pylist()):
                found = {pair_key(x, y) for x, y in shared.value.in_question(line)}
                at += [k] * len(found)
                keys += found
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(keys, pa.int64())], names=["id", "line_no", "class"])

    asked = materialize(lines.select("id", "line_no", "line").mapInArrow(ask, f"id {lines.schema['id'].dataType.simpleString()}, line_no int, class long"), "asked")
    wanted = Filter(asked)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["class", "n"])

        for b in source:
            words, ends = [], []  # of all texts of a batch, with a mark after each text
            for text in b.column(0).to_pylist():
                words += whole_words(text)
                ends.append(len(words))
                words.append("")
            keys, within = pair_keys(words), np.ones(max(len(words) - 1, 0), bool)
            at = np.array(ends, np.int64)
            within[at[at > 0] - 1] = False
            within[at[at < len(within)]] = False
            keys = keys[within]
            held.append(keys[wanted.holds(keys)])
            size += len(held[-1])
            if size > 2_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    met = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n"))
    return asked.join(met, "class").groupBy("id", "line_no").agg(F.collect_list(F.struct("class", "n")).alias("context"))


def scanned_lines(chunks: DataFrame, files: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(file_id, chunk_index, id, line_no, line, last) of the chunks of files with this suffix, split at
    line feeds. Repeated rows of chunks and files count once; null contents have no lines."""
    wanted = files.where(F.lower("path").endswith(suffix)).select(F.col("id").alias("file_id")).distinct()
    rows = chunks.where(F.col("content").isNotNull()).select("id", "file_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), "content")
    rows = rows.join(wanted, "file_id", "left_semi").dropDuplicates(["id"])  # a file with very many chunks is split by AQE's skew join
    split = rows.select("file_id", "chunk_index", "id", F.split("content", "\n", -1).alias("all"))
    return split.select("file_id", "chunk_index", "id", F.size("all").alias("n"), F.posexplode("all").alias("line_no", "line")).select("file_id", "chunk_index", "id", (F.col("line_no") + 1).alias("line_no"), "line", (F.col("line_no") + 1 == F.col("n")).alias("last"))


# The ways in which page numbers are written; 9 stands for digits, also misread ones.
DIGITS = "[0-9lIOoSsB]{1,4}"
STYLED = rf"(?i)^(?:-{{2,}}\s*(?:page|seite|página|pagina)\s+{DIGITS}\s*-{{2,}}|(?:page|seite|página|pagina|pag\.|pág\.|p\.|s\.)\s*{DIGITS}(?:\s*(?:/|of|von|de|sur)\s*{DIGITS})?|[-–—~•|·*]+\s*{DIGITS}\s*[-–—~•|·*]+|[\[(<]\s*{DIGITS}\s*[\])>]|{DIGITS}\s*/\s*{DIGITS})$"
ROMAN = r"(?i)^(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
BARE = r"^[0-9lIO]{1,4}$"
SMALL_WORDS = r"(?:^|[ .])\p{Ll}[^ .]*[ .](?:.*[ .])?\p{Ll}"
TITLE_NUMBER = rf"^{DIGITS}\s{{2,}}|\s{{2,}}{DIGITS}$|^(?:[0-9]{{1,4}})\s*[|·–-]\s+|\s+[|·–-]\s*(?:[0-9]{{1,4}})$"


def title_skeleton(title):
    """Lower case, numbers masked, and glyphs that scanners confuse made the same."""
    return _same_glyphs(F.regexp_replace(F.lower(title), r"(?<![\p{L}0-9])[0-9]+(?![\p{L}0-9])", "#"))


def _same_glyphs(text):
    for pair, letter in sorted(PAIRS.items(), key=lambda x: x[0] == "ri"):  # ri comes last, for ii and rn share its letters
        if len(pair) >= len(letter):
            text = F.replace(text, F.lit(pair), F.lit(letter))
    return F.translate(text, "".join(CLASSES), "".join(CLASSES.values()))


def near_title_marks(key):
    """Hashes that two titles share if they differ by a character, spaces aside: the title without its spaces, and that without
    one of its characters."""
    whole = _same_glyphs(F.replace(key, F.lit(" "), F.lit("")))
    without = F.transform(F.sequence(F.lit(1), F.length(whole)), lambda k: F.xxhash64(F.concat(F.substring(whole, F.lit(1), k - 1), whole.substr(k + 1, F.length(whole)))))
    return F.array_distinct(F.concat(without, F.array(F.xxhash64(whole))))


def furniture(lines: DataFrame) -> DataFrame:
    """(id, line_no, noise) of headers and page numbers."""
    short = (
        # body text shows itself by its second word in small letters, before anything else is worked out
        lines.where((F.length("line") <= 120) & ((F.length(F.trim("line")) <= 30) | ~F.col("line").rlike(SMALL_WORDS)))
        .select("file_id", "chunk_index", "id", "line_no", F.trim(F.regexp_replace("line", r"[\r\t ]+", " ")).alias("s"), F.trim(F.regexp_replace("line", "[\r\t]", "  ")).alias("raw"))
        .where("length(s) between 1 and 80")
        .withColumn("styled", (F.length("s") <= 30) & F.col("s").rlike("[0-9lIOS]") & F.col("s").rlike(STYLED))
        .withColumn("number", (F.length("s") <= 10) & (F.col("s").rlike(BARE) | F.col("s").rlike(ROMAN)))
        .withColumn("open", ~F.substring("s", -1, 1).isin(*".;:!?,") & (F.length("s") >= 6) & ~F.col("styled") & ~F.col("number"))
        .where("styled or number or open")
        .withColumn("t", F.when(F.col("open"), F.regexp_replace(F.trim(F.regexp_replace("raw", TITLE_NUMBER, "")), r"\s+", " ")))
        .withColumn("words", F.split("t", r"[ .]"))
        .withColumn("small", F.size(F.filter("words", lambda w: w.rlike(r"^\p{Ll}"))))
        # titles: every word starts with a capital or a glyph that isn't a letter, or all but one do
        .withColumn("title", F.coalesce(F.col("open") & (F.length("t") >= 6) & (F.col("small") <= F.when(F.size("words") >= 3, 1).otherwise(0)) & F.col("t").rlike(r"\p{L}{3}") & ~F.col("t").rlike(r"^[^,]*\p{L} [0-9]+, [0-9]"), F.lit(False)))
        .where("styled or number or title")
        .select("file_id", "chunk_index", "id", "line_no", "s", "t", "styled", "number", "title")
    )
    short = materialize(short, "short")  # the few lines that all below is about
    styled, numbers = short.where("styled"), short.where("number")
    digits = F.translate("s", "lIO", "110")
    roman = lambda c, n: (F.length("s") - F.length(F.regexp_replace(F.lower("s"), c, ""))) * n
    low = F.lower("s")
    minus = F.when(low.contains("iv") | low.contains("ix"), 2).otherwise(0) + F.when(low.contains("xl") | low.contains("xc"), 20).otherwise(0)
    plain = F.col("s").rlike("[0-9]")
    value = F.when(F.col("s").rlike(BARE) & (plain | ~F.col("s").rlike(ROMAN)), digits.try_cast("int")).otherwise(roman("i", 1) + roman("v", 5) + roman("x", 10) + roman("l", 50) + roman("c", 100) - minus)
    numbers = numbers.withColumn("v", value).withColumn("roman", ~plain & F.col("s").rlike(ROMAN)).where(F.col("v").isNotNull())
    # a number meets those of its stretch of twelve chunks and the two beside it, not all of its file
    numbers = numbers.withColumn("stretch", F.floor(F.col("chunk_index") / 12).cast("int"))
    near = (
        numbers.select("file_id", "roman", F.col("chunk_index").alias("c2"), "v", F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)).alias("stretch"))
        .select("file_id", "roman", "c2", "stretch", F.explode(F.array(F.col("v") - 1, F.col("v") + 1)).alias("v")).distinct()
    )
    joined = numbers.join(near, ["file_id", "roman", "v", "stretch"], "left").where(F.col("c2").isNull() | (F.abs(F.col("c2") - F.col("chunk_index")) <= 12))
    supported = joined.groupBy("id", "line_no").agg(F.count("c2").alias("n"))
    sequence = numbers.join(supported, ["id", "line_no"], "left").where((F.coalesce("n", F.lit(0)) > 0) | F.when(F.col("roman"), F.col("v") <= 50).otherwise(plain & (F.col("v") < 1000)))
    titled = short.where("title").withColumn("key", title_skeleton(F.col("t")))
    times = titled.groupBy("file_id", "key").agg(F.count(F.lit(1)).alias("n"))
    marks = times.select("file_id", "key", F.explode(near_title_marks(F.col("key"))).alias("mark"))
    shared = marks.groupBy("file_id", "mark").agg((F.min("key") != F.max("key")).alias("several")).where("several").select("file_id", "mark")
    alike = marks.join(shared, ["file_id", "mark"], "left_semi").select("file_id", "key")
    headers = titled.join(times.where("n > 1").select("file_id", "key").unionByName(alike).distinct(), ["file_id", "key"], "left_semi")
    found = (
        styled.select("id", "line_no", F.lit("page_number").alias("noise"))
        .unionByName(sequence.select("id", "line_no", F.lit("page_number").alias("noise")))
        .unionByName(headers.select("id", "line_no", F.lit("header").alias("noise")))
    )
    return found.groupBy("id", "line_no").agg(F.max("noise").alias("noise"))


def _cut_in_two(line: str) -> tuple[str, str] | None:
    """(word part, mark) where a line ends in a word with a mark of division."""
    s = line.rstrip(" \t\r")
    if len(s) < 2 or s[-1] not in MARKS or not (s[-2].isalnum() or s[-2] == "@"):
        return None
    k = len(s) - 1
    while k and (s[k - 1].isalnum() or s[k - 1] in "@|"):
        k -= 1
    return s[k:-1], s[-1]


def _first_word(line: str) -> str:
    m = _WORD.search(line)
    return m.group() if m and not line[: m.start()].strip() else ""


def mend_line(line: str, before: str | None, after: str | None, lexicon: Lexicon, context: dict[int, int] = {}) -> tuple[set[str], str, bool]:
    """(noises, repaired line, whether it takes the first word of the next line). before and after are the
    neighbouring body lines. Where the line before was cut, its first word is dropped, as that line has it."""
    noises: set[str] = set()
    line = line.rstrip("\r")
    cut = _cut_in_two(line)
    rest = _first_word(after) if cut and after is not None else ""
    if cut and not rest:
        # the text ends here: only the first part of a known compound keeps its mark
        if not (cut[1] in "-‐" and cut[0].lower() in lexicon.heads) and cut[0].isalpha():
            noises.add("hyphen")
        cut = None
    came = _cut_in_two(before) if before is not None else None
    came_word = _first_word(line) if came else ""
    spans = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(line)]
    if came and came_word and spans:
        spans[0] = (spans[0][0], spans[0][1], "")
    end = len(line.rstrip(" \t\r"))
    if cut and spans and spans[-1][1] >= end - 1:
        spans[-1] = (spans[-1][0], spans[-1][1], "")
    out, at = [], 0
    lows = [w.lower() for _, _, w in spans]
    for k, (s, e, w) in enumerate(spans):
        if not w:
            continue
        parts = w.split("-")
        done = []
        for p, part in enumerate(parts):
            low = part.lower()
            prev = lows[k - 1] if p == 0 and k else ""
            nxt = lows[k + 1] if p == len(parts) - 1 and k + 1 < len(lows) else ""
            form = lexicon.right_form(low, prev, nxt, context)
            if form:
                noises.add("misread")
                part = form.upper() if part.isupper() and len(part) > 1 else form.capitalize() if part[:1].isupper() else form
            done.append(part)
        out.append(line[at:s] + "-".join(done))
        at = e
    tail = line[at:]
    if cut:
        part, mark = cut
        whole, rest_low = (part + rest).lower(), rest.lower()
        hyphenated = lexicon.counts.get(f"{part.lower()}-{rest_low.split('-')[0]}", 0)
        keeps = mark in "-‐" and (hyphenated > lexicon.counts.get(whole, 0) or f"{part}{rest}".isdigit())
        stem = rest_low.split("-")[0]
        form = None if keeps else lexicon.right_form(part.lower() + stem, "", "")
        if form and not form.startswith(part.lower()):  # else the wrong character is in the next line
            noises.add("misread")
        if not keeps:
            noises.add("hyphen")
        mended = f"{part}-{rest}" if keeps else (form.capitalize() if part[:1].isupper() else form) + rest[len(stem):] if form else part + rest
        tail = tail[: len(tail.rstrip(" \t\r")) - len(part) - 1] + mended if tail.rstrip(" \t\r").endswith(part + mark) else tail.rstrip(" \t\r")[:-1] + mended[len(part):]
        follow = after[after.find(rest) + len(rest):] if rest else ""
        m = re.match(r"[^\s\w]+", follow)
        tail += m.group() if m else ""
    body = "".join(out) + tail
    if came and came_word:
        # the word's first part decides whether a wrong character lies here
        part, mark = came
        stem = came_word.lower().split("-")[0]
        if not (mark in "-‐" and lexicon.counts.get(f"{part.lower()}-{stem}", 0) > lexicon.counts.get(part.lower() + stem, 0)):
            form = lexicon.right_form(part.lower() + stem, "", "")
            if form and not form.endswith(stem):
                noises.add("misread")
        k = body.find(came_word)
        body = re.sub(r"^[^\s\w]+", "", body[k + len(came_word):]).lstrip()
    return noises, body, bool(cut)


def _body(lines: DataFrame, marks: DataFrame, context: DataFrame, block: int = BLOCK) -> DataFrame:
    """Body lines with the lines before and after them in their file, whether blank lines precede them, and
    para, where their paragraph starts: (block, chunk_index, id, line_no)."""
    info = marks.select("id", "line_no", "noise").join(context, ["id", "line_no"], "full_outer")
    kept = lines.join(info, ["id", "line_no"], "left").where(F.col("noise").isNull()).drop("noise")
    # the last element after the split of a chunk that ends in a line feed isn't a line
    kept = kept.where((F.col("line") != "") | ~F.col("last")).withColumn("block", F.floor(F.col("chunk_index") / block).cast("int")).withColumn("blank", F.trim(F.regexp_replace("line", "[\r\t]", " ")) == "")
    kept = kept.select("file_id", "block", "chunk_index", "id", "line_no", "line", "blank", "context").repartition("file_id", "block")
    place = F.struct("chunk_index", "id", "line_no")
    order = Window.partitionBy("file_id", "block").orderBy("chunk_index", "id", "line_no")
    # one row a block: its first and last body line, and whether it ends blank
    edges = kept.groupBy("file_id", "block").agg(
        F.min_by(F.when(~F.col("blank"), F.col("line")), F.when(~F.col("blank"), place)).alias("first"), F.max_by(F.when(~F.col("blank"), F.col("line")), F.when(~F.col("blank"), place)).alias("last"), F.max_by("blank", place).alias("ends_blank")
    )
    along = Window.partitionBy("file_id").orderBy("block")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select("file_id", "block", F.last("last", True).over(earlier).alias("came"), F.first("first", True).over(later).alias("comes"), F.lag("ends_blank").over(along).alias("came_blank"))
    body = kept.withColumn("gap", F.lag("blank").over(order)).where(~F.col("blank"))
    body = body.withColumn("before", F.lag("line").over(order)).withColumn("after", F.lead("line").over(order)).join(edges, ["file_id", "block"])
    return body.select("file_id", "block", "chunk_index", "id", "line_no", "line", F.coalesce("gap", "came_blank", F.lit(True)).alias("gap"), F.coalesce("before", "came").alias("before"), F.coalesce("after", "comes").alias("after"), "context")


def _numbered(body: DataFrame) -> DataFrame:
    """With para: where a line's paragraph starts in its block, null for lines that go on from the block before."""
    starts = (F.col("gap") & ~F.coalesce(F.col("before").rlike(rf"[{MARKS}][ \t\r]*$"), F.lit(False))) | F.col("line").rlike(r"^\s{2,}\S") | F.col("before").isNull()
    order = Window.partitionBy("file_id", "block").orderBy("chunk_index", "id", "line_no")
    start = F.when(starts, F.struct("chunk_index", "id", "line_no"))
    return body.withColumn("para", F.last(start, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _joined_blocks(pieces: DataFrame) -> DataFrame:
    """Paragraphs of (file_id, block, para, first_id, first_line, text): what goes on from the block before is put to its last
    paragraph. There is one such piece a block at most, and none where a block has no start before it."""
    last = pieces.groupBy("file_id", "block").agg(F.max("para").alias("last"))
    carried = last.select("file_id", "block", F.lag("last").over(Window.partitionBy("file_id").orderBy("block")).alias("to"))
    heads = pieces.where("para is null").join(carried, ["file_id", "block"])
    more = heads.where("to is not null").select("file_id", F.col("to").alias("para"), F.col("text").alias("more"))
    whole = pieces.where("para is not null").join(more, ["file_id", "para"], "left")
    whole = whole.select("file_id", "first_id", "first_line", F.array_join(F.filter(F.array("text", "more"), lambda t: t != ""), " ").alias("text"))
    return whole.unionByName(heads.where("to is null").select("file_id", "first_id", "first_line", "text"))


def _mended(body: DataFrame, lexicon: Lexicon, schema: str, rows) -> DataFrame:
    shared = body.sparkSession.sparkContext.broadcast(lexicon)

    def mend(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            yield rows(b, shared.value)

    return body.mapInArrow(mend, schema)


def _prepared(chunks: DataFrame, files: DataFrame, suffix: str, block: int) -> tuple[Lexicon, DataFrame, DataFrame]:
    """(lexicon, furniture, body lines)."""
    lexicon = build_lexicon(chunks, "content")
    lines = materialize(scanned_lines(chunks, files, suffix), "lines")
    marks = materialize(furniture(lines), "furniture")
    context = materialize(context_counts(lines, chunks, "content", lexicon), "context")
    return lexicon, marks, _body(lines, marks, context, block)


def _context(rows: list | None) -> dict[int, int]:
    return {r["class"]: r["n"] for r in rows} if rows else {}


def noise_places(chunks: DataFrame, files: DataFrame, suffix: str = ".pdf", block: int = BLOCK) -> DataFrame:
    """(id, line_no, noise) of all noise; see TESTDATA.md for its kinds.

    Nulls in content or path: no rows. Repeated rows count once. Empty tables give an empty result.
    Words are counted over all chunks, also those of other files. Extra columns are not read.
    """
    lexicon, marks, body = _prepared(chunks, files, suffix, block)

    def rows(b: pa.RecordBatch, lex: Lexicon) -> pa.RecordBatch:
        out: list[tuple] = []
        for i, n, line, before, after, context in zip(*(c.to_pylist() for c in b.columns)):
            for noise in sorted(mend_line(line, before, after, lex, _context(context))[0]):
                out.append((i, n, noise))
        cols = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["id", "line_no", "noise"])

    body = body.select(F.col("id").cast("long").alias("id"), "line_no", "line", "before", "after", "context")
    return marks.select(F.col("id").cast("long").alias("id"), "line_no", "noise").unionByName(_mended(body, lexicon, "id long, line_no int, noise string", rows))


def paragraphs(chunks: DataFrame, files: DataFrame, suffix: str = ".pdf", block: int = BLOCK) -> DataFrame:
    """(file_id, first_id, first_line, text): the repaired paragraphs, with the chunk and the line they
    start in. A paragraph starts after a blank line and at an indented line; one that runs on over a whole block of chunks is cut at blocks."""
    lexicon, _, body = _prepared(chunks, files, suffix, block)

    def rows(b: pa.RecordBatch, lex: Lexicon) -> pa.RecordBatch:
        text = [mend_line(line, before, after, lex, _context(context))[1].strip() for line, before, after, context in zip(*(b.column(k).to_pylist() for k in (6, 7, 8, 9)))]
        return pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(text, pa.string())], names=["file_id", "block", "para", "chunk_index", "id", "line_no", "text"])

    numbered = _numbered(body).select("file_id", "block", "para", "chunk_index", "id", "line_no", "line", "before", "after", "context")
    kind = numbered.schema["para"].dataType.simpleString()
    mended = _mended(numbered, lexicon, f"file_id long, block int, para {kind}, chunk_index int, id long, line_no int, text string", rows)
    pieces = (
        mended.groupBy("file_id", "block", "para")
        .agg(F.sort_array(F.collect_list(F.struct("chunk_index", "id", "line_no", "text"))).alias("parts"))
        .select("file_id", "block", "para", F.col("parts")[0]["id"].alias("first_id"), F.col("parts")[0]["line_no"].alias("first_line"),
                F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""), " ").alias("text"))
    )
    return _joined_blocks(materialize(pieces, "pieces"))
