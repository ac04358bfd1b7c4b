"""Sentence boundaries across languages and scripts.

Document-centred disambiguation: whether a period ends a sentence depends on
whether the token before it is an abbreviation, and that is read off
unambiguous occurrences - the same token before a lower case letter, a digit, or without
a period - first in the document itself, then in statistics of the whole corpus. In
the same way words that open paragraphs tell which words start a sentence, and
words that follow a day number tell ordinals. Scripts bring their own rules:
full-width terminators and dandas end a sentence without a blank, Thai
sentences end at blanks between Thai words.

Two scans of the corpus: one gathers counts (summed with partial aggregates), one cuts. No text is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..ship import ship

# Marks of the scripts covered.
HARD = "。！？｡؟۔।॥"
SOFT = ".!?…"
OPENERS = {"“": "”", "„": "“”", "«": "»", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】", "‘": "’"}
BRACKETS = "([（【"
CLOSERS = "”»)]）」』】’\"'"
BLANK = " \t   -​  　﻿\r\n\x0b\x0c\x85  "

PARAGRAPH = re.compile(rf"(?:\r\n|[\n\r\x85 ])[ \t 　]*(?:\r\n|[\n\r\x85 ])[{BLANK}]*| [{BLANK}]*")
SPACES = re.compile(f"[{BLANK}]+")
CLOSED_BY = {c: "".join(o for o, ends in OPENERS.items() if c in ends) for c in "".join(OPENERS.values())}
PAIRED = re.compile("[" + re.escape("".join(OPENERS) + "".join(OPENERS.values()) + "\"'") + "]")
MARKER = re.compile(rf"(?:\d{{1,2}}[.)]|[•‣◦·*–—-])[{BLANK}]+")
TOKEN = re.compile(rf"[^{BLANK}(\[（“„«‘\"'「『]*$")
PERIOD = re.compile(rf"(?<![^{BLANK}(\[（“„«‘\"'])([^{BLANK}(\[（“„«‘\"'.]{{1,24}}(?:\.[^{BLANK}.]{{1,3}})*)\.[{BLANK}]+([“„«\"'(\[¿¡]*)([^{BLANK}.,;:!?]+)")
WORD = re.compile(rf"[^{BLANK}.,;:!?…“”„«»()\[\]\"'¿¡]+")
THAI = "฀-๿"
CJK = "぀-ヿ㐀-䶿一-鿿"
HAS_THAI = re.compile(f"[{THAI}]")
HAS_CJK = re.compile(f"[{CJK}]")
TERMINATORS = re.compile(f"[{HARD}{re.escape(SOFT)}]+")
LINE_BREAK = re.compile(r"\r\n|[\n\r\x85 ]")
AFTER_MARK = re.compile(rf"[!?][{BLANK}]+([^{BLANK}.,;:!?“”„«»()\[\]\"'¿¡]+)")
AFTER_STOP = re.compile(rf"[。！？]([{CJK}]{{2}})")
THAI_START = re.compile(rf"[{THAI}][{BLANK}]+([{THAI}]{{5}})")
#: Words of up to five letters without a period after them.
PLAIN = re.compile(rf"(?<![^{BLANK}.,;:!?…“”„«»()\[\]\"'¿¡])[^{BLANK}.,;:!?…“”„«»()\[\]\"'¿¡]{{1,5}}(?![^{BLANK},;:!?…“”„«»()\[\]\"'¿¡])")
THAI_GAP = re.compile(rf"(?<=[^{BLANK}])[{BLANK}]+(?=[^{BLANK}])")
LATIN_THAI = re.compile(rf"([A-Za-z][\w.-]*)[{BLANK}]+([{THAI}]{{1,5}})")
#: Three Latin words in a row after Thai are no name or measure but text of their own.
LATIN_RUN = re.compile(rf"(?:[A-Za-z][\w.,'-]*[{BLANK}]+){{3}}")
INTRODUCES = re.compile(f"[^{HARD}!?]{{0,40}}?[:：][{BLANK}]*[“„«「『\"]")
CAMEL = re.compile(r"[a-z]{1,2}[A-Z]")
#: A word after a quotation that ended with a terminator; a clause there without marks in it; the character before a colon and a quotation.
AFTER_QUOTE = re.compile(rf"[{SOFT}؟!?][”»\"][{BLANK}]+([^{BLANK}.,;:!?…“”„«»()\[\]\"'¿¡]+)")
CLAUSE = re.compile(rf"[^{BLANK}，。：:！？]{{1,24}}")
INTRO = re.compile(rf"([{CJK}])[:：][{BLANK}]*[“「『]")

#: A word enters the lists of its kind from this part of all counts of the kind (so a list has at
#: most 1/SHARE entries, whatever the size of the corpus) and from LEAST occurrences. Abbreviations need LEAST only.
SHARE = {"start": 5e-4, "ordinal": 5e-3, "thai": 2e-3, "said": 5e-2, "cjk": 1e-3, "after": 1e-3, "intro": 1e-2}
LEAST = 3
SHORT = 5
#: Unambiguous occurrences in one document that make a token an abbreviation there, or a word.
OWN_YES, OWN_NO = 3, 2
#: Abbreviations that are broadcast; of more, each document gets those it may hold by a join.
MAX_TYPES = 500_000


@dataclass
class Model:
    """What the corpus tells. ``abbreviations`` maps a token to whether a sentence may end with it."""

    abbreviations: dict[str, bool] = field(default_factory=dict)
    starters: set[str] = field(default_factory=set)
    ordinals: set[str] = field(default_factory=set)
    thai: set[str] = field(default_factory=set)
    said: set[str] = field(default_factory=set)
    cjk: set[str] = field(default_factory=set)
    report: set[str] = field(default_factory=set)
    intro: set[str] = field(default_factory=set)


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in PARAGRAPH.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _starts_low(word: str) -> bool:
    return word[:1].islower() and not CAMEL.match(word)


def gather(text: str) -> Counter:
    """Counts ``(kind, key, key2)`` of a document."""
    out: Counter = Counter()
    for a, b in paragraphs(text):
        part = text[a:b].strip()
        m = MARKER.match(part)
        body = part[m.end() :] if m else part
        if not body:
            continue
        first = WORD.search(body)
        if first:
            word = first.group()
            out["start", word[:24], ""] += 1
            if HAS_THAI.match(body):
                out["thai", body[:5], ""] += 1
            said = LATIN_THAI.match(body)
            if said:
                out["said", said.group(2), ""] += 1
        if HAS_CJK.match(body):
            out["cjk", body[:2], ""] += 1
        for m in AFTER_MARK.finditer(body):
            out["start", m.group(1)[:24], ""] += 1
        for m in AFTER_STOP.finditer(body):
            out["cjk", m.group(1), ""] += 1
        if HAS_THAI.search(body):
            for m in THAI_START.finditer(body):
                out["thai", m.group(1), ""] += 1
        for m in AFTER_QUOTE.finditer(body):
            if not m.group(1)[0].isupper():
                out["after", m.group(1)[:24], ""] += 1
        for m in INTRO.finditer(body):
            out["intro", m.group(1), ""] += 1
        for m in PERIOD.finditer(body):
            token, opener, word = m.groups()
            key = token.lower()
            if token.isdigit():
                if len(token) <= 2 and int(token) <= 31 and not opener and word[:1].isupper():
                    out["ordinal", word[:24], ""] += 1
                continue
            kind = "open" if opener else "low" if _starts_low(word) else "digit" if word[0].isdigit() else "up"
            out["period", key, kind] += 1
            if kind == "up" and len(key) <= SHORT:
                out["pair", key, word[:24]] += 1
    for word, n in Counter(PLAIN.findall(text.lower())).items():
        out["plain", word, ""] += n
    return out


def learn(texts: DataFrame, column: str, scratch: Scratch, max_types: int = MAX_TYPES) -> tuple[Model, DataFrame | None]:
    """The model of a corpus: sums of all documents' counts, of which only common words and abbreviations reach the driver.

    With more than ``max_types`` abbreviations these stay a table ``(key, may_end)``, the second value.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for t in pdf[column]:
                total.update(gather(t))
            if len(total) > 200_000:
                yield _frame(total)
                total = Counter()
        if total:
            yield _frame(total)

    counts = scratch.write(texts.select(column).mapInPandas(scan, "kind string, key string, key2 string, n bigint").groupBy("kind", "key", "key2").agg(F.sum("n").alias("n")))
    totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    floor = {k: max(LEAST, totals.get(k, 0) * share) for k, share in SHARE.items()}
    model = Model()
    common = None
    for kind in SHARE:
        rows = counts.where((F.col("kind") == kind) & (F.col("n") >= floor[kind]))
        common = rows if common is None else common.unionByName(rows)
    sets = {"start": model.starters, "ordinal": model.ordinals, "thai": model.thai, "said": model.said, "cjk": model.cjk, "after": model.report, "intro": model.intro}
    for r in common.select("kind", "key").collect():  # at most 1/SHARE rows of a kind
        sets[r["kind"]].add(r["key"])
    model.ordinals -= model.starters
    model.report -= model.starters  # a word that opens sentences elsewhere opens one after a quotation too

    by = lambda k: F.sum(F.when(F.col("key2") == k, F.col("n")).otherwise(0)).alias(k)
    periods = counts.where("kind = 'period'").groupBy("key").agg(F.sum("n").alias("n"), by("low"), by("digit"), by("up"), by("open")).where(F.col("n") >= LEAST)
    plain = counts.where("kind = 'plain'").select("key", F.col("n").alias("plain"))
    starters = counts.where((F.col("kind") == "start") & (F.col("n") >= floor["start"])).select(F.col("key").alias("key2"), F.lit(1).alias("starts"))
    pairs = counts.where("kind = 'pair'").join(starters, "key2", "left").groupBy("key").agg(F.sum(F.col("n") * F.coalesce("starts", F.lit(0))).alias("starting"), F.sum("n").alias("pairs"), F.max(F.when(F.length("key2") > 1, F.col("n"))).alias("usual"))
    rows = periods.join(plain, "key", "left").join(pairs, "key", "left").fillna(0, ["plain", "starting", "pairs", "usual"])
    inside = (F.col("low") + F.col("digit") >= 0.5 * F.col("n")) | F.col("key").contains(".")
    # A title stands before many different names, or before another abbreviation of one letter.
    title = (F.length("key") <= SHORT) & (F.col("pairs") >= 0.5 * F.col("n")) & (F.col("starting") < 0.2 * F.col("pairs")) & (F.col("plain") <= 0.2 * F.col("n")) & (F.col("usual") <= 0.3 * F.col("pairs"))
    may_end = (F.col("up") + F.col("open") >= 0.1 * F.col("n")) & (F.col("starting") >= 0.5 * F.greatest("pairs", F.lit(1)))
    known = scratch.write(rows.where(inside | title).select("key", may_end.alias("may_end")))
    if known.count() > max_types:
        return model, known
    model.abbreviations.update((r["key"], r["may_end"]) for r in known.collect())  # at most max_types rows
    return model, None


def _frame(total: Counter) -> pd.DataFrame:
    return pd.DataFrame([(*k, n) for k, n in total.items()], columns=["kind", "key", "key2", "n"])


class _Document:
    """Cuts one text."""

    def __init__(self, text: str, model: Model, own_types: dict[str, bool] | None = None):
        self.text, self.model = text, model
        self.types = own_types if own_types is not None else model.abbreviations
        self._tokens: dict[str, bool | None] = {}
        self._words: dict[str, str] = {}

    def _occurrences(self, word: str) -> Iterator[int]:
        """Ends of the places where ``word`` stands alone."""
        text, at = self.text, self.text.find(word)
        while at >= 0:
            end = at + len(word)
            if not (at and (text[at - 1].isalnum() or text[at - 1] == ".")) and not text[end : end + 1].isalnum():
                yield end
            at = text.find(word, end)

    def own_evidence(self, token: str) -> bool | None:
        """What the document itself shows of ``token``: True if its unambiguous occurrences are those of an abbreviation (a
        period, then a lower case letter, a digit or a comma), False if they are those of a word (no period), else None."""
        if token not in self._tokens:
            text, yes, no, after = self.text, 0, 0, set()
            for end in self._occurrences(token):
                if text[end : end + 1] != ".":
                    no += 1
                    continue
                at = end + 1
                while at < len(text) and text[at] in BLANK:
                    at += 1
                c = text[at : at + 1]
                if c == "," or at > end + 1 and (c.islower() and not CAMEL.match(text, at) or c.isdigit()):
                    yes += 1
                    after.add(text[at : at + 4])
            # A passage that is repeated shows the same thing again, so what follows must differ.
            self._tokens[token] = True if yes >= OWN_YES and len(after) > 1 and not no else False if no >= OWN_NO and not yes else None
        return self._tokens[token]

    def own_word(self, word: str) -> str:
        """``name`` if the document has the capitalised ``word`` inside sentences and never in lower case, ``common`` if it is the other way round, else nothing."""
        if word not in self._words:
            text = self.text
            low = next(self._occurrences(word.lower()), None) is not None if word.lower() != word else False
            inside = False
            for end in self._occurrences(word):
                at = end - len(word)
                before = text[:at].rstrip(BLANK)[-1:] if at and text[at - 1] in BLANK else ""
                if before and (before.islower() or before == ","):
                    inside = True
                    break
            self._words[word] = "name" if inside and not low else "common" if low and not inside else ""
        return self._words[word]

    def abbreviation(self, token: str) -> bool:
        """The document decides; where it is silent, the corpus."""
        key = token.lower()
        own = self.own_evidence(token)
        if own is not None:
            return own
        return len(key) <= 1 or key in self.types or "." in key and all(len(x) <= 2 for x in key.split("."))

    def _token(self, at: int) -> str:
        """What stands before ``at`` without a blank or an opening mark."""
        text, width, begin = self.text, 64, 0
        while not begin and width < 8 * at + 64:
            low = max(0, at - width)
            begin = max(text.rfind(" ", low, at), text.rfind("\n", low, at)) + 1
            width *= 8
        return TOKEN.search(text, begin, at).group()

    def period_ends(self, at: int, after: int, limit: int) -> bool:
        """Whether the period at ``at`` ends a sentence; ``after`` is the next character that is not blank."""
        text, model = self.text, self.model
        token = self._token(at)
        word = WORD.match(text, after, min(limit, after + 40))
        word = word.group() if word else ""
        low = _starts_low(word)
        if token.isdigit():
            day = len(token) <= 2 and int(token) <= 31
            return not (day and (low or word in model.ordinals))
        if not token or not self.abbreviation(token):
            return True
        if low or word[:1].isdigit() and not MARKER.match(text, after):
            return False
        own = self.own_word(word) if word else ""
        if own == "common" or own != "name" and word in model.starters:
            return self.types.get(token.lower(), len(word) > 1)
        return self.types.get(token.lower(), False)

    def spans(self, a: int, b: int) -> dict[int, int]:
        """Outermost quotations and brackets of a paragraph: place of the opener -> place of its closer.

        One pass with a stack; an opener without a closer in its paragraph is a mark like any other.
        """
        text, open_, waiting, found = self.text, [], Counter(), []
        for m in PAIRED.finditer(text, a, b):
            at, c = m.start(), m.group()
            opener = self._opened_by(at, c, a, b, waiting)
            if opener:
                while True:
                    start, mark = open_.pop()
                    waiting[mark] -= 1
                    if mark == opener:
                        break
                found.append((start, at))
            elif c in OPENERS or c in "\"'" and (at == a or SPACES.match(text[at - 1]) or text[at - 1] in "([（:：") and at + 1 < b and not SPACES.match(text[at + 1]):
                open_.append((at, c))
                waiting[c] += 1
        out, end = {}, -1
        for start, at in sorted(found):
            if start > end:
                out[start] = end = at
        return out

    def _opened_by(self, at: int, c: str, a: int, b: int, waiting: Counter) -> str | None:
        """The waiting opener that the mark at ``at`` closes, if any."""
        text = self.text
        word_after = at + 1 < b and text[at + 1].isalnum()
        if c in "\"'":
            return c if waiting[c] and at > a and not SPACES.match(text[at - 1]) and not word_after else None
        if c == "’" and word_after:
            return None
        return next((o for o in CLOSED_BY.get(c, "") if waiting[o]), None)

    def ends(self) -> Iterator[int]:
        for a, b in paragraphs(self.text):
            yield from self._cut(a, b)

    def _skip(self, at: int, b: int) -> int:
        m = SPACES.match(self.text, at, b)
        return m.end() if m else at

    def _close(self, at: int, b: int) -> int:
        """Past further terminators and closing marks, with a blank before a guillemet."""
        text = self.text
        while at < b:
            if text[at] in CLOSERS and text[at] not in "\"'" or text[at] in HARD + SOFT:
                at += 1
            elif text[at] in "\"'" and (at + 1 == b or SPACES.match(text[at + 1])):
                at += 1
            elif SPACES.match(text[at]) and text[at] != "\n" and text[at + 1 : at + 2] == "»":
                at += 2
            else:
                break
        return at

    def _cut(self, a: int, b: int) -> Iterator[int]:
        text = self.text
        while b > a and SPACES.match(text[b - 1]):
            b -= 1
        start = self._skip(a, b)
        if start >= b:
            return
        spans = self.spans(start, b)
        lead = self._lead(start, b)
        points = self._points(start, b, spans)
        for kind, at, end in points:
            if end <= lead:
                continue
            after = self._skip(end, b)
            if after >= b:
                break
            if self._is_end(kind, at, end, after, lead, b):
                yield end
                start = after
                lead = self._lead(start, b)
        yield b

    def _lead(self, start: int, b: int) -> int:
        """First character of a sentence past its list marker."""
        m = MARKER.match(self.text, start, b)
        return m.end() if m else start

    def _points(self, a: int, b: int, spans: dict[int, int]) -> list[tuple[str, int, int]]:
        """Candidate ends outside quotations and brackets: (kind, place, end)."""
        text, out, at = self.text, [], a
        thai = HAS_THAI.search(text, a, b) is not None
        free: list[tuple[int, int]] = []
        for o, c in sorted(spans.items()):
            free.append((at, o))
            last = c - 1
            while last > o and SPACES.match(text[last]):
                last -= 1
            if text[last] in HARD + SOFT and text[c + 1 : c + 2] not in list(HARD + "!?"):
                out.append(("bracket" if text[o] in BRACKETS else "quote", o, c + 1))
            at = c + 1
        free.append((at, b))
        for x, y in free:
            for m in TERMINATORS.finditer(text, x, y):
                out.append((m.group(), m.start(), self._close(m.end(), b)))
            for m in LINE_BREAK.finditer(text, x, y):
                out.append(("\n", m.start(), m.start()))
            if thai:
                for m in THAI_GAP.finditer(text, x, y):
                    out.append((" ", m.start(), m.start()))
        out.sort(key=lambda p: (p[2], p[1]))
        return out

    def _is_end(self, kind: str, at: int, end: int, after: int, lead: int, b: int) -> bool:
        text = self.text
        following = text[after]
        if kind == ".":  # Latin terminators need a blank after them
            return end != after and (self._period_before_opener(at, b) if following in "“„«\"'(¿¡[" else self.period_ends(at, after, b))
        word = WORD.match(text, after, min(b, after + 40))
        low = bool(word) and _starts_low(word.group())
        if kind == "\n":
            if not MARKER.match(text, after, b):
                return False
            before = text[end - 1]
            return before in HARD + SOFT + CLOSERS or bool(HAS_THAI.match(before)) or bool(HAS_THAI.search(text, after, min(b, after + 12)))
        if kind == " ":
            return self._thai_gap(at, after, b)
        if kind in ("bracket", "quote"):
            if low or following in ",，、;；:：–—-" and not MARKER.match(text, after, b):
                return False
            if at == lead:
                report = self._report(end, b) if kind == "quote" else None
                return report is None or self._introduces(report, b)
            return kind == "quote" and not (following == "と")
        if any(c in HARD for c in kind):
            return following not in ",，、;；" or low
        if end == after:  # Latin terminators need a blank after them
            return bool(HAS_CJK.match(following)) and "…" not in kind and ".." not in kind
        if "…" in kind or ".." in kind:
            if word and not low and (word.group()[:1].isupper() or CAMEL.match(word.group())):
                return True
            return following in "“„«(¿¡" or word is not None and word.group() in self.model.starters
        return True

    def _period_before_opener(self, at: int, b: int) -> bool:
        token = self._token(at)
        if not token or token.isdigit() or not self.abbreviation(token):
            return True
        return self.types.get(token.lower(), False)

    def _report(self, at: int, b: int) -> int | None:
        """End of the words after a quotation that make it part of its sentence, where letter case does not tell: the Japanese particle, a
        word that the corpus has after quotations but not at the start of sentences, or a clause that ends as those do that introduce quotations."""
        text, at = self.text, self._skip(at, b)
        if text[at : at + 1] == "と":
            return at + 1
        word = WORD.match(text, at, b)
        if word and word.group() in self.model.report:
            return word.end()
        clause = CLAUSE.match(text, at, b)
        if clause and self.model.intro:
            said = clause.group().removesuffix("道")
            if said[-1:] in self.model.intro:
                return clause.end()
        return None

    def _introduces(self, at: int, b: int) -> bool:
        """Whether a reporting clause leads to a further quotation, so that it belongs to that one."""
        return INTRODUCES.match(self.text, at, b) is not None

    def _thai_gap(self, at: int, after: int, b: int) -> bool:
        text, model = self.text, self.model
        is_thai = lambda c: "฀" <= c <= "๿"
        before, following = text[at - 1], text[after]
        if is_thai(following):
            if is_thai(before):
                return True
            return text[after : after + 5] in model.thai and before not in HARD + SOFT + ",;:"
        if is_thai(before) and following.isalpha():
            said = LATIN_THAI.match(text, after, b)
            if said:
                return said.group(2) in model.said
            if LATIN_RUN.match(text, after, b):
                return True
            word = WORD.match(text, after, min(b, after + 40))
            return bool(word) and word.group() in model.starters
        return False


def sentence_ends(text: str, model: Model, own_types: dict[str, bool] | None = None) -> list[int]:
    """End of each sentence of ``text`` in characters from its start."""
    return list(dict.fromkeys(_Document(text, model, own_types).ends()))


def split_sentences(documents: DataFrame, id_col: str = "doc_id", text: str = "text", max_types: int = MAX_TYPES) -> DataFrame:
    """``(id_col, sentence_no, start_pos, end_pos)`` for every sentence of every document.

    Positions count code points; ``end_pos`` includes closing marks, not the blanks after them.
    Null, empty and blank texts have no row; a null identifier is kept. A repeated row gives its sentences again.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark, "sentences")
    docs = documents.select(F.col(id_col).alias("doc"), F.col(text).alias("body")).where("body IS NOT NULL AND body <> ''")
    model, table = learn(docs, "body", scratch, max_types)
    sent = spark.sparkContext.broadcast(model)
    if table is None:
        docs = docs.withColumn("types", F.lit(None).cast("array<struct<key: string, may_end: boolean>>"))
    else:
        # Too many abbreviations for every task: each text gets those among its own tokens. Only tokens are shuffled to find them, then texts once.
        docs = docs.withColumn("h", F.sha2("body", 256))
        tokens = docs.select("h", F.explode(F.array_distinct(F.split(F.lower("body"), rf"[{BLANK}(\[“„«‘\"'「『]+"))).alias("raw")).where(F.col("raw").contains("."))
        tokens = tokens.select("h", F.regexp_replace("raw", r"\.[^.]*$", "").alias("key")).distinct()
        docs = docs.join(tokens.join(table, "key").groupBy("h").agg(F.collect_list(F.struct("key", "may_end")).alias("types")), "h", "left")
        docs = docs.withColumn("types", F.coalesce("types", F.array().cast("array<struct<key: string, may_end: boolean>>"))).drop("h")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for pdf in batches:
            rows = []
            for doc, body, types in zip(pdf["doc"], pdf["body"], pdf["types"], strict=True):
                at = 0
                own = None if types is None else {t["key"]: t["may_end"] for t in types}
                for no, end in enumerate(sentence_ends(body, model, own)):
                    m = SPACES.match(body, at)
                    rows.append((doc, no, m.end() if m else at, end))
                    at = end
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "no", "start", "end"])

    kind = docs.schema["doc"].dataType.simpleString()
    cut_rows = docs.mapInPandas(cut, f"doc {kind}, no int, start bigint, end bigint")
    return cut_rows.select(F.col("doc").alias(id_col), F.col("no").alias("sentence_no"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))
