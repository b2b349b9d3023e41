"""Sentence units of texts in any language, with period statistics learned unsupervised from the corpus."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, join_measured

#: Log-likelihood ratio from which on a collocation or a preference counts (1 % of the chi-square distribution), as Kiss and Strunk (2006) have it.
SIGNIFICANT = 7.88
#: Log-likelihood ratio from which on a word counts as a starter of sentences (the same source).
STARTER = 30.0
#: Value of the length-weighted ratio from which on a word is an abbreviation (the same source).
ABBREVIATION = 0.3
#: A collocate stands at least so many times more often than among the starts of blocks.
LIFT = 2.0
#: Rates of periods with a collocate behind them under the two hypotheses: of a word that ends sentences, of an abbreviation.
RATES = (0.1, 0.9)

#: Frequent function words that tell languages of the Latin script apart (fixed values).
_WORDS_OF = {
    "en": "the of and to is was as no with that it for by be this from are which not has were its but had when after",
    "de": "der die das und ist nicht mit ein eine den dem zu von auf wird wurde wurden bei nach hat sich im am noch seit siehe ab",
    "fr": "le les et est une du dans pour que qui pas plus sur au avec ne ce par il elle trop depuis voir encore après",
    "es": "el los las y es una del para que no se por con su al lo como más ya todavía desde tras véase está fue",
    "it": "il gli di è una per che non con sono della nel alla più anche dal",
    "pt": "o os as e é uma do da para que não se por com mais ao foi pela",
    "nl": "het een en van is niet met voor op zijn dat te aan ook naar",
}
#: Words that stand in one list only.
FUNCTION_WORDS = {w: lang for lang, words in _WORDS_OF.items() for w in words.split() if sum(w in x.split() for x in _WORDS_OF.values()) == 1}

_CJK = r"⺀-⿟々-ヿ㐀-鿿가-힯豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
_SCRIPTS = [("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ru", re.compile("[Ѐ-ԯ]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿\U00020000-\U0003ffff]")), ("ar", re.compile("[؀-ۿ]")), ("el", re.compile("[Ͱ-Ͽ]")), ("ko", re.compile("[가-힯]"))]
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")

_HEADING = re.compile(r"[﻿​\s]*#{1,6}(\s|$)")
_LIST = re.compile(r"[﻿​\s]*(?:[-*+•]|\d{1,3}[.)])[ \t]+\S")
_MARK = re.compile(r"[﻿​ \t]*(?:(?:>[ \t]?)+|//+!?|--+|;+|%+)(?:[ \t]+|$)")
_FENCE = re.compile(r"[﻿​ \t]*(```+|~~~+)")

_TERM = re.compile(r"[.!?…。！？｡।॥؟۔‼-⁉]+")
_WIDE, _BAR = re.compile("[。！？｡]"), re.compile("[।॥؟۔]")
_WIDE_LETTER = re.compile(f"[{_CJK}]")
_NEXT = re.compile(r"\s*((?:[—–«„\-]\s+)?\S+)")
_NEXT_IN_TOKEN = re.compile(r"[^\s.!?…]+")
_VERSION = re.compile(r"v\d[\d.]*")
_PLAIN_END = re.compile(r"[a-zà-ÿа-я\d]{3}[\"”»)]?$")
#: Tokens after a word or comma: surely inside a sentence.
_INSIDE = re.compile(r"(?<=[\w,][ ])\S+")
_THAI_GAP = re.compile("(?<=[ก-ฮะ-ๅ็-๎๐-๙])[ \t ]+(?=[฀-๿\"“(])")
_CLOSE_OF = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "《": "》", "[": "]"}
_OPENERS_OF = {c: [o for o, closers in _CLOSE_OF.items() if c in closers] for c in "".join(_CLOSE_OF.values())}
_PAIRED = re.compile("[\"" + re.escape("".join(_CLOSE_OF) + "".join(_CLOSE_OF.values())) + "]")
_QUOTES = set('“„«‹「『"')
_OPENERS = '"“„«‹‘(¿¡[「『（—–-…*_'
_TRAIL = ",;:.!?)]”“»›\"'’…*_"
#: What goes on with a sentence after a Japanese quotation (fixed values).
_JA_GOES_ON = set("とっがはをのもにで、")


@dataclass
class Block:
    """Lines of one kind: text to be split, or one unit. ``at`` holds the offset of each character of ``text``."""

    text: str
    at: list[int] = field(default_factory=list)
    whole: bool = False


def blocks(text: str) -> list[Block]:
    """Blocks of a text. Marks that begin quoted or commented lines are left out; line breaks inside a block become spaces."""
    out: list[Block] = []
    open_: Block | None = None
    mark_of_open = ""
    after_text = False  # the line before belongs to running text
    fence = ""
    pos = 0
    for line in text.split("\n"):
        start, pos = pos, pos + len(line) + 1
        body = line.rstrip()
        if fence:
            out[-1].at[-1] = start + len(body) - 1 if body else out[-1].at[-1]
            if body.strip().startswith(fence):
                fence = ""
            continue
        if not body.strip("﻿​ \t\r 　"):
            open_, after_text = None, False
            continue
        if m := _FENCE.match(body):
            out.append(Block("", [start + len(body) - 1], True))
            fence, open_, after_text = m[1][:3], None, False
            if body.count(fence) > 1 and body.strip().endswith(fence) and len(body.strip()) > 3:
                fence = ""
            continue
        if _HEADING.match(body) or (not after_text and _LIST.match(body)):
            out.append(Block("", [start + len(body) - 1], True))
            open_, after_text = None, False
            continue
        m = _MARK.match(body)
        skip, mark = (m.end(), m[0].strip()[:1]) if m and m.end() < len(body) else (0, "")
        if m and not skip:  # a mark and nothing else is a blank line of its block
            open_, after_text = None, False
            continue
        if open_ is None or mark != mark_of_open:
            open_, mark_of_open = Block(""), mark
            out.append(open_)
            parts: list[str] = []
        else:
            open_.text += " "
            open_.at.append(start - 1)
        while skip < len(body) and body[skip] in "﻿​ \t":
            skip += 1
        open_.text += body[skip:].replace("\r", " ").replace("\t", " ")
        open_.at += range(start + skip, start + len(body))
        after_text = True
    return out


def language(text: str, declared: str | None) -> str:
    """Language of a block: by script, in the Latin script by function words, else as declared, else English."""
    if not text.isascii() and max(text) > "\u036f":
        letters = sum(map(len, _LATIN.findall(text)))
        for lang, pattern in _SCRIPTS:
            n = len(pattern.findall(text))
            if n * 4 > letters and n:
                return lang
    votes = Counter(filter(None, map(FUNCTION_WORDS.get, text.lower().split())))
    if votes:
        (best, n), *rest = votes.most_common(2)
        if not rest or n > rest[0][1]:
            return best
    declared = (declared or "").strip().lower()[:2]
    return declared if declared in ("en", "de", "fr", "es", "it", "pt", "nl") else "en"


@lru_cache(1 << 16)
def shape(token: str) -> str:
    """Class of a token by its looks."""
    if "/" in token:
        return "<path>"
    c = token[:1]
    if not c:
        return "<none>"
    if c.isdigit():
        return "<0>"
    if c == "v" and _VERSION.fullmatch(token):
        return "<v0>"
    if len(token) == 1 and c.isalpha():
        return "<X>" if c.isupper() else "<x>"
    if c.isupper():
        return "<XX>" if token.isupper() else "<Xx>"
    if c.islower():
        return "<x-x>" if "-" in token and token.isascii() else "<xx>"
    return "<other>" if c.isalpha() else "<mark>"


@lru_cache(1 << 16)
def follower(raw: str) -> tuple[str, str]:
    """(word, shape) of the token after a possible end. An opening mark is part of both."""
    core = raw.lstrip(_OPENERS)
    lead = raw[: len(raw) - len(core)]
    sign = "" if not lead else "—" if lead[0] in "—–-" and len(lead) == 1 else "“"
    core = core.rstrip(_TRAIL)
    s = sign + shape(core)
    return (sign + core if shape(core) in ("<Xx>", "<xx>", "<XX>", "<other>", "<X>", "<x>") else s), s


@lru_cache(1 << 16)
def before(raw: str, term: str, closed: str) -> tuple[str, str]:
    """(word, shape) of the token that carries a terminal mark."""
    tail = "”" if any(c in "”“»›\"」』" for c in closed) else ")" if closed else ""
    if "?" in term or "!" in term:
        return "?" + tail, "?" + tail
    if len(term) > 1 or "…" in term:
        return "…" + tail, "…" + tail
    core = raw.lstrip(_OPENERS)
    s = shape(core)
    if tail or s in ("<path>", "<0>", "<v0>", "<x-x>", "<none>", "<mark>"):
        return (s + tail if s not in ("<none>", "<mark>") else "." + tail), "." + tail
    return core.lower(), f"len{min(len(core), 9)}{'.' if '.' in core else ''}"


def spans(s: str) -> list[tuple[int, int]]:
    """Quotations and brackets that open and close in the block. Linear: the stack is searched only for what is known to be on it."""
    out, stack = [], []
    on: Counter = Counter()

    def back_to(at: int, end: int) -> None:
        out.append((stack[at][1], end))
        on.subtract(c for c, _ in stack[at:])
        del stack[at:]

    for m in _PAIRED.finditer(s):
        i, c = m.start(), m.group()
        if c == '"':
            opens = (i == 0 or s[i - 1] in " (—[ " or stack and stack[-1][1] == i - 1) and i + 1 < len(s) and s[i + 1] != " "
            if on['"'] > 0:
                back_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), i)
            elif opens:
                stack.append((c, i))
                on[c] += 1
            continue
        if any(on[o] > 0 for o in _OPENERS_OF.get(c, ())):
            back_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in _OPENERS_OF[c]), i)
        elif c in _CLOSE_OF:
            stack.append((c, i))
            on[c] += 1
    return out


@dataclass
class Candidate:
    end: int  # where the unit would end (exclusive)
    sure: bool | None  # decided by the mark itself
    word: tuple[str, str] = ("", "")
    next: tuple[str, str] = ("", "")
    quote_at: int = -1  # where a quotation opened that closes here


def candidates(s: str) -> list[Candidate]:
    """Places of a block where a sentence may end, from left to right; none inside quotations or brackets. Linear in the block."""
    pairs = spans(s)
    close = {b: a for a, b in pairs}
    turns = [0] * (len(s) + 1)
    for a, b in pairs:
        turns[a] += 1
        turns[b] -= 1
    inside = list(accumulate(turns))
    until = len(s.rstrip())
    out = [Candidate(m.start(), True) for m in _THAI_GAP.finditer(s) if not inside[m.start()]]
    seen = word = 0  # what has been looked at, where the token at hand begins
    slash = dot = False  # what the token holds so far
    for m in _TERM.finditer(s):
        part = s[seen : m.start()]
        if last := part.rsplit(None, 1) if part else None:
            if part[-1].isspace():
                word, slash, dot = m.start(), False, False
            elif len(last) == 2 or part[0].isspace():
                word, slash, dot = m.start() - len(last[-1]), "/" in last[-1], "@" in last[-1]
            else:
                slash, dot = slash or "/" in part, dot or "@" in part
        elif part:
            word, slash, dot = m.start(), False, False
        seen, term = m.end(), m.group()
        plain = not slash and not dot
        dot = dot or "." in term
        j, quote, opened = m.end(), -1, -1
        while True:
            if j in close:
                quote = close[j] if s[close[j]] in _QUOTES else quote
                opened = close[j]
                j += 1
            elif j + 1 < len(s) and s[j] in "   " and j + 1 in close and s[j + 1] in "»›":
                quote = opened = close[j + 1]
                j += 2
            else:
                break
        if inside[m.start()] if j == m.end() else opened > 0 and inside[opened - 1]:
            continue
        if j >= until:
            continue
        nxt = s[j]
        wide = _WIDE.search(term) or ("…" in term and (_WIDE_LETTER.match(nxt) or m.start() and _WIDE_LETTER.match(s[m.start() - 1])))
        if wide:
            out.append(Candidate(j, not (quote >= 0 and nxt in _JA_GOES_ON), quote_at=quote))
            continue
        if _BAR.search(term):
            out.append(Candidate(j, True, quote_at=quote))
            continue
        if nxt.isspace():
            token = _NEXT.match(s, j)[1].replace(" ", "")
        elif nxt.isupper() and plain and _PLAIN_END.search(s, max(word, m.start() - 4), m.start()):
            token = _NEXT_IN_TOKEN.match(s, j)[0]  # the space after a plain word was forgotten
        else:
            continue  # a mark inside a token
        out.append(Candidate(j, None, before(s[word : m.start()], term, s[m.end() : j]), follower(token), quote))
        word, slash, dot = j, False, False  # what follows is another token
    out.sort(key=lambda c: c.end)
    return out


#: What the scan of a text gives, one row each (the schema of mapInArrow): a unit's sure end, a place where one may end, or counts.
SCAN = "row long, doc long, kind string, end int, lang string, w string, ws string, t string, ts string, block int, at int, after int, n long"
_SCAN = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for c in SCAN.split(", ")])
UNIT, QUOTE, PAIR, START, INSIDE = "unit", "quote", "pair", "start", "inside"


class _Scan:
    """Rows of scanned texts and counts of how blocks start and of what stands inside sentences."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.starts: Counter = Counter()
        self.inside: dict[str, Counter] = defaultdict(Counter)

    def text(self, row: int, doc: int, text: str, declared: str | None) -> None:
        for no, block in enumerate(blocks(text)):
            if block.whole:
                self.rows.append((row, doc, UNIT, block.at[-1] + 1, *[None] * 8, 1))
                continue
            s = block.text
            if not s.strip():
                continue
            lang = language(s, declared)
            self.inside[lang].update(_INSIDE.findall(s))
            first = s.split(None, 1)
            token = first[0]
            if token in ("—", "–", "«", "„") and len(first) > 1:
                token += first[1].split(None, 1)[0]
            self.starts[lang, *follower(token)] += 1
            found = candidates(s)
            # a quotation that begins its sentence is followed by who said it: whether it does depends on the ends before it
            told = [lang in ("zh", "ko") and bool(c.sure) and c.quote_at >= 0 and not s[c.end].isspace() and s[c.end] not in "“「『（\"(" for c in found]
            group = no if any(told) else None
            for c, quoted in zip(found, told):
                end = block.at[c.end - 1] + 1
                if c.sure is None:
                    self.rows.append((row, doc, PAIR, end, lang, *c.word, *c.next, group, c.end, None, 1))
                elif quoted:
                    self.rows.append((row, doc, QUOTE, end, *[None] * 5, group, c.end, len(s[: c.quote_at].rstrip()), 1))
                elif c.sure:
                    self.rows.append((row, doc, UNIT, end, *[None] * 5, group, c.end, None, 1))
            self.rows.append((row, doc, UNIT, block.at[len(s.rstrip()) - 1] + 1, *[None] * 8, 1))

    def counts(self) -> None:
        """Turn the counts into rows and begin anew."""
        inside: Counter = Counter()
        for lang, tokens in self.inside.items():
            for token, n in tokens.items():
                inside[lang, *follower(token)] += n
        for kind, counts in ((START, self.starts), (INSIDE, inside)):
            self.rows += [(None, None, kind, None, lang, None, None, t, ts, None, None, None, n) for (lang, t, ts), n in counts.items()]
        self.starts, self.inside = Counter(), defaultdict(Counter)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[]] * len(_SCAN)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCAN)], schema=_SCAN)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan of batches (row, doc, text, lang); what is held is bounded by a batch and the tokens counted since the last flush."""
    out = _Scan()
    for batch in batches:
        for row, doc, text, declared in zip(*(batch.column(i).to_pylist() for i in range(4))):
            out.text(row, doc, text, declared)
            if len(out.rows) > 20_000:
                yield out.batch()
        if sum(map(len, out.inside.values())) > 100_000:
            out.counts()
        yield out.batch()
    out.counts()
    yield out.batch()


def _g2(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's log-likelihood ratio of two shares k / n, with a minus where the first is the smaller; 0 where a total is 0."""
    part = lambda k, p: F.when(k > 0, k * F.ln(p)).otherwise(0.0)
    both = lambda k, n, p: part(k, p) + part(n - k, 1 - p)
    p = (k1 + k2) / (n1 + n2)
    g = 2 * (both(k1, n1, k1 / n1) + both(k2, n2, k2 / n2) - both(k1, n1, p) - both(k2, n2, p))
    return F.when((n1 <= 0) | (n2 <= 0), 0.0).when(k1 * n2 >= k2 * n1, F.greatest(g, F.lit(0.0))).otherwise(-F.greatest(g, F.lit(0.0)))


def _followers(counts: DataFrame) -> DataFrame:
    """Every token that stands behind a possible end, per language: n_start (among ns starts of blocks), the ratio ``starter`` of starts
    to the inside of sentences, whether it is ``common`` (with a capital here, mostly small inside sentences) and ``small``, and ``c``, what it
    counts as: itself if it is known to start sentences or not to, one of the common ones, or its shape.
    """
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    per = counts.groupBy("lang", "t").agg(F.min("ts").alias("ts"), n(START).alias("n_start"), n(INSIDE).alias("n_inside"))
    totals = per.groupBy("lang").agg(F.sum("n_start").alias("ns"), F.sum("n_inside").alias("ni"))  # as many rows as language() has values
    core = F.ltrim(F.col("t"), F.lit("—“"))
    per = cut(per.join(F.broadcast(totals), "lang").withColumn("core", core).withColumn("low", F.lower("core")))
    inside = per.where("n_inside > 0")
    as_small = inside.select("lang", F.col("t").alias("low"), F.col("n_inside").alias("a"))
    as_is = inside.select("lang", F.col("t").alias("core"), F.col("n_inside").alias("b"))
    capital = per.where("low <> core").join(as_small, ["lang", "low"]).join(as_is, ["lang", "core"], "left").na.fill(0, ["b"])
    half = (F.col("a") + F.col("b")) / 2
    g = 2 * (F.col("a") * F.ln(F.col("a") / half) + F.when(F.col("b") > 0, F.col("b") * F.ln(F.col("b") / half)).otherwise(0.0))
    common = capital.where((F.col("a") > F.col("b")) & (g > SIGNIFICANT)).select("lang", "t", F.lit(True).alias("common"))
    starter = _g2(F.col("n_start"), F.col("ns"), F.col("n_inside"), F.col("ni"))
    out = per.join(common, ["lang", "t"], "left").na.fill(False, ["common"]).withColumn("starter", starter)
    known = F.when(F.col("common"), "<common>").when(F.abs("starter") > SIGNIFICANT, F.col("t")).otherwise(F.col("ts"))
    return out.select("lang", "t", "n_start", "ns", "starter", "common", F.ltrim(F.col("ts"), F.lit("—“")).isin("<xx>", "<x>").alias("small"), known.alias("c"))


def _ratios(cells: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of cells (lang, u, c, n): each with its collocation ratio g against the starts of blocks, and per (lang, u) the ratio v of
    the hypotheses that collocates or that sentences follow.
    """
    total = cells.groupBy("lang", "u").agg(F.sum("n").alias("n_u"))
    x = cells.join(total, ["lang", "u"]).join(starts, ["lang", "c"], "left").na.fill(0, ["k", "ns"])
    expected = F.when(F.col("ns") > 0, F.col("n_u") * F.col("k") / F.col("ns")).otherwise(0.0)
    g = F.when((F.col("c") == "<common>") | (F.col("n") < LIFT * expected), 0.0).otherwise(_g2(F.col("n"), F.col("n_u"), F.col("k"), F.col("ns")))
    x = cut(x.withColumn("g", g).withColumn("more", F.when(F.col("g") > SIGNIFICANT, F.col("n") - expected).otherwise(0.0)))
    low, high = RATES
    more, n = F.sum("more"), F.max("n_u")
    v = 2 * (more * log(high / low) + (n - more) * log((1 - high) / (1 - low)))
    return x.select("lang", "u", "c", "g"), x.groupBy("lang", "u").agg(v.alias("v"))


def learn(found: DataFrame) -> DataFrame:
    """Which pairs (lang, w, t) of a word with a mark and what follows end a sentence, learned from all that was scanned: lang, w, t, ends.

    Unsupervised, per language, by log-likelihood ratios over all counts:

    - starters: a token among the starts of blocks against the inside of sentences (Dunning);
    - collocations: what follows a word with a mark against the starts of blocks (Dunning, and at least LIFT times as often);
    - abbreviations: whether the periods of a word have collocates behind them at the rate of an abbreviation or of a word
      that ends sentences (RATES), weighted by length and inner periods as Kiss and Strunk do. A word whose ratio says nothing counts with all such words of its shape.

    Behind an abbreviation a sentence begins only with a starter that is no collocate; behind ? ! … with anything but a small letter;
    behind numbers, paths and closing marks with neither a small letter nor a collocate; behind any other word always if the word surely ends
    sentences, else unless a small letter follows. A capital on a word that is otherwise written small begins a sentence anywhere.
    """
    counts = cut(found.where(F.col("kind").isin(PAIR, START, INSIDE)).groupBy("kind", "lang", "w", "ws", "t", "ts").agg(F.sum("n").alias("n")))
    followers = cut(_followers(counts))
    pairs = cut(counts.where(F.col("kind") == PAIR).select("lang", "w", "ws", "t", "n").join(followers.select("lang", "t", "starter", "common", "small", "c"), ["lang", "t"]))
    totals = F.broadcast(followers.groupBy("lang").agg(F.max("ns").alias("ns")))
    starts = cut(followers.groupBy("lang", "c").agg(F.sum("n_start").alias("k")).join(totals, "lang"))
    cells = lambda u: pairs.withColumn("u", u).groupBy("lang", "u", "c").agg(F.sum("n").alias("n"))
    _, words = _ratios(cells(F.col("w")), starts)
    own = words.where(F.abs("v") > SIGNIFICANT).select("lang", F.col("u").alias("w"), F.lit(True).alias("own"))
    pairs = cut(pairs.join(own, ["lang", "w"], "left").na.fill(False, ["own"]).withColumn("u", F.when(F.col("own"), F.concat(F.lit("w "), "w")).otherwise(F.concat(F.lit("s "), "ws"))))
    each, per = _ratios(pairs.groupBy("lang", "u", "c").agg(F.sum("n").alias("n")), starts)
    x = pairs.join(each, ["lang", "u", "c"]).join(per, ["lang", "u"])
    plain = ~F.substring("w", 1, 1).isin("<", "…", "?", ".")
    bare = F.replace(F.col("w"), F.lit("."), F.lit(""))
    weighted = F.col("v") * F.exp(-F.length(bare)) * (1 + F.length("w") - F.length(bare)) - ABBREVIATION
    v = F.when(F.col("own") & plain & (F.col("v") > 0), weighted).otherwise(F.col("v"))
    start, no_collocate, mark = F.col("starter") > STARTER, F.col("g") <= SIGNIFICANT, F.substring("w", 1, 1)
    ends = (
        F.when(F.col("common"), True)
        .when(mark.isin("?", "…"), ~F.col("small"))
        .when(v > 0, start & no_collocate)
        .when(mark.isin("<", "."), ~F.col("small") & no_collocate)
        .otherwise(~F.col("small") | (F.col("own") & (v < -SIGNIFICANT)))
    )
    return x.select("lang", "w", "t", ends.alias("ends"))


def sentence_ends(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Units of every text: doc, end_char (code points up to and including the unit's last character), one row each.

    Every whole text is scanned once: blocks, sure ends, places where a sentence may end and counts are written as one table.
    The statistics are learned from all of it (see learn) and joined to the places; no text is read twice and no
    statistic passes through the driver. Null, empty and blank texts have no units; repeated rows are split as often as they
    stand; null or wrong languages are told by script and function words.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return _ends(cut(rows.mapInArrow(scan, SCAN))).withColumnRenamed("doc", doc)


def _ends(found: DataFrame) -> DataFrame:
    """Ends (doc, end_char) of what was scanned."""
    places = found.where(F.col("kind") == PAIR).select("row", "doc", "end", "lang", "w", "t", "block", "at")
    told = join_measured(places, learn(found), ["lang", "w", "t"]).select("row", "doc", "end", "block", "at", "ends", F.lit(None).cast("int").alias("after"))
    sure = found.where(F.col("kind").isin(UNIT, QUOTE)).select("row", "doc", "end", "block", "at", F.lit(True).alias("ends"), "after")
    alone = told.where(F.col("block").isNull() & F.col("ends")).unionByName(sure.where("block IS NULL")).select("doc", F.col("end").cast("long").alias("end_char"))
    # A quotation that begins its sentence, that is at the start of its block or right behind an end, ends no unit. Of quotations
    # right behind each other every other one does, beginning with what stands before the run.
    order = Window.partitionBy("row", "block").orderBy("at")
    linked = F.col("after").isNotNull() & (F.col("after") == F.lag("at").over(order))
    some = told.unionByName(sure).where("block IS NOT NULL").withColumn("linked", F.coalesce(linked, F.lit(False)))
    some = some.withColumn("ends", F.coalesce(F.col("after") > 0, "ends")).withColumn("run", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(order))
    within = Window.partitionBy("row", "block", "run").orderBy("at")
    turned = F.first("ends").over(within) != (F.row_number().over(within) % 2 == 0)
    chained = some.withColumn("turned", turned).where("turned").select("doc", F.col("end").cast("long").alias("end_char"))
    return alone.unionByName(chained)
