"""Text statistics per document, and whether a text is natural prose.

A text is cut into stretches of lines: at blank lines, and where lines whose
delimiters stand below the same delimiters of a neighbour (vertical delimiter
alignment) border on lines that don't.  Each stretch gets one score, positive
for structure, from

* the share of aligned lines (list marks, cell and key delimiters, places of
  columns, line ends, rules, time stamps),
* the periodicity of its indentation,
* the autocorrelation of its line lengths (near 1 for lines filled to a width,
  lower for the ragged short lines of a list), weighted by how short lines are,
* its shares of common words, letters and symbols, and its sentences.

A text is not prose if more than half of its characters lie in stretches with a
positive score.  All weights are in WEIGHTS and can be changed or set to 0.

Defined results: null, empty and blank texts have counts of 0 (null text: null),
null shares and no verdict; null ids are ignored; repeated rows come out as
often as they go in; an empty table gives an empty result; further columns are
ignored.  Texts are judged whole, in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that make up much of running text, by language (fixed values).
COMMON = {
    "en": """a about above after again all along alongside also although an and another any are as at be because been before behind below beneath beside between beyond both but by
        can cannot could did do does down during each either else ever every few for from had has have he her here him his how however i if in inside into is it its just less like many may me might
        more most much must my near neither never no nobody nor not nothing of off on once one only onto or other our out outside over per please rather same shall she should since so some somebody still such
        than that the their them then there these they this those though through till to too under unless until up upon us very was we were what when whenever where whether which while who whoever whom whose why will with
        within without would yet you your""",
    "de": """ab aber alle als also am an auch auf aus bei beide bis da damit dann das dass dem den denn der des dessen die dies diese diesem diesen dieser dieses doch du durch ein eine einem einen einer eines er es etwas
        für gegen haben hat hier hinter ich ihm ihn ihr ihre im in ist jede jedem jeden jeder jedes kann kein keine man mehr mit muss nach neben nicht nichts noch nun nur ob obwohl oder ohne schon sehr sein seine seit sich sie
        sind so sobald soll sondern über um und uns unter vom von vor während war waren was weil welche wenn wer werden wie wieder wir wird wo wurde wurden zu zum zur zwischen""",
    "ru": """а без более бы был была были было быть в вам вас весь во вот все всё вы где да даже для до его ее её если есть ещё же за здесь и из или им их к как каждая каждое каждый когда которая которое которые который кто ли
        лишь между меня мне может мы на над надо нас не него нее неё нет ни ним них но ну о об однако он она они оно от перед по под пока после потому поэтому при про с сам свой себя случае со так также такой там те тем то
        только том тот ту ты у уже хотя чего чем что чтобы эта эти это этой этом этот эту я""",
}
WORDS = frozenset(w for s in COMMON.values() for w in s.split())
WORDS = frozenset(w for s in COMMON.values() for w in s.split())
DDL = """doc_id long, n_chars long, n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, n_lines long, punct_line_share double, common_word_share double,
    list_line_share double, table_line_share double, aligned_line_share double, indent_period double, length_autocorrelation double, prose_share double, is_prose boolean"""

#: What each feature adds to the score of a stretch.  Set by hand, by how far the verdicts agree with earlier rules on the
#: test documents of two scales; there are no true labels.
WEIGHTS = {
    "aligned": 1.8,  # share of aligned lines
    "period": 6.0,  # periodicity of the indentation, up to 0.5
    "ragged": 16.0,  # one less the autocorrelation of line lengths, at full weight for short lines; adds 3 at most
    "uncommon": 10.0,  # what the share of common words lacks of 0.22; adds 0.6 and takes off 3.4 at most
    "symbols": 15.0,  # symbols above 0.03 of the characters; adds 2 and takes off 0.4 at most
    "marks": 6.0,  # what letters lack of 0.85 of the characters; adds 1.5 and takes off 0.5 at most
    "sentences": 1.0,  # words that no sentence ends: 5.6 for 25 or more, less for fewer; takes off 0.5 for sentences
    "lengths": 2.0,  # words of less than 2 or more than 16 letters on average, but in scripts without spaces
    "ends": 0.5,  # share of lines that end like a sentence or clause
    "base": -0.8,
}
SHORT, ITEM_WORDS, SENTENCE_WORDS = 8.5, 7, 60

_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d+")
_SYMBOL = re.compile(r"(?:[^\w\s.,;:!?'\"’‘“”„«»()\-–—…¿¡。！？，、：；「」（）]|_)+")
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_SENTENCE = re.compile(r"(?<![.!?…])[.!?…]++[\"'”’)\]»]*+(?:\s|$)|[。！？]")
_PUNCT_END = re.compile(r"[.!?…:;。！？][\"'”’)\]»]*$")
_LINE_ENDS = re.compile("\r\n?|\n|\u2028|\u2029|\x0b|\x0c|\x85")
_MARK = re.compile(r"\s*([-*+•·–—‣▪◦#]{1,6}|=>|->|>|\[[ xX]?\]|(\(?)(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})([.)]))\s+")
_KEY = re.compile(r"\s*(?:-\s+)?[\w./{}\"'-]+\s?([:=])(?:\s|$)")
_GAP = re.compile(r"\S(\s{2,})\S")
_STAMP = re.compile(r"[\[(]?\d{2,4}[-/:.]\d\d")
_RULE = re.compile(r"[\s|+=_*~#.:-]{3,}$")

#: ASCII letters in lower case, all else blank; marks of symbols, all else blank.
_LETTERS = {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(128)}
_SIGNS = {i: " " if chr(i).isalnum() or chr(i).isspace() or chr(i) in ".,;:!?'\"()-" else "#" for i in range(128)}


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    if text.isascii():
        return text.translate(_LETTERS).split()
    found = _WORD.findall(text.casefold())
    if all(map(str.isalpha, found)):
        return found
    return [p for w in found for p in "".join(c if c.isalpha() else " " for c in w).split()]  # without fractions and the like


def _symbols(text: str) -> int:
    """Characters that are neither letters, digits, white space nor marks of running text."""
    return text.translate(_SIGNS).count("#") if text.isascii() else sum(map(len, _SYMBOL.findall(text)))


def _digits(text: str) -> int:
    return sum(map(text.count, "0123456789")) if text.isascii() else sum(map(len, _DIGIT.findall(text)))


def delimiters(line: str) -> set[tuple]:
    """What of a line can stand below its like in another: (kind, which or where)."""
    out: set[tuple] = set()
    m = _MARK.match(line)
    if m:
        out.add(("mark", m.group(1) if m.group(3) is None else f"{m.group(2)}1{m.group(3)}"))
    for d, least in (("|", 2), ("\t", 1), (";", 2), (",", 2)):
        n = line.count(d)
        if n >= least:
            out.add((d, n))
    if "  " in line:
        out.update(("column", g.end(1)) for g in _GAP.finditer(line))
    if ":" in line or "=" in line:
        k = _KEY.match(line)
        if k:
            out.add(("key", k.group(1)))
    bare = line.strip()
    last = bare[-1:]
    if last in ",;:":
        out.add(("end", last))
    elif last in "{}()[]\\":
        out.add(("end", "{"))
    elif last in ".!?" and len(bare.split(None, ITEM_WORDS)) <= ITEM_WORDS:
        out.add(("end", "."))
    if "...." in bare and bare.rstrip("0123456789").rstrip().endswith("...."):
        out.add(("leader", ""))
    if (bare[:1].isdigit() or bare[:1] in "[(") and _STAMP.match(bare):
        out.add(("stamp", ""))
    if _RULE.match(line):
        out.add(("rule", ""))
    return out


def autocorrelation(x: np.ndarray) -> float:
    """Lag-1 autocorrelation about zero: 1 for equal values and for fewer than two, lower the more neighbours differ."""
    if len(x) < 2:
        return 1.0
    scale = float(np.sqrt((x[1:] @ x[1:]) * (x[:-1] @ x[:-1])))
    return float(x[1:] @ x[:-1]) / scale if scale else 1.0


def period(x: np.ndarray) -> float:
    """The strongest autocorrelation about the mean of indents within the next eight lines, 0 for none or flat ones."""
    if len(x) < 3 or (x == x[0]).all():
        return 0.0
    d = x - x.mean()
    var = float(d @ d)
    return max(float(d[k:] @ d[:-k]) / var for k in range(1, min(8, len(x) - 1) + 1))


class Stretch:
    """Counts of some lines of a text."""

    def __init__(self, lines: list[str], aligned: bool):
        text = "\n".join(lines)
        self.lines, self.aligned, self.size = lines, aligned, len(text)
        words = words_of(text)
        self.words, self.letters, self.common = len(words), sum(map(len, words)), sum(map(WORDS.__contains__, words))
        self.symbols, self.digits = _symbols(text), _digits(text)
        self.ends = sum(bool(_PUNCT_END.search(x.rstrip()[-8:])) for x in lines)
        self.sentences = len(_SENTENCE.findall(text))
        parts = text.split()
        self.inked = sum(map(len, parts))
        wide = 0 if text.isascii() else len(_WIDE.findall(text))
        self.running = max(self.words, wide // 2)  # scripts without spaces: two characters count as a word
        self.line_words = max(len(parts), wide // 2) / len(lines)

    def score(self, weights: dict[str, float]) -> float:
        """Positive for structure, negative for prose."""
        lengths = np.array([len(x.rstrip()) for x in self.lines[:-1]], dtype=float)
        indents = np.array([len(x) - len(x.lstrip()) for x in self.lines], dtype=float)
        short = min(1.0, max(0.0, (SHORT - self.line_words) / 4))
        common = self.common / self.words if self.words else 0.0
        per = self.running / max(1, self.sentences)
        if self.sentences and per <= SENTENCE_WORDS:
            unended = -0.5 if per >= 3 else 0.0
        else:
            unended = 0.2 if self.words < 12 else 0.8 if self.words < 25 else 5.6
        return (
            weights["base"]
            + weights["aligned"] * self.aligned
            + weights["period"] * min(0.5, max(0.0, period(indents)))
            + min(3.0, weights["ragged"] * (1 - autocorrelation(lengths))) * short
            + max(-3.4, min(0.6, weights["uncommon"] * (0.22 - common)))
            + max(-0.4, min(2.0, weights["symbols"] * (self.symbols / self.size - 0.03)))
            + max(-0.5, min(1.5, weights["marks"] * (0.85 - self.letters / max(1, self.inked))))
            + weights["sentences"] * unended
            + weights["lengths"] * (self.running == self.words and not 2 * self.words <= self.letters <= 16 * self.words)
            - weights["ends"] * (self.ends / len(self.lines) - 0.5)
        )


def stretches(lines: list[str]) -> tuple[list[Stretch], list[set[tuple]]]:
    """The stretches of a text, and the delimiters of each line that is not blank."""
    marks = [delimiters(x) if x and not x.isspace() else None for x in lines]
    runs: list[tuple[list[str], bool, bool]] = []  # lines, aligned, all short and unaligned
    open_ = False
    for i, m in enumerate(marks):
        if m is None:
            open_ = False
            continue
        aligned = bool(m) and any(0 <= j < len(marks) and marks[j] and not m.isdisjoint(marks[j]) for j in (i - 1, i + 1))
        if not open_ or runs[-1][1] != aligned:
            runs.append(([], aligned, False))
            open_ = True
        runs[-1][0].append(lines[i])
    # runs of short lines without delimiters that follow each other are one, blank lines between or not
    joined: list[tuple[list[str], bool, bool]] = []
    for own, aligned, _ in runs:
        items = not aligned and all(len(x.split(None, ITEM_WORDS)) < ITEM_WORDS for x in own)
        if items and joined and joined[-1][2]:
            joined[-1][0].extend(own)
        else:
            joined.append((own, aligned, items))
    return [Stretch(own, aligned) for own, aligned, _ in joined], [m for m in marks if m is not None]


def measure(text: str, weights: dict[str, float] = WEIGHTS) -> tuple:
    """The columns of DDL after the id, for a text that is not blank."""
    parts, marks = stretches(_LINE_ENDS.split(text))
    lines = [x for p in parts for x in p.lines]
    total = lambda name: sum(getattr(p, name) for p in parts)
    words, size, n = total("words"), len(text), len(lines)
    aligned = sum(len(p.lines) for p in parts if p.aligned)
    items = sum(any(k == "mark" for k, _ in m) for m in marks)
    cells = sum(any(k in "|\t;," or k == "column" for k, _ in m) for m in marks)
    bad = sum(p.size for p in parts if p.score(weights) > 0)
    share = 1 - bad / total("size")
    return (
        size, words, total("letters") / words if words else None, total("symbols") / size, total("digits") / size, n, total("ends") / n, total("common") / words if words else None,
        items / n, cells / n, aligned / n, period(np.array([len(x) - len(x.lstrip()) for x in lines], dtype=float)), autocorrelation(np.array([len(x) for x in lines], dtype=float)), share, share >= 0.5,
    )


_NONE = (None,) * 15
_BLANK = (0, 0, None, None, None, 0, None, None, None, None, None, None, None, None, None)


def _measure_batches(weights: dict[str, float]):
    types = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64(), *[pa.float64()] * 8, pa.bool_()]
    names = [x.split()[0] for x in DDL.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id_, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = t.as_py()
                rows.append((id_, *(_NONE if text is None else measure(text, weights) if text.strip() else (len(text), *_BLANK[1:]))))
            cols = list(zip(*rows)) if rows else [()] * 16
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def text_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """One row of DDL per document."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(_measure_batches(weights), DDL)
