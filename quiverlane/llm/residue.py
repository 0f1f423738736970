"""Texts that still hold parts of a template, filler, error messages or script notices.

Labelled exemplars (exemplars.py) are held in an inverted index from their terms. A term is a
meaning (concepts.py) that words of four languages share, or a word that has none there; what a
template leaves unfilled, commands that print filler, words of Latin filler and exact repetition
are terms as well. A passage of a document (latex.py) retrieves the exemplars that it may contain:
the index holds of each exemplar only so many of its weightiest terms that what is left weighs less
than the least containment, so nothing above it is missed. Every window of a passage, a run of
whole sentences, is then compared with the retrieved exemplars by terms weighted with TF-IDF:

* containment, the part of the exemplar's weight that the window has, and
* coverage, the part of the window's weight that the exemplar has, or that are meanings which
  other exemplars of its label have.

A window is residue if both are high: it then says what the exemplar says and little else. An
article that mentions such a text has the rest of its sentence around it, and what it quotes,
emphasises or shows as code is one word to begin with.

Document frequencies are those of all documents, counted in a first pass for the terms of the
exemplars, whose number is fixed.

Defined results: null, empty and blank texts aren't cases. Rows are judged each on its own, so
repeated ones come out as often as they stand in the table.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlane.llm import concepts, exemplars, latex
from quiverlane.runtime import spread

#: Least containment of an exemplar in a window, and least coverage of the window by it.
CONTAINMENT, COVERAGE = 0.7, 0.79
#: A window has at least so many of an exemplar's terms, or all if there are fewer, and they have at
#: least this weight together.
LEAST_TERMS, EVIDENCE = 3, 3.5
#: Least containment and coverage of passages whose terms are too common for that.
WHOLLY = 0.95
#: Words of Latin filler in its exemplar, and the least coverage by them.
FILLER_WORDS, FILLER_COVERAGE = 5, 0.8
#: Bounds of a term's weight, and the weight of words that no exemplar has.
LEAST, MOST, OTHER = 0.3, 6.0, 4.0

SLOT, UNFILLED, NUMBER, WRAPPED, REPEATED, LATIN = "⟨slot⟩", "⟨unfilled⟩", "#", "⟨wrapped⟩", "⟨repeated⟩", "⟨latin⟩"
#: A passage that says nothing but one or two words over and over, or one sentence, is filler
#: whatever the words: at least so many times, and so many words.
REPEAT_TIMES, REPEAT_WORDS = 3, 5

#: Lines count for frequencies if they hold so many words that no exemplar has: residue itself, however
#: many documents are copies of it, doesn't make its own terms common.
PROSE_WORDS = 5
#: Documents without any term that are counted along, so that small tables have weights as well.
PRIOR = 1000

#: What authors leave where something is to be added; in small letters these are words of other languages.
TO_DO = frozenset(("TODO", "TBD", "TBA", "FIXME"))
_NAMES = "|".join(sorted(exemplars.SLOT_NAMES, key=len, reverse=True))
_IDENT = rf"[A-Za-z_][\w.\-]*(?:\[\w*\][\w.]*)*"
_LABEL = rf"(?:[a-z0-9]+[_\s.]){{0,2}}(?:{_NAMES})(?:[_\s.][a-z0-9]+){{0,2}}"
#: What a template engine, a mail merge or a script leaves where a value should stand.
_SLOT = re.compile(
    rf"\{{\{{+\s*{_IDENT}(?:\s*\|[^{{}}\n]*)?\s*\}}\}}+|\$\{{\s*{_IDENT}\s*\}}|#\{{\s*{_IDENT}\s*\}}|<%=?\s*{_IDENT}\s*%>|\{{%\s*{_IDENT}[^{{}}%\n]*%\}}|@@\s*{_IDENT}\s*@@|%%?[A-Z][A-Z_0-9]+%%?|__[A-Z][A-Z_0-9]*__|\[\[\s*[A-Z][A-Z_0-9]+\s*\]\]"
    rf"|(?i:<<?\s*{_LABEL}\s*>>?|\[\[?\s*{_LABEL}\s*\]?\]|\[object\s+object\])"
)
#: Those that nothing but a template leaves, in an unescaped text; they count whatever stands around
#: them. Braces that aren't escaped may group, and brackets may be the author's.
_SURE_SLOT = re.compile(rf"\ue001\ue001\s*{_IDENT}(?:\s*\|[^{{}}\ue001\ue002\n]*)?\s*\ue002\ue002|\ue003\ue001\s*[A-Za-z_][\w.\-]+\s*\ue002|@@\s*{_IDENT}\s*@@|__[A-Z][A-Z_0-9]*__|\{{\{{\s*[A-Za-z]\w*(?:[._]\w+)+\s*\}}\}}")
_HTML = re.compile(r"</?(?:html|head|body|title|h[1-6]|hr|p|div|span|center|noscript|br|b|i|a)(?:\s+[\w-]+\s*=[^<>]*)?\s*/?>", re.I)
_WORD = re.compile(r"⟨\w+⟩|[^\W_]+(?:['’][^\W_]+)?")
#: Paths, addresses and dotted names count as numbers do, but for the names of errors in them.
_FAULT = re.compile(r"\w+(?:Error|Exception)\b")
_PATH = re.compile(r"(?<![\w.])[\w$-]*(?:[./:\\]+[\w$<>-]+){2,}(?:\([^()\s]*\))?")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_FILLER_COMMAND = re.compile(r"\\(?:" + "|".join(exemplars.FILLER_COMMANDS) + r")\*?(?![A-Za-z])(?:\s*\[[^\]]*\])*")
#: Signs in an unescaped text that a slot, a command that prints filler, or a bracketed passage may be
#: in it, each after a text that every match of it holds.
_NEEDLES = [
    (needle, re.compile(p))
    for needle, p in (
        *((o + o, rf"{re.escape(o + o)}\s*[A-Za-z_][\w.\-]+") for o in ("{", "\ue001")),
        *((d + o, rf"{re.escape(d + o)}\s*[A-Za-z_]") for d in ("$", "\ue003", "#") for o in ("{", "\ue001")),
        *((p, rf"{p}[A-Z][A-Z_0-9]+{p}") for p in ("%", "\ue000")),
        *((n, p) for n, p in (("[[", r"\[\[\s*[A-Z][A-Z_0-9]+\s*\]\]"), ("<%", "<%"), ("{%", r"\{%"), ("\ue001\ue000", "\ue001\ue000"), ("@@", "@@"), ("__", "__[A-Z]"))),
        *((n, rf"{re.escape(n)}\s*(?i:{_LABEL}|object\s+object)\s*(?:[>\]]|\\text)") for n in ("<", "[", "less", "less{}")),
        *((n, rf"{b}[ \t]*{re.escape(n)}[^\W\d_]") for n in ("<", "[") for b in (r"\A", r"\n", r"\{")),
        *(("\\" + c, rf"\\{c}(?![A-Za-z])") for c in exemplars.FILLER_COMMANDS),
        *((w, rf"{w}\b") for w in sorted(TO_DO)),
    )
]
_SIGNS = [sign for _, sign in _NEEDLES]
#: One of these is in every slot.
_SLOT_SIGN = re.compile(r"\{\{|[$#]\{|<|\[|@@|%|__|\{%")


def words(text: str, runs: bool = False) -> list[str]:
    """The words of a readable text in lower case; those with digits are one, as are runs of X unless ``runs``."""
    if _SLOT_SIGN.search(text):
        text = _SLOT.sub(f" {SLOT} ", text)
    text = _NOT.sub("cannot", _PATH.sub(lambda m: " ".join(_FAULT.findall(m[0])) or " 0 ", text))
    return [w.lower() if w.isalpha() and len(w) > 1 and w not in TO_DO and (runs or w[:2] != "XX") else _odd_word(w) for w in _WORD.findall(text)]


def _odd_word(w: str) -> str:
    if w[0] == "⟨" or w in STATUS:
        return w
    if w in TO_DO:
        return "placeholder"
    if len(w) == 1 and w.isupper() and w not in "AIY":
        return NUMBER  # Author B
    if not w.strip("X"):
        return NUMBER
    if any(map(str.isdigit, w)):
        # Author1, keyword2
        name = w.rstrip("0123456789").lower()
        return name if name in concepts.meanings() else NUMBER
    return w.lower().replace("’", "'")


_NOT = re.compile(r"\b(?:could|can|did)\s+not\b", re.I)
#: Numbers that have a meaning.
STATUS = frozenset(concepts.MEANINGS["status"].split())
#: Words of Latin filler that are no words of the four languages.
STOCK = frozenset(exemplars.LATIN_FILLER.split()) - frozenset(exemplars.COMMON_FILLER.split())


@lru_cache(maxsize=200_000)
def term(word: str) -> str:
    """What a word is compared as; nothing for words that say little."""
    if word in STOCK:
        return LATIN
    held = concepts.meaning(word)
    if held == word and "'" in word:  # l'article
        return next((m for part in reversed(word.split("'")) if (m := concepts.meaning(part)) != part and m), word)
    return held


def terms(said: list[str]) -> list[str]:
    return [t for w in said if (t := term(w))]


def sentences(text: str) -> list[list[str]]:
    """The terms of each sentence; a text that is bracketed as a whole begins with a mark."""
    text = text.strip()
    wrapped = False
    if not (text[:1] in "{$#<[@%_" and _SLOT.fullmatch(text)):
        stripped = _HTML.sub(" ", text) if "<" in text else text
        wrapped = len(text) > 2 and text[0] + text[-1] in ("[]", "<>") and stripped.strip() == text
        text = text if wrapped else stripped
    if wrapped:
        return [[WRAPPED, *terms(words(text))]]
    parts = [w for s in _SENTENCE.split(text) if (w := words(s))]
    if "&" not in text:  # rows of a table repeat themselves by their nature
        # runs of X are filler like any word
        said = [w for s in _SENTENCE.split(text) if (w := words(s, runs=True))] if "XX" in text else parts
        if _repeats(said):
            return [[REPEATED]]
    return [t for p in parts if (t := terms(p))]


def _repeats(parts: list[list[str]]) -> bool:
    said = [w for p in parts for w in p]
    if len(said) < REPEAT_WORDS or not any(map(str.isalpha, said[:2])):
        return False
    if len(parts) >= REPEAT_TIMES and all(p == parts[0] for p in parts[1:]):
        return True
    return any(len(said) >= REPEAT_TIMES * unit and said[unit:] == said[:-unit] for unit in (1, 2))


@dataclass(frozen=True)
class Exemplar:
    label: str
    text: str
    bag: Counter
    size: int  # sentences
    coverage: float = COVERAGE


def bank(*lines: Mapping[str, str]) -> list[Exemplar]:
    """The exemplars of texts by label (both lists of exemplars.py by default), and those told by their form."""
    out = []
    for texts in lines or (exemplars.EXEMPLARS, exemplars.GIVEN):
        for label, text in ((label, line) for label, block in texts.items() for line in block.strip().splitlines()):
            parts = sentences(text)
            out.append(Exemplar(label, text, Counter(w for p in parts for w in p), len(parts)))
    # what is told by its form: terms of their own, which count whatever stands around the sure ones
    out.append(Exemplar(exemplars.PLACEHOLDER, SLOT, Counter([SLOT]), 1))
    out.append(Exemplar(exemplars.PLACEHOLDER, UNFILLED, Counter([UNFILLED]), 1, 0.0))
    out.append(Exemplar(exemplars.FILLER, latex.FILLER, Counter([latex.FILLER]), 1, 0.0))
    out.append(Exemplar(exemplars.FILLER, REPEATED, Counter([REPEATED]), 1))
    out.append(Exemplar(exemplars.FILLER, "lorem ipsum", Counter({LATIN: FILLER_WORDS}), 1, FILLER_COVERAGE))
    return out


#: Terms that stand for something else than words have a fixed weight.
_FIXED = {SLOT: 2 * MOST, UNFILLED: 2 * MOST, latex.FILLER: 2 * MOST, REPEATED: 2 * MOST, LATIN: MOST, WRAPPED: 3.5, NUMBER: LEAST, latex.FORMULA: OTHER, latex.QUOTED: OTHER}


class Index:
    """The inverted index of the exemplars with the weights of their terms."""

    def __init__(self, frequency: dict[str, int], n_documents: int, entries: list[Exemplar] | None = None) -> None:
        self.entries = bank() if entries is None else entries
        vocabulary = {w for e in self.entries for w in e.bag}
        self.weight = {w: _FIXED.get(w) or min(MOST, max(LEAST, math.log((n_documents + PRIOR) / (frequency.get(w, 0) + 1)))) for w in vocabulary}
        self.total = [sum(self.weight[w] * n for w, n in e.bag.items()) for e in self.entries]
        self.postings: dict[str, list[int]] = defaultdict(list)
        #: Those of exemplars whose terms are all so common that only passages wholly in their terms count.
        self.common: dict[str, list[int]] = defaultdict(list)
        #: The meanings that exemplars of a label have.
        self.language: dict[str, set[str]] = defaultdict(set)
        for i, e in enumerate(self.entries):
            self.language[e.label] |= {w for w in e.bag if w[0] == "⟨" and w not in _FIXED}
            least, rest = WHOLLY if self.evidence(e.bag) < EVIDENCE else CONTAINMENT, self.total[i]
            for w in sorted(e.bag, key=lambda w: (-self.weight[w], w)):
                if rest < least * self.total[i]:
                    break
                (self.common if least == WHOLLY else self.postings)[w].append(i)
                rest -= self.weight[w] * e.bag[w]
        self.anchors = frozenset(self.postings) - {LATIN}
        self.known = _Known(frozenset(vocabulary))

    def evidence(self, distinct: Iterable[str]) -> float:
        return sum(self.weight[w] for w in distinct)

    def weigh(self, bag: Mapping[str, int]) -> float:
        get = self.weight.get
        return sum((get(w) or _FIXED.get(w, OTHER)) * n for w, n in bag.items() if w != NUMBER)

    def matches(self, text: str) -> Iterator[tuple[str, str, float, float]]:
        """Label, exemplar, containment and coverage of the best window of each passage that has residue."""
        passages = latex.passages(text, _FILLER_COMMAND)
        joined = "\n\n".join(passages)
        signs = [sign for needle, sign in _NEEDLES if needle in joined]
        for passage in passages:
            if latex.FILLER not in passage and not self.may_match(passage, signs):
                continue
            body = _SURE_SLOT.sub(f" {UNFILLED} ", latex.unquoted(passage))
            parts = sentences(body.translate(latex.PLAIN))
            if best := self._best(parts):
                yield best

    def _best(self, parts: list[list[str]]) -> tuple[str, str, float, float] | None:
        whole = Counter(w for p in parts for w in p)
        near = {i for w in whole for i in self.postings.get(w, ())}
        if all(w in self.known.vocabulary or w == NUMBER for w in whole):
            near.update(i for w in whole for i in self.common.get(w, ()))
        windows: dict[int, list[tuple[Counter, float]]] = {}
        best = None
        for i in sorted(near):
            e, weight = self.entries[i], self.weight
            # no window has more of the exemplar than the passage
            if sum(weight[w] * min(n, whole[w]) for w, n in e.bag.items() if w in whole) < CONTAINMENT * self.total[i]:
                continue
            language = self.language[e.label]
            for size in {*range(1, min(e.size + 1, len(parts)) + 1), len(parts)}:
                if size not in windows:
                    bags = [Counter(w for p in parts[at : at + size] for w in p) for at in range(len(parts) - size + 1)]
                    windows[size] = [(bag, max(LEAST, self.weigh(bag))) for bag in bags]
                for bag, total in windows[size]:
                    shared = [w for w in e.bag if w in bag]
                    if len(shared) < min(LEAST_TERMS, len(e.bag)):
                        continue
                    # a single word may be a name, unless the passage is nothing else
                    if len(shared) == 1 and shared[0] not in _FIXED and size < len(parts):
                        continue
                    weak = self.evidence(shared) < EVIDENCE
                    if weak and (size < len(parts) or sum(bag[w] for w in shared) < LEAST_TERMS):
                        continue
                    containment = sum(weight[w] * min(e.bag[w], bag[w]) for w in shared) / self.total[i]
                    if containment < (WHOLLY if weak else CONTAINMENT):
                        continue
                    # however often the window repeats what the exemplar says
                    coverage = self.weigh({w: n for w, n in bag.items() if w in e.bag or w in language or w == WRAPPED}) / total
                    if coverage >= (WHOLLY if weak else e.coverage) and (best is None or containment + coverage > best[2] + best[3]):
                        best = (e.label, e.text, containment, coverage)
        return best

    def may_match(self, text: str, signs: Iterable[re.Pattern] = _SIGNS) -> bool:
        """False only for texts without any term, repetition or sign that retrieves an exemplar."""
        said = raw_words(text)
        terms_found = list(map(self.known.__getitem__, said))
        found = set(terms_found)
        if not self.anchors.isdisjoint(found) or LATIN in found and terms_found.count(LATIN) >= FILLER_WORDS * CONTAINMENT or any(sign.search(text) for sign in signs):
            return True
        # passages wholly in the terms of exemplars; in HTML there are the names of tags as well
        if None not in found or "<" in text:
            return True
        # what is said REPEAT_TIMES has no more distinct words than a part of all, but for commands around it
        return 2 * len(set(said)) <= len(said)


#: Runs of letters, digits and the backslash of commands.
_RAW_WORD = re.compile(r"[\\\w]+")
#: Words whose terms a worker remembers.
REMEMBERED = 500_000


class _Known(dict):
    """Terms of raw words; None for words that aren't in a vocabulary, nothing for commands and numbers."""

    def __init__(self, vocabulary: frozenset[str]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> str | None:
        if len(self) >= REMEMBERED:
            self.clear()
        # what stands before a command, or nothing
        name = word.split("\\")[0].strip("_")
        plain = name.rstrip("0123456789")
        if not name or "_" in name or name not in STATUS and any(map(str.isdigit, name)) and plain not in concepts.meanings():
            held = ""
        else:
            held = term(name if name in STATUS else plain)
            held = held if not held or held in self.vocabulary else None
        self[word] = held
        return held


def raw_words(text: str) -> list[str]:
    """The words of an unescaped text in lower case, commands with their backslash; apostrophes part words."""
    return _RAW_WORD.findall(text.lower())


def prose_terms(text: str, known: _Known) -> set[str]:
    """Which of the terms stand in prose of an unescaped text."""
    found: set[str | None] = set()
    for line in text.split("\n"):
        held = list(map(known.__getitem__, raw_words(line)))
        if held.count(None) >= PROSE_WORDS:
            found.update(held)
    return found - {None, ""}


def document_frequencies(docs: DataFrame, text: str) -> tuple[dict[str, int], int]:
    """In how many documents each term of the exemplars stands in prose, and the number of documents with a text."""
    vocabulary = frozenset(w for e in bank() for w in e.bag)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        known = _Known(vocabulary)
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    seen.update(prose_terms(latex.unescaped(t.as_py()), known))
                    seen[""] += 1
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    # one row per term of the exemplars
    rows = spread(docs.select(text)).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return found, found.pop("", 0)


def residue_matches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, label, exemplar, containment, coverage``: a row per passage that is residue."""
    of = docs.schema[key].dataType.simpleString()
    frequency, n_documents = document_frequencies(docs, text)

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency, n_documents)
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1)):
                if t.is_valid:
                    for m in index.matches(latex.unescaped(t.as_py())):
                        at.append(i)
                        rows.append(m)
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            types = [pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], ["key", "label", "exemplar", "containment", "coverage"])

    return spread(docs.select(F.col(key), F.col(text))).mapInArrow(match, f"key {of}, label string, exemplar string, containment double, coverage double").withColumnRenamed("key", key)


def residue_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The distinct keys of documents with residue."""
    return residue_matches(docs, key, text).select(key).distinct()


def without_residue(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` that hold no residue; all columns are kept.

    Rows are judged each on its own, so neither a null ``key`` nor a repeated one makes a difference.
    """
    frequency, n_documents = document_frequencies(docs, text)
    at = docs.columns.index(text)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency, n_documents)
        for batch in batches:
            clean = [not (t.is_valid and any(True for _ in index.matches(latex.unescaped(t.as_py())))) for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return spread(docs).mapInArrow(keep, docs.schema)
