"""License scan: ordered signature rules behind a keyword prefilter.

A rule is a pattern over the words of a text, a label, a priority and a confidence. It runs only on texts that hold its keywords,
which are taken from the pattern. Rules run by priority, then as listed; a detection that lies inside one of a rule before it is
dropped, so a name inside a full notice does not count twice.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
from pyspark.sql import DataFrame

from dizin.llm import license_texts
from dizin.llm.common import with_judgement, words_of

#: Label, pattern of the license's name in lower-case words.
NAMES = (
    ("mit", "(?:mit|expat)(?: license)?"),
    ("mit-0", "mit no attribution"),
    ("x11", "x11(?: license)?"),
    ("apache-2.0", "apache(?: software)?(?: license)?(?: version)? (?:v2|2)(?: 0)?"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-1.0", "apache(?: software)?(?: license)?(?: version)? 1 0"),
    ("gpl-1.0", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?1(?: 0)?"),
    ("gpl-2.0", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-3.0", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?v?3(?: 0)?"),
    ("lgpl-2.0", "(?:gnu )?(?:library|lesser) general public license(?: version| v)? ?v?2(?: 0)?(?! 1)"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?v?2 1"),
    ("lgpl-3.0", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?v?3(?: 0)?"),
    ("agpl-3.0", "(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?v?3(?: 0)?"),
    ("gfdl-1.3", "(?:gnu )?free documentation license(?: version)? 1 [123]"),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: license)?"),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: license)?"),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: license)?"),
    ("0bsd", "(?:0bsd|zero clause bsd)(?: license)?"),
    ("isc", "isc(?: license)?"),
    ("mpl-1.1", "(?:mozilla public license|mpl)(?: version| v)? 1 1"),
    ("mpl-2.0", "(?:mozilla public license|mpl)(?: version| v)? 2 0"),
    ("epl-1.0", "(?:eclipse public license|epl)(?: version| v)? 1 0"),
    ("epl-2.0", "(?:eclipse public license|epl)(?: version| v)? 2 0"),
    ("cddl-1.0", "(?:common development and distribution license )?cddl(?: version| v)?(?: 1 0)?"),
    ("cc0-1.0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-4.0", "(?:cc by|creative commons attribution) 4 0"),
    ("cc-by-3.0", "(?:cc by|creative commons attribution) 3 0"),
    ("cc-by-sa-4.0", "(?:cc by sa|creative commons attribution sharealike) 4 0"),
    ("cc-by-sa-3.0", "(?:cc by sa|creative commons attribution sharealike) 3 0"),
    ("cc-by-nc-4.0", "(?:cc by nc|creative commons attribution noncommercial) 4 0"),
    ("cc-by-nc-3.0", "(?:cc by nc|creative commons attribution noncommercial) 3 0"),
    ("cc-by-nd-4.0", "(?:cc by nd|creative commons attribution noderivatives) 4 0"),
    ("cc-by-nc-sa-4.0", "(?:cc by nc sa|creative commons attribution noncommercial sharealike) 4 0"),
    ("cc-by-nc-nd-4.0", "(?:cc by nc nd|creative commons attribution noncommercial noderivatives) 4 0"),
    ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl(?: license)?"),
    ("zlib", "zlib(?: libpng)?(?: license)?"),
    ("boost-1.0", "boost software license(?: version)?(?: 1 0)?"),
    ("artistic-2.0", "artistic license(?: version)? 2(?: 0)?"),
    ("artistic-1.0", "artistic license(?: version)? 1(?: 0)?"),
    ("python-2.0", "python software foundation license(?: version)?(?: 2)?"),
    ("postgresql", "postgresql license"),
    ("openssl", "openssl license"),
    ("eupl-1.2", "european union public license(?: version)?(?: 1 [12])?"),
    ("ofl-1.1", "(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("odbl-1.0", "open database license(?: version)?(?: 1 0)?"),
    ("bsl-1.1", "business source license(?: version)?(?: 1 1)?"),
    ("sspl-1.0", "server side public license(?: version)?(?: 1)?"),
    ("proprietary", "all rights reserved"),
    ("public-domain", "public domain"),
)
#: Kind of notice, its pattern around a name, priority, confidence.
NOTICES = (
    ("identifier", "spdx license identifier {}", 5, 1.0),
    ("grant", "(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{}", 4, 0.95),
    ("permission", "(?:subject to|governed by|covered by|permitted by) (?:the )?(?:terms of )?(?:the )?{}", 3, 0.85),
    ("header", "license (?:is )?(?:the )?{}", 2, 0.7),
    ("mention", "{}", 1, 0.5),
)
#: The base phrases and their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
BASE_CONFIDENCE = 0.5


#: Names that are words of their own, or name software too. Without a notice they count only as written here.
MENTIONS = {
    "mit": "(?:mit|expat) (?:style )?licen[cs]ed?|(?:mit|expat) (?:or|and) (?:the )?(?:apache|bsd|gpl|lgpl|isc|unlicense|zlib)|(?:mit|expat) apache (?:2|license)"
    "|(?:apache(?: license)?(?: version)?(?: v?2)?(?: 0)?|bsd|gpl v?[23](?: 0)?|isc|unlicense|zlib) (?:or|and) (?:the )?(?:mit|expat)",
    "x11": "x11 (?:style )?licen[cs]ed?",
    "isc": "isc (?:style )?licen[cs]ed?",
    "zlib": "zlib(?: libpng)? (?:style )?licen[cs]ed?",
    "bsd-2-clause": "simplified bsd(?: license)?|bsd 2 clause(?: license)?|2 clause bsd(?: license)?|freebsd license",
    "wtfpl": "wtfpl(?: license)?",
}


@dataclass(frozen=True)
class Rule:
    label: str
    needs: tuple[frozenset[str], ...]
    pattern: re.Pattern
    priority: int
    confidence: float


def needs(parsed) -> list[frozenset[str]]:
    """Sets of strings, of each of which any match of the pattern holds one; no sets where nothing is certain."""
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        if run.strip():
            found.append(frozenset([run]))
        run = ""
        if op is sre.SUBPATTERN:
            found += needs(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0]:
            found += needs(arg[2])
        elif op is sre.BRANCH:
            each = [max(needs(b), key=_shortest, default=None) for b in arg[1]]
            if None not in each:
                found.append(frozenset().union(*each))
    return found


def _shortest(words: frozenset[str]) -> int:
    return min(map(len, words))


def rule(label: str, form: str, priority: int, confidence: float) -> Rule:
    """The rule of a pattern over whole words. Its longest keywords are asked first, those of one letter not at all."""
    keywords = sorted({k for k in needs(parser.parse(form)) if _shortest(k) > 1}, key=lambda k: (-_shortest(k), sorted(k)))
    return Rule(label, tuple(keywords), re.compile(rf"(?<= )(?:{form})(?= )"), priority, confidence)


class Ordered(list):
    """Rules in order, with an automaton that finds all their keywords in one pass over a text."""

    def __init__(self, made: list[Rule]):
        super().__init__(made)
        self.keywords = ahocorasick.Automaton()
        for word in {w for r in made for words in r.needs for w in words}:
            self.keywords.add_word(word, word)
        self.keywords.make_automaton()
        #: Rules by the keywords that are asked first, and those without any.
        self.by_word: dict[str, list[int]] = {}
        for i, r in enumerate(made):
            for word in r.needs[0] if r.needs else ():
                self.by_word.setdefault(word, []).append(i)
        self.always = [i for i, r in enumerate(made) if not r.needs]

    def asked(self, norm: str) -> list[Rule]:
        """The rules whose keywords the text has, in order."""
        present = {word for _, word in self.keywords.iter(norm)}
        some = {i for word in present for i in self.by_word.get(word, ())}
        return [self[i] for i in sorted({*self.always, *some}) if not any(map(present.isdisjoint, self[i].needs))]


@lru_cache(maxsize=1)
def rules(names=NAMES, notices=NOTICES) -> Ordered:
    """The signatures of license texts, then one rule per notice and name, by priority, then as listed."""
    made = [rule(label, license_texts.pattern(text), priority, license_texts.CONFIDENCE) for label, text, priority in license_texts.SIGNATURES]
    for kind, form, priority, confidence in notices:
        for label, name in names:
            made.append(rule(label, form.format(f"(?:{MENTIONS.get(label, name) if kind == 'mention' else name})"), priority, confidence))
    return Ordered(sorted(made, key=lambda r: -r.priority))


def detect(norm: str, ordered: Ordered, gated: bool = True) -> list[tuple[int, int, Rule]]:
    """Detections left after suppression, in the order of the rules. ``norm``: lower-case words between single spaces.

    Not ``gated``, all patterns run, with the same detections.
    """
    kept: list[tuple[int, int, Rule]] = []
    starts, ends = [], []  # of what is kept, by start, and the farthest end up to each
    for r in ordered.asked(norm) if gated else ordered:
        before = len(kept)
        for m in r.pattern.finditer(norm):
            at = bisect_right(starts, m.start())
            if not at or ends[at - 1] < m.end():  # matches of one rule never hold one another
                kept.append((m.start(), m.end(), r))
        if len(kept) > before:
            spans = sorted((a, b) for a, b, _ in kept)
            starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    return kept


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_text(text: str | None, ordered: Ordered) -> tuple:
    words = words_of(text)
    norm = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in BASE:
        seen = at = 0  # words before, counted on from the last place
        while (to := norm.find(b" " + phrase + b" ", at)) >= 0:
            seen, at = seen + norm.count(b" ", at, to + 1), to + 1
            places.append(seen - 1)
            base.add(label)
    found = detect(norm.decode("utf-8", "surrogatepass"), ordered)
    labels = base | {rule.label for *_, rule in found}
    miss = 1 - BASE_CONFIDENCE if base else 1.0
    best: dict[str, float] = {}
    for *_, r in found:
        best[r.label] = max(best.get(r.label, 0.0), r.confidence)
    for confidence in best.values():
        miss *= 1 - confidence
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - miss, 6)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the licenses of each whole text.

    ``n_base``, ``first_word`` and ``last_word`` count and place the base phrases (word positions from
    0, null without any); ``labels`` has those and the rules', ``score`` how sure they are together.
    Null and wordless texts have no license. Columns of these names are replaced.
    """

    def prepare():
        ordered = rules()
        return lambda body: scan_text(body, ordered)

    return with_judgement(docs, text, keep, COLUMNS, prepare)


def digest(documents: DataFrame) -> DataFrame:
    """``scan`` by doc_id alone. Null ids stay null, and repeated rows are scanned and returned each."""
    return scan(documents, keep=["doc_id"])
