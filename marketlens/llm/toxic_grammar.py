"""A weighted finite-state grammar of abusive clauses.

Small transducers turn words into symbols: insult (with a learned weight), threat, target,
negation and reported speech. Their composition reads a clause from left to right and tells what
it says: an insult or a threat, plain, at somebody, denied, or told of others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

# Words of the grammar.
INSULTS = (
    "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown "
    "imbecile dumb degenerate vermin filth freak idiote stupide imbécile connard crétin salaud "
    "dummkopf arschloch trottel abschaum estúpido imbécil escoria basura inútil"
).split()
THREATS = "kill hurt destroy beat burn hang shoot stab tuer frapper töten umbringen schlagen matar golpear".split()
TARGETS = (
    "you your yours yourself u ur he she they him her them toi vous tu te ton du dich dir ihr euch "
    "sie tú ti usted ustedes vosotros"
).split()
NEGATIONS = "not no never isn't aren't don't without nicht kein keine nie ne pas jamais sans nunca jamás sin".split()
REPORTS = (
    "said says say called calls wrote writes claimed claims quoted told reported sagte schrieb nannte "
    "dit écrit appelé dijo escribió llamó"
).split()

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
CLAUSE_END = re.compile(r"[.!?;:\n|]")
#: Words over which a negation holds.
REACH = 3

PLAIN, TARGETED, DENIED, REPORTED = "plain", "targeted", "denied", "reported"
KINDS = (PLAIN, TARGETED, DENIED, REPORTED)
#: Share of toxic documents among those whose clauses are of one kind, before any label is seen.
PRIOR = {PLAIN: 0.9, TARGETED: 0.95, DENIED: 0.3, REPORTED: 0.4}

_FIXED = {w: s for s, words in (("T", THREATS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}


def insult_pattern(terms: dict[str, float]) -> re.Pattern | None:
    """A search for any term at a word's start; terms that end in ``$`` are whole words."""
    stems = sorted((re.escape(t) for t in terms if not t.endswith("$")), key=len, reverse=True)
    whole = sorted((re.escape(t[:-1]) for t in terms if t.endswith("$")), key=len, reverse=True)
    parts = ([f"(?:{'|'.join(whole)})(?![^\\W_])"] if whole else []) + stems
    return re.compile(f"(?<![^\\W_])(?:{'|'.join(parts)})") if parts else None


def insult_weight(word: str, terms: dict[str, float]) -> float | None:
    """The insult transducer: the weight of the longest stem, or of the whole word, in ``terms``."""
    weight = terms.get(word + "$")
    size = len(word)
    while weight is None and size:
        weight = terms.get(word[:size])
        size -= 1
    return weight


def clauses(text: str, terms: dict[str, float]) -> Iterator[tuple[str, float]]:
    """Kind and weight of every clause that holds an insult or a threat against somebody.

    The automaton's state is what the clause has shown so far: a target, a report, a threat, and
    how many words ago a negation stood.
    """
    start = 0
    for end in [*(m.end() for m in CLAUSE_END.finditer(text)), len(text)]:
        best, denied, target, report, threat, since = None, False, False, False, False, REACH + 1
        for m in WORD.finditer(text, start, end):
            word = m[0]
            since += 1
            weight = insult_weight(word, terms)
            symbol = _FIXED.get(word) if weight is None else "I"
            if symbol == "N":
                since = 0
            elif symbol == "R":
                report = True
            elif symbol == "T":
                threat = since > REACH
            elif symbol == "Y":
                target = True
                if threat:  # a threat needs its target behind it
                    weight, threat = terms.get("<threat>", 0.0), False
            if weight is not None and (best is None or weight > best):
                best, denied = weight, since <= REACH
        if best is not None:
            yield (DENIED if denied else REPORTED if report else TARGETED if target else PLAIN), best
        start = end


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))
