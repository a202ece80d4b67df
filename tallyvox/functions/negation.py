"""Whether a text denies a phrase: a search over tokens, each occurrence judged by the words of its own clause.

The rules come twice, as column functions over arrays of tokens and for single texts inside tasks; both follow the list
below and a test holds them against each other. left is what stands before the phrase in its clause, nearest word first,
right what stands after it there, later everything after it.

    directly denied    not loud, never really loud, without any noise: the nearest word that is no degree is a denial
    lacking            less noise, missing screws, free of noise, needs more power: the lack stands right before
    no trouble         no issues with the noise: no, a trouble and its preposition, up to five words, no comma between
    never met          never noticed noise, zero (known) noise: up to three words between, no comma
    not the measure    not as loud as
    free of it         noise-free; no noise at all, no noise to speak of: up to four words between
    only wished        could be quieter in the sense of could be better ... quiet: up to nine words between
    not as claimed     supposed to be quiet ... but
    only at times      only loud on, just loud when
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import let

#: The words that the rules above speak of.
DENIALS = ["not", "never", "hardly", "barely", "isn't", "wasn't", "weren't", "ain't", "without"]
DEGREES = ["really", "very", "that", "quite", "at", "all"]
ARTICLES = ["any", "a"]
LACKS = ["less", "fewer", "lacking", "missing"]
NEEDS = ["need", "needs", "use"]
TROUBLES = ["issue", "issues", "problem", "problems", "complaint", "complaints", "trouble", "concern", "concerns"]
ABOUT = ["with", "from", "regarding", "about"]
MET = ["had", "experienced", "noticed", "encountered", "seen"]
WISHES = ["would", "could", "should"]
BETTER = ["more", "better", "nicer"]
CLAIMS = ["supposed", "expected", "meant", "claimed", "advertised"]
TURNS = ["but", "however", "yet", "instead", "unfortunately"]
ONLY, TIMES = ["only", "just"], ["on", "at", "when", "during", "in"]
CLOSINGS = [["at", "all"], ["whatsoever"], ["to", "speak", "of"]]
#: Marks that end a clause, marks that part words inside one, and other ASCII characters outside words, as patterns.
_MARKS = [("[’‘`]", "'"), ("[–—….!?;:\\n]", " . "), ('[,()\\[\\]"]', " , "), ("[\\x00-\\x1F#-&*+\\-/<-@\\\\^_{-\\x7F]", " ")]
STOP, PAUSE = ".", ","
#: Words before a phrase that are looked at first, more only while they leave open whether it is directly denied; and how near the better one must stand that was only wished.
REACH, WISHED = 13, 10


def tokens(text: str | None) -> list[str]:
    """Lower-case words, "." where a clause ends and "," where it pauses. Hyphens part words."""
    text = (text or "").lower()
    for pattern, said in _MARKS:
        text = re.sub(pattern, said, text)
    return [w for w in text.split(" ") if w]


def _before(words: list[str], stops: tuple[str, ...]) -> list[str]:
    return words[: next((i for i, w in enumerate(words) if w in stops), len(words))]


def _left(words: list[str], i: int) -> list[str]:
    """What stands before place i in its clause, nearest first: REACH words, or as many more as it takes to a second word that is no degree."""
    reach = REACH
    while True:
        part = words[max(0, i - reach) : i][::-1]
        left = _before(part, (STOP,))
        near = _before(left, (PAUSE,))
        if i <= reach or len(near) < len(part) or sum(w not in DEGREES for w in near) > 1:
            return left
        reach *= 2


def denied_at(left: list[str], right: list[str], later: list[str]) -> bool:
    """The rules above for one occurrence."""
    near, close = _before(left, (PAUSE,)), (*left, "", "", "")
    plain = [*(w for w in near if w not in DEGREES), "", ""]
    if plain[0] in DENIALS or (plain[0] in ARTICLES and plain[1] == "without"):
        return True
    if close[0] in LACKS or close[:2] == ("of", "free") or (close[0] == "more" and close[1] in NEEDS):
        return True
    for i, w in enumerate(near):
        ahead = [*near[:i][::-1], "", ""]  # what follows that word, in order
        if w == "no" and i <= 7 and ahead[0] in TROUBLES and ahead[1] in ABOUT:
            return True
        if (w == "never" and i <= 4 and ahead[0] in MET) or (w == "zero" and i <= 3):
            return True
    if close[:2] == ("as", "not") and right[:1] == ["as"]:
        return True
    if right[:1] == ["free"] or (close[0] == "no" and any(right[i : i + len(c)] == c for c in CLOSINGS for i in range(5))):
        return True
    if any(w in BETTER and close[i + 1] in ("be", "been") and close[i + (2 if close[i + 1] == "be" else 3)] in WISHES for i, w in enumerate(left[:WISHED])):
        return True
    claimed = close[1:3] if close[0] == "be" else close[:2]
    if claimed[0] == "to" and claimed[1] in CLAIMS and any(w in TURNS for w in later):
        return True
    return close[0] in ONLY and right[:1] != [] and right[0] in TIMES


@lru_cache(maxsize=50_000)
def _phrase(phrase: str) -> tuple[str, ...]:
    return tuple(w for w in tokens(phrase) if w not in (STOP, PAUSE))


def is_negated(phrase: str | None, text: str | None) -> bool:
    """Whether any occurrence of the phrase in text is denied, lacked, or only promised. Blank phrases and null texts: false."""
    said, words = _phrase(phrase or ""), tokens(text)
    n = len(said)
    if not n:
        return False
    for i in range(len(words) - n + 1):
        if words[i] == said[0] and tuple(words[i : i + n]) == said:
            left, right = _left(words, i), _before(words[i + n : i + n + REACH], (STOP,))
            if denied_at(left, right, words[i + n :]):
                return True
    return False


def token_array(text: Column) -> Column:
    """tokens() as a column function; null text has none."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for pattern, said in _MARKS:
        text = F.regexp_replace(text, pattern, said)
    return F.filter(F.split(text, " "), lambda w: w != "")


def _until(words: Column, stop: str) -> Column:
    at = F.array_position(words, stop).cast("int")
    return F.when(at > 0, F.slice(words, F.lit(1), at - 1)).otherwise(words)


def _denied(left: Column, right: Column, later: Column) -> Column:
    """denied_at() over arrays."""
    return let(_until(left, PAUSE), lambda near: let(_no_degrees(near), lambda plain: _by_rules(left, near, plain, right, later)))


def _no_degrees(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(DEGREES))


def _by_rules(left: Column, near: Column, plain: Column, right: Column, later: Column) -> Column:
    at = lambda words, i: F.coalesce(F.get(words, i if isinstance(i, Column) else F.lit(i)), F.lit(""))
    direct = at(plain, 0).isin(DENIALS) | (at(plain, 0).isin(ARTICLES) & (at(plain, 1) == "without"))
    lacking = at(left, 0).isin(LACKS) | ((at(left, 0) == "of") & (at(left, 1) == "free")) | ((at(left, 0) == "more") & at(left, 1).isin(NEEDS))
    trouble = F.exists(F.sequence(F.lit(2), F.lit(7)), lambda i: (at(near, i) == "no") & at(near, i - 1).isin(TROUBLES) & at(near, i - 2).isin(ABOUT))
    met = F.exists(F.sequence(F.lit(1), F.lit(4)), lambda i: (at(near, i) == "never") & at(near, i - 1).isin(MET)) | F.coalesce(F.array_position(near, "zero").between(1, 4), F.lit(False))
    measure = (at(left, 0) == "as") & (at(left, 1) == "not") & (at(right, 0) == "as")
    closed = F.exists(F.sequence(F.lit(0), F.lit(4)), lambda i: (at(right, i) == "whatsoever") | ((at(right, i) == "at") & (at(right, i + 1) == "all")) | ((at(right, i) == "to") & (at(right, i + 1) == "speak") & (at(right, i + 2) == "of")))
    free = (at(right, 0) == "free") | ((at(left, 0) == "no") & closed)
    wish = F.exists(F.sequence(F.lit(0), F.lit(WISHED - 1)), lambda i: at(left, i).isin(BETTER) & F.when(at(left, i + 1) == "be", at(left, i + 2).isin(WISHES)).when(at(left, i + 1) == "been", at(left, i + 3).isin(WISHES)).otherwise(False))
    to = F.when(at(left, 0) == "be", 1).otherwise(0)
    claimed = (at(left, to) == "to") & at(left, to + 1).isin(CLAIMS) & F.arrays_overlap(later, F.array(*map(F.lit, TURNS)))
    times = at(left, 0).isin(ONLY) & at(right, 0).isin(TIMES)
    return direct | lacking | trouble | met | measure | free | wish | claimed | times


def negated(phrase: str, words: Column) -> Column:
    """is_negated() as a column function over token_array(text)."""
    said = _phrase(phrase)
    n = len(said)
    if not n:
        return F.lit(False)
    size = F.size(words)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: (F.get(words, i - 1) == said[0]) & (F.slice(words, i, n) == F.array(*map(F.lit, said))) if n > 1 else F.get(words, i - 1) == said[0])

    def judged(i: Column) -> Column:
        before = lambda first: _until(F.reverse(F.slice(words, first, i - first)), STOP)
        open_ = lambda left: (F.size(left) == REACH) & (F.array_position(left, PAUSE) == 0) & (F.size(_no_degrees(left)) < 2)
        right, later = _until(F.slice(words, i + n, REACH), STOP), F.slice(words, i + n, F.greatest(size, F.lit(1)))
        whole = lambda left: F.when(open_(left), before(F.lit(1))).otherwise(left)
        return let(before(F.greatest(i - REACH, F.lit(1))), lambda near: let(whole(near), lambda left: let(right, lambda right: _denied(left, right, later))))

    return F.coalesce(F.exists(starts, judged), F.lit(False))
