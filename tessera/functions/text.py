"""Terms, keys and text predicates, as column expressions; Porter stems as a pandas UDF."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English words that carry no meaning for search.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def content_terms(text: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(terms(text), lambda t: ~F.array_contains(stop, t))


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(terms(text))


def initial(text: Column) -> Column:
    """The first letter in upper case, as one letter always: where that has none of its own, as it is."""
    first = F.translate(F.substring(text, 1, 1), "ß", "ẞ")
    one = lambda c: F.when(F.char_length(c) <= 1, c)
    return F.coalesce(one(F.upper(first)), one(F.initcap(first)), first)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(F.coalesce(text, F.lit(""))) + 1) / 2)).cast("long")


def key16(*parts: Column) -> Column:
    """Sixteen hex digits that stand for the parts; nulls are told from empty strings."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256), 1, 16)


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return key16(F.least(a, b), F.greatest(a, b))


def secret_reason(text: Column) -> Column:
    """Why a text looks as if it held a secret; null if it does not."""
    return (
        F.when(text.rlike(r"(?i)(recovery|backup) code"), "recovery_code")
        .when(text.rlike(r"(?i)(password|passwd|secret|api[_-]?key|token)[ ]*[:=]"), "assignment")
        .when(text.rlike(r"sk-[A-Za-z0-9]{16,}"), "key_prefix")
        .when(text.rlike(r"\b(AKIA|ghp_|xox[bp]-)[A-Za-z0-9-]{8,}"), "key_prefix")
    )


def low_value_reason(text: Column) -> Column:
    bare = F.trim(text)
    return (
        F.when(bare == "", "empty")
        .when(bare.rlike(r"^[vV]?[0-9]+([.][0-9]+)*[.]?$"), "number_or_version")
        .when(F.lower(bare).isin("ok", "healthy", "running", "up", "down", "done"), "health_word")
        .when(F.length(bare) < 5, "too_short")
    )


def event_filter_reason(text: Column) -> Column:
    """Why a message is not worth extracting from; null if it is."""
    bare = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(F.length(bare) < 5, "too_short")
        .when(bare.rlike(r"^(ok|okay|yes|no|thanks|thank you|got it|done)[.!]*$"), "acknowledgement")
        .when(bare.rlike(r"^[{\[].*[}\]]$"), "raw_output")
        .when((F.length(bare) < 40) & bare.rlike(r"^(status|progress|state):"), "status_report")
    )


def intent(query: Column) -> Column:
    """Route a query by its words; the first that matches wins."""
    q = F.lower(query)
    return (
        F.when(q.rlike(r"\b(was|were|previously|before|history|used to)\b"), "historical")
        .when(q.rlike(r"\b(prefer|preference|favou?rite|like)\b"), "preference")
        .when(q.rlike(r"\b(tool|command|api)\b"), "tool")
        .when(q.rlike(r"\b(how|steps|procedure)\b"), "procedure")
        .otherwise("current")
    )


def canonical(value):
    """A JSON value in one form: strings in one case without outer spaces, keys in order."""
    if isinstance(value, str):
        return unicodedata.normalize("NFKC", value).strip().casefold()
    if isinstance(value, dict):
        return {k: canonical(v) for k, v in sorted(value.items())}
    return [canonical(v) for v in value] if isinstance(value, list) else value


def _canonical_text(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(canonical(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (json.JSONDecodeError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON texts in one form, as hashes of facts need it; null where a text is not JSON. Of equal keys the last counts."""
    return text.map(_canonical_text)


class _Porter:
    """M. Porter's stemmer of 1980: measure-guarded suffix rules in five steps."""

    # The suffix rules of the published algorithm.
    STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
    STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def shape(word: str) -> str:
        out = ""
        for i, c in enumerate(word):
            vowel = c in "aeiou" or c == "y" and i > 0 and out[-1] == "c"
            out += "v" if vowel else "c"
        return out

    def measure(self, stem: str) -> int:
        return self.shape(stem).count("vc")

    def short(self, stem: str) -> bool:
        return len(stem) >= 3 and self.shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    def double(self, stem: str) -> bool:
        return len(stem) >= 2 and stem[-1] == stem[-2] and self.shape(stem)[-1] == "c"

    def rules(self, word: str, table: tuple, least: int) -> str:
        for end, new in sorted(table, key=lambda r: -len(r[0])):
            if word.endswith(end):
                stem = word[: -len(end)]
                return stem + new if self.measure(stem) > least else word
        return word

    def stem(self, word: str) -> str:
        if len(word) <= 2 or not word.isascii() or not word.isalpha():
            return word
        if word.endswith("s"):
            word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
        if word.endswith("eed"):
            word = word[:-1] if self.measure(word[:-3]) > 0 else word
        else:
            for end in ("ed", "ing"):
                if word.endswith(end) and "v" in self.shape(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif self.double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif self.measure(word) == 1 and self.short(word):
                        word += "e"
                    break
        if word.endswith("y") and "v" in self.shape(word[:-1]):
            word = word[:-1] + "i"
        word = self.rules(self.rules(word, self.STEP2, 0), self.STEP3, 0)
        for end in sorted(self.STEP4, key=lambda e: -len(e)):
            if word.endswith(end):
                stem = word[: -len(end)]
                if self.measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                    word = stem
                break
        if word.endswith("e") and (self.measure(word[:-1]) > 1 or self.measure(word[:-1]) == 1 and not self.short(word[:-1])):
            word = word[:-1]
        return word[:-1] if self.double(word) and word[-1] == "l" and self.measure(word) > 1 else word


porter = _Porter().stem


@F.pandas_udf(StringType())
def porter_stem(word: pd.Series) -> pd.Series:
    """Stems of distinct words: apply it to a vocabulary, not to every occurrence."""
    return word.map(lambda w: None if w is None else porter(w))
