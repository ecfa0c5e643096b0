"""Line-first quality rules.

Each line of a text is judged on its own; lines that fail are removed; the document is rejected if too much of it went
with them, or if the text as a whole breaks a base rule (too few words, too much repetition).

Line rules, in this order, each reported under its name:
  navigation   menu separators are at least one word in five
  punctuation  more than one symbol in ten characters, more than one "!" or "?" in two words, or mostly capitals
  boilerplate  a short line with a stock phrase of licences, cookie notices, or site furniture, in English, French, German or Spanish
  punctuation  no sentence end anywhere in the line
A line without a word is neither kept nor counted as lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SPACE, StableHashes, gram_hashes

SYMBOLS = "#*$%&|<>"
SEPARATORS = frozenset(["|", "»", "›", "·", "•", "/", "::", ">", "→"])
#: Phrases of licence lines, notices and site furniture.
BOILERPLATE_PHRASES = [
    "all rights reserved", "licen[sc]ed under", "under the [A-Za-z0-9_ .-]{0,40}licen[sc]e", "creative commons", "cookie", "privacy policy",
    "terms of (?:use|service)", "javascript", "subscribe", "newsletter", "sign (?:in|up)", "log ?in\\b", "read more", "click here", "copyright", "©",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "s'abonner", "en savoir plus", "cliquez ici",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "weiterlesen", "hier klicken",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "suscríbete", "leer más", "haga clic",
]
BOILERPLATE_PATTERN = "|".join(BOILERPLATE_PHRASES)
BOILERPLATE = re.compile(BOILERPLATE_PATTERN, re.IGNORECASE)
SENTENCE_END_PATTERN = "[.!?…。！？।؟։][\"')\\]}»”’*_]*(?:[\\x09-\\x0D ]|$)"
_ENDS_IN_LINE = re.compile(SENTENCE_END_PATTERN)
_CAPITALS, _LETTERS = re.compile("[A-Z]"), re.compile("[A-Za-z]")

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("lost_punctuation", T.LongType()),
        T.StructField("lost_navigation", T.LongType()),
        T.StructField("lost_boilerplate", T.LongType()),
        T.StructField("n_lost_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    repeat_window: int = 5
    max_repeat_percent: int = 20
    max_lost_share: float = 0.5
    boilerplate_words: int = 30


def failed_rule(line: str, words: list[str], rules: Rules) -> str | None:
    """Name of the rule that a line with words breaks, or None."""
    n = len(words)
    if n > 2 and 5 * sum(w in SEPARATORS for w in words) >= n:
        return "navigation"
    if 10 * sum(map(line.count, SYMBOLS)) > len(line) or 2 * (line.count("!") + line.count("?")) > n:
        return "punctuation"
    letters = len(_LETTERS.findall(line)) if any(w.isupper() for w in words) else 0
    if letters >= 20 and 5 * len(_CAPITALS.findall(line)) > 3 * letters:
        return "punctuation"
    if n <= rules.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    if not _ENDS_IN_LINE.search(line):
        return "punctuation"
    return None


def repeated_words(words: list[bytes], hashes: np.ndarray, k: int) -> int:
    """Words that lie in a window of k words which the text has twice or more, the first one included."""
    grams = gram_hashes(hashes, k)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    starts = np.flatnonzero(again)
    seen: dict[tuple, int] = {}  # equal hashes are confirmed on the words themselves
    for i in starts.tolist():
        key = tuple(words[i : i + k])
        seen[key] = seen.get(key, 0) + 1
    if min(seen.values()) < 2:  # a window that stands once shares its hash with another
        starts = np.array([i for i in starts.tolist() if seen[tuple(words[i : i + k])] > 1], np.int64)
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def report(text: str, rules: Rules, hashes: StableHashes) -> tuple:
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the ASCII white space
    n = len(words)
    lines = text.split("\n")
    with_words = [(line, parts) for line in lines if (parts := [w for w in re.split("[ \t\x0b\x0c\r]+", line) if w])]
    lost = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    lost_words, kept_lines = 0, []
    for line, parts in with_words:
        rule = failed_rule(line, parts, rules)
        if rule is None:
            kept_lines.append(line)
        else:
            lost[rule] += 1
            lost_words += len(parts)
    repeats = repeated_words(words, hashes.of(words), rules.repeat_window)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    return (
        n,
        len(text) - sum(map(text.count, WORD_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(with_words) - len({line for line, _ in with_words}),
        repeats,
        len(with_words),
        lost["punctuation"],
        lost["navigation"],
        lost["boilerplate"],
        lost_words,
        base_failed,
        not base_failed and lost_words <= rules.max_lost_share * n,
        "\n".join(kept_lines),
    )


def quality_report(text: Column, rules: Rules = Rules()) -> Column:  # noqa: B008
    """Struct column REPORT for each text; clean_text is what the line rules leave.

    The texts are judged once, however many fields are used: the column counts as nondeterministic, so that a filter on one field isn't given a judge
    of its own. Null and empty texts have no words, fail the base rules, and are rejected with an empty clean_text. Texts are judged
    whole at any length. Equal rows get equal reports; other columns are not looked at.
    """

    @F.arrow_udf(REPORT)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = StableHashes()
        kind = pa.struct([(f.name, _ARROW[type(f.dataType)]) for f in REPORT.fields])
        for batch in batches:
            rows = [report(t or "", rules, hashes) for t in batch.to_pylist()]
            yield pa.array([dict(zip(REPORT.names, r, strict=True)) for r in rows], kind)

    return judge.asNondeterministic()(text)


_ARROW = {T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.StringType: pa.string()}
