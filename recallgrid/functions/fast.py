"""text.tokens and text.cues as Arrow functions, for whole tables of texts: the same lists, with what a word becomes
looked up instead of worked out again by interpreted expressions at each place."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.functions import text as T

_URL = re.compile(T.URL, re.A)
_TOKEN = re.compile(T.TOKEN)
_DELIMITER = re.compile(T.DELIMITERS)
_NOT_SOLID = re.compile("[^\\w|\t\n\x0b\f\r ]|_")  # white space is that of ASCII, as Java has it
_RULES = [(re.compile(p), p, cut, add) for p, cut, add in T.LEMMA_RULES]
_MOST = 1 << 18  # words kept


def lemma(word: str) -> str:
    if len(word.encode()) <= 3:
        return word
    if word in T.EXCEPTIONS:
        return T.EXCEPTIONS[word]
    ending = next((e for e in ("s", "ing", "ed") if word.endswith(e)), None)
    for rule, p, cut, add in _RULES if ending else ():
        if (p.endswith(f"{ending}$") or (ending == "s" and p.endswith("s)$"))) and rule.search(word):
            return word[: len(word) - cut] + add
    return word


class Lists:
    def __init__(self, lang: str = "default"):
        self.stop, self.token, self.part = frozenset(T.stop_list(lang)), {}, {}

    def _token(self, w: str) -> str | None:
        hashed = len(w) > 6 and re.search("[0-9]", w) and re.search("[a-z]", w)
        got = None if w in self.stop or len(w) <= 1 or hashed else lemma(w)
        if len(self.token) < _MOST:
            self.token[w] = got
        return got

    def _part(self, w: str) -> str | None:
        got = None if w == "|" or w in self.stop or len(w.encode()) <= 1 else lemma(w)
        if len(self.part) < _MOST:
            self.part[w] = got
        return got

    def tokens(self, text: str) -> list[str]:
        """Of a text without URLs, in lower case."""
        have = self.token
        found = dict.fromkeys(_TOKEN.findall(text))
        return [w for w in dict.fromkeys(have[w] if w in have else self._token(w) for w in found) if w is not None]

    def phrases(self, text: str, limit: int = 15) -> list[str]:
        have, out, run = self.part, {}, []
        for w in [*_NOT_SOLID.sub("", _DELIMITER.sub(" | ", text)).split(), "|"]:
            got = have[w] if w in have else self._part(w)
            if got is not None:
                run.append(got)
                continue
            if 2 <= len(run) <= 4 and len((p := "_".join(run)).encode()) >= 5:
                out[p] = None
                if len(out) == limit:
                    break
            run = []
        return list(out)

    def cues(self, text: str) -> list[str]:
        return list(dict.fromkeys([*self.tokens(text), *self.phrases(text)]))


def _lists(text: Column, kind: str, lang: str) -> Column:
    kept = []

    @F.arrow_udf("array<string>")
    def run(a: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Lists(lang))
        of, parts = getattr(kept[0], kind), []
        for i in range(0, len(a), 256):
            texts = a.slice(i, 256).cast(pa.binary()).to_pylist()
            parts.append(pa.array([None if t is None else of(_URL.sub(r"\1", t.decode("utf-8", "replace")).lower()) for t in texts], pa.list_(pa.string())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return run(text)


def tokens(text: Column, lang: str = "default") -> Column:
    return _lists(text, "tokens", lang)


def cues(text: Column, lang: str = "default") -> Column:
    return _lists(F.coalesce(text, F.lit("")), "cues", lang)
