"""Text to cues as Column expressions: no Python runs in the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://(?:www[.])?([-0-9A-Za-z]+)(?:[.][A-Za-z]+)+\S*"
TOKEN = "[a-z][0-9a-z]*"
DELIMITERS = r"""[\n\r~@#$%&*+=|\\/^`'"<>(){}\[\],.;:?!]"""

PLAIN_STOPWORDS = """themselves yourselves ourselves yourself because himself herself through between further should before itself myself
    during having theirs cannot could would while there where these those above being doing which until under other their
    https yours ought about below once same some here were more have each such with both will them whom from than been then
    when down into http over your does this hers ours that what most they only very had did and she the are off org him com
    own who too her for our has was his its but out you few how www why any be he me we if of am an in on do io so to up or
    as is us at it by my a i""".split()
CONTRACTIONS = {"n't": "are ca could did does do had has have is must sha should was were wo would", "'s": "he here how it let she that there what when where who why", "'d": "he i she they we you", "'ll": "he i she they we you", "'re": "they we you", "'ve": "i they we you", "'m": "i"}
STOPWORDS = (*PLAIN_STOPWORDS, *(stem + end for end, stems in CONTRACTIONS.items() for stem in stems.split()))

KEYWORDS = {
    "rust": "fn as pub mod use ref dyn mut type move self impl enum loop async crate match break union super trait await const static unsafe extern struct",
    "python": "def del try none true elif pass async yield raise false class await lambda global return except assert import finally nonlocal",
    "go": "map var func type case chan goto range break defer const switch return select struct import package default interface fallthrough",
    "javascript": "var new try void case true null enum async yield false catch break super class await const throw public static delete typeof switch return import export package private extends default continue function debugger protected interface instanceof implements",
    "php": "fn die use var xor try case eval echo exit list yield clone endif catch final class unset isset trait print const throw array empty public static switch global return include declare require private foreach extends default callable function abstract protected interface namespace implements",
    "java": "int new try void case byte true long null enum char false catch break final super class float short const throw public static double native switch return throws assert import package private boolean extends default finally volatile abstract protected interface transient instanceof implements synchronized",
}
ALIASES = {"lang:rs": "rust", "rs": "rust", "py": "python", "ts": "javascript", "typescript": "javascript", "js": "javascript", "golang": "go"}
EXCEPTIONS = {"adding": "add", "added": "add", "children": "child", "men": "man", "women": "woman", "went": "go", "ran": "run", "running": "run", "better": "good", "data": "data", "news": "news", "series": "series", "species": "species", "indices": "index", "matrices": "matrix", "queries": "query", "telling": "tell", "calling": "call", "called": "call"}


def language(name: str) -> str:
    """The stop-list of a language name, ``lang:`` prefix allowed; default where there is none."""
    n = name.lower().removeprefix("lang:")
    n = ALIASES.get(n, n)
    return n if n in KEYWORDS else "default"


def stop_list(lang: str = "default") -> tuple[str, ...]:
    return tuple(sorted({*STOPWORDS, *KEYWORDS.get(language(lang), "").split()}))


def normalize_text(text: Column) -> Column:
    """Lower case, letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " "), r"\s+", " "))


def sanitize_text(text: Column) -> Column:
    """URLs become the first label of their host."""
    return F.regexp_replace(text, URL, "$1")


def hash_like(token: Column) -> Column:
    return (F.length(token) > 6) & token.rlike("[0-9]") & token.rlike("[a-z]")


#: (pattern, characters to cut, what to append), tried in order; words of three bytes or fewer and EXCEPTIONS come first.
LEMMA_RULES = [
    (r"(ss|us|is|ous)$", 0, ""),
    (r"..ies$", 3, "y"),
    (r"(x|z|ch|sh|ss)es$", 2, ""),
    (r"..s$", 1, ""),
    (r"^.*[aeiouy].*(bb|dd|gg|mm|nn|pp|rr|tt)ing$", 4, ""),
    (r"^.*[aeiouy].*(at|bl|iz|iv|uc)ing$", 3, "e"),
    (r"^.+[aeiouy].*[a-z]ing$", 3, ""),
    (r"eed$", 0, ""),
    (r"^.*[aeiouy].*(bb|dd|gg|mm|nn|pp|rr|tt)ed$", 3, ""),
    (r"^.*[aeiouy].*(at|bl|iz|iv|uc)ed$", 1, ""),
    (r"^.+[aeiouy].*[a-z]ed$", 2, ""),
]


def lemma(word: Column, exceptions: dict[str, str] = EXCEPTIONS) -> Column:
    """Rule lemmatiser; the dictionary of exceptions can be replaced. A word meets only the rules of its own ending."""

    def by(ending: str) -> Column:
        expr = F.when(F.lit(False), word)
        for pattern, cut, add in LEMMA_RULES:
            if pattern.endswith(f"{ending}$") or (ending == "s" and pattern.endswith("s)$")):
                out = F.substring(word, F.lit(1), F.length(word) - cut) if cut else word
                expr = expr.when(word.rlike(pattern), F.concat(out, F.lit(add)) if add else out)
        return expr.otherwise(word)

    expr = F.when(F.octet_length(word) <= 3, word)
    if exceptions:
        table = F.create_map(*[F.lit(x) for pair in sorted(exceptions.items()) for x in pair])
        expr = expr.when(word.isin(*exceptions), F.element_at(table, word))
    for ending in ("s", "ing", "ed"):
        expr = expr.when(F.endswith(word, F.lit(ending)), by(ending))
    return expr.otherwise(word)


def phrases(text: Column, lang: str = "default", limit: int = 15) -> Column:
    """Runs of two to four content words between delimiters and stop-words, as lemmas joined by '_'."""
    solid = F.regexp_replace(F.regexp_replace(F.lower(text), DELIMITERS, " | "), r"[^\p{L}\p{N}|\s]", "")
    clean = F.filter(F.split(solid, r"\s+"), lambda w: w != "")
    marked = F.transform(clean, lambda w: F.when((w == "|") | w.isin(*stop_list(lang)) | (F.octet_length(w) <= 1), F.lit("|")).otherwise(lemma(w)))
    runs = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.trim(r))
    good = F.filter(runs, lambda r: r.rlike("^[^ ]+( [^ ]+){1,3}$") & (F.octet_length(r) >= 5))
    return F.slice(F.array_distinct(F.transform(good, lambda r: F.replace(r, F.lit(" "), F.lit("_")))), 1, limit)


def tokens(text: Column, lang: str = "default") -> Column:
    """Content tokens of a text as lemmas, in order, distinct."""
    found = F.array_distinct(F.regexp_extract_all(normalize_text(sanitize_text(text)), F.lit(TOKEN), 0))
    kept = F.filter(found, lambda t: ~t.isin(*stop_list(lang)) & (F.length(t) > 1) & ~hash_like(t))
    return F.array_distinct(F.transform(kept, lambda t: lemma(t)))


def cues(text: Column, lang: str = "default") -> Column:
    """Tokens, then phrases, distinct; empty for a null text."""
    t = F.coalesce(text, F.lit(""))
    return F.array_union(tokens(t, lang), phrases(sanitize_text(t), lang))


# ---- the same in DuckDB's dialect, for the oracles ----


def _sql_list(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def sql_normalize(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_sanitize(x: str) -> str:
    return rf"regexp_replace({x}, '{URL}', '\1', 'g')"


def sql_lemma(w: str, exceptions: dict[str, str] = EXCEPTIONS) -> str:
    out = f"CASE WHEN strlen({w}) <= 3 THEN {w} " + "".join(f"WHEN {w} = '{k}' THEN '{v}' " for k, v in sorted(exceptions.items()))
    for pattern, cut, add in LEMMA_RULES:
        body = f"substr({w}, 1, length({w}) - {cut})" if cut else w
        out += f"WHEN regexp_matches({w}, '{pattern}') THEN {body}" + (f" || '{add}' " if add else " ")
    return out + f"ELSE {w} END"


def sql_tokens(x: str, lang: str = "default") -> str:
    found = f"regexp_extract_all({sql_normalize(sql_sanitize(x))}, '{TOKEN}')"
    keep = f"t NOT IN ({_sql_list(stop_list(lang))}) AND length(t) > 1 AND NOT (length(t) > 6 AND regexp_matches(t, '[0-9]') AND regexp_matches(t, '[a-z]'))"
    return f"list_transform(list_filter({found}, lambda t: {keep}), lambda t: {sql_lemma('t')})"


def sql_phrases(x: str, lang: str = "default") -> str:
    delim = DELIMITERS.replace("'", "''")
    words = rf"regexp_split_to_array(regexp_replace(lower({sql_sanitize(x)}), '{delim}', ' | ', 'g'), '\s+')"
    clean = rf"list_filter(list_transform({words}, lambda w: CASE WHEN w = '|' THEN w ELSE regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g') END), lambda w: w <> '')"
    marked = f"list_transform({clean}, lambda w: CASE WHEN w = '|' OR w IN ({_sql_list(stop_list(lang))}) OR strlen(w) <= 1 THEN '|' ELSE {sql_lemma('w')} END)"
    runs = f"list_transform(string_split(array_to_string({marked}, ' '), '|'), lambda r: trim(r))"
    return f"list_transform(list_filter({runs}, lambda r: regexp_matches(r, '^[^ ]+( [^ ]+){{1,3}}$') AND strlen(r) >= 5), lambda r: replace(r, ' ', '_'))"
