"""Cue functions: normalisation with a trace, taxonomy, index keys, lexical gates and parsing of proposed cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.config import Normalization, Taxonomy

UNTRAINABLE = r"^(path|id|memory_id|file|alias_id|source):"
NO_EXPANSION = ("id", "path", "source", "file", "type", "status", "reason")


def index_form(cue: Column) -> Column:
    return F.trim(F.lower(cue))


def normalize_cue(raw: Column, config: Normalization = Normalization()) -> tuple[Column, Column]:
    """(normalised cue, names of the rules that changed it), rules in order."""
    c = F.trim(raw) if config.trim else raw
    c = F.lower(c) if config.lowercase else c
    trace = []
    for rule in config.rules:
        after = F.regexp_replace(c, rule.pattern, rule.replacement)
        trace.append(F.when(after != c, F.lit(rule.name)))
        c = after
    return c, F.array_compact(F.array(*trace)) if trace else F.array().cast("array<string>")


def trainable(cue: Column) -> Column:
    return ~F.lower(cue).rlike(UNTRAINABLE)


def index_keys(cue: Column) -> Column:
    """The cue and, if there is one, the text after its first colon."""
    c = index_form(cue)
    value = F.trim(F.substring(c, F.instr(c, ":") + 1, F.length(c)))
    return F.when((F.instr(c, ":") > 0) & (value != ""), F.array_distinct(F.array(c, value))).otherwise(F.array(c))


def cue_key(cue: Column) -> Column:
    return F.when(F.instr(cue, ":") > 0, F.substring_index(cue, ":", 1))


def cue_value(cue: Column) -> Column:
    return F.when(F.instr(cue, ":") > 0, F.substring(cue, F.instr(cue, ":") + 1, F.length(cue)))


def taxonomy_code(cue: Column, taxonomy: Taxonomy) -> Column:
    """bad_format, unknown_key or unknown_value; null where the cue is accepted."""
    k, v = cue_key(cue), cue_value(cue)
    code = F.when(F.instr(cue, ":") == 0, F.lit(None).cast("string")).when((k == "") | (v == ""), F.lit("bad_format"))
    if taxonomy.keys is not None:
        code = code.when(~k.isin(*taxonomy.keys), F.lit("unknown_key"))
    for name in sorted({*taxonomy.values, *taxonomy.prefixes}):
        ok = F.lit(False)
        if name in taxonomy.values:
            ok = ok | v.isin(*taxonomy.values[name])
        for p in taxonomy.prefixes.get(name, ()):
            ok = ok | v.startswith(p)
        code = code.when((k == name) & ~ok, F.lit("unknown_value"))
    return code


def cue_tokens(cue: Column) -> Column:
    return F.filter(F.split(F.lower(cue), "[:_-]"), lambda t: F.octet_length(t) >= 3)


def lexical_gate(a: Column, b: Column) -> Column:
    """One contains the other, or they share a token."""
    return F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(cue_tokens(a), cue_tokens(b))


def canonical_format(cue: Column) -> Column:
    return cue.rlike("(?s)^[^:]+:.+")


def canonical_of(a: Column, b: Column) -> Column:
    """A key:value cue before a plain one, else the lesser."""
    return F.when(canonical_format(a) & ~canonical_format(b), a).when(canonical_format(b) & ~canonical_format(a), b).otherwise(F.least(a, b))


def proposed_cues(response: Column) -> Column:
    """Cues in an answer: a JSON array (of strings or {key, value}), an object with ``cues``, the same inside a fence,
    or any quoted key:value."""
    inner = F.trim(F.coalesce(F.nullif(F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), response))
    listed = F.coalesce(F.get_json_object(inner, "$.cues"), F.when(inner.startswith("["), inner))
    plain = F.from_json(listed, "array<string>")
    made = F.transform(plain, lambda s: F.when(F.get_json_object(s, "$.key").isNotNull(), F.concat_ws(":", F.get_json_object(s, "$.key"), F.get_json_object(s, "$.value"))).otherwise(s))
    made = F.filter(made, lambda s: s.isNotNull() & (s != ""))
    quoted = F.regexp_extract_all(response, F.lit(r"""["']([-_0-9a-z]+:[-_0-9a-z]+)["']"""), 1)
    return F.when(F.size(made) > 0, made).otherwise(quoted)
