"""Queries opN_<name>: each operator over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from recallgrid.llm._arrow import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op5_suffix_repeats(spark, sf_dir):
    from recallgrid.llm.suffix import suffix_repeats

    return suffix_repeats(table(spark, sf_dir, "documents"))


@query
def op9_superkmer_repeats(spark, sf_dir):
    from recallgrid.llm.superkmer import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


@query
def op10_simhash_groups(spark, sf_dir):
    from recallgrid.llm.simhash import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents"))


@query
def op1_best_fit_packing(spark, sf_dir):
    from recallgrid.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op2_quality_scores(spark, sf_dir):
    from recallgrid.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_temperature_mix(spark, sf_dir):
    from recallgrid.llm.mixing import mix_schedule

    return mix_schedule(table(spark, sf_dir, "documents"))


def _mixing_sql() -> str:
    from recallgrid.llm.mixing import ORACLE

    return ORACLE


SQL["op8_temperature_mix"] = _mixing_sql()


@query
def op3_secret_findings(spark, sf_dir):
    from recallgrid.llm.secrets import findings

    return findings(table(spark, sf_dir, "documents"))


@query
def op7_toxic_severity(spark, sf_dir):
    from recallgrid.llm.toxicity import severity

    return severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_media_columns(spark, sf_dir):
    from recallgrid.llm.jpeg import media_columns, with_picture

    return media_columns(with_picture(table(spark, sf_dir, "pages").select("page_id", "html")), "media", "page_id")


@query
def op4_mtree_neighbors(spark, sf_dir):
    from recallgrid.llm.mtree import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def _nearest_sql() -> str:
    from recallgrid.llm.mtree import ORACLE

    return ORACLE


SQL["op4_mtree_neighbors"] = _nearest_sql()
