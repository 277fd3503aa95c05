"""Registered queries over the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of (spark, sf_dir), with its SQL where SQL can express it."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_sql(text: str) -> str:
    """DuckDB: a number in [0, 1) from the md5 of a text expression."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_decisions"](spark, sf_dir)


for _name in ("text", "filters", "joins", "metrics", "ranking", "augment", "algebra", "policy", "sets", "profiles", "sources"):
    try:
        importlib.import_module(f"tallyspark.plans.{_name}_queries")
    except ModuleNotFoundError as _error:
        if _error.name != f"tallyspark.plans.{_name}_queries":
            raise


#: Array columns of registered queries, by kind of their elements. They leave as text, which every client compares alike.
ARRAYS = {
    "o008_vote_shares": {"dist": "number"},
    "o012_logit_dump": {"logits": "number"},
    "o041_id_tokens": {"tokens": "text"},
    "o042_stems": {"stems": "text"},
    "o043_ordinal_scales": {"scale": "text"},
    "o046_option_lists": {"spans": "whole"},
    "o051_hard_targets": {"target": "number"},
    "o070_alignment": {"vals": "number"},
    "o081_lineage": {"items": "whole"},
    "o116_top_values": {"raws": "text"},
    "o143_tournament": {"logp": "number"},
    "o165_message_dedup": {"folders": "text"},
    "o166_option_shuffle": {"candidates": "text"},
    "o168_null_synth": {"target": "number"},
    "o170_near_miss": {"candidates": "text"},
    "o172_choice_set_variants": {"candidates": "text"},
    "o173_k_sweep": {"candidates": "text"},
    "o174_counterfactual_sets": {"removed": "text", "added": "text", "near": "text"},
    "o177_null_copies": {"candidates": "text"},
    "o178_ordinal_smoothing": {"target": "number"},
    "o179_listwise": {"candidates": "text"},
    "o182_soft_merge": {"target": "number"},
    "o184_rubric_groups": {"candidates": "text"},
    "o188_mcq_nulls": {"candidates": "text"},
    "o191_narrowed": {"candidates": "text"},
    "o192_teacher_merge": {"smooth": "number", "mean": "number"},
    "o193_permutation_average": {"mean": "number"},
    "o199_softmax": {"warm": "number", "shifted": "number"},
    "o200_factored_null": {"p": "number"},
    "o201_over_labels": {"p": "number"},
    "o204_cumulative_link": {"p": "number"},
    "o208_support_gate": {"p": "number"},
    "o213_tempered": {"p": "number"},
    "o218_truth_table": {"assignment": "whole"},
    "o219_collect_policy": {"actions": "text"},
}


def _as_text(name: str, kinds: dict[str, str]) -> None:
    """Numbers with six decimals, all joined by commas."""
    from pyspark.sql import functions as F

    query_, sql = QUERIES[name], ORACLES[name]

    def run(spark, sf_dir):
        df = query_(spark, sf_dir)
        to = lambda c, k: F.array_join(F.transform(c, lambda x: F.format_string("%.6f", x.cast("double")) if k == "number" else x.cast("string")), ",")
        return df.withColumns({c: to(c, k) for c, k in kinds.items()})

    to = {"number": "list_transform({0}, lambda x: printf('%.6f', x::DOUBLE))", "text": "{0}", "whole": "list_transform({0}, lambda x: x::VARCHAR)"}
    QUERIES[name] = run
    ORACLES[name] = "SELECT * REPLACE (" + ", ".join(f"array_to_string({to[k].format(c)}, ',') AS {c}" for c, k in kinds.items()) + f") FROM ({sql})"


for _query, _kinds in ARRAYS.items():
    _as_text(_query, _kinds)
