"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscale.llm import conversations, leaks, lookalikes, markup, mixing, names, repetition, scans, splitting


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": conversations.p1_found,
        "p1_turns": conversations.p1_turns,
        "p2_found": markup.p2_found,
        "p2_texts": markup.p2_texts,
        "p3_found": lookalikes.p3_found,
        "p4_found": names.p4_found,
        "p4_members": names.p4_members,
        "p5_found": splitting.p5_found,
        "p5_pieces": splitting.p5_pieces,
        "p6_found": scans.p6_found,
        "p6_texts": scans.p6_texts,
        "p7_found": leaks.p7_found,
        "p7_leaks": leaks.p7_leaks,
        "p8_mix": mixing.p8_mix,
        "p8_shares": mixing.p8_shares,
        "p8_epoch": mixing.p8_epoch,
        "p8_epoch_shares": mixing.p8_epoch_shares,
        "p9_found": repetition.p9_found,
        "p9_shares": repetition.p9_shares,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": conversations.P1_SQL, "p2_found": markup.p2_sql(), "p3_found": lookalikes.p3_sql(), "p5_found": splitting.P5_SQL, "p9_found": repetition.P9_SQL}
