"""Queries stated once in the SQL that Spark and DuckDB share; Spark reads the entities as DataFrames, DuckDB as common table expressions."""

from __future__ import annotations

import re

from . import bindings
from .registry import query
from .words import WORDS, words

#: Entities with their DataFrame and their SQL; any other name in braces is a table of the driver.
_ENTITIES = {"units": (bindings.units, bindings.UNITS), "cues": (bindings.cues, bindings.CUES), "words": (words, WORDS), "tasks": (bindings.tasks, bindings.TASKS)}
#: What the two engines write differently: whole-number division, digests, ordered concatenation and rows of a series.
_SPARK = [(r"~/", "div"), (r"SHA\(", "sha2_256("), (r"JOINED\((.+?) SEP (.+?) BY (.+?)\)\)", r"listagg(\1, \2) WITHIN GROUP (ORDER BY \3))"), (r"JOINED\((.+?) SEP (.+?) BY (.+?)\)", r"listagg(\1, \2) WITHIN GROUP (ORDER BY \3)"), (r"SERIES\((.+?) TO (.+?)\)", r"explode(sequence(\1, \2))")]
_DUCK = [(r"~/", "//"), (r"SHA\(", "sha256("), (r"JOINED\((.+?) SEP (.+?) BY (.+?)\)\)", r"string_agg(\1, \2 ORDER BY \3))"), (r"JOINED\((.+?) SEP (.+?) BY (.+?)\)", r"string_agg(\1, \2 ORDER BY \3)"), (r"SERIES\((.+?) TO (.+?)\)", r"unnest(generate_series(\1, \2))")]


def _said(sql: str, rules: list[tuple[str, str]]) -> str:
    for pattern, said in rules:
        sql = re.sub(pattern, said, sql, flags=re.S)
    return sql


def stated(name: str, sql: str, faster: str | None = None) -> None:
    """Register a query; ``{cues}`` and the like name what it reads. ``faster`` says the same to Spark where the plain statement is quadratic."""
    used = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    spark_sql = re.sub(r"sha2_256\(([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*)\)", r"sha2(\1, 256)", _said(faster or sql, _SPARK))

    def run(spark, sf_dir):
        own = {n: _ENTITIES[n][0](spark, sf_dir) if n in _ENTITIES else bindings.table(spark, sf_dir, n) for n in used}
        return spark.sql(spark_sql, **own)

    # words are made of cues, whose expression theirs begins with
    needed = [_ENTITIES[n][1] for n in used if n in _ENTITIES and not (n == "cues" and "words" in used)]
    duck = re.sub(r"\{(\w+)\}", r"\1", _said(sql, _DUCK))
    if needed:
        duck = f"WITH {', '.join(needed)}, " + duck.lstrip()[5:] if duck.lstrip().startswith("WITH ") else f"WITH {', '.join(needed)} {duck}"
    query(duck, name)(run)
