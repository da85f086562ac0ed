"""JSON documents: canonical lines with digests as a sink, and recognition evidence read strictly from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.once import once


def of_text(text: Column) -> Column:
    """JSON with the keys of all objects sorted at every depth, without spaces: variants keep their keys in order.

    Decimals have no trailing zeros; a repeated key is an error.
    """
    return F.to_json(F.parse_json(text))


def of_columns(*columns: str | Column) -> Column:
    """Columns of any type as one such object."""
    return F.to_json(F.call_function("to_variant_object", F.struct(*columns)))


def write_lines(df: DataFrame, path: str, json: Column, *keys: str) -> DataFrame:
    """Write one canonical line a row under ``path`` and return the manifest (keys, sha256, bytes) that is written beside it."""
    rows = df.select(*keys, json.alias("_json"))
    rows.select("_json").write.text(f"{path}/lines")
    rows.select(*keys, F.sha2("_json", 256).alias("sha256"), F.octet_length("_json").cast("long").alias("bytes")).write.parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(f"{path}/lines").withColumnRenamed("value", "json")


#: What a document of recognition evidence must name, and what its request must.
KEYS = ["chunks", "created_at", "engines", "language", "master_text", "media", "request", "schema_version", "source_schema_version", "units"]
REQUEST = ["hotword_count", "hotwords_sha256", "input_fingerprint", "profile_id", "prompt_sha256", "provider_response", "provider_submission", "requested_language"]
VERSIONS = ("recognition-evidence.v1", "recognition-source.v1")
_DIGEST = "^[0-9a-f]{64}$"


def _kind(path: str) -> str:
    return f"schema_of_variant(variant_get(v, '{path}'))"


def _text_ok(path: str, most: int, empty: bool = False) -> str:
    got = f"try_variant_get(v, '{path}', 'string')"
    return f"coalesce({_kind(path)} = 'STRING' AND length(trim({got})) <= {most}" + ("" if empty else f" AND trim({got}) <> ''") + ", false)"


def _number(path: str, of: str = "v") -> str:
    """The number at a path; null for text, truth values and what is absent."""
    return f"if(schema_of_variant(variant_get({of}, '{path}')) RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)', try_variant_get({of}, '{path}', 'double'), NULL)"


def _keys(path: str) -> str:
    return f"array_sort(json_object_keys(to_json(variant_get(v, '{path}'))))"


def _listed(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in values) + ")"


def _artifact(path: str) -> str:
    name, digest = f"try_variant_get(v, '{path}.relative_path', 'string')", f"try_variant_get(v, '{path}.sha256', 'string')"
    return f"coalesce({_keys(path)} = array('relative_path', 'sha256') AND length(trim({name})) BETWEEN 1 AND 500 AND trim({name}) NOT RLIKE '[/\\\\\\\\]|^[.][.]?$' AND {digest} RLIKE '{_DIGEST}', false)"


def _rules(versions: tuple[str, str]) -> list[tuple[str, str]]:
    """(code, what must hold), in the order in which they are told."""
    listed = lambda path: f"coalesce({_kind(path)} LIKE 'ARRAY%', false)"
    timed = lambda x: f"coalesce({_number('$.start', x)} >= 0 AND {_number('$.end', x)} >= {_number('$.start', x)}, false)"
    said = lambda x, most: f"coalesce(schema_of_variant(variant_get({x}, '$.text')) = 'STRING' AND length(trim(try_variant_get({x}, '$.text', 'string'))) BETWEEN 1 AND {most}, false)"
    placed = lambda x: f"coalesce(try_variant_get({x}, '$.index', 'long') = i AND schema_of_variant(variant_get({x}, '$.index')) = 'BIGINT', false)"
    each = lambda name, holds: f"NOT exists(transform({name}, (x, i) -> {holds}), ok -> NOT ok)"
    engines = "map_entries(coalesce(try_variant_get(v, '$.engines', 'map<string,variant>'), map()))"
    scalar = "(e.value IS NULL OR schema_of_variant(e.value) RLIKE '^(STRING|BIGINT|DECIMAL|DOUBLE|BOOLEAN|VOID)') AND (schema_of_variant(e.value) <> 'STRING' OR length(variant_get(e.value, '$', 'string')) <= 500)"
    digest = lambda path: f"coalesce({_kind(path)} = 'STRING' AND try_variant_get(v, '{path}', 'string') RLIKE '{_DIGEST}', false)"
    rising = f"NOT exists(transform(units, (x, i) -> i > 0 AND {_number('$.start', 'x')} + 0.001D < {_number('$.start', 'units[i - 1]')}), late -> coalesce(late, false))"
    return [
        ("keys", f"coalesce({_keys('$')} = {_listed(KEYS)}, false)"),
        ("schema_version", f"coalesce(try_variant_get(v, '$.schema_version', 'string') = '{versions[0]}' AND try_variant_get(v, '$.source_schema_version', 'string') = '{versions[1]}', false)"),
        ("created_at", _text_ok("$.created_at", 100)),
        ("media", f"coalesce(lower(try_variant_get(v, '$.media.sha256', 'string')) RLIKE '{_DIGEST}', false) AND ({_kind('$.media.duration_seconds')} IS NULL OR coalesce({_number('$.media.duration_seconds')} >= 0, false))"),
        ("engines", f"size({engines}) > 0 AND NOT exists({engines}, e -> NOT (e.key RLIKE '^[A-Za-z0-9][A-Za-z0-9_.:-]{{0,127}}$' AND coalesce({scalar}, true)))"),
        ("language", _text_ok("$.language", 200, True)),
        ("master_text", _text_ok("$.master_text", 50_000_000)),
        ("chunks", listed("$.chunks")),
        ("chunk_index", each("chunks", placed("x"))),
        ("chunk_timing", each("chunks", timed("x"))),
        ("chunk_text", each("chunks", said("x", 1_000_000))),
        ("units", f"{listed('$.units')} AND size(units) > 0"),
        ("unit_index", each("units", placed("x"))),
        ("unit_timing", f"{each('units', timed('x'))} AND {rising}"),
        ("unit_text", each("units", said("x", 10_000))),
        ("request", f"coalesce({_keys('$.request')} = {_listed(REQUEST)}, false)"),
        ("request_digest", " AND ".join(digest(f"$.request.{k}") for k in ("input_fingerprint", "prompt_sha256", "hotwords_sha256"))),
        ("hotword_count", f"coalesce({_kind('$.request.hotword_count')} = 'BIGINT' AND try_variant_get(v, '$.request.hotword_count', 'long') >= 0, false)"),
        ("profile_id", _text_ok("$.request.profile_id", 100)),
        ("requested_language", _text_ok("$.request.requested_language", 40)),
        ("provider_submission", _artifact("$.request.provider_submission")),
        ("provider_response", f"coalesce({_kind('$.request.provider_response')}, 'VOID') = 'VOID' OR {_artifact('$.request.provider_response')}"),
        ("engine_profile", "coalesce(try_variant_get(v, '$.engines.profile_id', 'string') = try_variant_get(v, '$.request.profile_id', 'string'), false)"),
    ]


def evidence(files: DataFrame, versions: tuple[str, str] = VERSIONS) -> DataFrame:
    """Documents (path, json) with what is wrong with each: an array of codes, empty for a sound one; ``not_json`` stands alone."""
    got = once(files.select("path", "json"), v=F.try_parse_json("json"))
    got = once(got, **{name: F.expr(f"coalesce(try_variant_get(v, '$.{name}', 'array<variant>'), array())") for name in ("chunks", "units")})
    rules = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(holds), F.lit(False)), F.lit(code)) for code, holds in _rules(versions)]))
    return once(got, errors=F.when(F.col("v").isNull(), F.array(F.lit("not_json"))).otherwise(rules))


def read_evidence(spark: SparkSession, path: str, versions: tuple[str, str] = VERSIONS) -> tuple[DataFrame, DataFrame]:
    """Units (path, idx, start_s, end_s, text) of the sound documents under a path, one JSON object a file, and the bad ones (path, errors).

    A document is judged whole: a single wrong unit keeps all its units out.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("path"), F.col("value").alias("json"))
    judged = evidence(files, versions)
    unit = F.posexplode("units").alias("idx", "u")
    sound = judged.where(F.size("errors") == 0).select("path", unit)
    units = sound.select("path", F.col("idx").cast("long").alias("idx"), F.expr("variant_get(u, '$.start', 'double')").alias("start_s"), F.expr("variant_get(u, '$.end', 'double')").alias("end_s"), F.expr("trim(variant_get(u, '$.text', 'string'))").alias("text"))
    return units, judged.where(F.size("errors") > 0).select("path", "errors")
