"""Config-driven projection and validation of profiles.

A config is a dict: ``fields`` (each with ``path``, and optionally ``from``,
``type``, ``required``, ``normalize``), ``on_missing`` (``null``, ``omit`` or
``error``), ``include_confidence`` and ``include_provenance``.  It is compiled to
columns when the query is planned; rows are never looked at by Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.contacts import normalize_phone
from kinweave.functions.skills import canonical_skill

NAMES = {T.StringType: "str", T.LongType: "int", T.IntegerType: "int", T.DoubleType: "float", T.FloatType: "float", T.BooleanType: "bool", T.ArrayType: "list", T.StructType: "dict", T.MapType: "dict"}


class ProjectionError(ValueError):
    """A required field is missing under ``on_missing: error``."""


@dataclass
class Resolved:
    """A path as a column; ``missing`` says per row, or for all rows, whether a step can't be taken."""

    value: Column | None
    type: T.DataType | None
    missing: Column | bool


def tokens(path: str) -> list[str]:
    """``skills[].name`` as skills, [], name; ``emails[0]`` as emails, [0]."""
    out: list[str] = []
    for part in path.split("."):
        found = re.fullmatch(r"([^\[]+)((?:\[[^\]]*\])*)", part)
        out += [found[1], *re.findall(r"\[[^\]]*\]", found[2])] if found else [part]
    return out


def _each(items: Column, field: str) -> Column:
    return F.transform(items, lambda x: x[field])


def resolve_path(schema: T.StructType, path: str) -> Resolved:
    """The column for a path such as ``emails[0]``, ``location.country`` or ``skills[].name``."""
    never = Resolved(None, None, True)
    value: Column | None = None
    kind: T.DataType = schema
    missing: Column | bool = False
    listing = False
    for token in tokens(path):
        index = re.fullmatch(r"\[(.*)\]", token)
        if listing:  # a field of each element; elements without it are left out
            element = kind.elementType
            listing = False
            if index or not isinstance(element, T.StructType) or token not in element.names:
                value, kind = F.array().cast("array<string>"), T.ArrayType(T.StringType())
            else:
                value, kind = F.filter(_each(value, token), lambda x: x.isNotNull()), T.ArrayType(element[token].dataType)
        elif index:
            if not isinstance(kind, T.ArrayType):
                return never
            if index[1] == "":
                listing = True
                continue
            if not re.fullmatch(r"\s*[+-]?\d+\s*", index[1]):
                return never
            i = int(index[1])
            out = (F.size(value) <= i) if i >= 0 else (F.size(value) < -i)
            missing = out if missing is False else (missing | out)
            value, kind = F.try_element_at(value, F.lit(i + 1 if i >= 0 else i)), kind.elementType
        elif isinstance(kind, T.StructType) and token in kind.names:
            value, kind = (F.col(f"`{token}`") if value is None else value[token]), kind[token].dataType
        else:
            return never
    return Resolved(value, kind, missing)


def normalized(value: Column, kind: T.DataType, how: str) -> Column:
    """``E164`` and ``canonical`` on texts and lists of them, ``lower`` and ``upper`` on texts; anything else as it is."""
    one = {"E164": normalize_phone, "canonical": canonical_skill, "lower": F.lower, "upper": F.upper}.get(how)
    if one and isinstance(kind, T.StringType):
        return one(value)
    if one and how in ("E164", "canonical") and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(value, lambda x: one(x))
    return value


def _columns(profiles: DataFrame, config: dict) -> dict[str, tuple[Column, Column | bool]]:
    """For each output field its column, and whether a row misses it."""
    if not config.get("fields"):
        drop = {"cluster_id", *(c for c, key in (("provenance", "include_provenance"), ("overall_confidence", "include_confidence")) if not config.get(key, True))}
        return {c: (F.col(c), False) for c in profiles.columns if c not in drop}
    policy = config.get("on_missing", "null")
    out: dict[str, tuple[Column, Column | bool]] = {}
    for spec in config["fields"]:
        path, start = spec["path"], spec.get("from", spec["path"])
        found = resolve_path(profiles.schema, start)
        strict = bool(spec.get("required")) and policy == "error"
        message = f"required field missing: {path} (from {start})"
        if found.missing is True:
            if strict:
                raise ProjectionError(message)
            if policy != "omit":
                out[path] = (F.lit(None).cast("string"), False)
            continue
        value = normalized(found.value, found.type, spec["normalize"]) if "normalize" in spec else found.value
        if found.missing is not False and strict:
            value = F.when(found.missing, F.raise_error(F.lit(message))).otherwise(value)
        out[path] = (value, found.missing)
    for c, key in (("overall_confidence", "include_confidence"), ("provenance", "include_provenance")):
        if config.get(key):
            out[c] = (F.col(c), False)
    return out


def project(profiles: DataFrame, config: dict) -> DataFrame:
    """The columns that a config asks for.

    Without ``fields``, all columns but the internal cluster_id, meta columns
    unless switched off.  Under ``omit`` a field that no row can have is left
    out; one that only some rows miss is null here, and left out by
    ``as_json``.  Under ``error`` a required field that is missing fails: when
    the query is planned if no row has it, else in the row.
    """
    return profiles.select(*(value.alias(path) for path, (value, _) in _columns(profiles, config).items()))


def as_json(profiles: DataFrame, config: dict) -> DataFrame:
    """(json): each projected row as an object that keeps nulls, and under ``omit`` leaves out what is missing."""
    omit = config.get("on_missing") == "omit"
    pieces = []
    for path, (value, missing) in _columns(profiles, config).items():
        alone = F.to_json(F.struct(value.alias(path)), {"ignoreNullFields": "false"})
        inner = F.substring(alone, F.lit(2), F.length(alone) - 2)
        pieces.append(F.when(~missing, inner) if omit and missing is not False else inner)
    return profiles.select(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pieces)), ","), F.lit("}")).alias("json"))


def as_variant(profiles: DataFrame, config: dict) -> DataFrame:
    """(profile): each projected row as a typed object, in which under ``omit`` a key that is missing is absent, and one that is null is null."""
    return as_json(profiles, config).select(F.parse_json("json").alias("profile"))


def missing_required(profiles: DataFrame, config: dict) -> DataFrame:
    """(candidate_id, cluster_id, n, error): the required fields that rows miss under ``on_missing: error``, as rows where ``project`` fails."""
    said = []
    for spec in config.get("fields") or [] if config.get("on_missing") == "error" else []:
        path, start = spec["path"], spec.get("from", spec["path"])
        missing = resolve_path(profiles.schema, start).missing
        if spec.get("required") and missing is not False:
            said.append(F.when(F.lit(True) if missing is True else missing, F.lit(f"required field missing: {path} (from {start})")))
    every = F.array_compact(F.array(*said)) if said else F.array().cast("array<string>")
    return profiles.select("candidate_id", "cluster_id", F.posexplode(every).alias("n", "error")).withColumn("n", F.col("n").cast("long"))


def _fits(kind: T.DataType, declared: str) -> bool | None:
    """Whether a column type is a declared type; None for an unknown declaration."""
    text, number, flag, thing = isinstance(kind, T.StringType), isinstance(kind, T.NumericType), isinstance(kind, T.BooleanType), isinstance(kind, (T.StructType, T.MapType))
    single = {"string": text, "number": number, "boolean": flag, "object": thing}
    if declared in single:
        return single[declared]
    if declared in ("string[]", "number[]", "object[]"):
        return isinstance(kind, T.ArrayType) and bool(_fits(kind.elementType, declared[:-2]))
    return None


def errors(shown: DataFrame, config: dict) -> Column:
    """The messages of what a projected row violates."""
    said = []
    for spec in config.get("fields") or []:
        path, declared = spec["path"], spec.get("type")
        there = path in shown.columns
        value = F.col(f"`{path}`") if there else F.lit(None)
        if spec.get("required"):
            said.append(F.when(value.isNull(), F.lit(f"required field '{path}' is missing or null")))
        if not declared or not there:
            continue
        kind = shown.schema[path].dataType
        fits = _fits(kind, declared)
        wrong = F.lit(f"field '{path}': unknown type '{declared}'" if fits is None else f"field '{path}': expected {declared}, got {NAMES.get(type(kind), kind.simpleString())}")
        if not fits:
            said.append(F.when(value.isNotNull(), wrong))
        elif declared.endswith("[]"):
            said.append(F.when(value.isNotNull() & F.exists(value, lambda x: x.isNull()), wrong))
    return F.array_compact(F.array(*said)) if said else F.array().cast("array<string>")


def violations(profiles: DataFrame, config: dict) -> DataFrame:
    """(candidate_id, cluster_id, n, error): every violation of the projected profiles; n counts within a profile."""
    columns = {path: value for path, (value, _) in _columns(profiles, config).items()}
    ids = [F.col("candidate_id").alias("_id"), F.col("cluster_id").alias("_cluster")]
    shown = profiles.select(*ids, *(value.alias(path) for path, value in columns.items()))
    found = shown.select("_id", "_cluster", F.posexplode(errors(shown, config)).alias("n", "error"))
    return found.select(F.col("_id").alias("candidate_id"), F.col("_cluster").alias("cluster_id"), F.col("n").cast("long").alias("n"), "error")


def strict(found: DataFrame) -> None:
    """Raises if there is any violation."""
    if not found.isEmpty():
        raise ValueError("profiles violate the output config")
