"""Contracts of nested structs: declared once, compiled to one `violations` column of paths.

A model is a tuple of constraints on a struct's fields. `violations()` turns it, with the
schema of the data, into built-in expressions; `decode()` reads canonical JSON by the
same models, level by level, and says which fields are unknown or missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, NumericType, StringType, StructType

from .canonical import parse


@dataclass(frozen=True)
class Field:
    """A constraint on one field. kind: boolean, enum, number, integer, text, strings (unique,
    in order of lower case and then as they are), numbers, struct or structs; `rule` instead
    names a condition on the whole struct that must hold."""

    name: str
    kind: str
    low: float | None = None
    high: float | str | None = None
    values: tuple[str, ...] = ()
    model: tuple = ()
    optional: bool = False
    holds: Callable[[Column], Column] | None = None


def boolean(*names):
    return tuple(Field(n, "boolean") for n in names)


def enum(name, values):
    return (Field(name, "enum", values=tuple(values)),)


def number(name, low, high):
    return (Field(name, "number", low, high),)


def integer(name, low, high):
    """high: a number, or the name of the count given to violations()."""
    return (Field(name, "integer", low, high),)


def text(*names, optional=False):
    return tuple(Field(n, "text", optional=optional) for n in names)


def strings(*names):
    return tuple(Field(n, "strings") for n in names)


def numbers(name, low, high):
    return (Field(name, "numbers", low, high),)


def struct(name, model):
    return (Field(name, "struct", model=model),)


def structs(name, model):
    return (Field(name, "structs", model=model),)


def rule(name, holds):
    return (Field(name, "rule", holds=holds),)


KINDS = {"boolean": BooleanType, "enum": StringType, "text": StringType, "number": NumericType, "numbers": NumericType, "integer": IntegralType, "strings": StringType}


def _typed(kind: str, found: DataType) -> bool:
    if kind in ("strings", "numbers"):
        return isinstance(found, ArrayType) and isinstance(found.elementType, KINDS[kind])
    if kind in ("struct", "structs"):
        return isinstance(found, StructType) if kind == "struct" else isinstance(found, ArrayType) and isinstance(found.elementType, StructType)
    return isinstance(found, KINDS[kind])


def violations(model: tuple, value: Column, schema: StructType, path: str | Column = "", counts: dict[str, Column] | None = None) -> Column:
    """array<string>: the path of every field of a struct that breaks its constraint, in the
    order of the model. Nulls break it unless the field is optional; so do fields that the
    schema lacks or has of another type, and NaN and infinite numbers. A null struct breaks
    all constraints at once: its own path alone."""
    path = F.lit(path) if isinstance(path, str) else path
    counts = counts or {}
    known = {f.name: f.dataType for f in schema.fields}
    at = lambda name: F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit("." + name)))
    parts = []
    for f in model:
        if f.kind == "rule":
            parts.append(F.when(F.coalesce(f.holds(value), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(at(f.name))))
        elif f.name not in known or not _typed(f.kind, known[f.name]):
            parts.append(F.array(at(f.name)))
        elif f.kind == "struct":
            parts.append(violations(f.model, value[f.name], known[f.name], at(f.name), counts))
        elif f.kind == "structs":
            parts.append(_each(f, value[f.name], known[f.name].elementType, at(f.name), counts))
        else:
            parts.append(F.when(F.coalesce(_holds(f, value[f.name], counts), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(at(f.name))))
    return F.when(value.isNull(), F.array(path)).otherwise(F.concat(*parts))


def _each(f: Field, values: Column, inner: StructType, path: Column, counts: dict[str, Column]) -> Column:
    own = F.transform(values, lambda x, i: violations(f.model, x, inner, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), counts))
    return F.when(values.isNull(), F.array(path)).otherwise(F.flatten(own))


def _holds(f: Field, x: Column, counts: dict[str, Column]) -> Column:
    finite = lambda v: ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    if f.kind == "boolean":
        ok = x.isNotNull()
    elif f.kind == "enum":
        ok = x.isin(*f.values)
    elif f.kind == "number":
        ok = finite(x) & x.between(f.low, f.high)
    elif f.kind == "integer":
        ok = x.between(F.lit(f.low), counts[f.high] if isinstance(f.high, str) else F.lit(f.high))
    elif f.kind == "text":
        ok = F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""
    elif f.kind == "numbers":
        ok = F.forall(x, lambda v: F.coalesce(finite(v) & v.between(f.low, f.high), F.lit(False)))
    else:
        key = lambda v: F.struct(F.lower(v), v)
        whole = F.forall(x, lambda v: F.coalesce(F.btrim(v, F.lit(" \t\n\x0b\x0c\r")) != "", F.lit(False)))
        pairs = F.when(F.size(x) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(x) - 1))
        ok = whole & F.forall(pairs, lambda i: key(F.get(x, i - 1)) < key(F.get(x, i)))
    return x.isNull() | ok if f.optional else ok


#: Vocabularies of audio plans, versions and statuses.
INTENTS = ("establish", "support", "build", "tension", "release", "reflection", "transition", "climax", "resolution", "neutral")
TONES = ("neutral", "calm", "reflective", "mysterious", "tense", "somber", "hopeful", "dramatic", "uplifting", "triumphant")
STYLES = ("none", "documentary", "ambient", "cinematic", "minimal", "emotional_piano", "orchestral", "hybrid", "electronic", "historical", "nature", "suspense")
PLACES = ("none", "room_tone", "urban", "crowd", "nature", "forest", "ocean", "wind", "rain", "machinery", "transport", "battlefield", "archival_noise", "generic_environment")
CHANGES = ("none", "crossfade", "fade_in", "fade_out", "hard_cut", "silence", "ambient_bridge", "riser", "impact", "tonal_shift")
STATUSES = ("planned", "fallback")
SCHEMA_VERSION, PLANNER_VERSION = "1.0", "4.7.0"


def _off(kind: str):
    """What is switched off is none at 0; what is on is something."""
    return rule("off", lambda v: v.enabled | ((v[kind] == "none") & (v.intensity == 0.0))) + rule("on", lambda v: ~v.enabled | (v[kind] != "none"))


_planner = rule("planner", lambda v: v.deterministic & (v.planner_version == PLANNER_VERSION))
_versions = rule("version", lambda v: (v.schema_version == SCHEMA_VERSION) & (v.planner_version == PLANNER_VERSION))

MUSIC = boolean("enabled") + enum("style", STYLES) + number("intensity", 0.0, 1.0) + text("rationale") + _off("style")
AMBIENCE = boolean("enabled") + enum("type", PLACES) + number("intensity", 0.0, 1.0) + number("confidence", 0.0, 1.0) + strings("source_basis") + text("fallback_reason", optional=True) + _off("type")
DUCKING = (
    boolean("ducking_enabled") + number("music_reduction_db", -60.0, 0.0) + number("ambience_reduction_db", -60.0, 0.0) + integer("attack_ms", 0, 5000) + integer("release_ms", 0, 10000) + text("rationale")
    + rule("off", lambda v: v.ducking_enabled | ((v.music_reduction_db == 0.0) & (v.ambience_reduction_db == 0.0)))
)
TRANSITION = enum("type", CHANGES) + integer("duration_ms", 0, 10000) + text("rationale") + rule("at_once", lambda v: ~v["type"].isin("none", "hard_cut", "impact") | (v.duration_ms == 0))
SILENCE = (
    integer("pre_scene_silence_ms", 0, 10000) + integer("post_scene_silence_ms", 0, 10000) + boolean("music_suppressed", "ambience_suppressed", "intentional_silence") + text("rationale")
    + rule("unintended", lambda v: v.intentional_silence | ((v.pre_scene_silence_ms == 0) & (v.post_scene_silence_ms == 0) & ~v.music_suppressed & ~v.ambience_suppressed))
)
SCENE_DIAGNOSTICS = (
    number("confidence", 0.0, 1.0) + strings("warnings") + boolean("fallback_used") + text("fallback_reason", optional=True) + strings("missing_inputs", "source_signals", "resolved_conflicts") + boolean("deterministic")
    + rule("reason", lambda v: ~v.fallback_used | v.fallback_reason.isNotNull()) + _planner
)
SCENE = (
    text("scene_id") + integer("scene_index", 0, 1_000_000) + number("start", 0.0, 1_000_000.0) + number("end", 0.0, 1_000_000.0) + number("duration", 0.0001, 1_000_000.0)
    + rule("timing", lambda v: (v.end > v.start) & (F.abs((v.end - v.start) - v.duration) <= 0.001)) + enum("audio_intent", INTENTS) + enum("emotional_tone", TONES) + number("energy", 0.0, 1.0)
    + struct("music", MUSIC) + struct("ambience", AMBIENCE) + struct("ducking", DUCKING) + struct("transition_in", TRANSITION) + struct("transition_out", TRANSITION) + struct("silence", SILENCE) + struct("diagnostics", SCENE_DIAGNOSTICS)
)
SUMMARY = (
    enum("dominant_tone", TONES) + enum("default_music_style", STYLES) + numbers("energy_curve", 0.0, 1.0) + integer("scene_count", 0, 1_000_000)
    + rule("curve", lambda v: F.size(v.energy_curve) == v.scene_count) + number("target_loudness_lufs", -40.0, -5.0)
)
COUNTERS = ("fallback_count", "extreme_energy_count", "music_style_change_count", "unsupported_aggressive_transition_count", "ambience_scene_count", "scene_without_usable_input_count")
PROJECT_DIAGNOSTICS = (
    number("confidence", 0.0, 1.0) + strings("warnings", "missing_inputs", "resolved_conflicts") + sum((integer(n, 0, "scenes") for n in COUNTERS), ())
    + boolean("flat_energy_curve", "fallback_dominant", "deterministic") + _planner
)
PLAN = (
    _versions + rule("status", lambda v: v.deterministic & v.status.isin(*STATUSES)) + struct("project_summary", SUMMARY) + rule("scene_count", lambda v: F.size(v.scenes) == v.project_summary.scene_count) + structs("scenes", SCENE)
    + rule("scene_order", lambda v: F.forall(F.transform(v.scenes, lambda s, i: s.scene_index == i), lambda ok: F.coalesce(ok, F.lit(False))))
    + rule("scene_ids", lambda v: F.size(F.array_distinct(F.transform(v.scenes, lambda s: s.scene_id))) == F.size(v.scenes))
    + rule("energy_curve", lambda v: F.transform(v.scenes, lambda s: s.energy) == v.project_summary.energy_curve)
)
DIAGNOSTICS = _versions + rule("deterministic", lambda v: v.deterministic) + struct("project", PROJECT_DIAGNOSTICS) + structs("scenes", SCENE_DIAGNOSTICS)


def names(model: tuple) -> dict[str, Field]:
    return {f.name: f for f in model if f.kind != "rule"}


def misfits(model: tuple, value, path: str = "", extra: tuple[str, ...] = ()) -> list[str]:
    """Fields of a decoded value that the model lacks (+path) or that it asks for (-path), at
    every level; a level that is no object, or no list, is ~path. `extra`: fields that only
    rules read."""
    if not isinstance(value, dict):
        return ["~" + (path or ".")]
    known, at = names(model), lambda n: f"{path}.{n}" if path else n
    out = ["+" + at(n) for n in sorted(value) if n not in known and n not in extra]
    for n, f in known.items():
        if n not in value:
            out += [] if f.optional else ["-" + at(n)]
        elif f.kind == "struct":
            out += misfits(f.model, value[n], at(n), extra)
        elif f.kind == "structs":
            out += [m for i, x in enumerate(value[n]) for m in misfits(f.model, x, f"{at(n)}[{i}]", extra)] if isinstance(value[n], list) else ["~" + at(n)]
    return out


def decode(column: Column, model: tuple, dialect: str = "contract", limit: int = 65_536, extra: tuple[str, ...] = ()) -> Column:
    """array<string>: why a text is no canonical JSON of a model: the parser's one reason, or the
    fields that don't fit, by path; empty where it is one, null for null."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return misfits(model, parse(t, dialect, limit), "", extra)
            except ValueError as e:
                return [str(e)]

        return texts.map(one)

    return run(column)
