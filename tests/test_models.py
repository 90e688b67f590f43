"""Constraints of audio structs, a case a rule; strict JSON in three dialects; fields by path."""

import copy
import json
import math

import pytest
from pyspark.sql import functions as F

from fabula.functions import models as m
from fabula.functions.canonical import encode, parse, verdict
from fabula.plans import registry

DDL = (
    "schema_version string, planner_version string, deterministic boolean, status string, project_summary struct<dominant_tone:string,default_music_style:string,energy_curve:array<double>,scene_count:int,target_loudness_lufs:double>, "
    "scenes array<struct<scene_id:string,scene_index:int,start:double,end:double,duration:double,audio_intent:string,emotional_tone:string,energy:double,music:struct<enabled:boolean,style:string,intensity:double,rationale:string>,"
    "ambience:struct<enabled:boolean,type:string,intensity:double,confidence:double,source_basis:array<string>,fallback_reason:string>,ducking:struct<ducking_enabled:boolean,music_reduction_db:double,ambience_reduction_db:double,attack_ms:int,release_ms:int,rationale:string>,"
    "transition_in:struct<type:string,duration_ms:int,rationale:string>,transition_out:struct<type:string,duration_ms:int,rationale:string>,silence:struct<pre_scene_silence_ms:int,post_scene_silence_ms:int,music_suppressed:boolean,ambience_suppressed:boolean,intentional_silence:boolean,rationale:string>,"
    "diagnostics:struct<confidence:double,warnings:array<string>,fallback_used:boolean,fallback_reason:string,missing_inputs:array<string>,source_signals:array<string>,resolved_conflicts:array<string>,deterministic:boolean,planner_version:string>>>"
)


def scene(i):
    change = {"type": "crossfade", "duration_ms": 800, "rationale": "r"}
    return {
        "scene_id": f"scene_{i + 1:03d}", "scene_index": i, "start": i * 5.0, "end": i * 5.0 + 5, "duration": 5.0, "audio_intent": "build", "emotional_tone": "calm", "energy": 0.4 + i / 10,
        "music": {"enabled": True, "style": "ambient", "intensity": 0.5, "rationale": "r"}, "ambience": {"enabled": True, "type": "urban", "intensity": 0.3, "confidence": 0.8, "source_basis": ["a", "B", "b"], "fallback_reason": None},
        "ducking": {"ducking_enabled": True, "music_reduction_db": -8.0, "ambience_reduction_db": -4.0, "attack_ms": 120, "release_ms": 400, "rationale": "r"}, "transition_in": dict(change), "transition_out": dict(change),
        "silence": {"pre_scene_silence_ms": 0, "post_scene_silence_ms": 0, "music_suppressed": False, "ambience_suppressed": False, "intentional_silence": False, "rationale": "r"},
        "diagnostics": {"confidence": 0.7, "warnings": [], "fallback_used": False, "fallback_reason": None, "missing_inputs": ["captions"], "source_signals": [], "resolved_conflicts": [], "deterministic": True, "planner_version": "4.7.0"},
    }


def plan():
    return {"schema_version": "1.0", "planner_version": "4.7.0", "deterministic": True, "status": "planned", "project_summary": {"dominant_tone": "calm", "default_music_style": "ambient", "energy_curve": [0.4, 0.5], "scene_count": 2, "target_loudness_lufs": -16.0}, "scenes": [scene(0), scene(1)]}


def changed(path, value):
    out = plan()
    at = out
    *way, last = path
    for step in way:
        at = at[step]
    at[last] = value
    return out


S = ("scenes", 1)
CASES = [
    ((), None, []),
    (("schema_version",), "2.0", ["version"]), (("planner_version",), None, ["version"]), (("status",), "done", ["status"]), (("deterministic",), False, ["status"]),
    (("project_summary", "dominant_tone"), "glad", ["project_summary.dominant_tone"]), (("project_summary", "default_music_style"), None, ["project_summary.default_music_style"]),
    (("project_summary", "energy_curve"), [0.4, 1.5], ["project_summary.energy_curve", "energy_curve"]), (("project_summary", "energy_curve"), [0.4], ["project_summary.curve", "energy_curve"]), (("project_summary", "energy_curve"), [0.4, 0.6], ["energy_curve"]),
    (("project_summary", "scene_count"), 3, ["project_summary.curve", "scene_count"]), (("project_summary", "target_loudness_lufs"), -4.9, ["project_summary.target_loudness_lufs"]),
    ((*S, "scene_id"), " \t", ["scenes[1].scene_id"]), ((*S, "scene_id"), "scene_001", ["scene_ids"]), ((*S, "scene_index"), 5, ["scene_order"]), ((*S, "scene_index"), -1, ["scenes[1].scene_index", "scene_order"]),
    ((*S, "start"), -1.0, ["scenes[1].start", "scenes[1].timing"]), ((*S, "end"), math.inf, ["scenes[1].end", "scenes[1].timing"]), ((*S, "duration"), 5.01, ["scenes[1].timing"]), ((*S, "duration"), 0.0, ["scenes[1].duration", "scenes[1].timing"]),
    ((*S, "audio_intent"), "Build", ["scenes[1].audio_intent"]), ((*S, "emotional_tone"), "", ["scenes[1].emotional_tone"]), ((*S, "energy"), math.nan, ["scenes[1].energy", "energy_curve"]),
    ((*S, "music", "enabled"), False, ["scenes[1].music.off"]), ((*S, "music", "style"), "none", ["scenes[1].music.on"]), ((*S, "music", "intensity"), 1.1, ["scenes[1].music.intensity"]), ((*S, "music", "rationale"), "", ["scenes[1].music.rationale"]), ((*S, "music"), None, ["scenes[1].music"]),
    ((*S, "ambience", "enabled"), None, ["scenes[1].ambience.enabled", "scenes[1].ambience.off"]), ((*S, "ambience", "type"), "none", ["scenes[1].ambience.on"]), ((*S, "ambience", "confidence"), -0.1, ["scenes[1].ambience.confidence"]),
    ((*S, "ambience", "source_basis"), ["b", "a"], ["scenes[1].ambience.source_basis"]), ((*S, "ambience", "source_basis"), ["a", "a"], ["scenes[1].ambience.source_basis"]), ((*S, "ambience", "source_basis"), ["b", "B"], ["scenes[1].ambience.source_basis"]), ((*S, "ambience", "source_basis"), ["a", " "], ["scenes[1].ambience.source_basis"]), ((*S, "ambience", "source_basis"), [], []),
    ((*S, "ambience", "fallback_reason"), " ", ["scenes[1].ambience.fallback_reason"]), ((*S, "ducking", "ducking_enabled"), False, ["scenes[1].ducking.off"]), ((*S, "ducking", "music_reduction_db"), 0.5, ["scenes[1].ducking.music_reduction_db"]), ((*S, "ducking", "attack_ms"), 5001, ["scenes[1].ducking.attack_ms"]), ((*S, "ducking", "release_ms"), None, ["scenes[1].ducking.release_ms"]),
    ((*S, "transition_in", "type"), "hard_cut", ["scenes[1].transition_in.at_once"]), ((*S, "transition_out", "duration_ms"), 10_001, ["scenes[1].transition_out.duration_ms"]), ((*S, "transition_out", "type"), "wipe", ["scenes[1].transition_out.type"]),
    ((*S, "silence", "pre_scene_silence_ms"), 200, ["scenes[1].silence.unintended"]), ((*S, "silence", "music_suppressed"), True, ["scenes[1].silence.unintended"]), ((*S, "silence", "post_scene_silence_ms"), -1, ["scenes[1].silence.post_scene_silence_ms", "scenes[1].silence.unintended"]),
    ((*S, "diagnostics", "fallback_used"), True, ["scenes[1].diagnostics.reason"]), ((*S, "diagnostics", "planner_version"), "4.6.0", ["scenes[1].diagnostics.planner"]), ((*S, "diagnostics", "deterministic"), False, ["scenes[1].diagnostics.planner"]), ((*S, "diagnostics", "warnings"), None, ["scenes[1].diagnostics.warnings"]),
    (("scenes",), [], ["scene_count", "energy_curve"]),
]


def test_every_rule_of_a_plan(spark):
    rows = [(i, plan() if not path else changed(path, value)) for i, (path, value, _) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, f"i int, v struct<{DDL}>")
    found = {r.i: r.bad for r in docs.select("i", m.violations(m.PLAN, F.col("v"), docs.schema["v"].dataType).alias("bad")).collect()}
    assert {i: (CASES[i][0], sorted(b)) for i, b in found.items()} == {i: (p, sorted(w)) for i, (p, _, w) in enumerate(CASES)}


def test_project_diagnostics_and_types(spark):
    ddl = "confidence double, warnings array<string>, missing_inputs array<string>, resolved_conflicts array<string>, fallback_count int, extreme_energy_count int, music_style_change_count int, unsupported_aggressive_transition_count string, ambience_scene_count int, flat_energy_curve boolean, fallback_dominant boolean, deterministic boolean, planner_version string"
    docs = spark.createDataFrame([(0.5, ["a"], [], [], 3, 4, 0, "0", 0, True, False, True, "4.7.0")], ddl)
    whole = docs.select(F.struct("*").alias("v"))
    bad = whole.select(m.violations(m.PROJECT_DIAGNOSTICS, F.col("v"), whole.schema["v"].dataType, counts={"scenes": F.lit(3)}).alias("bad")).first().bad
    # four of three scenes; a count as text; a count that is not there
    assert bad == ["extreme_energy_count", "unsupported_aggressive_transition_count", "scene_without_usable_input_count"]


TEXTS = [
    ('{"a":1}', "canonical", "canonical", "canonical"), ('{"a": 1}', *["not canonical"] * 3), ('{"b":1,"a":2}', *["not canonical"] * 3), ('{"a":{"x":1,"x":2}}', *["a key comes twice"] * 3), ('[{"a":1,"a":1}]', *["a key comes twice"] * 3),
    ('﻿{"a":1}', *["begins with a byte order mark"] * 3), ('{"a":1.5}', "this number is not allowed", "this number is not allowed", "canonical"), ('{"a":-0.0}', "this number is not allowed", "this number is not allowed", "not canonical"), ('{"a":NaN}', *["this number is not allowed"] * 3), ('{"a":1e999}', "this number is not allowed", "this number is not allowed", "this number is not allowed"),
    ('{"a":null}', "null is not allowed", "canonical", "null is not allowed"), ('{"a":"é"}', "not canonical", "canonical", "not canonical"), ('{"a":"\\u00e9"}', *["not canonical"] * 3), ('{"é":1,"é":2}', "keys collide in composed form", "canonical", "keys collide in composed form"),
    ("{", *["no JSON"] * 3), ("", *["no JSON"] * 3), ("[" * 100_000, *["too long"] * 3), ("[" * 60_000, *["no JSON"] * 3), ('{"a":true,"b":[1,"x"]}', *["canonical"] * 3), (None, None, None, None), ('"\\u001f\\n"', *["canonical"] * 3),
]


def test_strict_json_in_three_dialects(spark):
    docs = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TEXTS)], "i int, t string")
    found = {r.i: (r.contract, r.storage, r.key) for r in docs.select("i", *(verdict(F.col("t"), d).alias(d) for d in ("contract", "storage", "key"))).collect()}
    assert {i: (TEXTS[i][0], f) for i, f in found.items()} == {i: (t[0], t[1:]) for i, t in enumerate(TEXTS)}
    with pytest.raises(ValueError, match="not UTF-8"):
        parse(b"\xff", "contract")


def test_fields_by_path(spark):
    whole = plan()
    models = {"PLAN": (m.PLAN, whole), "SCENE": (m.SCENE, scene(0)), "SUMMARY": (m.SUMMARY, whole["project_summary"])}
    extra = ("schema_version", "planner_version", "deterministic", "status")
    for model, value in models.values():
        value = json.loads(json.dumps(value))
        more = copy.deepcopy(value)
        more["other"] = 1
        docs = spark.createDataFrame([(i, encode(_plain(v), "key")) for i, v in ((1, value), (2, more))], "i int, t string")
        assert {r.i: r.bad for r in docs.select("i", m.decode(F.col("t"), model, "key", extra=extra).alias("bad")).collect()} == {1: [], 2: ["+other"]}
    less = _plain(json.loads(json.dumps(whole)))
    del less["scenes"][1]["music"]["style"], less["scenes"][0]["scene_id"]
    less["scenes"][1]["silence"]["more"] = 1
    less["project_summary"] = []
    docs = spark.createDataFrame([(json.dumps(less, sort_keys=True, separators=(",", ":")),), ("{}",), (None,), ("[]",)], "t string")
    assert [r.bad for r in docs.select(m.decode(F.col("t"), m.PLAN, "key", extra=extra).alias("bad")).collect()] == [["~project_summary", "-scenes[0].scene_id", "-scenes[1].music.style", "+scenes[1].silence.more"], ["-project_summary", "-scenes"], None, ["~."]]


def _plain(value):
    """Without nulls, which this dialect refuses."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def test_registered_texts_and_records(spark):
    found = {tuple(r)[1:] for r in registry.QUERIES["parse_canonical"](spark, "/root/testdata/sf0.001").collect()}
    assert {f[0] for f in found} >= {"canonical", "not canonical", "a key comes twice", "this number is not allowed", "begins with a byte order mark", "no JSON"}
    assert {tuple(r.misfits) for r in registry.QUERIES["json_codecs"](spark, "/root/testdata/sf0.001").collect()} == {()}
