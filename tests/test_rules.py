"""Hand-computed cases of the rules, over small observation tables given in place of the derived ones."""

import pytest

from fabula.plans import registry  # noqa: F401  (registers the relations)
from fabula.plans.relation import apply

SCENES = "project_id string, scene_index int, scene_count int, scene_start double, scene_end double, voiceover_text string"
WORDS = "project_id string, i int, word string, s double, e double"


def rows(spark, name, *columns, **given):
    return sorted(tuple(r[c] for c in columns) for r in apply(name, spark, **given).collect())


def words(spark, *items):
    return spark.createDataFrame([("p", i, w, float(s), float(e)) for i, (w, s, e) in enumerate(items, 1)], WORDS)


def test_words_are_made_monotonic(spark):
    given = words(spark, ("a", 0.0, 0.5), ("tiny", 0.4, 0.45), ("b", 0.3, 0.35), ("c", 0.6, 0.62), ("-", 1.0, 1.2), ("-d", 1.2, 1.5))
    # b and tiny and c are under 0.075 and not the first word
    assert rows(spark, "monotonic_words", "place", "word", "word_start", "word_end", raw_words=given) == [(1, "a", 0.0, 0.5), (2, "-", 1.0, 1.2), (3, "-d", 1.2, 1.5)]
    given = words(spark, ("a", 0.0, 0.5), ("b", 0.2, 0.6), ("c", 0.25, 0.4))
    assert rows(spark, "monotonic_words", "place", "word_start", "word_end", raw_words=given) == [(1, 0.0, 0.5), (2, 0.485, 0.6), (3, 0.585, 0.665)]


def test_hyphens_join_the_word_before(spark):
    given = words(spark, ("-first", 0, 0.2), ("well", 0.3, 0.5), ("-", 0.5, 0.6), ("known", 0.6, 0.9), ("-er", 0.9, 1.2))
    assert rows(spark, "hyphen_merge", "word", "s", "e", raw_words=given) == [("-first", 0.0, 0.2), ("known-er", 0.6, 1.2), ("well-", 0.3, 0.6)]


def test_transcript_detectors(spark):
    ok = [("plain", i, i + 0.5) for i in range(3)]
    scenes = spark.createDataFrame([("p", 0, 1, 0.0, 9.0, "x"), ("empty", 0, 1, 0.0, 9.0, "x")], SCENES)

    def issues(*items):
        found = dict(rows(spark, "transcript_quality", "project_id", "issues", scenes=scenes, raw_words=words(spark, *items)))
        assert found["empty"] == "empty transcript"
        return found["p"]

    assert issues(*ok, ("other", 4, 4.4)) == ""
    assert issues(*[(f"w{i}", i, i + 0.08) for i in range(5)]) == "" and issues(*[(f"w{i}", i, i + 0.08) for i in range(6)]) == "micro-timestamp run"
    assert issues(*[(f"w{i}", i * 0.1, i * 0.1 + 0.1) for i in range(8)]) == "implausible word burst"
    assert issues(*[(f"w{i}", i * 0.1, i * 0.1 + 0.1) for i in range(7)]) == ""
    assert issues(*[(w, i, i + 0.5) for i, w in enumerate("We go, we GO! now".split())]) == "repeated 2-word phrase"
    assert issues(*[(w, i, i + 0.5) for i, w in enumerate("so it was so it was then".split())]) == "repeated 3-word phrase"
    assert issues(*[(w, i, i + 0.5) for i, w in enumerate("no no ... ... no".split())]) == ""


def test_captions_on_screen(spark):
    captions = spark.createDataFrame([("p", 1, 0.0, 1.0, "a"), ("p", 2, 0.8, 2.0, "b")], "project_id string, caption_id int, caption_start double, caption_end double, caption_text string")
    spoken = spark.createDataFrame([("p", n, i, t) for n, (i, t) in enumerate([(1, 0.5), (2, 0.9), (3, 1.0), (4, 1.5), (5, 2.0), (6, 2.1)], 1)], "project_id string, n int, word_index int, word_start double")
    assert rows(spark, "active_caption", "word_index", "caption_id", captions=captions, spoken=spoken) == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)]


@pytest.mark.parametrize("times,active", [([(0.0, 0.2), (0.2, 0.47), (0.6, 0.9)], 1), ([(0.0, 0.2), (0.2, 0.45), (0.6, 0.9)], 1), ([(0.0, 0.5), (0.5, 0.9)], 0), ([(0.6, 0.8), (0.8, 0.9)], 0), ([(0.0, 0.1), (0.2, 0.3), (0.7, 0.9)], 1)])
def test_active_word(spark, times, active):
    captions = spark.createDataFrame([("p", 1, 0.0, 1.0, "a")], "project_id string, caption_id int, caption_start double, caption_end double, caption_text string")
    spoken = spark.createDataFrame([("p", 1, i, i, s, e) for i, (s, e) in enumerate(times, 1)], "project_id string, n int, place int, word_index int, word_start double, word_end double")
    assert rows(spark, "active_word", "active", captions=captions, spoken=spoken) == [(active,)]


def test_subrip_blocks(spark):
    captions = spark.createDataFrame([("p", 7, 3661.5, 3662.25, "Hello there")], "project_id string, caption_id int, caption_start double, caption_end double, caption_text string")
    assert rows(spark, "sink_srt", "block", captions=captions) == [("7\n01:01:01,500 --> 01:01:02,250\nHELLO THERE\n",)]


def test_small_captions_chain(spark):
    groups = spark.createDataFrame([("p", i, n, s, e) for i, (n, s, e) in enumerate([(4, 0.0, 1.0), (1, 1.0, 1.3), (1, 1.3, 1.6), (1, 1.6, 1.9), (1, 6.0, 6.2)], 1)], "project_id string, caption int, n int, s0 double, e1 double")
    assert rows(spark, "caption_merge_small", "caption", "merged", "size", caption_groups=groups) == [(1, 1, 4), (2, 1, 5), (3, 1, 6), (4, 2, 1), (5, 3, 1)]


def test_coverage_counts_words(spark):
    spoken = spark.createDataFrame([("p", i) for i in (1, 2, 3)], "project_id string, word_index int")
    merged = spark.createDataFrame([("p", 1, 1)], "project_id string, caption int, merged int")
    for kept, covered in (([1, 2, 3], True), ([1, 2], False)):
        segments = spark.createDataFrame([("p", i, 1) for i in kept], "project_id string, word_index int, caption int")
        assert rows(spark, "caption_coverage", "covered", spoken=spoken, caption_segmentation=segments, caption_merge_small=merged) == [(covered,)]


def test_faces_weigh_by_area(spark):
    faces = spark.createDataFrame([("p", 1, 1, 0.0, 0.0, 192.0, 108.0), ("p", 1, 2, 960.0, 540.0, 384.0, 216.0)], "project_id string, n int, face int, x double, y double, w double, h double")
    # centres 0.05 and 0.6, areas as 1 to 4
    assert rows(spark, "face_centroid", "focus_x", "focus_y", "confidence", "face_count", "subject_scale", faces=faces) == [(0.49, 0.49, 0.88, 2, 0.05)]


def test_cuts_keep_their_distance(spark):
    frames = spark.createDataFrame([(i, "c", i + 1, i * 0.5, d, w) for i, (d, w) in enumerate([(0.0, 5), (0.9, 9), (0.9, 1), (0.9, 7), (0.1, 7), (0.6, 2), (0.2, 1), (0.2, 3)])], "vec_id long, clip string, frame int, t double, distance double, detail long")
    # the first cut may come 1.2 after the start: at 1.5; the next at 2.5 is too early
    assert rows(spark, "cut_detection", "scene", "began", "ended", "representative", bhattacharyya=frames) == [(1, 0.0, 1.5, 1), (2, 1.5, 4.0, 3)]


def test_names_of_projects(spark):
    names = spark.createDataFrame([(1, "Återkomst: Del 2!"), (2, "***"), (3, "  Élan -- vital "), (4, "漢字"), (5, "a_b")], "page_id long, name string")
    assert rows(spark, "slugify", "page_id", "slug", names=names) == [(1, "aterkomst_del_2"), (2, "documentary"), (3, "elan_vital"), (4, "documentary"), (5, "a_b")]


def test_density_is_twenty_characters_a_second(spark):
    scenes = spark.createDataFrame([("p", 0, 1, 0.0, 10.0, "x" * 100)], SCENES)
    captions = spark.createDataFrame([("p", 1, 0.0, 1.0, "x")], "project_id string, caption_id int, caption_start double, caption_end double, caption_text string")
    assert rows(spark, "narration_density", "density", scenes=scenes, captions=captions) == [(0.5,)]


def test_candidates_of_one_digest(spark):
    ddl = "doc long, node int, language string, kind string, candidate_id string, format string, digest string, bytes long"
    given = spark.createDataFrame([(1, 1, "sv", "MANUAL", "a", "SRT", "d1", 5), (1, 2, "en", "AUTOMATIC", "a", "SRT", "d1", 5), (1, 3, "en", "MANUAL", "b", "JSON", "d1", 5), (2, 1, "en", "MANUAL", "a", "SRT", "d2", 5), (2, 2, "en", "MANUAL", "a", "TTML", "d2", 6)], ddl)
    assert rows(spark, "candidate_dedup", "doc", "node", "clash", transcript_candidates=given) == [(1, 3, 0), (2, 1, 1)]
    assert rows(spark, "candidate_total_order", "doc", "place", "node", transcript_candidates=given)[:3] == [(1, 1, 3), (1, 2, 2), (1, 3, 1)]


# -- the cache: each reason of a lookup, by the stage that finds it
OK = dict(structure="valid", versions="valid", outcome="valid", payload="valid", lock="absent", failed_at=None, stable=True, root_stable=True)
LOOKUPS = [
    ({}, "hit", None), (dict(structure="entry_absent"), "miss", None), (dict(structure="entry_absent", lock="stale"), "miss", None), (dict(structure="entry_absent", lock="active"), "locked_or_in_progress", None),
    *((dict(structure="entry_absent", lock=r), s, r) for r, s in (("unsupported_lock_version", "unsupported_version"), ("malformed_lock", "invalid_entry"), ("lock_identity_conflict", "invalid_entry"), ("lock_timestamp_invalid", "invalid_entry"), ("unsafe_object", "unsafe_path"), ("io_failure", "invalid_entry"), ("unstable_snapshot", "invalid_entry"))),
    *((dict(structure=r), s, r) for r, s in (("unsafe_object", "unsafe_path"), ("incomplete_entry", "invalid_entry"), ("unexpected_top_level_object", "invalid_entry"))),
    *((dict(versions=r), s, r) for r, s in (("unsupported_entry_version", "unsupported_version"), ("unsupported_manifest_version", "unsupported_version"), ("unsupported_cache_key_version", "unsupported_version"), ("unsupported_runtime_fingerprint_version", "unsupported_version"), ("malformed_complete", "invalid_entry"), ("malformed_metadata", "invalid_entry"), ("malformed_manifest", "invalid_entry"))),
    *((dict(outcome=r), s, r) for r, s in (("entry_identity_conflict", "invalid_entry"), ("cache_key_conflict", "invalid_entry"), ("manifest_digest_mismatch", "integrity_failure"), ("metadata_digest_mismatch", "integrity_failure"), ("namespace_producer_conflict", "producer_mismatch"), ("producer_mismatch", "producer_mismatch"), ("schema_mismatch", "schema_mismatch"), ("artifact_mismatch", "schema_mismatch"), ("runtime_fingerprint_mismatch", "runtime_fingerprint_mismatch"))),
    (dict(outcome="metadata_manifest_summary_mismatch"), "invalid_entry", "malformed_metadata"),
    *((dict(payload=r), "integrity_failure", r) for r in ("payload_missing", "payload_size_mismatch", "payload_digest_mismatch", "payload_hardlink_detected")),
    (dict(payload="unsafe_object"), "unsafe_path", "unsafe_object"), (dict(payload="unexpected_payload_object"), "invalid_entry", "unexpected_payload_object"), (dict(payload="payload_cardinality_invalid"), "invalid_entry", "unexpected_payload_object"), (dict(payload="payload_policy_limit_exceeded"), "invalid_entry", "malformed_manifest"), (dict(payload="payload_read_unstable"), "invalid_entry", "unstable_snapshot"),
    (dict(stable=False), "invalid_entry", "unstable_snapshot"), (dict(failed_at="structure"), "invalid_entry", "io_failure"), (dict(failed_at="payload"), "invalid_entry", "io_failure"),
    # earlier stages win; a root that moved wins over later reasons only
    (dict(versions="malformed_complete", outcome="cache_key_conflict", payload="payload_missing"), "invalid_entry", "malformed_complete"), (dict(outcome="schema_mismatch", payload="payload_missing"), "schema_mismatch", "schema_mismatch"),
    (dict(root_stable=False), "invalid_entry", "unstable_snapshot"), (dict(root_stable=False, payload="payload_missing"), "invalid_entry", "unstable_snapshot"), (dict(root_stable=False, versions="malformed_manifest"), "invalid_entry", "malformed_manifest"),
]


def test_every_reason_of_a_lookup(spark):
    cases = [OK | c for c, _, _ in LOOKUPS]
    table = lambda ddl, *keys: spark.createDataFrame([(i, *(c[k] for k in keys)) for i, c in enumerate(cases)], "entry long, " + ddl)
    versions = spark.createDataFrame([(i, "COMPLETE", 1, c["versions"]) for i, c in enumerate(cases)] + [(i, "metadata.json", 2, "malformed_metadata") for i, c in enumerate(cases) if c["versions"] != "valid"], "entry long, document string, ordinal int, version_state string")
    given = dict(entry_structure=table("structure string", "structure"), document_versions=versions, document_integrity=table("outcome string", "outcome"), payload_validate=table("outcome string", "payload"), lock_observation=table("lock_state string", "lock"), entry_reads=table("failed_at string, stable boolean, root_stable boolean", "failed_at", "stable", "root_stable"), entries=spark.createDataFrame([(i,) for i in range(len(cases))], "entry long"))
    found = rows(spark, "lookup_status", "entry", "status", "reason", **given)
    assert found == [(i, s, r) for i, (_, s, r) in enumerate(LOOKUPS)]
    assert len({r for _, _, r in found if r}) == 30  # all but the one that no stage gives
    final = dict(rows(spark, "final_only_lookup", "entry", "status", **given))
    assert all(final[i] == "miss" for i, c in enumerate(cases) if c["structure"] == "entry_absent")
    codes = dict(rows(spark, "reason_to_diagnostic", "reason", "code", **given))
    assert codes["malformed_lock"] == "document_invalid" and codes["lock_identity_conflict"] == "identity_mismatch" and codes["schema_mismatch"] == "expectation_mismatch" and codes["payload_hardlink_detected"] == "payload_hardlink"
    states = dict(rows(spark, "final_observe", "entry", "final_state", **given))
    assert states[0] == "final_valid" and states[1] == "final_absent" and {states[i] for i, (_, s, r) in enumerate(LOOKUPS) if r == "unstable_snapshot" and cases[i]["structure"] != "entry_absent"} == {"final_unstable"}


def test_structure_of_a_folder(spark):
    own = [("COMPLETE", "file"), ("manifest.json", "file"), ("metadata.json", "file"), ("payload", "directory")]
    listings = {1: [(".", "directory"), *own], 2: [(".", "symlink")], 3: [(".", "directory"), *own[1:]], 4: [(".", "directory"), *own, ("x", "file")], 5: [(".", "directory"), *own[:3], ("payload", "file")], 6: [(".", "directory"), *own[1:], ("x", "pipe")], 7: [(".", "directory"), *own[1:], ("x", "file")]}
    objects = spark.createDataFrame([(e, *o) for e, os in listings.items() for o in os], "entry long, name string, kind string")
    entries = spark.createDataFrame([(e,) for e in range(8)], "entry long")
    assert dict(rows(spark, "entry_structure", "entry", "structure", entry_objects=objects, entries=entries)) == {0: "entry_absent", 1: "valid", 2: "unsafe_object", 3: "incomplete_entry", 4: "unexpected_top_level_object", 5: "unsafe_object", 6: "unsafe_object", 7: "incomplete_entry"}


def test_first_finding_of_a_payload(spark):
    base = dict(empty_allowed=False, records=2, too_much=False, unsafe=False, unexpected=False, missing=False, bad=None)
    cases = [({}, "valid"), (dict(records=0), "payload_cardinality_invalid"), (dict(records=0, empty_allowed=True), "valid"), (dict(too_much=True, unsafe=True), "payload_policy_limit_exceeded"), (dict(unsafe=True, unexpected=True), "unsafe_object"), (dict(unexpected=True, missing=True), "unexpected_payload_object"), (dict(missing=True, bad="a|payload_size_mismatch"), "payload_missing"), (dict(bad="a/b.bin|payload_digest_mismatch"), "payload_digest_mismatch")]
    given = spark.createDataFrame([(i, *(base | c).values(), 0) for i, (c, _) in enumerate(cases)], "entry long, empty_allowed boolean, records long, too_much boolean, unsafe boolean, unexpected boolean, missing boolean, bad string, hashed long")
    assert rows(spark, "payload_validate", "entry", "outcome", payload_findings=given) == [(i, o) for i, (_, o) in enumerate(cases)]
    declared = spark.createDataFrame([(1, p, 10, 1) for p in "abc"], "entry long, path string, bytes long, content long")
    observed = spark.createDataFrame([(1, "a", "file", 10, 1, True, 2), (1, "b", "file", 11, 1, True, 1), (1, "c", "file", 10, 2, True, 1)], "entry long, path string, kind string, bytes long, links int, stable boolean, content long")
    entries = spark.createDataFrame([(1, "o")], "entry long, producer string")
    assert rows(spark, "payload_validate", "outcome", "bytes_valid", declared=declared, observed=observed, entries=entries) == [("payload_digest_mismatch", 10)]


@pytest.mark.parametrize("final,staging,lock,status", [
    ("final_valid", [], "lock_absent", "final_published"), ("final_valid", [], "lock_stale", "final_published_lock_retained"), ("final_valid", ["staging_incomplete"], "lock_absent", "final_published_with_superseded_staging"), ("final_valid", ["staging_complete_valid"], "lock_active", "final_published_with_superseded_staging_and_lock"),
    ("final_absent", [], "lock_absent", "empty"), ("final_absent", [], "lock_active", "active_lock_without_entry"), ("final_absent", [], "lock_stale", "stale_lock_without_entry"), ("final_absent", ["staging_complete_valid"], "lock_absent", "unpublished_complete_staging"), ("final_absent", ["staging_complete_valid"], "lock_active", "complete_staging_with_active_lock"), ("final_absent", ["staging_complete_valid"], "lock_stale", "complete_staging_with_stale_lock"),
    ("final_absent", ["staging_complete_valid", "staging_incomplete"], "lock_absent", "incomplete_staging"), ("final_absent", ["staging_incomplete"], "lock_active", "incomplete_staging_with_active_lock"), ("final_absent", ["staging_incomplete"], "lock_stale", "incomplete_staging_with_stale_lock"),
    ("final_invalid", ["staging_unsafe"], "lock_unsupported", "recovery_unsafe"), ("final_invalid", [], "lock_unsupported", "recovery_unsupported"), ("final_unstable", ["staging_invalid"], "lock_absent", "recovery_unstable"), ("final_absent", ["staging_io_failure"], "lock_absent", "recovery_invalid"),
])
def test_lifecycles(spark, final, staging, lock, status):
    reason = lambda s: None if s.rsplit("_", 1)[1] in ("valid", "absent", "active", "stale", "incomplete") else "why " + s
    given = dict(final_observe=spark.createDataFrame([(1, final, reason(final))], "entry long, final_state string, reason string"), lock_observe=spark.createDataFrame([(1, lock, reason(lock))], "entry long, lock_state string, reason string"),
                 staging_observe=spark.createDataFrame([(1, i, s, reason(s)) for i, s in enumerate(staging or ["staging_absent"])], "entry long, candidate int, state string, reason string"))
    (found,) = rows(spark, "recovery_compose", "status", "staging_count", "reason", **given)
    assert found[:2] == (status, len(staging)) and (found[2] is not None) == status.startswith("recovery_")


F, G = "f" * 64, "0" * 64
RECON = [
    (dict(lookup=None), "defer", "expectations_unavailable"), (dict(catalog_status="catalog_unavailable", lookup="miss", recovery="empty"), "noop", "empty_catalog_unavailable"), (dict(catalog_status="catalog_unavailable"), "defer", "catalog_io_failure"),
    (dict(catalog_status="catalog_corrupt"), "report_only", "catalog_corrupt"), (dict(catalog_status="catalog_unsupported"), "report_only", "catalog_unsupported"), (dict(catalog_status="catalog_unsafe"), "report_only", "catalog_unsafe"), (dict(catalog_status="catalog_unstable"), "defer", "catalog_unstable"), (dict(catalog_status="catalog_io_failure"), "defer", "catalog_io_failure"),
    (dict(lookup="unsupported_version"), "report_only", "authoritative_unsupported"), (dict(lookup="unsafe_path"), "report_only", "authoritative_unsafe"), (dict(lookup="invalid_entry", lookup_reason="io_failure"), "defer", "authoritative_io_failure"), (dict(lookup="integrity_failure"), "report_only", "authoritative_invalid"),
    (dict(recovery="recovery_unstable"), "defer", "authoritative_unstable"), (dict(recovery="recovery_unsafe"), "report_only", "authoritative_unsafe"), (dict(recovery="recovery_unsupported"), "report_only", "authoritative_unsupported"), (dict(recovery="recovery_invalid"), "report_only", "authoritative_invalid"),
    (dict(lookup="miss", recovery="empty", catalog_status="record_absent", tombstone_revision=3), "noop", "tombstone_matches_empty"), (dict(lookup="miss", recovery="empty", catalog_status="record_absent"), "noop", "empty_catalog_absent"), (dict(lookup="miss", recovery="empty", catalog_status="record_found", record_revision=2), "tombstone_empty", "exact_empty"),
    (dict(final_summary=F, last_final=None), "upsert_final", "final_summary_missing"), (dict(final_summary=F, last_final=G), "upsert_final", "final_summary_stale"), (dict(final_summary=F, last_final=F, recovery="final_published", recovery_summary=F, last_recovery=None), "upsert_recovery", "recovery_summary_missing"), (dict(lookup="miss", recovery="incomplete_staging", recovery_summary=F, last_recovery=G), "upsert_recovery", "recovery_summary_stale"),
    (dict(final_summary=F, last_final=F), "noop", "summaries_match"), (dict(lookup="miss"), "defer", "authoritative_incomplete"), (dict(lookup="locked_or_in_progress"), "defer", "authoritative_incomplete"),
]


def test_every_reason_of_the_reconciliation(spark):
    base = dict(flags=1, lookup="hit", lookup_reason=None, final_summary=None, recovery=None, recovery_summary=None, catalog_status="record_found", tombstone_revision=None, record_revision=None, last_final=None, last_recovery=None)
    kinds = dict(flags="int", tombstone_revision="long", record_revision="long")
    given = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _, _) in enumerate(RECON)], "entry long, " + ", ".join(f"{k} {kinds.get(k, 'string')}" for k in base))
    found = rows(spark, "recon_compare", "entry", "action", "reason", catalog_vs_authority=given)
    assert found == [(i, a, r) for i, (_, a, r) in enumerate(RECON)] and len({r for _, _, r in found}) == 21


def test_writes_compare_revisions(spark):
    compare = spark.createDataFrame([(1, 1, "upsert_final", 4), (2, 1, "upsert_recovery", 4), (3, 1, "upsert_final", None), (4, 1, "tombstone_empty", 2), (17, 1, "upsert_final", 4), (6, 1, "noop", 1)], "entry long, flags int, action string, expected_revision long")
    lookup = spark.createDataFrame([(1, "record_found", None, 4, "old", "kept"), (2, "record_found", None, 4, "kept", "old"), (3, "record_absent", None, None, None, None), (4, "record_found", None, 2, "a", "b"), (17, "record_found", None, 4, "old", "kept"), (6, "record_found", None, 1, None, None)], "entry long, status string, tombstone_revision long, record_revision long, last_final string, last_recovery string")
    authority = spark.createDataFrame([(i, "new", "new") for i in (1, 2, 3, 4, 17, 6)], "entry long, final_summary string, recovery_summary string")
    found = rows(spark, "cas_upsert", "entry", "outcome", "revision", "last_final", "last_recovery", recon_compare=compare, catalog_lookup=lookup, catalog_vs_authority=authority)
    done = "catalog_write_applied"
    assert found == [(1, done, 5, "new", "kept"), (2, done, 5, "kept", "new"), (3, done, 1, "new", None), (4, done, 3, None, None), (17, "catalog_write_conflict", None, None, None)]


def test_graphs_of_provenance(spark):
    chain = lambda n: [(0, 1), *((i, i + 1) for i in range(1, n))]
    graphs = {1: (3, chain(3)), 2: (3, [*chain(3), (3, 9)]), 3: (3, [(0, 1), (1, 2)]), 4: (3, [*chain(3), (3, 1)]), 5: (40, chain(40)), 6: (31, chain(31)), 7: (2, [(0, 1), (0, 2), (1, 2)]), 8: (70, chain(70)), 9: (3, [(0, 1), (2, 3), (3, 2)])}
    records = [(g, 0, "AGGREGATE") for g in graphs] + [(g, i, "METADATA") for g, (n, _) in graphs.items() for i in range(1, n + 1)] + [(10, 1, "METADATA"), (11, 0, "AGGREGATE"), (11, 5, "AGGREGATE")]
    given = dict(provenance=spark.createDataFrame(records, "doc long, node int, role string"), provenance_edges=spark.createDataFrame([(g, *e) for g, (_, es) in graphs.items() for e in es], "doc long, node int, parent int"))
    assert dict(rows(spark, "provenance_graph", "doc", "verdict", **given)) == {1: "valid", 2: "parent_unresolved", 3: "root_not_unique", 4: "cyclic", 5: "too_deep", 6: "valid", 7: "valid", 8: "too_many_records", 9: "unreachable", 10: "aggregate_not_unique", 11: "aggregate_not_unique"}


# -- sequences over the scenes of a project
def test_images_are_not_used_up(spark):
    files = spark.createDataFrame([(1, "a.jpg"), (2, "B.jpg"), (3, "c.jpg")], "image_id long, file string")
    scenes = spark.createDataFrame([("p", i, 4, 0.0, 1.0, "x") for i in range(4)], SCENES)
    scores = spark.createDataFrame([("p", s, i, x) for s in range(4) for i, x in ((1, 60.0), (2, 58.0), (3, 30.0))], "project_id string, scene_index int, image_id long, final_score double")
    reference = spark.createDataFrame([("p", s, i, x) for s in range(4) for i, x in ((1, 9.0), (2, 9.0), (3, 40.0))], "project_id string, scene_index int, image_id long, score double")
    # 1 by score, 2 as 1 comes again at once; 1 (60 - 3.5) over 3; then 2 (58 - 3.5). The reference
    # takes 3, is kept from it by 25 + 3.5 (11.5 left, still the best), and so on
    found = rows(spark, "image_assignment", "scene_index", "image", "semantic_reference", profiles=files, scenes=scenes, final_image_score=scores, semantic_reference_score=reference)
    assert found == [(0, 1, 3), (1, 2, 3), (2, 1, 1), (3, 2, 3)]


def test_motion_goes_on_from_the_last_scene(spark):
    ddl = "project_id string, scene_index int, scene_start double, scene_end double, preset string, z0 double, z1 double, x0 double, y0 double, x1 double, y1 double, tx double, ty double, strength double, confidence double, guided_hold double"
    push = ("subject_push_in", 1.015, 1.1, 0.1, 0.1, 0.4, 0.2, 0.4, 0.2, 1.0, 0.9, 0.0)
    given = spark.createDataFrame([("p", i, i * 5.0, i * 5.0 + 5.0, *push) for i in range(3)], ddl)
    found = rows(spark, "motion_continuity", "scene_index", "preset", "z0", "z1", "x0", "x1", "hold", motion_preset=given)
    assert found[0] == (0, "subject_push_in", 1.015, 1.1, 0.1, 0.4, 0.0)
    # at 1.1 of 1.015 to 1.105: reversed, 0.09 * 0.58 down; then pushed again from there
    assert found[1] == (1, "continuity_pull_out", 1.1, 1.0478, 0.0, 0.18, 0.07)
    assert found[2] == (2, "subject_push_in", 1.0478, 1.1, 0.0, 0.4, 0.07)


def test_pages_after_a_cursor(spark):
    entries = spark.createDataFrame([(i, "d", "p", 1, f"{i:x}") for i in range(1, 9)], "entry long, domain string, producer string, schema_version int, digest string")
    cursors = spark.createDataFrame([("d", "p", 1, "2", 3)], "domain string, producer string, schema_version int, cursor string, page_limit int")
    assert rows(spark, "keyset_page", "entry", "place", "next_cursor", entries=entries, cursors=cursors) == [(3, 1, None), (4, 2, None), (5, 3, "5")]


def test_what_files_are(spark):
    ddl = "file_id long, run long, context string, relative string, path string, kind string, bytes long, look string, target string, inside boolean, traversal string"
    cases = [("run", "work/caption_audio_16khz.wav", "work.caption_audio_normalized", "eligible_work", True), ("run", "output/audio_plan.json", "cache.audio_plan", "eligible_cache", True), ("run", "output/x.json", "unknown.fail_closed", "protected_unknown", False), ("run", "work/generated_1.mp4", "work.legacy_video_ambiguous", "protected_unknown", False), ("validation", "a/Final_report.MD", "validation.report", "protected_validation", False), ("project", "Narration 1.WAV", "source.voiceover", "immutable_source", False), ("project", "a.wav", "source.audio_role_unknown", "protected_unknown", False), ("repository", "styles/a/b.json", "config.style", "protected_git_tracked", False)]
    files = spark.createDataFrame([(i, 1, c, r, f"{c}/1/{r}", "file", 10, "ok", None, True, None) for i, (c, r, *_) in enumerate(cases)], ddl)
    given = dict(inventory_files=files, tracked_paths=spark.createDataFrame([(1, "styles/a/b.json")], "run long, tracked string"))
    assert rows(spark, "inventory_classify", "file_id", "rule_id", **given) == [(i, c[2]) for i, c in enumerate(cases)]
    assert rows(spark, "inspect_inventory", "file_id", "protection", "reclaimable", **given) == [(i, c[3], 10 if c[4] else 0) for i, c in enumerate(cases)]
    assert rows(spark, "artifact_group_status", "group_id", "status", "missing", **given) == [("audio-plan-bundle:run/1/output", "partial", "audio_diagnostics")]
