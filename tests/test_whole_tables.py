"""Relations take all rows of their tables, not those of some first ids."""

import pytest

from fabula.plans import registry  # noqa: F401  (registers the relations)
from fabula.plans.relation import apply

PROFILES = "image_id long, user_id long, file string, description string, tags string, ocr string, tag_list array<string>, ocr_list array<string>, semantic_text string, priority double, preferred_phase double, realism double, width int, height int, contrast double, brightness double, edge_mean double, center_edges double, quietest double"
SCENES = "project_id string, scene_index int, scene_count int, scene_start double, scene_end double, voiceover_text string"


def image(i, user, description, ocr=""):
    file = f"img_{i}.jpg"
    return (i, user, file, description, "", ocr, [], [ocr] if ocr else [], f"{file} {description} {ocr}".strip(), 0.5, 0.0, None, 900, 1600, 40.0, 128.0, 10.0, 10.0, 100.0)


def test_images_of_a_user_are_ranked(spark):
    profiles = spark.createDataFrame([image(5, 1, "quiet portrait"), image(7000, 1, "hospital doctor record"), image(8, 2, "hospital doctor record")], PROFILES)
    scenes = spark.createDataFrame([("1-0", 0, 1, 0.0, 5.0, "The hospital record and a portrait.")], SCENES)
    given = dict(profiles=profiles, scenes=scenes)
    for name in ("scene_x_image", "semantic_overlap", "top_terms", "final_image_score", "semantic_reference_score", "candidate_reason"):
        assert {r.image_id for r in apply(name, spark, **given).collect()} == {5, 7000}, name
    assert {r.image_id: (r.overlap, r.semantic) for r in apply("semantic_overlap", spark, **given).collect()} == {5: (1, 49.0), 7000: (2, 58.0)}
    assert {r.image_id: r.rank for r in apply("rank_candidates", spark, **given).collect()} == {7000: 1, 5: 2}
    # the reference: 1.14^2 + 1.6^2 + 0.14 * 1.14 + 1.7 for 5, which comes first; 2 * 1.14^2 + 1.6^2 + 0.14 * 1.14 for 7000
    assert [(r.image, r.semantic_reference, r.semantic_score) for r in apply("image_assignment", spark, **given).collect()] == [(7000, 5, pytest.approx(18.219))]
    plan = apply("scene_x_image", spark, **given)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_text_in_a_picture_costs_room_for_captions(spark):
    profiles = spark.createDataFrame([image(1, 1, "x"), image(2, 1, "x", "BREAKING"), image(3, 1, "x", "Y" * 90)], PROFILES)
    assert {r.image_id: r.penalty for r in apply("caption_ocr_penalty", spark, profiles=profiles).collect()} == {1: 0.0, 2: 24.0, 3: 55.0}


def test_concepts_and_their_members_are_weighed(spark):
    words = spark.createDataFrame([(1, 5, "court", 1), (1, 5, "report", 2), (1, 900, "court", 1), (1, 900, "evidence", 1), (1, 901, "quiet", 1), (2, 7, "court", 1)], "user_id long, image_id long, word string, c long")
    profiles = spark.createDataFrame([image(5, 1, "court report"), image(900, 1, "evidence court"), image(901, 1, "quiet"), image(7, 2, "room")], PROFILES)
    found = {(r.image_id, r.word): r.weight for r in apply("concept_expand", spark, image_words=words, profiles=profiles).collect()}
    both = {"court_report": 1.6, "court_evidence": 1.6}
    want = {5: both | {"court": 1.28, "report": 2.14, "evidence": 0.14}, 900: both | {"court": 1.28, "report": 0.14, "evidence": 1.14}, 901: {"quiet": 2.74}, 7: {"court": 1.0}}
    assert found == {(i, w): pytest.approx(x) for i, ws in want.items() for w, x in ws.items()}


def test_unresolved_parents_of_every_graph(spark):
    given = dict(provenance=spark.createDataFrame([(7, 1), (7, 2), (11, 1), (11, 3), (20, 1)], "doc long, node int"), provenance_edges=spark.createDataFrame([(7, 2, 1), (11, 3, 2), (20, 1, 9)], "doc long, node int, parent int"))
    assert sorted(tuple(r) for r in apply("provenance_parent_resolve", spark, **given).collect()) == [(11, 3, 2), (20, 1, 9)]


def test_frames_that_differ_in_late_bins(spark):
    early, late = [1.0] * 8 + [5.0] * 28 + [0.0] * 28, [1.0] * 8 + [0.0] * 28 + [5.0] * 28
    frames = spark.createDataFrame([(i, "c", v, 148.0, i + 1, i * 1.0, 1) for i, v in enumerate([early, early, late, late])], "vec_id long, clip string, hist array<double>, total double, frame int, t double, detail long")
    found = {r.vec_id: r.distance for r in apply("bhattacharyya", spark, frames=frames).collect()}
    assert found == {0: 0.0, 1: 0.0, 2: pytest.approx((1 - 8 / 148) ** 0.5, abs=1e-6), 3: 0.0}
    assert [(r.scene, r.began) for r in apply("cut_detection", spark, frames=frames).orderBy("scene").collect()] == [(1, 0.0), (2, 2.0)]
    assert {(r.bins, r.mass) for r in apply("histogram", spark, frames=frames).collect()} == {(36, 29.6)}


def test_all_staging_candidates_are_kept(spark):
    names = [("ab12", i) for i in range(65)] + [("ab99", i) for i in range(100, 164)]
    paths = spark.createDataFrame([(i, f"staging/v1/{h}.{i:05x}") for h, i in names], "entry long, staging_path string")
    found = apply("recovery_traversal", spark, final_path=paths).collect()
    assert {(r.prefix, r.identity, r.entry, r.exceeded) for r in found} == {("ab", h, i, h == "ab12") for h, i in names}
    assert len(found) == len(names)


def test_contract_of_many_scenes(spark):
    scenes = spark.createDataFrame([(p, i, 6, 2.0 * i, 2.0 * i + 2.0 + (0.1 if p == "d" and i == 2 else 0.0), "Why?") for p in "abcd" for i in range(6)], SCENES)
    plans = spark.createDataFrame([(p, i, 2.0 * i + (0.02 if p == "c" else 0.0), 2.0 * i + 2.0 + (0.1 if p == "d" and i == 2 else 0.0)) for p in "abcd" for i in range(5 if p == "b" else 6)], "project_id string, scene_index int, scene_start double, scene_end double")
    found = {r.project_id: (r.counts_agree, r.positive, r.gapless, r.plans_agree) for r in apply("transition_contract", spark, scenes=scenes, motion_plans=plans).collect()}
    assert found == {"a": (True, True, True, True), "b": (False, True, True, True), "c": (True, True, True, False), "d": (True, True, False, True)}
