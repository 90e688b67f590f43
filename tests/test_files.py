import pandas as pd
import pytest

from fabula.functions import canonical
from fabula.sources import files
from fabula.streaming import events as streaming


def test_canonical_dialects():
    assert canonical.encode({"b": 1, "a": "é"}, "contract") == '{"a":"é","b":1}'
    assert canonical.encode({"a": None}, "storage") == '{"a":null}' and canonical.encode([-0.0], "key") == "[0.0]"
    for value, dialect in (({"a": None}, "contract"), ([0.5], "contract"), ([float("nan")], "key")):
        with pytest.raises(ValueError):
            canonical.encode(value, dialect)
    for text in ('{"b":1,"a":2}', '{"a":1,"a":1}', '{"a": 1}'):
        with pytest.raises(ValueError):
            canonical.parse(text, "contract")


def test_canonical_columns(spark):
    frame = spark.createDataFrame([('{"a":1}',), ('{"a": 1}',), (None,)], "t string")
    rows = frame.select(canonical.is_canonical(frame.t, "contract").alias("ok"), canonical.digest(frame.t).alias("d")).collect()
    assert [r.ok for r in rows] == [True, False, None] and rows[0].d == rows[1].d and rows[2].d is None


def test_pair_is_published_whole(spark, tmp_path):
    one, two = spark.range(3), spark.range(4)
    files.publish_pair(spark, one, two, str(tmp_path))
    files.publish_pair(spark, two, one, str(tmp_path))
    first, second = files.read_pair(spark, str(tmp_path))
    assert first.count() == 4 and second.count() == 3


def test_ffconcat_repeats_the_last_image(spark, tmp_path):
    frame = spark.createDataFrame([("p", 0, "a'b.jpg", 1.5), ("p", 1, "c.jpg", 2.0)], "project_id string, scene_index int, image string, duration double")
    files.sink_ffconcat(frame, f"{tmp_path}/out")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert lines == ["ffconcat version 1.0", "file 'a'\\''b.jpg'", "duration 1.500000", "file 'c.jpg'", "duration 2.000000", "file 'c.jpg'"]


def test_json_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"project_id": "p", "scene_index": 1}')
    assert files.scan_json(spark, f"{tmp_path}/a.json", files.SCENES).first().scene_index == 1
    frame = spark.createDataFrame([('{"a":1}',), ("[1]",), (None,)], "t string")
    assert [r.warning for r in files.with_warning(frame, "t", "a int").collect()] == [None, "not_object", "missing"]
    assert files.with_warning(spark.createDataFrame([("{oops",)], "t string"), "t", "a int").first().warning == "unreadable"
    assert files.read_bounded(spark, str(tmp_path), 10).count() == 0 and files.scan_listing(spark, str(tmp_path)).count() == 1


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, frame, mode in (("activity", streaming.activity(stream, "60 days"), "complete"), ("smoothed", streaming.smoothed(stream), "append"), ("latest", streaming.latest(stream, "60 days"), "append")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
    assert spark.sql("select sum(n) n from activity").first().n == source.count()
    out: pd.DataFrame = spark.sql("select * from smoothed").toPandas()
    assert len(out) == source.count() and out.energy.between(0, 1).all()
    assert spark.table("latest").count() == source.count()


def test_documents_and_why_not(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"a": 1}')
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "bad.json").write_text("{")
    assert files.scan_required_json(spark, f"{tmp_path}/ok.json") == {"a": 1} and files.scan_optional_json(spark, f"{tmp_path}/none.json") == {}
    for name, kind in (("list", "not_object"), ("bad", "unreadable"), ("none", "missing")):
        with pytest.raises(files.ScanError) as e:
            files.scan_required_json(spark, f"{tmp_path}/{name}.json")
        assert e.value.kind == kind and files.scan_optional_with_warning(spark, f"{tmp_path}/{name}.json", "story") == (None, f"story_optional_input_{kind}")
    with pytest.raises(files.ScanError):
        files.scan_optional_json(spark, f"{tmp_path}/list.json")


def test_listings(spark, tmp_path):
    for name in ("a/img10.jpg", "a/img2.JPG", "a/x.txt", "a/voice.wav", "b/only.png", "c/deep/er/f.txt", "r/.git/index", "r/f.txt", ".hidden/f"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    assert files.scan_media_dir(spark, f"{tmp_path}/a") == ["img2.JPG", "img10.jpg"]
    assert [r.folder.rpartition("/")[2] for r in files.scan_media_folders(spark, str(tmp_path)).collect()] == ["a"]
    assert files.resolve_project(spark, str(tmp_path)).endswith("/a") and files.resolve_project(spark, "x", "given") == "given"
    tree = {(r.path, r.issue) for r in files.scan_tree(spark, str(tmp_path), max_depth=1).collect()}
    assert tree == {("a/img10.jpg", None), ("a/img2.JPG", None), ("a/x.txt", None), ("a/voice.wav", None), ("b/only.png", None), ("c/deep", "truncated"), ("r", "nested_repository")}
    assert files.list_dir_bounded(spark, f"{tmp_path}/a", 4) == ["img10.jpg", "img2.JPG", "voice.wav", "x.txt"]
    with pytest.raises(files.ScanError):
        files.list_dir_bounded(spark, f"{tmp_path}/a", 3)
    assert files.scan_git_index(spark, f"{tmp_path}/nowhere")[1] == "unknown"
    assert files.validate_root(spark, str(tmp_path)).endswith(tmp_path.name)
    for bad in ("relative", f"{tmp_path}/../x", f"{tmp_path}/a/x.txt"):
        with pytest.raises(files.ScanError):
            files.validate_root(spark, bad)


def test_revisions_are_compared(spark, tmp_path):
    root = f"{tmp_path}/catalog"
    assert files.sink_catalog(spark, spark.range(2), root, 0) == 1 and files.sink_catalog(spark, spark.range(3), root, 1) == 2
    with pytest.raises(files.Conflict):
        files.sink_catalog(spark, spark.range(9), root, 1)
    assert files.published(spark, root)["records"].count() == 3
    assert files.sink_checkpoint(spark, f"{tmp_path}/cp.json", {"run_id": "a"}, 0) == 1 and files.sink_checkpoint(spark, f"{tmp_path}/cp.json", {"run_id": "a"}, 1) == 2
    with pytest.raises(files.Conflict):
        files.sink_checkpoint(spark, f"{tmp_path}/cp.json", {"run_id": "a"}, 1)


def test_staged_entries_and_plans(spark, tmp_path):
    manifest = files.sink_staging_entry(spark, spark.range(5).coalesce(1), {"entry_digest": "d"}, f"{tmp_path}/staged")
    assert [f["size_bytes"] > 0 for f in manifest["files"]] and files.scan_required_json(spark, f"{tmp_path}/staged/metadata.json")["payload_file_count"] == len(manifest["files"])
    assert set(files.scan_required_json(spark, f"{tmp_path}/staged/COMPLETE")) == {"manifest.json", "metadata.json"}

    def broken():
        raise ValueError("no scenes")

    fallback = lambda why: spark.createDataFrame([(why,)], "reason string")
    assert files.sink_plan(lambda: spark.range(1), fallback, f"{tmp_path}/good") == "planned"
    assert files.sink_plan(broken, fallback, f"{tmp_path}/bad") == "fallback" and spark.read.json(f"{tmp_path}/bad/fallback").first().reason == "no scenes"
    files.sink_canonical(spark.createDataFrame([("b", -0.00001, 1), ("a", 0.123456, None)], "z string, b double, c int"), f"{tmp_path}/canonical", ["z"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/canonical").orderBy("value").collect()] == ['{"b":0.0,"c":1,"z":"b"}', '{"b":0.1235,"c":null,"z":"a"}']
    merged = files.sink_run_config(spark, {"a": {"x": 1, "y": 2}, "b": 3}, {"a": {"y": 9}, "c": 4}, f"{tmp_path}/run.json")
    assert merged == {"a": {"x": 1, "y": 9}, "b": 3, "c": 4} == files.scan_required_json(spark, f"{tmp_path}/run.json")
