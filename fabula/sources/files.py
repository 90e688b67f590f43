"""Reads and writes of the files that projects use.

Tables are read and written by Spark; what is one small document (a pointer, a checkpoint, a run's
configuration) or a listing goes through Hadoop's file systems on the driver, so paths may be
on any of them.
"""

from __future__ import annotations

import json
import re
import subprocess
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEGMENTS = "project_id string, start double, end double, text string, words array<struct<word:string,start:double,end:double>>"
MANIFEST = "schema_version string, images array<struct<file:string,description:string,tags:array<string>,priority:double,preferred_phase:double>>"
SCENES = "project_id string, scene_index int, start double, end double, image string, voiceover_text string, match_terms array<string>"
LISTING = "path string, name string, kind string, bytes long, modified_ms long, depth int, issue string"
IMAGES, AUDIO = ("jpg", "jpeg", "png", "webp"), ("wav", "mp3", "m4a", "aac", "flac")


class ScanError(ValueError):
    """Why a required document can't be used: `kind` is missing, unreadable or not_object."""

    def __init__(self, kind: str, path: str):
        super().__init__(f"{kind}: {path}")
        self.kind = kind


class Conflict(RuntimeError):
    """Someone else published first."""


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str, limit: int) -> str | None:
    """The text of a small file; None where there is none. A file over the limit is unreadable."""
    system, at = _system(spark, path)
    if not system.exists(at):
        return None
    size = system.getFileStatus(at).getLen()
    if size > limit:
        raise ScanError("unreadable", path)
    stream = system.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    except UnicodeDecodeError as e:
        raise ScanError("unreadable", path) from e
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file as a whole: written beside it, then renamed over it."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    system, at = _system(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = system.create(aside, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = system.makeQualified(at)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(system.makeQualified(aside), qualified, how)


def scan_json(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """Whole-file JSON objects under an explicit schema. Rows that do not parse keep their
    text in _corrupt_record, or fail the read where the input is required."""
    full = StructType.fromDDL(schema).add("_corrupt_record", "string")
    reader = spark.read.option("multiLine", True)
    return reader.schema(StructType.fromDDL(schema)).option("mode", "FAILFAST").json(path) if required else reader.schema(full).option("mode", "PERMISSIVE").json(path)


def scan_required_json(spark: SparkSession, path: str, limit: int = 64 << 20) -> dict:
    """One document's object; a ScanError tells missing, unreadable and not_object apart."""
    text = _read(spark, path, limit)
    if text is None:
        raise ScanError("missing", path)
    try:
        value = json.loads(text)
    except ValueError as e:
        raise ScanError("unreadable", path) from e
    if not isinstance(value, dict):
        raise ScanError("not_object", path)
    return value


def scan_optional_json(spark: SparkSession, path: str, limit: int = 64 << 20) -> dict:
    """As scan_required_json, but a document that is not there is an empty object."""
    try:
        return scan_required_json(spark, path, limit)
    except ScanError as e:
        if e.kind != "missing":
            raise
        return {}


def scan_optional_with_warning(spark: SparkSession, path: str, label: str) -> tuple[dict | None, str | None]:
    """A document's object, or a warning code: label_optional_input_missing, _unreadable or _not_object."""
    try:
        return scan_required_json(spark, path), None
    except ScanError as e:
        return None, f"{label}_optional_input_{e.kind}"


def with_warning(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column parsed to `value`, and why not: missing, unreadable or not_object."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    known = F.try_parse_json(column)
    warning = F.when(F.col(column).isNull(), "missing").when(known.isNull(), "unreadable").when(~F.ltrim(column).startswith("{"), "not_object")
    return df.withColumn("warning", warning).withColumn("value", F.when(F.col("warning").isNull(), parsed))


def scan_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder: path, length, modificationTime, depth; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "modificationTime", (F.size(F.split("path", "/")) - 1).alias("depth"))


def natural_key(name: str) -> list[tuple[int, int, str]]:
    """Digits as numbers, before letters in lower case."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", name) if p]


def scan_tree(spark: SparkSession, root: str, max_depth: int = 32, hidden: bool = False) -> DataFrame:
    """A listing of a folder (LISTING), depth first by name: nested repositories and folders at
    max_depth are listed but not entered (issue nested_repository, truncated), folders that
    can't be listed have listing_error, `.git` is left out."""
    system, top = _system(spark, root)
    rows, stack = [], [(top, 0)]
    prefix = str(system.makeQualified(top)).rstrip("/") + "/"
    while stack:
        folder, depth = stack.pop()
        try:
            found = sorted(system.listStatus(folder), key=lambda s: (s.getPath().getName().lower(), s.getPath().getName()))
        except Exception as e:  # noqa: BLE001  (a Java exception of any kind)
            if folder is top:
                raise ScanError("unreadable", root) from e
            rows.append((str(folder).removeprefix(prefix), folder.getName(), "directory", 0, 0, depth, "listing_error"))
            continue
        below = []
        for s in found:
            name = s.getPath().getName()
            if name == ".git" or (name.startswith(".") and not hidden):
                continue
            relative = str(s.getPath()).removeprefix(prefix)
            if s.isSymlink():
                rows.append((relative, name, "symlink", s.getLen(), s.getModificationTime(), depth, None))
            elif s.isDirectory():
                issue = "nested_repository" if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), ".git")) else "truncated" if depth >= max_depth else None
                if issue:
                    rows.append((relative, name, "directory", 0, s.getModificationTime(), depth, issue))
                else:
                    below.append((s.getPath(), depth + 1))
            else:
                rows.append((relative, name, "file", s.getLen(), s.getModificationTime(), depth, None))
        stack += reversed(below)
    return spark.createDataFrame(rows, LISTING)


def list_dir_bounded(spark: SparkSession, path: str, most: int) -> list[str]:
    """Names in a folder, sorted; raises ScanError where there is one more than `most`."""
    system, at = _system(spark, path)
    names, found = [], system.listStatusIterator(at)
    while found.hasNext():
        names.append(found.next().getPath().getName())
        if len(names) > most:
            raise ScanError("unreadable", path)
    return sorted(names)


def scan_media_dir(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGES) -> list[str]:
    """Names of a folder's files with one of the suffixes, in natural order."""
    system, at = _system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(at) if s.isFile()]
    return sorted((n for n in names if n.lower().rpartition(".")[2] in suffixes), key=lambda n: (natural_key(n), n))


def scan_media_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders below a root with at least one image and one audio file: folder, newest change."""
    files = scan_listing(spark, root).withColumn("folder", F.regexp_replace("path", "/[^/]+$", "")).withColumn("suffix", F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1)))
    both = files.groupBy("folder").agg(F.bool_or(F.col("suffix").isin(*IMAGES)).alias("images"), F.bool_or(F.col("suffix").isin(*AUDIO)).alias("audio"), F.max("modificationTime").alias("modified"))
    return both.where("images and audio").select("folder", "modified")


def resolve_project(spark: SparkSession, root: str, explicit: str | None = None) -> str:
    """The folder that was asked for, else the one with media that changed last."""
    if explicit:
        return explicit
    newest = scan_media_folders(spark, root).agg(F.max_by("folder", F.struct("modified", "folder")).alias("folder")).first().folder
    if newest is None:
        raise ScanError("missing", root)
    return newest


def scan_git_index(spark: SparkSession, repository: str) -> tuple[DataFrame, str]:
    """Tracked paths of a repository on the driver, and `tracked`; no paths and `unknown` where
    Git can't tell, so that nothing counts as untracked."""
    try:
        done = subprocess.run(["git", "-C", repository, "ls-files", "-z"], capture_output=True, check=True, timeout=60)
        paths = [p for p in done.stdout.decode("utf-8").split("\0") if p]
    except (OSError, subprocess.SubprocessError, UnicodeDecodeError):
        return spark.createDataFrame([], "tracked string"), "unknown"
    return spark.createDataFrame([(p,) for p in paths], "tracked string"), "tracked"


def validate_root(spark: SparkSession, path: str) -> str:
    """A root as a qualified path: absolute, no steps up, a folder and no link."""
    if ".." in path.split("/") or not re.match(r"^(/|[a-z][a-z0-9+.-]*:/)", path):
        raise ScanError("unreadable", path)
    system, at = _system(spark, path)
    if not system.exists(at) or not system.getFileStatus(at).isDirectory() or system.getFileLinkStatus(at).isSymlink():
        raise ScanError("missing", path)
    return str(system.makeQualified(at))


def read_bounded(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Files of at most `limit` bytes with their SHA-256; longer ones are never loaded."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= limit)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def sink_json(df: DataFrame, path: str) -> None:
    """A new folder of JSON lines; what is there already is never overwritten."""
    df.write.mode("errorifexists").json(path)


def sink_canonical(df: DataFrame, path: str, key: list[str]) -> None:
    """JSON lines with sorted keys, numbers to four places and -0 as 0, in the order of `key`."""
    def value(f):
        c = F.col(f"`{f.name}`")
        return F.when(F.round(c, 4) == 0, F.lit(0.0)).otherwise(F.round(c, 4)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else c

    line = F.to_json(F.struct(*(value(f) for f in sorted(df.schema.fields, key=lambda f: f.name))), {"ignoreNullFields": "false"})
    sink_lines(df.withColumn("_line", line), path, key, "_line")


def sink_lines(df: DataFrame, path: str, key: list[str], line: str) -> None:
    """Text lines in the order of keys (range-partitioned, so part files follow on)."""
    df.repartitionByRange(*key).sortWithinPartitions(*key).select(F.col(line).alias("value")).write.mode("errorifexists").text(path)


def sink_ffconcat(df: DataFrame, path: str) -> None:
    """project_id, scene_index, image, duration -> concat lists, each begun by its header; the
    last image comes again."""
    quoted = F.concat(F.lit("file '"), F.replace("image", F.lit("'"), F.lit("'\\''")), F.lit("'"))
    last = df.groupBy("project_id").agg(F.max_by("image", "scene_index").alias("image"), (F.max("scene_index") + 1).alias("scene_index"))
    lines = df.select("project_id", "scene_index", F.concat_ws("\n", quoted, F.format_string("duration %.6f", "duration")).alias("line"))
    header = last.select("project_id", F.lit(-1).alias("scene_index"), F.lit("ffconcat version 1.0").alias("line"))
    lines = lines.unionByName(last.select("project_id", "scene_index", quoted.alias("line"))).unionByName(header)
    sink_lines(lines, path, ["project_id", "scene_index"], "line")


def sink_plan(build: Callable[[], DataFrame], fallback: Callable[[str], DataFrame], path: str) -> str:
    """Writes what `build` gives, or what `fallback` gives for its error: a plan is always
    there. Returns planned or fallback."""
    try:
        status = "planned"
        build().write.mode("errorifexists").json(f"{path}/{status}")
    except Exception as e:  # noqa: BLE001  (whatever stops planning)
        status = "fallback"
        fallback(str(e)).write.mode("errorifexists").json(f"{path}/{status}")
    return status


def publish(spark: SparkSession, frames: dict[str, DataFrame], root: str, expected: int | None = None) -> int:
    """Tables as one: all go to a folder of their own, then a pointer names it, renamed into
    place. A reader sees the old tables or the new ones, never some of each. Where `expected`
    is given, the pointer must have that revision (0: none yet), else Conflict; one writer at
    a time is the caller's to see to. Returns the new revision."""
    now = scan_optional_json(spark, f"{root}/current.json")
    if expected is not None and now.get("revision", 0) != expected:
        raise Conflict(root)
    version = uuid.uuid4().hex
    for name, frame in frames.items():
        frame.write.parquet(f"{root}/{version}/{name}")
    again = scan_optional_json(spark, f"{root}/current.json")
    if again.get("revision", 0) != now.get("revision", 0):
        raise Conflict(root)
    revision = now.get("revision", 0) + 1
    _write(spark, f"{root}/current.json", json.dumps({"revision": revision, "tables": sorted(frames), "version": version}, sort_keys=True))
    return revision


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that the pointer names."""
    now = scan_required_json(spark, f"{root}/current.json")
    return {name: spark.read.parquet(f"{root}/{now['version']}/{name}") for name in now["tables"]}


def publish_pair(spark: SparkSession, plan: DataFrame, diagnostics: DataFrame, root: str) -> int:
    """An audio plan and its diagnostics, both or neither."""
    return publish(spark, {"plan": plan, "diagnostics": diagnostics}, root)


def read_pair(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    found = published(spark, root)
    return found["plan"], found["diagnostics"]


def sink_catalog(spark: SparkSession, records: DataFrame, root: str, expected: int) -> int:
    """A catalog's records as a new snapshot, by compare and swap on its revision."""
    return publish(spark, {"records": records}, root, expected)


def sink_checkpoint(spark: SparkSession, path: str, checkpoint: dict, expected: int) -> int:
    """A checkpoint with the next revision, where the one there has the expected one (0: none)."""
    now = scan_optional_json(spark, path, 65_536)
    if now.get("checkpoint_revision", 0) != expected:
        raise Conflict(path)
    _write(spark, path, json.dumps({**checkpoint, "checkpoint_revision": expected + 1}, sort_keys=True, separators=(",", ":")))
    return expected + 1


def sink_staging_entry(spark: SparkSession, payload: DataFrame, metadata: dict, path: str) -> dict:
    """A staged entry: payload, manifest with each file's bytes and SHA-256, metadata, and last
    of all COMPLETE, which names the digests of the two; without it the entry is none."""
    payload.write.mode("errorifexists").parquet(f"{path}/payload")
    files = read_bounded(spark, f"{path}/payload", 1 << 40).withColumn("path", F.regexp_extract("path", "([^/]+)$", 1)).orderBy("path").collect()
    manifest = {"files": [{"digest": f"sha256:{f.sha256}", "relative_path": f.path, "size_bytes": f.length} for f in files], "manifest_version": 1}
    texts = {"manifest.json": json.dumps(manifest, sort_keys=True), "metadata.json": json.dumps({**metadata, "payload_file_count": len(files), "payload_total_bytes": sum(f.length for f in files)}, sort_keys=True)}
    for name, text in texts.items():
        _write(spark, f"{path}/{name}", text)
    digests = {name: spark.createDataFrame([(text,)], "t string").select(F.sha2("t", 256)).first()[0] for name, text in texts.items()}
    _write(spark, f"{path}/COMPLETE", json.dumps(digests, sort_keys=True))
    return manifest


def sink_run_config(spark: SparkSession, base: dict, changes: dict, path: str) -> dict:
    """A run's own configuration: the base with changes laid over it, section by section."""
    merged = {k: {**v, **changes[k]} if isinstance(v, dict) and isinstance(changes.get(k), dict) else changes.get(k, v) for k, v in base.items()}
    merged |= {k: v for k, v in changes.items() if k not in base}
    _write(spark, path, json.dumps(merged, indent=2, sort_keys=True, ensure_ascii=False))
    return merged
