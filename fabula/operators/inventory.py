"""Inventory of a project's files: what each is, whether it is safe, what might be cleaned up.

Files come from the parts: a run has one file of every kind below, each in a context (an explicit
root), with what a look at it showed. `apply(name, spark, inventory_files=df)` takes listings of
one's own.
"""

from ..plans.relation import literal, quote, relation

#: Files of a run: context, path below its root, and what kind of object is found there.
FILES = [
    ("validation", "validation_report.md", "file"), ("validation", "out/Report-1.json", "file"), ("validation", "sha256.txt", "file"), ("validation", "validation_pack.zip", "file"), ("validation", "notes.bin", "file"),
    ("archive", "release-1.zip", "file"), ("repository", "config.json", "file"), ("repository", "styles/dark.json", "file"), ("repository", "engine/main.py", "file"), ("repository", "engine", "directory"), ("repository", ".git/index", "file"),
    ("run", "config.json", "file"), ("run", "work/caption_audio_16khz.wav", "file"), ("run", "work/source_images.ffconcat", "file"), ("run", "work/semantic_video_intermediate.mp4", "file"), ("run", "work/generated_ab12.mp4", "file"), ("run", "work/other.tmp", "file"), ("run", "work/link.wav", "symlink"),
    ("run", "output/captions.json", "file"), ("run", "output/audio_plan.json", "file"), ("run", "output/audio_diagnostics.json", "file"), ("run", "output/motion_plan.json", "file"), ("run", "output/captions.srt", "file"), ("run", "output/documentary.mp4", "file"), ("run", "logs/run.log", "file"),
    ("project", "image_manifest.json", "file"), ("project", "Img_2.PNG", "file"), ("project", "Voiceover final.wav", "file"), ("project", "music.mp3", "file"), ("project", "readme.txt", "file"), ("none", "stray.dat", "file"),
]
#: Names with a meaning in a run's output and work folders, and suffixes.
OUTPUT_NAMES = [("captions.json", "captions_json"), ("image_intelligence_plan.json", "image_intelligence_plan"), ("semantic_edit_plan.json", "semantic_edit_plan"), ("caption_director_plan.json", "caption_director_plan"), ("story_director_plan.json", "story_director_plan"), ("audio_plan.json", "audio_plan"), ("audio_diagnostics.json", "audio_diagnostics"), ("motion_analysis.json", "motion_analysis"), ("motion_plan.json", "motion_plan")]
WORK_NAMES = [("caption_audio_16khz.wav", "caption_audio_normalized"), ("source_images.ffconcat", "source_images_concat"), ("semantic_timeline.ffconcat", "semantic_timeline_concat"), ("base_video_intermediate.mp4", "base_video_intermediate"), ("semantic_video_intermediate.mp4", "semantic_video_intermediate")]
IMAGES = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff")
AUDIO = (".wav", ".mp3", ".m4a", ".aac", ".flac")


def named(pairs) -> str:
    return "case lower " + " ".join(f"when {quote(n)} then {quote(t)}" for n, t in pairs) + " end"


def one_of(values) -> str:
    return "(" + ", ".join(map(quote, values)) + ")"


@relation(public=False)
def file_kinds(d):
    return d.values("f", ("k", "context", "relative", "found"), [(i, *f) for i, f in enumerate(FILES)])


@relation("part", "file_kinds", public=False)
def inventory_files(d):
    """Listed files: context, path below its root and below the inventory's, object, size, how
    the look at it ended (ok, missing, error), where a link leads, whether the resolved path is
    inside, and what went wrong on the way (traversal)."""
    n = len(FILES)
    return f"""
    select p_partkey as file_id, run, context, relative, concat(case context when 'run' then concat('runs/', cast(run as string), '/') when 'none' then '' else concat(context, '/', cast(run as string), '/') end, relative) as path,
      case when p_partkey % 53 = 7 and found = 'file' then 'missing' else found end as kind, cast(p_size * 1000 as bigint) as bytes, case when p_partkey % 53 = 7 and found = 'file' then 'missing' when p_partkey % 59 = 8 then 'error' else 'ok' end as look,
      case when found = 'symlink' then case run % 5 when 0 then 'internal' when 1 then 'external' when 2 then 'broken' when 3 then 'loop' else 'unreadable' end end as target, p_partkey % 61 <> 9 as inside, case when p_partkey % 53 = 7 and found = 'file' then 'stat_error' when found = 'directory' and run % 4 = 0 then 'nested_repository' when found = 'directory' and run % 4 = 1 then 'truncated' end as traversal
    from (select *, cast(floor(p_partkey / {n}e0) as bigint) as run, cast(p_partkey % {n} as int) as which from part) p join file_kinds on k = which"""


@relation("inventory_files", public=False)
def tracked_paths(d):
    """The Git index of each repository: its source and configuration."""
    return "select run, relative as tracked from inventory_files where context = 'repository' and kind = 'file' and relative <> 'styles/dark.json' and look = 'ok' and run % 7 <> 3"


@relation("inventory_files", public=False)
def git_indexes(d):
    """Whether each run's index can be read."""
    return "select distinct run, run % 7 <> 3 as readable from inventory_files"


@relation("git_indexes", "tracked_paths")
def scan_git_index(d):
    """The index of each run's repository: how many paths it tracks; unknown where it can't be
    read, so that nothing below counts as untracked."""
    return "select i.run, case when i.readable then 'tracked' else 'unknown' end as status, cast(count(t.tracked) as bigint) as paths from git_indexes i left join tracked_paths t on t.run = i.run and i.readable group by i.run, i.readable"


@relation("inventory_files", "git_indexes", "tracked_paths")
def git_status_for(d):
    """tracked where the index has the path or one below it; outside the repository it does not
    apply, and where there is no index that can be read it is unknown."""
    folders = d.map(d.range(1, d.size(d.split('tracked', '/'))), d.join(d.slice(d.split('tracked', '/'), 1, 'x'), '/'))
    return f"""
    select f.file_id, case when context <> 'repository' then 'not_applicable' when not coalesce(i.readable, false) then 'unknown' when t.folder is not null then 'tracked' else 'untracked' end as git_status
    from inventory_files f left join git_indexes i on i.run = f.run left join (select distinct run, folder from {d.unnest(f"(select run, {folders} as folders from tracked_paths) s", 'folders', 'folder')}) t on t.run = f.run and t.folder = relative"""


@relation("inventory_files", "git_status_for")
def assess_path_safety(d):
    """Path, Git and link status of each file, whether that protects it, and why; every doubt
    protects."""
    # fixed values: statuses and reasons, in order of precedence
    steps = [
        ("relative = ''", "'protected_root'", "'not_symlink'", "true", "Inventory, repository, and storage roots are protected containers."),
        ("relative like '.git/%' or relative like '%/.git/%'", "'unsafe'", "'not_symlink'", "true", ".git and all of its contents are always protected."),
        ("look = 'missing'", "'unknown'", "'unknown'", "true", "Path disappeared or is missing; protected fail-closed."),
        ("look = 'error'", "'unknown'", "'unknown'", "true", "Path metadata is inaccessible; protected fail-closed."),
        ("target = 'unreadable'", "'unknown'", "'unknown'", "true", "Symlink target could not be assessed."),
        ("target = 'external'", "'unsafe'", "'external'", "true", "Symlink resolves outside the explicit inventory root."),
        ("target = 'internal'", "'safe'", "'internal'", "true", "Internal symlink is observed but always protected."),
        ("target = 'broken'", "'unsafe'", "'broken'", "true", "Broken symlink is protected fail-closed."),
        ("target = 'loop'", "'unsafe'", "'loop'", "true", "Symlink loop is protected fail-closed."),
        ("not inside", "'outside_root'", "'not_symlink'", "true", "Resolved path escapes the explicit inventory root."),
        ("git_status = 'tracked'", "'safe'", "'not_symlink'", "true", "Git-tracked paths are always protected."),
        ("git_status = 'unknown'", "'unknown'", "'not_symlink'", "true", "Git status is unknown; protected fail-closed."),
        ("true", "'safe'", "'not_symlink'", "false", "Contained non-symlink path passed read-only safety checks."),
    ]
    pick = lambda i: "case " + " ".join(f"when {s[0]} then {quote(s[i]) if i == 4 else s[i]}" for s in steps) + " end"
    git = "case when relative like '.git/%' then 'tracked' else git_status end"
    return f"select f.file_id, {pick(1)} as path_status, {git} as git_status, {pick(2)} as symlink_status, {pick(3)} as protected, {pick(4)} as reason from inventory_files f join git_status_for g on g.file_id = f.file_id"


@relation("inventory_files")
def inventory_classify(d):
    """Type, category, protection and rule of each file: the first rule of its context that
    matches; traversal issues and links are never classified."""
    unknown = ("unknown", "work", "protected_unknown", False)
    # fixed values: names of types, categories, protections and rules
    rules = [
        ("kind = 'symlink'", *unknown, "safety.symlink_fail_closed", "suspicious"), ("traversal = 'nested_repository'", *unknown, "safety.nested_repository", "suspicious"),
        ("traversal = 'truncated'", *unknown, "traversal.max_depth", "partial"), ("traversal is not null", *unknown, "concat('observation.', traversal)", "suspicious"),
        ("context = 'validation' and (contains(lower, 'validation_report') or (contains(lower, 'report') and suffix in ('.md', '.json', '.txt')))", "validation_report", "validation", "protected_validation", False, "validation.report", "known"),
        ("context = 'validation' and (contains(lower, 'hash') or contains(lower, 'sha256'))", "validation_hash_inventory", "validation", "protected_validation", False, "validation.hash_inventory", "known"),
        ("context = 'validation' and suffix = '.zip' and contains(lower, 'validation')", "validation_package", "validation", "protected_validation", False, "validation.package", "known"),
        ("context = 'validation'", *unknown, "unknown.fail_closed", "unknown"),
        ("context = 'archive'", "release_archive", "archive", "protected_archive", False, "archive.explicit_root", "known"),
        ("context = 'repository' and relative = 'config.json'", "repository_config", "config", "protected_config", False, "config.repository", "known"),
        ("context = 'repository' and relative like 'styles/%' and suffix = '.json'", "style_config", "config", "protected_config", False, "config.style", "known"),
        ("context = 'run' and relative = 'config.json'", "effective_run_config", "config", "protected_config", False, "config.effective_run", "known"),
        (f"context = 'run' and relative like 'work/%' and {named(WORK_NAMES)} is not null", named(WORK_NAMES), "work", "eligible_work", False, f"concat('work.', {named(WORK_NAMES)})", "known"),
        ("context = 'run' and relative like 'work/%' and lower like 'generated~_%' escape '~' and suffix = '.mp4'", *unknown, "work.legacy_video_ambiguous", "ambiguous"),
        (f"context = 'run' and relative like 'output/%' and {named(OUTPUT_NAMES)} is not null", named(OUTPUT_NAMES), "cache", "eligible_cache", True, f"concat('cache.', {named(OUTPUT_NAMES)})", "known"),
        ("context = 'run' and relative like 'output/%' and lower = 'captions.srt'", "captions_srt", "output", "protected_output", False, "output.captions_srt", "known"),
        ("context = 'run' and relative like 'output/%' and lower = 'documentary.mp4'", "final_documentary", "output", "protected_output", False, "output.final_documentary", "known"),
        ("context = 'run' and relative like 'logs/%' and suffix = '.log'", "run_log", "logs", "protected_unknown", False, "logs.run_log", "known"),
        ("context = 'project' and lower = 'image_manifest.json'", "image_manifest", "source", "immutable_source", False, "source.image_manifest", "known"),
        (f"context = 'project' and suffix in {one_of(IMAGES)}", "source_image", "source", "immutable_source", False, "source.image", "known"),
        (f"context = 'project' and suffix in {one_of(AUDIO)} and (contains(lower, 'voiceover') or contains(lower, 'voice over') or contains(lower, 'narration') or contains(lower, 'narrator'))", "source_voiceover", "source", "immutable_source", False, "source.voiceover", "known"),
        (f"context = 'project' and suffix in {one_of(AUDIO)}", *unknown, "source.audio_role_unknown", "unknown"),
        ("true", *unknown, "unknown.fail_closed", "unknown"),
    ]
    value = lambda v: v if isinstance(v, str) and v.startswith(("case ", "concat(")) else literal(v)
    pick = lambda i, name: "case " + " ".join(f"when {r[0]} then {value(r[i])}" for r in rules) + f" end as {name}"
    columns = ", ".join(pick(i, n) for i, n in enumerate(("artifact_type", "category", "rule_protection", "cacheable", "rule_id", "observation"), 1))
    return f"""
    select file_id, run, context, path, kind, bytes, {columns}, case when context = 'run' and kind = 'file' and relative in ('output/audio_plan.json', 'output/audio_diagnostics.json') then concat('audio-plan-bundle:', path_above) end as group_id
    from (select *, {d.replace('path', '/[^/]+$', '')} as path_above, lower({d.extract('path', '([^/]+)$', 1)}) as lower, lower({d.extract('path', '([.][^./]+)$', 1)}) as suffix from inventory_files) t"""


@relation("inventory_classify", "assess_path_safety")
def effective_protection(d):
    """Tracked files are protected as such, what safety protects as unknown, the rest by its rule."""
    return "select c.file_id, case when git_status = 'tracked' then 'protected_git_tracked' when protected then 'protected_unknown' else rule_protection end as protection from inventory_classify c join assess_path_safety s on s.file_id = c.file_id"


@relation("assess_path_safety")
def safety_gate(d):
    """Whether a file is safe, no link, and untracked or outside any repository."""
    return "select file_id, path_status = 'safe' and symlink_status = 'not_symlink' and git_status in ('untracked', 'not_applicable') as passes from assess_path_safety"


@relation("inventory_classify", "effective_protection", "safety_gate")
def cleanup_candidate(d):
    """Files of eligible protection that are known, regular and pass the safety gate."""
    return "select c.file_id from inventory_classify c join effective_protection p on p.file_id = c.file_id join safety_gate g on g.file_id = c.file_id where protection in ('eligible_cache', 'eligible_work') and kind = 'file' and observation = 'known' and passes"


@relation("inventory_classify", "effective_protection", "assess_path_safety", "cleanup_candidate")
def inspect_inventory(d):
    """One record a listed file, with all that is known of it and the bytes that cleaning it up
    would give back."""
    return """
    select c.file_id, run, path, kind, bytes, artifact_type, category, protection, cacheable, rule_id, observation, path_status, git_status, symlink_status, reason as safety_reason, group_id, case when k.file_id is not null and not protected then bytes else 0 end as reclaimable
    from inventory_classify c join effective_protection p on p.file_id = c.file_id join assess_path_safety s on s.file_id = c.file_id left join cleanup_candidate k on k.file_id = c.file_id"""


@relation("inspect_inventory", "inventory_files")
def inventory_totals(d):
    """Bytes in all, of regular files and reclaimable of each run, whether its listing was cut,
    and the warnings it gave."""
    warnings = (("A nested Git boundary could not be assessed.", "traversal = 'nested_git_unknown'"), ("Nested repository or submodule boundary protected fail-closed.", "traversal = 'nested_repository'"), ("One or more paths could not be fully observed.", "traversal in ('listing_error', 'stat_error')"), ("Traversal was truncated by max_depth.", "traversal = 'truncated'"))
    return f"""
    select i.run, cast(sum(i.bytes) as bigint) as bytes, cast(sum(case when i.kind = 'file' then i.bytes else 0 end) as bigint) as regular_bytes, cast(sum(reclaimable) as bigint) as reclaimable, bool_or(rule_id = 'traversal.max_depth') as truncated,
      concat_ws(' ', {', '.join(f"case when bool_or({c}) then {quote(w)} end" for w, c in warnings)}) as warnings from inspect_inventory i join inventory_files f on f.file_id = i.file_id group by i.run"""


@relation("inventory_classify")
def group_membership(d):
    """Files that belong to a bundle, by its type and id."""
    return "select file_id, 'audio_plan_bundle' as group_type, group_id, artifact_type from inventory_classify where group_id is not null"


@relation("group_membership")
def artifact_group_status(d):
    """Bundles with the members present and missing: complete with both, else partial."""
    has = lambda t: f"bool_or(artifact_type = '{t}')"
    members = ("audio_diagnostics", "audio_plan")
    return f"""
    select group_type, group_id, case when {' and '.join(map(has, members))} then 'complete' else 'partial' end as status, concat_ws(',', {', '.join(f"case when {has(t)} then '{t}' end" for t in members)}) as present,
      concat_ws(',', {', '.join(f"case when not {has(t)} then '{t}' end" for t in members)}) as missing from group_membership group by group_type, group_id"""


@relation("inventory_files", public=False)
def claimed_paths(d):
    """Paths as they are claimed: some absolute, some with a step up."""
    return "select file_id, case file_id % 5 when 0 then concat('/', path) when 1 then concat('a/../', path) when 2 then concat('C:/', path) else path end as claimed from inventory_files"


@relation("claimed_paths")
def path_containment(d):
    """Whether a path stays inside its root: neither absolute nor with a step up."""
    return f"select file_id, not {d.matches('claimed', '^(/|[A-Za-z]:)')} and not {d.matches('claimed', '(^|/)[.][.](/|$)')} and not contains(claimed, chr(92)) as inside from claimed_paths"


@relation("inventory_files")
def inventory_helpers(d):
    """Each file's path relative to the root of its context, or the record of an unknown one."""
    return "select file_id, case when context <> 'none' then relative end as relative, case when context = 'none' then 'unknown.fail_closed' end as rule_id from inventory_files"


@relation("inspect_inventory")
def sink_inventory_text(d):
    """The lines that a listing of the inventory prints."""
    return "select file_id, concat(case when reclaimable > 0 then '* ' else '- ' end, path, ' [', category, '/', artifact_type, '] ', protection, ' ', cast(bytes as string), ' B (', rule_id, ')') as line from inspect_inventory"
