"""Codecs, projections and validation of records."""

from ..plans.relation import quote, relation
from .evidence import FORMATS, KINDS
from .text import four

#: Limits of listings and relative paths.
LISTING, DEPTH, PATH_BYTES = 4096, 64, 1024


def json(d, pairs) -> str:
    """Compact JSON with sorted keys: pairs of key and SQL text of the value, already JSON."""
    body = ", ',', ".join(f"{quote(chr(34) + k + chr(34) + ':')}, {v}" for k, v in sorted(pairs))
    return f"concat('{{', {body}, '}}')"


def text(column) -> str:
    """A JSON string of ASCII text without quotes, backslashes or control characters."""
    return f"concat('\"', {column}, '\"')"


def number(column) -> str:
    return f"cast({column} as string)"


def maybe(column, value) -> str:
    return f"case when {column} is null then 'null' else {value} end"


@relation("identity_three_way_union", "entries", "cursors")
def incremental_work(d):
    """Identities of each namespace behind its cursor, in order."""
    return "select u.entry, flags, cast(row_number() over (partition by e.domain, e.producer, e.schema_version order by digest) as int) as place from identity_three_way_union u join entries e on e.entry = u.entry join cursors c on c.domain = e.domain and c.producer = e.producer and c.schema_version = e.schema_version where cursor is null or digest > cursor"


@relation("sources_seen")
def flag_union(d):
    """Sources that saw each identity, as the union of their flags and by name."""
    return "select entry, cast(bit_or(flag) as int) as flags, cast(bit_count(cast(bit_or(flag) as int)) as int) as n_sources, bool_or(flag = 1) as in_final, bool_or(flag = 2) as in_staging, bool_or(flag = 4) as in_catalog from sources_seen group by entry"


@relation("catalog", "entries")
def catalog_record_codec(d):
    """Records as canonical JSON, live ones with their summaries, and whether they keep to 64 KiB."""
    live = json(d, [("entry_digest", text("digest")), ("last_recovery_observation", maybe("last_recovery", text("last_recovery"))), ("last_validated_final", maybe("last_final", text("last_final"))), ("record_kind", "'\"live\"'"), ("record_revision", number("record_revision")), ("record_version", number("version"))])
    dead = json(d, [("entry_digest", text("digest")), ("record_kind", "'\"tombstone\"'"), ("record_revision", number("record_revision")), ("record_version", number("version"))])
    return f"select entry, json, length(json) <= 65536 as fits from (select c.entry, case when tombstone then {dead} else {live} end as json from catalog c join entries e on e.entry = c.entry) t"


@relation("catalog_record_codec")
def metadata_observe_parse(d):
    """Fields read back from each record's JSON, null where they are not there."""
    read = lambda key, value: d.extract("json", f'"{key}":{value}', 1)
    none = lambda x: f"nullif({x}, '')"
    return f"select entry, cast({read('record_revision', '([0-9]+)')} as bigint) as record_revision, {none(read('record_kind', '.([a-z]+).'))} as record_kind, {none(read('entry_digest', '.([0-9a-f]{64}).'))} as entry_digest, {none(read('last_validated_final', '.([0-9a-z]+).'))} as last_final, cast({read('record_version', '([0-9]+)')} as int) as record_version from catalog_record_codec"


@relation("catalog_record_codec", public=False)
def version_documents(d):
    """Documents as they are found: some with the version twice, negative or a fraction."""
    damaged = """case when entry % 7 = 3 then replace(json, '"record_version":', '"record_version":1,"record_version":') when entry % 7 = 4 then replace(json, '"record_version":', '"record_version":-') when entry % 7 = 1 then replace(json, '"record_version":1', '"record_version":1.5') else json end"""
    return f"select entry, {damaged} as document from catalog_record_codec"


@relation("version_documents")
def version_probe(d):
    """The version in a document's text: refused where the key comes twice or is no positive integer."""
    once = """(length(j) - length(replace(j, '"record_version":', ''))) = 17"""
    valid = f"{once} and {d.matches('j', '[{,].record_version.:[1-9][0-9]*[,}]')}"
    return f"select entry, case when {valid} then 'readable' else 'malformed' end as probe, case when {valid} then cast({d.extract('j', 'record_version.:([0-9]+)', 1)} as int) end as version from (select entry, document as j from version_documents) t"


@relation("catalog", "entries")
def catalog_scalar_validators(d):
    """What breaks the rules in each record: versions, revisions, digests, and tombstones with summaries."""
    rules = [("version", "version is null or version <= 0"), ("revision", "record_revision <= 0 or record_revision > 4"), ("digest", f"not {d.matches('digest', '^[0-9a-f]{64}$')}"), ("last_final", f"last_final is not null and not {d.matches('last_final', '^[0-9a-f]{64}$')}"), ("last_recovery", f"last_recovery is not null and not {d.matches('last_recovery', '^[0-9a-f]{64}$')}"), ("tombstone", "tombstone and (last_final is not null or last_recovery is not null)")]
    return f"select c.entry, concat_ws(',', {', '.join(f'''case when {c} then '{n}' end''' for n, c in rules)}) as violations from catalog c join entries e on e.entry = c.entry"


@relation("final_path", "entry_metadata")
def identity_probe(d):
    """Whether the namespace and digest that an entry's documents name are those of its path."""
    return f"select p.entry, {d.extract('final_path', '^entries/v1/([^/]+)/', 1)} = domain as namespace_agrees, {d.extract('final_path', '([^/]+)$', 1)} = digest as digest_agrees from final_path p join entry_metadata m on m.entry = p.entry"


@relation("entries")
def namespace_iter(d):
    """Namespaces in order, schemas as numbers."""
    return "select domain, producer, schema_version, cast(count(*) as bigint) as n, cast(row_number() over (partition by domain order by producer, schema_version) as int) as place from entries group by domain, producer, schema_version"


@relation("entries")
def listing_budget(d):
    """Folders of the first shard and the entries in them, against the most that a listing may hold."""
    return f"select domain, producer, schema_version, cast(count(distinct substring(digest, 1, 2)) as bigint) as folders, cast(count(*) as bigint) as entries, count(distinct substring(digest, 1, 2)) > {LISTING} or max(n) > {LISTING} as over from (select *, count(*) over (partition by domain, producer, schema_version, substring(digest, 1, 4)) as n from entries) t group by domain, producer, schema_version"


@relation("final_path")
def relative_path_limits(d):
    """Depth and bytes of paths against their limits."""
    return f"select entry, cast({d.size(d.split('final_path', '/'))} as int) as depth, {d.bytes('final_path')} <= {PATH_BYTES} and {d.size(d.split('final_path', '/'))} <= {DEPTH} as fits from final_path"


@relation("final_path")
def recovery_traversal(d):
    """Staging candidates of each identity, all of them, and whether they exceed the 64
    that an identity may have."""
    identity = d.extract("staging_path", "/([0-9a-f]+)[.]", 1)
    return f"select substring(identity, 1, 2) as prefix, identity, entry, count(*) over (partition by identity) > 64 as exceeded from (select entry, {identity} as identity from final_path) t"


@relation("documents", public=False)
def streams(d):
    """Streams with the lengths that were declared for them: some too short, some too long."""
    return "select doc_id, coalesce(text, '') as body, cast(length(coalesce(text, '')) + case doc_id % 5 when 1 then -1 when 2 then 1 else 0 end as int) as declared from documents"


@relation("streams")
def stream_sha256(d):
    """Digest of as many characters as were declared, how many were read, and whether one more
    was there. A length below zero gives no row."""
    return f"select doc_id, declared, cast(least(length(body), declared) as int) as characters_read, length(body) > declared as has_more, {d.sha256('substring(body, 1, declared)')} as digest from streams where declared >= 0"


@relation("lines", public=False)
def fingerprint_rows(d):
    """Inputs and configurations of entries."""
    return "select doc, node, l_partkey, concat('model.', lower(l_returnflag), cast(l_partkey % 5 as string)) as config from lines"


@relation("fingerprint_rows")
def fingerprint_lists(d):
    """Inputs of each entry as they come, configurations sorted, and whether none comes twice."""
    return f"select doc as entry, {d.agg_text('cast(l_partkey as string)', ',', 'node')} as inputs, {d.agg_text('config', ',', 'config', 'node')} as configs, count(distinct config) = count(*) as unique_configs from fingerprint_rows group by doc"


@relation("entries", "fingerprint_lists", "runtime_fingerprint_values")
def cache_key_material(d):
    """What a key is made of, as canonical JSON: the artifact, inputs in order, configurations
    sorted, producer and runtime."""
    listed = lambda c: f"concat('[\"', replace({c}, ',', '\",\"'), '\"]')"
    return f"select e.entry, {json(d, [('artifact_kind', text('domain')), ('cache_contract_version', text(quote('1.0'))), ('config_fingerprints', listed('configs')), ('input_fingerprints', listed('inputs')), ('producer', text('producer')), ('runtime_fingerprint', maybe('r.entry', text('r.runtime'))), ('schema', number('schema_version'))])} as material from entries e join fingerprint_lists f on f.entry = e.entry left join (select entry, runtime from runtime_fingerprint_values where ok) r on r.entry = e.entry"


@relation("cache_key_material")
def artifact_identity(d):
    """Qualified digest of the material."""
    return f"select entry, concat('sha256:', {d.sha256('material')}) as identity from cache_key_material"


@relation("entries", public=False)
def runtimes(d):
    """What producers say of their runtime."""
    value = "case entry % 6 when 0 then '3.12' when 1 then '/usr/lib' when 2 then 'C:/x' when 3 then 'cpython' when 4 then '12' else 'arm64' end"
    return f"select entry, {value} as runtime from entries"


@relation("runtimes")
def runtime_fingerprint_values(d):
    """Whether values may stand in a runtime fingerprint: neither fractions nor physical paths."""
    return f"select entry, runtime, not {d.matches('runtime', '^-?[0-9]+[.][0-9]+$')} and not {d.matches('runtime', '^(/|[A-Za-z]:)')} as ok from runtimes"


@relation("provenance", "provenance_edges")
def provenance_id(d):
    """Digest of each record's canonical JSON without its id: role, method, evidence, sorted parents."""
    parents = "coalesce(parents, '')"
    return f"select p.doc, p.node, concat('sha256:', {d.sha256(json(d, [('acquisition_method', text('method')), ('evidence_digest', text('evidence')), ('parent_refs', f'''concat('[', {parents}, ']')'''), ('role', text('role')), ('schema_version', quote('1'))]))}) as provenance_id from provenance p left join (select doc, node, {d.agg_text('cast(parent as string)', ',', 'parent')} as parents from provenance_edges group by doc, node) e on e.doc = p.doc and e.node = p.node"


@relation("availability", "transcript_candidates")
def component_summary(d):
    """Digest of a source's components: availabilities, and the candidates' digests in order."""
    return f"select a.doc, concat('sha256:', {d.sha256(json(d, [('audio', text('audio')), ('candidates', '''concat('[', coalesce(c.digests, ''), ']')'''), ('metadata', text('metadata')), ('transcript', text('transcript'))]))}) as summary from availability a left join (select doc, {d.agg_text('digest', ',', 'digest', 'node')} as digests from transcript_candidates group by doc) c on c.doc = a.doc"


@relation("transcript_candidates", public=False)
def declared_formats(d):
    """Kinds and formats as they are declared: some in another case, some misspelt."""
    given = "case node % 4 when 0 then lower({0}) when 1 then concat({0}, 'X') else {0} end"
    return f"select doc, node, {given.format('kind')} as kind, {given.format('format')} as format from transcript_candidates"


@relation("declared_formats")
def enum_parse(d):
    """Kinds and formats that are known as they are spelt; anything else is refused."""
    known = lambda vs: "(" + ", ".join(map(quote, vs)) + ")"
    return f"select doc, node, case when kind in {known(KINDS)} then kind end as kind, case when format in {known(FORMATS)} then format end as format from declared_formats"


@relation("events", public=False)
def objects(d):
    """Objects as text: some with another field, one more, or a null."""
    given = """case event_id % 5 when 0 then replace(props, '"k"', '"other"') when 1 then replace(props, '}', ', "more": 1}') when 2 then '{"k": null}' else props end"""
    return f"select event_id, {given} as object from events"


@relation("objects", public=False)
def json_texts(d):
    """JSON texts in many shapes: compact, with a blank, keys out of order or twice (inside too), a
    fraction, a byte order mark, letters and marks apart, no JSON."""
    compact = "replace(object, ': ', ':')"
    shapes = [compact, "object", f"concat('{chr(0xFEFF)}', {compact})", """concat('{"a":', {c}, ',"b":[1,2]}')""", """concat('{"b":[1,2],"a":', {c}, '}')""", """'{"a":{"x":1,"x":1}}'""", """'{"a":1.5}'""", """'{"a":NaN}'""", f"""'{{"a":"e{chr(0x301)}"}}'""", """'{"a":'"""]
    cases = " ".join(f"when {i} then {s.replace('{c}', compact)}" for i, s in enumerate(shapes))
    return f"select event_id, case event_id % {len(shapes)} {cases} end as document from objects"


@relation("objects")
def exact_fields(d):
    """What is wrong with a flat object's fields: unknown ones, missing ones, nulls; the one
    expected is k."""
    keys = d.tokens("object", '"[^"]*" *:')
    others = d.keep(keys, f"not {d.matches('x', '^' + chr(34) + 'k' + chr(34))}")
    return f"""
    select event_id, case when {d.size(others)} > 0 then 'unknown' when {d.size(keys)} = 0 then 'missing' when {d.matches('object', ': *null')} then 'null' else 'exact' end as verdict, {d.any(keys, d.matches('x', '^' + chr(34) + 'k' + chr(34)))} as has_k from objects"""


@relation("inventory_classify", "effective_protection")
def descriptor_constraints(d):
    """Descriptors whose category, type and protection do not go together."""
    rules = [("unknown_protection", "artifact_type = 'unknown' and protection not in ('protected_unknown', 'protected_git_tracked')"), ("unknown_cacheable", "artifact_type = 'unknown' and cacheable"), ("no_cleanup", "category in ('source', 'config', 'output', 'validation', 'archive') and protection in ('eligible_cache', 'eligible_work')"), ("cache_category", "protection = 'eligible_cache' and category <> 'cache'"), ("work_category", "protection = 'eligible_work' and category <> 'work'"), ("missing_cacheable", "kind = 'missing' and cacheable")]
    return f"select c.file_id, concat_ws(',', {', '.join(f'''case when {c} then '{n}' end''' for n, c in rules)}) as violations from inventory_classify c join effective_protection p on p.file_id = c.file_id"


@relation("inventory_classify", "effective_protection")
def descriptor_identity(d):
    """What identifies a descriptor, as canonical JSON: all but where it lies now."""
    return f"select c.file_id, {json(d, [('artifact_type', text('artifact_type')), ('cacheable', 'lower(cast(cacheable as string))'), ('primary_category', text('category')), ('protection', text('protection')), ('group', maybe('group_id', text('group_id')))])} as identity from inventory_classify c join effective_protection p on p.file_id = c.file_id"


@relation("profiles", "natural_sort", public=False)
def manifests(d):
    """Manifests as users have them: some in another version, out of order, with a file twice or left out."""
    return """
    select user_id, file, place, version from (select p.user_id, case when p.user_id % 11 = 3 and place = 2 then 'again.jpg' when p.user_id % 11 = 3 and place = 3 then 'again.jpg' else file end as file, case when p.user_id % 7 = 2 then -place else place end as place, case when p.user_id % 13 = 4 then '0.9' else '1.0' end as version, p.user_id % 5 = 1 and place = 1 as gone
      from profiles p join natural_sort n on n.image_id = p.image_id) t where not gone"""


@relation("profiles", "natural_sort", "manifests")
def validate_manifest(d):
    """Whether each user's manifest has version 1.0 and every image once, in natural order."""
    return f"""
    select e.user_id, case when version <> '1.0' then 'schema' when given is null or distinct_files < n then 'not_exactly_once' when given <> expected then 'order_or_set' else 'valid' end as verdict from (select p.user_id, {d.agg_text('file', '|', 'place')} as expected from profiles p join natural_sort s on s.image_id = p.image_id group by p.user_id) e
    left join (select user_id, min(version) as version, count(*) as n, count(distinct file) as distinct_files, {d.agg_text('file', '|', 'place')} as given from manifests group by user_id) m on m.user_id = e.user_id"""


@relation("profiles", "manifests")
def missing_manifest_files(d):
    """Files that a manifest names and no image has."""
    return "select m.user_id, m.file from manifests m left join profiles p on p.user_id = m.user_id and p.file = m.file where p.file is null"


@relation("scenes", public=False)
def scene_rows(d):
    """Scenes as they are handed over, with ids and durations: some wrong."""
    given = "case when scene_index % 7 = 5 then '' when scene_index % 5 = 4 then 'scene_001' else concat('scene_', lpad(cast(scene_index + 1 as string), 3, '0')) end"
    return f"select project_id, scene_index, scene_start, scene_end, {given} as scene_id, scene_end - scene_start + case when scene_index % 5 = 3 then 0.01e0 else 0e0 end as duration from scenes"


@relation("scene_rows")
def validate_scene_timing(d):
    """What is wrong with each scene: its end, its duration (within 0.001), its id (empty or not
    its own alone)."""
    return """
    select project_id, scene_index, concat_ws(',', case when scene_end <= scene_start then 'end' end, case when abs((scene_end - scene_start) - duration) > 0.001e0 then 'duration' end, case when scene_id = '' then 'id_empty' when count(*) over (partition by project_id, scene_id) > 1 then 'id_repeated' end) as violations
    from scene_rows"""


@relation("motion_continuity", public=False)
def motion_plan_rows(d):
    """Motion plans as they are handed over, in their order: some scenes late, some without an
    id, some plans too short."""
    return """
    select project_id, scene_index as place, scene_index, case when project_id like '%1-1' and scene_index = 1 then null else concat('scene_', lpad(cast(scene_index + 1 as string), 3, '0')) end as scene_id,
      scene_start + case when project_id like '%3-2' and scene_index = 3 then 0.1e0 else 0e0 end as scene_start, scene_end, scene_end - scene_start as duration from motion_continuity where not (project_id like '%7-1' and scene_index = 2)"""


@relation("scene_rows", "motion_plan_rows")
def motion_alignment_check(d):
    """The first way in which a project's motion plan does not fit its scenes: their number, an
    id or index, a time (within 0.001). A scene with an empty id goes by its number."""
    named = "coalesce(nullif(s.scene_id, ''), concat('scene_', lpad(cast(s.scene_index + 1 as string), 3, '0')))"
    late = " or ".join(f"coalesce(abs(m.{c} - s.{c}) > 0.001e0, true)" for c in ("scene_start", "scene_end", "duration"))
    return f"""
    select n.project_id, case when coalesce(n_plans, 0) <> n then 'motion_plan_scene_count_mismatch' when bad is not null then concat('motion_plan_scene_', bad) end as issue
    from (select project_id, count(*) as n from scene_rows group by project_id) n left join (select project_id, count(*) as n_plans from motion_plan_rows group by project_id) p on p.project_id = n.project_id
    left join (select project_id, substring(min(verdict), 11) as bad from (select s.project_id, concat(lpad(cast(s.scene_index as string), 10, '0'), cast(s.scene_index as string), case when coalesce(m.scene_id <> {named} or m.scene_index <> s.scene_index, true) then '_identity_mismatch' when {late} then '_timing_mismatch' end) as verdict
      from scene_rows s join motion_plan_rows m on m.project_id = s.project_id and m.place = s.scene_index) v where verdict like '%mismatch' group by project_id) b on b.project_id = n.project_id"""


@relation("scenes", "match_terms", public=False)
def scene_fields(d):
    return f"select s.project_id, s.scene_index, voiceover_text, case when s.scene_index % 3 = 1 then 'Narration Aside' end as narration, terms from scenes s left join (select project_id, scene_index, {d.agg_text('term', ' ', 'term')} as terms from match_terms group by project_id, scene_index) t on t.project_id = s.project_id and t.scene_index = s.scene_index"


@relation("scene_fields", "caption_scene_interval_join", "captions")
def scene_text(d):
    """A scene's text for story analysis (voiceover, narration, match terms, captions) and for
    audio (all fields in lower case)."""
    return f"""
    select f.project_id, f.scene_index, concat_ws(' ', trim(voiceover_text), trim(narration), terms, said) as story_text, lower(concat_ws(' ', voiceover_text, coalesce(narration, ''), '', '', '')) as audio_text
    from scene_fields f left join (select c.project_id, scene_index, {d.agg_text('trim(caption_text)', ' ', 'caption_start', 'c.caption_id')} as said from caption_scene_interval_join j join captions c on c.project_id = j.project_id and c.caption_id = j.caption_id group by c.project_id, scene_index) s on s.project_id = f.project_id and s.scene_index = f.scene_index"""


@relation("scene_fields")
def flatten_text(d):
    """All text of a scene's fields, lists within them included, as one lower-case string."""
    return "select project_id, scene_index, lower(concat_ws(' ', voiceover_text, narration, terms)) as flat from scene_fields"


@relation("orders", public=False)
def settings(d):
    """Configurations as text, good and bad."""
    return "select o_orderkey, case o_orderkey % 7 when 0 then 'wide' else cast(round(o_totalprice / 400003e0, 6) as string) end as max_width, case o_orderkey % 5 when 0 then '9' when 1 then '2' when 2 then '' else '1' end as max_lines, cast(round(o_totalprice / 2000003e0, 6) as string) as safe_margin, case o_orderkey % 4 when 0 then '#ffd54a' when 1 then 'yellow' else '#00FF0' end as color, case o_orderkey % 6 when 0 then 'top' when 1 then 'left' else 'center' end as position, cast(round(o_totalprice / -9000e0, 2) as string) as loudness, cast(round(o_totalprice / 800003e0, 4) as string) as max_delta from orders"


@relation("settings")
def safe_config_numbers(d):
    """Configuration in range, else its default: a fallback never fails."""
    cast = "try_cast({} as double)"
    margin = f"coalesce(case when {cast.format('safe_margin')} between 0.02e0 and 0.20e0 then {four(cast.format('safe_margin'))} end, 0.08e0)"
    width = cast.format("max_width")
    return f"""
    select o_orderkey, margin, coalesce(case when {width} between 0.40e0 and 1e0 - 2e0 * margin then {four(width)} end, 0.82e0) as max_width, coalesce(case when try_cast(max_lines as int) between 1 and 4 then try_cast(max_lines as int) end, 2) as max_lines, case when {d.matches('upper(color)', '^#[0-9A-F]{6}$')} then upper(color) else '#FFD54A' end as color, case when position in ('top', 'center', 'bottom') then position else 'bottom' end as position
    from (select *, {margin} as margin from settings) t"""


@relation("settings")
def settings_parse(d):
    """The first setting that is refused: loudness, energy step, margin, width, lines, colour, position."""
    number = "try_cast({} as double)"
    steps = [("target_loudness_lufs", f"coalesce({number.format('loudness')} not between -40e0 and -5e0, true)"), ("max_energy_delta", f"coalesce({number.format('max_delta')} not between 0.01e0 and 0.45e0, true)"), ("safe_margin", f"coalesce({number.format('safe_margin')} not between 0.02e0 and 0.20e0, true)"), ("max_width", f"coalesce({number.format('max_width')} not between 0.40e0 and 1e0 - 2e0 * {number.format('safe_margin')}, true)"), ("max_lines", "coalesce(try_cast(max_lines as int) not between 1 and 4, true)"), ("highlight_color", f"not {d.matches('upper(color)', '^#[0-9A-F]{6}$')}"), ("default_position", "position not in ('top', 'center', 'bottom')")]
    return f"select o_orderkey, case {' '.join(f'''when {c} then '{n}' ''' for n, c in steps)} end as refused from settings"


@relation("scenes")
def caption_fallback(d):
    """The layout of each scene where planning failed: the default place, nothing highlighted."""
    return "select project_id, scene_index + 1 as scene, 'bottom' as position, 0.72e0 as vertical_anchor, 0.82e0 as max_width, 2 as max_lines, 0.08e0 as safe_margin, '' as highlight_words, '#FFD54A' as highlight_color, 0 as caption_count, false as face_avoidance_applied, 'Fail-closed fallback preserved existing placement.' as reason from scenes"


@relation("part", public=False)
def brand_names(d):
    """Names of brands, some in capitals."""
    return "select p_brand, case when p_size % 2 = 0 then p_name else upper(p_name) end as name from part"


@relation("brand_names")
def canonical_string_sort(d):
    """Names of a brand, unique, by lower case and then as they are."""
    return f"select p_brand, {d.agg_text('name', ',', 'lower(name)', 'name')} as names from (select distinct p_brand, name from brand_names) t group by p_brand"


@relation("payload_vs_manifest")
def distinct_warnings(d):
    """Kinds of findings of each entry, sorted."""
    return f"select entry, {d.agg_text('status', ',', 'status')} as warnings from (select distinct entry, status from payload_vs_manifest where status <> 'valid') t group by entry"


@relation("pages", public=False)
def escaped_refs(d):
    """References with escapes, good and bad."""
    shapes = ["url", "concat(url, '%20x')", "concat(url, '%2F')", "concat(url, '%zz')", "concat(url, '%')", "concat(url, '%C3%A4')", "concat(url, '%C3')", "concat(url, '%e2%82%ac%26')"]
    raw = "case page_id % 8 " + " ".join(f"when {i} then {s}" for i, s in enumerate(shapes)) + " end"
    return f"select page_id, {raw} as raw from pages"


@relation("escaped_refs")
def strict_percent_decode(d):
    """Whether a reference decodes (each % before two hex digits, none for a delimiter, bytes in
    UTF-8), and to what."""
    rest = d.replace("raw", "%[0-9A-Fa-f]{2}", "")
    one, two, three, four = "%[0-7][0-9a-f]", "%c[2-9a-f]%[89ab][0-9a-f]|%d[0-9a-f]%[89ab][0-9a-f]", "%e[0-9a-f](%[89ab][0-9a-f]){2}", "%f[0-4](%[89ab][0-9a-f]){3}"
    left = d.replace("lower(raw)", f"{one}|{two}|{three}|{four}", "")
    return f"""
    select page_id, verdict, case when verdict = 'valid' then {d.decoded('raw')} end as decoded
    from (select page_id, raw, case when contains({rest}, '%') then 'malformed_escape' when {d.matches('lower(raw)', '%(26|3d|25|23|3f|2f|5c)')} then 'structural_delimiter' when contains({left}, '%') then 'not_utf8' else 'valid' end as verdict from escaped_refs) t"""


@relation("scenes", public=False)
def audio_inputs(d):
    """Which optional inputs of audio planning each project has."""
    return "select project_id, count(*) % 3 <> 1 as captions, count(*) % 5 <> 2 as motion_plan, count(*) >= 3 as story_director_plan from scenes group by project_id"


@relation("audio_inputs", "motion_alignment_check")
def audio_input_warnings(d):
    """A project's warnings of its optional inputs, sorted, and the inputs that are missing; one
    that is there is compared with the scenes."""
    missing = [("captions", "captions_optional_input_missing"), ("motion_plan", "motion_plan_optional_input_missing"), ("story_director_plan", "story_director_optional_input_missing")]
    said = [f"case when not p.{m} then '{w}' end" for m, w in missing]
    said.insert(2, "case when p.motion_plan then issue end")
    return f"""
    select p.project_id, concat_ws(',', {', '.join(said)}) as warnings, concat_ws(',', {', '.join(f"case when not p.{m} then '{m}' end" for m, _ in missing)}) as missing_inputs
    from audio_inputs p left join motion_alignment_check m on m.project_id = p.project_id"""


@relation("visual_plan", "motion_guidance")
def guidance_compose(d):
    """Guidance beside the plan it comes from, for every scene."""
    return "select v.project_id, v.scene_index, v.visual_intent, v.narrative_intent, g.preferred_preset, g.intensity, g.hold_fraction, g.reason from visual_plan v join motion_guidance g on g.project_id = v.project_id and g.scene_index = v.scene_index"
