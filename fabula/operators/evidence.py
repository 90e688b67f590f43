"""Source evidence: candidates, provenance graphs, diagnostics and validators.

An order is one source's evidence; its lines are the components that were acquired. What is
wrong with some of them is decided by residues of the order's number, in private relations.
"""

from ..plans.relation import relation

#: Ends lines.
LF = "\n"

#: Fixed values, in the order of their declaration.
KINDS = ("MANUAL", "AUTOMATIC", "UNKNOWN")
FORMATS = ("PLAIN_TEXT", "WEBVTT", "SRT", "TTML", "JSON", "OTHER")
SUBJECTS = ("EVIDENCE", "METADATA", "PROVIDER_TRANSCRIPT_CANDIDATE", "AUDIO_EVIDENCE", "PROVENANCE")
SEVERITIES = ("NON_FATAL", "INFORMATIONAL")
CODES = ("COMPONENT_AVAILABLE", "COMPONENT_UNAVAILABLE", "COMPONENT_UNKNOWN", "COMPONENT_NOT_REQUESTED", "EVIDENCE_PARTIAL", "METADATA_INCOMPLETE", "TRANSCRIPT_CANDIDATE_INCOMPLETE", "AUDIO_PROPERTIES_INCOMPLETE", "PROVENANCE_REPLAYED")
#: Most records of a graph, most parents of a record and of the aggregate, depth.
RECORDS, PARENTS, AGGREGATE_PARENTS, DEPTH = 64, 16, 34, 32


def place(column: str, values) -> str:
    return f"case {column} " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(values)) + " end"


@relation("lineitem", public=False)
def lines(d):
    return "select l_orderkey as doc, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as node, l_partkey, l_quantity, l_returnflag, l_linestatus from lineitem"


@relation("lines", public=False)
def provenance(d):
    """Records of each graph: component records, and the aggregate (node 0; a second one somewhere)."""
    role = "case when node = 1 then 'METADATA' when node <= 4 then 'PROVIDER_TRANSCRIPT_CANDIDATE' else 'AUDIO' end"
    digest = d.sha256("concat(cast(doc as string), '/', cast(node as string), '/', cast(l_partkey as string))")
    return f"""
    select doc, node, {role} as role, case when l_returnflag = 'R' then 'REPLAY' else 'PROVIDER_API' end as method, concat('sha256:', {digest}) as evidence from lines
    union all select distinct doc, 0, 'AGGREGATE', 'LOCAL_FILE', concat('sha256:', {d.sha256("concat(cast(doc as string), '/aggregate')")}) from lines union all select distinct doc, 90, 'AGGREGATE', 'LOCAL_FILE', 'sha256:second' from lines where doc % 43 = 4"""


@relation("lines", public=False)
def provenance_edges(d):
    """Parents of each record: the aggregate has all components (in some graphs not the last),
    each component the one before; some lead nowhere, some back."""
    return """
    select l.doc, 0 as node, l.node as parent from lines l join (select doc, max(node) as last from lines group by doc) m on m.doc = l.doc where not (l.doc % 31 = 1 and l.node = last)
    union all select doc, node, node - 1 from lines where node > 1 union all select distinct doc, 1, 99 from lines where doc % 37 = 2
    union all select doc, 1, max(node) from lines where doc % 41 = 3 group by doc"""


@relation("provenance_edges", "provenance")
def provenance_parent_resolve(d):
    """References to parents that are not there."""
    return "select e.doc, e.node, e.parent from provenance_edges e left join provenance p on p.doc = e.doc and p.node = e.parent where p.node is null"


@relation("provenance", "provenance_edges", public=False)
def provenance_levels(d):
    """Records at each distance from the aggregate, as far as there can be levels: a record
    more than once where several ways lead to it. Spark walks a graph as one row, since its
    recursion is held to a number of rows; a graph has 64 records at most."""
    if d.spark:
        below = "array_distinct(flatten(transform(a.level, f -> transform(filter(edges, x -> x.node = f), x -> x.parent))))"
        step = f"named_struct('level', {below}, 'found', concat(a.found, transform({below}, n -> named_struct('node', n, 'depth', i))))"
        start = "named_struct('level', array(0), 'found', array(named_struct('node', 0, 'depth', 1)))"
        walk = f"aggregate(sequence(2, least({DEPTH}, records) + 1), {start}, (a, i) -> {step}, a -> a.found)"
        return f"select doc, f.node, f.depth from (select doc, explode({walk}) as f from (select p.doc, records, coalesce(edges, cast(array() as array<struct<node:int,parent:int>>)) as edges from (select doc, cast(count(*) as int) as records from provenance group by doc) p left join (select doc, collect_list(struct(cast(node as int) as node, cast(parent as int) as parent)) as edges from provenance_edges group by doc) e on e.doc = p.doc))"
    return f"with recursive walk as (select doc, 0 as node, 1 as depth, cast(count(*) as int) as records from provenance group by doc union select e.doc, e.parent, w.depth + 1, records from walk w join provenance_edges e on e.doc = w.doc and e.node = w.node where w.depth < least({DEPTH}, records) + 1) select doc, cast(node as int) as node, cast(depth as int) as depth from walk"


@relation("provenance", "provenance_edges", "provenance_parent_resolve", "provenance_levels")
def provenance_graph(d):
    """The first rule that each graph breaks: its size, parents that resolve, one aggregate as
    the only root, no cycle, at most 32 deep, everything reachable."""
    return f"""
    select p.doc, records, depth, case when records > {RECORDS} then 'too_many_records' when most > case when wide = 0 then {AGGREGATE_PARENTS} else {PARENTS} end then 'too_many_parents' when unresolved > 0 then 'parent_unresolved' when aggregates <> 1 then 'aggregate_not_unique' when roots <> 1 or root <> 0 then 'root_not_unique'
      when depth > {DEPTH} then 'too_deep' when depth > records then 'cyclic' when reached < records then 'unreachable' else 'valid' end as verdict
    from (select p.doc, cast(count(*) as int) as records, count_if(role = 'AGGREGATE') as aggregates, count_if(r.parent is null) as roots, max(case when r.parent is null then p.node end) as root from provenance p left join (select distinct doc, parent from provenance_edges) r on r.doc = p.doc and r.parent = p.node group by p.doc) p
    join (select l.doc, cast(max(depth) as int) as depth, count(distinct case when q.node is not null then l.node end) as reached from provenance_levels l left join provenance q on q.doc = l.doc and q.node = l.node group by l.doc) w on w.doc = p.doc
    left join (select doc, max(n) as most, min(node) as wide from (select doc, node, count(*) as n from provenance_edges group by doc, node) c group by doc) c on c.doc = p.doc left join (select doc, count(*) as unresolved from provenance_parent_resolve group by doc) u on u.doc = p.doc"""


@relation("lines", "provenance", public=False)
def evidence_parts(d):
    """Components that each source's evidence holds, with the record and digest they name."""
    return "select l.doc, l.node, p.role, case when l.doc % 47 = 5 and l.node = 2 then 77 else l.node end as reference, case when l.doc % 53 = 6 and l.node = 1 then 'sha256:other' else p.evidence end as digest, case when l.doc % 59 = 7 and l.node = 1 then 'AUDIO' else p.role end as claimed_role from lines l join provenance p on p.doc = l.doc and p.node = l.node"


@relation("evidence_parts", "provenance")
def component_provenance_match(d):
    """Components whose record has their role and digest, and whether all of a source's do."""
    return "select c.doc, c.node, p.node is not null as matched, bool_and(p.node is not null) over (partition by c.doc) as all_matched from evidence_parts c left join provenance p on p.doc = c.doc and p.node = c.reference and p.role = c.claimed_role and p.evidence = c.digest"


@relation("orders", "lines", public=False)
def availability(d):
    """What each source says of metadata, transcripts and audio, beside what is there."""
    said = lambda k: f"case when o_orderkey % 61 = {k} then 'UNKNOWN' when n > {k} then 'AVAILABLE' when o_orderkey % 3 = 0 then 'NOT_REQUESTED' else 'UNAVAILABLE' end"
    return f"select o_orderkey as doc, {said(0)} as metadata, {said(1)} as transcript, {said(4)} as audio, n > 0 as has_metadata, n > 1 as has_transcript, n > 4 as has_audio from (select o_orderkey, coalesce(n, 0) as n from orders left join (select doc, count(*) as n from lines group by doc) l on doc = o_orderkey) t"


@relation("availability")
def evidence_availability_matrix(d):
    """Evidence is available exactly where it is present; the first component that is not so."""
    return "select doc, case when (metadata = 'AVAILABLE') <> has_metadata then 'metadata' when (transcript = 'AVAILABLE') <> has_transcript then 'provider transcript candidates' when (audio = 'AVAILABLE') <> has_audio then 'audio evidence' end as violation, metadata, transcript, audio from availability"


@relation("lines", public=False)
def transcript_candidates(d):
    """Transcripts that providers offer: language, kind, id, format, digest and length; some
    offered twice, some with a length that differs."""
    return f"""
    select doc, node, case l_partkey % 4 when 0 then 'en' when 1 then 'sv' when 2 then 'de-AT' else 'zh-Hant-TW' end as language, case l_partkey % 3 when 0 then 'MANUAL' when 1 then 'AUTOMATIC' else 'UNKNOWN' end as kind, concat('c', cast(l_partkey % 11 as string)) as candidate_id,
      case l_partkey % 6 when 0 then 'PLAIN_TEXT' when 1 then 'WEBVTT' when 2 then 'SRT' when 3 then 'TTML' when 4 then 'JSON' else 'OTHER' end as format, concat('sha256:', {d.sha256('cast(l_partkey % 3 as string)')}) as digest, cast(1000 + l_partkey % 3 + case when l_partkey % 17 = 4 then 1 else 0 end as bigint) as bytes from lines"""


ORDER = f"language, {place('kind', KINDS)}, candidate_id, {place('format', FORMATS)}, digest, bytes, node"


@relation("transcript_candidates")
def candidate_total_order(d):
    """Candidates of each source by language, declared kind, id, declared format and digest."""
    return f"select doc, node, cast(row_number() over (partition by doc order by {ORDER}) as int) as place from transcript_candidates"


@relation("transcript_candidates")
def candidate_dedup(d):
    """The first candidate of each digest in canonical order; a source refuses all where one
    digest comes with different lengths."""
    return f"""
    select doc, node, digest, bytes, clash from (select doc, node, digest, bytes, row_number() over (partition by doc, digest order by {ORDER}) as r, max(clash) over (partition by doc) as clash
      from (select *, case when min(bytes) over (partition by doc, digest) <> max(bytes) over (partition by doc, digest) then 1 else 0 end as clash from transcript_candidates) c) t where r = 1"""


@relation("lines", "availability", "provenance", public=False)
def evidence_diagnostics(d):
    """Diagnostics about each source: subject, severity, code, ordinal and what they refer to."""
    subject = "case l_partkey % 5 when 0 then 'EVIDENCE' when 1 then 'METADATA' when 2 then 'PROVIDER_TRANSCRIPT_CANDIDATE' when 3 then 'AUDIO_EVIDENCE' else 'PROVENANCE' end"
    state = "case subject when 'METADATA' then metadata when 'PROVIDER_TRANSCRIPT_CANDIDATE' then transcript when 'AUDIO_EVIDENCE' then audio end"
    code = f"case when subject = 'EVIDENCE' then 'EVIDENCE_PARTIAL' when subject = 'PROVENANCE' then 'PROVENANCE_REPLAYED' when l_quantity > 40 then case subject when 'METADATA' then 'METADATA_INCOMPLETE' when 'AUDIO_EVIDENCE' then 'AUDIO_PROPERTIES_INCOMPLETE' else 'TRANSCRIPT_CANDIDATE_INCOMPLETE' end when l_quantity > 38 then 'COMPONENT_UNKNOWN' else concat('COMPONENT_', {state}) end"
    present = "case subject when 'METADATA' then has_metadata when 'PROVIDER_TRANSCRIPT_CANDIDATE' then has_transcript when 'AUDIO_EVIDENCE' then has_audio else true end"
    return f"""
    select doc, node, subject, case when l_linestatus = 'F' then 'NON_FATAL' else 'INFORMATIONAL' end as severity, {code} as code, cast(l_partkey % 7 as int) as ordinal, {state} as availability, metadata, transcript, audio, {present} as present, method, l_linestatus = 'F' as audio_incomplete,
      case when l_quantity < 3 then 'none' when l_quantity < 5 then 'elsewhere' when {present} then 'own' else 'none' end as refers_to
    from (select l.*, {subject} as subject, a.metadata, a.transcript, a.audio, has_metadata, has_transcript, has_audio, p.method from lines l join availability a on a.doc = l.doc join provenance p on p.doc = l.doc and p.node = l.node) t"""


@relation("evidence_diagnostics")
def diagnostic_ref_resolve(d):
    """Whether a diagnostic refers to what its subject allows: to the subject's own digest, or
    to nothing where the component is not there."""
    return "select doc, node, case when subject in ('EVIDENCE', 'PROVENANCE') then refers_to = 'own' when present then refers_to = 'own' else refers_to = 'none' end as valid from evidence_diagnostics"


@relation("evidence_diagnostics", "diagnostic_ref_resolve")
def diagnostics_matrix(d):
    """The first rule that a diagnostic breaks: its reference, a reference left out, the
    availability it claims, and what each code asks of subject, severity and component."""
    return """
    select e.doc, e.node, subject, code, case when not valid then 'incompatible_reference' when refers_to = 'none' and not (availability is not null and availability <> 'AVAILABLE' and code in ('COMPONENT_UNAVAILABLE', 'COMPONENT_UNKNOWN', 'COMPONENT_NOT_REQUESTED')) then 'reference_required'
      when code like 'COMPONENT~_%' escape '~' and (availability is null or code <> concat('COMPONENT_', availability)) then 'availability_differs'
      when code = 'EVIDENCE_PARTIAL' and (subject <> 'EVIDENCE' or (metadata = 'AVAILABLE' and transcript = 'AVAILABLE' and audio = 'AVAILABLE')) then 'evidence_not_partial'
      when code = 'METADATA_INCOMPLETE' and not (subject = 'METADATA' and present) then 'metadata_required' when code = 'TRANSCRIPT_CANDIDATE_INCOMPLETE' and not (subject = 'PROVIDER_TRANSCRIPT_CANDIDATE' and refers_to = 'own') then 'candidate_required'
      when code = 'AUDIO_PROPERTIES_INCOMPLETE' and not (subject = 'AUDIO_EVIDENCE' and present and audio_incomplete) then 'incomplete_audio_required'
      when code = 'PROVENANCE_REPLAYED' and not (subject = 'PROVENANCE' and severity = 'INFORMATIONAL' and method = 'REPLAY') then 'replay_required' else 'valid' end as verdict from evidence_diagnostics e join diagnostic_ref_resolve r on r.doc = e.doc and r.node = e.node"""


@relation("evidence_diagnostics")
def diagnostic_total_order(d):
    """Diagnostics of each source by ordinal, then subject, severity and code as declared, then reference."""
    return f"select doc, node, cast(row_number() over (partition by doc order by ordinal, {place('subject', SUBJECTS)}, {place('severity', SEVERITIES)}, {place('code', CODES)}, refers_to, node) as int) as place from evidence_diagnostics"


@relation("documents", public=False)
def transcript_segments(d):
    """Segments of transcripts: the lines of whole documents, with times; some in other orders,
    empty, with control characters, letters and marks apart, or of unknown language."""
    return f"""
    select doc_id, cast(ordinal as int) as ordinal, case when doc_id % 13 = 4 and ordinal = 2 then concat(line, chr(7)) when doc_id % 11 = 3 and ordinal = 1 then '' when doc_id % 7 = 2 then concat(line, chr(13), chr(10), 'more', chr(13)) when doc_id % 17 = 9 then concat(line, ' e\u0301') else line end as text,
      ordinal * 2000 + case when doc_id % 17 = 5 and ordinal = 3 then -5000 else 0 end as start_ms, ordinal * 2000 + case when doc_id % 19 = 6 then 2400 else 1900 end as end_ms, case when doc_id % 5 = 1 then null else lang end as language
    from {d.unnest_at(f"(select doc_id, lang, {d.split('coalesce(text, chr(32))', LF)} as ws from documents) s", 'ws', 'line', 'ordinal')}"""


@relation("transcript_segments", "transcript_text_normalization")
def transcript_diagnostics_matrix(d):
    """What a transcript's segments show: empty and refused ones, overlaps, times out of order,
    languages unknown."""
    flags = [("EMPTY_SEGMENT", "text = ''"), ("CONTROL_CHARACTER", "refused"), ("OVERLAPPING_SEGMENTS", "coalesce(start_ms < before_end, false) and start_ms >= before_start"), ("TIMING_OUT_OF_ORDER", "coalesce(start_ms < before_start, false)"), ("LANGUAGE_UNKNOWN", "language is null")]
    return f"""
    select doc_id, concat_ws(',', {', '.join(f"case when bool_or({c}) then '{n}' end" for n, c in flags)}) as codes, cast(count(*) as bigint) as segments
    from (select s.*, refused, lag(end_ms) over (partition by s.doc_id order by s.ordinal) as before_end, lag(start_ms) over (partition by s.doc_id order by s.ordinal) as before_start from transcript_segments s join transcript_text_normalization n on n.doc_id = s.doc_id and n.ordinal = s.ordinal) t group by doc_id"""


@relation("transcript_segments", public=False)
def document_blocks(d):
    """Blocks of documents as they are stored, one for each segment: some changed, missing or left over."""
    return """
    select doc_id, ordinal as block, md5(case when doc_id % 29 = 8 and ordinal = 1 then 'changed' else text end) as text_md5 from transcript_segments where not (doc_id % 23 = 7 and ordinal = 2)
    union all select doc_id, max(ordinal) + 1, md5('left over') from transcript_segments where doc_id % 31 = 11 group by doc_id"""


@relation("transcript_segments", "document_blocks")
def segment_block_projection(d):
    """Segments and blocks of a document side by side: each segment must be one block, in its
    place and with its text."""
    return """
    select coalesce(s.doc_id, b.doc_id) as doc_id, coalesce(s.ordinal, b.block) as place, case when b.block is null then 'block_missing' when s.ordinal is null then 'block_left_over' when b.text_md5 <> md5(s.text) then 'text_differs' else 'agrees' end as verdict
    from transcript_segments s full outer join document_blocks b on b.doc_id = s.doc_id and b.block = s.ordinal"""


@relation("documents", "transcript_segments")
def completeness_matrix(d):
    """Whether a document is complete: it has blocks, none is empty, times run on; partial or empty else."""
    return """
    select t.doc_id, case when n is null then 'EMPTY' when empties > 0 or backwards > 0 then 'PARTIAL' else 'COMPLETE' end as completeness, coalesce(n, 0) as blocks from (select doc_id from documents) t
    left join (select doc_id, count(*) as n, count_if(text = '') as empties, count_if(start_ms < before) as backwards from (select *, coalesce(lag(start_ms) over (partition by doc_id order by ordinal), start_ms) as before from transcript_segments) s group by doc_id) u on u.doc_id = t.doc_id"""


@relation("conversations", public=False)
def claims(d):
    """Claims from conversation turns: type, statement, and the sorted references behind each."""
    return f"""
    select conv_id, turn, case turn % 4 when 0 then 'FACT' when 1 then 'QUOTE' when 2 then 'INTERPRETATION' else 'OPINION' end as claim_type, text, role, case when turn % 4 = 1 and conv_id % 5 <> 0 then substring(text, 1, 30) end as excerpt, case when turn % 4 = 3 then role end as attributed_to,
      case when conv_id % 6 = 1 then 'b,a' when conv_id % 6 = 2 then 'a,a' when conv_id % 6 = 3 then '' else 'a,b,c' end as supports from conversations"""


@relation("claims")
def claim_type_matrix(d):
    """What each type of claim asks for: a quote its excerpt, an opinion whose it is, a fact support."""
    return "select conv_id, turn, claim_type, case when claim_type = 'QUOTE' and excerpt is null then 'excerpt_required' when claim_type <> 'QUOTE' and excerpt is not null then 'excerpt_forbidden' when claim_type = 'OPINION' and attributed_to is null then 'attribution_required' when claim_type = 'FACT' and supports = '' then 'support_required' else 'valid' end as verdict from claims"


@relation("claims")
def sorted_refs(d):
    """Whether a claim's references are sorted and none comes twice."""
    refs = d.split("supports", ",")
    ordered = "array_sort" if d.spark else "list_sort"
    return f"select conv_id, turn, supports, {refs} = {ordered}({d.distinct(refs)}) as canonical from claims"


@relation("claims")
def disagreement_matrix(d):
    """Conversations in which both sides claim something of one type, which a disagreement needs."""
    return "select conv_id, claim_type, cast(count(distinct role) as bigint) as sides, cast(count(*) as bigint) as claims from claims group by conv_id, claim_type having count(distinct role) > 1"


@relation("documents", public=False)
def scalars(d):
    """Values as they come in: versions, counts, names, digests, times and paths, good and bad."""
    return f"""
    select doc_id, case doc_id % 5 when 0 then '0' when 1 then '1' when 2 then '-1' when 3 then '1.5' else 'true' end as version, case doc_id % 4 when 0 then '' when 1 then concat(lang, '-', source) when 2 then concat('Ä', lang) else concat(' ', source) end as name,
      case doc_id % 3 when 0 then concat('sha256:', {d.sha256('source')}) when 1 then {d.sha256('source')} else upper({d.sha256('lang')}) end as digest, case doc_id % 6 when 0 then '2024-02-30T00:00:00Z' when 1 then '2024-02-28T23:59:59Z' when 2 then '2024-02-28 23:59:59' when 3 then '2023-12-31T24:00:00Z' when 4 then '1999-01-01T00:00:00Z' else '' end as stamp,
      case doc_id % 7 when 0 then '/abs/x' when 1 then 'a/b.txt' when 2 then 'a/../b' when 3 then concat('C:', chr(92), 'x') when 4 then 'a//b' when 5 then 'dir./x' else 'a/b/' end as path, case doc_id % 4 when 0 then 'model.size' when 1 then '.hidden' when 2 then 'a..b' else 'a/b' end as config from documents"""


def is_positive(d, column):
    return d.matches(column, "^[1-9][0-9]*$")


@relation("scalars")
def scalar_validators_si02(d):
    """Which values break the rules of source evidence: schema version 1, positive integers,
    ASCII and UTF-8 text of bounded bytes, qualified digests, component names."""
    rules = [("schema_version", "version <> '1'"), ("positive_int", f"not {is_positive(d, 'version')}"), ("uint", f"not {d.matches('version', '^(0|[1-9][0-9]*)$')}"), ("boolean", "version not in ('true', 'false')"), ("ascii_text", f"not {d.matches('name', '^[ -~]{1,64}$')}"), ("utf8_text", f"{d.bytes('name')} not between 1 and 64"),
             ("digest_sha256", f"not {d.matches('digest', '^sha256:[0-9a-f]{64}$')}"), ("logical_component_id", f"not {d.matches('name', '^[a-z0-9]([a-z0-9._-]*[a-z0-9])?$')}")]
    return f"select doc_id, concat_ws(',', {', '.join(f'''case when {c} then '{n}' end''' for n, c in rules)}) as violations from scalars"


TIMESTAMP = {True: "try_to_timestamp(stamp, 'yyyy-MM-dd''T''HH:mm:ss''Z''')", False: "try_strptime(stamp, '%Y-%m-%dT%H:%M:%SZ')"}


@relation("scalars")
def scalar_validators_storage(d):
    """Which values break the rules of storage: text without outer space, no physical path,
    versions, digests, whole-second UTC times of real days, portable manifest paths."""
    real = f"coalesce({TIMESTAMP[d.spark]} is not null, false)"
    rules = [("nonempty_text", "name = '' or name <> trim(name)"), ("physical_path", f"{d.matches('path', '^(/|[A-Za-z]:)')}"), ("positive_int", f"not {is_positive(d, 'version')}"), ("nonnegative_int", f"not {d.matches('version', '^(0|[1-9][0-9]*)$')}"), ("version", "version <> '1'"), ("digest", f"not {d.matches('digest', '^[0-9a-f]{64}$')}"),
             ("timestamp", f"not ({d.matches('stamp', '^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z$')} and {real})"), ("manifest_path", f"path = '' or contains(path, chr(92)) or {d.matches('path', '(^/|/$|//|[ .](/|$)|(^|/)[.]{1,2}(/|$))')}")]
    return f"select doc_id, concat_ws(',', {', '.join(f'''case when {c} then '{n}' end''' for n, c in rules)}) as violations from scalars"


@relation("scalars")
def scalar_validators_cache_keys(d):
    """Which values break the rules of cache keys: text that is no absolute path, logical names,
    dotted configuration paths, digests in either case, dotted contract versions."""
    rules = [("text", f"trim(path) = '' or {d.matches('path', '^(/|[A-Za-z]:)')}"), ("logical_name", f"{d.matches('path', '^(/|[A-Za-z]:)')} or {d.matches('path', '(//|/$|(^|/)[.]{2}(/|$))')}"), ("config_path", f"contains(config, chr(92)) or {d.matches('config', '(^[.]|[.]$|[.][.])')}"), ("sha256_digest", f"not {d.matches('lower(digest)', '^[0-9a-f]{64}$')}"), ("contract_version", f"not {d.matches('version', '^[0-9]+([.][0-9]+)*$')}")]
    return f"select doc_id, concat_ws(',', {', '.join(f'''case when {c} then '{n}' end''' for n, c in rules)}) as violations from scalars"


@relation("scalars")
def scalar_validators(d):
    """Which values break the rules of source identities: versions, text of 1 to 512 bytes, kinds."""
    rules = [("schema_version", "version <> '1'"), ("positive_int", f"not {is_positive(d, 'version')}"), ("ascii_text", f"not {d.matches('name', '^[ -~]+$')}"), ("utf8_text", f"{d.bytes('name')} not between 1 and 512"), ("source_kind", "name not in ('YOUTUBE_VIDEO', 'LOCAL_FILE')")]
    return f"select doc_id, concat_ws(',', {', '.join(f'''case when {c} then '{n}' end''' for n, c in rules)}) as violations from scalars"
