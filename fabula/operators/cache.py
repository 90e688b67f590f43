"""Decisions about cache entries: lookup, recovery, catalog and reconciliation.

What an inspection of a storage sees stands in observation tables (private relations): objects
of an entry's folder, what its documents say, payload files, locks, staging candidates and
catalog slots. Here they are derived from orders and line items, where the residue of an
entry's number decides what is wrong with it; `apply(name, spark, locks=df, ...)` takes
observations of one's own. The decisions are when-chains and rule tables over those columns.
"""

from ..plans.relation import relation, shorter

#: Lookup reasons in order of precedence, with status, diagnostic code and subject.
REASONS = [
    ("unsafe_path", "unsafe_path", "expectation_mismatch", "entry"),
    ("unsafe_object", "unsafe_path", "unsafe_object", "entry"),
    ("unsupported_entry_version", "unsupported_version", "version_unsupported", "entry"),
    ("unsupported_manifest_version", "unsupported_version", "version_unsupported", "entry"),
    ("unsupported_cache_key_version", "unsupported_version", "version_unsupported", "entry"),
    ("unsupported_runtime_fingerprint_version", "unsupported_version", "version_unsupported", "entry"),
    ("unsupported_lock_version", "unsupported_version", "version_unsupported", "lock"),
    ("incomplete_entry", "invalid_entry", "required_object_missing", "entry"),
    ("malformed_complete", "invalid_entry", "document_invalid", "entry"),
    ("malformed_metadata", "invalid_entry", "document_invalid", "entry"),
    ("malformed_manifest", "invalid_entry", "document_invalid", "entry"),
    ("malformed_lock", "invalid_entry", "document_invalid", "lock"),
    ("entry_identity_conflict", "invalid_entry", "identity_mismatch", "entry"),
    ("cache_key_conflict", "invalid_entry", "identity_mismatch", "entry"),
    ("lock_identity_conflict", "invalid_entry", "identity_mismatch", "lock"),
    ("lock_timestamp_invalid", "invalid_entry", "expectation_mismatch", "lock"),
    ("unexpected_top_level_object", "invalid_entry", "unexpected_object", "entry"),
    ("unexpected_payload_object", "invalid_entry", "unexpected_object", "entry"),
    ("unstable_snapshot", "invalid_entry", "unstable", "entry"),
    ("io_failure", "invalid_entry", "io_failure", "entry"),
    ("manifest_digest_mismatch", "integrity_failure", "digest_mismatch", "entry"),
    ("metadata_digest_mismatch", "integrity_failure", "digest_mismatch", "entry"),
    ("payload_missing", "integrity_failure", "payload_missing", "entry"),
    ("payload_size_mismatch", "integrity_failure", "payload_size_mismatch", "entry"),
    ("payload_digest_mismatch", "integrity_failure", "payload_digest_mismatch", "entry"),
    ("payload_hardlink_detected", "integrity_failure", "payload_hardlink", "entry"),
    ("namespace_producer_conflict", "producer_mismatch", "expectation_mismatch", "entry"),
    ("producer_mismatch", "producer_mismatch", "expectation_mismatch", "entry"),
    ("schema_mismatch", "schema_mismatch", "expectation_mismatch", "entry"),
    ("artifact_mismatch", "schema_mismatch", "expectation_mismatch", "entry"),
    ("runtime_fingerprint_mismatch", "runtime_fingerprint_mismatch", "expectation_mismatch", "entry"),
]
#: Most bytes of COMPLETE, metadata, manifest; payload records, path bytes, depth,
#: bytes of a file and in all; bytes of a catalog record.
DOCUMENT_BYTES = {"COMPLETE": 4096, "metadata.json": 262144, "manifest.json": 8388608}
PAYLOAD_LIMITS = {"records": 100000, "path_bytes": 1024, "depth": 64, "file_bytes": 1099511627776, "total_bytes": 17592186044416}
RECORD_BYTES = 65536
#: Budgets of a reconciliation run, and its page.
BUDGETS = {"identities": 1024, "lookups": 1024, "recoveries": 512, "mutations": 256}
PAGE = 256
#: Parameters of the observations: seconds that a heartbeat stays fresh, bytes of a lock,
#: diagnostics that are kept.
FRESH, LOCK_BYTES, DIAGNOSTICS = 1200, 4096, 3


def merged(*parts: tuple[str, dict[str, str]], key: str = "entry", by: dict[str, str] | None = None, named: str | None = None) -> str:
    """What several relations say of an entry, as one row each: one exchange and one hash
    aggregate in place of a join for each of them. parts: (relation, column -> type); a column
    is taken from where it is (by: with another aggregate than max), null where nothing is said.
    named: a name of its own for the key in the union, by which Spark sees that its parts are
    dealt out alike and need no exchange."""
    columns = {c: t for _, own in parts for c, t in own.items()}
    aggregates = [f"{(by or {}).get(c, 'max')}({c}) as {c}" for c in columns]
    inner, outer = (f"{key} as {named}", f"{named} as {key}") if named else (key, key)
    rows = " union all ".join(f"select {inner}, " + ", ".join(c if c in own else f"cast(null as {t}) as {c}" for c, t in columns.items()) + f" from {source}" for source, own in parts)
    return f"(select {outer}, {', '.join(aggregates)} from ({rows}) u group by {named or key})"


@relation(public=False)
def lookup_reasons(d):
    return d.values("r", ("reason", "precedence", "status", "code", "subject"), [(r, i, *rest) for i, (r, *rest) in enumerate(REASONS, 1)])


@relation("entries", public=False)
def entry_objects(d):
    """Objects in an entry's folder, `.` the folder itself; three of four entries have one."""
    names = d.strings(".", "COMPLETE", "manifest.json", "metadata.json", "notes.txt", "payload")
    return f"""
    select entry, name, case when k = 2 and name = 'payload' or k = 3 and name = '.' then 'symlink' when k = 5 and name = 'notes.txt' then 'pipe' when name in ('.', 'payload') then 'directory' else 'file' end as kind
    from {d.unnest(f"(select entry, entry % 101 as k, {names} as names from entries where entry % 4 <> 3) s", "names", "name")}
    where case name when 'notes.txt' then k in (4, 5, 6) when 'COMPLETE' then k <> 7 when 'manifest.json' then k not in (6, 8) else true end"""


@relation("entries", "entry_objects")
def entry_structure(d):
    """The folder of each entry: absent, unsafe before incomplete before unexpected before valid."""
    own = "name in ('COMPLETE', 'manifest.json', 'metadata.json', 'payload')"
    seen = f"(select entry, case when name = '.' then kind end as root, cast(case when {own} then 1 else 0 end as bigint) as n, name <> '.' and not {own} as others, name <> '.' and case when name = 'payload' then kind <> 'directory' when {own} then kind <> 'file' else kind not in ('file', 'directory') end as unsafe from entry_objects)"
    rows = merged(("entries", {}), (f"{seen} o", {"root": "string", "n": "bigint", "others": "boolean", "unsafe": "boolean"}), by={"n": "sum"})
    return f"select entry, case when root is null then 'entry_absent' when root <> 'directory' or unsafe then 'unsafe_object' when n < 4 then 'incomplete_entry' when others then 'unexpected_top_level_object' else 'valid' end as structure from {rows} t"


@relation("entries", public=False)
def entry_documents(d):
    """What a probe of each document reads: bytes, version numbers (null where there is no
    positive integer) and whether it parses strictly."""
    names = d.strings(*DOCUMENT_BYTES)
    most = " ".join(f"when '{n}' then {b}" for n, b in DOCUMENT_BYTES.items())
    return f"""
    select entry, document, ordinal, case document {most} end as most, case when k = 9 and ordinal = 1 then 5000 else 900 + k end as bytes,
      case when k = 10 and ordinal = 1 then 2 when k = 11 and ordinal = 2 then null else 1 end as entry_version, case when k = 12 then 3 when k = 17 then 2 else 1 end as key_version,
      case when k = 13 then 2 else 1 end as runtime_version, case when k = 15 then 2 when k = 18 then null else 1 end as manifest_version, not (k = 14 and ordinal = 2 or k = 16 and ordinal = 3 or k in (17, 19) and ordinal = 1) as parses
    from {d.unnest_at(f"(select entry, entry % 101 as k, {names} as names from entries where entry % 4 <> 3) s", "names", "document", "ordinal")}"""


@relation("entry_documents")
def document_versions(d):
    """Each document: too large or without versions is malformed, other versions are
    unsupported, then it must parse."""
    bad = "concat('malformed_', lower(replace(document, '.json', '')))"
    return f"""
    select entry, document, ordinal, case when bytes > most then {bad}
      when document <> 'manifest.json' and entry_version is null then {bad} when document <> 'manifest.json' and entry_version <> 1 then 'unsupported_entry_version'
      when document = 'metadata.json' and key_version is null then {bad} when document = 'metadata.json' and key_version <> 1 then 'unsupported_cache_key_version'
      when document = 'metadata.json' and runtime_version is null then {bad} when document = 'metadata.json' and runtime_version <> 1 then 'unsupported_runtime_fingerprint_version'
      when document = 'manifest.json' and manifest_version is null then {bad} when document = 'manifest.json' and manifest_version <> 1 then 'unsupported_manifest_version'
      when not parses then {bad} else 'valid' end as version_state from entry_documents"""


@relation("entries", "declared", public=False)
def entry_metadata(d):
    """Identities, digests and expectations of an entry as its documents have them, beside
    what they should be."""
    other = lambda k, x: f"case when k = {k} then concat('x', {x}) else {x} end"
    listed = "(select entry, cast(1 as bigint) as files, bytes from declared) f"
    rows = merged(("entries", {"digest": "string", "domain": "string", "producer": "string", "schema_version": "int", "at_s": "double"}), (listed, {"files": "bigint", "bytes": "bigint"}), by={"files": "sum", "bytes": "sum"})
    return f"""
    select entry, at_s, digest as want_digest, {other(20, 'digest')} as digest, {other(21, 'digest')} as rebuilt_digest, {other(22, 'digest')} as marker_digest, domain as want_domain, {other(23, 'domain')} as domain,
      concat('key:', digest) as want_key, {other(24, "concat('key:', digest)")} as cache_key, sha_m as manifest_sha, {other(25, 'sha_m')} as metadata_manifest_sha, {other(26, 'sha_m')} as marker_manifest_sha, sha_d as metadata_sha, {other(27, 'sha_d')} as marker_metadata_sha,
      files + case when k = 28 then 1 else 0 end as files, bytes + case when k = 29 then 1 else 0 end as bytes, files as manifest_files, bytes as manifest_bytes,
      {other(30, 'producer')} as namespace_producer, producer, schema_version + case when k = 31 then 1 else 0 end as namespace_schema, schema_version as producer_schema,
      {other(32, 'producer')} as want_producer, schema_version + case when k = 33 then 1 else 0 end as want_schema, 'plan' as artifact_kind, 1 as artifact_version, concat('id-', cast(entry as string)) as logical_id,
      case when k = 34 then 'plan' when k = 36 then 'image' when entry % 2 = 0 then 'plan' end as want_kind, 1 as want_artifact_version, case when k = 34 then 'id-0' end as want_logical_id, concat('rt-', cast(entry % 7 as string)) as runtime, {other(35, "concat('rt-', cast(entry % 7 as string))")} as want_runtime
    from (select *, entry % 101 as k, {d.sha256("concat('m', digest)")} as sha_m, {d.sha256("concat('d', digest)")} as sha_d from (select entry, digest, domain, producer, schema_version, at_s, coalesce(files, 0) as files, coalesce(bytes, 0) as bytes from {rows} r) e) t"""


@relation("entry_metadata")
def document_integrity(d):
    """The first check of an entry's documents that fails, in order; none of the artifact is
    asked where nothing is expected of it."""
    return """
    select entry, case when digest <> rebuilt_digest or digest <> want_digest or domain <> want_domain or marker_digest <> want_digest then 'entry_identity_conflict'
      when cache_key <> want_key then 'cache_key_conflict' when metadata_manifest_sha <> manifest_sha or marker_manifest_sha <> manifest_sha then 'manifest_digest_mismatch'
      when marker_metadata_sha <> metadata_sha then 'metadata_digest_mismatch' when files <> manifest_files or bytes <> manifest_bytes then 'metadata_manifest_summary_mismatch'
      when namespace_producer <> producer or namespace_schema <> producer_schema then 'namespace_producer_conflict' when producer <> want_producer then 'producer_mismatch' when producer_schema <> want_schema then 'schema_mismatch'
      when want_kind is not null and (artifact_kind <> want_kind or artifact_version <> want_artifact_version or coalesce(logical_id <> want_logical_id, false)) then 'artifact_mismatch'
      when runtime <> want_runtime then 'runtime_fingerprint_mismatch' else 'valid' end as outcome from entry_metadata"""


@relation("entries", "declared", "observed", public=False)
def payload_findings(d):
    """Declared and observed files of each entry in one row. The first bad record, by path,
    has its finding behind its path. Producer p may publish nothing at all."""
    sides = """(select entry, path, bytes as m_bytes, content as m_content, cast(null as bigint) as bytes, cast(null as bigint) as content, cast(null as string) as kind, cast(null as int) as links, cast(null as boolean) as stable from declared
      union all select entry, path, null, null, bytes, content, kind, links, stable from observed) b"""
    files = f"(select entry, path, max(m_bytes) as m_bytes, max(m_content) as m_content, max(bytes) as bytes, max(content) as content, max(kind) as kind, max(links) as links, bool_and(stable) as stable from {sides} group by entry, path) f"
    found = f"""(select entry, cast(case when m_bytes is not null then 1 else 0 end as bigint) as records, kind not in ('file', 'directory') as unsafe, m_bytes is null as unexpected, kind is null as missing, case when m_bytes is not null then length(path) > {PAYLOAD_LIMITS['path_bytes']} or {d.size(d.split('path', '/'))} > {PAYLOAD_LIMITS['depth']} or m_bytes > {PAYLOAD_LIMITS['file_bytes']} end as large, m_bytes as total,
        case when m_bytes is null or kind is null then null when links > 1 then concat(path, '|payload_hardlink_detected') when bytes <> m_bytes then concat(path, '|payload_size_mismatch') when not stable then concat(path, '|payload_read_unstable') when content <> m_content then concat(path, '|payload_digest_mismatch') end as bad, case when bytes = m_bytes and content = m_content then m_bytes else 0 end as hashed from {files}) g"""
    own = "(select entry, producer = 'p' as empty_allowed from entries) e"
    rows = merged((own, {"empty_allowed": "boolean"}), (found, {"records": "bigint", "unsafe": "boolean", "unexpected": "boolean", "missing": "boolean", "large": "boolean", "total": "bigint", "bad": "string", "hashed": "bigint"}), by={"records": "sum", "total": "sum", "bad": "min", "hashed": "sum"})
    return f"select entry, empty_allowed, cast(coalesce(records, 0) as bigint) as records, coalesce(records > {PAYLOAD_LIMITS['records']} or large or total > {PAYLOAD_LIMITS['total_bytes']}, false) as too_much, coalesce(unsafe, false) as unsafe, coalesce(unexpected, false) as unexpected, coalesce(missing, false) as missing, bad, cast(coalesce(hashed, 0) as bigint) as hashed from {rows} t"


@relation("payload_findings")
def payload_validate(d):
    """The first finding about an entry's payload: cardinality, limits, unsafe, unexpected and
    missing files, then records in order (links, size, stability, digest)."""
    return f"""
    select entry, case when records = 0 and not empty_allowed then 'payload_cardinality_invalid' when too_much then 'payload_policy_limit_exceeded' when unsafe then 'unsafe_object'
      when unexpected then 'unexpected_payload_object' when missing then 'payload_missing' when bad is not null then {d.extract('bad', '[|]([a-z_]+)$', 1)} else 'valid' end as outcome,
      bad is null and not (unsafe or unexpected or missing or too_much) as fully_hashed, hashed as bytes_valid from payload_findings"""


@relation("entries", public=False)
def locks(d):
    """Lock files: kind, bytes, whether reads work and stay stable, what is in them, the clock."""
    return f"""
    select entry, case when j = 1 then 'symlink' else 'file' end as kind, case when j = 2 then {LOCK_BYTES} + 1 else 300 end as bytes, j <> 3 as stable, j <> 4 as readable, case when j = 5 then 2 when j = 10 then null else 1 end as lock_version, j <> 6 as parses,
      digest as want_digest, case when j = 7 then concat('x', digest) else digest end as digest, at_s + 60e0 * (entry % 45) + case when j = 8 then 1e0 else -30e0 end as acquired, at_s + 60e0 * (entry % 45) + case when j = 9 then 4000e0 else 0e0 end as heartbeat, at_s + 3000e0 + case when j = 11 then 0.5e0 else 0e0 end as clock
    from (select *, entry % 103 as j from entries where entry % 5 > 1) t"""


@relation("entries", "locks")
def lock_observation(d):
    """absent, what is wrong with a lock, else active or stale by its heartbeat's age in whole seconds."""
    state = f"""case when kind <> 'file' then 'unsafe_object' when not readable then 'io_failure' when bytes > {LOCK_BYTES} then 'malformed_lock' when not stable then 'unstable_snapshot'
      when lock_version is null then 'malformed_lock' when lock_version <> 1 then 'unsupported_lock_version' when not parses then 'malformed_lock' when digest <> want_digest then 'lock_identity_conflict'
      when acquired > heartbeat or acquired > clock or heartbeat > clock then 'lock_timestamp_invalid' when floor(clock - heartbeat) <= {FRESH} then 'active' else 'stale' end"""
    rows = merged(("entries", {}), (f"(select entry, {state} as lock_state from locks) l", {"lock_state": "string"}))
    return f"select entry, coalesce(lock_state, 'absent') as lock_state from {rows} t"


@relation("locks")
def clock_validate(d):
    """Whether the clock of each observation is in whole seconds of UTC and in range."""
    return "select entry, clock = floor(clock) and clock >= 0e0 and clock < 253402300800e0 as ok from locks"


@relation("entries", public=False)
def entry_reads(d):
    """At which step reads of an entry fail, and whether entry and root stay as they were."""
    return "select entry, case entry % 101 when 41 then 'structure' when 42 then 'documents' when 43 then 'payload' end as failed_at, entry % 101 <> 40 as stable, entry % 211 <> 5 as root_stable from entries"


@relation("entry_structure", "document_versions", "document_integrity", "payload_validate", "lock_observation", "entry_reads", "lookup_reasons", public=False, dealt=True)
def lookups(d):
    """The reason that ends each lookup, with and without a look at locks (null for a hit, a
    miss or an entry in progress), and the level that was verified."""
    common = """when failed_at = 'structure' then 'io_failure' when structure not in ('entry_absent', 'valid') then structure when structure = 'entry_absent' then {absent} when failed_at = 'documents' then 'io_failure' when documents is not null then substring(documents, 2)
      when outcome = 'metadata_manifest_summary_mismatch' then 'malformed_metadata' when outcome <> 'valid' then outcome when failed_at = 'payload' then 'io_failure'
      when payload = 'payload_cardinality_invalid' then 'unexpected_payload_object' when payload = 'payload_policy_limit_exceeded' then 'malformed_manifest' when payload = 'payload_read_unstable' then 'unstable_snapshot' when payload <> 'valid' then payload
      when not stable then 'unstable_snapshot'"""
    late = "not root_stable and coalesce(r{0}.precedence, 99) > 19"
    first = "(select entry, case when version_state <> 'valid' then concat(cast(ordinal as string), version_state) end as documents from document_versions) v"
    rows = merged(("entry_structure", {"structure": "string"}), (first, {"documents": "string"}), ("document_integrity", {"outcome": "string"}), ("(select entry, outcome as payload from payload_validate) p", {"payload": "string"}), ("lock_observation", {"lock_state": "string"}), ("entry_reads", {"failed_at": "string", "stable": "boolean", "root_stable": "boolean"}), by={"documents": "min"})
    level = """case when failed_at = 'structure' or structure <> 'valid' then 0 when failed_at = 'documents' or documents is not null then 1 when outcome <> 'valid' then 2 when failed_at = 'payload' or payload <> 'valid' or not stable then 3 else 4 end"""
    return f"""
    select entry, structure, lock_state, case when {late.format(1)} then 'unstable_snapshot' else t.reason end as reason, case when {late.format(2)} then 'unstable_snapshot' else t.final_reason end as final_reason,
      case when {late.format(1)} then least(3, level) else level end as level
    from (select entry, structure, lock_state, root_stable, {level} as level, case {common.format(absent="case when lock_state not in ('absent', 'active', 'stale') then lock_state end")} end as reason, case {common.format(absent='null')} end as final_reason from {rows} s) t
    left join lookup_reasons r1 on r1.reason = t.reason left join lookup_reasons r2 on r2.reason = t.final_reason"""


@relation("lookups", "lookup_reasons")
def lookup_status(d):
    """The status of each lookup, its reason and how far the entry was verified."""
    levels = "case level when 0 then 'none' when 1 then 'structure' when 2 then 'canonical_documents' when 3 then 'document_integrity' else 'full_payload_sha256' end"
    return f"select entry, case when l.reason is not null then r.status when structure <> 'entry_absent' then 'hit' when lock_state = 'active' then 'locked_or_in_progress' else 'miss' end as status, l.reason, {levels} as level from lookups l left join lookup_reasons r on r.reason = l.reason"


@relation("lookups", "lookup_reasons")
def final_only_lookup(d):
    """Lookup without locks: an absent entry is a miss, whatever its lock."""
    return "select entry, case when final_reason is not null then r.status when structure <> 'entry_absent' then 'hit' else 'miss' end as status, final_reason as reason from lookups l left join lookup_reasons r on r.reason = final_reason"


@relation("lookups", "lookup_reasons")
def reason_to_diagnostic(d):
    """Diagnostic code and subject of each entry that was refused, and the reason's precedence."""
    return "select entry, l.reason, code, subject, precedence from lookups l join lookup_reasons r on r.reason = l.reason"


@relation("final_only_lookup")
def final_observe(d):
    """The final component of each entry's recovery, with its reason."""
    return """
    select entry, case when status = 'miss' then 'final_absent' when status = 'hit' then 'final_valid' when status = 'unsupported_version' then 'final_unsupported' when status = 'unsafe_path' then 'final_unsafe'
      when reason = 'unstable_snapshot' then 'final_unstable' else 'final_invalid' end as final_state, case when status not in ('miss', 'hit') then reason end as reason from final_only_lookup"""


@relation("lock_observation")
def lock_observe(d):
    """The lock component of each entry's recovery, with its reason."""
    return """
    select entry, case lock_state when 'unsafe_object' then 'lock_unsafe' when 'unstable_snapshot' then 'lock_unstable' when 'malformed_lock' then 'lock_malformed' when 'unsupported_lock_version' then 'lock_unsupported'
      when 'lock_identity_conflict' then lock_state when 'lock_timestamp_invalid' then lock_state else concat('lock_', lock_state) end as lock_state, case when lock_state not in ('absent', 'active', 'stale') then lock_state end as reason from lock_observation"""


@relation("entries", public=False)
def staging_candidates(d):
    """Staging folders of an entry, up to two: kind, objects present, what their documents,
    integrity and payload came to, and whether reads work and stay stable."""
    return f"""
    select entry, candidate, case when j = 1 then 'symlink' else 'directory' end as kind, j <> 2 as readable, j = 3 as unsafe, j = 4 as unexpected,
      g < 3 or j in (4, 5) as has_complete, g <> 4 or j in (6, 7) as has_metadata, g < 4 as has_manifest, true as has_payload,
      case when j = 6 then 'unsupported_entry_version' when j = 7 then 'malformed_metadata' else 'valid' end as metadata, case when j = 8 then 'unsupported_manifest_version' when j = 9 then 'malformed_manifest' else 'valid' end as manifest,
      case when j = 10 then 'cache_key_conflict' else 'valid' end as integrity, case j when 11 then 'unsafe_object' when 12 then 'payload_read_unstable' when 13 then 'payload_missing' else 'valid' end as payload, j <> 14 as stable
    from (select entry, nth - 1 as candidate, (entry + 17 * (nth - 1)) % 83 as j, (entry + nth - 1) % 5 as g from {d.unnest_at(f"(select entry, case when entry % 6 < 2 then {d.strings('0', '1')} else {d.strings('0')} end as cs from entries where entry % 6 < 4) s", 'cs', 'c', 'nth')}) t"""


MISSING = "not (has_complete and has_metadata and has_manifest and has_payload)"
PARTIAL = """case when unexpected or has_complete then 'staging_invalid' when not stable then 'staging_unstable' when has_metadata and metadata like 'unsupported%' then 'staging_unsupported' when has_metadata and metadata <> 'valid' then 'staging_invalid'
  when has_manifest and manifest like 'unsupported%' then 'staging_unsupported' when has_manifest and manifest <> 'valid' then 'staging_invalid' else 'staging_incomplete' end"""


@relation("staging_candidates")
def incomplete_staging_state(d):
    """Partial staging folders: invalid with a marker or unexpected objects, else as their documents are."""
    return f"select entry, candidate, {PARTIAL} as state from staging_candidates where kind = 'directory' and readable and not unsafe and {MISSING}"


@relation("staging_candidates", "entries")
def staging_observe(d):
    """Each staging candidate's state and reason; an entry without any has one absent row."""
    state = f"""case when not readable then 'staging_io_failure' when kind <> 'directory' or unsafe then 'staging_unsafe' when {MISSING} then {PARTIAL} when unexpected then 'staging_invalid'
      when metadata like 'unsupported%' or (metadata = 'valid' and manifest like 'unsupported%') then 'staging_unsupported' when metadata <> 'valid' or manifest <> 'valid' or integrity <> 'valid' then 'staging_invalid'
      when payload = 'unsafe_object' then 'staging_unsafe' when payload = 'payload_read_unstable' then 'staging_unstable' when payload <> 'valid' then 'staging_invalid' when stable then 'staging_complete_valid' else 'staging_unstable' end"""
    reason = "case state when 'staging_invalid' then 'invalid_staging' when 'staging_unsupported' then 'unsupported_staging' when 'staging_unsafe' then 'unsafe_staging_path' when 'staging_unstable' then 'unstable_staging' when 'staging_io_failure' then 'staging_io_failure' end"
    none = merged(("entries", {}), ("staging_candidates", {"candidate": "int"}), by={"candidate": "count"})
    return f"select entry, candidate, state, {reason} as reason from (select entry, candidate, {state} as state from staging_candidates union all select entry, 0, 'staging_absent' from {none} n where candidate = 0) t"


#: Failure families of the recovery precedence.
FAMILY = """case when {0} like '%_unsafe' then 0 when {0} like '%_unsupported' then 1 when {0} like '%_unstable' then 2
  when {0} in ('final_invalid', 'staging_invalid', 'staging_io_failure', 'lock_malformed', 'lock_io_failure', 'lock_identity_conflict', 'lock_timestamp_invalid') then 3 else 4 end"""


@relation("final_observe", "staging_observe", "lock_observe", public=False)
def recovery_findings(d):
    """All components of an entry as rows: family, subject (0 final, 1 staging, 2 lock), candidate."""
    return f"""
    select entry, {FAMILY.format('state')} as family, subject, candidate, state, reason from (select entry, 0 as subject, 0 as candidate, final_state as state, reason from final_observe
      union all select entry, 1, candidate, state, reason from staging_observe union all select entry, 2, 0, lock_state, reason from lock_observe) t"""


def lifecycle(findings: str, key: str = "entry") -> str:
    """The lifecycle of each entry, `key` in `findings`."""
    worst = "min(case when family < 4 then concat(cast(family as string), cast(subject as string), lpad(cast(candidate as string), 4, '0'), reason) end)"
    locked = "lock_state <> 'lock_absent'"
    return f"""
    select {key if key == 'entry' else f'{key} as entry'}, final_state, staging_count, lock_state, case substring(worst, 1, 1) when '0' then 'recovery_unsafe' when '1' then 'recovery_unsupported' when '2' then 'recovery_unstable' when '3' then 'recovery_invalid' else
      case when final_state = 'final_valid' and staging = 'absent' then case when {locked} then 'final_published_lock_retained' else 'final_published' end
           when final_state = 'final_valid' then case when {locked} then 'final_published_with_superseded_staging_and_lock' else 'final_published_with_superseded_staging' end
           when staging = 'absent' then case lock_state when 'lock_absent' then 'empty' when 'lock_active' then 'active_lock_without_entry' else 'stale_lock_without_entry' end
           when staging = 'complete' then case lock_state when 'lock_absent' then 'unpublished_complete_staging' when 'lock_active' then 'complete_staging_with_active_lock' else 'complete_staging_with_stale_lock' end
           else case lock_state when 'lock_absent' then 'incomplete_staging' when 'lock_active' then 'incomplete_staging_with_active_lock' else 'incomplete_staging_with_stale_lock' end end end as status, substring(worst, 7) as reason
    from (select {key}, {worst} as worst, max(case when subject = 0 then state end) as final_state, max(case when subject = 2 then state end) as lock_state, cast(count_if(subject = 1 and state <> 'staging_absent') as int) as staging_count,
      case when bool_and(subject <> 1 or state = 'staging_absent') then 'absent' when bool_or(state = 'staging_incomplete') then 'incomplete' else 'complete' end as staging from {findings} group by {key}) t"""


@relation("recovery_findings")
def recovery_compose(d):
    """Lifecycle of an entry: the first failure by family, subject and candidate, else by the
    final, staging and lock states."""
    return lifecycle("recovery_findings")


@shorter("recovery_compose", "final_observe", "staging_observe", "lock_observe")
def _(d):
    """The components by a name of the entry's own, as in merged()."""
    parts = [("final_observe", 0, "0", "final_state"), ("staging_observe", 1, "candidate", "state"), ("lock_observe", 2, "0", "lock_state")]
    rows = " union all ".join(f"select entry as whose, {FAMILY.format(s)} as family, {n} as subject, {c} as candidate, {s} as state, reason from {source}" for source, n, c, s in parts)
    return lifecycle(f"({rows}) f", "whose")


@relation("recovery_findings")
def recovery_diag_rank(d):
    """Diagnostics of each entry in order of family, subject and candidate."""
    subject = "case subject when 0 then 'final' when 1 then 'staging' else 'lock' end"
    return f"select entry, {subject} as subject, candidate, concat({subject}, '.', coalesce(reason, state)) as code, cast(row_number() over (partition by entry order by family, subject, candidate) as int) as place from recovery_findings"


@relation("recovery_diag_rank")
def diagnostics_truncate(d):
    """At most so many diagnostics of each entry: where there are more, the last one says so."""
    cut = f"n > {DIAGNOSTICS} and place = {DIAGNOSTICS}"
    return f"""
    select entry, place, case when {cut} then 'root' else subject end as subject, case when {cut} then 'DIAGNOSTICS_TRUNCATED' else code end as code
    from (select *, count(*) over (partition by entry) as n from recovery_diag_rank) t where place <= {DIAGNOSTICS}"""


#: What a recovery's summary is the digest of.
RECOVERED = "concat_ws('|', status, coalesce(reason, ''), cast(staging_count as string), final_state, lock_state)"


@relation("recovery_compose")
def recovery_summary_projection(d):
    """Status, reason, number of staging candidates and states, and the summary's digest."""
    return f"select entry, status, reason, staging_count, final_state, lock_state, {d.sha256(RECOVERED)} as summary from recovery_compose"


@relation("recovery_compose")
def inspect_recovery(d):
    """Whether each entry needs attention: nothing to do, safe to wait for, or to be looked at."""
    return "select entry, status, reason, case when status in ('empty', 'final_published') then 'settled' when status like '%active_lock%' then 'in_progress' when status like 'recovery_%' then 'failed' else 'residue' end as outlook from recovery_compose"


#: What a final summary is made of, and its columns.
SUMMED = {"producer": "string", "producer_schema": "int", "artifact_kind": "string", "artifact_version": "int", "runtime": "string", "at_s": "double", "manifest_sha": "string", "files": "bigint", "bytes": "bigint"}


def final_columns(d) -> dict[str, str]:
    return {"provenance": "'step5b_hit'", "contract_version": "1", "producer_id": "m.producer", "producer_version": "'1.0'", "producer_schema_version": "producer_schema", "artifact_kind": "m.artifact_kind", "artifact_contract_version": "artifact_version",
            "runtime_digest": f"concat('sha256:', {d.sha256('runtime')})", "created_at_s": "at_s", "manifest_digest": "concat('sha256:', manifest_sha)", "payload_files": "files", "payload_bytes": "m.bytes"}


def final_digest(d) -> str:
    return d.sha256("concat_ws('|', " + ", ".join(f"cast({c} as string)" for c in final_columns(d) if c != "created_at_s") + ")")


@relation("lookup_status", "entry_metadata")
def final_summary_projection(d):
    """What a catalog keeps of a hit: thirteen columns with the digest of the runtime
    fingerprint, and the summary's digest."""
    cols = final_columns(d)
    rows = merged(("lookup_status", {"status": "string"}), ("entry_metadata", SUMMED))
    return f"""
    select entry, {', '.join(cols)}, {final_digest(d)} as summary
    from (select entry, {', '.join(f'{x} as {c}' for c, x in cols.items())} from {rows} m where status = 'hit') t"""


#: What is found in a catalog slot, from an entry's summaries (j: its number's residue).
SLOT = """case when j = 1 then 'symlink' else 'file' end as kind, case when j = 2 then 70000 else 900 end as bytes, j <> 3 as stable, j <> 4 as readable, case j when 5 then 1 when 6 then 3 end as missing_depth, case when j = 7 then 2 else 1 end as version,
      j <> 8 as parses, j <> 9 as same_identity, entry % 19 = 0 as tombstone, cast(entry % 5 + 1 as bigint) as record_revision,
      case when entry % 19 = 0 or entry % 3 = 0 then null when entry % 11 = 0 then 'older' else final end as last_final, case when entry % 19 = 0 or entry % 4 = 1 then null when entry % 13 = 0 then 'older' else recovery end as last_recovery"""


@relation("entries", "final_summary_projection", "recovery_summary_projection", public=False)
def catalog(d):
    """Catalog slots of five of seven entries: kind, bytes, how reads went, at what depth the
    path ends (null: it is there), versions, identity, revision, tombstones and last summaries."""
    rows = merged(("(select entry, true as slot from entries where entry % 7 < 5) e", {"slot": "boolean"}), ("(select entry, summary as final from final_summary_projection) f", {"final": "string"}), ("(select entry, summary as recovery from recovery_summary_projection) r", {"recovery": "string"}))
    return f"""
    select entry, {SLOT}
    from (select *, entry % 61 as j from {rows} r where slot) t"""


CHAIN = "case when missing_depth is null then 'present' when missing_depth <= 1 then 'catalog_unavailable' else 'record_absent' end"


STATUS = f"""case when {CHAIN} <> 'present' then {CHAIN} when kind <> 'file' then 'catalog_unsafe' when not readable then 'catalog_io_failure' when not stable then 'catalog_unstable' when bytes > {RECORD_BYTES} then 'catalog_corrupt'
      when version <> 1 then 'catalog_unsupported' when not parses or not same_identity then 'catalog_corrupt' when tombstone then 'record_absent' else 'record_found' end"""
FOUND = "status, case when status = 'record_absent' and tombstone and missing_depth is null then record_revision end as tombstone_revision, case when status = 'record_found' then record_revision end as record_revision, case when status = 'record_found' then last_final end as last_final, case when status = 'record_found' then last_recovery end as last_recovery"


@relation("catalog")
def catalog_parent_chain(d):
    """Where a record's path ends early: above the records the catalog is unavailable, below
    them the record is absent."""
    return f"select entry, {CHAIN} as chain from catalog"


@relation("catalog")
def scan_catalog_slots(d):
    """Slots that can be read, as live, tombstone, corrupt or unsupported."""
    return f"select entry, case when bytes > {RECORD_BYTES} then 'corrupt' when version <> 1 then 'unsupported' when not parses or not same_identity then 'corrupt' when tombstone then 'supported_tombstone' else 'supported_live' end as classification from catalog where kind = 'file' and readable and stable and missing_depth is null"


@relation("scan_catalog_slots")
def catalog_identities(d):
    """Identities of supported slots only."""
    return "select entry from scan_catalog_slots where classification like 'supported%'"


@relation("entries", "catalog")
def catalog_lookup(d):
    """What a look at one identity's record finds, with a tombstone's revision."""
    slots = f"(select entry, {FOUND} from (select *, {STATUS} as status from catalog) c) s"
    rows = merged(("entries", {}), (slots, {"status": "string", "tombstone_revision": "bigint", "record_revision": "bigint", "last_final": "string", "last_recovery": "string"}))
    return f"select entry, coalesce(status, 'record_absent') as status, tombstone_revision, record_revision, last_final, last_recovery from {rows} t"


@relation("catalog_lookup", public=False)
def expected_revisions(d):
    """Records with the revision that a writer expects: the one that was read, some older."""
    return "select *, coalesce(record_revision, tombstone_revision) - case when entry % 13 = 0 then 1 else 0 end as expected from catalog_lookup"


@relation("expected_revisions")
def catalog_merge_precheck(d):
    """Whether the revision that a writer expects is the record's."""
    return "select entry, expected, case when status not in ('record_found', 'record_absent') then status when expected is null or coalesce(record_revision, tombstone_revision, -1) = expected then 'continue' else 'conflict' end as verdict from expected_revisions"


@relation("lookup_status", "entry_metadata")
def catalog_evidence_guard(d):
    """Whether a hit may become a record: its identity and all document digests agree."""
    names = ("digest", "want_digest", "cache_key", "want_key", "rebuilt_digest", "metadata_manifest_sha", "manifest_sha", "marker_manifest_sha", "marker_metadata_sha", "metadata_sha", "marker_digest")
    rows = merged(("lookup_status", {"status": "string"}), ("entry_metadata", {n: "string" for n in names}))
    return f"""
    select entry, case when status <> 'hit' then 'no_evidence' when digest <> want_digest or cache_key <> want_key or rebuilt_digest <> want_digest then 'identity_differs'
      when metadata_manifest_sha <> manifest_sha or marker_manifest_sha <> manifest_sha or marker_metadata_sha <> metadata_sha or marker_digest <> want_digest then 'integrity_differs' else 'agrees' end as guard from {rows} t"""


@relation("entries", public=False)
def resolved(d):
    """Whether what is expected of an entry is known."""
    return "select entry, entry % 131 <> 0 as known from entries"


#: Whether an identity is known and its recovery is asked for.
NEEDS = "(known and ((flags & 2) <> 0 or (lookup <> 'hit' and (flags & 4) <> 0)))"


@relation("identity_three_way_union", "resolved", "lookup_status", "recovery_summary_projection", "catalog_lookup", "final_summary_projection")
def catalog_vs_authority(d):
    """What lookup, recovery (where it is needed) and catalog say about each identity that any
    source has seen; nothing but the sources where expectations are unknown."""
    rows = merged(("identity_three_way_union", {"flags": "int"}), ("resolved", {"known": "boolean"}), ("(select entry, status as lookup, reason as lookup_reason from lookup_status) l", {"lookup": "string", "lookup_reason": "string"}), ("(select entry, status as recovery, summary as recovery_summary from recovery_summary_projection) r", {"recovery": "string", "recovery_summary": "string"}),
                  ("(select entry, status as catalog_status, tombstone_revision, record_revision, last_final, last_recovery from catalog_lookup) c", {"catalog_status": "string", "tombstone_revision": "bigint", "record_revision": "bigint", "last_final": "string", "last_recovery": "string"}), ("(select entry, summary as final_summary from final_summary_projection) f", {"final_summary": "string"}))
    kept = ", ".join(f"case when known then {c} end as {c}" for c in ("lookup", "lookup_reason", "final_summary", "catalog_status", "tombstone_revision", "record_revision", "last_final", "last_recovery"))
    return f"select entry, flags, {kept}, case when {NEEDS} then recovery end as recovery, case when {NEEDS} then recovery_summary end as recovery_summary from {rows} t where flags is not null"


#: The reconciliation matrix, first match: condition, action, reason.
MATRIX = [
    ("lookup is null or catalog_status is null", "defer", "expectations_unavailable"),
    ("catalog_status = 'catalog_unavailable' and lookup <> 'hit' and recovery = 'empty'", "noop", "empty_catalog_unavailable"),
    ("catalog_status = 'catalog_corrupt'", "report_only", "catalog_corrupt"),
    ("catalog_status = 'catalog_unsupported'", "report_only", "catalog_unsupported"),
    ("catalog_status = 'catalog_unsafe'", "report_only", "catalog_unsafe"),
    ("catalog_status = 'catalog_unstable'", "defer", "catalog_unstable"),
    ("catalog_status in ('catalog_io_failure', 'catalog_unavailable')", "defer", "catalog_io_failure"),
    ("lookup = 'unsupported_version'", "report_only", "authoritative_unsupported"),
    ("lookup = 'unsafe_path'", "report_only", "authoritative_unsafe"),
    ("lookup_reason = 'io_failure'", "defer", "authoritative_io_failure"),
    ("lookup not in ('hit', 'miss', 'locked_or_in_progress')", "report_only", "authoritative_invalid"),
    ("recovery = 'recovery_unstable'", "defer", "authoritative_unstable"),
    ("recovery = 'recovery_unsafe'", "report_only", "authoritative_unsafe"),
    ("recovery = 'recovery_unsupported'", "report_only", "authoritative_unsupported"),
    ("recovery = 'recovery_invalid'", "report_only", "authoritative_invalid"),
    ("lookup <> 'hit' and recovery = 'empty' and catalog_status = 'record_absent' and tombstone_revision is not null", "noop", "tombstone_matches_empty"),
    ("lookup <> 'hit' and recovery = 'empty' and catalog_status = 'record_absent'", "noop", "empty_catalog_absent"),
    ("lookup <> 'hit' and recovery = 'empty'", "tombstone_empty", "exact_empty"),
    ("final_summary is not null and last_final is null", "upsert_final", "final_summary_missing"),
    ("final_summary <> last_final", "upsert_final", "final_summary_stale"),
    ("recovery_summary is not null and last_recovery is null", "upsert_recovery", "recovery_summary_missing"),
    ("recovery_summary <> last_recovery", "upsert_recovery", "recovery_summary_stale"),
    ("final_summary is not null or recovery_summary is not null", "noop", "summaries_match"),
    ("lookup in ('miss', 'locked_or_in_progress')", "defer", "authoritative_incomplete"),
]


def picked(i: int, other: str) -> str:
    return "case " + " ".join(f"when {s[0]} then '{s[i]}'" for s in MATRIX) + f" else '{other}' end"


@relation("catalog_vs_authority")
def recon_compare(d):
    """Action and reason for each identity by the matrix, with the revision it expects."""
    return f"select entry, flags, {picked(1, 'report_only')} as action, {picked(2, 'authoritative_invalid')} as reason, coalesce(record_revision, tombstone_revision) as expected_revision, lookup is not null as looked_up, recovery is not null as recovered from catalog_vs_authority"


EXECUTION = "case action when 'noop' then 'no_change' when 'defer' then 'deferred' when 'report_only' then 'report_only' else 'would_apply' end"


@relation("recon_compare")
def recon_execute(d):
    """What a dry run would do with each action."""
    return f"select entry, action, {EXECUTION} as execution from recon_compare"


MOVED = "case when entry % 17 = 0 then 1 else 0 end"


@relation("catalog_lookup", public=False)
def catalog_now(d):
    """Revisions of records when mutations are written: some have moved on since they were read."""
    return f"select entry, coalesce(record_revision, tombstone_revision) + {MOVED} as now from catalog_lookup"


#: The actions that write; whether a write goes through, and what it leaves.
WRITES = "action in ('upsert_final', 'upsert_recovery', 'tombstone_empty')"
TRIED = "coalesce(expected_revision, 0) as expected_or_zero, status in ('record_found', 'record_absent') as readable, status in ('record_found', 'record_absent') and coalesce(now, 0) = coalesce(expected_revision, 0) as wrote"
OUTCOME = "case when not readable then concat('catalog_write_', replace(status, 'catalog_', '')) when wrote then 'catalog_write_applied' else 'catalog_write_conflict' end"
WRITTEN = f"""case when wrote then expected_or_zero + 1 end as revision, {OUTCOME} as outcome,
      case when wrote and action <> 'tombstone_empty' then case when action = 'upsert_final' then final_summary else last_final end end as last_final, case when wrote and action <> 'tombstone_empty' then case when action = 'upsert_recovery' then recovery_summary else last_recovery end end as last_recovery"""
ENDED = "case when outcome is null then {0} when outcome = 'catalog_write_applied' then 'applied' when outcome = 'catalog_write_conflict' then 'revision_conflict' else 'catalog_failure' end"


@relation("recon_compare", "catalog_lookup", "catalog_vs_authority", "catalog_now")
def cas_upsert(d):
    """Mutations against the catalog as it is when they are written: a new record replaces one summary and keeps the other; tombstones keep none."""
    rows = merged(("recon_compare", {"action": "string", "expected_revision": "bigint"}), ("catalog_lookup", {"status": "string", "tombstone_revision": "bigint", "record_revision": "bigint", "last_final": "string", "last_recovery": "string"}), ("catalog_vs_authority", {"final_summary": "string", "recovery_summary": "string"}), ("catalog_now", {"now": "bigint"}))
    return f"""
    select entry, action, {WRITTEN}
    from (select *, {TRIED} from {rows} r where {WRITES}) t"""


@relation("recon_execute", "cas_upsert")
def execution_status_map(d):
    """How each action ended: not written, applied, conflict or a failure of the catalog."""
    rows = merged(("recon_execute", {"action": "string", "execution": "string"}), ("cas_upsert", {"outcome": "string", "revision": "bigint"}))
    return f"select entry, action, {ENDED.format('execution')} as execution, revision from {rows} t"


DIAGNOSED = """case when execution = 'revision_conflict' then 'catalog_revision_conflict' when execution = 'catalog_failure' then 'catalog_failure' when reason in ('authoritative_unstable', 'authoritative_unsafe') then reason
      when reason in ('authoritative_invalid', 'authoritative_unsupported') then 'authoritative_corrupt' when reason like 'catalog_%' then 'catalog_failure' when action = 'noop' then 'identity_noop' when action in ('defer', 'report_only') then 'identity_skipped' else 'identity_reconciled' end as code,
      case flags when 1 then 'final' when 2 then 'staging' when 4 then 'catalog' else 'combined' end as source"""


@relation("execution_status_map", "recon_compare")
def recon_diagnostic_code(d):
    """Diagnostic of each identity from its execution, reason and action, and the source that
    saw it (combined where several did)."""
    rows = merged(("recon_compare", {"flags": "int", "action": "string", "reason": "string"}), ("(select entry, execution from execution_status_map) x", {"execution": "string"}))
    return f"""
    select entry, {DIAGNOSED} from {rows} t"""


@relation("recon_compare", "execution_status_map", "entries", public=False)
def run_rows(d):
    """Identities that were compared, with their namespace and how they ended."""
    rows = merged(("recon_compare", {"action": "string", "looked_up": "boolean", "recovered": "boolean"}), ("(select entry, execution from execution_status_map) x", {"execution": "string"}), ("entries", {"domain": "string", "producer": "string", "schema_version": "int", "digest": "string"}))
    return f"select * from {rows} t where action is not null"


#: Columns that a lookup, a recovery and a catalog have to say about a known identity, and what
#: the catalog had to say itself.
RECORD = ("catalog_status", "tombstone_revision", "record_revision", "last_final", "last_recovery")


@relation("entries", "entry_metadata", "lookup_status", "recovery_compose", "identity_three_way_union", "resolved", public=False)
def entry_run(d):
    """What catalog, comparison and mutations come to for each identity that any source has
    seen, worked out along one row of it: the shorter way of the relations named so. Columns
    of the catalog as read begin with read_."""
    cols = final_columns(d)
    own = "(select entry, domain, producer as own_producer, schema_version, digest, case when entry % 7 < 5 then true end as slot from entries) e"
    rows = merged(("identity_three_way_union", {"flags": "int"}), ("resolved", {"known": "boolean"}), ("(select entry, status as lookup, reason as lookup_reason from lookup_status) l", {"lookup": "string", "lookup_reason": "string"}), ("recovery_compose", {"status": "string", "reason": "string", "staging_count": "int", "final_state": "string", "lock_state": "string"}),
                  ("entry_metadata", SUMMED), (own, {"domain": "string", "own_producer": "string", "schema_version": "int", "digest": "string", "slot": "boolean"}), named="whose")
    names = "entry, domain, own_producer, schema_version, digest, flags"
    seen = f"select {names}, known, slot, lookup, lookup_reason, status as recovered_as, case when status is not null then {d.sha256(RECOVERED)} end as recovered_summary, {', '.join(f'{x} as {c}' for c, x in cols.items())} from {rows} m where flags is not null"
    summed = f"select {names}, known, slot, lookup, lookup_reason, recovered_as, recovered_summary, entry % 61 as j, case when lookup = 'hit' then {final_digest(d)} end as final, recovered_summary as recovery from ({seen}) s"
    slots = f"select {names}, known, slot, lookup, lookup_reason, recovered_as, recovered_summary, final as summary, {SLOT} from ({summed}) s"
    found = f"select {names}, known, slot, lookup, lookup_reason, recovered_as, recovered_summary, summary, {FOUND} from (select *, {STATUS} as status from ({slots}) s) s"
    read = f"select {names}, known, lookup, lookup_reason, recovered_as, recovered_summary, summary, coalesce(case when slot then status end, 'record_absent') as read_catalog_status, {', '.join(f'case when slot then {c} end as read_{c}' for c in RECORD[1:])} from ({found}) s"
    kept = ", ".join(f"case when known then {x} end as {c}" for c, x in {"lookup": "lookup", "lookup_reason": "lookup_reason", "final_summary": "summary", **{c: f"read_{c}" for c in RECORD}}.items())
    told = f"select {names}, {', '.join(f'read_{c}' for c in RECORD)}, {kept}, case when {NEEDS} then recovered_as end as recovery, case when {NEEDS} then recovered_summary end as recovery_summary from ({read}) s"
    compared = f"select *, {picked(1, 'report_only')} as action, {picked(2, 'authoritative_invalid')} as reason, coalesce(record_revision, tombstone_revision) as expected_revision, lookup is not null as looked_up, recovery is not null as recovered from ({told}) s"
    moved = f"select *, read_catalog_status as status, coalesce(read_record_revision, read_tombstone_revision) + {MOVED} as now from ({compared}) s"
    tried = f"select *, case when {WRITES} then {OUTCOME} end as outcome from (select *, {TRIED} from ({moved}) s) s"
    return f"select *, {ENDED.format(EXECUTION)} as execution from ({tried}) s"


@shorter("catalog_vs_authority", "entry_run")
def _(d):
    return f"select entry, flags, lookup, lookup_reason, final_summary, {', '.join(RECORD)}, recovery, recovery_summary from entry_run"


@shorter("recon_compare", "entry_run")
def _(d):
    return "select entry, flags, action, reason, expected_revision, looked_up, recovered from entry_run"


@shorter("cas_upsert", "entry_run")
def _(d):
    kept = "entry, action, expected_or_zero, readable, wrote, status, final_summary, recovery_summary, read_last_final as last_final, read_last_recovery as last_recovery"
    return f"select entry, action, {WRITTEN} from (select {kept} from entry_run lateral view explode(case when {WRITES} then array(1) end) w as written) t"


@shorter("execution_status_map", "entry_run")
def _(d):
    return f"select entry, action, execution, case when {WRITES} and wrote then expected_or_zero + 1 end as revision from entry_run"


@shorter("recon_diagnostic_code", "entry_run")
def _(d):
    return f"select entry, {DIAGNOSED} from entry_run"


@shorter("run_rows", "entry_run")
def _(d):
    return "select entry, action, looked_up, recovered, execution, domain, own_producer as producer, schema_version, digest from entry_run"


@relation("run_rows", public=False)
def reconciled(d):
    """Identities of each namespace in order, with what the run has used up to and before each."""
    w = "over (partition by domain, producer, schema_version order by digest rows between unbounded preceding and {0})"
    work = {"lookups": "case when looked_up then 1 else 0 end", "recoveries": "case when recovered then 1 else 0 end", "mutations": "case when execution = 'applied' then 1 else 0 end"}
    used = ", ".join(f"sum({x}) {w.format('current row')} as {n}, coalesce(sum({x}) {w.format('1 preceding')}, 0) as {n}_before" for n, x in work.items())
    return f"""
    select *, identities - 1 >= {BUDGETS['identities']} or lookups_before >= {BUDGETS['lookups']} or (recovered and recoveries_before >= {BUDGETS['recoveries']}) or (mutates and mutations_before >= {BUDGETS['mutations']}) as over_budget
    from (select entry, domain, producer, schema_version, digest, recovered, action in ('upsert_final', 'upsert_recovery', 'tombstone_empty') as mutates, row_number() {w.format('current row').replace(' rows between unbounded preceding and current row', '')} as identities, {used} from run_rows) t"""


@relation("reconciled")
def work_budget_wrappers(d):
    """Whether each identity's lookup, recovery and mutation still fit the budgets of its namespace's run."""
    return "select entry, not (coalesce(bool_or(over_budget) over (partition by domain, producer, schema_version order by identities rows between unbounded preceding and current row), false)) as within from reconciled"


@relation("reconciled")
def reconcile_run(d):
    """Each namespace's run: pages done, counters at the end, the cursor, the checkpoint's
    revision (one for each identity, one more when complete) and how it ended."""
    return f"""
    select domain, producer, schema_version, cast(ceil(max(identities) / {PAGE}e0) as int) as pages, cast(max(identities) as bigint) as identities, cast(max(lookups) as bigint) as lookups, cast(max(recoveries) as bigint) as recoveries, cast(max(mutations) as bigint) as mutations,
      case when max(total) > max(identities) then max(digest) end as cursor, cast(max(identities) + 1 + case when max(total) > max(identities) then 0 else 1 end as bigint) as revision, case when max(total) > max(identities) then 'budget_exhausted' else 'complete' end as status
    from (select *, count(*) over (partition by domain, producer, schema_version) as total, bool_or(over_budget) over (partition by domain, producer, schema_version order by identities rows between unbounded preceding and current row) as stopped from reconciled) t where not stopped group by domain, producer, schema_version"""


@relation("run_rows")
def recon_progress(d):
    """Identities, lookups, recoveries and applied mutations of each namespace."""
    return "select domain, producer, schema_version, cast(count(*) as bigint) as identities, cast(count_if(looked_up) as bigint) as lookups, cast(count_if(recovered) as bigint) as recoveries, cast(count_if(execution = 'applied') as bigint) as mutations from run_rows group by domain, producer, schema_version"


@relation("recon_compare", "entries")
def recon_compare_batch(d):
    """Batches of 256 identities of each namespace in canonical order, and whether each is unique."""
    return f"""
    select domain, producer, schema_version, batch, cast(count(*) as bigint) as n, count(distinct entry) = count(*) as unique_ids, min(digest) as first_digest, max(digest) as last_digest
    from (select r.entry, domain, producer, schema_version, digest, cast(floor((row_number() over (partition by domain, producer, schema_version order by digest, r.entry) - 1) / {PAGE}e0) as bigint) as batch from recon_compare r join entries e on e.entry = r.entry) t group by domain, producer, schema_version, batch"""


@relation("reconcile_run", public=False)
def checkpoints(d):
    """Checkpoints as found, one a run: bytes, how reads went, version, text fields and counters."""
    return f"""
    select r.domain, r.producer, r.schema_version, case when r.schema_version = 1 then null else 400 + identities end as bytes, r.schema_version <> 2 as stable, case r.schema_version when 3 then 'symlink' else 'file' end as kind, r.schema_version <> 4 as readable, case r.schema_version when 5 then 2 else 1 end as version, r.schema_version <> 6 as exact_fields,
      {d.sha256("concat(r.domain, r.producer)")} as run_id, case when r.schema_version = 7 then -1 else revision end as revision, identities, case when r.schema_version = 8 then null else cursor end as cursor, status, case when r.schema_version = 9 then null else coalesce(cursor, 'last') end as last_identity from reconcile_run r"""


@relation("checkpoints")
def checkpoint_codec(d):
    """What reading each checkpoint gives, of seven outcomes, and the JSON of those that were found."""
    json = """concat('{"checkpoint_revision":', cast(revision as string), ',"checkpoint_version":1,"counters":{"identities_completed":', cast(identities as string), '},"run_id":"', substring(run_id, 1, 32), '","state":"', case when status = 'complete' then 'complete' else 'active' end, '"}')"""
    found = """case when bytes is null then 'absent' when kind <> 'file' then 'unsafe' when not readable then 'io_failure' when bytes > 65536 then 'corrupt' when not stable then 'unstable' when not exact_fields then 'corrupt' when version <> 1 then 'unsupported' when revision <= 0 or (identities = 0) <> (last_identity is null) then 'corrupt' else 'found' end"""
    return f"select domain, producer, schema_version, outcome, case when outcome = 'found' then {json} end as json from (select *, {found} as outcome from checkpoints) t"


@relation("catalog_record_path", "entries", public=False)
def catalog_names(d):
    """Names in the catalog's folders: records, temporary files, and in some namespaces a corrupt name."""
    return """
    select entry, path, domain, producer, schema_version from (select p.entry, case when e.entry % 997 = 13 then replace(path, '.json', '.jsn') else path end as path, domain, producer, schema_version from catalog_record_path p join entries e on e.entry = p.entry) t
    union all select entry, concat_ws('/', 'catalog/v1/records', domain, producer, cast(schema_version as string), concat('.catalog-tmp-', substring(digest, 1, 32))), domain, producer, schema_version from entries where entry % 50 = 7"""


@relation("catalog_names")
def catalog_enumerate_dirs(d):
    """Pages of each namespace, schemas as numbers: records by digest, temporary files left out;
    one corrupt name fails the whole page."""
    record, temporary = d.matches("name", "^[0-9a-f]{64}[.]json$"), d.matches("name", "^[.]catalog-tmp-[0-9a-f]{32}$")
    return f"""
    select domain, producer, schema_version, cast(count_if({record}) as bigint) as records, cast(count_if({temporary}) as bigint) as temporary, case when bool_or(not {record} and not {temporary}) then 'catalog_corrupt' end as failure, case when bool_or(not {record} and not {temporary}) then null else min(case when {record} then name end) end as first_record
    from (select *, {d.extract('path', '([^/]+)$', 1)} as name from catalog_names) t group by domain, producer, schema_version"""


@relation("locks")
def lock_verify(d):
    """Whether the lock that is held is still the one that was taken: same entry, times in order, a regular file."""
    return "select entry, kind = 'file' and parses and coalesce(lock_version, 0) = 1 and digest = want_digest and acquired <= heartbeat as still_owned from locks"
