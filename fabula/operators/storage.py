"""Content-addressed storage as tables: identities, payloads, locks, recovery, catalogs.

Entries come from orders, payload files from line items; what a scan of a file system
would find (missing files, other sizes, locks, staging folders) is derived by modulus.
"""

from ..plans.relation import relation

#: Joins lines.
LF = "\n"


@relation("orders", public=False)
def entries(d):
    return f"select o_orderkey as entry, lower(substring(o_orderpriority, 3)) as domain, lower(o_orderstatus) as producer, cast(o_custkey % 12 + 1 as int) as schema_version, {d.sha256('cast(o_orderkey as string)')} as digest, o_custkey, o_totalprice, {d.seconds('o_orderdate')} as at_s from orders"


@relation("entries")
def entry_digest(d):
    """Content address of each entry: SHA-256 of its key."""
    return f"select entry, {d.sha256("concat('cache-v1.0:sha256:', digest)")} as entry_digest from entries"


@relation("entries")
def digest_shards(d):
    """Two levels of shard folders from a digest."""
    return "select entry, substring(digest, 1, 2) as aa, substring(digest, 3, 2) as bb from entries"


@relation("entries")
def final_path(d):
    """final, staging and lock paths of an entry."""
    base = "concat_ws('/', domain, producer, cast(schema_version as string), substring(digest, 1, 2), substring(digest, 3, 2), digest)"
    return f"select entry, concat('entries/v1/', {base}) as final_path, concat('staging/v1/', digest, '.', substring(digest, 60)) as staging_path, concat('locks/v1/', digest, '.json') as lock_path from entries"


@relation("entries")
def catalog_record_path(d):
    """Path of an entry's catalog record."""
    return "select entry, concat_ws('/', 'catalog/v1/records', domain, producer, cast(schema_version as string), concat(digest, '.json')) as path from entries"


@relation("entries")
def qualified_sha256(d):
    """Digest with its algorithm in front, and whether it is well formed."""
    return f"select entry, concat('sha256:', digest) as qualified, {d.matches('digest', '^[0-9a-f]{64}$')} as ok from entries"


#: The limits of a reconciliation policy, in the order in which they are digested.
POLICY = (256, 1024, 1024, 512, 256, 256, 4096, 4096, 1024, 64)


@relation("entries", public=False)
def policies(d):
    """Policies, one a schema: each limit as fixed or lowered."""
    return f"select distinct schema_version, {', '.join(f'case when schema_version % {i + 2} = 0 then {v} else {v} / 2 end as l{i}' for i, v in enumerate(POLICY))} from entries"


@relation("policies")
def policy_digest(d):
    """SHA-256 of a policy's version and limits joined by colons."""
    limits = ", ".join(f"cast(cast(l{i} as bigint) as string)" for i in range(len(POLICY)))
    return f"select schema_version, {d.sha256(f"concat_ws(':', '1', {limits})")} as policy from policies"


@relation("entries", public=False)
def key_values(d):
    """Values that a key is made of: names, a note that may be null, a share that may be -0."""
    return "select entry, domain, producer, schema_version, cast(null as string) as note, (entry % 9 - 4) * 0.25e0 * case when entry % 9 = 4 then -1e0 else 1e0 end as share from entries"


@relation("key_values")
def canonical_json(d):
    """Canonical JSON of each entry in the three dialects: contracts have no nulls or floats,
    storage keeps nulls, keys keep finite floats with -0 as 0. (ASCII text without escapes;
    functions/canonical.py has them for any text.)"""
    q = "chr(34)"
    member = lambda k, v: f"{q}, '{k}', {q}, ':', {v}"
    text = lambda c: f"{q}, {c}, {q}"
    note = f"case when note is null then concat(chr(110), chr(117), chr(108), chr(108)) else concat({text('note')}) end"
    base = [("domain", text("domain")), ("producer", text("producer")), ("schema", "cast(schema_version as string)")]
    of = lambda ms: "concat('{', " + ", ',', ".join(member(k, v) for k, v in sorted(ms)) + ", '}')"
    share = "case when share = 0e0 then '0.0' else cast(share as string) end"
    return f"select entry, {of(base)} as json, {of([*base, ('note', note)])} as storage_json, {of([*base, ('share', share)])} as key_json from key_values"


@relation("canonical_json")
def derive_cache_key(d):
    """Cache key from canonical material."""
    return f"select entry, concat('cache-v1.0:sha256:', {d.sha256('json')}) as cache_key from canonical_json"


@relation("entries")
def identity_sort(d):
    """Entries of a namespace (domain, producer, schema) in canonical order, and the
    namespaces' keys, in which the numeric schema counts as a number."""
    return "select entry, concat_ws('/', domain, producer, lpad(cast(schema_version as string), 10, '0')) as namespace, cast(row_number() over (partition by domain, producer, schema_version order by digest) as int) as place from entries"


@relation("entries", public=False)
def cursors(d):
    """Where each namespace's page begins: after this digest (none: at the start), and its limit."""
    return "select domain, producer, schema_version, case when schema_version % 3 > 0 then substring(max(digest), 1, 1) end as cursor, 20 + schema_version as page_limit from entries group by domain, producer, schema_version"


@relation("entries", "cursors")
def keyset_page(d):
    """A page of each namespace: identities after its cursor, as many as its limit, with the
    next cursor where more follow."""
    w = "over (partition by e.domain, e.producer, e.schema_version order by digest)"
    return f"""
    select domain, producer, schema_version, entry, place, case when n > page_limit and place = page_limit then digest end as next_cursor
    from (select e.domain, e.producer, e.schema_version, entry, digest, page_limit, cast(row_number() {w} as int) as place, count(*) over (partition by e.domain, e.producer, e.schema_version) as n
      from entries e join cursors c on c.domain = e.domain and c.producer = e.producer and c.schema_version = e.schema_version where cursor is null or digest > cursor) t where place <= page_limit"""


@relation("entries", public=False)
def sources_seen(d):
    return "select entry, 1 as flag from entries where entry % 2 = 0 union all select entry, 2 from entries where entry % 3 = 0 union all select entry, 4 from entries where entry % 5 < 3"


@relation("sources_seen")
def identity_three_way_union(d):
    """Identities of three sources with the union of their flags."""
    return "select entry, cast(bit_or(flag) as int) as flags from sources_seen group by entry"


@relation("lineitem", public=False)
def declared(d):
    return "select l_orderkey as entry, concat(case when l_linenumber % 3 = 0 then 'set/' else '' end, 'part-', cast(l_linenumber as string), '.bin') as path, max(cast(l_quantity * 1000 as bigint)) as bytes, max(l_partkey) as content from lineitem group by l_orderkey, l_linenumber"


@relation("declared", public=False)
def observed(d):
    """Files as found: kind, size, links, stability and content; some missing, some renamed."""
    return "select entry, case when content % 137 = 5 then concat(path, '.tmp') when content % 139 = 6 then upper(path) when content % 149 = 8 then 'set' when content % 151 = 9 then concat('./', path) else path end as path, case when content % 101 = 7 then 'symlink' else 'file' end as kind, case when content % 123 = 0 then bytes + 1 else bytes end as bytes, case when content % 97 = 11 then 2 else 1 end as links, content % 89 <> 12 as stable, case when content % 129 = 0 then content + 1 else content end as content from declared where content % 131 <> 0"


@relation("declared", "observed")
def payload_vs_manifest(d):
    """Declared against observed files: missing, unexpected, of other size or content."""
    return "select coalesce(m.entry, o.entry) as entry, coalesce(m.path, o.path) as path, case when o.path is null then 'missing' when m.path is null then 'unexpected' when m.bytes <> o.bytes then 'size_mismatch' when m.content <> o.content then 'digest_mismatch' else 'valid' end as status from declared m full outer join observed o on o.entry = m.entry and o.path = m.path"


@relation("declared", "observed")
def payload_summary_check(d):
    """Whether count and bytes of the files are those declared."""
    return "select m.entry, m.n, m.b as bytes, coalesce(o.n, 0) = m.n as count_ok, coalesce(o.b, 0) = m.b as bytes_ok from (select entry, cast(count(*) as bigint) as n, cast(sum(bytes) as bigint) as b from declared group by entry) m left join (select entry, count(*) as n, sum(bytes) as b from observed group by entry) o on o.entry = m.entry"


@relation("observed")
def payload_paths_valid(d):
    """What is wrong with an entry's file paths: names, letter case that clashes, a file where
    another path has a folder. (Order and repeats are a listing's.)"""
    bad = " or ".join([f"{d.matches('path', '(^/|/$|//|[ .](/|$)|(^|/)[.]{1,2}(/|$))')}", "contains(path, chr(92))", "path <> trim(path)", "path = ''"])
    return f"""
    select p.entry, cast(count(*) as bigint) as n, concat_ws(',', case when bool_or({bad}) then 'name' end, case when count(distinct lower(path)) < count(*) then 'case' end, case when bool_or(c.prefix is not null) then 'prefix' end) as violations
    from (select entry, path from observed group by entry, path) p left join (select distinct entry, folder as prefix from {d.unnest(f"(select entry, {d.map(d.range(1, d.size(d.split('path', '/')) + ' - 1'), d.join(d.slice(d.split('path', '/'), 1, 'x'), '/'))} as folders from observed) s", 'folders', 'folder')}) c on c.entry = p.entry and c.prefix = path group by p.entry"""


@relation("payload_findings")
def cardinality_check(d):
    """Whether an entry may have as many files as it declares: none only where that is allowed."""
    return "select entry, records, records > 0 or empty_allowed as ok from payload_findings"


@relation("declared", "observed")
def entry_snapshot(d):
    """Whether two listings of an entry agree in every path and column."""
    return "select coalesce(a.entry, b.entry) as entry, bool_and(a.bytes is not null and b.bytes is not null and a.bytes = b.bytes and a.content = b.content and b.kind = 'file' and b.links = 1) as stable, cast(count_if(a.path is null or b.path is null) as bigint) as only_once from declared a full outer join observed b on b.entry = a.entry and b.path = a.path group by coalesce(a.entry, b.entry)"


@relation("observed", public=False)
def file_looks(d):
    """Two looks at each file: before and after."""
    return "select entry, path, kind, bytes, content, case when content % 41 = 0 then null else content % 3 end as before_device, content % 3 as device, entry * 10 + links as before_inode, entry * 10 + case when stable then links else 9 end as inode, bytes as before_bytes, content * 7 as before_mtime, content * 7 + case when content % 43 = 1 then 1 else 0 end as mtime from observed"


@relation("file_looks")
def file_identity(d):
    """Whether two looks at a file saw the same object: type, device, inode, size and times
    equal, links within one; a device or inode that is not known is never the same."""
    return """
    select entry, path, before_device is not null and device is not null and before_device = device and before_inode is not null and inode is not null and before_inode = inode and kind = 'file' and before_bytes = bytes and before_mtime = mtime as same
    from file_looks"""


@relation("final_path")
def scan_entry_identities(d):
    """Identities parsed back from their paths; the shards must begin the digest."""
    digest = d.extract("final_path", "([0-9a-f]{64})$", 1)
    return f"select entry, {d.extract('final_path', '^entries/v1/([^/]+)/', 1)} as domain, contains(final_path, concat('/', substring({digest}, 1, 2), '/', substring({digest}, 3, 2), '/')) as shards_ok, {digest} as digest from final_path"


@relation("final_path")
def scan_staging_identities(d):
    """Identities that staging names hold, each once, with its candidates' number and first token."""
    return f"select digest, cast(count(*) as bigint) as candidates, min(token) as first_token from (select {d.extract('staging_path', '/([0-9a-f]+)[.]', 1)} as digest, {d.extract('staging_path', '[.]([0-9a-f]+)$', 1)} as token from final_path) t where digest <> '' group by digest"


@relation("documents", public=False)
def excerpts(d):
    """Excerpts that claims cite from documents: their middle, or a changed one."""
    return "select doc_id, text, concat(substring(text, 10, 40), case when doc_id % 3 = 0 then 'x#' else '' end) as excerpt from documents"


@relation("excerpts")
def excerpt_containment(d):
    """Whether a document holds the excerpt that a claim cites, as it stands."""
    return "select doc_id, contains(text, excerpt) as contained from excerpts"


@relation("documents")
def claim_identity(d):
    """Digest of a claim's identity."""
    return f"select doc_id, {d.sha256('concat_ws(chr(10), lang, source, cast(n_chars as string))')} as claim_id from documents"


@relation("conversations")
def plain_text_projection(d):
    """Turns of a conversation as one text, one line a turn."""
    return f"select conv_id, md5({d.agg_text('text', LF, 'turn')}) as text_md5, cast(count(*) as bigint) as n from conversations group by conv_id"


@relation("conversations")
def segment_ordering(d):
    """Whether turns are numbered without gaps, and roles alternate."""
    return "select conv_id, bool_and(previous is null or turn = previous + 1) as gapless, bool_and(before is null or before <> role) as alternate from (select *, lag(turn) over (partition by conv_id order by turn) as previous, lag(role) over (partition by conv_id order by turn) as before from conversations) t group by conv_id"


@relation("documents", public=False)
def language_claims(d):
    """Languages of documents: as declared, and as their source says; either may be missing."""
    return "select doc_id, case when doc_id % 4 <> 0 then lang end as declared, case when doc_id % 8 = 0 then 'en' end as of_source from documents"


@relation("language_claims")
def document_language_precedence(d):
    """Declared language, else the source's, else unknown."""
    return "select doc_id, coalesce(declared, of_source, 'und') as language from language_claims"


@relation("customer", "orders")
def resolve_project(d):
    """The newest order of each customer."""
    return "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as r from orders join customer on c_custkey = o_custkey) t where r = 1"


@relation("lineitem")
def scan_media_folders(d):
    """Orders that have both a returned and a shipped line."""
    return "select l_orderkey from lineitem group by l_orderkey having bool_or(l_returnflag = 'R') and bool_or(l_linestatus = 'O')"
