"""Text scalars."""

from ..plans.relation import WHITE, quote, relation

#: Words that never count as content.
STOP_STORY = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it", "its",
    "of", "on", "or", "she", "that", "the", "their", "them", "they", "this", "to", "was", "were", "with", "would", "att", "av", "de", "den", "det",
    "en", "ett", "för", "från", "han", "har", "hon", "i", "med", "och", "om", "på", "som", "till", "var", "är",
)
STOP_SEMANTIC = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "did", "do", "for", "from", "had", "has", "have", "he", "her", "hers", "him",
    "his", "in", "into", "is", "it", "its", "of", "on", "one", "or", "she", "that", "the", "their", "them", "there", "they", "this", "to", "was",
    "were", "with", "would", "att", "av", "blev", "de", "den", "det", "du", "en", "ett", "för", "från", "han", "har", "hon", "i", "inte", "med",
    "men", "och", "om", "på", "som", "till", "var", "vi", "är",
)

#: Story signals and the substrings that show them.
SIGNALS = {
    "contrast": ("but", "however", "yet", "despite", "instead", "although", "men", "dock", "däremot", "trots", "istället"),
    "challenge": ("claimed", "alleged", "challenged", "disputed", "denied", "questioned", "påstod", "ifrågasatte", "bestred"),
    "cause": ("because", "therefore", "as a result", "the result", "därför", "eftersom", "resultatet"),
    "reveal": ("the truth", "revealed", "discovered", "uncovered", "came to light", "avslöjade", "upptäckte", "sanningen"),
    "evidence": ("evidence", "according to", "records", "documents", "data", "report", "bevis", "enligt", "journaler", "dokument", "rapport"),
    "escalation": ("crisis", "danger", "risk", "worse", "urgent", "death", "killed", "kris", "fara", "risk", "värre", "död"),
    "conclusion": ("finally", "ultimately", "in the end", "therefore", "conclusion", "slutligen", "till slut", "sammanfattningsvis"),
    "reflection": ("looking back", "legacy", "remembered", "years later", "i efterhand", "arv", "år senare"),
    "chronology": ("years later", "months later", "in 19", "in 20", "then", "later", "år senare", "månader senare", "sedan", "senare"),
    "call": ("must act", "we need", "take action", "you can", "agera", "vi måste", "du kan"),
}

WORD_STORY = "[a-zåäö0-9]+(?:-[a-zåäö0-9]+)?"
WORD_SEMANTIC = "[a-z0-9]+(?:-[a-z]+)?"
WORD_VISUAL = "[a-z0-9]+(?:-[a-z0-9]+)?"
WORD_AMBIENCE = "[a-zåäö0-9]+"


def words_in(values) -> str:
    return "(" + ", ".join(map(quote, values)) + ")"


def has(text: str, signal: str) -> str:
    """Whether a text shows a signal: any of its substrings, in any case."""
    return "(" + " or ".join(f"contains(lower({text}), {quote(p)})" for p in SIGNALS[signal]) + ")"


def story_tokens(d, text: str) -> str:
    return d.keep(d.tokens(f"lower({text})", WORD_STORY), f"length(x) > 1 and x not in {words_in(STOP_STORY)}")


def four(x: str) -> str:
    """Rounded to four places, halves up, by whole numbers: alike on any engine at exact halves."""
    return f"(cast(floor((cast(round(({x}) * 1e9) as bigint) + 50000) / 1e5) as bigint) / 1e4)"


def clamp(d, x: str) -> str:
    return d.round(f"greatest(0e0, least(1e0, {x}))", 4)


@relation("documents")
def clean_text(d):
    """Runs of white space (all that Unicode knows) become one space; ends are stripped."""
    white = WHITE.replace("\\", "\\\\") if d.spark else WHITE
    return f"select doc_id, md5(cleaned) as cleaned_md5, cast(length(cleaned) as int) as n from (select doc_id, trim({d.replace('text', white, ' ')}) as cleaned from documents) t"


@relation("documents")
def tokens_story(d):
    """Content words of each document for story analysis."""
    return f"select doc_id, cast({d.size('w')} as int) as n_tokens, cast({d.size(d.distinct('w'))} as int) as n_distinct, md5({d.join('w', ' ')}) as tokens_md5 from (select doc_id, {story_tokens(d, 'text')} as w from documents)"


@relation("documents")
def tokens_semantic(d):
    """ASCII content words, with a singular added for longer plurals; as counts and a digest."""
    kept = d.keep(d.tokens("lower(text)", WORD_SEMANTIC), f"length(x) > 1 and x not in {words_in(STOP_SEMANTIC)}")
    with_singular = d.map("w", "case when x like '%s' and length(x) > 4 then concat(x, ' ', substring(x, 1, length(x) - 1)) else x end")
    return f"select doc_id, cast({d.size('w')} as int) as n_base, md5({d.join(with_singular, ' ')}) as tokens_md5 from (select doc_id, {kept} as w from documents)"


@relation("documents")
def tokens_audio(d):
    """All words of each document for audio planning (no stop words)."""
    return f"select doc_id, cast({d.size('w')} as int) as n_tokens, md5({d.join('w', ' ')}) as tokens_md5 from (select doc_id, {d.tokens('lower(text)', WORD_STORY)} as w from documents)"


@relation("documents")
def tokens_ambience(d):
    """Words without hyphens."""
    return f"select doc_id, cast({d.size('w')} as int) as n_tokens, md5({d.join('w', ' ')}) as tokens_md5 from (select doc_id, {d.tokens('lower(text)', WORD_AMBIENCE)} as w from documents)"


@relation("scenes")
def signal_has(d):
    """The ten story signals of each scene."""
    flags = ", ".join(f"{has('voiceover_text', s)} as {s}" for s in SIGNALS)
    return f"select project_id, scene_index, {flags} from scenes"


@relation("documents")
def token_counter(d):
    """Multiset counts of words over all documents."""
    return f"select word, cast(count(*) as bigint) as n from {d.unnest(f'''(select {story_tokens(d, "text")} as w from documents) s''', 'w', 'word')} group by word"


@relation("story_text")
def sentence_regex_split(d):
    """Sentences of each scene's text, in order: cut after . ! or ? and white space of any kind."""
    parts = d.cut(d.strip("text"), f"([.!?]){WHITE}", 1)
    return f"select project_id, scene_index, cast(place as int) as place, sentence from {d.unnest_at(f'(select project_id, scene_index, {parts} as parts from story_text)', 'parts', 'sentence', 'place')}"


@relation("pages", public=False)
def names(d):
    """Names of pages and languages, some with marked letters, some without any letter."""
    return "select page_id, case page_id % 6 when 0 then concat('Återkomst: ', url) when 1 then '***' when 2 then concat('  Élan vital ', cast(page_id as string)) when 3 then '漢字' else url end as name from pages"


@relation("pages")
def ffconcat_quote(d):
    """A path quoted for a concat list: each ' closes, escapes and reopens the quotes."""
    esc = "replace(concat(url, chr(39), 's'), chr(39), concat(chr(39), chr(92), chr(39), chr(39)))"
    return f"select page_id, concat('file ', chr(39), {esc}, chr(39)) as line from pages"


@relation("spoken", "caption_scene_interval_join", "match_terms")
def highlight_clean(d):
    """Caption words stripped of edge punctuation, and whether each may be highlighted: a year
    of 1900-2099, or a match term of its scene with five letters or more."""
    clean = d.replace("word", "^[^A-Za-z0-9]+|[^A-Za-z0-9-]+$", "")
    return f"select s.project_id, s.word_index, s.clean, {d.matches('s.clean', '^(19|20)[0-9][0-9]$')} as is_year, m.term is not null and length(s.clean) >= 5 as is_keyword from (select project_id, n, word_index, {clean} as clean from spoken) s left join caption_scene_interval_join c on c.project_id = s.project_id and c.caption_id = s.n left join match_terms m on m.project_id = c.project_id and m.scene_index = c.scene_index and m.term = lower(s.clean)"


def stamp(seconds: str) -> str:
    """HH:MM:SS,mmm of a time, none below zero."""
    ms = f"greatest(0, cast(round({seconds} * 1000e0) as bigint))"
    part = lambda n, size: f"lpad(cast(cast(floor({n}) as bigint) as string), {size}, '0')"
    return f"concat({part(f'{ms} / 3600000', 2)}, ':', {part(f'({ms} % 3600000) / 60000', 2)}, ':', {part(f'({ms} % 60000) / 1000', 2)}, ',', {part(f'{ms} % 1000', 3)})"


@relation("captions")
def srt_timestamp(d):
    """HH:MM:SS,mmm of each caption's start and end."""
    return f"select project_id, caption_id, {stamp('caption_start')} as start_stamp, {stamp('caption_end')} as end_stamp from captions"


@relation("srt_timestamp", "captions")
def sink_srt(d):
    """Captions as SubRip blocks, keyed by project and id (write ordered by both)."""
    return "select c.project_id, c.caption_id, concat(cast(c.caption_id as string), chr(10), start_stamp, ' --> ', end_stamp, chr(10), upper(caption_text), chr(10)) as block from captions c join srt_timestamp s on s.project_id = c.project_id and s.caption_id = c.caption_id"


@relation("orders")
def clamp01_round4(d):
    """Values held in [0, 1] and rounded to four places."""
    return f"select o_orderkey, {four('greatest(0e0, least(1e0, (o_totalprice - 50000e0) / 300000e0))')} as unit from orders"


@relation("orders")
def optional_unit(d):
    """A value where it lies in [0, 1], else null."""
    return "select o_orderkey, case when v between 0e0 and 1e0 then v end as unit from (select o_orderkey, (o_totalprice - 50000e0) / 300000e0 as v from orders)"


@relation("orders")
def fraction_in_range(d):
    """A fraction rounded to four places and whether it keeps within 0.08 to 0.92."""
    return f"select o_orderkey, f, f between 0.08e0 and 0.92e0 as ok from (select o_orderkey, {d.round('o_totalprice / 500000e0', 4)} as f from orders)"


#: Language tags by a document's number: valid, odd case, with script and region, and malformed.
TAGS = [(0, "en"), (1, "SV"), (2, "zh-hant-tw"), (3, "UND"), (4, "sr-Latn"), (5, "es-419"), (6, "e"), (7, "en-"), (8, "und-SE"), (9, "en-us-x"), (10, "de-AT")]


@relation(public=False)
def tags(d):
    return d.values("t", ("k", "tag"), TAGS)


@relation("documents", "tags", public=False)
def document_tags(d):
    """Documents with the tags that they come with."""
    return f"select doc_id, tag from documents join tags on k = doc_id % {len(TAGS)}"


@relation("document_tags")
def language_tag_canon(d):
    """Canonical language tag (language lower, Script capitalised, REGION upper) or null."""
    p = d.split("tag", "-")
    lang, two, three = (f"coalesce({d.element('p', i)}, '')" for i in (1, 2, 3))
    n = d.size("p")
    is_script = lambda x: d.matches(x, "^[A-Za-z]{4}$")
    is_region = lambda x: d.matches(x, "^([A-Za-z]{2}|[0-9]{3})$")
    script = f"concat(upper(substring({two}, 1, 1)), lower(substring({two}, 2)))"
    return f"""
    select doc_id, tag, case when lower(tag) = 'und' then 'und' when not {d.matches(lang, "^[A-Za-z]{2,3}$")} or lower({lang}) = 'und' then null
      when {n} = 1 then lower({lang})
      when {n} = 2 and {is_script(two)} then concat(lower({lang}), '-', {script})
      when {n} = 2 and {is_region(two)} then concat(lower({lang}), '-', upper({two}))
      when {n} = 3 and {is_script(two)} and {is_region(three)} then concat(lower({lang}), '-', {script}, '-', upper({three})) end as canonical
    from (select doc_id, tag, {p} as p from document_tags)"""


@relation("pages", public=False)
def video_refs(d):
    """Video references of many shapes, good and malformed."""
    v = "substring(md5(cast(page_id as string)), 1, 11)"
    watch = f"concat('https://www.youtube.com/watch?v=', {v}"
    shapes = [f"concat('https://youtu.be/', {v})", f"{watch})", f"concat('https://youtube.com/shorts/', {v})", f"concat('http://youtu.be/', {v})", f"concat('https://YouTube.com:443/watch?v=', {v})", f"concat('https://youtu.be/', {v}, '/x')", f"concat('https://youtu.be:80/', {v})", "url", f"{watch}, '&t=90&feature=share')", f"{watch}, '&x=1')", f"{watch}, '&t=99999999')",
              f"{watch}, '&list=')", f"{watch}, '&si=a%20b')", f"{watch}, '&si=a%2Fb')", f"{watch}, '#t=75s')", f"{watch}, '#')", f"{watch}, '#top')", f"concat('https://www.youtube.com/watch?t=5&v=', {v}, '&v=', {v})", f"concat('https://user@youtu.be/', {v})", f"concat('https://youtu.be./', {v})", f"concat(' https://youtu.be/', {v})", f"concat('HTTPS://youtu.be/', {v}, '?t=12')", f"concat('https://youtu.be/', {v}, '?v=', {v})", f"concat('https://youtu.be/', {v}, '?t')", f"{watch}, '&st%61rt=3')"]
    cases = " ".join(f"when {i} then {s}" for i, s in enumerate(shapes))
    return f"select page_id, case page_id % {len(shapes)} {cases} end as ref from pages"


#: Query keys beside v, and the most that a time may be.
QUERY_KEYS, MOST_TIME = ("t", "start", "si", "feature", "list", "index"), 86400000


@relation("video_refs")
def canonicalize_youtube(d):
    """The video id of an https reference to one of three hosts, port 443 or none; else null.
    Lexical only: closed query keys, each once, with values; times bounded; escapes strict."""
    keys = "|".join(QUERY_KEYS)
    late = lambda x: f"(not {d.matches(x, '^[0-9]{1,8}$')} or coalesce(try_cast({x} as bigint), 0) > {MOST_TIME})"
    escape = lambda x: f"(contains({d.replace(x, '%[0-9A-Fa-f]{2}', '')}, '%') or {d.matches(f'lower({x})', '%(26|3d|25|23|3f|2f|5c)')})"
    value = d.replace("x", "^[a-z]+=", "")
    wrong = " or ".join([f"not {d.matches('x', f'^({keys}|v)=[^=]+$')}", f"({d.matches('x', '^(t|start)=')} and {late(value)})", escape("x"), "length(x) > 530", f"({d.matches('x', '^v=')} and not {d.matches('x', '^v=[A-Za-z0-9_-]{11}$')})"])
    members = d.split("query", "&")
    own = d.size(d.distinct(d.map("members", d.replace("x", "=.*$", ""))))
    videos = d.size(d.keep("members", d.matches("x", "^v=")))
    fine = f"(query_absent or (not {d.any('members', wrong)} and {own} = {d.size('members')}))"
    seconds = d.replace("fragment", "^t=|s$", "")
    cut = f"(fragment_absent or ({d.matches('fragment', '^t=[0-9]{1,8}s?$')} and not {late(seconds)}))"
    return f"""
    select page_id, ref, case when not {d.matches('ref', '^[!-~]')} or {d.matches('ref', '[' + ('\\\\' if d.spark else '\\') + 't' + ('\\\\' if d.spark else '\\') + 'r' + ('\\\\' if d.spark else '\\') + 'n]')} or not {fine} or not {cut} then null
      when host = 'youtu.be' and {d.matches('path', '^/[A-Za-z0-9_-]{11}$')} and (query_absent or {videos} = 0) then substring(path, 2)
      when host in ('youtube.com', 'www.youtube.com') and path = '/watch' and not query_absent and {videos} = 1 then substring({d.element(d.keep('members', d.matches('x', '^v=')), 1)}, 3)
      when host in ('youtube.com', 'www.youtube.com') and {d.matches('path', '^/shorts/[A-Za-z0-9_-]{11}$')} and (query_absent or {videos} = 0) then substring(path, 9) end as video_id
    from (select *, {members} as members, query = '' as query_absent, not contains(ref, '#') as fragment_absent from (select page_id, ref, {d.replace(f"lower({d.extract('ref', '^[Hh][Tt][Tt][Pp][Ss]://([^/?#]*)', 1)})", ':443$', '')} as host, {d.extract('ref', '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)} as path, {d.extract('ref', '^[^?#]*[?]([^#]*)', 1)} as query, {d.extract('ref', '#(.*)$', 1)} as fragment from video_refs) a) b"""
