"""Words, captions, beats and frames on one timeline."""

from ..plans.relation import WHITE, relation
from .text import STOP_SEMANTIC, WORD_SEMANTIC, four, words_in

#: Words that begin a turn of the story.
TURNS = (
    "but", "however", "yet", "instead", "meanwhile", "later", "finally", "eventually", "although", "despite", "then", "suddenly", "because",
    "therefore", "men", "dock", "däremot", "samtidigt", "senare", "slutligen", "plötsligt", "därför",
)


@relation("spoken", public=False)
def recognised(d):
    """Words of segments as a recogniser gives them: some blank, some without a start or an end."""
    return "select project_id, n, t as segment_start, word_index, case when word_index % 41 = 7 then ' ' else concat(' ', word) end as word, case when word_index % 29 <> 3 then word_start end as word_start, case when word_index % 31 = 4 then null when word_index % 37 = 5 then word_start else word_end end as word_end from spoken"


@relation("recognised")
def explode_words(d):
    """Timed words, blank ones left out: without a start they begin with their segment, without
    an end they last 0.18; one that does not end after it starts ends 0.12 later."""
    cleaned = f"trim({d.replace('word', WHITE.replace(chr(92), chr(92) * 2) if d.spark else WHITE, ' ')})"
    return f"""
    select project_id, word_index, word, s as word_start, case when e <= s then s + 0.12e0 else e end as word_end
    from (select *, coalesce(word_end, s + 0.18e0) as e from (select project_id, word_index, {cleaned} as word, coalesce(word_start, segment_start) as s, word_end from recognised) a) t where word <> ''"""


@relation("timed")
def interpolate_words(d):
    """Segments without words: their text spread evenly over their length, 0.2 at least."""
    step = "greatest(0.2e0, value / 100e0) * {} / size"
    return f"select project_id, n, place, word, round(t + {step.format('(place - 1)')}, 9) as word_start, round(t + {step.format('place')}, 9) as word_end from (select project_id, n, t, value, word, place, {d.size('parts')} as size from {d.unnest_at('(select project_id, n, t, value, ' + d.split('phrase', ' ') + ' as parts from timed)', 'parts', 'word', 'place')})"


@relation("spoken")
def flatten_caption_words(d):
    """Words of all captions by start and end."""
    return "select project_id, word, word_start, cast(row_number() over (partition by project_id order by word_start, word_end, word_index) as int) as place from spoken"


@relation("spoken", public=False)
def raw_words(d):
    """Words as a recogniser gives them: overlapping, some very short, some hurried, some in a
    loop, some only a hyphen or begun with one."""
    return """
    select project_id, word_index as i, case when n % 11 = 0 and place = 3 then '-' when n % 7 = 0 and place = 2 then concat('-', word) when n % 13 = 0 then case place % 2 when 1 then 'Over' else 'again,' end
        when n % 17 = 0 then case place % 3 when 1 then 'one' when 2 then 'two' else 'three' end when n % 19 = 0 then case place % 4 when 1 then 'as' when 2 then 'it' when 3 then 'was' else 'said' end else word end as word,
      case when n % 5 = 0 then t + (word_start - t) * 0.4e0 else word_start end as s,
      case when n % 9 = 0 then word_start + 0.08e0 when n % 5 = 0 then t + (word_end - t) * 0.4e0 when place % 6 = 0 then word_start + 0.05e0 else word_end + 0.03e0 end as e from spoken"""


@relation("raw_words")
def drop_micro_words(d):
    """Words under 0.075 go, unless they come first."""
    return "select project_id, i, word, s, e from (select *, row_number() over (partition by project_id order by s, e, i) as r from raw_words) t where r = 1 or e - s >= 0.075e0"


@relation("drop_micro_words")
def monotonic_words(d):
    """No word starts over 0.015 before the last one's end, nor lasts under 0.08: in closed
    form, a running maximum."""
    w = "over (partition by project_id order by r)"
    return f"""
    select project_id, cast(r as int) as place, word, round(greatest(s, coalesce(lag(word_end) {w} - 0.015e0, s)), 4) as word_start, round(word_end, 4) as word_end
    from (select *, greatest(0e0, max(greatest(e, s + 0.08e0) - 0.065e0 * r) over (partition by project_id order by r rows between unbounded preceding and current row)) + 0.065e0 * r as word_end
      from (select *, row_number() over (partition by project_id order by s, e, i) as r from drop_micro_words)) t"""


@relation("monotonic_words")
def hyphen_merge(d):
    """Words that begin with a hyphen, and bare hyphens, join the word before, up to their end."""
    island = "cast(sum(case when place > 1 and word like '-%' then 0 else 1 end) over (partition by project_id order by place rows between unbounded preceding and current row) as int)"
    return f"select project_id, place, min(word_start) as s, max(word_end) as e, {d.agg_text('word', '', 'nth')} as word from (select project_id, place as nth, word, word_start, word_end, {island} as place from monotonic_words) t group by project_id, place"


@relation("hyphen_merge")
def micro_run(d):
    """Where the sixth word in a row of at most 0.085 starts, the first time."""
    w = "over (partition by project_id order by place rows between 5 preceding and current row)"
    return f"select project_id, min(s) as near from (select project_id, s, sum(case when e - s <= 0.085e0 then 1 else 0 end) {w} as n from hyphen_merge) t where n = 6 group by project_id"


@relation("hyphen_merge")
def repeat_ngram(d):
    """Where a phrase of 2, 3 or 4 words first comes twice in a row, by letters, digits and
    apostrophes alone; words without any never count."""
    lead = lambda k: f"lead(w, {k}) over (partition by project_id order by place)"
    names = ["w", *(f"w{k}" for k in range(1, 8))]
    size = lambda k: f"min(case when {' and '.join(f'{names[i]} = {names[i + k]}' for i in range(k))} and {' and '.join(f'{names[i]} <> {quote_empty}' for i in range(k))} then s end) as size{k}"
    quote_empty = "''"
    cols = ", ".join(f"{lead(k)} as w{k}" for k in range(1, 8))
    clean = d.replace("lower(word)", "[^a-z0-9'']+", "")
    return f"select * from (select project_id, {', '.join(map(size, (2, 3, 4)))} from (select project_id, s, w, {cols} from (select project_id, place, s, {clean} as w from hyphen_merge) a) t group by project_id) u where size2 is not null or size3 is not null or size4 is not null"


@relation("hyphen_merge")
def word_burst(d):
    """Where eight words or more within 0.8 first start."""
    w = "over (partition by project_id order by place rows between current row and 7 following)"
    return f"select project_id, min(s) as near from (select project_id, s, count(*) {w} as n, max(e) {w} as last_end from hyphen_merge) t where n = 8 and last_end - s <= 0.8e0 group by project_id"


@relation("scenes", "hyphen_merge", "repeat_ngram", "word_burst", "micro_run")
def transcript_quality(d):
    """What looks like a recogniser's invention, in order: an empty transcript, repeated
    phrases, implausible bursts, runs of tiny words."""
    issues = ", ".join(["case when n is null then 'empty transcript' end", *(f"case when size{k} is not null then 'repeated {k}-word phrase' end" for k in (2, 3, 4)), "case when b.near is not null then 'implausible word burst' end", "case when m.near is not null then 'micro-timestamp run' end"])
    return f"""
    select p.project_id, concat_ws(', ', {issues}) as issues, least(size2, size3, size4, b.near, m.near) as first_near from (select distinct project_id from scenes) p left join (select project_id, count(*) as n from hyphen_merge group by project_id) w on w.project_id = p.project_id
    left join repeat_ngram r on r.project_id = p.project_id left join word_burst b on b.project_id = p.project_id left join micro_run m on m.project_id = p.project_id"""


@relation("spoken", public=False)
def sentence_words(d):
    """Words of all captions by start and end, blank ones left out, with those that end a
    sentence: at . ! or ?, a closing quote behind it or not."""
    ends = d.matches("word", "[.!?][\"'']?$")
    return f"""
    select *, coalesce(sum(ends) over (partition by project_id order by word_index rows between unbounded preceding and 1 preceding), 0) as s_raw
    from (select project_id, word, word_start, word_end, row_number() over (partition by project_id order by word_start, word_end, word_index) as word_index, case when {ends} then 1 else 0 end as ends from (select project_id, {d.strip('word')} as word, word_start, word_end, word_index from spoken) a where word <> '') t"""


@relation("sentence_words")
def sentence_split(d):
    """Sentences of timed words, from their first word's start to their last one's end."""
    return f"select project_id, cast(s_raw as int) as sentence, min(word_start) as s, {'max_by' if d.spark else 'arg_max'}(word_end, word_index) as e, {d.agg_text('word', ' ', 'word_index')} as text from sentence_words group by project_id, s_raw"


@relation("sentence_split", public=False)
def sentence_turns(d):
    first = d.element(d.keep(d.tokens("lower(text)", WORD_SEMANTIC), f"length(x) > 1 and x not in {words_in(STOP_SEMANTIC)}"), 1)
    return f"select *, coalesce({first}, '') in {words_in(TURNS)} or {d.matches('lower(text)', '^(in|under|during|after|before) (19|20)[0-9][0-9]([^0-9a-z_åäö]|$)')} as strong from sentence_split"


@relation("sentence_turns", public=False)
def numbered_sentences(d):
    return "select *, sentence + 1 as place from sentence_turns"


@relation("numbered_sentences", public=False)
def beat_walk(d):
    begins = "(s.s0 is null or s.e1 - s.s0 >= 12.5e0 or (s.e1 - s.s0 >= 4.5e0 and x.strong) or (s.e1 - s.s0 >= 7.5e0 and x.e - s.s0 > 12.5e0))"
    state = {"beat": ("int", "1", f"s.beat + case when {begins} then 1 else 0 end"), "s0": ("double", "x.s", f"case when {begins} then x.s else s.s0 end"), "e1": ("double", "x.e", "x.e")}
    return d.scan("numbered_sentences", ["project_id"], "place", ["s", "e", "strong"], state)


@relation("beat_walk")
def beat_segmentation(d):
    """Sentences grouped to beats: a turn ends a group of 4.5, 12.5 is the most."""
    return "select project_id, place - 1 as sentence, beat from beat_walk"


@relation("scenes", public=False)
def project_lengths(d):
    """How long each project's audio is."""
    return "select project_id, max(scene_end) as duration from scenes group by project_id"


@relation("project_lengths", "beat_segmentation", "sentence_split")
def beat_align(d):
    """Beats with contiguous bounds, from 0 to the end of the audio: each ends where the next
    begins. A project without words is one beat, `documentary`."""
    return f"""
    select p.project_id, coalesce(beat, 1) as beat, case when coalesce(beat, 1) = 1 then 0e0 else s end as beat_start, coalesce(lead(s) over (partition by p.project_id order by beat), duration) as beat_end, coalesce(text, 'documentary') as text
    from project_lengths p left join (select b.project_id, beat, min(s) as s, {d.agg_text('text', ' ', 't.sentence')} as text from beat_segmentation b join sentence_split t on t.project_id = b.project_id and t.sentence = b.sentence group by b.project_id, beat) u on u.project_id = p.project_id"""


@relation("beat_align")
def drop_short_beats(d):
    """Beats of half a second or more."""
    return "select project_id, beat, beat_start, beat_end, text from beat_align where beat_end - beat_start >= 0.5e0"


@relation("spoken", public=False)
def caption_walk(d):
    begins = "(s.n >= 5 or x.word_end - s.s0 > 2.4e0 or x.word_start - s.e1 > 0.55e0 or (s.stop and s.n >= 2))"
    stop = d.matches("x.word", "[.!?]$")
    state = {"caption": ("int", "1", f"s.caption + case when {begins} then 1 else 0 end"), "n": ("int", "1", f"case when {begins} then 1 else s.n + 1 end"),
             "s0": ("double", "x.word_start", f"case when {begins} then x.word_start else s.s0 end"), "e1": ("double", "x.word_end", "x.word_end"), "stop": ("boolean", stop, stop)}
    return d.scan("spoken", ["project_id"], "word_index", ["word_start", "word_end", "word"], state)


@relation("caption_walk")
def caption_segmentation(d):
    """Words grouped to captions: at most 5 words, 2.4 long, gaps of 0.55; a sentence's end breaks."""
    return "select project_id, word_index, caption from caption_walk"


@relation("caption_walk", public=False)
def caption_groups(d):
    return "select project_id, caption, cast(count(*) as int) as n, min(s0) as s0, max(e1) as e1 from caption_walk group by project_id, caption"


@relation("caption_groups")
def caption_merge_small(d):
    """Captions of one word join the one before, merged or not, where it then has at most six
    words and lasts at most 2.75."""
    joins = "(x.n < 2 and s.size + x.n <= 6 and x.e1 - s.began <= 2.75e0)"
    state = {"merged": ("int", "1", f"s.merged + case when {joins} then 0 else 1 end"), "size": ("int", "x.n", f"case when {joins} then s.size + x.n else x.n end"), "began": ("double", "x.s0", f"case when {joins} then s.began else x.s0 end")}
    return f"select project_id, caption, merged, size from ({d.scan('caption_groups', ['project_id'], 'caption', ['n', 's0', 'e1'], state)}) w"


@relation("caption_segmentation", "caption_merge_small", "spoken")
def caption_coverage(d):
    """Whether the words of all captions are as many as were spoken."""
    return """
    select s.project_id, s.words, coalesce(c.words, 0) as caption_words, coalesce(c.words, 0) = s.words as covered, coalesce(n_captions, 0) as n_captions from (select project_id, cast(count(*) as bigint) as words from spoken group by project_id) s
    left join (select g.project_id, cast(count(*) as bigint) as words, cast(count(distinct merged) as bigint) as n_captions from caption_segmentation g join caption_merge_small m on m.project_id = g.project_id and m.caption = g.caption group by g.project_id) c on c.project_id = s.project_id"""


#: Interval joins meet in cells of the time axis of so many seconds.
CELL = "16e0"


def cell(t: str) -> str:
    return f"cast(floor({t} / {CELL}) as int)"


def in_cells(d, source: str, start: str, end: str) -> str:
    """Intervals once for each cell that they touch, as a table expression: a point meets
    those of its own cell alone, so a join by project and cell is linear in the rows."""
    return d.unnest(f"(select *, {d.range(cell(start), cell(end))} as cells from {source}) c", "cells", "cell")


@relation("captions", "scenes")
def caption_scene_interval_join(d):
    """Captions with the scene that their midpoint falls in."""
    return f"""
    select c.project_id, caption_id, scene_index from (select project_id, caption_id, m, {cell('m')} as cell from (select *, (caption_start + caption_end) * 0.5e0 as m from captions) a) c
    join (select project_id, scene_index, scene_start, scene_end, cell from {in_cells(d, 'scenes', 'scene_start', 'scene_end')}) s on s.project_id = c.project_id and s.cell = c.cell and m >= scene_start and m < scene_end"""


@relation("scenes", public=False)
def scene_middles(d):
    return f"select project_id, scene_index, scene_start, scene_end, m, {cell('m')} as cell from (select *, (scene_start + scene_end) * 0.5e0 as m from scenes) s"


@relation("scene_middles", "analyses")
def analysis_for_scene(d):
    """The analysis that covers a scene's midpoint, the earliest of several."""
    return f"select project_id, scene_index, analysis_start, focus_y, face_count, source from (select s.project_id, scene_index, a.analysis_start, focus_y, face_count, source, row_number() over (partition by s.project_id, scene_index order by a.analysis_start, a.analysis_end) as r from scene_middles s join {in_cells(d, 'analyses', 'analysis_start', 'analysis_end').removesuffix('_u')} a on a.project_id = s.project_id and a.cell = s.cell and analysis_start <= m and analysis_end > m) t where r = 1"


@relation("scene_middles", "analyses", public=False)
def nearest_analyses(d):
    """The analyses before and after each scene's midpoint by their own (the first of several
    at one): scenes and analyses in one order of time, and what came last on either side."""
    union = "select project_id, m as t, 1 as kind, scene_index, cast(null as int) as n, cast(null as double) as middle from scene_middles union all select project_id, (analysis_start + analysis_end) * 0.5e0, 0, null, cast(n as int), (analysis_start + analysis_end) * 0.5e0 from analyses"
    side = lambda c, way: d.last_known(c, f"partition by project_id order by t{way}, kind, n desc rows between unbounded preceding and current row")
    columns = ", ".join(f"{side(c, way)} as {c}_{name}" for c in ("n", "middle") for name, way in (("before", ""), ("after", " desc")))
    closer = "n_after is null or abs(middle_before - t) < abs(middle_after - t) or (abs(middle_before - t) = abs(middle_after - t) and n_before < n_after)"
    return f"select project_id, scene_index, case when n_before is not null and ({closer}) then n_before else n_after end as n from (select project_id, t, kind, scene_index, {columns} from ({union}) u) v where kind = 1"


@relation("scene_middles", "nearest_analyses", "analyses", public=False)
def scene_analyses(d):
    """The analysis of each scene, with its focus and faces: the first that covers its midpoint,
    else the nearest by midpoint."""
    covering = f"select s.project_id, scene_index, min(a.n) as n from scene_middles s join {in_cells(d, 'analyses', 'analysis_start', 'analysis_end').removesuffix('_u')} a on a.project_id = s.project_id and a.cell = s.cell and analysis_start <= m and analysis_end > m group by s.project_id, scene_index"
    return f"""
    select s.project_id, s.scene_index, scene_start, scene_end, a.analysis_start, c.n is not null as covers, focus_x, focus_y, face_count, subject_scale, confidence, source from scene_middles s left join ({covering}) c on c.project_id = s.project_id and c.scene_index = s.scene_index
    join nearest_analyses b on b.project_id = s.project_id and b.scene_index = s.scene_index join analyses a on a.project_id = s.project_id and a.n = coalesce(c.n, b.n)"""


@relation("scene_analyses")
def semantic_to_analysis(d):
    """Scenes with the analysis that takes their times over, and whether it covers their midpoint."""
    return "select project_id, scene_index, scene_start, scene_end, analysis_start, covers from scene_analyses"


@relation("captions", "spoken")
def active_caption(d):
    """The caption on screen at each word's start, ends included: the first that has not ended."""
    return f"select w.project_id, word_index, min(caption_id) as caption_id from (select project_id, word_index, word_start, {cell('word_start')} as cell from spoken) w join {in_cells(d, 'captions', 'caption_start', 'caption_end').removesuffix('_u')} c on c.project_id = w.project_id and c.cell = w.cell and word_start >= caption_start and word_start <= caption_end group by w.project_id, word_index"


@relation("captions", "spoken")
def active_word(d):
    """The word shown half a second into each caption, from 0: the first that has begun and has
    ended at most 0.04 ago, else the last that has begun, else the first."""
    at = "caption_start + 0.5e0"
    return f"""
    select c.project_id, caption_id, cast(coalesce(min(case when word_start <= {at} and {at} <= word_end + 0.04e0 then place end), max(case when word_start <= {at} then place end), 1) - 1 as int) as active
    from captions c join spoken w on w.project_id = c.project_id and w.n = c.caption_id group by c.project_id, caption_id"""


@relation("scenes", "analysis_for_scene")
def required_position(d):
    """Where captions must stand to keep faces clear, and why; null where nothing is known."""
    y = "concat(cast(cast(floor(round(focus_y * 100e0) / 100e0) as int) as string), '.', lpad(cast(cast(round(focus_y * 100e0) as int) % 100 as string), 2, '0'))"
    label = "case when face_count > 0 then 'Face' else 'Primary subject' end"
    return f"""
    select s.project_id, s.scene_index, case when focus_y >= 0.55e0 then 'top' when focus_y <= 0.45e0 then 'bottom' when source in ('face', 'saliency') then 'bottom' end as position,
      case when focus_y >= 0.55e0 then concat({label}, ' detected in the lower frame at y=', {y}, '.') when focus_y <= 0.45e0 then concat({label}, ' detected in the upper frame at y=', {y}, '.')
        when source in ('face', 'saliency') then concat({label}, ' detected near center at y=', {y}, '; bottom is the safer edge.') else 'No reliable face or subject metadata is available.' end as reason,
      coalesce(face_count, 0) > 0 as face, coalesce(source in ('face', 'saliency'), false) as subject from scenes s left join analysis_for_scene a on a.project_id = s.project_id and a.scene_index = s.scene_index"""


@relation("timed", public=False)
def caption_settings(d):
    """Each project's default position, and whether scenes may move captions away from it."""
    return "select project_id, case when user_id % 5 = 2 then 'top' else 'bottom' end as default_position, user_id % 7 <> 3 as allow_reposition from timed group by project_id, user_id"


@relation("required_position", "caption_settings")
def caption_position_carry(d):
    """The position in force: the last one required, else the default; always the default where
    scenes may not move it."""
    carried = d.last_known("r.position", "partition by r.project_id order by r.scene_index rows between unbounded preceding and current row")
    return f"select r.project_id, r.scene_index, default_position, case when allow_reposition then coalesce({carried}, default_position) else default_position end as position from required_position r join caption_settings c on c.project_id = r.project_id"


@relation("caption_position_carry")
def placement_stability(d):
    """Whether captions moved from the scene before, at first from the default."""
    return "select project_id, scene_index, position, position <> coalesce(lag(position) over (partition by project_id order by scene_index), default_position) as moved from caption_position_carry"


#: Words that are never highlighted.
STOP_HIGHLIGHT = ("about", "after", "again", "because", "before", "could", "every", "first", "from", "have", "into", "more", "other", "over", "said", "some", "than", "that", "their", "them", "then", "there", "these", "they", "this", "through", "under", "very", "were", "what", "when", "where", "which", "while", "with", "would", "your")


@relation("scene_words", public=False)
def match_terms(d):
    """The six commonest content words of each scene, which stand for its match terms."""
    return "select project_id, scene_index, word as term from (select project_id, scene_index, word, row_number() over (partition by project_id, scene_index order by c desc, word) as r from scene_words) t where r <= 6"


@relation("caption_scene_interval_join", "spoken", "match_terms")
def highlight_topk(d):
    """The first two distinct words of a scene's captions that are a year or, with five
    letters or more, a match term."""
    clean = d.replace("word", "^[^A-Za-z0-9]+|[^A-Za-z0-9-]+$", "")
    return f"""
    select project_id, scene_index, clean as word, cast(r as int) as place from (select project_id, scene_index, clean, row_number() over (partition by project_id, scene_index order by first_at) as r
      from (select w.project_id, w.scene_index, lower(clean) as folded, min(word_index) as first_at, {'min_by' if d.spark else 'arg_min'}(clean, word_index) as clean from (select s.project_id, c.scene_index, word_index, {clean} as clean from caption_scene_interval_join c join spoken s on s.project_id = c.project_id and s.n = c.caption_id) w
        left join match_terms m on m.project_id = w.project_id and m.scene_index = w.scene_index and m.term = lower(clean) where {d.matches('clean', '^(19|20)[0-9][0-9]$')} or (m.term is not null and length(clean) >= 5 and lower(clean) not in {words_in(STOP_HIGHLIGHT)}) group by w.project_id, w.scene_index, lower(clean)) f) t where r <= 2"""


@relation("spoken", public=False)
def wrap_walk(d):
    begins = "(s.len > 0 and s.len + length(x.word) + 1 > 24 and s.line < 2)"
    state = {"line": ("int", "1", f"s.line + case when {begins} then 1 else 0 end"), "len": ("int", "length(x.word)", f"case when {begins} then length(x.word) else s.len + length(x.word) + 1 end")}
    return d.scan("spoken", ["project_id", "n"], "place", ["word"], state)


@relation("wrap_walk")
def wrap_caption(d):
    """Caption words wrapped at 24 characters to two lines, of which the last takes what is
    left: the numbers of the words on each line."""
    return f"select project_id, n as caption_id, cast(max(line) as int) as n_lines, {d.agg_text('cast(place - 1 as string)', ' ', 'place')} as words, cast(count_if(line = 1) as int) as first_line, cast(max(len) as int) as longest from wrap_walk group by project_id, n"


@relation("required_position", "placement_stability", "highlight_topk", "caption_scene_interval_join", "wrap_caption")
def caption_plan(d):
    """The caption layout of each scene: place, sizes, highlights, layouts and the reason."""
    n = "chr(34)"
    quoted = f"concat({n}, word, {n})"
    return f"""
    select s.project_id, s.scene_index + 1 as scene, s.position, case s.position when 'top' then 0.18e0 when 'center' then 0.5e0 else 0.72e0 end as vertical_anchor, 0.82e0 as max_width, 2 as max_lines, 0.08e0 as safe_margin, coalesce(words, '') as highlight_words, '#FFD54A' as highlight_color,
      true as contrast_required, true as outline_recommended, coalesce(n_captions, 0) as caption_count, r.face as face_avoidance_applied, r.subject as subject_avoidance_applied, coalesce(layouts, '') as caption_layouts,
      concat_ws(' ', r.reason, concat(upper(substring(s.position, 1, 1)), substring(s.position, 2), ' placement chosen.'), 'Up to 2 lines with 0.82 maximum width preserve reading comfort.', case when words is null then 'No conservative highlight candidate was found.' else concat('Conservative highlights: ', quoted, '.') end,
        'Safe margin 0.08 maintained.', case when moved then 'Placement moved only to avoid detected visual content.' else 'Placement remains stable.' end) as reason
    from placement_stability s join required_position r on r.project_id = s.project_id and r.scene_index = s.scene_index
    left join (select project_id, scene_index, {d.agg_text('word', ',', 'place')} as words, {d.agg_text(quoted, ', ', 'place')} as quoted from highlight_topk group by project_id, scene_index) h on h.project_id = s.project_id and h.scene_index = s.scene_index
    left join (select c.project_id, c.scene_index, cast(count(*) as int) as n_captions, {d.agg_text("concat(cast(c.caption_id as string), ':', cast(first_line as string))", ',', 'c.caption_id')} as layouts from caption_scene_interval_join c join wrap_caption w on w.project_id = c.project_id and w.caption_id = c.caption_id group by c.project_id, c.scene_index) l on l.project_id = s.project_id and l.scene_index = s.scene_index"""


@relation("embeddings", public=False)
def frames(d):
    """Sampled frames of clips, two a second, with non-negative histograms (every fourth frame
    has the bins of another kind of picture) and a measure of detail."""
    other = d.map("embedding", "case when x > 0 then x * 1e0 else 0e0 end")
    like = d.map("embedding", "0.2e0 + abs(x * 1e0)")
    return f"""
    select *, {d.sum_of('hist')} as total, cast(row_number() over (partition by clip order by vec_id) as int) as frame, (row_number() over (partition by clip order by vec_id) - 1) * 0.5e0 as t
    from (select vec_id, concat(cast(label as string), '-', cast(cast(floor(vec_id / 400e0) as int) as string)) as clip, case when vec_id % 9 < 4 then {other} else {like} end as hist, vec_id * 37 % 101 as detail from embeddings) e"""


@relation("frames")
def bhattacharyya(d):
    """Distance of each frame's whole histogram from the one before in its clip, 0 at first."""
    over = "over (partition by clip order by frame)"
    root = d.sum_of(d.zip("hist", "p", "sqrt(coalesce(x, 0e0) * coalesce(y, 0e0))"))
    return f"select vec_id, clip, frame, t, detail, case when p is null then 0e0 else round(sqrt(greatest(0e0, 1e0 - {root} / sqrt(total * p_total))), 6) end as distance from (select *, lag(hist) {over} as p, lag(total) {over} as p_total from frames) t"


@relation("bhattacharyya", public=False)
def cut_walk(d):
    cut = "(x.distance > 0.53e0 and x.t - s.began >= 1.2e0)"
    state = {"scene": ("int", "1", f"s.scene + case when {cut} then 1 else 0 end"), "began": ("double", "x.t", f"case when {cut} then x.t else s.began end")}
    return d.scan("bhattacharyya", ["clip"], "frame", ["distance", "t"], state)


@relation("cut_walk", "bhattacharyya")
def cut_detection(d):
    """Scenes of each clip: a cut needs a distance over 0.53 and 1.2 since the last one; the
    frame of most detail, the first of several, stands for a scene. A last scene of 0.05 or
    less is none."""
    return """
    select clip, scene, began, coalesce(lead(began) over (partition by clip order by scene), last_t) as ended, representative from (select w.clip, scene, min(began) as began, max(t) + 0.5e0 as last_t, max(case when r = 1 then vec_id end) as representative
      from (select w.clip, w.frame, scene, began, vec_id, t, row_number() over (partition by w.clip, scene order by detail desc, w.frame) as r from cut_walk w join bhattacharyya b on b.clip = w.clip and b.frame = w.frame) w group by w.clip, scene) u where last_t > began + 0.05e0"""


@relation("faces")
def face_centroid(d):
    """Centre of the faces of each frame, weighted by area, with confidence and the share of the frame they fill."""
    x, y, scale = four("sum((x + w / 2e0) / 1920e0 * (w * h)) / sum(w * h)"), four("sum((y + h / 2e0) / 1080e0 * (w * h)) / sum(w * h)"), four("least(1e0, sum(w * h) / (1920e0 * 1080e0))")
    return f"select project_id, n, {x} as focus_x, {y} as focus_y, least(1e0, 0.72e0 + 0.08e0 * count(*)) as confidence, cast(count(*) as int) as face_count, {scale} as subject_scale from faces group by project_id, n"


@relation("timed")
def legacy_zoom(d):
    """Zoom at each event: in and out by turns, eased."""
    return "select project_id, event_id, round(case when n % 2 = 0 then 1e0 + 0.12e0 * x else 1.12e0 - 0.12e0 * x end, 6) as zoom from (select *, t - floor(t) as x from timed) t"
