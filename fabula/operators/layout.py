"""Caption pages: widths, pages of any length of caption, sizes, and balanced lines.

Widths come from a relation of letters in place of a font (`glyphs`, at size 100, scaled
by size), the frame from a relation of one row a project (`page_setups`). A page is the
longest run of words that fits the frame's lines at the smallest size, found by one walk
over the words; all that follows works on pages, whose length the frame bounds.
"""

from ..plans.relation import relation

#: Widths at size 100: of narrow and wide letters, any other ('') and a space.
GLYPHS = [*((c, 30) for c in "iljtfrI.,:;'!|"), *((c, 90) for c in "mwMW@"), ("", 55), (" ", 28)]
#: Above any cost.
NEVER = "1e300"


@relation(public=False)
def glyphs(d):
    return d.values("g", ("glyph", "width"), GLYPHS)


@relation("timed", public=False)
def page_setups(d):
    """The frame of each project: the most that a line may measure, how many lines, and the
    sizes to try, from the first to the last by steps of two."""
    return "select project_id, cast(300 + 130 * (user_id % 3) as int) as max_width, cast(1 + user_id % 4 as int) as max_lines, 64 as target_size, 44 as min_size from timed group by project_id, user_id"


@relation("spoken", public=False)
def caption_words(d):
    """Words of each caption that are not blank, in their order."""
    return "select project_id, n, cast(row_number() over (partition by project_id, n order by place) as int) as place, trim(word) as word, word_start, word_end from spoken where trim(word) <> ''"


@relation("caption_words", "glyphs", public=False)
def word_widths(d):
    """The width of each different word: letters that the table lacks measure as ''."""
    letters = d.unnest(f"(select word, {d.tokens('word', '.')} as letters from (select distinct word from caption_words) w) l", "letters", "letter")
    return f"select word, cast(sum(coalesce(g.width, (select max(width) from glyphs where glyph = ''))) as bigint) as width from (select word, letter from {letters}) t left join glyphs g on g.glyph = t.letter group by word"


@relation("caption_words", "word_widths")
def text_width(d):
    """Width of each word at size 100 by the table of letters."""
    return "select c.project_id, c.n, c.place, c.word, w.width from caption_words c join word_widths w on w.word = c.word"


@relation("text_width", "glyphs")
def line_width(d):
    """Width of each caption on one line: its words and a space between each two."""
    return "select project_id, n as caption_id, cast(sum(width) + (select max(width) from glyphs where glyph = ' ') * (count(*) - 1) as bigint) as width from text_width group by project_id, n"


@relation("text_width", "page_setups", "glyphs", public=False)
def fitted_words(d):
    """Words with the frame, and their width at the smallest size that is tried (in hundredths);
    a first size under the last leaves none to try."""
    smallest = "(target_size - 2 * cast(floor((target_size - min_size) / 2e0) as int))"
    room = "(select max(width) from glyphs where glyph = ' ')"
    return f"""
    select t.project_id, n, place, word, width, {room} as space, width * {smallest} as w, {room} * {smallest} as gap, max_width * 100 as most, max_lines, target_size, min_size, max_width,
      target_size < min_size or width * {smallest} > max_width * 100 as alone
    from text_width t join page_setups p on p.project_id = t.project_id"""


@relation("fitted_words", public=False)
def page_walk(d):
    """The page of each word: a new one begins where the words since the last would need one
    line too many at the smallest size. A word too wide even for that stands alone."""
    over = "s.len + x.gap + x.w > x.most"
    begins = f"(s.alone or x.alone or ({over} and s.line >= x.max_lines))"
    state = {
        "page": ("int", "1", f"s.page + case when {begins} then 1 else 0 end"),
        "line": ("int", "1", f"case when {begins} then 1 when {over} then s.line + 1 else s.line end"),
        "len": ("bigint", "x.w", f"case when {begins} or {over} then x.w else s.len + x.gap + x.w end"),
        "alone": ("boolean", "x.alone", "x.alone"),
    }
    return d.scan("fitted_words", ["project_id", "n"], "place", ["w", "gap", "most", "max_lines", "alone"], state)


@relation("page_walk", "fitted_words", public=False)
def page_rows(d):
    """One row a page: its words, its frame, and the widths of its first 1, 2, ... words."""
    before = "over (partition by w.project_id, w.n, w.page order by w.place)"
    return f"""
    select project_id, n, page, cast(min(place) as int) as first, cast(count(*) as int) as words, {d.agg_list('word', 'place')} as word_list, {d.agg_list('upto', 'place')} as p, max(width) as widest, bool_or(alone) as alone,
      max(space) as space, max(max_width) as max_width, max(max_lines) as max_lines, max(target_size) as target_size, max(min_size) as min_size
    from (select w.project_id, w.n, w.page, w.place, w.alone, f.word, f.width, f.space, f.max_width, f.max_lines, f.target_size, f.min_size, cast(sum(f.width) {before} as bigint) as upto
      from page_walk w join fitted_words f on f.project_id = w.project_id and f.n = w.n and f.place = w.place) t group by project_id, n, page"""


@relation("page_rows", "caption_words", "captions")
def paginate_words(d):
    """Pages of each caption: the words [first, last) from 0, and when the page is shown, from
    its first word's start to the next one's; the caption's own bounds at both ends."""
    over = "over (partition by p.project_id, p.n order by p.page)"
    return f"""
    select p.project_id, p.n as caption_id, page, p.first - 1 as first, p.first - 1 + p.words as last, alone, case when page = 1 then caption_start else word_start end as shown, coalesce(lead(word_start) {over}, caption_end) as hidden
    from page_rows p join caption_words w on w.project_id = p.project_id and w.n = p.n and w.place = p.first join captions c on c.project_id = p.project_id and c.caption_id = p.n"""


def width_of(d, i: str, j: str) -> str:
    """The words after the i-th up to the j-th on one line, at size 100."""
    before = f"case when {i} = 0 then 0 else {d.element('p', i)} end"
    return f"({d.element('p', j)} - {before} + space * ({j} - {i} - 1))"


@relation("page_rows", public=False)
def page_sizes(d):
    """The least width that holds a page in its lines (the smallest widest line over all breaks, a
    line more at a time), and the first size at which that width fits the frame. A word that
    stands alone shrinks by ones, down to 11."""
    last = d.min_of(d.each(d.range("1", "j - 1"), "i", f"greatest({d.element('m', 'i')}, {width_of(d, 'i', 'j')})"))
    more = d.each(d.range("1", "words"), "j", f"case when j = 1 then {d.element('m', 'j')} else least({d.element('m', 'j')}, {last}) end")
    least = d.fold(d.range("2", "least(max_lines, words)"), d.each(d.range("1", "words"), "j", width_of(d, "0", "j")), "m", "k", more)
    steps = "greatest(0e0, ceil((target_size * need - 100 * max_width) * 1e0 / (2 * need)))"
    alone = "least(min_size, greatest(11, cast(floor(max_width * 100e0 / widest) as int)))"
    return f"select *, case when alone then {alone} else cast(target_size - 2 * {steps} as int) end as size from (select *, case when alone then null else {d.element(least, 'words')} end as need from page_rows) t"


@relation("page_sizes")
def fit_page(d):
    """The largest size at which each page fits its frame."""
    return "select project_id, n as caption_id, page, words, need, size from page_sizes"


@relation("page_sizes", public=False)
def page_lines(d):
    """levels: for each number of lines, the cheapest way to end a line after the j-th word, and
    where the line before ends. A line costs the square of what it leaves free, more for a
    word alone, and for differing in length from the line before (on its cheapest way)."""
    at = lambda i, j: f"({width_of(d, i, j)} * size / 100e0)"
    alone = lambda i: f"case when j - {i} = 1 and words > 2 then max_width * max_width * 0.35e0 else 0e0 end"
    square = lambda i: f"(max_width - {at(i, 'j')}) * (max_width - {at(i, 'j')})"
    first = d.each(d.range("1", "words"), "j", d.struct(c=f"case when {at('0', 'j')} <= max_width then {square('0')} + {alone('0')} else {NEVER} end", i="0"))
    before = f"{d.element(d.element('a', d.size('a')), 'i')}"
    cost = f"{before}.c + {square('i')} + {alone('i')} + abs({at(f'{before}.i', 'i')} - {at('i', 'j')}) * max_width * 0.18e0"
    ways = d.each(d.range("1", "j - 1"), "i", d.struct(c=f"case when {before}.c < {NEVER} and {at('i', 'j')} <= max_width then {cost} else {NEVER} end", i="i"))
    level = d.each(d.range("1", "words"), "j", d.min_of(d.append(ways, d.struct(c=NEVER, i="-1"))))
    levels = d.fold(d.range("2", "least(max_lines, words)"), d.array(first), "a", "k", d.append("a", level))
    return f"select project_id, n, page, words, word_list, alone, size, {levels} as levels from page_sizes"


@relation("page_lines")
def split_lines(d):
    """Each page's lines: the number of words on each, the text with a line feed between lines,
    and the cost; the fewest lines of several as cheap. A word that stands alone is its line."""
    ends = d.each(d.range("1", d.size("levels")), "k", d.struct(c=f"{d.element(d.element('levels', 'k'), 'words')}.c", k="k"))
    back = d.fold(d.range("0", "lines - 1"), d.array("words"), "b", "s", d.append("b", f"{d.element(d.element('levels', 'lines - s'), d.element('b', d.size('b')))}.i"))
    counts = d.each(d.range("1", "lines"), "k", f"{d.element('b', 'lines - k + 1')} - {d.element('b', 'lines - k + 2')}")
    text = d.join(d.each(d.range("1", "lines"), "k", d.join(d.slice("word_list", f"{d.element('b', 'lines - k + 2')} + 1", f"({d.element('b', 'lines - k + 1')} - {d.element('b', 'lines - k + 2')})"), " ")), "\n")
    return f"""
    select project_id, n as caption_id, page, size, lines as n_lines, {d.join(d.each(counts, 'x', 'cast(x as string)'), ',')} as line_words, {text} as layout, case when not alone then round(cost, 3) end as cost
    from (select *, {back} as b from (select *, case when alone then 1 else best.k end as lines, best.c as cost from (select *, {d.min_of(ends)} as best from page_lines) t) u) v"""
