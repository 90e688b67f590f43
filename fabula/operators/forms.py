"""Unicode forms: canonical composition and plain letters, as joins with the standard's tables.

Texts that hold no character in doubt are in composed form already and go past; of the
others, each different run of such characters (with the one before it) is exploded once,
decomposed by a join, put in canonical order by a window, and composed by one walk. Tables come from Python's own `unicodedata`, for
characters below UPTO; those above stay as they are.
"""

import unicodedata

from ..plans.relation import quote, relation

UPTO = 0x3000
KNOWN = [chr(i) for i in range(0x80, UPTO) if unicodedata.category(chr(i)) not in ("Cn", "Cs")]
MARKS = [(c, unicodedata.combining(c)) for c in KNOWN if unicodedata.combining(c)]
DECOMPOSED = [(c, unicodedata.normalize("NFD", c)) for c in KNOWN if unicodedata.normalize("NFD", c) != c]
PLAIN = [(c, "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80")) for c in KNOWN]
PAIRS = [(unicodedata.decomposition(c).split(" "), c) for c, _ in DECOMPOSED if unicodedata.normalize("NFC", c) == c]
COMPOSED = {chr(int(a, 16)) + chr(int(b, 16)): c for (a, b), c in PAIRS}

#: All pairs, each between two marks and before what it becomes.
TABLE = "".join(f"\x01{pair}\x02{c}" for pair, c in COMPOSED.items())


def ranges(chars) -> str:
    """A class of characters for a pattern."""
    out, points = [], sorted(map(ord, chars))
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out) + "]"


#: Characters that the composed form may not hold, or not behind every other.
DOUBTFUL = ranges({c for c, _ in MARKS} | {c for c, _ in DECOMPOSED if unicodedata.normalize("NFC", c) != c} | {pair[1] for pair in COMPOSED})

#: What a text in doubt is cut into: doubtful characters with the one before them, and the rest.
OTHER = "[^" + DOUBTFUL[1:]
PIECES = f"(?s){OTHER}?{DOUBTFUL}+|{OTHER}+(?!{DOUBTFUL})|{OTHER}"


@relation(public=False)
def decompositions(d):
    return d.values("u", ("whole", "parts"), DECOMPOSED)


@relation(public=False)
def combining_classes(d):
    return d.values("u", ("mark", "class"), MARKS)


@relation(public=False)
def plain_letters(d):
    return d.values("u", ("whole", "plain"), [(c, p) for c, p in PLAIN if p])


FORMS = ("decompositions", "combining_classes")


def in_order(d, source: str, key: str, text: str) -> str:
    """The characters of texts in doubt, decomposed and in canonical order: key, place, ch, class."""
    letters = d.unnest_at(f"(select {key}, {d.tokens(text, '(?s).')} as letters from {source} where {d.matches(text, DOUBTFUL)}) a", "letters", "letter", "pos")
    parts = d.unnest_at(f"(select {key}, pos, {d.tokens('coalesce(parts, letter)', '(?s).')} as own from (select {key}, letter, pos from {letters}) b left join decompositions on whole = letter) c", "own", "ch", "nth")
    classed = f"select {key}, pos, nth, ch, coalesce(class, 0) as class from (select {key}, pos, nth, ch from {parts}) e left join combining_classes on mark = ch"
    starters = f"sum(case when class = 0 then 1 else 0 end) over (partition by {key} order by pos, nth rows between unbounded preceding and current row)"
    return f"select {key}, ch, class, cast(row_number() over (partition by {key} order by run, class, pos, nth) as int) as place from (select *, {starters} as run from ({classed}) f) g"


def composed(d, source: str, key: str, text: str) -> str:
    """key and nfc for texts in doubt, as a query that needs the relations FORMS. A mark joins
    the starter before it where both have a composed form and no mark between them has its
    class or a higher one; a starter joins only the one right before it."""
    if not d.spark:  # the oracle has a function of its own for this
        return f"select {key}, nfc_normalize({text}) as nfc from {source} where {d.matches(text, DOUBTFUL)}"
    wanted = "concat(chr(1), s.starter, x.ch, chr(2))"
    both = f"substring({quote(TABLE)}, locate({wanted}, {quote(TABLE)}) + length({wanted}), 1)"
    joins = f"((s.marks = '' or (x.class > 0 and s.last < x.class)) and locate({wanted}, {quote(TABLE)}) > 0)"
    begins = f"(x.class = 0 and not {joins})"
    state = {
        "starter": ("string", "x.ch", f"case when {joins} then {both} when x.class = 0 then x.ch else s.starter end"),
        "marks": ("string", "''", f"case when {joins} then s.marks when x.class = 0 then '' else concat(s.marks, x.ch) end"),
        "last": ("int", "0", f"case when {joins} then s.last else x.class end"),
        "done": ("string", "''", f"case when {begins} then concat(s.starter, s.marks) else '' end"),
    }
    pieces = d.unnest_at(f"(select {key}, {d.tokens(text, PIECES)} as own from {source} where {d.matches(text, DOUBTFUL)}) a", "own", "piece", "pos")
    different = f"(select distinct piece, piece as letters_of from {pieces} where {d.matches('piece', DOUBTFUL)})"
    walk = d.scan(f"({in_order(d, different, 'piece', 'letters_of')})", ["piece"], "place", ["ch", "class"], state)
    whole = f"select piece, concat({d.agg_text('done', '', 'place')}, max_by(concat(starter, marks), place)) as form from ({walk}) w group by piece"
    return f"select {key}, {d.agg_text('coalesce(w.form, p.piece)', '', 'pos')} as nfc from (select {key}, piece, pos from {pieces}) p left join ({whole}) w on w.piece = p.piece group by {key}"


@relation("names", "plain_letters")
def slugify(d):
    """Lower-case names of ASCII letters and digits joined by underscores: letters lose their
    marks and other forms (as compatibility decomposition does), other characters go;
    `documentary` where nothing is left."""
    letters = d.unnest_at(f"(select page_id, {d.tokens('name', '(?s).')} as letters from names where {d.matches('name', '[^ -~]')}) a", "letters", "letter", "pos")
    ascii_only = f"select page_id, {d.agg_text('own', '', 'pos')} as plain from (select page_id, pos, case when {d.matches('letter', '^[ -~]$')} then letter else coalesce(plain, '') end as own from (select page_id, letter, pos from {letters}) b left join plain_letters on whole = letter) c group by page_id"
    slug = f"lower({d.replace(d.replace('plain', '[^a-zA-Z0-9]+', '_'), '^_+|_+$', '')})"
    return f"select page_id, case when {slug} = '' then 'documentary' else {slug} end as slug from (select n.page_id, coalesce(a.plain, n.name) as plain from names n left join ({ascii_only}) a on a.page_id = n.page_id) t"


@relation("inventory_files", public=False)
def raw_paths(d):
    """Logical paths as file systems give them: some with letters and marks apart."""
    apart = quote("/readme.txt ré")
    return f"select file_id, bytes, kind, case when relative = 'readme.txt' then concat(path, ' ré') when relative = 'stray.dat' then concat('project/', cast(run as string), {apart}) else path end as raw from inventory_files"


@relation("raw_paths", *FORMS)
def logical_path_collision(d):
    """Files whose paths are one in composed form: one record with the sizes summed, protected
    and suspicious."""
    return f"""
    select logical, cast(sum(bytes) as bigint) as bytes, case when bool_and(kind = 'file') then 'file' else 'other' end as kind, case when count(*) > 1 then 'observation.logical_path_collision' end as rule_id, case when count(*) > 1 then 'suspicious' else 'known' end as observation
    from (select coalesce(n.nfc, r.raw) as logical, kind, bytes from raw_paths r left join ({composed(d, 'raw_paths', 'file_id', 'raw')}) n on n.file_id = r.file_id) t group by logical"""


@relation("transcript_segments", public=False)
def segment_lines(d):
    """Segments under one key, with line feeds alone (from CR LF and CR)."""
    lf = "replace(replace(text, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10))"
    return f"select concat(cast(doc_id as string), ':', cast(ordinal as string)) as segment, doc_id, ordinal, {lf} as text from transcript_segments"


@relation("segment_lines", *FORMS)
def transcript_text_normalization(d):
    """Text in composed form with line feeds alone, and whether it holds other control
    characters, which refuse it."""
    control = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
    control = control.replace("\\", "\\\\") if d.spark else control
    return f"select s.doc_id, s.ordinal, md5(coalesce(n.nfc, s.text)) as text_md5, {d.matches('s.text', control)} as refused from segment_lines s left join ({composed(d, 'segment_lines', 'segment', 'text')}) n on n.segment = s.segment"
