"""Candidate images: profiles from the parts, scores against scenes, ranking."""

from ..plans.relation import relation
from .text import STOP_SEMANTIC, WORD_SEMANTIC, four, words_in

#: Terms that speak for and against a documentary picture.
DOCUMENTARY = (
    "archive", "court", "courtroom", "document", "evidence", "hospital", "investigation", "medical", "news", "photograph", "real", "records",
    "report", "trial",
)
GENERATED = ("ai generated", "artificial intelligence", "distorted anatomy", "extra fingers", "unrealistic lighting", "synthetic", "render", "illustration", "fantasy")


def content(d, text):
    return d.keep(d.tokens(f"lower({text})", WORD_SEMANTIC), f"length(x) > 1 and x not in {words_in(STOP_SEMANTIC)}")


#: Parts stand for pictures, some thirteen a user.
USER = "cast(floor(p_partkey * 0.075e0) as bigint)"
FILE = "concat(case when p_partkey % 3 = 0 then 'Img' else 'img' end, '_', cast(p_partkey as string), '.jpg')"


@relation("part", public=False)
def image_files(d):
    """The images found in each user's folder, with their pictures' statistics."""
    return f"""
    select p_partkey as image_id, {USER} as user_id, {FILE} as file, 600 + (p_partkey % 17) * 80 as width, 500 + (p_partkey % 13) * 120 as height, 20e0 + (p_partkey % 60) as contrast,
      40e0 + (p_partkey % 170) as brightness, 4e0 + (p_partkey % 19) as edge_mean, 3e0 + (p_partkey % 23) as center_edges, (p_partkey % 400) * 1e0 as quietest from part"""


@relation("part", public=False)
def manifest_items(d):
    """What users' manifests say of files: description, tags, texts seen in them, priority,
    preferred place and realism. One in nine has no description, one in seven no place; some
    images are not listed."""
    kinds = ("city street crowd", "hospital doctor record", "map border route", "court evidence report", "quiet room portrait", "archive photograph footage", "danger crisis risk")
    pick = " ".join(f"when {i} then '{k}'" for i, k in enumerate(kinds))
    return f"""
    select {USER} as user_id, {FILE} as file, case when p_partkey % 9 = 0 then '' else concat(p_name, ' ', case p_partkey % {len(kinds)} {pick} end) end as description, case when p_partkey % 4 = 0 then {d.strings('records', 'streets')} else {d.no_strings()} end as tag_list,
      case when p_partkey % 10 = 5 then {d.array("concat('BREAKING NEWS ', upper(p_brand))")} else {d.no_strings()} end as ocr_list, p_size / 25e0 - 0.8e0 as priority, case when p_partkey % 7 <> 1 then (p_partkey % 11) / 10e0 end as preferred_phase, case when p_partkey % 6 = 2 then (p_partkey % 100) * 1e0 end as realism
    from part where p_partkey % 23 <> 6"""


@relation("image_files", "manifest_items")
def profiles(d):
    """Every image found, with what its user's manifest says of the file (nothing: its name
    alone), and all of its text in one. Files that only a manifest names are no images."""
    none = d.no_strings()
    return f"""
    select *, concat_ws(' ', file, nullif(description, ''), nullif(tags, ''), nullif(ocr, '')) as semantic_text
    from (select i.*, coalesce(description, '') as description, coalesce(tag_list, {none}) as tag_list, coalesce(ocr_list, {none}) as ocr_list, coalesce({d.join('tag_list', ' ')}, '') as tags, coalesce({d.join('ocr_list', ' ')}, '') as ocr, coalesce(priority, 0e0) as priority, preferred_phase, realism
      from image_files i left join manifest_items m on m.user_id = i.user_id and m.file = i.file) p"""


@relation("profiles")
def profile_text(d):
    """File, description, tags and seen text of a profile in one."""
    return "select image_id, semantic_text as profile from profiles"


@relation("profiles")
def undescribed_images(d):
    """Images with neither a description nor tags."""
    return "select image_id, file from profiles where description = '' and tags = ''"


@relation("profiles")
def natural_sort(d):
    """A user's files in natural order: by lower case, every number inside as a number (by its
    length without zeros, then by digits)."""
    value = d.replace("x", "^0+", "")
    number = f"concat(chr(1), lpad(cast(length({value}) as string), 5, '0'), {value}, chr(1))"
    key = d.join(d.map(d.tokens("lower(file)", "[0-9]+|[^0-9]+"), f"case when {d.matches('x', '^[0-9]')} then {number} else x end"), "")
    return f"select image_id, cast(row_number() over (partition by user_id order by {key}, file) as int) as place from profiles"


@relation("profiles")
def pixel_scores(d):
    """Composition, technical quality, documentary look, room for captions and for motion from
    a picture's statistics."""
    hold = lambda x: f"greatest(0e0, least(100e0, {x}))"
    exposure, balance = hold("100e0 - abs(brightness - 128e0) * 0.75e0"), hold("100e0 - abs(edge_mean - center_edges) * 5e0")
    technical = f"0.48e0 * {hold('30e0 + 42e0 * log2(greatest(0.25e0, width * height / 1000000e0) + 1e0)')} + 0.34e0 * {hold('edge_mean * 4.4e0')} + 0.18e0 * {exposure}"
    retained = "least(1e0, least(width * 1e0 / height, 0.5625e0) / greatest(width * 1e0 / height, 0.5625e0))"
    scores = {"composition": f"0.58e0 * {balance} + 0.42e0 * {hold('contrast * 2.35e0')}", "technical": technical, "documentary_pixels": "72e0 + contrast * 0.35e0 - greatest(0e0, abs(brightness - 128e0) - 72e0) * 0.8e0",
              "caption": f"0.65e0 * {hold('100e0 - sqrt(greatest(0e0, quietest)) * 4.2e0')} + 0.35e0 * {exposure}", "motion": f"0.62e0 * 100e0 * sqrt({retained}) + 0.38e0 * {balance}"}
    return f"select image_id, {', '.join(f'round({hold(x)}, 4) as {n}' for n, x in scores.items())} from profiles"


@relation("profiles", "pixel_scores")
def documentary_score(d):
    """Pixels, realism (70 where unknown) and terms in the profile's text, held in 0 to 100."""
    pos = " + ".join(f"case when contains(lower(semantic_text), '{t}') then 1 else 0 end" for t in DOCUMENTARY)
    neg = " + ".join(f"case when contains(lower(semantic_text), '{t}') then 1 else 0 end" for t in GENERATED)
    return f"select p.image_id, round(greatest(0e0, least(100e0, 0.55e0 * documentary_pixels + 0.45e0 * greatest(0e0, least(100e0, coalesce(realism, 70e0))) + ({pos}) * 2e0 - ({neg}) * 14e0)), 4) as score from profiles p join pixel_scores x on x.image_id = p.image_id"


@relation("profiles", "pixel_scores")
def caption_ocr_penalty(d):
    """Room for captions less what text in the picture takes: 18 and 0.75 a character, 55 at most."""
    penalty = "case when trim(ocr) <> '' then least(55e0, 18e0 + 0.75e0 * length(trim(ocr))) else 0e0 end"
    return f"select p.image_id, {penalty} as penalty, round(greatest(0e0, least(100e0, caption - {penalty})), 4) as caption from profiles p join pixel_scores x on x.image_id = p.image_id"


def counted(d, keys, source, text) -> str:
    """Counts of content words, with a singular besides each longer plural."""
    words = d.unnest(f"(select {keys}, {content(d, text)} as ws from {source}) s", "ws", "word")
    return f"select {keys}, word, count(*) as c from (select {keys}, word from {words} union all select {keys}, substring(word, 1, length(word) - 1) from {words} where word like '%s' and length(word) > 4) w group by {keys}, word"


@relation("scenes", public=False)
def scene_words(d):
    return counted(d, "project_id, scene_index", "scenes", "voiceover_text")


@relation("profiles", public=False)
def image_words(d):
    return counted(d, "user_id, image_id", "profiles", "semantic_text")


def owned(d, source: str) -> str:
    """Rows of projects with the user whose images they meet."""
    return f"(select *, cast({d.extract('project_id', '^([0-9]+)', 1)} as bigint) as owner from {source})"


@relation("scenes", "profiles")
def scene_x_image(d):
    """Every scene of a project with every image of the project's user."""
    return f"select s.project_id, s.scene_index, scene_count, p.user_id, p.image_id from (select *, cast({d.extract('project_id', '^([0-9]+)', 1)} as bigint) as owner from scenes) s join profiles p on p.user_id = owner"


@relation("scene_x_image", "scene_words", "image_words", public=False)
def pair_words(d):
    """Words that a scene and an image of its user share, with both counts."""
    if d.spark:  # by user and word, so that pairs are not met with all words of both
        return f"select s.project_id, s.scene_index, i.image_id, s.word, s.c as in_scene, i.c as in_image from {owned(d, 'scene_words')} s join image_words i on i.user_id = s.owner and i.word = s.word"
    return "select x.project_id, x.scene_index, x.image_id, s.word, s.c as in_scene, i.c as in_image from scene_x_image x join scene_words s on s.project_id = x.project_id and s.scene_index = x.scene_index join image_words i on i.image_id = x.image_id and i.word = s.word"


@relation("scene_x_image", "pair_words", "profiles")
def semantic_overlap(d):
    """How well an image fits a scene's words, 0 to 100: nine for each shared word (counted three
    times at most on either side) up to 70, with priority and the place it prefers, or its
    place among the user's names."""
    expected = "x.scene_index / greatest(1e0, scene_count - 1e0)"
    return f"""
    select x.project_id, x.scene_index, x.image_id, coalesce(overlap, 0) as overlap, round(greatest(0e0, least(100e0, 18e0 + least(70e0, 9e0 * coalesce(overlap, 0)) + greatest(-10e0, least(10e0, priority * 4e0)) + case when preferred_phase is not null then 20e0 * greatest(0e0, 1e0 - abs({expected} - preferred_phase) / 0.24e0)
        else 8e0 * (1e0 - least(1e0, abs({expected} - place / greatest(1e0, n - 1e0)))) end)), 4) as semantic
    from scene_x_image x join (select image_id, priority, preferred_phase, row_number() over (partition by user_id order by lower(file), file) - 1 as place, count(*) over (partition by user_id) as n from profiles) p on p.image_id = x.image_id
    left join (select project_id, scene_index, image_id, cast(sum(least(in_scene, 3) * least(in_image, 3)) as bigint) as overlap from pair_words group by project_id, scene_index, image_id) o on o.project_id = x.project_id and o.scene_index = x.scene_index and o.image_id = x.image_id"""


@relation("pair_words")
def top_terms(d):
    """The six strongest shared words of a scene and an image."""
    return f"select project_id, scene_index, image_id, {d.agg_text('word', ', ', 'r')} as terms from (select project_id, scene_index, image_id, word, row_number() over (partition by project_id, scene_index, image_id order by in_scene * in_image desc, word) as r from pair_words) t where r <= 6 group by project_id, scene_index, image_id"


@relation("semantic_overlap", "pixel_scores", "documentary_score", "caption_ocr_penalty")
def final_image_score(d):
    """Semantics, composition, technical quality, documentary look, captions and motion, weighed;
    before any penalty for repetition."""
    final = four("semantic * 0.35e0 + composition * 0.15e0 + technical * 0.15e0 + s.score * 0.15e0 + c.caption * 0.08e0 + motion * 0.12e0")
    return f"select o.project_id, o.scene_index, o.image_id, semantic, composition, technical, s.score as documentary, c.caption, motion, {final} as final_score from semantic_overlap o join pixel_scores x on x.image_id = o.image_id join documentary_score s on s.image_id = o.image_id join caption_ocr_penalty c on c.image_id = o.image_id"


@relation("final_image_score", "profiles")
def rank_candidates(d):
    """Images of each scene by score, then name in lower case, then name."""
    return "select f.project_id, f.scene_index, f.image_id, final_score, cast(row_number() over (partition by f.project_id, f.scene_index order by final_score desc, lower(file), file) as int) as rank from final_image_score f join profiles p on p.image_id = f.image_id"


def chosen(d, source: str, digits: int) -> str:
    """Each scene's image by score less 3.5 for each use before and 25 where it is the last
    scene's. Of i scenes before, at most i images are used, so a project's first candidates,
    as many as its scenes, hold the best; they stand in `source` (place, candidates)."""
    if d.spark:
        used = "size(filter(s.used, u -> u = c.image))"
        best = "array_sort(transform(x.candidates, c -> struct(-round(c.score - 3.5e0 * {used} - {last}, {digits}) as k, lower(c.file) as low, c.file as file, c.image as image)))[0]"
    else:
        used = "len(list_filter(s.used, lambda u: u = c.image))"
        best = "list_sort(list_transform(x.candidates, lambda c: struct_pack(k := -round(c.score - 3.5e0 * {used} - {last}, {digits}), low := lower(c.file), file := c.file, image := c.image)))[1]"
    first, step = best.format(used="0", last="0e0", digits=digits), best.format(used=used, last="case when c.image = s.image then 25e0 else 0e0 end", digits=digits)
    array = "array<bigint>" if d.spark else "bigint[]"
    more = "concat(s.used, array({0}))" if d.spark else "list_append(s.used, {0})"
    one = "array({0})" if d.spark else "[{0}]"
    state = {"image": ("bigint", f"{first}.image", f"{step}.image"), "score": ("double", f"-{first}.k", f"-{step}.k"), "used": (array, one.format(f"{first}.image"), more.format(f"{step}.image"))}
    return d.scan(source, ["project_id"], "place", ["candidates"], state)


def listed(d, scores: str, digits: int) -> str:
    """The candidates of each scene that may be chosen: as many as the project has scenes."""
    items = "collect_list(struct(score, file, image_id as image))" if d.spark else "list(struct_pack(score := score, file := file, image := image_id))"
    return f"select project_id, scene_index + 1 as place, {items} as candidates from (select s.project_id, s.scene_index, s.image_id, score, file, row_number() over (partition by s.project_id, s.scene_index order by round(score, {digits}) desc, lower(file), file) as r, scene_count from ({scores}) s join profiles p on p.image_id = s.image_id join scenes c on c.project_id = s.project_id and c.scene_index = s.scene_index) t where r <= scene_count group by project_id, scene_index"


@relation("final_image_score", "profiles", "scenes", public=False)
def quality_candidates(d):
    return listed(d, "select project_id, scene_index, image_id, final_score as score from final_image_score", 4)


@relation("semantic_reference_score", "profiles", "scenes", public=False)
def reference_candidates(d):
    return listed(d, "select project_id, scene_index, image_id, score from semantic_reference_score", 9)


@relation("quality_candidates", public=False)
def quality_walk(d):
    return chosen(d, "quality_candidates", 4)


@relation("reference_candidates", public=False)
def reference_walk(d):
    return chosen(d, "reference_candidates", 9)


@relation("quality_walk", "reference_walk")
def image_assignment(d):
    """Scene by scene, the image of the best quality and the one that describes it, each with
    a memory of its own of what was used."""
    return "select q.project_id, q.place - 1 as scene_index, q.image, q.score, r.image as semantic_reference, round(r.score, 3) as semantic_score from quality_walk q join reference_walk r on r.project_id = q.project_id and r.place = q.place"


@relation("rank_candidates", "top_terms")
def candidate_reason(d):
    """Why a candidate has its rank, before repetition."""
    two = lambda x, n: f"concat(cast(cast(floor(round({x} * 1e{n}) / 1e{n}) as bigint) as string), '.', lpad(cast(cast(round({x} * 1e{n}) as bigint) % {10 ** n} as string), {n}, '0'))"
    return f"select r.project_id, r.scene_index, r.image_id, concat('Rank ', cast(rank as string), '; final ', {two('final_score', 4)}, '; ', coalesce(terms, 'no direct lexical match'), '; repetition penalty 0.00.') as reason from rank_candidates r left join top_terms t on t.project_id = r.project_id and t.scene_index = r.scene_index and t.image_id = r.image_id"


@relation("profiles", public=False)
def concepts(d):
    """Concepts of a user's images with their members: a concept is the first five words, in
    order, of a description, of a tag or of a text seen, its members all words of the texts so named."""
    texts = d.unnest_at(f"(select user_id, image_id, {d.joined(d.array('description'), 'tag_list', 'ocr_list')} as own from profiles) p", "own", "text", "part")
    parts = f"select user_id, image_id, part, {content(d, 'text')} as ws from {texts}"
    words = d.unnest(f"({parts}) s", "ws", "word")
    return f"""
    select distinct n.user_id, concept, w.word from (select user_id, image_id, part, {d.agg_text('word', '_', 'word')} as concept from (select user_id, image_id, part, word, row_number() over (partition by image_id, part order by word) as r from (select distinct user_id, image_id, part, word from ({{0}}) a) b) c where r <= 5 group by user_id, image_id, part) n
    join (select distinct user_id, image_id, part, word from ({{0}}) e) w on w.image_id = n.image_id and w.part = n.part""".replace("{0}", f"select user_id, image_id, part, word from {words} union all select user_id, image_id, part, substring(word, 1, length(word) - 1) from {words} where word like '%s' and length(word) > 4")


def expanded(words: str, keys: str) -> str:
    """Weights of words and of the concepts of the same user that they touch: one for each time
    a word is there, 1.6 for a concept, 0.14 for each of its members."""
    own = ", ".join(f"w.{k.strip()}" for k in keys.split(","))
    touched = f"(select distinct {own}, w.user_id, c.concept from {words} w join concepts c on c.user_id = w.user_id and c.word = w.word)"
    return f"select {keys}, word, cast(sum(hundredths) as bigint) / 100e0 as weight from (select {keys}, word, c * 100 as hundredths from {words} union all select {keys}, concept, 160 from {touched} t union all select {', '.join('t.' + k.strip() for k in keys.split(','))}, m.word, 14 from {touched} t join concepts m on m.user_id = t.user_id and m.concept = t.concept) p group by {keys}, word"


@relation("image_words", "concepts")
def concept_expand(d):
    """Weights of an image's words and of the concepts it touches among its user's images."""
    return expanded("image_words", "image_id")


@relation("scene_words", "concepts", public=False)
def scene_expanded(d):
    return expanded(f"(select *, cast({d.extract('project_id', '^([0-9]+)', 1)} as bigint) as user_id from scene_words)", "project_id, scene_index")


@relation("scene_x_image", "scene_expanded", "concept_expand", "profiles", "natural_sort")
def semantic_reference_score(d):
    """Shared weights (each counted three at most), the place in natural order against the
    scene's, priority and preferred place; before any penalty."""
    expected = "x.scene_index / greatest(1e0, x.scene_count - 1e0)"
    met, shared = "scene_x_image a join scene_expanded s on s.project_id = a.project_id and s.scene_index = a.scene_index join concept_expand i on i.image_id = a.image_id and i.word = s.word", "least(s.weight, 3e0) * least(i.weight, 3e0)"
    if d.spark:  # by user and word, so that pairs are not met with all words of the scene
        met = f"(select s.project_id, s.scene_index, i.image_id, s.weight, i.weight as other from {owned(d, 'scene_expanded')} s join (select user_id, e.image_id, word, weight from concept_expand e join profiles p on p.image_id = e.image_id) i on i.user_id = s.owner and i.word = s.word) a"
        shared = "least(a.weight, 3e0) * least(a.other, 3e0)"
    return f"""
    select x.project_id, x.scene_index, x.image_id, round(coalesce(shared, 0e0) + 1.7e0 * (1e0 - least(1e0, abs({expected} - (place - 1) / greatest(1e0, n - 1e0)))) + priority + case when preferred_phase is not null then 12e0 * greatest(0e0, 1e0 - abs({expected} - preferred_phase) / 0.24e0) else 0e0 end, 9) as score
    from scene_x_image x join (select p.image_id, priority, preferred_phase, place, count(*) over (partition by p.user_id) as n from profiles p join natural_sort s on s.image_id = p.image_id) p on p.image_id = x.image_id
    left join (select a.project_id, a.scene_index, a.image_id, cast(sum(cast(round({shared} * 10000e0) as bigint)) as bigint) / 10000e0 as shared from {met} group by a.project_id, a.scene_index, a.image_id) o
      on o.project_id = x.project_id and o.scene_index = x.scene_index and o.image_id = x.image_id"""
