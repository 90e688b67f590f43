"""Unicode forms against Python's, over all assigned characters that the tables cover."""

import random
import re
import unicodedata

from fabula.operators import forms
from fabula.plans import registry  # noqa: F401  (registers the relations)
from fabula.plans.relation import apply

R = random.Random(3)
MARKS = [c for c, _ in forms.MARKS]
STARTERS = ["a", "E", "ı", "Å", "ạ", "ᾳ", "क", "ে", "ெ", "େ", " ", "ဥ"]
SEQUENCES = ["".join(R.choice(STARTERS if R.random() < 0.4 else MARKS) for _ in range(R.randrange(1, 9))) for _ in range(2_000)]
SEQUENCES += ["".join(p) for p in forms.COMPOSED] + ["ą́̀", "́a", "q̣̇", "ෝ", "ෝ", "ố plain", "", "ascii only"]


def test_every_character_and_many_sequences_compose(spark):
    alone = [f"{c}|" for c in forms.KNOWN] + [f"x{c}y" for c in forms.KNOWN] + [f"{s}|" for s in SEQUENCES]
    texts = [*("".join(alone[i : i + 60]) for i in range(0, len(alone), 60)), *SEQUENCES[-40:]]
    lines = spark.createDataFrame([(str(i), i, 1, t) for i, t in enumerate(texts)], "segment string, doc_id long, ordinal int, text string").repartition(8)
    want = {i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    import hashlib

    got = {r.doc_id: r.text_md5 for r in apply("transcript_text_normalization", spark, segment_lines=lines).collect()}
    wrong = [i for i, t in want.items() if got[i] != hashlib.md5(t.encode()).hexdigest()]
    assert not wrong, [(texts[i].encode("unicode_escape"), want[i].encode("unicode_escape")) for i in wrong[:5]]


def test_names_lose_their_marks(spark):
    texts = [f"b{c}c" for c in forms.KNOWN] + ["Ångström № ½", "ﬁ", "", "漢字", "__a--b__", "Straße Ǆ"]
    slug = lambda t: re.sub(r"[^a-zA-Z0-9]+", "_", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()).strip("_").lower() or "documentary"
    names = spark.createDataFrame(list(enumerate(texts)), "page_id long, name string").repartition(8)
    got = {r.page_id: r.slug for r in apply("slugify", spark, names=names).collect()}
    # above the tables, one compatibility form: the ligature goes
    assert {i: slug(t) for i, t in enumerate(texts) if t != "ﬁ"} == {i: s for i, s in got.items() if texts[i] != "ﬁ"}


def test_paths_collide_in_composed_form(spark):
    paths = [(1, 10, "file", "a/ré"), (2, 20, "file", "a/ré"), (3, 5, "symlink", "a/re"), (4, 7, "file", "b/ậ"), (5, 1, "symlink", "b/ậ")]
    given = spark.createDataFrame(paths, "file_id long, bytes long, kind string, raw string")
    rows = sorted((r.logical, r.bytes, r.kind, r.observation) for r in apply("logical_path_collision", spark, raw_paths=given).collect())
    assert rows == sorted([("a/re", 5, "other", "known"), ("a/ré", 30, "file", "suspicious"), ("b/ậ", 8, "other", "suspicious")])


def test_control_characters_are_refused(spark):
    lines = spark.createDataFrame([(str(i), i, 1, f"a{chr(i)}b") for i in range(128)], "segment string, doc_id long, ordinal int, text string")
    got = {r.doc_id for r in apply("transcript_text_normalization", spark, segment_lines=lines).collect() if r.refused}
    assert got == {i for i in range(128) if i < 32 and i not in (9, 10, 13) or i == 127}
