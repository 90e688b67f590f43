"""Every registered query over a small folder with nulls, empty and long texts, ties, repeated
rows and extra columns with clashing names: the columns of its contract against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fabula.llm import importance, licenses, queries, toxicity
from fabula.llm.common import discard, small, tables_dir, written

from .test_llm import BASE_ASSIGN, TEXTS, brute_containment, brute_jaccard, prose

R = random.Random(21)
LONG = " ".join(f"{prose(12, R)}" for _ in range(900))
ROWS = [(i, t) for i, t in enumerate([*TEXTS, LONG, TEXTS[6], "password: hunter22 and password: hunter22", "Ελλάδα ΟΔΟΣ " * 40])]
ROWS += [(300 + i, prose(30, R) + (" You vermin. " if i % 3 == 0 else " ") + prose(20, R)) for i in range(120)]
ROWS += [ROWS[6], ROWS[6], (None, TEXTS[6]), (None, None), (7, "another text of number seven")]
CLASH = "size int, shard string, toxicity double, offending string, content string, candidates int, secrets string, ids string, text_sha256 string, log_weight double, _order long, licenses string, h long, doc string, hits int, feature string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    extra = [c.split() for c in CLASH.split(", ")]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 5}", len(t) if t else 0) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.select("*", *(F.lit(None).cast(k).alias(n) for n, k in extra))
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, int("vermin" in (t or ""))) for i, t in ROWS if i is not None and i >= 300] + [(303, 1, 1), (304, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


ITEMS = [(1, " ".join(TEXTS[10].split()[5:10])), (2, " ".join(TEXTS[10].split()[20:60])), (3, "two words"), (4, None), (5, ""), (1, " ".join(TEXTS[10].split()[5:10]))]


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory, folder):
    path = str(tmp_path_factory.mktemp("nothing"))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


def rows_of(spark, folder, number):
    name = next(n for n in queries.QUERIES if n.startswith(f"op{number}_"))
    return queries.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("number", range(1, 14))
def test_empty_tables_give_no_rows(spark, nothing, number):
    assert rows_of(spark, nothing, number) == []


def key(r):
    return (r.doc_id is None, r.doc_id or 0)


def test_op1(spark, folder):
    found = rows_of(spark, folder, 1)
    utf8 = lambda t: (t or "").encode()
    assert sorted((key(r), r.size, r.text_crc32) for r in found) == sorted(((i is None, i or 0), len(utf8(t)) + 1, zlib.crc32(utf8(t))) for i, t in ROWS)
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}
    for n in range(16):
        assert sorted(r.slot for r in found if r.shard == n) == list(range(sum(r.shard == n for r in found)))


def test_op2_against_plain_counts(spark, folder):
    found = rows_of(spark, folder, 2)
    hasher = importance.Hasher()
    good = {i for i, t in ROWS if i is not None and i >= 300 and i % 2} | {303}
    counts = lambda rows: Counter(b for _, t in rows for b in hasher(t).tolist())
    raw, target = counts(ROWS), counts([r for r in ROWS if r[0] in good])
    n_raw, n_target = sum(raw.values()), sum(target.values())
    noise = {r.doc_id: (r.u % 2**64 + 0.5) / 2.0**64 for r in spark.createDataFrame([(i,) for i, _ in ROWS], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(0)).alias("u")).collect()}
    weighed = []
    for i, t in ROWS:
        own = Counter(hasher(t).tolist())
        size, inside = sum(own.values()), i in good
        w = 0.0
        for b, c in own.items():
            p = (raw[b] - c + 0.5) / (n_raw - size + importance.BUCKETS / 2)
            q = (target[b] - c * inside + 0.5) / (n_target - size * inside + importance.BUCKETS / 2)
            w += c * (math.log(q) - math.log(p))
        weighed.append((w - math.log(-math.log(noise[i])), w, i))
    k = round(sum(min(1.0, math.exp(min(0.0, w))) for _, w, _ in weighed))
    want = sorted(weighed, key=lambda x: (x[0], x[2] or 0), reverse=True)
    cut = want[k - 1][0]
    want = [x for x in want if x[0] >= cut]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for _, _, i in want)
    assert sorted(r.log_weight for r in found) == pytest.approx(sorted(w for _, w, _ in want))


def test_op3_short_items_are_all_found(spark, folder):
    found = {(r.doc_id, r.item_id) for r in rows_of(spark, folder, 3)}
    assert found == brute_containment(ROWS, ITEMS) and {i for _, i in found} == {1, 2}


def test_op3_many_five_word_items(spark):
    from fabula.llm import decontamination

    r = random.Random(4)
    texts = [prose(400, r) for _ in range(150)]
    items = [(i, " ".join(t.split()[i : i + 5])) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontamination.contained(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute_containment(list(enumerate(texts)), items) and len(found) >= 150


def test_op3_classes_are_clamped(spark, monkeypatch):
    from fabula.llm import decontamination

    monkeypatch.setattr(decontamination, "CLASSES", 6)
    text = prose(3000, random.Random(6))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(text.split()[100:900]))], "item_id long, text string")
    assert decontamination.contained(docs, items).count() == 1


def test_op5(spark, folder):
    want = []
    for i, t in ROWS:
        t = t or ""
        spans = [("assign", *m.span()) for m in BASE_ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = Counter(k for k, _, _ in spans)
        want.append(((i is None, i or 0), n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest()))
    found = rows_of(spark, folder, 5)
    assert sorted((key(r), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == sorted(want)
    for r in found:
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("generic"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256


def test_op6(spark, folder):
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows_of(spark, folder, 6))
    assert found == brute_jaccard(ROWS, 4, 85)


def test_op7(spark, folder):
    from fabula.llm import media

    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        stored = b"P5\n192 %d\n255\n" % (len(p) // 192) + p
        want.append(((i is None, i or 0), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stored), hashlib.sha256(stored).hexdigest()))
    found = rows_of(spark, folder, 7)
    assert sorted((key(r), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in found) == sorted(want)
    assert len({(r.media_sha256, r.feature) for r in found}) == len({r.media_sha256 for r in found})
    assert media.features(b" " * 192) == "rows=1;mean=32.0000;var=0.0000;min=32;max=32;entropy=-0.0000;gradient=0.0000"


def plain_score(text, model):
    """Noisy-or over sentences, one product at a time."""
    clean = 1.0 - model.leak
    for sentence in re.findall(r"[^.!?\n]+[.!?\n]*", text or ""):
        words = re.findall(r"[^\W_]+", sentence.lower())
        seen = {f for w in words for f in [w, *("^" + w[:k] for k in (4, 5, 6, 7) if len(w) > k)] if f in model.weights}
        if seen:
            clean *= 1.0 - 1.0 / (1.0 + math.exp(-(toxicity.BASE_LOGIT + sum(model.weights[f] for f in seen))))
    return 1.0 - clean


def test_op8(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = toxicity.training_rows(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    labelled = {i: int("vermin" in t) for i, t in ROWS if i is not None and i >= 300} | {303: 1}
    text = dict(r for r in ROWS if r[0] is not None and r[0] >= 300)
    assert sorted(rows) == sorted((text[i], y) for i, y in labelled.items() if not out(i))
    model = toxicity.fit(rows)
    found = rows_of(spark, folder, 8)
    assert sorted((key(r), r.held_out) for r in found) == sorted(((i is None, i or 0), out(i)) for i, _ in ROWS)
    assert sorted(r.score for r in found) == pytest.approx(sorted(plain_score(t, model) for _, t in ROWS))
    assert all(r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id >= 300]
    assert all(r.predicted == labelled[r.doc_id] for r in held) and len(held) > 15


def test_training_rows_keep_to_their_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 0), (3, 1)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(docs, labels, size=1000)) == 10
    assert toxicity.training_rows(docs, labels) == toxicity.training_rows(docs.repartition(7), labels)


def test_op8_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    found = spark.createDataFrame(rows_of(spark, path, 8), "doc_id long, held_out boolean, score double, predicted int, offending string")
    held = found.where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("toxic is not null").collect()
    assert len(held) >= 50 and sum(r.predicted == r.toxic for r in held) / len(held) >= 0.93


def plain_matches(text, templates, threshold):
    """All passages that begin and end with a common bigram, best first."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    best = []
    for name, wordings in templates.items():
        for wording in wordings:
            own = licenses.bigrams(licenses.normalise(wording))
            for a in range(len(words) - 1):
                top = None
                for e in range(a, len(words) - 1):
                    if (words[a], words[a + 1]) in own and (words[e], words[e + 1]) in own:
                        score = licenses.dice(set(zip(words[a : e + 1], words[a + 1 : e + 2])), own)
                        if score >= threshold - 1e-12 and (top is None or score > top[0]):
                            top = (score, a, e + 2, name)
                best += [top] if top else []
    taken, out = set(), []
    for score, a, e, name in sorted(best, key=lambda f: (-f[0], f[1] - f[2], f[1], f[3])):
        if taken.isdisjoint(range(a, e)):
            taken |= set(range(a, e))
            out.append((a, e - a, name, round(score, 9)))
    return sorted(out)


def test_op9_against_all_passages(spark, folder):
    matcher = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    r = random.Random(2)
    wordings = [w for ws in licenses.TEMPLATES.values() for w in ws if len(w) < 400]
    for _ in range(40):
        words = []
        for _ in range(3):
            own = r.choice(wordings).split()
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = "changed"
            words += prose(r.randrange(4), r).split() + own
        text = " ".join(words)
        assert [(m["word"], m["n_words"], m["license"], round(m["dice"], 9)) for m in matcher.matches(text)] == plain_matches(text, licenses.TEMPLATES, licenses.THRESHOLD)
    want = sorted(((i is None, i or 0), *m) for i, t in ROWS if len(t or "") < 2000 for m in plain_matches(t, licenses.TEMPLATES, licenses.THRESHOLD))
    found = sorted((key(x), x.word, x.n_words, x.license, round(x.dice, 9)) for x in rows_of(spark, folder, 9))
    assert found == want


def test_op9_whole_licences():
    matcher = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    r = random.Random(3)
    for name, text in (("MIT", licenses.MIT), ("ISC", licenses.ISC), ("BSD-2-Clause", licenses.BSD_CONDITIONS + licenses.BSD_DISCLAIMER), ("BSD-3-Clause", licenses.BSD_CONDITIONS + licenses.BSD_NAMES + licenses.BSD_DISCLAIMER), ("Zlib", licenses.ZLIB), ("Unlicense", licenses.UNLICENSE)):
        words = text.split()
        (found,) = matcher.matches(prose(40, r) + " " + text + " " + prose(30, r))
        assert found["license"] == name and found["dice"] == 1.0 and found["word"] == 40
        for i in r.sample(range(5, len(words) - 5), len(words) // 30):
            words[i] = "other"
        changed = matcher.matches(prose(40, r) + " " + " ".join(words) + " " + prose(30, r))
        assert changed[0]["license"] == name


def test_op9_many_notices_in_a_text():
    matcher = licenses.Matcher(licenses.TEMPLATES, licenses.THRESHOLD)
    assert len(matcher.matches("Released under the MIT License. Some other words here. " * 3000)) == 3000


def test_op10(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    found = rows_of(spark, folder, 10)
    assert len(found) == len(ROWS) and all(r.round_trip for r in found)
    want = sorted((hashlib.sha256((t or "").encode()).hexdigest(), hashlib.sha256(np.array(library.encode(t or ""), "<i4").tobytes()).hexdigest()) for _, t in ROWS if "▁" not in (t or ""))
    assert sorted((r.text_sha256, r.ids_sha256) for r in found if (r.text_sha256, ) and r.text_sha256 not in {hashlib.sha256(t.encode()).hexdigest() for _, t in ROWS if t and "▁" in t}) == want


def test_broadcasts_are_bounded_in_bytes(spark):
    table = written(spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit("yy"), F.lit("z")).alias("a")), "bounded")
    marked = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert marked(small(table)) and not marked(small(table, size=50_000)) and not marked(small(table, rows=99))


def test_a_session_s_settings_stay(spark, folder):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows_of(spark, folder, 9)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_tables_can_be_discarded(spark):
    import os

    written(spark.range(3), "gone")
    discard(spark)
    assert not os.path.exists(tables_dir(spark).removeprefix("file:"))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_op6_loses_no_link_of_a_whole_table(spark, k, percent):
    from fabula.llm import jaccard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(docs, k, percent).collect())
    assert found == brute_jaccard(rows, k, percent)


def test_a_text_beyond_the_bound_leaves_the_others_in_the_sample(spark):
    rows = [(i, "x" * 2_000 if i == 3 else f"text number {i}") for i in range(60)] + [(4, "text number 4"), (6, "another six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert {3, 4, 6} <= set(free)
    whole = toxicity.training_rows(docs, labels)
    assert sorted(whole) == sorted((dict(rows[:60])[i], i % 2) for i in free if i != 6)
    assert sorted(toxicity.training_rows(docs, labels, size=1_500)) == sorted((t, y) for t, y in whole if len(t) < 100)
    few = toxicity.training_rows(docs, labels, size=100)
    assert 0 < len(few) < 12 and sum(len(t) for t, _ in few) <= 100


def test_rows_without_an_id_link_what_they_are_close_to(spark):
    from fabula.llm import jaccard

    words = [f"w{i}" for i in range(300)]
    a, b, c = " ".join(words), " ".join(["x1", "x2"] + words[2:-8] + [f"y{i}" for i in range(8)]), " ".join([f"z{i}" for i in range(10)] + words[10:-18] + [f"y{i}" for i in range(8)] + [f"q{i}" for i in range(10)])
    rows = lambda middle: [(1, a), (middle, b), (middle, b), (3, c), (None, None), (9, "far away from all of them")]

    def components(middle):
        found = jaccard.join(spark.createDataFrame(rows(middle), "doc_id long, text string")).collect()
        return {r.doc_id: r.component_id for r in found if r.doc_id is not None}

    sets = [{tuple(t.split()[i : i + 4]) for i in range(297)} for t in (a, b, c)]
    alike = lambda x, y: len(x & y) / len(x | y)
    assert alike(sets[0], sets[1]) >= 0.85 and alike(sets[1], sets[2]) >= 0.85 and alike(sets[0], sets[2]) < 0.85
    assert components(2) == {1: 1, 2: 1, 3: 1, 9: 9}
    assert components(None) == {1: 1, 3: 1, 9: 9}
