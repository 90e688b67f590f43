"""Operators 11 to 13 on texts with nulls, ties, repeated rows, odd characters and clashing
columns, against plain Python."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fabula.llm import alignment, lines, middles, queries
from fabula.llm.common import written

R = random.Random(5)
SHARED = "A line that MANY documents hold"
PARTS = [SHARED, f"  {SHARED.lower()}\t", SHARED.upper(), "short one", "exactly 10", "ÄÖÜ äöü ÄÖÜ", "äöü ÄÖÜ äöü", "", " \x0b ", "漢字漢字漢字漢字漢字", "a line with hard blanks ", "a line with hard blanks", "once 🙂 only in a text"]
TEXTS = [None, "", "\n", "\n\n", SHARED, f"{SHARED}\n{SHARED}", f"x\n{SHARED}\r\ny\r", "\x01\x02e \x02m\n\x01", "no end", "end\n", "<P> a marker\nb", "x <S", "<", "a<M>b", "\x02\x01\n" * 5, "one\rtwo\r\nthree"]
TEXTS += ["\n".join(R.choices([*PARTS, f"line number {i} of its own"], k=R.randrange(1, 9))) for i in range(60)]
TEXTS += ["\n".join(f"long text line {i % 700}" for i in range(5_000)), "\n".join(f"long text line {i}" for i in range(0, 4_000, 3))]
ROWS = [(i * 2**40, t) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[5], ROWS[20], (None, SHARED), (None, TEXTS[30]), (None, None), (ROWS[6][0], f"{SHARED}\nanother text of number six")]
CLASH = ["n_lines", "n_dropped", "kept", "id", "body", "place", "h1", "h2", "first", "places", "own", "marked", "form", "output", "whole", "h", "n", "low", "a", "b", "row", "link_a", "key0", "drop", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string")
    return made.select("*", *(F.lit(c).alias(c) for c in CLASH)).repartition(3).cache()


def order(rows):
    return sorted(rows, key=repr)


def brute_lines(rows, min_docs=2, min_chars=10):
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add((i is None, i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(holders[key(x)]) < min_docs or min(holders[key(x)]) == (i is None, i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("min_docs,min_chars", [(2, 10), (4, 10), (2, 0), (1, 11)])
def test_lines_against_plain_python(docs, min_docs, min_chars):
    found = lines.dedup(docs, min_docs, min_chars)
    assert set(found.columns) == set(docs.columns)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect()]
    assert order(got) == order(brute_lines(ROWS, min_docs, min_chars))
    assert {r["a.b"] for r in found.select("`a.b`").collect()} == {"a.b"}


def test_lines_stay_on_the_main_path_of_sql(docs):
    plan = lines.dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_middle(i, t, rate=100, spm=50, seed=7):
    t = t or ""
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"rate": 60}, {"spm": 0}, {"spm": 100, "seed": 3}])
def test_middles_against_plain_python(docs, options):
    made = middles.transform(docs, **options)
    rows = made.withColumn("back", middles.restored(F.col("output"), F.col("form"))).collect()
    got = [(r.doc_id, r.text, r.n_units, r.form, r.prefix, r.middle, r.suffix, r.output) for r in rows]
    assert order(got) == order((i, t, *brute_middle(i, t, **options)) for i, t in ROWS)
    assert all(r.back == (r.text or "") for r in rows) and len(made.columns) == len(docs.columns) + len(middles.ADDED) - 2
    assert len({r.form for r in rows}) >= 2


def test_middles_of_other_units(spark):
    rows = [(i, " ".join(R.choices(["a", "bb", "\x01", "\x02e"], k=i))) for i in range(30)]
    made = middles.transform(spark.createDataFrame(rows, "doc_id long, text string"), units=r"[^ ]* |[^ ]+")
    for r in made.withColumn("back", middles.restored(F.col("output"), F.col("form"))).collect():
        assert r.n_units == len(re.findall(r"[^ ]* |[^ ]+", r.text)) and r.back == r.text


ODD = [
    None, "", " ", "  ", "   x", " x ", "two  blanks", "tabs\t and \n new\n\n lines \n", "\r\n x\r", "a\x00b", "▁", "a▁b and more", "<|endoftext|> plain <s> </s> <unk> <0x41>",
    "don't we'll I'M", "Ä ö é é 漢字かな 한국어 🙂👩‍👩‍👧 ​﻿", "a b   c  d  e", "x\x1c y \x85 z", "ﬁ ﬂ", "0123456789 " * 20, "a" * 3000, "word " * 3000, "no-space" * 400, "for i in range(10):\n    print(i)\n\n\n\n  return",
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_str(queries.byte_bpe())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())


def brute_alignment(text, tokenizers):
    """Whole texts through both libraries; token bytes by the vocabulary files; two pointers."""
    a, b = tokenizers
    nothing = ([], [], [], [])
    if not text:
        return nothing
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    inverse = {i: e for e, i in json.loads(queries.byte_bpe())["model"]["vocab"].items()}
    alphabet = alignment.byte_alphabet()
    said_a = [bytes(alphabet[c] for c in inverse[i]) for i in ids_a]
    said_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    if not b"".join(said_a) == b"".join(said_b) == (" " + text).encode():
        return nothing
    groups, links, own = [], [], ([], [])
    i = j = end_a = end_b = 0
    while i < len(ids_a) or j < len(ids_b):
        if end_a <= end_b:
            own[0].append(ids_a[i])
            end_a += len(said_a[i])
            i += 1
        else:
            own[1].append(ids_b[j])
            end_b += len(said_b[j])
            j += 1
        if end_a == end_b:
            groups.append(own)
            links.append((ids_a[i - 1], ids_b[j - 1]))
            own = ([], [])
    return ids_a, ids_b, groups, links


def said(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def test_alignment_against_whole_texts(spark, docs, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "SLAB", 500)
    rows = [(i * 2**55 + 1, t) for i, t in enumerate([*ODD, *TEXTS])] + [(None, ODD[13]), (None, None), (1, ODD[13]), (1, ODD[13])]
    given_rows = spark.createDataFrame(rows, "doc_id long, text string").withColumn("link_a", F.lit("clash")).withColumn("row", F.lit(1)).repartition(3)
    found = alignment.scored(alignment.align(given_rows, queries.byte_bpe(), queries.piece_model())).collect()
    whole = [(i, brute_alignment(t, tokenizers)) for i, t in rows]
    counts = Counter(x for _, w in whole for x in w[3])
    best_a, best_b = defaultdict(int), defaultdict(int)
    for (a, b), n in counts.items():
        best_a[a], best_b[b] = max(best_a[a], n), max(best_b[b], n)
    want = [
        (i, len(a), len(b), len(g), len(x), sum(counts[p] == best_b[p[1]] for p in x), sum(counts[p] == best_a[p[0]] for p in x), sum(counts[p] for p in x), said(g))
        for i, (a, b, g, x) in whole
    ]
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.n_best_a, r.count_sum, r.groups) for r in found]
    assert order(got) == order(want)
    assert sum(not w[0] for _, w in whole) >= 5 and len(counts) <= alignment.possible_pairs(alignment.byte_level_table(queries.byte_bpe()), alignment.piece_table(tokenizers[1]))


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85 　▁aAzé'sld09.,!<|>\x00漢🙂́")))
def test_words_are_cut_where_both_tokenizers_end(tokenizers, text):
    aligner = test_words_are_cut_where_both_tokenizers_end.__dict__.setdefault("aligner", alignment.Aligner(queries.byte_bpe(), queries.piece_model()))
    (n_a, n_b, n_groups, n_links, groups, *_), = aligner.align([text])
    ids_a, ids_b, want, links = brute_alignment(text, tokenizers)
    assert (n_a, n_b, n_groups, n_links, groups) == (len(ids_a), len(ids_b), len(want), len(links), said(want))


def test_a_worker_forgets_words(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 20)
    monkeypatch.setattr(alignment, "SLAB", 100)
    aligner = alignment.Aligner(queries.byte_bpe(), queries.piece_model())
    texts = [" ".join(f"w{R.randrange(90)}" for _ in range(40)) for _ in range(20)]
    assert [a[4] for a in aligner.align(texts)] == [said(brute_alignment(t, tokenizers)[2]) for t in texts]
    aligner.tidy()
    assert len(aligner.index) == len(aligner.words) == len(aligner.texts) <= 10


def test_columns_of_the_queries(spark, docs, tmp_path_factory, tokenizers):
    path = str(tmp_path_factory.mktemp("three"))
    docs.drop("a.b").write.parquet(f"{path}/documents.parquet")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op11_line_dedup(spark, path).collect()]
    assert order(got) == order((*r[:3], digest(r[3])) for r in brute_lines(ROWS))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in queries.op12_fill_in_middle(spark, path).collect()]
    size = lambda x: None if x is None else len(x)
    assert order(got) == order((i, n, form, size(p), size(m), digest(out), digest(t or "")) for i, t in ROWS for n, form, p, m, _, out in [brute_middle(i, t)])
    got = [(r.doc_id, r.n_groups, r.groups_sha256) for r in queries.op13_token_alignment(spark, path).collect()]
    assert order(got) == order((i, len(g), digest(said(g)) if g else "") for i, t in ROWS for g in [brute_alignment(t, tokenizers)[2]])


def test_written_tables_keep_rows_apart(spark):
    same = written(spark.createDataFrame([(None, "a b c")] * 3, "doc_id long, text string"), "same")
    found = alignment.scored(alignment.align(same, queries.byte_bpe(), queries.piece_model())).collect()
    assert [(r.doc_id, r.n_links, r.count_sum) for r in found] == [(None, 3, 9)] * 3
