"""Passages at similarity 0.8 and over, planted in otherwise different documents."""

import random
import re
import time

import numpy as np
import pyarrow as pa

from fabula.llm import passages


def planted(length, rate, times, r, first=0):
    """Pairs of documents with a passage, of whose words a share is other words in the second."""
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    words = lambda n: [word() for _ in range(n)]
    rows = []
    for i in range(first, first + 2 * times, 2):
        passage = words(length)
        other = [*passage]
        for j in r.sample(range(length), int(rate * length)):
            other[j] = word()
        rows += [(i, " ".join(words(150) + passage + words(150))), (i + 1, " ".join(words(170) + other + words(130)))]
    return rows


def test_fuzzy_passages_are_found(spark):
    r = random.Random(3)
    cases = [(60, 0.1), (60, 0.15), (80, 0.15), (80, 0.2), (100, 0.2)]
    rows = [row for n, (length, rate) in enumerate(cases) for row in planted(length, rate, 20, r, 40 * n)]
    found = {x.doc_id for x in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shares = [sum(i in found for i in range(40 * n, 40 * n + 40)) / 40 for n in range(len(cases))]
    assert all(s >= 0.85 for s in shares) and sum(shares) >= 4.6


def test_a_pair_that_the_smallest_document_hides(spark):
    r = random.Random(4)
    rows = planted(70, 0, 1, r, 1)
    whole = rows[0][1].split()[150:220]
    filler = [row[1].split() for row in planted(10, 0, 1, r)]
    rows.append((0, " ".join(w for i in range(0, 70, 10) for w in [*whole[i : i + 10], *filler[0][4 * i : 4 * i + 40]])))  # every seed, but no passage
    found = {(x.doc_id, x.ref_doc_id) for x in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, _ in found} == {1, 2}


def test_later_places_of_a_passage(spark):
    r = random.Random(5)
    (_, text), (_, other) = planted(70, 0, 1, r)
    again = text + " " + " ".join(text.split()[150:220])
    found = [x for x in passages.repeated(spark.createDataFrame([(0, other), (1, again)], "doc_id long, text string")).collect() if x.doc_id == 1]
    assert sorted((x.start_word, x.end_word) for x in found) == [(150, 220), (370, 440)]


def test_similar_parts_of_a_chain():
    a = np.arange(300, dtype=np.uint32)
    b = a.copy()
    b[60:200] += 1000  # two exact runs with other words between them
    seeds = np.array([10, 30, 50, 210, 240, 280])
    parts = sorted(passages.similar_parts(a, b, seeds, seeds))
    assert [p[:2] for p in parts] == [(0, 60), (200, 300)]


def brute_hashes(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_words_are_runs_of_letters_and_digits():
    texts = ["", None, "Ein_Wort, zwei", "ΟΔΟΣ Σίσυφος İstanbul 漢字x 𝒳𝒴 a1-b2", "x" * 70000 + " y", "___", "same same"]
    found = list(passages.word_hashes(texts))
    assert [len(h) for h in found] == [len(brute_hashes(t)) for t in texts]
    names = {}
    for h, t in zip(found, texts):
        for value, word in zip(h.tolist(), brute_hashes(t)):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_pieces_of_several_partners_are_no_passage(spark):
    r = random.Random(6)
    one, two, three = (planted(35, 0, 1, r)[0][1].split()[150:185] for _ in range(3))
    filler = [row[1].split() for row in planted(40, 0, 2, r)]
    rows = [(1, filler[0][:100] + one + filler[0][100:150]), (2, filler[1][:100] + two + filler[1][100:150]), (3, filler[2][:30] + one + two + filler[2][100:150])]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert passages.repeated(table).count() == 0


def longest_common_runs(rows, least=passages.LEAST):
    """Brute force over all pairs: maximal runs of words that two documents have in common."""
    found = {}
    words = {d: brute_hashes(t) for d, t in rows}
    for a in words:
        for b in words:
            if a != b:
                x, y = words[a], words[b]
                before = [0] * (len(y) + 1)
                for i, w in enumerate(x):
                    now = [0] * (len(y) + 1)
                    for j, v in enumerate(y):
                        if w == v:
                            now[j + 1] = before[j] + 1
                            ended = i + 1 == len(x) or j + 1 == len(y) or x[i + 1] != y[j + 1]
                            if ended and now[j + 1] >= least:
                                found.setdefault(a, []).append((i + 1 - now[j + 1], i + 1))
                    before = now
    return found


def test_exact_passages_against_all_pairs(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    shared = [[word() for _ in range(n)] for n in (20, 35, 48, 55, 70, 120)]
    rows = []
    for d in range(30):
        text = []
        for _ in range(5):
            text += [word() for _ in range(r.randrange(5, 40))] + r.choice(shared)
        rows.append((d, " ".join(text)))
    rows += [(90, None), (91, ""), (92, rows[0][1]), (92, rows[0][1]), (None, rows[1][1])]
    want = longest_common_runs([x for x in rows if x[0] is not None])
    cover = lambda spans: {i for a, b in spans for i in range(a, b)}
    found = {}
    for x in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(x.doc_id, []).append((x.start_word, x.end_word))
    assert set(found) == set(want)
    short = longest_common_runs([x for x in rows if x[0] is not None], 5)
    for d in want:
        assert cover(want[d]) <= cover(found[d])
        for a, b in found[d]:  # 2 n >= 0.8 (la + lb) and lb >= n: a third at most joins exact runs
            assert len(cover(short[d]) & set(range(a, b))) >= 0.66 * (b - a)


def test_a_passage_between_documents_that_are_no_end_of_any_seed(spark):
    r = random.Random(9)
    filler = lambda n: planted(n, 0, 1, r)[0][1].split()[150 : 150 + n]
    shared = filler(60)
    rows = [(5, filler(40) + shared + filler(30)), (6, filler(20) + shared + filler(50))]
    rows += [(d, filler(30) + part + filler(30)) for d, part in ((1, shared[:43]), (8, shared[:43]), (2, shared[17:]), (9, shared[17:]))]
    found = [tuple(x) for x in passages.repeated(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()]
    assert sorted(found) == [(5, 40, 100, 6, 1), (6, 20, 80, 5, 1)]


def test_all_pairs_of_documents_that_share_runs_with_many(spark):
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    long = [[word() for _ in range(75)] for _ in range(4)]
    rows = []
    for d in range(60):  # most have runs under LEAST words of several long texts, the ends among them
        text = []
        for source in r.sample(long, 3):
            n = r.choice((52, 60)) if 10 <= d < 50 and r.random() < 0.2 else r.randrange(30, 45)
            start = r.randrange(75 - n)
            text += [word() for _ in range(r.randrange(10, 30))] + source[start : start + n]
        rows.append((d, " ".join(text + [word() for _ in range(10)])))
    rows += [(70 + i, text) for i, (_, text) in enumerate(rows[20:23])]  # copies
    want = longest_common_runs(rows)
    cover = lambda spans: {i for a, b in spans for i in range(a, b)}
    found = {}
    for x in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(x.doc_id, []).append((x.start_word, x.end_word))
    assert set(want) <= set(found)
    for d in want:
        lost = cover(want[d]) - cover(found[d])
        assert len(lost) <= 10 * len(want[d])


def test_tiles_meet_all_pairs(spark, monkeypatch):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    line, tail = [word() for _ in range(12)], [word() for _ in range(50)]
    rows = [(d, [word() for _ in range(60)] + line + (tail if d in (7, 23) else [word() for _ in range(50)]) + [word() for _ in range(40)]) for d in range(40)]
    rows = [(d, " ".join(w)) for d, w in rows]
    monkeypatch.setattr(passages, "OPEN_TILE", 8)
    monkeypatch.setattr(passages, "TILE", 16)
    monkeypatch.setattr(passages, "STEP", 32)
    found = {(x.doc_id, x.ref_doc_id) for x in passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(7, 23), (23, 7)}


def test_bounds_of_what_codes_can_come_to():
    r = np.random.default_rng(12)
    a = r.integers(1, 16, (4000, 2 * passages.MARGIN), dtype=np.uint8)
    b = np.where(r.random(a.shape) < r.random((4000, 1)), a, r.integers(0, 16, a.shape, dtype=np.uint8))
    packed = [np.ascontiguousarray(x[:, ::2] | x[:, 1::2] << 4) for x in (a, b)]
    want = [passages.K + sum(max(passages.reach(x[s], y[s], m)[0] for m in (2, 4)) for s in (slice(0, passages.MARGIN), slice(passages.MARGIN, None))) for x, y in zip(a, b)]
    assert passages.followed(*packed).tolist() == want
    assert (passages.bounded(*packed) >= want).all()


def tiles_of(groups_, r):
    """Rows of matched_with_all()'s tiles, all open: words around places, a seed of one tile each."""
    span = passages.MARGIN + np.r_[-passages.AWAY - passages.SIDE : -passages.AWAY, passages.K + passages.AWAY : passages.K + passages.AWAY + passages.SIDE]
    beside = passages.MARGIN + np.r_[-1 : -passages.MARGIN - 1 : -1, passages.K : passages.K + passages.MARGIN]
    rows = []
    for h, words in enumerate(groups_):
        codes = (words[:, beside] % np.uint64(15) + np.uint64(1)).astype(np.uint8)
        near = [x.tobytes() for x in codes[:, ::2] | codes[:, 1::2] << 4]
        shifts = 2 * np.arange(2 * passages.SIDE, dtype=np.uint64)
        one, two = (((words[:, span] >> np.uint64(n) & np.uint64(3)) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64) for n in (20, 22))
        ctx = r.permutation(len(words))
        for side in (0, 1):
            rows += [(h, 0, 0, side, int(ctx[k]), 1000 * h + k, 7, 1000 * h + k, 7, True, int(one[k]), int(two[k]), near[k]) for k in range(len(words))]
    names = ["h", "i", "j", "side", "ctx", "doc", "at", "other", "oat", "open", "one", "two", "near"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def test_tiles_of_several_seeds_meet_together():
    r = np.random.default_rng(13)
    groups_ = []
    for n in (3, 1, 40, 2, 120, 25):
        words = r.integers(0, 1 << 62, (n, 2 * passages.MARGIN + passages.K)).astype(np.uint64)
        line = r.integers(0, 1 << 62, words.shape[1]).astype(np.uint64)
        for k in range(n):
            left, right = r.integers(0, 60, 2)
            words[k, passages.MARGIN - left : passages.MARGIN + passages.K + right] = line[passages.MARGIN - left : passages.MARGIN + passages.K + right]
        groups_.append(words)
    batch = tiles_of(groups_, r)
    near = {batch.column("doc")[i].as_py(): np.frombuffer(batch.column("near")[i].as_py(), np.uint8)[None] for i in range(batch.num_rows)}
    want = set()
    for h, words in enumerate(groups_):
        for a in range(len(words)):
            for b in range(a):
                if passages.followed(near[1000 * h + a], near[1000 * h + b])[0] >= passages.LEAST:
                    want.add((1000 * h + a, 1000 * h + b))
    found = [(d, o) for d, _, o, _ in zip(*(c.tolist() for c in passages.met(batch)))]
    assert len(found) == len(set(found)) and set(found) <= want
    assert len(found) >= 0.95 * len(want)  # two places that share fewer than MET codes beyond AWAY are not followed


def test_pairs_that_share_a_line_alone_cost_little():
    r = np.random.default_rng(14)
    words = r.integers(0, 1 << 62, (1500, 2 * passages.MARGIN + passages.K)).astype(np.uint64)
    line = slice(passages.MARGIN - 9, passages.MARGIN + passages.K + 33)
    words[:, line] = words[0, line]
    batch = tiles_of([words], r)
    one = batch.column("one").to_numpy()[:1500]

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    plain = least(lambda: [np.bitwise_count(one[k] ^ one).sum() for k in range(1500) for _ in range(4)])
    assert len(passages.met(batch)[0]) < 0.01 * 1500**2
    assert least(lambda: passages.met(batch)) < 8 * plain  # 20 where each pair is followed word by word


def test_common_words_of_pieces():
    r = random.Random(15)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randrange(9))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for v in a:
            row = [0, *np.maximum.accumulate([max(row[i + 1], row[i] + (w == v)) for i, w in enumerate(b)]).tolist()]
        assert passages.common(a, b) == row[-1]


def test_seeds_of_texts_together_are_those_of_each():
    r = np.random.default_rng(16)
    texts = [r.integers(0, n, r.integers(0, 80)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (2, 3, 9, 1000) for _ in range(25)]
    text, *found = passages.seeds_of(texts)
    alone = [passages.seeds_of([h]) for h in texts]
    assert text.tolist() == [n for n, x in enumerate(alone) for _ in x[0]]
    assert all(np.concatenate([x[k + 1] for x in alone]).tolist() == c.tolist() for k, c in enumerate(found))


def test_whole_pairs_keeps_groups_whole():
    r = np.random.default_rng(17)
    d = np.sort(r.integers(0, 40, 500))
    table = pa.RecordBatch.from_arrays([pa.array(d), pa.array(np.zeros(500, np.int64)), pa.array(np.arange(500))], names=["doc", "ref", "n"])
    for rows in (1, 3, 10, 100, 1000):
        parts = list(passages.whole_pairs(iter([table.slice(0, 130), table.slice(130, 0), table.slice(130)]), rows))
        assert np.concatenate([p.column("n").to_numpy() for p in parts]).tolist() == list(range(500))
        seen = [set(p.column("doc").to_pylist()) for p in parts]
        assert sum(map(len, seen)) == len(set.union(*seen)) == len(set(d.tolist()))
