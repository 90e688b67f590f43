"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Texts are cut before single words, where both tokenizers end a token whatever is beside;
a worker remembers what the tokens of a word are and how they meet. Token ends, summed
up, are merged like two sorted runs, which gives groups and links. Spark counts the
linked pairs of ids over the corpus and joins the counts, and the highest of each id on
either side, back to the documents. Pairs whose tokens end together are such that one's
bytes end the other's, so their number is bounded by the vocabularies.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, trim, written

#: A space after something else and before a word: no token of either side spans it.
CUT = re.compile(r"(?<=[^ ])(?= \S)")
WIDE = re.compile(r" (?=\s|\Z)")
#: Characters met together, words encoded together, words that a worker remembers between
#: slabs, and the length up to which it keeps them.
SLAB, TOGETHER, WORDS, KEY = 1 << 20, 1 << 12, 1 << 18, 64
RESULT = "n_a long, n_b long, n_groups long, n_links long, groups string, link_a array<int>, link_b array<int>, link_n array<int>"


def byte_alphabet() -> dict[str, int]:
    """What each character of a byte-level vocabulary stands for: printable bytes are
    themselves, the others follow from 256 in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_table(tokenizer: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE in a tokenizers file."""
    alphabet = byte_alphabet()
    vocabulary = json.loads(tokenizer)["model"]["vocab"]
    table = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        table[i] = bytes(alphabet[c] for c in entry)
    return table


def piece_table(processor) -> list[bytes]:
    """The bytes of each id of a SentencePiece model; special ids have none."""
    table = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            table.append(bytes([int(piece[3:5], 16)]))
        else:
            special = processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)
            table.append(b"" if special else piece.replace("▁", " ").encode())
    return table


def words_of(text: str):
    """Lists of a text's words, a space before each (the first one's is added), some SLAB
    characters in a list."""
    start = 0
    while start < len(text) or not start:
        cut = CUT.search(text, start + SLAB) if start + SLAB < len(text) else None
        end = cut.start() if cut else len(text)
        window = " " + text[start:end] if not start else text[start:end]
        yield window.split(" ")[1:] if not WIDE.search(window) else [w[1:] for w in CUT.split(window)]
        start = end


class Aligner:
    """Aligns texts; made once a task, remembers a bounded number of words."""

    def __init__(self, tokenizer: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizer)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a, self.bytes_b = byte_level_table(tokenizer), piece_table(self.b)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # how an id is written: inside a side of a group, at the end of A's, at the end of B's
        self.written = [f"{i}{end}" for table, last in ((self.bytes_a, "|"), (self.bytes_b, ";")) for end in (",", last) for i in range(len(table))]
        self.forget()

    def forget(self) -> None:
        self.words: list[str] = []
        self.index: dict[str, int] = {}
        self.texts: list[str | None] = []
        #: tokens of A and of B, groups of each word, and how often it came
        self.sizes, self.hits = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        #: where each word's links begin, and all links (a << 32 | b)
        self.starts, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def tidy(self) -> None:
        """Keeps the short words that came most often, once there are too many."""
        if len(self.words) <= WORDS:
            return
        often = np.argsort(-self.hits, kind="stable")[: WORDS // 2]
        keep = np.sort([i for i in often.tolist() if self.hits[i] > 1 and len(self.words[i]) <= KEY]).astype(np.int64)
        sizes, hits, links, starts = self.sizes[keep], self.hits[keep] // 2, self.links[self.where(keep)], self.starts
        words, texts = [self.words[i] for i in keep.tolist()], [self.texts[i] for i in keep.tolist()]
        counts = starts[keep + 1] - starts[keep]
        self.words, self.texts, self.sizes, self.hits, self.links = words, texts, sizes, hits, links
        self.starts, self.index = np.concatenate([[0], counts.cumsum()]).astype(np.int64), {w: i for i, w in enumerate(words)}

    def where(self, words: np.ndarray) -> np.ndarray:
        """The places of the links of some words."""
        counts = self.starts[words + 1] - self.starts[words]
        return np.arange(counts.sum()) + np.repeat(self.starts[words] - counts.cumsum() + counts, counts)

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not known yet, many in one text, and merges their token
        ends. Words with white space at an end stand alone, as do those of a text that its
        tokens don't give back."""
        self.tidy()
        new = [w for w in words if w not in self.index]
        plain = [w for w in new if w == w.strip() and "▁" not in w]
        odd = [[w] for w in new if w != w.strip() or "▁" in w]
        todo = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)] + odd
        while todo:
            own = todo.pop()
            text = " ".join(own)
            a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
            said = (" " + text).encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) == said == b"".join(map(self.bytes_b.__getitem__, b)):
                self._file(own, np.array(a, np.int64), np.array(b, np.int64))
            elif len(own) > 1:
                todo += [[w] for w in own]
            else:
                self._file(own, np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _file(self, words: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Adds words with their tokens; none where a word can't be aligned."""
        self.index.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.words += words
        self.hits = np.concatenate([self.hits, np.zeros(len(words), np.int64)])
        ends_a, ends_b = self.len_a[a].cumsum(), self.len_b[b].cumsum()
        # a merge of two sorted runs: where tokens of both end
        met, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        # each token's group, then its place where A's and B's tokens of a group follow each other
        group_a, group_b = met.searchsorted(ends_a), met.searchsorted(ends_b)
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[at_a], last_b[at_b] = True, True
        order[np.arange(len(a)) + np.concatenate([[0], at_b + 1])[group_a]] = a + last_a * len(self.bytes_a)
        order[np.arange(len(b)) + (at_a + 1)[group_b]] = b + last_b * len(self.bytes_b) + 2 * len(self.bytes_a)
        parts = list(map(self.written.__getitem__, order.tolist()))
        until = np.array([len(w.encode()) + 1 for w in words], np.int64).cumsum()
        sizes = np.stack([np.diff(e.searchsorted(until, "right"), prepend=0) for e in (ends_a, ends_b, met)], axis=1)
        tokens = np.concatenate([[0], (sizes[:, 0] + sizes[:, 1]).cumsum()]).tolist()
        self.texts += ["".join(parts[i:j]) if j > i else None for i, j in zip(tokens, tokens[1:])]
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.concatenate([self.starts, self.starts[-1] + sizes[:, 2].cumsum()])
        self.links = np.concatenate([self.links, a[at_a] << 32 | b[at_b]])

    def align(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, groups, link codes, their numbers) of each text."""
        held: list[tuple[int, list[str]]] = []
        found = [Alignment() for _ in texts]
        size = 0
        for n, text in enumerate(texts):
            for words in words_of(text) if text else ():
                held.append((n, words))
                size += sum(map(len, words))
                if size >= SLAB:
                    self._meet(held, found)
                    held, size = [], 0
        self._meet(held, found)
        return [f.result() for f in found]

    def _meet(self, held, found) -> None:
        self.learn({w for _, words in held for w in words})
        for n, words in held:
            own = np.array(list(map(self.index.__getitem__, words)), np.int64)
            parts = list(map(self.texts.__getitem__, own.tolist()))
            if None in parts or not found[n].good:
                found[n].good = False
                continue
            found[n].sizes += self.sizes[own].sum(axis=0)
            found[n].parts.append("".join(parts))
            own, times = np.unique(own, return_counts=True)
            self.hits[own] += times
            found[n].add(self.links[self.where(own)], np.repeat(times, self.starts[own + 1] - self.starts[own]))


class Alignment:
    """What is known of one text so far."""

    def __init__(self):
        self.good, self.parts, self.sizes = True, [], np.zeros(3, np.int64)
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray, times: np.ndarray) -> None:
        self.codes, where = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
        self.times = np.bincount(where, np.concatenate([self.times, times]), len(self.codes)).astype(np.int64)

    def result(self) -> tuple:
        if not self.good or not self.parts:
            nothing = np.zeros(0, np.int32)
            return 0, 0, 0, 0, "", nothing, nothing, nothing
        n_a, n_b, n_groups = self.sizes.tolist()
        codes = self.codes
        return n_a, n_b, n_groups, int(self.times.sum()), "".join(self.parts)[:-1], (codes >> 32).astype(np.int32), (codes & 0xFFFFFFFF).astype(np.int32), self.times.astype(np.int32)


def align(docs: DataFrame, tokenizer: str, model: bytes, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: the key columns, n_a, n_b, n_groups, n_links (long), groups
    (`a1,a2|b1;a3|b2,b3`: ids of A and B) and the distinct links as arrays link_a, link_b,
    link_n. `tokenizer` is the text of a byte-level BPE file (A, given a space and the
    text), `model` a SentencePiece model that adds the space itself (B).

    Null and empty texts, and those that either side's bytes don't give back (as with
    U+2581), have no tokens: zeros, an empty string, empty arrays. Long texts go through
    in windows. Keys travel as strings, so nulls and large numbers stay exact; other
    columns are left out. Repeated rows give equal rows, empty tables none.
    """
    kinds = {k: docs.schema[k].dataType for k in keys}
    names = [f"key{i}" for i in range(len(keys))]
    given = docs.select(*(F.col(f"`{k}`").cast("string").alias(n) for k, n in zip(keys, names)), "text")
    columns = [part.split()[0] for part in RESULT.split(", ")]

    def run(frames):
        aligner = Aligner(tokenizer, model)
        for frame in frames:
            for start in range(0, len(frame), 1_000):
                part = frame.iloc[start : start + 1_000]
                out = pd.DataFrame(aligner.align(part["text"].tolist()), columns=columns)
                for n in names:
                    out.insert(0, n, part[n].to_numpy())
                yield out
            trim()

    found = given.mapInPandas(run, ", ".join([*(f"{n} string" for n in names), RESULT]))
    return found.select(*(F.col(n).cast(kinds[k]).alias(k) for k, n in zip(keys, names)), *columns)


def linked(aligned: DataFrame, *columns: str) -> DataFrame:
    """One row for each distinct link of a document: a, b and its number n."""
    links = F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_n").alias("n"))
    return aligned.select(*columns, F.inline(links))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, pair_count, best_a, best_b): how many links of the corpus hold a pair of ids,
    and the highest such count of the same a and of the same b."""
    counts = written(linked(aligned).groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("pair_count")), "pairs")
    for side in ("a", "b"):
        counts = counts.join(counts.groupBy(side).agg(F.max("pair_count").alias(f"best_{side}")), side)
    return counts


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of ids can end together, whatever the corpus: one's bytes end the other's."""
    known_a, known_b = {x for x in a if x}, {x for x in b if x}
    longer = sum(x[i:] in known_b for x in known_a for i in range(len(x)))
    return longer + sum(x[i:] in known_a for x in known_b for i in range(1, len(x)))


def scored(aligned: DataFrame) -> DataFrame:
    """aligned (a written table) without its links, with n_best (links whose count is the
    highest of their b), n_best_a (of their a; ties count on both) and count_sum over the
    links, all long; zeros without links. Each row is counted by itself, repeated ones
    and those without keys too."""
    numbered = written(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = small(written(pair_counts(numbered), "counts"))

    def over(value: Column | str):
        return F.sum(F.col("n") * value)

    links = linked(numbered, "row").join(counts, ["a", "b"])
    of_row = links.groupBy("row").agg(
        over((F.col("pair_count") == F.col("best_b")).cast("long")).alias("n_best"),
        over((F.col("pair_count") == F.col("best_a")).cast("long")).alias("n_best_a"),
        over(F.col("pair_count")).alias("count_sum"),
    )
    rest = numbered.drop("link_a", "link_b", "link_n")
    return rest.join(of_row, "row", "left").drop("row").na.fill(0, ["n_best", "n_best_a", "count_sum"])
