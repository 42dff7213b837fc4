"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; the dynamic programme carries the best score and
the number of pieces on that path, so no path is traced back. Ties go as in the tokenizer: a later candidate replaces one only
if it is strictly better, and candidates come in order of their start, so the longest piece wins. A character without a
piece of its own costs the least score less 10 and counts as its UTF-8 bytes if the vocabulary has all byte pieces, else runs
of such characters count as one.

Spaces are written as U+2581, one of which starts a text. No piece holds U+2581 after another character (this is checked when
the vocabulary is loaded; otherwise texts are scored whole), so the best path is a chain of best paths of the parts before
each such mark, and counts of parts are remembered in a bounded table. Long parts are never remembered, and never cut.

The vocabulary: a unigram tokenizer file (``.json``) is taken with its scores. The public vocabulary at hand is a BPE one, whose
stored scores are merge ranks and no probabilities, so its pieces get those of Zipf's law by rank, log of 1 / (rank + 2.7) over
their sum: no score is trained. Counts are those of the unigram tokenizer with these pieces and scores, not of the BPE tokenizer.
Only ordinary pieces match text; names of control, unknown and byte pieces in a text are text.

Defined results: null and empty texts have 0 tokens; repeated rows get equal counts; rows without id are counted too; extra
columns are ignored; an empty table gives an empty result. The vocabulary file must be readable on
every executor; its path is a parameter.
"""

from __future__ import annotations

import functools
import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

MARK, PENALTY = "▁", 10.0
#: Parts remembered by a worker at most, and the longest that is remembered.
REMEMBERED, LONGEST = 1_000_000, 40
#: Zipf's law: the probability of rank r falls as 1 / (r + SHIFT).
SHIFT = 2.7


class Counter:
    """Counts the pieces of texts under one vocabulary of ordinary pieces (piece, score), with byte pieces for other characters or not."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool) -> None:
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.find.add_word(piece, (len(piece), float(score)))
        self.find.make_automaton()
        names = {p for p, _ in pieces}
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.bytes = byte_pieces
        self.parts = not any(MARK in p.lstrip(MARK) for p in names)
        self.lines = self.bytes and self.parts and not any("\n" in p for p in names)
        self.seen: dict[str, int] = {}

    def viterbi(self, part: str) -> int:
        """The number of pieces on the best path over a part, or over a whole text."""
        size = len(part)
        best, count, out = [0.0] + [None] * size, [0] * (size + 1), [False] * (size + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, found in self.find.iter(part):
            matches[end].append(found)
        for end in range(1, size + 1):
            single, top, came, width = False, None, 0, 1
            for length, score in sorted(matches[end - 1], reverse=True):  # longest first: in order of start
                single |= length == 1
                score += best[end - length]
                if top is None or score > top:
                    top, came, width = score, end - length, length
            if not single and (top is None or best[end - 1] + self.unknown > top):
                top, came, out[end] = best[end - 1] + self.unknown, end - 1, True
                step = len(part[came].encode("utf-8", "surrogatepass")) if self.bytes else int(not out[came])
            else:
                step = 1
            best[end], count[end] = top, count[came] + step
        return count[size]

    def part(self, part: str) -> int:
        n = self.seen.get(part)
        if n is None:
            n = self.viterbi(part)
            if len(part) <= LONGEST:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[part] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.parts:
            return self.viterbi(MARK + text.replace(" ", MARK))
        total = 0
        for k, line in enumerate(text.split("\n") if self.lines else [text]):
            total += k > 0  # the byte piece of the line end
            words, marks = line.replace(MARK, " ").split(" "), "" if k else MARK
            for j, word in enumerate(words):
                marks += MARK * (j > 0)
                if word or j == len(words) - 1:
                    if marks or word:
                        total += self.part(marks + word)
                    marks = ""
        return total


def zipf(ordered: list[str]) -> list[tuple[str, float]]:
    """Pieces in order of rank with the log-probabilities of Zipf's law."""
    total = sum(1 / (rank + SHIFT) for rank in range(len(ordered)))
    return [(piece, -math.log((rank + SHIFT) * total)) for rank, piece in enumerate(ordered)]


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Ordinary pieces with scores of a vocabulary file, and whether it has all byte pieces."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "Unigram":
            raise ValueError(f"{path} is no unigram tokenizer but {model['type']}")
        names = [f"<0x{b:02X}>" for b in range(256)]
        whole = bool(model.get("byte_fallback")) and {p for p, _ in model["vocab"]}.issuperset(names)
        return [(p, s) for i, (p, s) in enumerate(model["vocab"]) if i != model.get("unk_id") and p not in set(names)], whole
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    return zipf([model.id_to_piece(i) for i in plain]), sum(map(model.is_byte, ids)) == 256


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each worker process and vocabulary."""
    return Counter(*vocabulary(path))


def count_column(text: Column, path: str) -> Column:
    def counted(texts: pd.Series) -> pd.Series:
        count = counter(path).text
        return pd.Series([count(t) for t in texts], dtype="int64")

    return F.pandas_udf(counted, "long")(text)


def op3_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", count_column(F.col("text"), path or public_tokenizers.path("piece_bpe_32k.model")).alias("n_tokens"))


QUERIES = {"op3_token_counts": op3_token_counts}
