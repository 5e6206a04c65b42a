"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a word, and Viterbi's recurrence
carries the best score and its number of pieces to each character; no path is kept.  Ties go as in
the tokenizers library: of equal scores the earliest start wins, that is, the longest last piece.  A
character that no piece covers alone gets the least score less 10 and, with byte pieces, as many
tokens as bytes.

Blanks become the word mark, and words start at each mark, so a word's count doesn't depend on its
neighbours: a worker keeps the counts of usual words.

The vocabulary is that of a sentencepiece file: its normal pieces with their scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsearch.llm.common import arrow_batches, read_table

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[tuple[str, float]]:
    """The normal pieces of a sentencepiece file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class TokenCounter:
    """Counts the pieces of texts.  byte_fallback: an uncovered character counts a token for each byte, else one for each run of such characters."""

    KEEP, LONGEST = 1_000_000, 64

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, least: float | None = None):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        lowest = min((s for _, s in pieces), default=0.0) if least is None else least
        self.unknown = lowest - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.kept: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best path over a word."""
        score: list[float | None] = [None] * (len(word) + 1)
        start, count, open_ = [0] * (len(word) + 1), [0] * (len(word) + 1), [False] * (len(word) + 1)
        score[0] = 0.0
        at = 0

        def unknown(end: int) -> None:
            c = word[end - 1]
            if c in self.single:
                return
            if score[end] is None or self.unknown + score[end - 1] > score[end]:
                score[end] = self.unknown + score[end - 1]
                new = len(c.encode("utf-8", "replace")) if self.byte_fallback else int(not open_[end - 1])
                count[end], open_[end] = count[end - 1] + new, True

        # Matches come by their end; an end's unknown step is last, as it starts latest.
        for last, (size, value) in self.found.iter(word):
            end, begin = last + 1, last + 1 - size
            while at < last:
                at += 1
                unknown(at)
            new = value + score[begin]
            if score[end] is None or new > score[end] or (new == score[end] and begin < start[end]):
                score[end], start[end], count[end], open_[end] = new, begin, count[begin] + 1, False
        while at < len(word):
            at += 1
            unknown(at)
        return count[-1]

    def text(self, text: str) -> int:
        """Pieces of a text."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        words = (marked if marked[0] == MARK else MARK + marked).split(MARK)[1:]
        kept, total = self.kept, 0
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.word(MARK + w)
                if len(w) <= self.LONGEST:
                    if len(kept) >= self.KEEP:
                        kept.clear()
                    kept[w] = n
            total += n
        return total


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_chars, n_bytes, n_tokens.

    Null text counts as empty and has no tokens.  Repeated rows are counted each.  Other columns are not read.
    An empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    take = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TokenCounter(load_pieces(path))
        counter = _counters[path]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            made = [[len(t) for t in texts], [len(t.encode("utf-8", "replace")) for t in texts], [counter.text(t) for t in texts]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in made)], ["id", "n_chars", "n_bytes", "n_tokens"])

    kind = take.schema["id"].dataType.simpleString()
    return take.mapInArrow(count, f"id {kind}, n_chars long, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
