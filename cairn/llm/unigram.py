"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

Aho-Corasick lists the vocabulary pieces that end at each place; dynamic programming carries, for every
place, the best score and the number of pieces on its path, and never the path. Ties and unknown
characters go as the published unigram tokenizer has them: of equal scores the piece that starts first
stays; a character that is no piece itself costs the lowest score less ten; unknown neighbours are one
piece. Spaces become ``▁``, one is put in front, and a piece never crosses the start of a word.

The vocabulary is a parameter. None of the tokenizer files at hand is a unigram one; the query takes the pieces of
a BPE file, whose scores are its merge ranks, and leaves that file's normaliser out. So its counts are those of the
unigram model with these pieces and scores, which the library agrees with (a test), and not the counts of the
BPE tokenizer that the file was published as.

Defined results: a null or empty text has no pieces. Words of any length are counted whole, in linear
time; only short ones are remembered. Repeated rows get equal counts; other columns pass through.
"""

from __future__ import annotations

import hashlib
import pickle

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.frames import map_columns
from cairn.llm.linear import TwoGenerations

SPACE, UNKNOWN_PENALTY, MEMO_WORDS, MEMO_CHARS = "▁", 10.0, 200_000, 64


def read_pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces and scores of a sentencepiece file, without its control and byte pieces; the unknown piece is the first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    unknown = model.unk_id()
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in (unknown, *ids)], 0


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in pieces:
            scores[piece] = score
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.memo = TwoGenerations(self._word, MEMO_WORDS)

    def best(self, chunk: str) -> tuple[float, int, int]:
        """The best path's score, its pieces, and those of them that are unknown."""
        n = len(chunk)
        score, pieces, odd = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        open_ = bytearray(n + 1)  # whether a path ends in an unknown piece
        reached, unknown, single = 0, self.unknown, self.single

        def by_unknown(at: int, known: float | None) -> None:
            if chunk[at - 1] in single:
                return
            new = unknown + score[at - 1]
            if known is None or new > known:
                joins = open_[at - 1]
                score[at], pieces[at], odd[at], open_[at] = new, pieces[at - 1] + 1 - joins, odd[at - 1] + 1 - joins, 1

        known: float | None = None
        for last, (size, gain) in self.automaton.iter(chunk):
            at = last + 1
            if at != reached:  # an end's pieces come together, longest first
                if reached:
                    by_unknown(reached, known)
                for skipped in range(reached + 1, at):
                    by_unknown(skipped, None)
                reached, known = at, None
            new = gain + score[at - size]
            if known is None or new > known:
                known = new
                score[at], pieces[at], odd[at], open_[at] = new, pieces[at - size] + 1, odd[at - size], 0
        if reached:
            by_unknown(reached, known)
        for skipped in range(reached + 1, n + 1):
            by_unknown(skipped, None)
        return score[n], pieces[n], odd[n]

    def _word(self, word: str) -> int:
        _, pieces, odd = self.best(SPACE + word)
        return pieces | odd << 32

    def count(self, text: str | None) -> tuple[int, int]:
        """Pieces of the text, and how many are unknown."""
        if not text:
            return 0, 0
        words = text.replace(" ", SPACE).split(SPACE)
        if text[0] in (" ", SPACE):
            del words[0]
        memo = self.memo.__getitem__
        total = sum(memo(w) if len(w) <= MEMO_CHARS else self._word(w) for w in words)
        return total & 0xFFFFFFFF, total >> 32


_counters: dict[str, Counter] = {}


def count(df: DataFrame, pieces: list[tuple[str, float]], text_col: str = "text", keep: list[str] | None = None, out_cols: tuple[str, str] = ("n_tokens", "n_unknown")) -> DataFrame:
    """Add the pieces of each text and the unknown ones among them. The vocabulary is broadcast (about a MB)."""
    packed = pickle.dumps(pieces)
    key, shared = hashlib.sha256(packed).hexdigest(), df.sparkSession.sparkContext.broadcast(packed)

    def kernel():
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(pickle.loads(shared.value))
        counter = _counters[key]

        def run(columns):
            made = [counter.count(t.as_py()) for t in columns[0]]
            return [pa.array([m[k] for m in made], pa.int64()) for k in range(2)]

        return run

    return map_columns(df, [text_col], f"`{out_cols[0]}` bigint, `{out_cols[1]}` bigint", kernel, keep)
