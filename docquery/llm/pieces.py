"""A piece vocabulary as a unigram model, and the parts that its operators share.

The public vocabulary is a byte-pair one whose scores are minus the rank of a
merge. Here it is read as a unigram model with these scores (that is, the same
file with the model type changed): the best segmentation has the largest sum.
Placeholder scores (below -1e8, of runs of the space mark) become the worst
ordinary score, since sums with them would lose all others in rounding. A file
of a unigram model is read as it is. Scores are single-precision numbers, summed
in double precision per chunk: exact for ranks, and for log probabilities as far
as 29 more bits go (sums that differ less than the tokenizer's own single
precision shows may be ordered differently there).

No piece has a space mark after another character, so every segmentation breaks
before each run of space marks; and a character that no piece of two characters
or more has is always alone. A text is cut there into chunks, which are
segmented once each.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10
#: Scores below this only say that a piece comes last.
PLACEHOLDER = -1e8


class Vocabulary(NamedTuple):
    pieces: tuple[tuple[str, int, float], ...]  # piece, id, score
    byte_ids: tuple[int, ...]  # ids of the pieces of the 256 bytes
    unknown_id: int
    unknown_score: float

    @classmethod
    def of(cls, names: list[str], scores: list[float], special: set[int], byte_ids: dict[int, int], unknown_id: int) -> Vocabulary:
        if missing := set(range(256)) - set(byte_ids):
            raise ValueError(f"{len(missing)} bytes have no piece; unknown characters can't be spelt")
        bytes_ = set(byte_ids.values())
        normal = [i for i in range(len(names)) if i not in special and i not in bytes_]
        worst = min((float(scores[i]) for i in normal if scores[i] > PLACEHOLDER), default=0.0)
        pieces = tuple((names[i], i, max(float(scores[i]), worst)) for i in normal)
        return cls(pieces, tuple(byte_ids[b] for b in range(256)), unknown_id, worst - UNKNOWN_PENALTY)


@lru_cache(4)
def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Reads the file on the driver; operators send the vocabulary (about
    1 MB) to the tasks, so executors need no such file. Files whose texts are
    normalised otherwise than here, with pieces defined by the user or without
    pieces of bytes are refused."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        m = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    n, kind = m.normalizer_spec, m.SentencePiece.Type
    refused = {
        "a normaliser": bool(n.precompiled_charsmap or n.normalization_rule_tsv), "no mark put first": not n.add_dummy_prefix, "spaces removed": n.remove_extra_whitespaces,
        "spaces not marked": not n.escape_whitespaces, "marks put last": m.trainer_spec.treat_whitespace_as_suffix,
        "pieces defined by the user": any(p.type == kind.USER_DEFINED for p in m.pieces),
    }
    if any(refused.values()):
        raise ValueError(f"{path} has what isn't supported: {', '.join(k for k, v in refused.items() if v)}")
    of = lambda *kinds: {i for i, p in enumerate(m.pieces) if p.type in kinds}
    byte_ids = {int(m.pieces[i].piece[3:5], 16): i for i in of(kind.BYTE)}
    special = of(kind.CONTROL, kind.UNKNOWN, kind.UNUSED)
    return Vocabulary.of([p.piece for p in m.pieces], [p.score for p in m.pieces], special, byte_ids, min(of(kind.UNKNOWN)))


def normalized(text: str | None) -> str:
    """Spaces become marks, and one mark comes first; nothing else changes."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Lattice:
    """Chunks and piece matches of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        inner: set[str] = set()
        for piece, i, score in vocabulary.pieces:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} has a space mark inside")
            self.automaton.add_word(piece, (len(piece), score, i))
            if len(piece) > 1:
                inner.update(piece)
        self.automaton.make_automaton()
        self.singles = frozenset(p for p, _, _ in vocabulary.pieces if len(p) == 1)
        self.inner = frozenset(inner)
        inner.discard(SPACE)
        word = f"[{''.join(map(re.escape, sorted(inner)))}]" if inner else "(?!)"
        self.chunks = re.compile(f"{SPACE}+{word}*|{word}+|[^{SPACE}]").findall
        self.raw = {i: p.replace(SPACE, " ").encode() for p, i, _ in vocabulary.pieces}
        self.raw |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        self.raw.setdefault(vocabulary.unknown_id, " ⁇ ".encode())
        self.raw = [self.raw.get(i, b"") for i in range(max(self.raw) + 1)]
        self.spelt = pa.array(self.raw, pa.large_binary())

    def edges(self, chunk: str):
        """(start, end, score, id) in the order of the ends, longer pieces
        first; a character that is no piece gets an unknown edge."""
        if self.singles.issuperset(chunk):
            return [(last + 1 - length, last + 1, score, i) for last, (length, score, i) in self.automaton.iter(chunk)]
        return self._with_unknown(chunk)

    def _with_unknown(self, chunk: str):
        at = 0
        single = True
        for last, (length, score, i) in self.automaton.iter(chunk):
            while at <= last:
                if at and not single:
                    yield at - 1, at, self.v.unknown_score, -1
                at, single = at + 1, False
            single |= length == 1
            yield last + 1 - length, last + 1, score, i
        while at <= len(chunk):
            if at and not single:
                yield at - 1, at, self.v.unknown_score, -1
            at, single = at + 1, False

    def n_bytes(self, chunk: str, at: int) -> int:
        return len(chunk[at].encode("utf-8", "surrogatepass"))

    def ids_of(self, chunk: str, path: list[tuple[int, int, int]]) -> list[int]:
        """The ids of (start, end, id) edges; an unknown character becomes its bytes."""
        out: list[int] = []
        for a, b, i in path:
            out += [i] if i >= 0 else [self.v.byte_ids[x] for x in chunk[a:b].encode("utf-8", "surrogatepass")]
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of ids; the mark put first is taken off."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Memo(dict):
    """What make returns for a chunk, remembered for up to twice `most` short
    chunks: when full, the newer half takes the place of the older."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, chunk: str):
        found = self.older.get(chunk)
        if found is None:
            found = self.make(chunk)
        if len(chunk) < 64:  # long chunks hardly repeat
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found


@lru_cache(2)
def lattice(vocabulary: Vocabulary) -> Lattice:
    """Built once per worker process."""
    return Lattice(vocabulary)
