"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

The library merges the best-scored adjacent pair again and again. The same
result is found left to right:

* an Aho-Corasick automaton over all pieces gives the longest piece starting
  at every position, and a table gives each piece's longest proper prefix that
  is itself a piece;
* a piece may follow another one only if the two are *compatible*: merging the
  characters of both together again ends in exactly these two pieces;
* a bitfield remembers positions from which no completion exists; when no
  piece fits at a position, it is marked, the last piece is taken back and its
  next shorter prefix is tried.

A sequence whose neighbours are all compatible is the merge result, and only
one exists. Text is cut before the search where no piece can reach across:
before a space that follows a non-space, and around characters that are in no
piece (both checked on the vocabulary when it is loaded), so results of
frequent words can be kept per worker in bounded tables.

Cases: null counts as empty (no ids, empty decoded text); a literal U+2581 is a
space to the library and here; characters without a piece become their UTF-8
bytes; very long texts cost time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from souk.llm.common import held, ship, small_batches

SPACE = "▁"
#: Bound of a generation of the per-worker table of finished chunks, and the longest chunk kept there.
CACHE_ENTRIES = 220_000
CACHE_CHARS = 48


@dataclass(frozen=True)
class Vocabulary:
    """What the model file says, small and of fixed size: shipped to tasks."""
    pieces: tuple[str, ...]                 # by id
    scores: tuple[float, ...]
    kinds: tuple[str, ...] = field(repr=False)   # n normal, b byte, c control, u unknown

    @staticmethod
    def load(model_file: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        kinds = tuple("b" if sp.is_byte(i) else "c" if sp.is_control(i) else "u" if sp.is_unknown(i)
                      else "x" if sp.is_unused(i) else "n" for i in ids)
        if "x" in kinds:
            raise ValueError("models with unused pieces are not supported")
        return Vocabulary(tuple(sp.id_to_piece(i) for i in ids), tuple(sp.get_score(i) for i in ids), kinds)


class Codec:
    """Encoder and decoder of one vocabulary (built once per Python worker)."""

    def __init__(self, vocab: Vocabulary, entries: int = CACHE_ENTRIES):
        import ahocorasick

        self.entries = entries
        self.vocab = vocab
        self.id_of = {p.replace(SPACE, " "): i for i, p in enumerate(vocab.pieces) if vocab.kinds[i] == "n"}
        self.text_of = {i: p for p, i in self.id_of.items()}
        self.score = vocab.scores
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(vocab.pieces) if vocab.kinds[i] == "b"}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.chars = {c for p in self.id_of for c in p}
        if any(c not in self.id_of for c in self.chars):
            raise ValueError("a character occurs only inside longer pieces")
        if any(re.search(r"[^ ] ", p) for p in self.id_of):
            raise ValueError("a piece reaches across a word boundary")
        auto = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            auto.add_word(p, (len(p), i))
        auto.make_automaton()
        self.matches = auto.iter
        self.shorter = {}                     # longest proper prefix that is a piece
        for p, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id_of), -1)
        self.length = {i: len(p) for p, i in self.id_of.items()}
        self.pair_ok: dict[int, bool] = {}
        self.cut = self._cutter().findall
        self.changed: dict[str, str] = {}     # chunks of the text in hand whose decoded text differs
        self.encoded = _Table(self._encode_kept, self.changed, entries)

    def _cutter(self) -> re.Pattern:
        """Cut where no piece reaches across: before a space after a non-space,
        around line feeds and between letters and other characters, as far as
        this vocabulary has no such piece."""
        inner = [a + b for p in self.id_of for a, b in zip(p, p[1:])]
        letter = re.compile(r"[^\W\d_]").match
        mixed = any(bool(letter(x[0])) != bool(letter(x[1])) and " " not in x for x in inner)
        feed = "" if "\n" in self.chars else "\n"
        if mixed:
            return re.compile(rf" *[^ {feed}]+|\n| +")
        return re.compile(rf" *[^\W\d_]+| *(?:(?![ {feed}])[\W\d_])+|\n| +")

    def _encode_kept(self, chunk: str) -> str:
        ids = self.encode_chunk(chunk)
        text = self._plain(ids)
        if text != chunk:
            self.changed[chunk] = text
        return ",".join(map(str, ids))

    # -- merging -----------------------------------------------------------
    def merge(self, text: str) -> list[int]:
        """Plain merging of a short text: best score first, leftmost of equals."""
        parts = list(text)
        get, score = self.id_of.get, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.id_of[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a * len(self.score) + b
        ok = self.pair_ok.get(key)
        if ok is None:
            if len(self.pair_ok) >= self.entries:
                self.pair_ok.clear()
            ok = self.pair_ok[key] = self.merge(self.text_of[a] + self.text_of[b]) == [a, b]
        return ok

    # -- encoding ----------------------------------------------------------
    def encode_known(self, text: str) -> list[int]:
        """Backtracking over a text whose characters all have pieces."""
        n = len(text)
        longest = [0] * n
        for end, (size, i) in self.matches(text):
            longest[end + 1 - size] = i       # matches come by end: the last one is the longest
        length, shorter, compatible = self.length, self.shorter, self.compatible
        failed = bytearray((n >> 3) + 1)      # bit p: nothing completes from position p
        out: list[int] = []
        pos, piece = 0, longest[0]
        while True:
            while piece >= 0:
                end = pos + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or compatible(out[-1], piece)):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                pos = end
                if pos == n:
                    return out
                piece = longest[pos]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= length[piece]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk; characters without a piece become byte pieces."""
        if self.chars.issuperset(chunk):
            return self.encode_known(chunk)
        out: list[int] = []
        start = 0
        for at, c in enumerate(chunk):
            if c not in self.chars:
                if at > start:
                    out += self.encode_known(chunk[start:at])
                out += [self.byte_id[b] for b in c.encode("utf-8")]
                start = at + 1
        return out + (self.encode_known(chunk[start:]) if start < len(chunk) else [])

    def chunks(self, text: str | None) -> list[str]:
        return self.cut(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.chunks(text) for i in self.encode_chunk(c)]

    # -- decoding ----------------------------------------------------------
    def _plain(self, ids: list[int]) -> str:
        out, pending = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            out.append(self.text_of.get(i, " ⁇ " if self.vocab.kinds[i] == "u" else ""))
        return "".join(out) + pending.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding puts in front is taken off."""
        return self._plain(ids).removeprefix(" ")

    # -- whole texts -------------------------------------------------------
    def lines(self, text: str | None) -> tuple[str, str]:
        """Ids (decimal, comma-joined) and decoded text."""
        self.changed.clear()
        chunks = self.chunks(text)
        ids = ",".join(map(self.encoded.__getitem__, chunks))
        back = "".join([self.changed.get(c, c) for c in chunks] if self.changed else chunks)
        return ids, back.removeprefix(" ")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids' line, sha256 of the decoded text."""
        return digest(*self.lines(text))


def digest(ids: str, back: str) -> tuple[int, str, str]:
    return (ids.count(",") + 1 if ids else 0,
            hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


class _Table(dict):
    """Results of a function for short keys (but those in ``skip``). When full, the
    table becomes the old generation; what is asked for again moves back."""

    def __init__(self, make, skip, entries):
        super().__init__()
        self.make, self.skip, self.entries, self.old = make, skip, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_CHARS and key not in self.skip:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def codec(vocab: Vocabulary, entries: int = CACHE_ENTRIES) -> Codec:
    """The worker's codec of a vocabulary."""
    return held(f"codec-{entries}-{hash(vocab.pieces)}", lambda: Codec(vocab, entries))


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = False, with_text: bool = False,
                     cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; ``with_ids`` adds
    the ids, ``with_text`` the decoded text."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary.load(model_file))   # fixed size: the model's pieces
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else "")

    def run(batches):
        import pyarrow as pa

        c = codec(shared.value, cache_entries)
        for batch in batches:
            made = [c.lines(t) for t in batch.column("text").to_pylist()]
            rows = [digest(*x) for x in made]
            cols = [batch.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ids = [np.fromstring(x[0], np.int32, sep=",") if x[0] else [] for x in made]
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                cols.append(pa.array([x[1] for x in made], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
