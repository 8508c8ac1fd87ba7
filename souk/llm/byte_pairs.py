"""Byte-level BPE encoding by a traversal of a prefix-sharing trie, and decoding.

Merging is a function of the word alone, and the last token of a word's prefix is a
function of that prefix: among the tokens that end the prefix it is the only one that
may follow the last token of what stands before it. "May follow" means that merging
the bytes of both tokens again ends in exactly these two. So

* the distinct words of a batch of texts are inserted into a trie (edges hold byte
  strings, a node exists only where words part or end);
* one depth-first walk keeps the last token of every prefix on the path from the root
  in one list. A step down appends to it, a step back cuts it off, so a prefix that
  many words share is worked out once;
* where a word ends, its tokens are read off the list from the back.

Texts are cut into words as the vocabulary's file says (byte-level pattern; added
tokens are matched first and stand alone). The classes of that pattern are asked from
the library for every code point on which Unicode versions may differ.

Cases: null counts as empty (no ids, empty decoded text); every text round-trips, as
each of the 256 bytes is a token; repeated rows and repeated or null ids give one row
each; an empty table gives no rows; other columns of the input are ignored whatever
their names. Very long texts cost time and memory in proportion to their length, very
long words too (the walk keeps one token a byte).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame

from souk.llm.common import held, ship, small_batches

#: Bound of a generation of the per-worker table of finished words, and the longest word kept there.
TABLE_WORDS = 200_000
TABLE_CHARS = 40
#: White space of the pattern (fixed in Unicode) and the endings it cuts off. Fixed values.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


@dataclass(frozen=True)
class ByteVocabulary:
    """What the vocabulary's file says, small and of fixed size: shipped to tasks."""
    tokens: tuple[bytes, ...] = field(repr=False)                       # by id; added tokens are empty here
    merges: tuple[tuple[int, int, int], ...] = field(repr=False)        # left id, right id, id; best first
    added: tuple[tuple[str, int], ...]
    letters: str = field(repr=False)                                    # character classes as ranges
    numbers: str = field(repr=False)

    @staticmethod
    def load(vocabulary_file: str) -> ByteVocabulary:
        """Reads a file of the tokenizers library; other kinds of files are refused."""
        from tokenizers import Tokenizer

        with open(vocabulary_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not spec["normalizer"] and cut.get("type") == "ByteLevel"
                 and cut.get("use_regex") and not cut.get("add_prefix_space")
                 and (spec["decoder"] or {}).get("type") == "ByteLevel"
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                    "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        added = [(a["content"], a["id"]) for a in spec["added_tokens"]]
        if not plain or any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("not a plain byte-level merge vocabulary")
        byte_of = {c: b for b, c in byte_signs().items()}
        ids = model["vocab"]
        tokens = [b""] * (max([*ids.values(), *(i for _, i in added)]) + 1)
        for sign, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in sign)
        merges = []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.append((ids[a], ids[b], ids[a + b]))
        letters, numbers = classes(Tokenizer.from_file(vocabulary_file).pre_tokenizer)
        return ByteVocabulary(tuple(tokens), tuple(merges), tuple(added), letters, numbers)


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in the file: printable ones for themselves, the
    others numbered from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    out.update((b, chr(256 + k)) for k, b in enumerate(sorted(set(range(256)) - set(shown))))
    return out


def classes(pre) -> tuple[str, str]:
    """Letters and numbers of the library's pattern as ranges for a regular expression.
    Code points assigned in Python's Unicode tables keep their class; the library is asked
    for those that are not (planes 0 to 3 and 14; the others hold no letters)."""
    letters, numbers, unknown = [], [], []
    for c in [*range(0x40000), *range(0xE0000, 0xF0000)]:
        kind = unicodedata.category(chr(c))
        if kind == "Cn":
            unknown.append(c)
        elif kind[0] == "L":
            letters.append(c)
        elif kind[0] == "N":
            numbers.append(c)
    letters += _joined(pre, "a", unknown)
    numbers += _joined(pre, "1", unknown)
    return _ranges(sorted(letters)), _ranges(sorted(numbers))


def _joined(pre, mark: str, codes: list[int]) -> list[int]:
    """Code points that stay in one word with a mark on either side of them."""
    text = "".join(mark + chr(c) + mark for c in codes)
    starts = {a for _, (a, _) in pre.pre_tokenize_str(text)}
    return [c for k, c in enumerate(codes) if 3 * k + 1 not in starts and 3 * k + 2 not in starts]


def _ranges(codes: list[int]) -> str:
    cuts = [0, *(k for k in range(1, len(codes)) if codes[k] != codes[k - 1] + 1), len(codes)]
    return "".join(f"\\U{codes[a]:08x}-\\U{codes[b - 1]:08x}" for a, b in pairwise(cuts) if a < b)


class Node:
    """A trie node: the bytes of the edge that leads to it, its children by first byte,
    and whether a word ends here."""
    __slots__ = ("children", "edge", "ends")

    def __init__(self, edge: bytes, ends: bool):
        self.edge, self.ends, self.children = edge, ends, {}


def insert(root: Node, word: bytes) -> None:
    node, at = root, 0
    while at < len(word):
        child = node.children.get(word[at])
        if child is None:
            child = node.children[word[at]] = Node(word[at:], False)
        edge = child.edge
        if not word.startswith(edge, at):
            n = 1
            while at + n < len(word) and edge[n] == word[at + n]:
                n += 1
            upper = Node(edge[:n], False)
            upper.children[edge[n]] = child
            child.edge = edge[n:]
            node.children[word[at]] = child = upper
        at += len(child.edge)
        node = child
    node.ends = True


class ByteCodec:
    """Encoder and decoder of one vocabulary (built once per Python worker)."""

    def __init__(self, vocab: ByteVocabulary, table_words: int = TABLE_WORDS):
        self.vocab, self.table_words = vocab, table_words
        self.rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(vocab.merges)}
        self.byte_id = {t[0]: i for i, t in enumerate(vocab.tokens) if len(t) == 1}
        self._endings([i for i, t in enumerate(vocab.tokens) if t and self.merge(t) == [i]])
        self.fits: dict[int, bool] = {}
        letters, numbers, spaces = vocab.letters, vocab.numbers, SPACES
        self.cut = _pattern(letters, numbers, spaces)
        self.cut_ascii = _pattern("A-Za-z", "0-9", "\t-\r ")
        self.special = dict(vocab.added)
        self.text_of_special = {i: t for t, i in vocab.added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.table: dict[str, str] = {}           # word -> its ids, decimal and comma-joined
        self.old: dict[str, str] = {}             # the generation before
        self.changed: dict[str, str] = {}         # words whose decoded text differs

    def _endings(self, ids: list[int]) -> None:
        """Automaton over the tokens that merging can end in: ``step`` and ``fail`` move from
        state to state, ``ending`` is the longest token that ends at a state and ``shorter``
        the next shorter token that ends a token."""
        step: list[dict[int, int]] = [{}]
        state_of = {}
        for i in ids:
            s = 0
            for b in self.vocab.tokens[i]:
                if b not in step[s]:
                    step[s][b] = len(step)
                    step.append({})
                s = step[s][b]
            state_of[i] = s
        token_at = {s: i for i, s in state_of.items()}
        fail, ending = [0] * len(step), [-1] * len(step)
        order = [0]
        for s in order:
            for b, t in step[s].items():
                f = fail[s]
                while f and b not in step[f]:
                    f = fail[f]
                fail[t] = step[f][b] if s else 0
                ending[t] = token_at.get(t, ending[fail[t]])
                order.append(t)
        self.step, self.fail, self.ending = step, fail, ending
        self.shorter = {i: ending[fail[s]] for i, s in state_of.items()}
        self.size = [len(t) for t in self.vocab.tokens]

    # -- merging -----------------------------------------------------------
    def merge(self, word: bytes) -> list[int]:
        """Plain merging of a short byte string: best pair first, leftmost of equals."""
        parts = [self.byte_id[b] for b in word]
        while len(parts) > 1:
            found = [(self.rank[p], k) for k, p in enumerate(pairwise(parts)) if p in self.rank]
            if not found:
                break
            (_, token), k = min(found)
            parts[k:k + 2] = [token]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        key = a * len(self.vocab.tokens) + b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) >= 2 * self.table_words:
                self.fits.clear()
            ok = self.fits[key] = self.merge(self.vocab.tokens[a] + self.vocab.tokens[b]) == [a, b]
        return ok

    # -- the trie ----------------------------------------------------------
    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of every word, shared prefixes worked out once."""
        root = Node(b"", False)
        for w in words:
            insert(root, w.encode())
        out: dict[str, list[int]] = {}
        path, states, last = bytearray(), [0], []     # bytes from the root, automaton state and last token of every prefix
        todo = [(root, 0)]
        while todo:
            node, depth = todo.pop()
            del path[depth:], states[depth + 1:], last[depth:]
            path += node.edge
            self.step_down(node.edge, states, last)
            if node.ends:
                out[path.decode()] = self._read_back(last)
            here = len(path)
            todo.extend([(child, here) for child in node.children.values()])
        return out

    def step_down(self, edge: bytes, states: list[int], last: list[int]) -> None:
        """Appends the automaton's state and the last token of every prefix along an edge."""
        step, fail, ending, shorter, size = self.step, self.fail, self.ending, self.shorter, self.size
        known, width = self.fits.get, len(self.size)
        state, n = states[-1], len(last)
        for b in edge:
            while b not in step[state]:
                state = fail[state]
            state = step[state][b]
            states.append(state)
            n += 1
            token = ending[state]
            while (before := n - size[token]) and not (
                    ok if (ok := known(last[before - 1] * width + token)) is not None
                    else self.may_follow(last[before - 1], token)):
                token = shorter[token]
            last.append(token)

    def _read_back(self, last: list[int]) -> list[int]:
        ids, n = [], len(last)
        while n:
            ids.append(last[n - 1])
            n -= self.size[ids[-1]]
        return ids[::-1]

    # -- texts -------------------------------------------------------------
    def words(self, text: str | None) -> list[str]:
        """Words and added tokens in order."""
        if not text:
            return []
        cut = (self.cut_ascii if text.isascii() else self.cut).findall
        if self.cut_special is None or not self.cut_special.search(text):
            return cut(text)
        return [w for part in self.cut_special.split(text)
                for w in ([part] if part in self.special else cut(part))]

    def lines(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Ids (decimal, comma-joined) and decoded text of every text."""
        cut = [self.words(t) for t in texts]
        fresh = set().union(*cut).difference(self.table, self.special)
        again = {w: self.old[w] for w in fresh if w in self.old}
        fresh.difference_update(again)
        self.changed.clear()
        made = again | {s: str(i) for s, i in self.special.items()}
        for word, ids in self.encode_words(fresh).items():
            made[word] = ",".join(map(str, ids))
            if (back := self.decode(ids)) != word:
                self.changed[word] = back
        table = self.table
        out = [",".join([table[w] if w in table else made[w] for w in ws]) for ws in cut]
        back = ["".join([self.changed.get(w, w) for w in ws] if self.changed else ws) for ws in cut]
        self._keep(made)
        return list(zip(out, back, strict=True))

    def _keep(self, made: dict[str, str]) -> None:
        """Finished short words stay for the worker's next batches. A full table becomes the
        old generation; what is asked for again moves back."""
        short = {w: ids for w, ids in made.items() if len(w) <= TABLE_CHARS and w not in self.changed}
        if len(self.table) + len(short) > self.table_words:
            self.old, self.table = self.table, {}
        if len(short) <= self.table_words:
            self.table.update(short)

    def encode(self, text: str | None) -> list[int]:
        line = self.lines([text])[0][0]
        return [int(i) for i in line.split(",")] if line else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement character."""
        signs = self.text_of_special
        return b"".join([signs[i].encode() if i in signs else self.vocab.tokens[i] for i in ids]).decode("utf-8", "replace")


def _pattern(letters: str, numbers: str, spaces: str) -> re.Pattern:
    return re.compile(f"{ENDINGS}| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
                      f"|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def digest(ids: str, back: str) -> tuple[int, str, str]:
    """Number of ids, sha256 of the ids' line, sha256 of the decoded text."""
    return (ids.count(",") + 1 if ids else 0,
            hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def encode_documents(docs: DataFrame, vocabulary_file: str, with_ids: bool = False, with_text: bool = False,
                     table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; ``with_ids`` adds
    the ids, ``with_text`` the decoded text. Nothing is shuffled: each Arrow batch of
    texts has its own trie, and finished words stay in a bounded table of the worker."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ByteVocabulary.load(vocabulary_file))   # fixed size: the file's tokens
    key = f"bytes-{table_words}-{vocabulary_file}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else "")

    def run(batches):
        import pyarrow as pa

        codec = held(key, lambda: ByteCodec(shared.value, table_words))
        for batch in batches:
            made = codec.lines(batch.column("text").to_pylist())
            rows = [digest(*x) for x in made]
            cols = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
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


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
