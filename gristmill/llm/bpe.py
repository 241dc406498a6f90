"""BPE encoding and decoding by a tokenization automaton.

*Compilation.*  The automaton reads token sequences: a state for each token (what may follow once that token has
been read) and an arc for each token that may follow.  It starts with the base symbols, every arc present, and takes
the merges in order.  The gadget for a merge (a, b) -> c

- adds a state c, a copy of state b as it is at that moment,
- adds arc c to every state that has arc a at that moment,
- removes arc b from state a (and for a = b also the new arc c, since runs are merged from the left).

What is left accepts exactly the sequences that BPE gives, and every string of symbols is spelled by one accepted
path.  The copies are kept by reference: a state is its origin, the merge that made it and the arcs it lost since,
so the whole automaton takes a few integers for each merge instead of a row of all tokens for each state, and an arc
is looked up by following origins back in time.

*Encoding.*  The automaton is run over symbols together with the trie of the tokens' spellings.  A reading state is
what may still be going on: the tokens begun at earlier places and the token before each.  It is made deterministic
as it is met; from then on a symbol costs one look into the transition table, which gives the next state and the
token that ends there.  Walking back from the end of a word by the tokens' lengths gives its path.  Words that have
been met lately come from a table.  Both tables are bounded: a full one is emptied.

*Decoding* emits the labels of the path's arcs.

The split into words and the normalisation are those of the tokenizer file: in plain Python where that is known to
be the same, by the tokenizers library's own normaliser and pre-tokeniser for texts with other characters.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gristmill.session import ship

START = -1
WORDS_KEPT, STATES_KEPT = 150_000, 220_000
#: Characters for which Python's normalisation and the regex module agree with the tokenizers library.
PLAIN = re.compile("[\x00-΢Τ-՗ -₎₠-鿿가-힣]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def _pack(pairs: list[tuple[int, int]]) -> bytes:
    return array("Q", [before - START << 32 | node for before, node in pairs]).tobytes()


class MergeAutomaton:
    """The automaton over tokens, built merge by merge."""

    def __init__(self, n_symbols: int) -> None:
        self.born = [0] * n_symbols
        self.left = list(range(n_symbols))
        self.right = list(range(n_symbols))
        self.lost: dict[tuple[int, int], int] = {}

    def merge(self, a: int, b: int) -> int:
        """Apply the gadget of the next merge; the new token's state."""
        token = len(self.born)
        self.lost[a, b] = now = len(self.lost) + 1
        self.born.append(now)
        self.left.append(a)
        self.right.append(b)
        return token

    def arc(self, u: int, v: int) -> bool:
        """Whether token v may follow token u."""
        if u == START:
            return True
        born, left, right, lost = self.born, self.left, self.right, self.lost
        now = len(lost)
        while True:
            gone = lost.get((u, v))
            if gone is not None and gone <= now:
                return False
            if born[u] >= born[v]:
                if not born[u]:
                    return True
                now = born[u] - 1
                if u == v:  # the new arc at the new state: where the copied state has arc a
                    v = left[v]
                u = right[u]
            else:
                if u == left[v] == right[v]:
                    return False
                now = born[v] - 1
                v = left[v]


class Encoder:
    """Tables of one tokenizer file (a BPE with an end-of-word suffix over bytes)."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.definition = definition
        self.library = None
        symbols = byte_symbols()
        base = symbols + [s + suffix for s in symbols]
        number = {s: i for i, s in enumerate(base)}
        automaton = MergeAutomaton(len(base))
        spelling = [(i,) for i in range(len(base))]
        for a, b in model["merges"]:
            x, y = number[a], number[b]
            if a + b in number:
                raise ValueError(f"two merges make {a + b!r}")
            number[a + b] = automaton.merge(x, y)
            spelling.append(spelling[x] + spelling[y])
        self.arc = automaton.arc
        self.lengths = [len(s) for s in spelling]
        self.ids = [vocab[s] for s in number]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: s for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None
        self.trie: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for token, spelled in enumerate(spelling):
            at = 0
            for s in spelled:
                key = at << 9 | s
                if key not in self.trie:
                    self.trie[key] = nodes
                    nodes += 1
                at = self.trie[key]
            self.ends[at] = token
        self.coded: dict[str, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        self.table: dict[int, int] = {}
        # a state lists (token before, place in the trie), packed, since there are many
        self.states: list[bytes] = [_pack([(START, 0)])]
        self.numbers = {self.states[0]: 0}

    def _step(self, state: int, symbol: int) -> int:
        """Work out a transition that isn't in the table: next state and the token that ends here."""
        alive, last = [], None
        for packed in array("Q", self.states[state]):
            before, node = (packed >> 32) + START, packed & 0xFFFFFFFF
            to = self.trie.get(node << 9 | symbol)
            if to is None:
                continue
            token = self.ends.get(to)
            if token is not None and self.arc(before, token):
                last = token
            alive.append((before, to))
        new = _pack([*alive, (last, 0)])
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        self.table[state << 9 | symbol] = found = number << 20 | last
        return found

    def path(self, word: bytes) -> list[int]:
        """The automaton's tokens for the bytes of one word."""
        state, table, lasts = 0, self.table, []
        end = len(word) - 1
        for i, b in enumerate(word):
            symbol = b if i < end else b + 256
            found = table.get(state << 9 | symbol)
            if found is None:
                if len(self.states) > STATES_KEPT:  # start anew from this state, even within a very long word
                    held = self.states[state]
                    self._reset()
                    table, state = self.table, self.numbers.setdefault(held, len(self.states))
                    if state == len(self.states):
                        self.states.append(held)
                found = self._step(state, symbol)
            state = found >> 20
            lasts.append(found & 0xFFFFF)
        at, out = len(lasts), []
        while at:
            token = lasts[at - 1]
            out.append(token)
            at -= self.lengths[token]
        return out[::-1]

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        found = np.array([self.ids[t] for t in self.path(word.encode())], "<u4").tobytes()
        if len(word) <= 64:
            if len(self.coded) >= WORDS_KEPT:
                self.coded.clear()
            self.coded[word] = found
        return found

    def split(self, text: str) -> list[str]:
        """Normalised words."""
        if PLAIN.fullmatch(text):
            return self.words(unicodedata.normalize("NFC", text).lower())  # words hold no white space
        if self.library is None:
            from tokenizers import Tokenizer

            spec = json.loads(self.definition)
            spec["pre_tokenizer"]["pretokenizers"] = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
            self.library = Tokenizer.from_str(json.dumps(spec))
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        parts = self.special_split(text) if self.special_split else [text]
        get, out = self.coded.get, []
        for part in parts:
            if part in self.specials:
                out.append(self.specials[part].to_bytes(4, "little"))
            elif part:
                out += [get(w) or self.word(w) for w in self.split(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Labels of the path's arcs, as the file (which has no decoder) joins them."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The compiled tables, once for each worker process."""
    key = hashlib.sha1(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def _definition(path: str) -> str:
    """A tokenizer file, read by the driver; executors get it by broadcast (about 2 MB)."""
    return Path(path).read_text(encoding="utf-8")


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Token ids of whole texts, and digests of the ids and of what they decode to.

    :param docs: text and other columns, which are kept; null texts count as empty.
    :param path: a tokenizer file of the tokenizers library: BPE over bytes with an end-of-word suffix.
    :return: the columns of ``docs`` but text, then n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``,
        ids; columns of these names in ``docs`` are replaced.

    Special tokens in a text become their ids, none are added.  Empty texts have no tokens.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_definition(path))
    new = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        new = new.add("ids", T.ArrayType(T.IntegerType()))
    kept = [c for c in docs.columns if c not in ("text", *new.names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = encoder(shared.value)
        for batch in batches:
            step = 500  # rows of output held at once
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                n, digests, decoded, coded = [], [], [], []
                for text in rows.column("text").to_pylist():
                    ids = tables.encode(text or "")
                    n.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(tables.decode(ids).encode()).hexdigest())
                    if with_ids:
                        coded.append(ids)
                columns = [rows.column(c) for c in kept] + [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    ends = pa.array(np.cumsum([0, *n]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new.names])

    schema = T.StructType([docs.schema[c] for c in kept] + new.fields)
    return docs.select(*(f"`{c}`" for c in kept), "text").mapInArrow(run, schema)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with ``decoded``: the text of its ids.  Null ids count as none; a column ``decoded`` is replaced."""
    ship(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast(_definition(path))
    kept = [c for c in coded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = encoder(shared.value)
        for batch in batches:
            texts = [tables.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, "decoded"])

    schema = T.StructType([coded.schema[c] for c in kept]).add("decoded", "string")
    return coded.select(*(f"`{c}`" for c in kept)).mapInArrow(run, schema)
