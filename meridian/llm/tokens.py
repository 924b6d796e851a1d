"""Token counts by finite-state tokenizer compilation.

A byte-pair vocabulary with word ends is compiled into a deterministic
transducer over the bytes of a word. A sequence of tokens is the byte-pair
encoding of its text exactly if each two neighbours are the encoding of their
concatenation, so the state after a prefix needs only, for every suffix that a
longer token may still begin with, the last token before it. States are
determinised as texts reach them; each transition carries by how much the
number of emitted tokens changes (it can fall, when a longer token replaces
several).

White space ends every word and is dropped, so it resets the transducer. A
chunk's state map is therefore (bytes before its first white space, tokens
counted between, bytes after its last white space); maps compose
associatively, and a prefix scan over the chunks of a long text gives the count
before each chunk. Short texts are one chunk.

Null texts count as empty (0 tokens). Texts of any length work: a text is cut
into chunks of ``chunk_chars``, and memory for memoised words and states is
bounded by parameters.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the vocabulary's pre-tokenizer.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_START = -1
_NO_SPACE = regex.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer doesn't
_PIECE = regex.compile(r"(?:[^\s]|[\x1c-\x1f])+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


class WordTransducer:
    """Counts the byte-pair tokens of single words; compiled lazily, at most ``max_states`` states at a time."""

    def __init__(self, model: dict, max_states: int = 200_000):
        letters = byte_letters()
        number = {x: b for b, x in enumerate(letters)}
        end = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ", 1)): i for i, m in enumerate(model["merges"])}
        self.letters = [*letters, *(x + end for x in letters)]
        self.spelling: list[str] = []
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token in model["vocab"]:
            body = token[: -len(end)] if end and token.endswith(end) and token != end else token
            if not all(x in number for x in body):
                continue
            symbols = [number[x] for x in body]
            if body is not token and len(body) < len(token):
                symbols[-1] += 256
            node = 0
            for s in symbols:
                to = self.children[node].get(s)
                if to is None:
                    to = len(self.children)
                    self.children[node][s] = to
                    self.children.append({})
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = len(self.spelling)
            self.spelling.append(token)
        self.parts = [self._split(t, end) for t in self.spelling]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.max_states = max_states
        self._clear()

    def _split(self, token: str, end: str) -> tuple[str, ...]:
        if end and token.endswith(end) and token != end:
            body = token[: -len(end)]
            return (*body[:-1], body[-1] + end)
        return tuple(token)

    def _clear(self) -> None:
        self.states: list[tuple] = [((0, _START, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, parts: tuple[str, ...]) -> list[str]:
        """Byte-pair encoding by its definition; only ever applied to two tokens' letters."""
        parts = list(parts)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def fits(self, before: int, token: int) -> bool:
        known = self.pairs.get((before, token))
        if known is None:
            own = self.parts[token]
            if before == _START:
                known = self.merge(own) == [self.spelling[token]]
            else:
                known = self.merge(self.parts[before] + own) == [self.spelling[before], self.spelling[token]]
            self.pairs[before, token] = known
        return known

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition of a state on a symbol: (next state, change of the number of tokens)."""
        alive, last, count = [], None, 0
        for node, before, relative in self.states[state]:
            to = self.children[node].get(symbol)
            if to is None:
                continue
            token = self.token_at[to]
            if last is None and token >= 0 and self.fits(before, token):
                last, count = token, relative + 1
            if self.children[to]:
                alive.append((to, before, relative))
        if last is None:
            raise ValueError("the vocabulary lacks a single byte")
        entry = (*((n, b, r - count) for n, b, r in alive), (0, last, 0))
        to = self.number.get(entry)
        if to is None:
            to = self.number[entry] = len(self.states)
            self.states.append(entry)
            self.moves.append({})
        self.moves[state][symbol] = (to, count)
        return to, count

    def count(self, word: bytes) -> int:
        """Tokens of one word, whose last byte carries the word end."""
        if len(self.states) > self.max_states:
            self._clear()
        state = total = 0
        moves = self.moves
        for b in word[:-1]:
            step = moves[state].get(b)
            if step is None:
                step = self.compile(state, b)
            state = step[0]
            total += step[1]
        b = word[-1] + 256
        step = moves[state].get(b)
        if step is None:
            step = self.compile(state, b)
        return total + step[1]


#: The state map of a chunk without white space is its text alone; else (head, tokens between, tail).
ChunkMap = tuple[str, int | None, str]


class Tokenizer:
    """Counts of whole texts: special strings, normalisation, words, transducer."""

    def __init__(self, content: str, chunk_chars: int = 1 << 18, max_memo: int = 400_000):
        whole = json.loads(content)
        self.words = WordTransducer(whole["model"])
        special = [t["content"] for t in whole.get("added_tokens", []) if t.get("special")] or list(SPECIAL)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.pretoken = regex.compile(PRETOKEN)
        self.chunk_chars, self.max_memo = chunk_chars, max_memo
        self.memo: dict[str, int] = {}

    def run(self, piece: str) -> int:
        """Tokens of a piece of text without white space."""
        total = 0
        at = 0
        for hit in [*self.special.finditer(piece), None]:
            part = piece[at : hit.start() if hit else None]
            if part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                for word in self.pretoken.findall(part.lower()):
                    total += self.words.count(word.encode())
            if hit:
                total += 1
                at = hit.end()
        return total

    def pieces(self, text: str) -> list[str]:
        if not _NO_SPACE.search(text):
            return text.split()
        return _PIECE.findall(text)

    def tally(self, pieces: Iterable[str]) -> int:
        memo, total = self.memo, 0
        for piece in pieces:
            n = memo.get(piece)
            if n is None:
                n = self.run(piece)
                if len(piece) < 64:
                    if len(memo) >= self.max_memo:
                        memo.clear()
                    memo[piece] = n
            total += n
        return total

    def chunk_map(self, chunk: str) -> ChunkMap:
        """What a chunk does to any state it may be entered in."""
        pieces = self.pieces(chunk)
        opens, closes = not chunk[:1].isspace(), not chunk[-1:].isspace()
        opens |= bool(_NO_SPACE.match(chunk[:1]))
        closes |= bool(_NO_SPACE.match(chunk[-1:]))
        if not pieces:
            return "", 0, ""
        if len(pieces) == 1 and opens and closes:
            return chunk, None, ""
        head = pieces.pop(0) if opens else ""
        tail = pieces.pop() if closes and pieces else ""
        return head, self.tally(pieces), tail

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b; associative."""
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        joint = a[2] + b[0]
        return a[0], a[1] + b[1] + (self.run(joint) if joint else 0), b[2]

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan: pairs are composed, the half is scanned, and the odd places filled in."""
        if len(maps) < 2:
            return maps
        half = self.scan([self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(half[i // 2] if i % 2 else self.compose(half[i // 2 - 1], maps[i]))
        return out

    def finish(self, whole: ChunkMap) -> int:
        """Tokens of a text whose map is whole."""
        return (whole[1] or 0) + sum(self.run(x) for x in (whole[0], whole[2]) if x)

    def count(self, text: str) -> int:
        if len(text) <= self.chunk_chars:
            return self.tally(self.pieces(text))
        n = self.chunk_chars
        return self.finish(self.scan([self.chunk_map(text[i : i + n]) for i in range(0, len(text), n)])[-1])


@functools.lru_cache(maxsize=2)
def compiled(content: str) -> Tokenizer:
    """One compilation a Python worker and vocabulary."""
    return Tokenizer(content)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (one row out for each row in, repeated rows too).

    The vocabulary is a file of known size on the driver and is sent to the
    executors once. Nothing is shuffled.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(content.value)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                counts = [tokenizer.count(t) if t else 0 for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_column)
    kind = dict(docs.dtypes)[id_column]
    slim = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
