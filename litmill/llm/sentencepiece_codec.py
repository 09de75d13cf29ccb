"""SentencePiece BPE encoding and decoding by a table of prefixes.

The encoding of every prefix of a string ends in exactly one token. A token may be that last token if it ends where
the prefix ends (the automaton over the vocabulary finds these) and if it and the last token of what lies before it
stay two tokens when they are encoded together (the pair test). The table of last tokens is filled from left to
right, and the ids are read from it backwards. The work is linear in the text, whatever the lengths of its words.

The vocabulary file is read by the sentencepiece library; the encoding and decoding are done here.

Nulls: a null text counts as empty. An empty text gives the end id alone. Repeated rows give repeated results.
Columns other than the key and the text are left out of the result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm._base import Remember, map_rows, table

SPACE = "▁"
#: A run of marks goes with the word behind it; no piece has a mark behind another character, so chunks are independent.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Codec:
    """Encodes and decodes as the library does for a BPE model with byte fallback and the identity normaliser."""

    #: Chunks and pairs to remember, and the longest of the chunks, in characters.
    REMEMBER, PAIRS, LONGEST = 170_000, 180_000, 40

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = lib.get_piece_size()
        self.end = lib.eos_id()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.names, self.sizes = list(map(str, range(n))), list(map(len, self.pieces))
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(n) if lib.is_control(i)}
        plain = [i for i in range(n) if not (i in self.byte_of or i in self.silent or lib.is_unknown(i) or lib.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) or "\n" in self.pieces[i] for i in plain):
            raise ValueError("pieces of this model cross words; its texts can't be cut at spaces")
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: lib.get_score(i) for i in plain}
        self.pairs = Remember(self._compatible, self.PAIRS)
        self.known = Remember(self._entry, self.REMEMBER, lambda chunk: len(chunk) <= self.LONGEST)
        self.unlike: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            p = self.pieces[i]
            if len(p) == 1 or self._merged(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short string, by the merging rule itself: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, pair: int) -> bool:
        """pair: the first id times the size of the vocabulary, plus the second."""
        left, right = divmod(pair, len(self.pieces))
        a, b = self.pieces[left], self.pieces[right]
        return self._merged(a + b) == [a, b]

    def _entry(self, chunk: str) -> str:
        """A chunk's ids as text. What they decode to is kept too, unless it is the chunk itself, as it nearly always is."""
        ids = self.chunk(chunk)
        pieces, names = self.pieces, self.names
        if "".join([pieces[i] for i in ids]) != chunk and (back := self.decode_marked(ids)) != chunk:
            self.unlike[chunk] = back
        return " ".join([names[i] for i in ids])

    def chunk(self, text: str) -> list[int]:
        """Ids of a string that starts with the marks of its spaces."""
        n = len(text)
        last = [-1] * (n + 1)  # -1: the prefix ends in a character that the vocabulary doesn't have
        pairs, sizes, all_ = self.pairs, self.sizes, len(self.pieces)
        for end, (length, token) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = end - length
                left = last[before] if before else -1
                # Under 0: the text's start, or a character outside the vocabulary, which never merges.
                if left < 0 or pairs[left * all_ + token]:
                    last[end] = token
        ids: list[int] = []
        at = n
        while at:
            token = last[at]
            if token < 0:
                at -= 1
                ids.extend(self.byte_id[b] for b in reversed(text[at].encode("utf-8")))
            else:
                ids.append(token)
                at -= sizes[token]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        ids = [i for c in self.chunks(text) for i in self.chunk(c)]
        return [*ids, self.end]

    @staticmethod
    def chunks(text: str) -> list[str]:
        return CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode_marked(self, ids: list[int]) -> str:
        """The text of ids, with marks for spaces and the one that encoding puts in front."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.silent:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_marked(ids).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end, hash of the ids, hash of the text decoded from them."""
        chunks = self.chunks(text)
        ids = " ".join([*map(self.known.__getitem__, chunks), str(self.end)])
        back = "".join(map(self.unlike.get, chunks, chunks) if self.unlike else chunks).replace(SPACE, " ")
        back = back[1:] if back.startswith(" ") else back
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest()


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def encode(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> with the end id, decoded string: the real outputs."""

    def start():
        c = codec(model_path)

        def row(k, t):
            ids = c.encode(t or "")
            yield k, ids, c.decode(ids)

        return row

    kind = dict(docs.dtypes)[key]
    return map_rows(docs.select(key, F.coalesce(F.col(text), F.lit(""))), f"{key} {kind}, ids array<int>, decoded string", start)


def encode_digest(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: as encode(), with each chunk's ids and decoded text made once while remembered."""

    def start():
        c = codec(model_path)
        return lambda k, t: ((k, *c.digest(t or "")),)

    kind = dict(docs.dtypes)[key]
    return map_rows(docs.select(key, F.coalesce(F.col(text), F.lit(""))), f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), default_model())
