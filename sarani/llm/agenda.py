"""Encoding and decoding with a merge-type SentencePiece vocabulary through a score-ordered agenda.

1. A text becomes symbols: one per character, blanks as a visible mark, one mark in front.
2. The agenda holds every pair of neighbouring symbols that together form a piece, best score
   first, then leftmost. The best pair is merged, its new neighbours are entered, and pairs
   that a merge has broken are passed over, until the agenda is empty.
3. Characters that are no piece become the pieces of their bytes.

A text is first cut where no piece of the vocabulary reaches across: merges on one side then
never meet those on the other. So each distinct word is merged once per task, whatever its
frequency, and the ids of a text are those of its words in turn. The short new words of a chunk
share one agenda, kept as a table of pair scores with a row per word: each step merges the
best pair of every word. A long word has an agenda of its own.

The model file is sent to the executors with the job. `check` also runs the sentencepiece
library on every Arrow batch: it encodes all words that are new in the batch, run together
where nothing joins them, and decodes the ids of every row. A row agrees if all its words and
its decoded text do.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from sarani.llm.common import chunks, keyed_texts
from sarani.llm.pair_table import PairTable, by_width

MARK = "▁"  # stands for a blank inside pieces
CHUNK = 2 << 20
HELD_WORDS = 600_000  # merged words a task keeps from chunk to chunk
LONG_WORD = 32  # characters from which a word is searched for further cuts and has its own agenda
_IDENTITY, _BPE = "identity", 2


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised message, one level deep."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Pieces:
    """A merge-type vocabulary with byte fallback, read from a SentencePiece model file.

    Models of another type, with user-defined or unused pieces, without byte fallback, or whose
    normaliser changes characters or blanks, raise ValueError.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(wire_fields(f.read()))
        trainer = dict(wire_fields(next((v for k, v in message if k == 2), b"")))
        normaliser = dict(wire_fields(next((v for k, v in message if k == 3), b"")))
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(size)]
        is_byte = [library.is_byte(i) for i in range(size)]
        own = [not (is_byte[i] or library.is_control(i) or library.is_unknown(i)) for i in range(size)]
        plain = normaliser.get(1, b"") == _IDENTITY.encode() and not normaliser.get(2) and not normaliser.get(4, 1) and normaliser.get(5, 1)
        kinds = {dict(wire_fields(v)).get(3, 1) for k, v in message if k == 1}
        if trainer.get(3) != _BPE or sum(is_byte) != 256 or not plain or kinds - {1, 2, 3, 6}:
            raise ValueError("needs a BPE model with byte fallback, plain pieces and an identity normaliser that keeps blanks")
        self.prefix = MARK if normaliser.get(3, 1) else ""
        self._begin, self._end = (np.array([i], "<u4").tobytes() for i in (library.bos_id(), library.eos_id()))
        self.id_of = {p: i for i, p in enumerate(pieces) if own[i]}
        steps = {s: k for k, s in enumerate(sorted({library.get_score(i) for i in self.id_of.values()}, reverse=True))}
        self.rank = {p: steps[library.get_score(i)] for p, i in self.id_of.items()}
        self.byte_id = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.is_byte = is_byte
        byte_of = {i: b for b, i in enumerate(self.byte_id)}
        unknown = " ⁇ ".encode()  # how the library shows an unknown piece
        self.shown = [
            bytes([byte_of[i]]) if is_byte[i] else pieces[i].replace(MARK, " ").encode() if own[i] else unknown if library.is_unknown(i) else b""
            for i in range(size)
        ]
        self.control = [library.is_control(i) for i in range(size)]
        self.joined = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        lone = "".join(c for c in map(chr, range(128)) if not any(c in j for j in self.joined))
        self.lone = lone
        self.unlike: set[str] = set()  # words that the library encodes in another way
        if any(j[1] == MARK != j[0] for j in self.joined):
            self.cut = None  # some piece holds a blank after another character
        else:
            stop = re.escape(lone)
            self.cut = re.compile(f"{MARK}+[^{MARK}{stop}]*|[^{MARK}{stop}]+" + (f"|[{stop}]" if lone else ""))
        self.held: dict[str, bytes] = {}
        self._high_bytes = frozenset(self.byte_id[128:])
        self._build_pairs()

    def _build_pairs(self) -> None:
        """The symbol of each character, and the merged symbol and rank of each pair of symbols.

        A symbol is the id of its piece; a character that is no piece has a number above all ids.
        """
        self.size = len(self.shown)
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        symbol = lambda text: self.id_of.get(text, self.size + ord(text) if len(text) == 1 else None)
        rules = {}
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                left, right = symbol(piece[:k]), symbol(piece[k:])
                if left is not None and right is not None:
                    rules[left, right] = (i, self.rank[piece])
        self.pairs = PairTable(rules)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of short words as little-endian 32-bit numbers; all words advance together."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for width, own in by_width(lengths, LONG_WORD):
            codes = np.frombuffer("".join([words[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            inside = np.arange(width) < lengths[own][:, None]
            symbols = np.full(inside.shape, -1, np.int64)
            symbols[inside] = self.symbol_of[codes]
            self.pairs.merge(symbols, lambda rows, done, own=own: self._finish(done, own[rows], out))
        return out

    def _finish(self, symbols: np.ndarray, places: np.ndarray, out: list[bytes]) -> None:
        held = symbols >= 0
        data = symbols[held].astype("<u4").tobytes()
        ends = (4 * np.cumsum(held.sum(axis=1))).tolist()
        low = 0
        for place, high in zip(places.tolist(), ends):
            out[place] = data[low:high]
            low = high
        # Characters that are no piece become bytes.
        for i in np.flatnonzero((symbols >= self.size).any(axis=1)).tolist():
            ids = []
            for s in symbols[i][held[i]].tolist():
                ids.extend([s] if s < self.size else [self.byte_id[b] for b in chr(s - self.size).encode()])
            out[places[i]] = np.array(ids, "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """Parts of a text that no piece joins."""
        if not text:
            return []
        marked = self.prefix + text.replace(" ", MARK)
        return self.cut.findall(marked) if self.cut else [marked]

    def _parts(self, word: str) -> list[str]:
        if len(word) <= LONG_WORD:
            return [word]
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, word: str) -> list[str]:
        """The symbols left when no neighbours form a piece any more."""
        symbols, rank = list(word), self.rank.get
        n = len(symbols)
        now, agenda = [-1] * n, []  # the rank of the pair that starts at a symbol; the agenda
        for i in range(n - 1):
            r = rank(symbols[i] + symbols[i + 1])
            if r is not None:
                now[i] = r
                agenda.append(r << 32 | i)
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            entry = heapq.heappop(agenda)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if now[i] != r:
                continue
            j = after[i]
            symbols[i] += symbols[j]
            symbols[j], now[i], now[j] = "", -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(symbols[i] + symbols[k])
                if r is not None:
                    now[i] = r
                    heapq.heappush(agenda, r << 32 | i)
            p = before[i]
            if p >= 0:
                r = rank(symbols[p] + symbols[i])
                now[p] = -1
                if r is not None:
                    now[p] = r
                    heapq.heappush(agenda, r << 32 | p)
        return [s for s in symbols if s]

    def word_ids(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit numbers."""
        ids: list[int] = []
        for part in self._parts(word):
            for symbol in self.merge(part):
                known = self.id_of.get(symbol)
                ids.extend([known] if known is not None else [self.byte_id[b] for b in symbol.encode()])
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text with begin and end ids, as little-endian 32-bit numbers."""
        return self.encode_all([text])[0]

    def check(self, words: Iterable[str], ids_of: Callable[[str], bytes], library: sentencepiece.SentencePieceProcessor) -> None:
        """Notes the words that the library encodes in another way.

        Words that begin with a blank and end otherwise follow each other in one text, the others
        stand on lines of their own; if such a text differs, its words are looked at one by one.
        """
        encoded = lambda text: np.array(library.encode(text), "<u4").tobytes()
        led = [w for w in words if w[0] == MARK != w[-1]]
        alone = [w for w in words if not w[0] == MARK != w[-1]]
        in_line = lambda ws: ("".join(ws)[len(self.prefix) :].replace(MARK, " "), b"".join(map(ids_of, ws)))
        line = self.word_ids("\n")
        in_lines = lambda ws: ("\n" + "\n".join(ws).replace(MARK, " "), self.word_ids(self.prefix) + b"".join(line + ids_of(w) for w in ws))
        for own, built in ((led, in_line), (alone, in_lines)):
            text, ids = built(own)
            if own and encoded(text) != ids:
                self.unlike.update(w for w in own if encoded(built([w])[0]) != built([w])[1])

    def encode_all(self, texts: list[str], library: sentencepiece.SentencePieceProcessor | None = None) -> list[bytes]:
        """The ids of several texts, whose new words are merged together and, with a library, checked."""
        cut = [self.words(t) for t in texts]
        if len(self.held) > HELD_WORDS:
            self.held.clear()
        held = self.held
        known = [list(map(held.get, words)) for words in cut]
        new = {w for words, ids in zip(cut, known) for w, i in zip(words, ids) if i is None}
        short = [w for w in new if len(w) <= LONG_WORD]
        held.update(zip(short, self.merge_words(short)))
        long = {w: self.word_ids(w) for w in new if len(w) > LONG_WORD}
        if library and new:
            self.check(new, lambda w: held.get(w) or long[w], library)
        out = []
        for words, ids in zip(cut, known):
            if None in ids:
                ids = [(held.get(w) or long[w]) if i is None else i for w, i in zip(words, ids)]
            out.append(b"".join([self._begin, *ids, self._end]))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: one leading blank goes, bytes that are no character become U+FFFD."""
        parts = [self.shown[i] for i in ids]
        first = next((k for k, i in enumerate(ids) if not self.control[i]), None)
        if first is not None and self.prefix and parts[first].startswith(b" ") and ids[first] in self._blank_led:
            parts[first] = parts[first][1:]
        if self._high_bytes.isdisjoint(ids):
            return b"".join(parts).decode()
        out, run = [], []
        for i, part in zip(ids, parts):
            if self.is_byte[i]:
                run.append(part)
                continue
            out += [characters(b"".join(run)), part.decode()]
            run = []
        return "".join([*out, characters(b"".join(run))])

    @functools.cached_property
    def _blank_led(self) -> set[int]:
        return {i for p, i in self.id_of.items() if p.startswith(MARK)}


def characters(data: bytes) -> str:
    """The characters of a run of bytes; each byte that starts none becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


@functools.lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(SparkFiles.get(name))


@functools.lru_cache(maxsize=2)
def library_of(name: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))


def send_model(df: DataFrame, path: str) -> str:
    """Adds the model file, once read and accepted, to the files of the job; gives its name there."""
    Pieces(path)
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def sp_encode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True, digests: bool = True, check: bool = False,
) -> DataFrame:
    """doc_id, n_tokens and, as asked for, ids (array<long>), digests and `agrees`.

    `path` is a merge-type model file on the driver. Ids begin with the begin id and end with
    the end id. ids_sha256 is taken from the ids as little-endian 32-bit numbers, decoded_sha256
    from the decoded text. `agrees` tells whether ids and decoded text are those of the
    sentencepiece library, run on the same Arrow batch. Null and empty texts have only begin
    and end ids and decode to an empty text. Every input row gives a row, repeated and null ids
    too; other columns are not read; an empty table gives no rows.
    """
    texts = keyed_texts(docs, key, text)
    name = send_model(docs, path)
    schema = "doc_id long, n_tokens long" + ", ids array<long>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests + ", agrees boolean" * check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(name)
        for chunk in chunks(batches, "text", CHUNK):
            texts = chunk.column("text").to_pylist()
            library = library_of(name) if check else None
            by_words = known.cut is not None and "\n" in known.lone and bool(known.prefix)
            found = known.encode_all(texts, library if by_words else None)
            out = {"doc_id": chunk.column("doc_id"), "n_tokens": pa.array([len(b) // 4 for b in found], pa.int64())}
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in found])]).astype(np.int32)
                out["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int64)))
            listed = [np.frombuffer(b, "<u4").tolist() for b in found] if digests or check else []
            decoded = [known.decode(ids) for ids in listed]
            if digests:
                out["ids_sha256"] = pa.array([hashlib.sha256(b).hexdigest() for b in found], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())
            if check:
                if by_words:
                    like = [not known.unlike or known.unlike.isdisjoint(known.words(t)) for t in texts]
                else:
                    like = [w == ids for w, ids in zip(library.encode(texts, add_bos=True, add_eos=True, num_threads=1), listed)]
                same = [ok and library.decode(ids) == t for ok, ids, t in zip(like, listed, decoded)]
                out["agrees"] = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_pydict(out)

    return texts.mapInArrow(run, schema)


def sp_decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the decoded text of a column of ids; null ids give an empty text, null elements are left out."""
    name = send_model(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(name)
        for batch in batches:
            texts = [known.decode([i for i in row or [] if i is not None]) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    chosen = encoded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<long>").alias("ids"))
    return chosen.mapInArrow(run, "doc_id long, text string")
