"""Encoding with a byte-level BPE of given ranks, by merge replay over the words of the whole corpus.

The distinct words of the corpus that are no token as a whole are gathered first, each is replayed once, and texts are
then put together from their words. In a replay many words are laid out as bytes in one array. An inverted index leads
from each pair's rank to the positions where that pair begins; merges are replayed in the order of their ranks, each at
all of its positions, and only the neighbours of a merge get new entries. The table of replayed words is bounded: of a
corpus with more distinct words, those that few tasks met are replayed where they are met again, with the same result.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Where the vocabulary is unless a caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The words of the public tokenizer (fixed value): its pattern, with white space spelled as the Unicode property.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words and pieces that a worker remembers; beyond it starts anew. It bounds memory and changes no result.
REMEMBERED = 400_000
#: Longer pieces of a text aren't remembered.
LONG = 48
#: Words of the corpus whose ids are sent to all workers, at most, and words that are replayed together.
WORDS, TOGETHER = 300_000, 50_000


class MergeReplay:
    """Words of bytes to ids, for ranks that give each token's bytes its id; a lower id is merged first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}

    def rank(self, left: int, right: int) -> int:
        """The id that a pair merges to, or -1."""
        if (r := self.pair_rank.get((left, right))) is None:
            if len(self.pair_rank) > 4 * REMEMBERED:
                self.pair_rank.clear()
            r = self.pair_rank[left, right] = self.ranks.get(self.token[left] + self.token[right], -1)
        return r

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(words)
        ids, nxt, prv, begins = [], [], [], []
        index: dict[int, list[int]] = {}
        for w, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[w] = (whole,)
                continue
            start = len(ids)
            begins.append((w, start))
            ids.extend(map(self.byte_ids.__getitem__, word))
            end = len(ids)
            nxt.extend(range(start + 1, end))
            nxt.append(-1)
            prv.append(-1)
            prv.extend(range(start, end - 1))
            for i in range(start, end - 1):
                if (r := self.rank(ids[i], ids[i + 1])) >= 0:
                    index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            for i in sorted(index.pop(r, ())):
                j = nxt[i]
                if ids[i] < 0 or j < 0 or self.rank(ids[i], ids[j]) != r:
                    continue  # a neighbour took part in another merge
                ids[i], ids[j] = r, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    if (s := self.rank(r, ids[k])) >= 0:
                        if s not in index:
                            index[s] = []
                            heapq.heappush(heap, s)
                        index[s].append(i)
                h = prv[i]
                if h >= 0 and (s := self.rank(ids[h], r)) >= 0:
                    if s not in index:
                        index[s] = []
                        heapq.heappush(heap, s)
                    index[s].append(h)
        for w, i in begins:
            word_ids = []
            while i >= 0:
                word_ids.append(ids[i])
                i = nxt[i]
            out[w] = tuple(word_ids)
        return out


class Encoder:
    """Texts to ids. Keeps what it learned of words and pieces between batches, beside the words that it is given."""

    def __init__(self, vocabulary: bytes, given: dict[str, tuple[int, ...]] | None = None):
        self.replay = MergeReplay({base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)})
        self.given = given or {}
        self.split = regex.compile(WORD).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def cut(text: str) -> list[str]:
        """A text cut before every blank that a non-blank follows: no word of WORD crosses these places."""
        parts = text.split(" ")
        pieces, now = [], parts[0]
        for p in parts[1:]:
            if p and not p[0].isspace():
                pieces.append(now)
                now = " " + p
            else:
                now += " " + p
        pieces.append(now)
        return pieces

    def new_words(self, texts: list[str | None]) -> list[str]:
        """The distinct words of texts that are no token as a whole and were not met before in this way."""
        if len(self.words) + len(self.pieces) > 2 * REMEMBERED:
            self.words.clear()
            self.pieces.clear()
        found: dict[str, None] = {}
        pieces, words, ranks = self.pieces, self.words, self.replay.ranks
        for t in texts:
            for p in {*self.cut(t)} if t else ():
                if p not in pieces:
                    if len(p) <= LONG:
                        pieces[p] = ()
                    for w in self.split(p):
                        if w not in words and w not in found and w.encode() not in ranks:
                            found[w] = None
        words.update((w, ()) for w in found if len(w) <= LONG)
        return list(found)

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text, in order; none for empty and null texts."""
        if len(self.words) + len(self.pieces) > 2 * REMEMBERED:
            self.words.clear()
            self.pieces.clear()
        split, known, words = self.split, self.pieces, self.words
        cuts = [self.cut(t) if t else [] for t in texts]
        new = {p: None for c in cuts for p in c if p not in known}
        spelled = {p: split(p) for p in new}
        given = self.given
        unseen = list({w: None for ws in spelled.values() for w in ws if w not in words})
        words.update((w, given[w]) for w in unseen if w in given)
        fresh = [w for w in unseen if w not in given]
        words.update(zip(fresh, self.replay.encode([w.encode() for w in fresh])))
        long = {}
        for p, ws in spelled.items():
            (known if len(p) <= LONG else long)[p] = tuple(i for w in ws for i in words[w])
        for w in unseen:
            if len(w) > LONG:
                del words[w]
        for c in cuts:
            ids: list[int] = []
            for p in c:
                ids.extend(known[p] if p in known else long[p])
            yield ids


#: A worker's encoders by the name of the job that they belong to; those of the last two jobs are kept.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(job: str, vocabulary: bytes, table: pa.Table | None = None) -> Encoder:
    if job not in _ENCODERS:
        while len(_ENCODERS) > 1:
            del _ENCODERS[next(iter(_ENCODERS))]
        given = {} if table is None else dict(zip(table.column("word").to_pylist(), map(tuple, table.column("ids").to_pylist())))
        _ENCODERS[job] = Encoder(vocabulary, given)
    return _ENCODERS[job]


def replayed_words(df: DataFrame, text_column: str, vocabulary: bytes, most: int = WORDS) -> DataFrame:
    """(word, ids) of the distinct words of the corpus that are no token as a whole, each replayed once; where there are more
    than `most`, of those that most tasks met. Each task tells a word once as long as it remembers it, so what is shuffled
    is about the distinct words of each task, not the texts."""
    sent, job = df.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(job, sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encoder.new_words(b.column(0).to_pylist()), pa.string())], ["word"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, words = _encoder(job, sent.value), []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(encoder.replay.encode([w.encode() for w in words]), pa.list_(pa.int32()))], ["word", "ids"])

        for b in batches:
            words += b.column("word").to_pylist()
            if len(words) >= TOGETHER:
                yield done()
                words = []
        yield done()

    told = cut(df.select(text_column).mapInArrow(tell, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    if told.limit(most + 1).count() > most:
        told = told.orderBy(F.desc("n"), "word").limit(most)
    return told.select("word").mapInArrow(replay, "word string, ids array<int>")


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, counts_only: bool = False, most: int = WORDS) -> DataFrame:
    """(id_column, ids array<int>) of each row, without special tokens, or (id_column, n_tokens) with counts_only.

    Empty and null texts give an empty list (0 tokens); repeated rows and null ids give a row each; whole texts are
    encoded, of any length. Texts are read twice and never shuffled: once for the corpus's distinct words, each of which is
    replayed once, and once to be put together. What is sent to the workers is the vocabulary's file, of a fixed size near
    1 MB, and the ids of `most` words at most. Strings of special tokens in a text are ordinary text."""
    raw, job = open(vocabulary, "rb").read(), uuid.uuid4().hex
    sent = df.sparkSession.sparkContext.broadcast((raw, replayed_words(df, text_column, raw, most).toArrow()))
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(job, *sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                offsets, flat = [0], []
                for ids in encoder.encode(part.column(1).to_pylist()):
                    if counts_only:
                        flat.append(len(ids))
                    else:
                        flat.extend(ids)
                        offsets.append(len(flat))
                last = pa.array(flat, pa.int64()) if counts_only else pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), last], [id_column, "n_tokens" if counts_only else "ids"])

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, " + ("n_tokens bigint" if counts_only else "ids array<int>"))
