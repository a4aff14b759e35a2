"""Counts of the tokens of a sentencepiece BPE vocabulary, by rank-synchronous array merging.

The distinct words of a batch of texts are held as ragged numpy arrays of
pieces. In each step every sequence merges its pair of the lowest rank, all
sequences at once and everywhere in a sequence where the pair stands, until no
sequence has a pair left; what survives is counted. Nothing is shuffled.

Why this gives the library's counts: no piece reaches across the beginning of a
word, nor across two characters that stand together in no piece, so texts may be
cut there. The library merges one pair at a time, of the lowest rank and then
leftmost. A merge can only bring forward another one if a longer piece around it
has a lower rank; for such pieces a step merges only the leftmost pair. Blanks
in a row merge after all else, in a pass from the left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame

#: Texts over this many tokens are marked.
LIMIT = 4096
#: Bytes of text that are merged together; a longer text goes alone.
CHUNK = 1 << 23
#: What a vocabulary writes for a blank.
BLANK = "▁"
NO_PAIR = np.iinfo(np.int32).max


class Vocabulary:
    """The merges of a sentencepiece BPE model as arrays."""

    def __init__(self, model: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        probe = " a  b" + BLANK + "ﬁ１\n"
        if library.normalize(probe) != BLANK + probe.replace(" ", BLANK):
            raise ValueError("only vocabularies that keep texts as they are, with a blank before them, are counted")
        ids = [i for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        pieces = [library.id_to_piece(i) for i in ids]
        blank = [p.strip(BLANK) == "" for p in pieces]
        if not any(library.is_byte(i) for i in range(library.get_piece_size())):
            raise ValueError("the vocabulary has no bytes to fall back to")
        if odd := [p for p, b in zip(pieces, blank, strict=True) if not b and BLANK in p[1:]]:
            raise ValueError(f"pieces that reach over the beginning of a word: {odd[:5]}")
        scores = {p: library.get_score(i) for p, i, b in zip(pieces, ids, blank, strict=True) if not b and len(p) > 1}
        lasts = [library.get_score(i) for p, i, b in zip(pieces, ids, blank, strict=True) if b and len(p) > 1]
        if len(set(scores.values())) < len(scores) or lasts and (len(set(lasts)) > 1 or lasts[0] >= min(scores.values())):
            raise ValueError("merges without an order of their own")
        #: Blanks in a row that are one piece.
        self.runs = {len(p) for p, b in zip(pieces, blank, strict=True) if b}
        self.run_tokens = [0]
        self._run: list[int] = []
        # Single characters are numbered after the merged pieces, whose numbers are their ranks.
        ranked = sorted(scores, key=scores.__getitem__, reverse=True)
        number = {p: k for k, p in enumerate(ranked)}
        letters = sorted({c for p in pieces for c in p})
        known = set(pieces)
        number |= {c: len(ranked) + k for k, c in enumerate(letters)}
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.letter_pieces = np.array([number[c] for c in letters], np.int32)
        #: Of a letter that is no piece itself, and so bytes if nothing takes it up.
        self.bare = np.array([c not in known for c in letters], bool)
        self.blank_piece = number[BLANK]
        self.size = len(number)
        pairs = {(number[p[:k]], number[p[k:]]): r for p, r in list(number.items()) if len(p) > 1 for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        keys = np.array([a * self.size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(pairs.values()), np.int32)[order]
        #: Pieces that a longer one of a lower rank may take up at once.
        self.hasty = np.zeros(len(ranked), bool)
        for (a, b), r in pairs.items():
            for part in (a, b):
                if part < len(ranked) and r < part:
                    self.hasty[part] = True
        neighbours = {(a, b) for p in ranked for a, b in zip(p, p[1:], strict=False)}
        self.neighbours = np.array(sorted((ord(a) << 32) | ord(b) for a, b in neighbours), np.int64)

    def blanks(self, n: int) -> int:
        """Tokens of ``n`` blanks in a row."""
        while len(self.run_tokens) <= n:
            self._run.append(1)
            while len(self._run) > 1 and self._run[-2] + self._run[-1] in self.runs:
                self._run[-2:] = [self._run[-2] + self._run[-1]]
            self.run_tokens.append(len(self._run))
        return self.run_tokens[n]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_PAIR if it is none."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_PAIR)

    def word_tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word with a blank before it: its tokens, and whether the blank is one of them."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.cumsum(lengths) - lengths
        points = np.frombuffer((BLANK + BLANK.join(words)).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), lengths)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        found = self.letters[at] == points
        spelled = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        pieces = np.where(found, self.letter_pieces[at], -1)
        weight = np.where(found & ~self.bare[at], 1, spelled)
        # Sequences end where two characters stand together in no piece.
        together = np.zeros(len(points), bool)
        keys = (points[:-1].astype(np.int64) << 32) | points[1:]
        place = np.minimum(np.searchsorted(self.neighbours, keys), len(self.neighbours) - 1)
        together[1:] = self.neighbours[place] == keys
        together[first] = False
        alone = ~together
        alone[:-1] &= ~together[1:]
        counts = np.bincount(word[alone], weights=weight[alone], minlength=len(words)).astype(np.int64)
        blank = alone[first]
        rest = np.flatnonzero(~alone)
        if len(rest):
            head = ~together[rest]
            left, sequences = self.merged(pieces[rest], head)
            owner = word[rest]
            weights = weight[rest]
            # A letter that was never merged weighs what it weighed; a merged piece weighs one.
            counts += np.bincount(owner[left], weights=np.where(sequences < self.size - len(self.letters), 1, weights[left]), minlength=len(words)).astype(np.int64)
            single = left[sequences == self.blank_piece]
            blank[owner[single]] = True
        return counts, blank

    def merged(self, pieces: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the surviving pieces of all sequences begin, and which they are; ``head`` marks a sequence's first."""
        where = np.arange(len(pieces))
        ended_at, ended = [], []
        rank = np.full(len(pieces), NO_PAIR, np.int32)
        inner = np.flatnonzero(~head) - 1
        rank[inner] = self.ranks(pieces[inner], pieces[inner + 1])
        while len(pieces):
            heads = np.flatnonzero(head)
            best = np.minimum.reduceat(rank, heads)
            sequence = np.cumsum(head) - 1
            going = (best != NO_PAIR)[sequence]
            if not going.all():
                ended_at.append(where[~going])
                ended.append(pieces[~going])
                where, pieces, head, rank, sequence = where[going], pieces[going], head[going], rank[going], sequence[going]
                if not len(pieces):
                    break
            least = best[sequence]
            hit = np.flatnonzero(rank == least)
            # Pairs that overlap: from the left, every second one.
            begins = np.ones(len(hit), bool)
            begins[1:] = np.diff(hit) != 1
            starts = np.flatnonzero(begins)
            place = np.arange(len(hit)) - starts[np.cumsum(begins) - 1]
            chosen = place % 2 == 0
            hasty = self.hasty[least[hit]]
            if hasty.any():
                leftmost = np.ones(len(hit), bool)
                leftmost[1:] = sequence[hit[1:]] != sequence[hit[:-1]]
                chosen &= leftmost | ~hasty
            hit = hit[chosen]
            pieces[hit] = least[hit]
            keep = np.ones(len(pieces), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(pieces), bool)
            changed[hit] = True
            where, pieces, head, rank, changed = where[keep], pieces[keep], head[keep], rank[keep], changed[keep]
            # Pairs with a changed piece on either side are ranked anew.
            last = np.ones(len(pieces), bool)
            last[:-1] = head[1:]
            anew = changed.copy()
            anew[:-1] |= changed[1:]
            rank[anew & last] = NO_PAIR
            anew = np.flatnonzero(anew & ~last)
            rank[anew] = self.ranks(pieces[anew], pieces[anew + 1])
        return np.concatenate(ended_at), np.concatenate(ended)

    def text_tokens(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if pc.any(pc.match_substring(texts, BLANK)).as_py():
            texts = pc.replace_substring(texts, BLANK, " ")
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy()
        encoded = split.flatten().dictionary_encode()
        word = encoded.indices.to_numpy()
        counts, blank = self.word_tokens(encoded.dictionary.to_pylist())
        empty = np.array([not len(w) for w in encoded.dictionary.to_pylist()], bool)
        tokens = counts[word]
        # Empty words are blanks of a run that the next word's blank ends, if it stays alone.
        hollow = empty[word]
        tokens[hollow] = 0
        text = np.repeat(np.arange(len(texts)), np.diff(edges))
        if hollow.any():
            begins = hollow.copy()
            begins[1:] &= ~hollow[:-1] | (text[1:] != text[:-1])
            starts = np.flatnonzero(begins)
            ends = hollow.copy()
            ends[:-1] &= ~hollow[1:] | (text[1:] != text[:-1])
            stops = np.flatnonzero(ends) + 1
            n = stops - starts
            after = np.minimum(stops, len(word) - 1)
            joins = (stops < len(word)) & (text[after] == text[starts])
            joins[joins] &= blank[word[after[joins]]]
            tokens[starts] = [self.blanks(int(k)) for k in n + joins]
            tokens[after[joins]] -= 1
        out = np.bincount(text, weights=tokens, minlength=len(texts)).astype(np.int64)
        out[pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0] = 0
        return out


@lru_cache(maxsize=1)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def counter(model: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = vocabulary(model)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunk = np.cumsum(sizes) // CHUNK
            edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(sizes)]
            tokens = np.concatenate([np.zeros(0, np.int64), *(merges.text_tokens(batch.column(1).slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return counted


def token_counts(documents: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``documents``.

    Tokens are those of the sentencepiece BPE file ``model`` for the whole text,
    without tokens for its begin or end; strings that spell control tokens are
    ordinary text. A null text counts as empty, which has no tokens. Each row is
    counted for itself: repeated rows and null doc_ids give a row each. An empty
    table gives an empty result; other columns are not read.
    """
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    return documents.select("doc_id", "text").mapInArrow(counter(model, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
