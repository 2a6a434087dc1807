"""BPE encoding as a transducer with bounded lookahead, and decoding as a state machine from bytes to text."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Entries of a task's table of known words, and characters of a text worked on at a time.
KNOWN_WORDS = 200_000
PIECE_CHARS = 1_000_000
NO_RULE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + others.index(b)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Letters behind a token's end that can still change the token, at most.

    Two texts with a common beginning are merged alike up to a border, at first its end. Only a rule (u, v) moves the
    border, by the length of u, and only if in one of the texts v starts there. What starts there after a move
    over u starts with u; and rules are applied by rank. So the way of the border is a chain of rules of rising rank in
    which each right side starts with the left side before it; the longest such chain bounds it.
    """
    best: dict[str, int] = {}
    longest = 0
    for u, v in merges:
        chain = len(u) + max((best.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        best[u] = max(best.get(u, 0), chain)
        longest = max(longest, chain)
    return longest


class Rules:
    """Merge rules on token numbers, looked up for whole arrays of pairs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        made: dict[str, int] = {}
        for rank, (u, v) in enumerate(merges):
            if max(made.get(u, -1), made.get(v, -1)) >= rank:
                raise ValueError("a rule uses a token that is made later")
            made[u + v] = rank
        keys = np.array([vocab[u] << 32 | vocab[v] for u, v in merges], np.uint64)
        results = np.array([vocab[u + v] for u, v in merges], np.int32)
        ranks = np.arange(len(merges), dtype=np.int32)
        # Two tables by hash; the second holds what found its place taken in the first.
        self.tables = []
        while len(keys):
            table = np.full(1 << 18, np.uint64(2**64 - 1)), np.full(1 << 18, NO_RULE), np.zeros(1 << 18, np.int32)
            multiplier = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables) * 0x1234567)
            at = (keys * multiplier) >> np.uint64(46)
            _, first = np.unique(at, return_index=True)
            for column, values in zip(table, (keys, ranks, results)):
                column[at[first]] = values[first]
            self.tables.append((multiplier, *table))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks, results = keys[rest], ranks[rest], results[rest]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the rule for each pair, or NO_RULE, and the token it makes."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        rank, result = np.full(len(keys), NO_RULE), np.zeros(len(keys), np.int32)
        for multiplier, held, ranks, results in self.tables:
            at = ((keys * multiplier) >> np.uint64(46)).astype(np.int64)
            hit = np.flatnonzero(held[at] == keys)
            rank[hit], result[hit] = ranks[at[hit]], results[at[hit]]
        return rank, result


class Tokenizer:
    """A BPE vocabulary file with its merge rules, text preparation and decoding."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.rules = Rules(self.vocab, merges)
        plain = [(u, v.removesuffix(self.suffix) + "\n" if self.suffix and v.endswith(self.suffix) else v) for u, v in merges]
        self.lookahead = sufficient_lookahead(plain)
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int32)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int32)
        names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names |= {i: t for t, i in self.special.items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        lengths = [len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t in self.tokens]
        self.lengths = np.array(lengths, np.int64)
        self.window = 4 * (self.lookahead + int(self.lengths.max()))
        self.known: dict[str, bytes] = {}
        library = tokenizers.Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.letter_bytes = {c: b for b, c in enumerate(letters)}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", BLANK[1:-1]))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.byte_decoder = spec["decoder"] is not None
        self._prepare_decoding(letters)

    # Encoding

    def merged(self, words: list[bytes], final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and how many each has. A word that is not final goes on behind its last byte.

        All words are merged at once: in each round every word applies its rule of lowest rank, wherever it fits from
        the left, until no word has a rule left.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        token = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes) - 1
        closing = ends[final]
        token[closing] = self.last[np.frombuffer(b"".join(words), np.uint8)[closing]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_tokens, done_words = [], []
        while len(token):
            same = word[1:] == word[:-1]
            rank, result = self.rules.find(token[:-1], token[1:])
            rank = np.append(np.where(same, rank, NO_RULE), NO_RULE)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(token))))
            over = least == NO_RULE
            done_tokens.append(token[over])
            done_words.append(word[over])
            chosen = (rank == least) & ~over
            # Of places in a row, which overlap, every second one from the left.
            at = np.flatnonzero(chosen)
            if len(at):
                fresh = np.concatenate([[True], np.diff(at) > 1])
                at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))) % 2 == 0]
            token[at] = result[at]
            over[at + 1] = True
            token, word = token[~over], word[~over]
        token, word = np.concatenate(done_tokens or [token]), np.concatenate(done_words or [word])
        order = np.argsort(word, kind="stable")
        return token[order], np.bincount(word, minlength=len(words))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token numbers of each word as 32-bit integers.

        A word longer than the window passes through it: tokens that end at least the lookahead before the window's end
        cannot change any more and are given out, and the window moves behind them.
        """
        out: list[list[bytes]] = [[] for _ in words]
        at = [0] * len(words)
        live = [i for i, w in enumerate(words) if w]
        while live:
            parts = [words[i][at[i] : at[i] + self.window] for i in live]
            final = np.array([at[i] + self.window >= len(words[i]) for i in live])
            tokens, counts = self.merged(parts, final)
            stops = np.cumsum(counts)
            starts = stops - counts
            data = tokens.astype("<i4").tobytes()
            going = []
            for k, i in enumerate(live):
                a, b = int(starts[k]), int(stops[k])
                if not final[k]:
                    ends = np.cumsum(self.lengths[tokens[a:b]])
                    b = a + int(np.searchsorted(ends, self.window - self.lookahead, "right"))
                    at[i] += int(ends[b - a - 1])
                    going.append(i)
                out[i].append(data[4 * a : 4 * b])
            live = going
        return [b"".join(o) for o in out]

    def _split(self, text: str) -> list[str]:
        """A text without special tokens as runs between white space, prepared for the merge rules."""
        if not OTHER.search(text):
            # No mark, no case rule and no white space here differs from Python's own.
            return text.lower().split()
        return [w for w in SPACES.split(self.normalizer.normalize_str(text)) if w]

    def _words(self, run: str) -> list[str]:
        """The words of a run that has no white space."""
        if OTHER.search(run):
            # Classes of rarer letters are as old as the library's tables; it writes bytes as letters.
            parts = self.splitter.pre_tokenize_str(run)
            return [bytes(self.letter_bytes[c] for c in part).decode() for part, _ in parts]
        return [run] if run.isalpha() else self.words.findall(run)

    def _pieces(self, text: str) -> Iterator[bytes | list[str]]:
        """A text as special tokens, in numbers, and lists of runs of which none is much longer than a piece."""
        for part in self.specials.split(text):
            if part in self.special:
                yield self.special[part].to_bytes(4, "little")
                continue
            start = 0
            while start < len(part):
                stop = start + PIECE_CHARS
                if stop < len(part):
                    cut = CUT.search(part, stop)
                    stop = cut.start() if cut else len(part)
                yield self._split(part[start:stop])
                start = stop

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Token numbers of each text as 32-bit integers.

        Texts are taken together up to a piece's length; a longer one goes through piece by piece.
        """
        group, held = [], 0
        for text in texts:
            if len(text) > PIECE_CHARS:
                yield from self._encode_group(group)
                group, held = [], 0
                yield b"".join(b"".join(self._encode_group([[p]])) for p in self._pieces(text))
                continue
            group.append(list(self._pieces(text)))
            held += len(text)
            if held > PIECE_CHARS:
                yield from self._encode_group(group)
                group, held = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list[bytes | list[str]]]) -> Iterator[bytes]:
        known = self.known
        runs = dict.fromkeys(r for pieces in group for piece in pieces if isinstance(piece, list) for r in piece)
        missing = [r for r in runs if r not in known]
        if missing:
            if len(known) + len(missing) > KNOWN_WORDS:
                known.clear()
                missing = list(runs)
            words = [self._words(r) for r in missing]
            number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
            codes = self.encode_words([w.encode() for w in number])
            for r, ws in zip(missing, words):
                known[r] = codes[number[ws[0]]] if len(ws) == 1 else b"".join([codes[number[w]] for w in ws])
        for pieces in group:
            yield b"".join([p if isinstance(p, bytes) else b"".join([known[r] for r in p]) for p in pieces])

    # Decoding

    def _prepare_decoding(self, letters: list[str]) -> None:
        """Bytes of every token: those its letters stand for, or, without a byte decoder, its own with a blank behind."""
        if self.byte_decoder:
            value = {c: b for b, c in enumerate(letters)}
            pieces = [t.encode() if t in self.special or any(c not in value for c in t) else bytes(value[c] for c in t) for t in self.tokens]
        else:
            pieces = [t.encode() + b" " for t in self.tokens]
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_sizes = np.array([len(p) for p in pieces], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes

    def decode(self, ids: np.ndarray, step: int = 100_000) -> str:
        """The text of token numbers, by a machine that keeps the bytes of an unfinished character between steps.

        Bytes that are no UTF-8 become replacement characters. Numbers without a token are errors.
        """
        machine, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        for a in range(0, len(ids), step):
            part = ids[a : a + step]
            sizes = self.piece_sizes[part]
            ends = np.cumsum(sizes)
            places = np.repeat(self.piece_starts[part] - ends + sizes, sizes) + np.arange(ends[-1])
            out.append(machine.decode(self.piece_bytes[places].tobytes()))
        out.append(machine.decode(b"", True))
        text = "".join(out)
        return text if self.byte_decoder or not len(ids) else text[:-1]


# White space as the vocabulary's pattern means it; Python's own split knows four separators more.
BLANK = r"[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = regex.compile(BLANK + "+")
CUT = regex.compile(BLANK)
# Characters for which the library's own preparation is asked: separators that only Python knows, and all from the
# phonetic letters on, among which marks and case rules of their own begin.
OTHER = regex.compile(r"[\x1c-\x1f\u0250-\U0010ffff]")

_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def _lists(blobs: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every document: the token numbers of its whole text, without added ones.

    ``path`` names a vocabulary file that every executor has. Texts are streamed through the merge rules: what a task
    keeps beside the numbers of one text is a bounded table of known words. Absent and empty texts have no numbers;
    repeated rows are kept; an empty table gives no rows; columns beside doc_id and text are not read.
    """

    def run(batches):
        for doc_ids, blobs, _ in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([doc_ids, _lists(blobs)], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def _encoded(batches, path: str, decoded: bool = False):
    """Ids, token numbers and, where asked for, the decoded texts of documents, some million bytes at a time."""
    tok = tokenizer(path)
    for batch in batches:
        start, held, blobs, texts = 0, 0, [], []
        for i, blob in enumerate(tok.encode(t.as_py() or "" for t in batch.column(1))):
            blobs.append(blob)
            held += len(blob)
            if decoded:
                texts.append(tok.decode(np.frombuffer(blob, np.int32)))
            if held > 2_000_000 or i + 1 == batch.num_rows:
                yield batch.column(0).slice(start, len(blobs)), blobs, texts
                start, held, blobs, texts = i + 1, 0, [], []


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text``: the text that token numbers stand for; no numbers give an empty one."""

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            lists = batch.column(1)
            step = 256
            for a in range(0, batch.num_rows, step):
                part = lists.slice(a, step)
                values, ends = part.values.to_numpy(), part.offsets.to_numpy()
                texts = [tok.decode(values[x:y]) for x, y in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, step), part, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text``: as ``decode`` of ``encode``, with both in one pass of one worker."""

    def run(batches):
        for doc_ids, blobs, texts in _encoded(batches, path, True):
            yield pa.RecordBatch.from_arrays([doc_ids, _lists(blobs), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
